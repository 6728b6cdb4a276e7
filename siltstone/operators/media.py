"""Media: containers taken apart into segments, and three-way decisions over images, layers and tracks."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Segment = tuple[str, int, int]  # type, offset, size with its header

#: Boxes, lists and elements that hold others.
BOXES = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"udta", b"mvex", b"moof", b"traf"}
LISTS = {b"RIFF", b"LIST"}
ELEMENTS = {0x18538067: "Segment", 0x1F43B675: "Cluster", 0x1654AE6B: "Tracks", 0x114D9B74: "SeekHead", 0x1549A966: "Info", 0x1C53BB6B: "Cues", 0x1254C367: "Tags", 0x1941A469: "Attachments", 0x1043A770: "Chapters", 0x1A45DFA3: "EBML", 0xEC: "Void", 0xBF: "CRC-32"}


def boxes(x: bytes, lo: int, hi: int) -> Iterator[Segment]:
    """ISO media boxes, a parent before its children. A size of 0 reaches to the end; what isn't a whole box is `rest`."""
    while lo < hi:
        if hi - lo < 8:
            yield "rest", lo, hi - lo
            return
        size, kind = struct.unpack_from(">I4s", x, lo)
        head = 8
        if size == 1 and hi - lo >= 16:
            size, head = struct.unpack_from(">Q", x, lo + 8)[0], 16
        size = hi - lo if size == 0 else size
        if size < head or lo + size > hi:
            yield "rest", lo, hi - lo
            return
        yield kind.decode("latin-1"), lo, size
        if kind in BOXES:
            yield from boxes(x, lo + head, lo + size)
        lo += size


def chunks(x: bytes, lo: int, hi: int) -> Iterator[Segment]:
    """RIFF chunks; lists carry their form in the type, `LIST:movi`, and come before their children. Odd sizes are padded."""
    while lo < hi:
        size = struct.unpack_from("<I", x, lo + 4)[0] + 8 if hi - lo >= 8 else 0
        if not size or lo + size > hi:
            yield "rest", lo, hi - lo
            return
        kind = x[lo : lo + 4]
        if kind in LISTS and size >= 12:
            yield f"{kind.decode()}:{x[lo + 8 : lo + 12].decode('latin-1')}", lo, size
            yield from chunks(x, lo + 12, lo + size)
        else:
            yield kind.decode("latin-1"), lo, size
        lo = min(hi, lo + size + size % 2)


def glb(x: bytes) -> Iterator[Segment]:
    """Binary glTF: the header and its chunks."""
    yield "header", 0, min(12, len(x))
    lo = 12
    while lo < len(x):
        size = struct.unpack_from("<I", x, lo)[0] + 8 if len(x) - lo >= 8 else 0
        if not size or lo + size > len(x):
            yield "rest", lo, len(x) - lo
            return
        yield x[lo + 4 : lo + 8].rstrip(b"\0 ").decode("latin-1"), lo, size
        lo += size


def _vint(x: bytes, at: int, keep_marker: bool) -> tuple[int, int]:
    """(value, length) of a variable-length integer; length 0 where there is none. -1 is the unknown size."""
    if at >= len(x) or not x[at]:
        return 0, 0
    n = 9 - x[at].bit_length()
    if at + n > len(x):
        return 0, 0
    v = int.from_bytes(x[at : at + n], "big")
    if keep_marker:
        return v, n
    v &= (1 << 7 * n) - 1
    return (-1 if v == (1 << 7 * n) - 1 else v), n


def elements(x: bytes, lo: int, hi: int) -> Iterator[Segment]:
    """Matroska elements of the top level and of the segment; an unknown size reaches to the end."""
    while lo < hi:
        kind, a = _vint(x, lo, True)
        size, b = _vint(x, lo + a, False) if a else (0, 0)
        if not a or not b or lo + a + b + max(0, size) > hi:
            yield "rest", lo, hi - lo
            return
        whole = hi - lo if size < 0 else a + b + size
        name = ELEMENTS.get(kind, f"{kind:X}")
        yield name, lo, whole
        if name == "Segment":
            yield from elements(x, lo + a + b, lo + whole)
        lo += whole


def psd(x: bytes) -> Iterator[Segment]:
    """The five sections of a layered image."""
    yield "header", 0, min(26, len(x))
    lo = 26
    for name, wide in (("colours", False), ("resources", False), ("layers", len(x) > 5 and x[5] == 2)):
        head = 8 if wide else 4
        if len(x) - lo < head:
            break
        size = head + int.from_bytes(x[lo : lo + head], "big")
        if lo + size > len(x):
            break
        yield name, lo, size
        lo += size
    else:
        if lo < len(x):
            yield "pixels", lo, len(x) - lo
        return
    if lo < len(x):
        yield "rest", lo, len(x) - lo


#: What starts a part of a text model.
PARTS = (b"g ", b"o ", b"usemtl", b"facet", b"solid", b"end_header", b"element")


def model_text(x: bytes, least: int = 256 << 10, most: int = 4 << 20) -> Iterator[Segment]:
    """Text models cut at lines that start a part, once a piece has `least` bytes; at any line once it would pass `most`."""
    start = at = 0
    for line in x.splitlines(keepends=True):
        if at > start and ((at - start >= least and line.startswith(PARTS)) or at - start + len(line) > most):
            yield "lines", start, at - start
            start = at
        at += len(line)
    if at > start:
        yield "lines", start, at - start


def taken_apart(x: bytes) -> list[Segment]:
    """Segments by leading bytes; content of another kind is one segment, `data`."""
    if not x:
        return []
    if x[4:8] == b"ftyp":
        return list(boxes(x, 0, len(x)))
    for magic, parse in ((b"RIFF", lambda: chunks(x, 0, len(x))), (b"\x1aE\xdf\xa3", lambda: elements(x, 0, len(x))), (b"glTF", lambda: glb(x)), (b"8BPS", lambda: psd(x)), (b"solid ", lambda: model_text(x)), (b"ply\n", lambda: model_text(x)), (b"# OBJ", lambda: model_text(x))):
        if x.startswith(magic):
            return list(parse())
    return [("data", 0, len(x))]


def segments(df: DataFrame, key: str, data: str) -> DataFrame:
    """(key, seq, type, offset, size) of each content's segments, in order; null content has none. One content at a time
    is in memory, as it is in its row."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(k, seq, *s) for k, x in zip(pdf["k"], pdf["x"], strict=True) for seq, s in enumerate(taken_apart(x))]
            yield pd.DataFrame(rows, columns=["k", "seq", "type", "offset", "size"])

    kind = df.schema[key].dataType.simpleString()
    out = df.where(F.col(data).isNotNull()).select(F.col(key).alias("k"), F.col(data).cast("binary").alias("x")).mapInPandas(run, f"k {kind}, seq long, type string, offset long, size long")
    return out.withColumnRenamed("k", key)


def image_size(data: Column) -> Column:
    """struct(width, height) from the header of PNG, GIF, BMP and layered images; null for others."""
    head = F.hex(F.substring(data, 1, 32))
    at = lambda byte, n: F.conv(F.substring(head, 2 * byte + 1, 2 * n), 16, 10).cast("long")
    little = lambda byte, n: F.conv(F.concat(*(F.substring(head, 2 * (byte + k) + 1, 2) for k in reversed(range(n)))), 16, 10).cast("long")
    of = lambda w, h: F.struct(w.alias("width"), h.alias("height"))
    return F.when(head.startswith("89504E47"), of(at(16, 4), at(20, 4))).when(head.startswith("474946"), of(little(6, 2), little(8, 2))).when(head.startswith("424D"), of(little(18, 4), little(22, 4))).when(head.startswith("38425053"), of(at(18, 4), at(14, 4)))


# perceptual hashes


def sign_hash(values: Column) -> Column:
    """64 bits, the first value's highest: whether each is over 0."""
    return F.aggregate(values, F.lit(0).cast("long"), lambda h, x: F.shiftleft(h, 1).bitwiseOR(F.when(x > 0, 1).otherwise(0).cast("long")))


def hash_matches(hashes: DataFrame, least: float = 0.85) -> DataFrame:
    """hashes (id, hash: 64 bits as a long) -> a, b, similarity: all pairs of at least that similarity, those of equal hashes as classes.

    Items of one hash are a class, its smallest id stands for it: each other item is a row of similarity 1 with the
    class's first, and similar hashes are a row of their first items, a < b. So copies cost no rows that grow with the
    square, and two items match if their classes are one or linked. Exact: with so many bands that hashes of the least
    similarity differ in at most one bit of some band, a hash meets all within one bit of each of its bands, and the
    first such band of a pair keeps it. Null hashes match nothing.
    """
    most = max(d for d in range(65) if 1 - d / 64 >= least)
    n = most // 2 + 1
    cuts = [64 * k // n for k in range(n + 1)]
    masks = [((1 << b) - (1 << a)) - (1 << 64 if b == 64 else 0) for a, b in zip(cuts, cuts[1:], strict=False)]
    items = hashes.where("hash is not null")
    classes = items.groupBy("hash").agg(F.min("id").alias("first"))
    own = F.array(*(F.struct(F.lit(k).alias("band"), F.col("hash").bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks)))
    flips = [[0, *(1 << i if i < 63 else -1 << 63 for i in range(a, b))] for a, b in zip(cuts, cuts[1:], strict=False)]
    near = F.array(*(F.struct(F.lit(k).alias("band"), F.col("hash").bitwiseXOR(F.lit(x)).bitwiseAND(F.lit(m)).alias("key")) for k, m in enumerate(masks) for x in flips[k]))
    left = classes.select(F.col("first").alias("a"), F.col("hash").alias("ha"), F.explode(own).alias("at")).select("a", "ha", "at.*")
    right = classes.select(F.col("first").alias("b"), F.col("hash").alias("hb"), F.explode(near).alias("at")).select("b", "hb", "at.*")
    unlike = F.col("ha").bitwiseXOR(F.col("hb"))
    band = F.coalesce(*(F.when(F.bit_count(unlike.bitwiseAND(F.lit(m))) <= 1, k) for k, m in enumerate(masks)))
    meets = (left["band"] == right["band"]) & (left["key"] == right["key"]) & (F.col("a") < F.col("b")) & (F.bit_count(unlike) <= most) & (band == left["band"])
    pairs = left.join(right, meets).select("a", "b", (1 - F.bit_count(unlike) / F.lit(64)).alias("similarity"))
    copies = items.join(classes, "hash").where("id > first").select(F.col("first").alias("a"), F.col("id").alias("b"), F.lit(1.0).alias("similarity"))
    return pairs.unionByName(copies)


# decisions


def image_decision(same_size: Column, base_ours: Column, base_theirs: Column, ours_theirs: Column, least: float = 0.95) -> Column:
    """auto if dimensions are equal and all three pairs of hashes are similar; else why not."""
    return F.when(~same_size, "dimensions").when(F.least(base_ours, base_theirs, ours_theirs) >= least, "auto").otherwise("content")


def metadata_merge(base_first: str, other: str, plain: list[str], sets: list[str], most: list[str]) -> list[Column]:
    """Columns of a merged record: ours fills from theirs, sets are united, the greatest wins."""
    a, b = (lambda c: F.col(f"{base_first}.{c}")), (lambda c: F.col(f"{other}.{c}"))
    return [F.coalesce(a(c), b(c)).alias(c) for c in plain] + [F.array_sort(F.array_union(F.coalesce(a(c), F.array()), F.coalesce(b(c), F.array()))).alias(c) for c in sets] + [F.greatest(a(c), b(c)).alias(c) for c in most]


def layer_overlaps(layers: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """(key, id, x0, y0, x1, y1) twice -> key, a, b, area of rectangles that overlap with an area over 0."""
    a, b = (t.select(key, *(F.col(c).alias(c + s) for c in ("id", "x0", "y0", "x1", "y1"))) for t, s in ((layers, "_a"), (others, "_b")))
    side = lambda c: F.least(c + "1_a", c + "1_b") - F.greatest(c + "0_a", c + "0_b")
    return a.join(b, key).where((side("x") > 0) & (side("y") > 0)).select(key, F.col("id_a").alias("a"), F.col("id_b").alias("b"), (side("x") * side("y")).alias("area"))


def united(ours: DataFrame, theirs: DataFrame, *keys: str) -> DataFrame:
    """Tracks, layers or groups: all of ours, and those of theirs whose keys ours lacks."""
    return ours.unionByName(theirs.join(ours.select(*keys), list(keys), "left_anti").select(*ours.columns))
