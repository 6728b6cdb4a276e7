"""Content: chunking, similarity samples, compression, deltas. Arrow batches where bytes must be walked."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import graph

_GEAR = np.random.default_rng(1).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def fixed_chunks(df: DataFrame, key: str, data: str, size: int) -> DataFrame:
    """(key, seq, offset, size, oid) of chunks of `size` bytes; the last is shorter. Empty content has none."""
    n = F.ceil(F.octet_length(data) / F.lit(size)).cast("int")
    cut = df.where(F.octet_length(data) > 0).select(key, F.col(data).cast("binary").alias("x"), F.explode(F.sequence(F.lit(0), n - 1)).alias("seq"))
    part = F.substring(F.col("x"), F.col("seq") * size + 1, F.lit(size))
    return cut.select(key, F.col("seq").cast("long").alias("seq"), (F.col("seq") * F.lit(size)).cast("long").alias("offset"), F.octet_length(part).cast("long").alias("size"), F.sha2(part, 256).alias("oid"))


def boundaries(data: bytes, least: int, average: int, most: int) -> list[int]:
    """Ends of content-defined chunks: a gear hash over the last 64 bytes, a stricter mask before the average size and a
    looser one after it (normalised chunking)."""
    if not data:
        return []
    gear = _GEAR[np.frombuffer(data, np.uint8)]
    h = np.zeros(len(data), np.uint64)
    for k in range(min(64, len(data))):  # the hash at i is the sum of the last 64 values, each shifted by its age
        h[k:] += gear[: len(gear) - k] << np.uint64(k) if k else gear
    bits = max(1, average.bit_length() - 1)
    top = lambda n: h >> np.uint64(64 - n) == 0
    strict, loose = np.nonzero(top(bits + 1))[0], np.nonzero(top(max(1, bits - 1)))[0]
    ends, start = [], 0
    while start < len(data):
        end = min(start + most, len(data))
        a = strict[np.searchsorted(strict, start + least) :][:1]
        b = loose[np.searchsorted(loose, start + average) :][:1]
        at = [int(x[0]) + 1 for x, stop in ((a, start + average), (b, end)) if len(x) and x[0] < stop]
        end = min([end, *at]) if len(data) - start > least else len(data)
        ends.append(end)
        start = end
    return ends


def content_chunks(df: DataFrame, key: str, data: str, least: int = 2048, average: int = 8192, most: int = 65536) -> DataFrame:
    """(key, seq, offset, size, oid) of content-defined chunks; equal stretches give equal chunks wherever they are."""
    import hashlib

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for k, x in zip(pdf["k"], pdf["x"], strict=True):
                a = 0
                for seq, b in enumerate(boundaries(x, least, average, most)):
                    rows.append((k, seq, a, b - a, hashlib.sha256(x[a:b]).hexdigest()))
                    a = b
            yield pd.DataFrame(rows, columns=["k", "seq", "offset", "size", "oid"])

    kind = df.schema[key].dataType.simpleString()
    out = df.where(F.col(data).isNotNull()).select(F.col(key).alias("k"), F.col(data).cast("binary").alias("x")).mapInPandas(run, f"k {kind}, seq long, offset long, size long, oid string")
    return out.withColumnRenamed("k", key)


def _fnv(parts: list[bytes], width: int = 1024) -> np.ndarray:
    """FNV-1a 64 of byte strings of at most `width`, a column of bytes at a time."""
    sizes = np.array([len(p) for p in parts])
    grid = np.frombuffer(b"".join(p.ljust(width, b"\0") for p in parts), np.uint8).reshape(-1, width)
    h = np.full(len(parts), 0xCBF29CE484222325, np.uint64)
    for k in range(sizes.max(initial=0)):
        h = np.where(k < sizes, (h ^ grid[:, k]) * np.uint64(0x100000001B3), h)
    return h.view(np.int64)


@F.pandas_udf(T.ArrayType(T.LongType()))
def sample_hashes(data: pd.Series) -> pd.Series:
    """FNV-1a 64 (signed) of ten windows of up to 1 KB, spread over the content; null of null."""
    out: list[np.ndarray | None] = []
    for lo in range(0, len(data), 512):
        part = [x or b"" for x in data[lo : lo + 512]]
        out.extend(_fnv([x[i * len(x) // 11 :][:1024] for x in part for i in range(1, 11)]).reshape(-1, 10))
    return pd.Series([None if x is None else h for x, h in zip(data, out, strict=True)], dtype=object)


def similarity(target: Column, candidate: Column, ratio: Column) -> Column:
    """0.7 of the part of samples that the candidate has too, multiplicity kept, and 0.3 of the ratio of sizes."""
    matches = F.size(F.filter(target, lambda x: F.array_contains(candidate, x)))
    return 0.7 * matches / F.greatest(F.lit(1), F.least(F.size(target), F.size(candidate))) + 0.3 * ratio


def numbered(df: DataFrame, order: str, name: str) -> DataFrame:
    """df with a column that numbers its rows from 0 in the order of a column, by ranges and prefix sums of their sizes: no
    task sees all rows. df is written to the shared folder on the way."""
    at = F.monotonically_increasing_id()
    dealt = graph.written(df.repartitionByRange(order).sortWithinPartitions(order).withColumn("range", F.shiftright(at, 33)).withColumn(name, at.bitwiseAND(F.lit((1 << 33) - 1))), "numbered")
    before = F.coalesce(F.sum("rows").over(W.orderBy("range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    sizes = dealt.groupBy("range").agg(F.count("*").alias("rows")).select("range", before.alias("before"))  # a row for each range
    return dealt.join(F.broadcast(sizes), "range").withColumn(name, F.col("before") + F.col(name)).drop("range", "before")


def best_bases(items: DataFrame, order: str = "id", recent: int = 50, threshold: float = 0.3, size_ratio: float = 0.8) -> DataFrame:
    """items (id, type, size, samples; optional: is_delta, threshold and size_ratio of their own) -> id, base, score: of
    the `recent` objects before an item, whatever their type, the most similar one of its type that isn't a delta, is of a
    size ratio of at least size_ratio and scores strictly over the threshold; ties go to the newest.

    The window is the definition's, so each item meets `recent` others at most: items meet those of their own block of
    `recent` numbers and of the one before it, and no group's size matters. Items without samples match nothing."""
    own = {"is_delta": F.lit(False), "threshold": F.lit(threshold), "size_ratio": F.lit(size_ratio)}
    items = items.select(*dict.fromkeys((order, "id", "type", "size", "samples")), *(F.col(c) if c in items.columns else v.alias(c) for c, v in own.items()))
    at = graph.written(numbered(items, order, "n"), "items").where(F.size("samples") > 0)
    block = F.floor(F.col("n") / recent)
    mine = at.select("id", "type", "n", "size", "samples", "threshold", "size_ratio", F.explode(F.array(block, block - 1)).alias("block"))
    theirs = at.where(~F.col("is_delta")).select(F.col("id").alias("base"), F.col("type").alias("t2"), F.col("n").alias("n2"), F.col("size").alias("s2"), F.col("samples").alias("x2"), block.alias("block"))
    ratio = F.least("size", "s2") / F.greatest("size", "s2", F.lit(1))
    near = (F.col("n2") < F.col("n")) & (F.col("n2") >= F.col("n") - recent) & F.col("type").eqNullSafe(F.col("t2")) & (ratio >= F.col("size_ratio"))
    met = mine.alias("x").join(theirs.alias("y"), (F.col("x.block") == F.col("y.block")) & near)
    scored = met.withColumn("score", similarity(F.col("samples"), F.col("x2"), ratio)).where(F.col("score") > F.col("threshold"))
    best = scored.groupBy("id", "n").agg(F.max(F.struct("score", "n2", "base")).alias("m"))
    return best.select("id", F.col("m.base").alias("base"), F.round("m.score", 6).alias("score"))


@F.pandas_udf(T.BinaryType())
def zstd_delta(data: pd.Series, base: pd.Series) -> pd.Series:
    """Zstandard with the base as raw dictionary."""
    import zstandard

    pack = lambda x, b: zstandard.ZstdCompressor(level=19, dict_data=zstandard.ZstdCompressionDict(b, zstandard.DICT_TYPE_RAWCONTENT) if b else None).compress(x)
    return pd.Series([None if x is None else pack(x, b) for x, b in zip(data, base, strict=True)])


@F.pandas_udf(T.BinaryType())
def zstd_undelta(delta: pd.Series, base: pd.Series) -> pd.Series:
    import zstandard

    back = lambda x, b: zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(b, zstandard.DICT_TYPE_RAWCONTENT) if b else None).decompress(x)
    return pd.Series([None if x is None else back(x, b) for x, b in zip(delta, base, strict=True)])


def byte_entropy(df: DataFrame, key: str, data: str, most: int = 4096) -> DataFrame:
    """(key, bits): Shannon entropy of the first 4,096 bytes, by which a codec is chosen; a fixed part of the content, as defined."""
    head = df.select(key, F.substring(F.hex(F.substring(F.col(data).cast("binary"), 1, most)), 1, 2 * most).alias("x"))
    each = head.select(key, F.explode(F.regexp_extract_all("x", F.lit("(..)"), F.lit(1))).alias("byte"))
    n = each.groupBy(key, "byte").agg(F.count("*").alias("n"))
    # -sum(p log p) = log N - sum(n log n) / N
    return n.groupBy(key).agg(F.round(F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n"), 6).alias("bits"))
