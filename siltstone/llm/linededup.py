"""Fuzzy line deduplication: MinHash over character shingles, banding, exact Jaccard, one line kept of each component."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add, or_

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import fresh, located, table, written
from .components import components
from .tokens import forget, runs, slices

#: Characters of a shingle, MinHash values of a band, bands, least Jaccard similarity. At 0.8 a pair misses all bands
#: with probability (1 - 0.8^3)^8 = 0.3 %, at 0.9 with 0.003 %.
SHINGLE, ROWS, BANDS, LEAST = 8, 3, 8, 0.8
#: 64-bit words of a line's outline: at 16 few pairs of lines of some hundred characters below 0.78 pass its bound.
WORDS = 16
_MULTIPLY = np.random.default_rng(20).integers(0, 1 << 31, ROWS * BANDS, np.uint32) * np.uint32(2) + np.uint32(1)
_ADD = np.random.default_rng(21).integers(0, 1 << 32, ROWS * BANDS, np.uint32)


def trimmed(line: Column) -> Column:
    """Equal lines are those equal but for white space at their ends. Trimming more than spaces walks the whole line, so only lines that need it get it."""
    t = F.trim(line)
    ends = [f(t, F.lit(c)) for c in "\t\r\x0b\x0c" for f in (F.startswith, F.endswith)]
    return F.when(reduce(or_, ends), F.btrim(t, F.lit(" \t\r\x0b\x0c"))).otherwise(t)


def normal(line: str) -> str:
    """What shingles are taken from: lower case, runs of white space as one space."""
    return " ".join(line.lower().split())


def signatures(lines: list[str]) -> np.ndarray:
    """(lines, ROWS * BANDS) MinHash values of normalised lines. A line shorter than a shingle is one shingle."""
    padded = [x.ljust(SHINGLE, "\0") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    c = np.frombuffer("".join(padded).encode("utf-32-le"), "<u4")
    h = c
    for n in (1, 2, 4):  # of two characters, then four, then eight
        h = h[:-n] * np.uint32(pow(0x01000193, n, 1 << 32)) + h[n:]
    h = (h ^ (h >> np.uint32(16))) * np.uint32(0x85EBCA6B)
    h = (h ^ (h >> np.uint32(13))) * np.uint32(0xC2B2AE35)
    h ^= h >> np.uint32(16)
    starts = np.cumsum(size) - size
    cuts = np.stack([starts, starts + size - SHINGLE + 1], 1).ravel()[:-1]
    out = np.empty((len(lines), ROWS * BANDS), np.uint32)
    for k in range(ROWS * BANDS):
        out[:, k] = np.minimum.reduceat(h * _MULTIPLY[k] + _ADD[k], cuts)[::2]
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    """(lines, BANDS) signed 64-bit keys: hashes of a band's number and values."""
    parts = sig.reshape(len(sig), BANDS, ROWS).astype(np.uint64)
    h = np.arange(1, BANDS + 1, dtype=np.uint64)[None] * np.uint64(0x9E3779B97F4A7C15)
    for r in range(ROWS):
        h = (h ^ parts[:, :, r]) * np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    return h.view(np.int64)


def shingles(line: str) -> set[str]:
    """Of a normalised line."""
    return {line[i : i + SHINGLE] for i in range(max(1, len(line) - SHINGLE + 1))}


def jaccard(a: str, b: str) -> float:
    """Of the shingle sets of two normalised lines."""
    x, y = shingles(a), shingles(b)
    both = len(x & y)
    return both / (len(x) + len(y) - both)


#: Lines whose shingles are hashed at a time: a line's number takes 10 bits beside a shingle's 54.
_TOGETHER, _HASH = 1 << 10, np.uint64(54)


def tagged(lines: list[str]) -> np.ndarray:
    """Of up to 1,024 normalised lines, the distinct shingles as sorted keys: the line's number in the upper 10 bits, a
    hash of the shingle in the others."""
    padded = [x.ljust(SHINGLE, "\0") for x in lines]
    size = np.fromiter(map(len, padded), np.int64, len(padded))
    h = np.frombuffer("".join(padded).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    for n in (1, 2, 4):  # of two characters, then four, then eight
        h = h[:-n] * np.uint64(pow(0x9E3779B97F4A7C15, n, 1 << 64)) + h[n:]
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(by)
    of = np.repeat(np.arange(len(lines)), size)[: len(h)]
    whole = np.arange(len(h)) <= np.cumsum(size)[of] - SHINGLE
    keys = (h[whole] >> np.uint64(64) - _HASH) | (of[whole].astype(np.uint64) << _HASH)
    keys.sort()
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])]


def similar(a: list[str], b: list[str], least: float) -> np.ndarray:
    """Of up to 1,024 pairs of normalised lines, which have a Jaccard similarity of at least `least`. Hashes decide where
    the count of common shingles isn't within 2 of the bound, else the shingles themselves."""
    x, y = tagged(a), tagged(b)
    both = np.concatenate([x, y])
    both.sort(kind="stable")  # merges two sorted runs
    count = lambda keys: np.bincount((keys >> _HASH).astype(np.int64), minlength=len(a))
    n = count(both[1:][both[1:] == both[:-1]])
    over = n - least * (count(x) + count(y) - n)
    good = over > 0
    for k in np.nonzero(np.abs(over) <= 2)[0].tolist():
        good[k] = jaccard(a[k], b[k]) >= least
    return good


def _lines(docs: DataFrame, *keep: str) -> DataFrame:
    """(keep, no, line, h) of each line that isn't blank."""
    cut = docs.select(*keep, F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("no", "line"))
    return cut.select(*keep, "no", trimmed(F.col("line")).alias("line")).where("line <> ''").withColumn("h", F.xxhash64("line"))


def _banded(lines: DataFrame) -> DataFrame:
    """(h, line) -> (band, h); a line that comes again in a batch is hashed once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        for pdf in batches:
            pdf = pdf.drop_duplicates("h")
            own, n = [normal(x) for x in pdf["line"].tolist()], pdf["h"].to_numpy(np.int64)
            keys = [band_keys(signatures([own[i] for i in part])) for part in slices(own, 200_000)]
            if keys:  # an output batch costs more than its rows
                yield pd.DataFrame({"band": np.concatenate(keys).ravel(), "h": np.repeat(n, BANDS)})

    return lines.select("h", "line").mapInPandas(run, "band long, h long")


def _buckets(bands: DataFrame) -> DataFrame:
    """(band, first, before, h): each line of a bucket but its first, with the first and the one before it by hash.

    The window's buffer spills, and it holds hashes only."""
    by = W.partitionBy("band").orderBy("h")
    return bands.select("band", F.first("h").over(by).alias("first"), F.lag("h").over(by).alias("before"), "h").where("before < h")


def _near_first(buckets: DataFrame) -> DataFrame:
    """Distinct (u, v), u < v: each line with its buckets' firsts and with the ones before it, fewer than 2n pairs for n lines.

    They link nearly all near copies; the pairs left are those between components, see _across."""
    return buckets.select(F.explode(F.array("first", "before")).alias("u"), F.col("h").alias("v")).distinct()


def _unsettled(buckets: DataFrame, found: DataFrame) -> DataFrame:
    """(band, before, h, root, head) of the lines, but for the first, of buckets of four or more lines in which more than
    one component meets; head is the component of most of them. The first has met all others, and three lines are all neighbours."""
    rooted = buckets.join(found, "h", "left").select("band", "before", "h", F.coalesce("root", "h").alias("root"))
    per = rooted.groupBy("band", "root").agg(F.count("*").alias("n"))
    mixed = per.groupBy("band").agg(F.sum("n").alias("n"), F.count("*").alias("roots"), F.max(F.struct("n", "root")).alias("most"))
    return rooted.join(mixed.where("n >= 3 AND roots > 1").select("band", F.col("most.root").alias("head")), "band")


def outlines(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Of normalised lines: the sizes of their shingle sets, and (lines, WORDS) 64-bit words with the parities of the
    sets dealt over their bits. Two lines' words differ in at most as many bits as shingles are in one of the sets alone."""
    bits, sizes, words = 64 * WORDS, [], []
    for a in range(0, len(lines), _TOGETHER):
        keys, n = tagged(lines[a : a + _TOGETHER]), len(lines[a : a + _TOGETHER])
        of = (keys >> _HASH).astype(np.int64)
        odd = np.bincount(of * bits + (keys & np.uint64(bits - 1)).astype(np.int64), minlength=bits * n).reshape(n, bits) & 1
        sizes.append(np.bincount(of, minlength=n))
        words.append(np.packbits(odd.astype(np.uint8), axis=1).view("<i8"))
    return np.concatenate(sizes), np.concatenate(words)


def _outlined(texts: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            lines = pdf["line"].tolist()
            for part in slices(lines, 200_000, 500):
                size, words = outlines([normal(lines[i]) for i in part])
                yield pd.DataFrame({"h": pdf["h"].to_numpy(np.int64)[part], "n": size, **{f"w{k}": words[:, k] for k in range(WORDS)}})

    return texts.select("h", "line").mapInPandas(run, "h long, n long, " + ", ".join(f"w{k} long" for k in range(WORDS)))


def _across(unsettled: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """(u, v), u < v, of all pairs that share a bucket but no component and may be similar, each once.

    A pair of different components has a line outside the head's, so those lines meet all of their bucket but their
    neighbours, which they have met. The join puts out only pairs within two bounds that no similar pair breaks: the ratio
    of the sets' sizes, and the difference of their parities, at most the (1 - s) / (1 + s) part of both sizes at similarity
    s. A pair of several buckets comes from the least of them only: there too one of it is outside the head, or it has met."""
    own = unsettled.groupBy("h").agg(F.sort_array(F.collect_set("band")).alias("bands"))  # BANDS at most
    known = unsettled.join(_outlined(texts.join(own.select("h"), "h", "left_semi")), "h").join(own, "h")
    known = written(known, "unsettled")
    x, y = (known.select("band", *(F.col(c).alias(c + side) for c in ("h", "before", "root", "head", "n", "bands", *(f"w{k}" for k in range(WORDS))))) for side in "xy")
    differing = reduce(add, (F.bit_count(F.col(f"w{k}x").bitwiseXOR(F.col(f"w{k}y"))) for k in range(WORDS)))
    near = F.col("rootx") != F.col("rooty")
    near &= (F.col("rooty") == F.col("heady")) | (F.col("hx") < F.col("hy"))
    near &= (F.col("hx") != F.col("beforey")) & (F.col("hy") != F.col("beforex"))
    near &= F.least("nx", "ny") >= F.greatest("nx", "ny") * F.lit(least - 1e-9)
    near &= differing <= (F.col("nx") + F.col("ny")) * F.lit((1 - least) / (1 + least) + 1e-9)
    near &= F.array_min(F.filter("bandsx", lambda b: F.exists("bandsy", lambda c: b == c))) == F.col("x.band")
    met = x.where("rootx <> headx").alias("x").join(y.alias("y"), (F.col("x.band") == F.col("y.band")) & near)
    return met.select(F.least("hx", "hy").alias("u"), F.greatest("hx", "hy").alias("v"))


def _verified(pairs: DataFrame, texts: DataFrame, least: float) -> DataFrame:
    """The pairs whose lines have an exact Jaccard similarity of at least `least`."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = pdf["a"].tolist(), pdf["b"].tolist()
            for part in runs((len(x) + len(y) for x, y in zip(a, b, strict=True)), 300_000, _TOGETHER):
                good = similar([normal(a[i]) for i in part], [normal(b[i]) for i in part], least)
                yield pdf[["u", "v"]].iloc[part][good]

    one = texts.select(F.col("h").alias("hu"), F.col("line").alias("a"))
    two = texts.select(F.col("h").alias("hv"), F.col("line").alias("b"))
    met = pairs.join(one, pairs.u == one.hu).join(two, pairs.v == two.hv)
    return met.select("u", "v", "a", "b").mapInPandas(run, "u long, v long")


def line_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs (text) -> (h, root) of the lines that have a near copy other than themselves; root names their component.

    Every pair of similar lines that share a bucket is in one component: first lines meet the first of each bucket and the
    one before, then all pairs of a bucket that this left in different components are settled."""
    lines = _lines(docs.select("text"))
    buckets = written(_buckets(_banded(lines)), "buckets")
    wanted = buckets.select(F.explode(F.array("first", "h")).alias("h")).distinct()
    texts = written(lines.select("h", "line").join(wanted, "h", "left_semi").dropDuplicates(["h"]), "lines")
    found = components(_verified(_near_first(buckets), texts, least)).select(F.col("node").alias("h"), "root")
    found = written(found, "found")
    links = written(_verified(_across(_unsettled(buckets, found), texts, least), texts, least), "across")
    if links.isEmpty():
        return found
    one, two = found.select(F.col("h").alias("u"), F.col("root").alias("of_u")), found.select(F.col("h").alias("v"), F.col("root").alias("of_v"))
    met = links.join(one, "u", "left").join(two, "v", "left").select(F.coalesce("of_u", "u").alias("u"), F.coalesce("of_v", "v").alias("v"))
    merged = written(components(met).select("node", F.col("root").alias("top")), "merged")
    moved = found.join(merged, F.col("root") == F.col("node"), "left").select("h", F.coalesce("top", "root").alias("root"))
    return moved.union(merged.join(found, F.col("node") == F.col("h"), "left_anti").select("node", "top"))


def dedup_lines(docs: DataFrame, least: float = LEAST, removed: str = "n_removed", lines: str = "n_lines") -> DataFrame:
    """docs with each line of a component of near copies kept once in the corpus: the first by doc_id (null last), file
    and line. All columns are kept, two are added: lines (not blank) and those removed.

    Blank lines stay and count as none. Null and empty texts stay as they are. A text of which nothing is left becomes
    empty. Exact copies (but for white space at the ends) are in one component whatever their number: they are one node.
    An empty table gives an empty result.
    """
    file, row = fresh(docs, "at_file", "at_row")
    placed = located(docs, file, row)
    place = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").cast("long").alias("d"), F.col(file).alias("f"), F.col(row).alias("r"), F.col("no"))
    # two hashes, so that lines without near copies are one only if 128 bits agree
    first = _lines(placed, "doc_id", file, row).groupBy("h", F.xxhash64("line", F.lit(1)).alias("h2")).agg(F.min(place).alias("at"))
    rooted = first.join(line_classes(docs, least), "h", "left").select(F.coalesce("root", "h").alias("root"), F.when(F.col("root").isNull(), F.col("h2")).alias("h2"), "at")
    stay, count, of_file, of_row = fresh(docs, "stay", "n_stay", "of_file", "of_row")
    kept = rooted.groupBy("root", "h2").agg(F.min("at").alias("at")).select(F.col("at.f").alias(of_file), F.col("at.r").alias(of_row), F.expr("at.no div 64").alias("word"), F.expr("shiftleft(1L, at.no % 64)").alias("bit"))
    # the lines that stay as bits, so that a text of many lines is walked once
    kept = kept.groupBy(of_file, of_row, "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("n"))
    kept = kept.groupBy(of_file, of_row).agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias(stay), F.sum("n").alias(count))
    joined = placed.join(kept, (F.col(file) == F.col(of_file)) & (F.col(row) == F.col(of_row)), "left")
    cut, blank = F.split("text", "\n"), lambda x: trimmed(x) == ""
    stays = F.coalesce(F.col(count), F.lit(0))
    n = F.coalesce(F.size(F.filter(cut, lambda x: ~blank(x))), F.lit(0))
    flags = F.transform(F.sequence(F.lit(0).cast("long"), F.floor(F.size(cut) / 64)), lambda w: F.coalesce(F.try_element_at(stay, w), F.lit(0)))
    # the flags are an argument: within a lambda's body they would be made anew for each line
    left = F.transform(F.array(flags), lambda f: F.filter(cut, lambda x, i: blank(x) | (F.getbit(F.get(f, F.floor(i / 64).cast("int")), i % 64) == 1)))
    text = F.array_join(left[0], "\n")
    shorter = F.when(n == stays, F.col("text")).when(stays == 0, F.when(F.col("text").isNull(), F.col("text")).otherwise(F.lit(""))).otherwise(text)
    keep = [F.when(n == 0, F.col("text")).otherwise(shorter).alias(c) if c == "text" else F.col(c) for c in docs.columns]
    return joined.select(*keep, n.cast("long").alias(lines), (n - stays).cast("long").alias(removed))


def without_repeated_lines(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """docs with repeated lines removed and without documents of which no line is left; n_chars, if there, follows the
    text. Documents that had no line stay. The columns are those of docs."""
    gone, n, once = fresh(docs, "n_removed", "n_lines", "once")
    # so that the filter stays above the projection and the columns are made once
    out = dedup_lines(docs, least, gone, n).withColumn(once, F.monotonically_increasing_id())
    out = out.where(((F.col(n) == 0) | (F.col(gone) < F.col(n))) & (F.col(once) >= 0))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col(gone) > 0, F.char_length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return out.select(*docs.columns)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
