"""SimHash near-duplicates found by Golay-code fuzzy hashing."""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import fresh, located, table, written
from .components import components
from .tokens import forget, slices

#: Generator polynomial of the (23, 12) Golay code: x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1.
GENERATOR = 0b110001110101
#: The three segments of a fingerprint: lowest bit, bits. The last is padded with zeros.
SEGMENTS = ((0, 23), (23, 23), (46, 18))
#: Rows that a table has at most to pass through the driver.
BROADCAST_ROWS = 200_000


def fingerprints(texts: list[str], words: int = 4) -> np.ndarray:
    """Unsigned 64-bit SimHash of each text: words between ASCII white space, A-Z lowered, shingles of so many words
    with repeats, XXH64 with seed 42; a bit is set if it is in over half the shingles' hashes. No words: zero."""
    import xxhash

    digest, hashes, counts = xxhash.xxh64_intdigest, [], []
    for t in texts:
        ws = t.encode().lower().split()
        joined = b" ".join(ws)
        if len(ws) <= words:
            own = [digest(joined, 42)] if ws else []
        else:
            size = np.fromiter(map(len, ws), np.int64, len(ws))
            ends = np.cumsum(size + 1) - 1
            own = [digest(joined[a:b], 42) for a, b in zip((ends - size)[: 1 - words].tolist(), ends[words - 1 :].tolist(), strict=True)]
        hashes += own
        counts.append(len(own))
    n = np.array(counts, np.int64)
    out = np.zeros(len(n), np.uint64)
    if hashes:
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        some = np.nonzero(n)[0]
        starts = (np.cumsum(n) - n)[some]
        ones = np.add.reduceat(bits, starts, axis=0, dtype=np.int32)
        out[some] = np.packbits(2 * ones > n[some][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def simhash(text: Column) -> Column:
    """Signed 64-bit SimHash of a text column; null is a text without words."""

    @F.pandas_udf("long")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        forget()
        for s in batches:
            texts = s.tolist()
            yield pd.Series(np.concatenate([np.zeros(0, np.uint64), *(fingerprints([texts[i] for i in run]) for run in slices(texts, 500_000))]).view(np.int64))

    return f(F.coalesce(text, F.lit("")))


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def _mod(x: np.ndarray) -> np.ndarray:
    """Remainders of 23-bit polynomials by the generator."""
    x = x.copy()
    for bit in range(22, 10, -1):
        x ^= ((x >> bit) & 1) * (GENERATOR << (bit - 11))
    return x


@lru_cache(maxsize=1)
def _patterns() -> tuple[np.ndarray, np.ndarray]:
    """For each syndrome the error patterns that lead to codewords at most one bit further than the radius asks: the
    nearest codeword first and, where that is 3 bits off, the five that are 4 bits off. And how many there are."""
    errors = [sum(1 << b for b in c) for k in range(5) for c in combinations(range(23), k)]
    weight = np.array([bin(e).count("1") for e in errors])
    syn = _mod(np.array(errors, np.int64))
    table, count = np.zeros((2048, 6), np.int64), np.zeros(2048, np.int64)
    least = np.full(2048, 9)
    for e, w, s in zip(errors, weight.tolist(), syn.tolist(), strict=True):
        if w <= 3 or least[s] == 3:
            table[s, count[s]] = e
            count[s] += 1
            least[s] = min(least[s], w)
    return table, count


def nearby(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 23-bit words, the 12-bit indices of the codewords that the word, or the word with one bit changed, decodes to:
    an array of six for each word, the word's own first, and which of the six there are.

    Words that differ in one bit have each other's own index; words that differ in two share one at least, that of the
    word between them."""
    table, count = _patterns()
    syn = _mod(words)
    return (words[:, None] ^ table[syn]) >> 11, np.arange(6) < count[syn][:, None]


def keys(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row of fps, key, base key) so that fingerprints with at most 4 differing bits share a key.

    Pigeonhole: of three segments, the two with the fewest errors have two errors in all at most. For each pair of
    segments the keys are the own index of one beside each nearby index of the other. Errors (1, 1) meet in (the one's
    own index, the other's own index), (2, 0) in the index between. Base: both own indices."""
    u = fps.view(np.uint64)
    near = [nearby(((u >> np.uint64(lo)) & np.uint64((1 << n) - 1)).astype(np.int64)) for lo, n in SEGMENTS]
    rows, out, bases = [], [], []
    for p, (i, j) in enumerate(combinations(range(3), 2)):
        (a, has_a), (b, has_b) = near[i], near[j]
        base = p << 24 | a[:, 0] << 12 | b[:, 0]
        for made, has in ((p << 24 | a << 12 | b[:, :1], has_a), (p << 24 | a[:, :1] << 12 | b, has_b & (np.arange(6) > 0))):
            r, c = np.nonzero(has)
            rows.append(r)
            out.append(made[r, c])
            bases.append(base[r])
    return np.concatenate(rows), np.concatenate(out), np.concatenate(bases)


def links(fps: DataFrame, most: int = 4) -> DataFrame:
    """Distinct fingerprints (fp long) -> (u, v) with u < v, all pairs with at most 4 differing bits.

    Candidates are verified within the join, which puts out true links only; two fingerprints with the same base key
    meet under that key alone. The join is one of sorted shuffles: Spark takes the keys, up to 33 a fingerprint, for as many
    rows as there are fingerprints, and would send them all through the driver."""
    if most > 4:
        raise ValueError("the keys cover 4 differing bits")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            all_fps = pdf["fp"].to_numpy(np.int64)
            for a in range(0, len(all_fps), 20_000):
                part = all_fps[a : a + 20_000]
                r, k, base = keys(part)
                yield pd.DataFrame({"k": k.astype(np.int32), "base": base.astype(np.int32), "fp": part[r]})

    made = fps.select("fp").mapInPandas(run, "k int, base int, fp long")
    x, y = made.select("k", F.col("base").alias("bx"), F.col("fp").alias("u")), made.select("k", F.col("base").alias("by"), F.col("fp").alias("v"))
    met = x.hint("merge").join(y, (x.k == y.k) & (F.col("u") < F.col("v")) & ((F.col("bx") != F.col("by")) | (x.k == F.col("bx"))) & (F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= most))
    return met.select("u", "v").distinct()


def _joinable(df: DataFrame, rows: int) -> DataFrame:
    """df, of at most so many rows, as a side of a join: one of sorted shuffles beyond BROADCAST_ROWS. Spark goes by files, where
    a row takes a few bytes or bits, and would send several times its threshold through the driver."""
    return df.hint("merge") if rows > BROADCAST_ROWS else df


def classes(fps: DataFrame, most: int = 4) -> tuple[DataFrame, int]:
    """(fp, any columns) -> written (fp, root), where root is the smallest linked fingerprint, signed; and its rows."""
    nodes = written(fps.select("fp").distinct(), "fps")
    rows = nodes.count()
    found = _joinable(components(links(nodes, most)), rows)
    return written(nodes.join(found, nodes.fp == found.node, "left").select("fp", F.coalesce("root", "fp").alias("root")), "classes"), rows


def near_duplicates(docs: DataFrame, most: int = 4) -> DataFrame:
    """docs (doc_id, text) -> doc_id, fingerprint, component_id for every row.

    Exact copies and equal fingerprints are one node, so links are between different fingerprints only; none is lost.
    Null text and text without words have fingerprint zero, linked like any other. component_id is the smallest
    non-null doc_id in the component; null if it has none. Rows with equal doc_id stay rows. Other columns are ignored.
    An empty table gives an empty result.
    """
    fps = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), simhash(F.col("text")).alias("fp")), "simhash")
    own = fps.groupBy("fp").agg(F.min("doc_id").alias("first"))
    found, rows = classes(fps, most)
    of = found.join(_joinable(own, rows), "fp")
    least = of.groupBy("root").agg(F.min("first").alias("component_id"))
    named = written(of.join(_joinable(least, rows), "root").select("fp", "component_id"), "named")
    # each fp is in named; a left join never sends fps, which has a row a document, through the driver
    return fps.join(_joinable(named, rows), "fp", "left").select("doc_id", hex16(F.col("fp")).alias("fingerprint"), "component_id")


def one_of_each(docs: DataFrame, most: int = 4) -> DataFrame:
    """docs without all but one document of each component: the smallest doc_id stays (null counts as largest), of
    rows with equal doc_id the first in its file. All columns are kept."""
    file, row = fresh(docs, "at_file", "at_row")
    placed = located(docs, file, row)
    fps = written(placed.select(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id").alias("d"), F.col(file).alias("f"), F.col(row).alias("r")).alias("at"), simhash(F.col("text")).alias("fp")), "simhash")
    first = fps.groupBy("fp").agg(F.min("at").alias("at"))
    found, rows = classes(fps, most)
    kept = found.join(_joinable(first, rows), "fp").groupBy("root").agg(F.min("at").alias("at"))
    kept = written(kept.select(F.col("at.f").alias(file), F.col("at.r").alias(row)), "kept")
    return placed.join(_joinable(kept, kept.count()), [file, row], "left_semi").select(*docs.columns)


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
