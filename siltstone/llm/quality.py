"""Quality: log-likelihood ratio of hashed n-grams between trusted-target and raw-corpus multinomials."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .tokens import slices

BUCKETS = 1 << 16
#: At most so many trusted documents, those with the smallest hashes of their ids: a fixed bound of what is broadcast.
MOST_TRUSTED = 50_000
SMOOTHING = 1.0
#: Mean log-likelihood ratio for each n-gram, in nats, from which a document is kept.
THRESHOLD = -0.3
SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"


class _Numbers(dict):
    def __missing__(self, key: bytes) -> int:
        self[key] = n = len(self)
        return n


def _words(texts: list[str]) -> tuple[list[bytes], list[list[bytes]], np.ndarray, np.ndarray, _Numbers]:
    """UTF-8 texts, their words, the words' numbers in this run, the number of words of each text, the numbering."""
    data = [t.encode() for t in texts]
    split = [b.split() for b in data]
    count = np.fromiter(map(len, split), np.int64, len(split))
    numbers = _Numbers()
    ids = np.fromiter((numbers[w] for ws in split for w in ws), np.int64, int(count.sum()))
    return data, split, ids, count, numbers


def _grams(ids: np.ndarray, count: np.ndarray, numbers: _Numbers) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the words, buckets of the word pairs, and which pairs lie within one text."""
    crc = np.fromiter(map(zlib.crc32, numbers), np.uint64, len(numbers))[ids] if len(ids) else np.zeros(0, np.uint64)
    mix = lambda h: ((h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - 16)).astype(np.int64)
    inside = np.ones(max(0, len(ids) - 1), bool)
    ends = np.cumsum(count)[:-1]
    inside[ends[(ends > 0) & (ends < len(ids))] - 1] = False
    return mix(crc), mix(crc[:-1] * np.uint64(0xBF58476D1CE4E5B9) + crc[1:] + np.uint64(1)), inside


def counts(texts: list[str], trusted: np.ndarray) -> np.ndarray:
    """(2, BUCKETS): n-grams of all the texts, and of the trusted ones."""
    _, _, ids, n, numbers = _words(texts)
    one, two, inside = _grams(ids, n, numbers)
    of = np.repeat(trusted, n)
    grams, of = np.concatenate([one, two[inside]]), np.concatenate([of, of[:-1][inside]])
    return np.stack([np.bincount(grams, minlength=BUCKETS), np.bincount(grams[of], minlength=BUCKETS)])


def scores(ids: np.ndarray, n: np.ndarray, numbers: _Numbers, ratio: np.ndarray) -> np.ndarray:
    """Mean log-likelihood ratio over each text's words and word pairs; 0 without words."""
    out, some = np.zeros(len(n)), np.nonzero(n)[0]
    if not len(some):
        return out
    one, two, inside = _grams(ids, n, numbers)
    # each text is summed on its own: its score doesn't depend on what else is in the run
    values = np.stack([ratio[one], np.append(np.where(inside, ratio[two], 0.0), 0.0)])
    out[some] = np.add.reduceat(values, (np.cumsum(n) - n)[some], axis=1).sum(0)
    return out / np.maximum(1, 2 * n - 1)


def repeated(ids: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Words of each text in 3-word windows that its words have twice or more."""
    out = np.zeros(len(n), np.int64)
    if len(ids) < 4:
        return out
    doc = np.repeat(np.arange(len(n)), n)
    start = np.nonzero(doc[2:] == doc[:-2])[0]
    pairs = np.unique(ids[start] << 32 | ids[start + 1], return_inverse=True)[1]
    key = pairs << 32 | ids[start + 2]  # numbers of words and of pairs are below 2^31
    order = np.lexsort((key, doc[start]))
    k, d = key[order], doc[start][order]
    same = (k[1:] == k[:-1]) & (d[1:] == d[:-1])
    twice = np.zeros(len(k), bool)
    twice[1:] |= same
    twice[:-1] |= same
    at = start[order[twice]]
    hit = np.zeros(len(ids), bool)
    for j in range(3):
        hit[at + j] = True
    return np.bincount(doc[hit], minlength=len(n)).astype(np.int64)


def learn(docs: DataFrame, trusted: DataFrame, most: int = MOST_TRUSTED, smoothing: float = SMOOTHING) -> np.ndarray:
    """The log ratio of each bucket from all docs (doc_id, text) and the documents with a doc_id in trusted, most of
    them at most. Counts of all documents are summed by bucket in partial sums; the result has BUCKETS numbers, whatever the input."""
    ids = trusted.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("tid")).distinct().orderBy(F.xxhash64("tid"), "tid").limit(most)
    flagged = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(F.broadcast(ids), F.col("doc_id") == F.col("tid"), "left").select("text", F.col("tid").isNotNull().alias("good"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros((2, BUCKETS), np.int64)
        for pdf in batches:
            texts, good = pdf["text"].tolist(), pdf["good"].to_numpy(bool)
            for run in slices(texts):
                total += counts([texts[i] for i in run], good[run])
        some = np.nonzero(total[0])[0]
        yield pd.DataFrame({"bucket": some, "raw": total[0][some], "good": total[1][some]})

    summed = flagged.mapInPandas(count, "bucket long, raw long, good long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("good").alias("good"))
    got = np.array([tuple(r) for r in summed.collect()], np.int64).reshape(-1, 3)  # BUCKETS rows at most
    total = np.zeros((2, BUCKETS))
    total[:, got[:, 0]] = got[:, 1:].T
    raw, good = total
    if not good.sum():
        return np.zeros(BUCKETS)
    return np.log((good + smoothing) / (good.sum() + smoothing * BUCKETS)) - np.log((raw + smoothing) / (raw.sum() + smoothing * BUCKETS))


SCORED = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, score double, kept boolean"


def assess(docs: DataFrame, ratio: np.ndarray, threshold: float = THRESHOLD) -> DataFrame:
    """docs (doc_id, text) -> a row for each: base statistics, score, kept.

    kept: not base_failed and a score of at least the threshold, the same for every document. Null text has no words
    and fails the base rules. Rows with equal or null doc_id stay rows. Other columns are ignored."""
    shared = docs.sparkSession.sparkContext.broadcast(ratio)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        weights = shared.value
        for pdf in batches:
            texts = pdf["text"].tolist()
            for part in slices(texts):
                own = [texts[i] for i in part]
                data, _, ids, n, numbers = _words(own)
                twice = repeated(ids, n)
                score = scores(ids, n, numbers, weights)
                lines = [[x for x in b.split(b"\n") if x.strip()] for b in data]
                failed = (n < 50) | (100 * twice > 50 * n)
                yield pd.DataFrame(
                    {
                        "doc_id": pdf["doc_id"].iloc[part].astype("Int64").array,
                        "n_words": n,
                        "word_chars": [len(t) - sum(b.count(c) for c in SPACES) for t, b in zip(own, data, strict=True)],
                        "n_symbols": [sum(b.count(c) for c in SYMBOLS) for b in data],
                        "n_dup_lines": [len(x) - len(set(x)) for x in lines],
                        "n_repeat_words": twice,
                        "base_failed": failed,
                        "score": score,
                        "kept": ~failed & (score >= threshold),
                    }
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCORED)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    return assess(docs, learn(docs, labels.where("quality = 1 AND toxic = 0")))
