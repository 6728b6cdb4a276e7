"""Language identification: a linear-chain conditional random field labels words, its marginals name the document's language."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table
from .tokens import forget, slices, trim

WORD = re.compile(r"[^\W\d_]+")
FEATURES = 1 << 16
#: Training takes at most so many documents a label, those with the smallest hashes of their ids and at most so many
#: characters, and MOST_DOCS * MOST_LABELS in all, by label. Every document is labelled, whatever its length.
MOST_DOCS, MOST_CHARS, MOST_LABELS = 150, 20_000, 200
SEQUENCE, EPOCHS, SEED = 64, 4, 7
CHUNK = 128
_CACHE_WORDS = 250_000
#: Characters that a worker labels at a time.
_TOGETHER = 400_000
_LONG = 100_000


def word_features(word: str) -> Iterator[int]:
    """Hashed affixes to three letters, all n-grams of two and three, and the word itself, for the lexicon."""
    marked = f"^{word}$"
    names = [f"l{word}"]
    names += [f"p{word[:k]}" for k in (1, 2, 3)] + [f"s{word[-k:]}" for k in (1, 2, 3)]
    grams = (f"n{marked[i : i + k]}" for k in (2, 3) for i in range(max(0, len(marked) - k + 1)))
    return (zlib.crc32(x.encode()) % FEATURES for x in chain(names, grams))


def words(text: str) -> list[str]:
    """Runs of letters, in lower case. Long ones count whole."""
    return WORD.findall(text.lower())


def marginals(emit: np.ndarray, counts: np.ndarray, step: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Forward-backward over sequences laid end to end.

    emit: (words, labels), positive; step: (labels, labels) transition factors; counts: words of each sequence, all
    over 0. Exact for any length: each sequence is cut into chunks whose matrix products give the messages at the
    cuts, and then all chunks run side by side. So the number of Python steps follows the chunk, not the text.
    """
    labels = emit.shape[1]
    per = -(-counts // chunk)
    first = np.cumsum(per) - per
    n = int(per.sum())
    ends = np.cumsum(counts)
    seq = np.repeat(np.arange(len(counts)), per)
    lo = (ends - counts)[seq] + (np.arange(n) - first[seq]) * chunk
    size = np.minimum(chunk, ends[seq] - lo)
    at = np.minimum(lo[:, None] + np.arange(chunk), len(emit) - 1)
    there = np.arange(chunk) < size[:, None]
    e = np.where(there[:, :, None], emit[at], 0.0)
    product = np.repeat(np.eye(labels)[None], n, 0)
    for t in range(chunk):
        new = (product @ step) * e[:, t, None, :]
        new /= np.maximum(new.sum((1, 2), keepdims=True), 1e-300)
        product = np.where(there[:, t, None, None], new, product)
    into, out = np.full((n, labels), 1.0 / labels), np.ones((n, labels))
    for j in range(1, int(per.max())):
        c = first[per > j] + j
        v = np.einsum("nl,nlm->nm", into[c - 1], product[c - 1])
        into[c] = v / v.sum(1, keepdims=True)
    for j in range(int(per.max()) - 2, -1, -1):
        c = (first + j)[per > j + 1]
        v = np.einsum("nlm,nm->nl", product[c + 1], out[c + 1])
        out[c] = v / v.sum(1, keepdims=True)
    ahead, back = np.empty((chunk, n, labels)), np.empty((chunk, n, labels))
    a = into
    for t in range(chunk):
        new = (a @ step) * e[:, t]
        new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
        a = np.where(there[:, t, None], new, a)
        ahead[t] = a
    b = out
    for t in range(chunk - 1, -1, -1):
        back[t] = b
        new = (e[:, t] * b) @ step.T
        new /= np.maximum(new.sum(1, keepdims=True), 1e-300)
        b = np.where(there[:, t, None], new, b)
    both = (ahead * back).transpose(1, 0, 2)[there]
    return both / both.sum(1, keepdims=True)


class _Hashes(dict):
    """Features of affixes or n-grams by their text; the same as in word_features."""

    def __init__(self, kind: str):
        self.kind = kind

    def __missing__(self, x: str) -> int:
        if len(self) > _CACHE_WORDS:
            self.clear()
        self[x] = n = zlib.crc32((self.kind + x).encode()) % FEATURES
        return n


_PREFIX, _SUFFIX, _GRAM = map(_Hashes, "psn")


def _forget_hashes() -> None:
    for kind in (_PREFIX, _SUFFIX, _GRAM):
        kind.clear()


def _text(code: int, k: int) -> str:
    """Of k code points of 21 bits each."""
    return "".join(chr(code >> 21 * j & (1 << 21) - 1) for j in range(k - 1, -1, -1))


@dataclass
class Model:
    labels: list[str]
    weights: np.ndarray  # (FEATURES, labels)
    transitions: np.ndarray  # (labels, labels), logarithms

    def _sums(self, words: list[str]) -> np.ndarray:
        """The summed weights of each word's features, with each distinct n-gram hashed once."""
        at = lambda ids: self.weights[np.fromiter(ids, np.int64, len(words))]
        out = at(zlib.crc32(f"l{w}".encode()) % FEATURES for w in words)
        for k in (1, 2, 3):
            out += at(_PREFIX[w[:k]] for w in words)
            out += at(_SUFFIX[w[-k:]] for w in words)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        c = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le"), "<u4").astype(np.int64)
        left = np.repeat(np.cumsum(size), size) - np.arange(len(c))  # characters from here to the word's end
        code = c
        for k in (2, 3):
            code = code[:-1] << 21 | c[k - 1 :]
            grams, inverse = np.unique(code[left[: len(code)] >= k], return_inverse=True)
            weights = self.weights[np.fromiter((_GRAM[_text(x, k)] for x in grams.tolist()), np.int64, len(grams))]
            n = size - k + 1
            out += np.add.reduceat(weights[inverse], np.cumsum(n) - n, axis=0)
        return out

    def emissions(self, vocabulary: list[str]) -> np.ndarray:
        """Positive factors of each word, 1 for its best label."""
        score = np.empty((len(vocabulary), len(self.labels)))
        short = [k for k, w in enumerate(vocabulary) if len(w) <= _LONG]
        for part in slices([vocabulary[k] for k in short], max(_LONG, 2_000_000 // len(self.labels))):
            own = [short[i] for i in part]
            score[own] = self._sums([vocabulary[k] for k in own])
        for k, w in enumerate(vocabulary):
            if len(w) > _LONG:  # the same sum, without a row for each feature
                score[k] = np.bincount(np.fromiter(word_features(w), np.int64), minlength=FEATURES) @ self.weights
        return np.exp(np.maximum(score - score.max(1, keepdims=True), -30.0))


def fit(sample: list[tuple[str, str]], epochs: int = EPOCHS) -> Model | None:
    """The field from (text, label) pairs, in a fixed order; None without words or labels.

    Words have their document's label. Sequences of SEQUENCE words are put together from stretches of 4 to 24 words of
    random documents, so that the field learns when text changes its language. Adagrad on the log-likelihood.
    """
    docs = [(words(t), y) for t, y in sample]
    docs = [(w, y) for w, y in docs if w]
    labels = sorted({y for _, y in docs})
    if not labels:
        return None
    rng, number = np.random.default_rng(SEED), {y: k for k, y in enumerate(labels)}
    vocabulary = {w: k for k, w in enumerate(dict.fromkeys(w for ws, _ in docs for w in ws))}
    model = Model(labels, np.zeros((FEATURES, len(labels))), np.zeros((len(labels), len(labels))))
    if len(labels) == 1:
        return model
    by = [[np.array([vocabulary[w] for w in ws]) for ws, y in docs if number[y] == k] for k in range(len(labels))]
    stretches: list[np.ndarray] = []
    truth: list[np.ndarray] = []
    total, need = 0, min(120_000, 40 * sum(len(ws) for ws, _ in docs))
    while total < need:
        k = int(rng.integers(len(labels)))
        ws = by[k][int(rng.integers(len(by[k])))]
        n = int(rng.integers(4, 25))
        a = int(rng.integers(max(1, len(ws) - n + 1)))
        stretches.append(ws[a : a + n])
        truth.append(np.full(len(stretches[-1]), k))
        total += len(stretches[-1])
    rows = max(1, total // SEQUENCE)
    size = min(SEQUENCE, total)
    x, y = np.concatenate(stretches)[: rows * size].reshape(rows, size), np.concatenate(truth)[: rows * size].reshape(rows, size)
    feats = [list(word_features(w)) for w in vocabulary]
    n_feats = np.fromiter(map(len, feats), np.int64, len(feats))
    flat, start = np.fromiter((i for f in feats for i in f), np.int64, int(n_feats.sum())), np.cumsum(n_feats) - n_feats
    seen_w, seen_t = np.full_like(model.weights, 1e-6), np.full_like(model.transitions, 1e-6)
    for _ in range(epochs):
        for part in np.array_split(rng.permutation(rows), max(1, rows // 64)):
            xs, ys = x[part], y[part]
            types, inv = np.unique(xs, return_inverse=True)
            n = n_feats[types]
            at = flat[np.repeat(start[types] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))]
            owner = np.repeat(np.arange(len(types)), n)
            score = np.add.reduceat(model.weights[at], np.cumsum(n) - n, axis=0)
            emit = np.exp(np.maximum(score - score.max(1, keepdims=True), -30.0))[inv.ravel()]
            step = np.exp(model.transitions)
            m = marginals(emit, np.full(len(part), size), step, size)
            e = emit.reshape(len(part), size, -1)
            g = -m
            g[np.arange(len(g)), ys.ravel()] += 1
            per = np.zeros((len(types), len(labels)))
            np.add.at(per, inv.ravel(), g)
            gw = np.zeros_like(model.weights)
            np.add.at(gw, at, per[owner])
            # pair marginals: forward messages and backward messages of neighbours, from the same recursions
            gt = np.zeros_like(model.transitions)
            a = np.full((len(part), len(labels)), 1.0 / len(labels))
            ahead = []
            for t in range(size):
                ahead.append(a)
                a = (a @ step) * e[:, t]
                a /= a.sum(1, keepdims=True)
            b = np.ones((len(part), len(labels)))
            for t in range(size - 1, -1, -1):
                right = e[:, t] * b
                if t:
                    pair = ahead[t][:, :, None] * step * right[:, None, :]
                    gt -= (pair / pair.sum((1, 2), keepdims=True)).sum(0)
                    np.add.at(gt, (ys[:, t - 1], ys[:, t]), 1.0)
                b = right @ step.T
                b /= b.sum(1, keepdims=True)
            gw -= 1e-3 * model.weights
            seen_w += gw**2
            seen_t += gt**2
            model.weights += 0.3 * gw / np.sqrt(seen_w)
            model.transitions += 0.3 * gt / np.sqrt(seen_t)
    return model


class Labeller:
    """The model in a worker, with the emissions of words seen so far; emptied at 250,000 words, which changes no result."""

    def __init__(self, model: Model):
        self.model, self.step = model, np.exp(model.transitions)
        self._clear()

    def _clear(self) -> None:
        self.index: dict[str, int] = {}
        self.emit = np.zeros((0, len(self.model.labels)))

    def label(self, texts: list[str]) -> list[tuple[str, float, np.ndarray]]:
        """Of each text: language, mean marginal of it over the words, label number of each word; `und` and 0 without a letter."""
        if len(self.index) > _CACHE_WORDS:
            self._clear()
        split = [w if any(c.isalpha() for x in w for c in x) else [] for w in map(words, texts)]
        out: list[tuple[str, float, np.ndarray]] = [("und", 0.0, np.zeros(0, np.int64))] * len(texts)
        some = [k for k, w in enumerate(split) if w]
        if not some:
            return out
        new = list({w for k in some for w in split[k]} - self.index.keys())
        if new:
            self.index.update(zip(new, range(len(self.emit), len(self.emit) + len(new)), strict=True))
            self.emit = np.concatenate([self.emit, self.model.emissions(new)])
        counts = np.array([len(split[k]) for k in some])
        index = self.index
        m = marginals(self.emit[np.fromiter((index[w] for k in some for w in split[k]), np.int64, int(counts.sum()))], counts, self.step)
        starts = np.cumsum(counts) - counts
        mean = np.add.reduceat(m, starts, axis=0) / counts[:, None]
        best = m.argmax(1)
        for k, row, a, n in zip(some, mean, starts.tolist(), counts.tolist(), strict=True):
            top = int(row.argmax())
            out[k] = (self.model.labels[top], min(1.0, float(row[top])), best[a : a + n])
        return out


def learn(docs: DataFrame, most: int = MOST_DOCS, most_labels: int = MOST_LABELS) -> Model | None:
    """The field from documents with a label whose crc32(doc_id) mod 4 isn't 2: at most `most` a label, the smallest
    hashes of ids first (ties: the text), of at most MOST_CHARS characters, and most * most_labels in all, by label.

    Two readings: one ranks ids within the labels, with a limit in each task before anything is shuffled, one fetches
    the texts of the ids that are left, most * most_labels at most."""
    usable = docs.select(F.col("doc_id").cast("string").alias("doc_id"), "text", F.col("lang").alias("lang")).where(f"lang is not null and text is not null and doc_id is not null and length(text) <= {MOST_CHARS}")
    usable = usable.where(F.pmod(F.crc32(F.col("doc_id").cast("binary")), F.lit(4)) != 2)
    of = W.partitionBy("lang").orderBy("hash", "doc_id")
    ids = usable.select("lang", "doc_id", F.xxhash64("doc_id").alias("hash")).withColumn("k", F.row_number().over(of)).where(F.col("k") <= most)
    found: dict[str, list[str]] = {}
    for r in ids.select("lang", "doc_id", "k").sort("lang", "k").limit(most * most_labels).collect():
        found.setdefault(r.lang, []).append(r.doc_id)
    if not found:
        return None
    pairs = [(y, d) for y, own in found.items() for d in dict.fromkeys(own)]
    wanted = docs.sparkSession.createDataFrame(pa.table({"lang": [x[0] for x in pairs], "doc_id": [x[1] for x in pairs]}))
    texts: dict[str, list[tuple[str, str]]] = {}
    for r in usable.join(F.broadcast(wanted), ["lang", "doc_id"]).select("lang", "doc_id", "text").dropDuplicates().collect():
        texts.setdefault(r.lang, []).append((r.doc_id, r.text))
    place = {y: {d: k for k, d in reversed(list(enumerate(own)))} for y, own in found.items()}
    return fit([(t, y) for y in sorted(texts) for d, t in sorted(texts[y], key=lambda x: (place[y][x[0]], x[1]))[:most]])


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs (doc_id, text) -> doc_id, held_out, lang_pred, score, n_words, n_other: a row for each.

    lang_pred is `und`, with score 0, where text is null or has no letter, or no label was learned. n_other: words that
    the field gives another language, as in code-switched text. held_out is null for null doc_ids' remainder: false.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        forget()
        own = Labeller(shared.value) if shared.value else None
        for pdf in batches:
            texts = pdf.pop("text").tolist()
            got: list[tuple[str, float, np.ndarray]] = []
            for a in slices(texts, _TOGETHER):
                got += own.label([texts[i] for i in a]) if own else [("und", 0.0, np.zeros(0, np.int64))] * len(a)
            pdf["lang_pred"], pdf["score"] = [g[0] for g in got], [g[1] for g in got]
            pdf["n_words"] = [len(g[2]) for g in got]
            pdf["n_other"] = [int((g[2] != own.model.labels.index(g[0])).sum()) if len(g[2]) else 0 for g in got]
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            yield pdf
        del own
        _forget_hashes()
        trim()

    held = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, "doc_id long, held_out boolean, lang_pred string, score double, n_words long, n_other long")


def language(docs: DataFrame, model: Model | None) -> Column:
    """A struct column for docs (text): lang_pred and score."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double")
    def f(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        forget()
        own = Labeller(shared.value) if shared.value else None
        for s in batches:
            texts = s.tolist()
            got = [g for a in slices(texts, _TOGETHER) for g in (own.label([texts[i] for i in a]) if own else [("und", 0.0, None)] * len(a))]
            yield pd.DataFrame({"lang_pred": [g[0] for g in got], "score": [g[1] for g in got]})
        del own
        _forget_hashes()
        trim()

    return f(F.coalesce("text", F.lit("")))


def identified(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs without those that have no letter or no language with a mean marginal of at least `least`; all columns are kept. If no label can be learned, documents with a letter stay."""
    model = learn(docs)
    if model is None:
        return docs.where(F.coalesce("text", F.lit("")).rlike(r"\p{L}"))
    got = language(docs, model)
    return docs.where((got["lang_pred"] != "und") & (got["score"] >= least)).select(*docs.columns)


def op3_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return predict(docs, learn(docs))
