"""Secret scans: base patterns, and candidates judged by how many owners and repositories of the corpus have them."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, written

#: Fixed patterns of the contract.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
HEX_LONG = re.compile(r"[0-9a-f]{24,}")  # the runs of HEX that have 24 or more
KINDS = ("assign", "access", "hex", "owned")
#: A run that may be a credential: what secrets are written in, of 16 characters or more, however long, with a digit and a letter.
RUN = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
LEAST_BITS = 3.0
#: Characters on each side of a candidate that tell a near copy of a document from another text with the same value.
AROUND = 40
#: A value in more repositories than these is widely copied: with several owners, and under one owner alone.
MANY, MANY_OF_ONE = 16, 100


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, number of kind, end) of the base patterns, by start, then kind."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    found += [(m.start(), 2, m.end()) for m in HEX_LONG.finditer(text)]
    return sorted(found)


def entropy(s: str) -> float:
    """Bits a character, by the frequencies in s."""
    n = np.unique(np.frombuffer(s.encode("utf-32-le"), "<u4"), return_counts=True)[1] / len(s)
    return float(-(n * np.log2(n)).sum())


def candidates(text: str) -> list[tuple[int, int, str]]:
    """(start, end, value) of runs that look like live credentials: letters and digits, of at least LEAST_BITS bits a character."""
    out = []
    for m in RUN.finditer(text):
        v = m[0].strip("=-_/+")
        if len(v) >= 16 and any(c.isdigit() for c in v) and any(c.isalpha() for c in v) and entropy(v) >= LEAST_BITS:
            at = m.start() + m[0].index(v)
            out.append((at, at + len(v), v))
    return out


def digest(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()[:32]


def listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


SCANNED = "doc_id long, owner string, repository string, base array<struct<a:int,k:int,b:int>>, found array<struct<a:int,b:int,h:string,around:long>>, copy string"


def scan(docs: DataFrame, owner: str, repository: str) -> DataFrame:
    """docs -> doc_id, owner, repository, base spans, candidates with the SHA-256 of their value and a checksum of what is
    around it, and the SHA-256 of a text with candidates. Null text is empty."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            texts = pdf.pop("text").tolist()
            pdf["doc_id"] = pdf["doc_id"].astype("Int64")
            pdf["base"] = [[{"a": a, "k": k, "b": b} for a, k, b in base_spans(t)] for t in texts]
            pdf["found"] = [[{"a": a, "b": b, "h": digest(v), "around": zlib.crc32((t[max(0, a - AROUND) : a] + "\0" + t[b : b + AROUND]).encode())} for a, b, v in candidates(t)] for t in texts]
            pdf["copy"] = [digest(t) if f else None for t, f in zip(texts, pdf["found"], strict=True)]
            yield pdf

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(owner).cast("string").alias("owner"), F.col(repository).cast("string").alias("repository"), F.coalesce("text", F.lit("")).alias("text")).mapInPandas(run, SCANNED)


def ownership(scanned: DataFrame) -> DataFrame:
    """(h, n_repositories, n_owners, apart) of each candidate value over the whole corpus. Copies of one text count once,
    for the least of their owners and its least repository. apart: not all texts have the same around the value. Rows are
    counted in partial sums, first by value and text, then by value, owner and repository, so a value that a third of all
    rows hold doesn't meet in one task. Null owners and repositories count as one of their own."""
    held = scanned.select("copy", F.explode("found").alias("x"), F.struct(F.coalesce("owner", F.lit("\0")).alias("owner"), F.coalesce("repository", F.lit("\0")).alias("repository")).alias("holder")).select("copy", "x.h", "x.around", "holder")
    texts = held.groupBy("h", "copy").agg(F.min("holder").alias("holder"), F.min("around").alias("lo")).select("h", "holder.*", "lo", F.col("lo").alias("hi"))
    ends = F.min("lo").alias("lo"), F.max("hi").alias("hi")
    per = texts.groupBy("h", "owner", "repository").agg(*ends).groupBy("h", "owner").agg(F.count("*").alias("n"), *ends)
    return per.groupBy("h").agg(F.sum("n").alias("n_repositories"), F.count("*").alias("n_owners"), (F.min("lo") != F.max("hi")).alias("apart"))


def secrets(docs: DataFrame, owner: str = "source", repository: str = "doc_id", most_owners: int = 1, many: int = MANY, many_of_one: int = MANY_OF_ONE) -> DataFrame:
    """docs -> doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_owned, n_example, n_new, candidates.

    Base spans stay. The method adds a span of kind `owned` for each candidate that isn't widely copied, unless a base
    span covers it already (n_owned counts all of them, n_new those added). Widely copied examples are values of more
    than most_owners owners whose texts differ around the value or that more than `many` repositories hold, and values
    of fewer owners in more than many_of_one repositories: n_example counts them, and they add nothing. Copies of one
    text count once; near copies of a document, alike around the value, don't make an example of it until they are many.
    candidates: start:end:n_repositories:n_owners of each candidate, by start.
    Rows with equal or null doc_id stay rows. Null text has no spans: base_sha256 is that of the empty string.
    """
    scanned = written(scan(docs, owner, repository).select(F.monotonically_increasing_id().alias("rid"), "*"), "scanned")
    known = written(ownership(scanned), "ownership")
    each = scanned.where("size(found) > 0").select("rid", "base", F.explode("found").alias("x")).select("rid", "x.*", F.exists("base", lambda s: (s["a"] <= F.col("x.a")) & (s["b"] >= F.col("x.b"))).alias("inside"))
    judged = each.join(known, "h")
    several = F.col("n_owners") > most_owners
    live = ~F.when(several, F.col("apart") | (F.col("n_repositories") > many)).otherwise(F.col("n_repositories") > many_of_one)
    new = live & ~F.col("inside")
    per = judged.groupBy(F.col("rid").alias("of")).agg(F.count_if(live).alias("n_owned"), F.count_if(~live).alias("n_example"), F.collect_list(F.when(new, F.struct("a", F.lit(3).alias("k"), "b"))).alias("more"), F.collect_list(F.struct("a", "b", "n_repositories", "n_owners")).alias("counts"))
    out = scanned.join(per, scanned.rid == per.of, "left")
    text = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["a"], s["b"])), ",")
    of_kind = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long")
    more = F.coalesce("more", F.expr("cast(array() as array<struct<a:int,k:int,b:int>>)"))
    return out.select(
        "doc_id",
        of_kind(0).alias("n_assign"),
        of_kind(1).alias("n_access"),
        of_kind(2).alias("n_hex"),
        F.sha2(text(F.col("base")), 256).alias("base_sha256"),
        text(F.array_sort(F.concat("base", more))).alias("spans"),
        F.coalesce("n_owned", F.lit(0)).alias("n_owned"),
        F.coalesce("n_example", F.lit(0)).alias("n_example"),
        F.size(more).cast("long").alias("n_new"),
        F.coalesce(F.array_join(F.transform(F.array_sort("counts"), lambda c: F.concat_ws(":", c["a"], c["b"], c["n_repositories"], c["n_owners"])), ","), F.lit("")).alias("candidates"),
    )


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets(table(spark, sf_dir, "documents"))
