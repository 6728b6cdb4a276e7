"""Queries over deltas as stored."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import deltas
from ..sources import repository as repo
from .registry import query


def _varint(n: str) -> str:
    byte = lambda i: f"CASE WHEN {n} >= {1 << 7 * i if i else 0} THEN printf('%02X', (({n} >> {7 * i}) & 127) + CASE WHEN {n} >= {1 << 7 * (i + 1)} THEN 128 ELSE 0 END) ELSE '' END"
    return "(" + " || ".join(map(byte, range(5))) + ")"


_NUMBERS = "CAST(p_partkey AS BIGINT) * p_partkey * p_size % 4294967296"


@query(f"SELECT id, n, {_varint('n')} AS digits FROM (SELECT p_partkey AS id, {_NUMBERS} AS n FROM part UNION ALL SELECT p_partkey, p_partkey % 300 FROM part)")
def varints(s, d):
    """Numbers written as varints, and read back from them."""
    p = repo.table(s, d, "part")
    n = p.selectExpr("p_partkey AS id", f"{_NUMBERS} AS n").unionByName(p.selectExpr("p_partkey AS id", "p_partkey % 300 AS n"))
    digits = n.select("id", deltas.varint(F.col("n")).alias("digits"))
    return digits.select("id", deltas.from_varint(F.col("digits")).alias("n"), "digits")


@query(f"""WITH x AS (SELECT doc_id AS id, CAST(strlen(coalesce(text, '')) AS BIGINT) AS n, coalesce(text, '') AS text, doc_id % 6 AS depth FROM documents)
  SELECT x.id, CAST(x.depth AS BIGINT) AS depth, sha256(x.text) AS oid, CASE WHEN x.depth > 0 THEN '5A44' || {_varint('b.n')} || {_varint('x.n')} END AS head FROM x LEFT JOIN x b ON b.id = x.id - 1""")
def delta_chain_reads(s, d):
    """Documents stored in chains of up to five deltas, each to the document before it, and read back through them."""
    docs = repo.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.coalesce("text", F.lit("")).cast("binary").alias("x"))
    before = docs.select((F.col("id") + 1).alias("id"), F.col("x").alias("b"))
    stored = docs.where("id % 6 = 0").select("id", F.lit(None).cast("long").alias("base"), F.col("x").alias("data")).unionByName(docs.where("id % 6 <> 0").join(before, "id").select("id", (F.col("id") - 1).alias("base"), deltas.container(F.col("x"), F.col("b")).alias("data")))
    head = F.concat(F.lit(deltas.MAGIC), deltas.varint(F.col("p.base_size")), deltas.varint(F.col("p.result_size")))
    heads = stored.where("base is not null").select("id", deltas.parsed(F.col("data")).alias("p")).select("id", head.alias("head"))
    return deltas.read_chains(stored, docs.select("id")).join(heads, "id", "left").select("id", "depth", F.sha2("data", 256).alias("oid"), "head")
