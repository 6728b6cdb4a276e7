"""A virtual repository over the star-schema tables: commits, parents, refs, trees, objects, logs, manifests.

Each function gives a DataFrame; SQL has the same tables as common table expressions, for an independent engine."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def oid(kind: str, key: Column) -> Column:
    return F.sha2(F.concat(F.lit(kind + ":"), key.cast("string")), 256)


def commits(spark: SparkSession, d: str) -> DataFrame:
    """n numbers commits from 1; every seventh names a tree that no object has."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n = F.col("o_orderkey") + 1
    return o.join(c, F.col("o_custkey") == F.col("c_custkey")).select(
        n.alias("n"), oid("commit", n).alias("oid"), F.concat(F.lit("tree:"), (F.col("o_custkey") % 100).cast("string")).alias("tree"), F.col("c_name").alias("author"), F.concat("c_name", F.lit("@"), F.col("c_mktsegment")).alias("email"), F.col("o_orderdate").alias("ts"), F.concat("o_orderpriority", F.lit(" fix\nbody "), F.col("o_orderstatus")).alias("message")
    )


def commit_parents(spark: SparkSession, d: str) -> DataFrame:
    """A parent n/2; each fifth commit has a second one, n/3."""
    n = table(spark, d, "orders").select((F.col("o_orderkey") + 1).alias("n"))
    first = n.where("n > 1").select(F.col("n").alias("child"), F.expr("n div 2").alias("parent"), F.lit(0).alias("pos"))
    return first.unionByName(n.where("n % 5 = 0").select(F.col("n").alias("child"), F.expr("n div 3").alias("parent"), F.lit(1).alias("pos")))


def refs(spark: SparkSession, d: str) -> DataFrame:
    """A branch for each nation, at its newest commit; every tenth points past the last commit; a symbolic HEAD."""
    o, c, n = (table(spark, d, x) for x in ("orders", "customer", "nation"))
    heads = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).groupBy("n_nationkey", "n_name").agg(F.max(F.col("o_orderkey") + 1).alias("head"))
    kind = F.when(F.col("n_nationkey") % 3 == 0, "refs/tags/").when(F.col("n_nationkey") % 3 == 1, "refs/remotes/").otherwise("refs/heads/")
    broken = F.when(F.col("n_nationkey") % 10 == 9, F.col("head") + 100_000_000).otherwise(F.col("head"))
    return heads.select(F.concat(kind, "n_name").alias("name"), broken.alias("target"))


def _tree(part: DataFrame, skip: int, change: str, mode: str) -> DataFrame:
    path = F.expr("concat('dir', cast(p_partkey % 20 as string), '/', p_type, '/', cast(p_partkey as string), CASE p_partkey % 4 WHEN 0 THEN '.psd' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '' END)")
    return part.where(f"p_partkey % {skip} <> 0").select(path.alias("path"), F.expr(mode).alias("mode"), oid("blob", F.expr(f"p_partkey * 10 + {change}")).alias("oid"), F.expr("cast(p_size * 1000 as bigint)").alias("size"))


CHANGES = {
    "base": (11, "0", "'100644'"),
    "ours": (13, "(CASE WHEN p_partkey % 7 = 0 THEN 1 ELSE 0 END)", "CASE WHEN p_partkey % 29 = 0 THEN '100755' ELSE '100644' END"),
    "theirs": (17, "(CASE WHEN p_partkey % 5 = 0 THEN 1 WHEN p_partkey % 35 = 14 THEN 2 ELSE 0 END)", "'100644'"),
}


def tree(spark: SparkSession, d: str, which: str) -> DataFrame:
    """path, mode, oid, size of the files of the base, our or their tree."""
    return _tree(table(spark, d, "part"), *CHANGES[which])


def objects(spark: SparkSession, d: str) -> DataFrame:
    """Stored objects: key with its namespace, size, stored size. Order lines, some as deltas or chunks."""
    li = table(spark, d, "lineitem")
    space = F.expr("CASE WHEN l_returnflag = 'A' THEN 'chunks/' WHEN l_returnflag = 'R' THEN 'deltas/' ELSE 'objects/' END")
    return li.select(F.concat(space, F.col("l_orderkey").cast("string"), F.lit("_"), F.col("l_linenumber").cast("string")).alias("key"), F.col("l_partkey").alias("part"), F.col("l_orderkey").alias("order_no"), F.col("l_extendedprice").alias("size"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("stored"))


def lines(spark: SparkSession, d: str) -> DataFrame:
    """Manifests: documents cut at line ends, with the chunk's id."""
    cut = table(spark, d, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("seq", "line"))
    return cut.select("doc_id", F.col("seq").cast("long").alias("seq"), F.sha2("line", 256).alias("chunk_oid"), F.char_length("line").cast("long").alias("size"))


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events")


def _sql_tree(which: str) -> str:
    skip, change, mode = CHANGES[which]
    return f"""{which} AS (SELECT 'dir' || (p_partkey % 20) || '/' || p_type || '/' || p_partkey || CASE p_partkey % 4 WHEN 0 THEN '.psd' WHEN 1 THEN '.mp4' WHEN 2 THEN '.txt' ELSE '' END AS path,
      {mode} AS mode, sha256('blob:' || (p_partkey * 10 + {change})) AS oid, CAST(p_size * 1000 AS BIGINT) AS size FROM part WHERE p_partkey % {skip} <> 0)"""


SQL = {
    "commits": "commits AS (SELECT o_orderkey + 1 AS n, sha256('commit:' || (o_orderkey + 1)) AS oid, 'tree:' || (o_custkey % 100) AS tree, c_name AS author, c_name || '@' || c_mktsegment AS email, o_orderdate AS ts, o_orderpriority || ' fix' || chr(10) || 'body ' || o_orderstatus AS message FROM orders JOIN customer ON o_custkey = c_custkey)",
    "edges": "edges AS (SELECT o_orderkey + 1 AS child, (o_orderkey + 1) // 2 AS parent, 0 AS pos FROM orders WHERE o_orderkey > 0 UNION ALL SELECT o_orderkey + 1, (o_orderkey + 1) // 3, 1 FROM orders WHERE (o_orderkey + 1) % 5 = 0)",
    "refs": "refs AS (SELECT CASE n_nationkey % 3 WHEN 0 THEN 'refs/tags/' WHEN 1 THEN 'refs/remotes/' ELSE 'refs/heads/' END || n_name AS name, max(o_orderkey + 1) + CASE WHEN n_nationkey % 10 = 9 THEN 100000000 ELSE 0 END AS target FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_nationkey, n_name)",
    "base": _sql_tree("base"),
    "ours": _sql_tree("ours"),
    "theirs": _sql_tree("theirs"),
    "objects": "objects AS (SELECT CASE l_returnflag WHEN 'A' THEN 'chunks/' WHEN 'R' THEN 'deltas/' ELSE 'objects/' END || l_orderkey || '_' || l_linenumber AS key, l_partkey AS part, l_orderkey AS order_no, l_extendedprice AS size, l_extendedprice * (1 - l_discount) AS stored FROM lineitem)",
    "lines": "lines AS (SELECT doc_id, CAST(seq AS BIGINT) AS seq, sha256(line) AS chunk_oid, length(line) AS size FROM (SELECT doc_id, generate_subscripts(a, 1) - 1 AS seq, unnest(a) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS a FROM documents)))",
}


def with_tables(names: str, sql: str, recursive: str = "") -> str:
    """sql with the named tables before it."""
    parts = [SQL[n] for n in names.split()] + ([recursive] if recursive else [])
    return f"WITH RECURSIVE {', '.join(parts)} {sql}" if recursive else f"WITH {', '.join(parts)} {sql}"
