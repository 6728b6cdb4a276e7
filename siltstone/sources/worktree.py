"""Files of a folder as a tree: scans over any file system that Spark reads, staging against an index. Spark's sources leave
out empty files, so these aren't in a scan."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import compare


def _files(spark: SparkSession, root: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)


def _named(df: DataFrame, root: str, rules: list[str], hidden: str) -> DataFrame:
    """df with path made relative to root; without ignored files and those of the repository's own folder."""
    name = root.rstrip("/").rsplit("/", 1)[-1]
    path = F.regexp_replace("path", "^.*?/" + scalar.re_escape(name) + "/", "")
    out = df.withColumn("path", path).where(~(F.col("path").startswith(hidden + "/")))
    return out.where(~scalar.ignored(F.col("path"), rules)) if rules else out


def stat(spark: SparkSession, root: str, rules: list[str] = (), hidden: str = ".repo") -> DataFrame:
    """path, size, modified of the files under root. Contents aren't read."""
    return _named(_files(spark, root).select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified")), root, list(rules), hidden)


def scan(spark: SparkSession, root: str, rules: list[str] = (), hidden: str = ".repo") -> DataFrame:
    """path, mode, oid, size, modified: the tree under root, each file hashed in the task that reads it."""
    df = _files(spark, root).select("path", F.lit("100644").alias("mode"), F.sha2("content", 256).alias("oid"), F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    return _named(df, root, list(rules), hidden)


def changed(now: DataFrame, cache: DataFrame) -> DataFrame:
    """Files of a stat() to hash again: those without an equal record (path, size, modified) of the last look."""
    return now.join(cache.select("path", "size", "modified"), ["path", "size", "modified"], "left_anti")


def staged(head: DataFrame, work: DataFrame) -> DataFrame:
    """path, oid, change (added, modified, deleted): what staging all of the worktree puts into the index."""
    diff = compare.tree_diff(head, work)
    return diff.where("change <> 'unchanged'").select("path", F.col("b_oid").alias("oid"), "change")
