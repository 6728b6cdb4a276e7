"""Aggregations, windows and integrity queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def leaderboard(commits: DataFrame, n: int = 10) -> DataFrame:
    """Authors by commits, ties by name and address."""
    return commits.groupBy("author", "email").agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts")).orderBy(F.desc("commits"), "author", "email").limit(n)


def storage_by_namespace(objects: DataFrame) -> DataFrame:
    space = F.when(F.col("key").startswith("chunks/"), "chunks").when(F.col("key").startswith("deltas/"), "deltas").when(F.col("key").startswith("packs/"), "packs").when(F.col("key").startswith("manifests/"), "manifests").otherwise("loose")
    return objects.groupBy(space.alias("namespace")).agg(F.count("*").alias("objects"), F.round(F.sum("size"), 2).alias("bytes"))


def compression(objects: DataFrame, *keys: str) -> DataFrame:
    """Both ratios by name: original to stored, stored to original; and the saving in per cent."""
    s, t = F.sum("size"), F.sum("stored")
    return objects.groupBy(*keys).agg(F.count("*").alias("ops"), F.round(s / t, 6).alias("original_to_stored"), F.round(t / s, 6).alias("stored_to_original"), F.round((1 - t / s) * 100, 4).alias("saved_percent"))


def dedup_ratio(manifest: DataFrame) -> DataFrame:
    """By count and by bytes: one minus the unique chunks' part of the references."""
    per = manifest.groupBy("chunk_oid").agg(F.count("*").alias("refs"), F.max("size").alias("size"))
    refs, size = F.sum("refs"), F.sum(F.col("refs") * F.col("size"))
    return per.agg(refs.alias("refs"), F.count("*").alias("chunks"), F.round(1 - F.count("*") / refs, 6).alias("by_count"), F.round(1 - F.sum("size") / size, 6).alias("by_bytes"))


def chunk_references(manifest: DataFrame) -> DataFrame:
    return manifest.groupBy("chunk_oid").agg(F.count("*").alias("refs"), F.countDistinct("doc_id").alias("blobs"))


def histogram(df: DataFrame, key: str, value: str, bounds: list[float]) -> DataFrame:
    """Cumulative buckets: rows of at most each bound. One pass, a conditional count a bound."""
    counts = df.groupBy(key).agg(*(F.count_if(F.col(value) <= b).alias(f"b{i}") for i, b in enumerate(bounds)))
    return counts.select(key, F.inline(F.array(*(F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("cumulative")) for i, b in enumerate(bounds)))))


def positions(log: DataFrame, ref: str, *order: Column | str) -> DataFrame:
    """log with pos, 0 for each ref's newest, and old, the value before."""
    up = W.partitionBy(ref).orderBy(*order)
    return log.withColumn("k", F.row_number().over(up)).withColumn("old", F.lag("value").over(up)).withColumn("pos", F.count("*").over(W.partitionBy(ref)) - F.col("k")).drop("k")


def offsets(manifest: DataFrame, gap: int = 0) -> DataFrame:
    """manifest (doc_id, seq, size) with each chunk's offset: the sum of those before it, with so much between them."""
    before = W.partitionBy("doc_id").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)
    return manifest.withColumn("offset", F.coalesce(F.sum(F.col("size") + gap).over(before), F.lit(0)))


def uncovered(pieces: DataFrame, key: str) -> DataFrame:
    """pieces (key, lo, hi) -> (key, lo, hi) of the ranges between the first and last piece that none covers."""
    before = W.partitionBy(key).orderBy("lo", "hi").rowsBetween(W.unboundedPreceding, -1)
    return pieces.withColumn("end", F.max("hi").over(before)).where("lo > end").select(key, F.col("end").alias("lo"), F.col("lo").alias("hi"))


def missing(wanted: DataFrame, there: DataFrame, key: str) -> DataFrame:
    """Rows of wanted whose key isn't there: broken refs, absent trees and chunks, unreachable objects, unmigrated keys."""
    return wanted.join(there.select(key).distinct(), key, "left_anti")


def verify(source: DataFrame, target: DataFrame) -> DataFrame:
    """(key, checksum, size) twice -> key, result: ok, missing, checksum or size."""
    t = target.select("key", F.col("checksum").alias("c2"), F.col("size").alias("s2"), F.lit(True).alias("there"))
    result = F.when(F.col("there").isNull(), "missing").when(~F.col("checksum").eqNullSafe(F.col("c2")), "checksum").when(~F.col("size").eqNullSafe(F.col("s2")), "size").otherwise("ok")
    return source.join(t, "key", "left").select("key", result.alias("result"))


def version_order(tag: Column) -> Column:
    """Sort key of dotted versions: the numbers of their parts."""
    return F.transform(F.split(F.regexp_replace(tag, "^v", ""), r"\."), lambda x: F.coalesce(x.try_cast("int"), F.lit(-1)))


def tree_hash(tree: DataFrame) -> DataFrame:
    """hash, files, executable of a tree (path, mode, oid): each directory's sorted entries are hashed in a row of its own,
    then the sorted directories, so no row holds all files."""
    at = tree.withColumn("dir", F.regexp_extract("path", "^(.*)/[^/]*$", 1))
    entries = F.transform(F.sort_array(F.collect_list(F.struct("path", "mode", "oid"))), lambda x: F.concat_ws(" ", x["mode"], x["path"], x["oid"]))
    dirs = at.groupBy("dir").agg(F.sha2(F.concat_ws("\n", entries), 256).alias("hash"), F.count("*").alias("files"), F.count_if(F.col("mode") == "100755").alias("executable"))
    listed = F.transform(F.sort_array(F.collect_list(F.struct("dir", "hash"))), lambda x: F.concat_ws(" ", x["dir"], x["hash"]))
    return dirs.agg(F.sha2(F.concat_ws("\n", listed), 256).alias("hash"), F.sum("files").alias("files"), F.sum("executable").alias("executable"))


def first_copies(new: DataFrame, stored: DataFrame, key: str = "oid") -> DataFrame:
    """What a write adds: rows whose key isn't stored, one a key."""
    return missing(new.dropDuplicates([key]), stored, key)


def located(wanted: DataFrame, places: dict[str, DataFrame], key: str = "oid") -> DataFrame:
    """wanted with `place`: the first of the places, in order, that has the key; null where none has."""
    out = wanted
    for name, there in places.items():
        out = out.join(there.select(key).distinct().withColumn(f"in_{name}", F.lit(name)), key, "left")
    return out.select(*wanted.columns, F.coalesce(*(f"in_{n}" for n in places)).alias("place"))


def pack_index(objects: DataFrame, shards: int = 256) -> DataFrame:
    """objects (oid, stored) -> oid, pack, offset, stored: packs by the id's hash, bytes in order of ids. Running sums are
    a pack's own, so packs, not one list, bound a task."""
    pack = F.pmod(F.xxhash64("oid"), F.lit(shards))
    before = W.partitionBy("pack").orderBy("oid").rowsBetween(W.unboundedPreceding, -1)
    return objects.select("oid", pack.alias("pack"), "stored").withColumn("offset", F.coalesce(F.sum("stored").over(before), F.lit(0)))


def prometheus(df: DataFrame, metric: str, labels: list[str], value: str) -> DataFrame:
    """line: one sample a row in the text exposition format."""
    esc = lambda c: F.regexp_replace(F.regexp_replace(F.col(c).cast("string"), r"(\\|\")", r"\\$1"), "\n", r"\\n")
    inner = F.concat_ws(",", *(F.concat(F.lit(f'{c}="'), F.coalesce(esc(c), F.lit("")), F.lit('"')) for c in labels))
    return df.select(F.concat(F.lit(metric + "{"), inner, F.lit("} "), F.col(value).cast("string")).alias("line"))
