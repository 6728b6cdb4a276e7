"""Hierarchical weighted hash tree: region, rack and shard by weighted hash draws."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table, written


@dataclass(frozen=True)
class Leaf:
    shard: int
    rack: int
    region: int
    weight: float = 1.0


def even_tree(shards: int, per_rack: int = 4, racks: int = 2) -> list[Leaf]:
    """Shards of weight 1 in order: per_rack in each rack, so many racks in each region."""
    return [Leaf(s, s // per_rack, s // (per_rack * racks)) for s in range(shards)]


LEVELS = ("region", "rack", "shard")


def draw(key: Column, level: str, node: int, weight: float) -> Column:
    """A node's draw for a key: an exponential time with the weight as its rate, from the hash of key, level and node."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(LEVELS.index(level)), F.lit(node)), 11).cast("double") + 1) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(weight)


def children(tree: list[Leaf], level: str) -> dict[int, float]:
    """The nodes of a level in order, with the sums of their shards' weights, in the order of the shards."""
    out: dict[int, float] = {}
    for x in sorted(tree, key=lambda x: x.shard):
        out[getattr(x, level)] = out.get(getattr(x, level), 0.0) + x.weight
    return dict(sorted(out.items()))


def _chosen(key: Column, level: str, tree: list[Leaf]) -> Column:
    """The node of the level with the least draw; ties: the least node."""
    return F.array_min(F.array(*(F.struct(draw(key, level, node, w).alias("draw"), F.lit(node).alias("node")) for node, w in children(tree, level).items())))["node"]


def descend(rows: DataFrame, key: str, tree: list[Leaf], names: tuple[str, str, str]) -> DataFrame:
    """rows with three columns more: the region, rack and shard that the descent reaches for the key.

    Each level has draws of its own: first the regions draw with the sums of their shards' weights, then the racks of the
    chosen region with theirs, then the shards of the chosen rack. A row's draws are those of the nodes on its way and
    their siblings, not of all shards. A changed weight changes the draws of the nodes above that shard only: a row moves
    between regions only from or to that region, within that region only from or to that rack, within that rack only from
    or to that shard. A shard that is alone in a new region takes rows only into itself. Shards of weight 0 get none.
    """
    live = [x for x in tree if x.weight > 0]
    if not live:
        raise ValueError("no shard has a weight")
    for level, name, above in zip(LEVELS, names, (None, *names), strict=False):
        if above is None:
            rows = rows.withColumn(name, _chosen(F.col(key), level, live))
            continue
        up, at = LEVELS[LEVELS.index(level) - 1], F
        for node in sorted({getattr(x, up) for x in live}):  # only the branch of the chosen node is drawn
            at = at.when(F.col(above) == node, _chosen(F.col(key), level, [x for x in live if getattr(x, up) == node]))
        rows = rows.withColumn(name, at)
    return rows


def shard(docs: DataFrame, tree: list[Leaf], grown: Leaf | None = None, bucket_rows: int = 5_000) -> DataFrame:
    """docs (doc_id, text) -> doc_id, size, text_crc32, law, shard, slot, grown_shard, rack, region.

    size: UTF-8 bytes of the text plus 16; null text has none and checksum 0, as an empty one. Null doc_ids share one
    shard. Rows with equal doc_id share a shard and have slots of their own. grown_shard: the shard once grown is added;
    where that is alone in a new region, rows move to it and nowhere else. Racks are numbered through all regions.
    Slots: each shard's rows fall into buckets by hash; a bucket's first slot is the prefix sum of those before it, so
    no task sorts a whole shard. Other columns are ignored; an empty table gives an empty result.
    """
    key = F.col("doc_id").cast("long")
    rows = docs.select(key.alias("doc_id"), (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"), F.crc32(F.coalesce("text", F.lit("")).cast("binary")).alias("text_crc32"))
    rows = descend(rows, "doc_id", tree, ("region", "rack", "shard"))
    rows = descend(rows, "doc_id", [*tree, grown], ("grown_region", "grown_rack", "grown_shard")) if grown else rows.withColumn("grown_shard", F.lit(None).cast("int"))
    buckets = max(1, -(-docs.count() // (bucket_rows * len(tree))))
    placed = rows.select("doc_id", "size", "text_crc32", "shard", "rack", "region", "grown_shard", F.pmod(F.xxhash64("doc_id", "size", "text_crc32"), F.lit(buckets)).alias("bucket"))
    placed = written(placed, "placed")
    count = placed.groupBy("shard", "bucket").agg(F.count("*").alias("n"))
    base = count.select("shard", "bucket", F.coalesce(F.sum("n").over(W.partitionBy("shard").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    numbered = placed.withColumn("k", F.row_number().over(W.partitionBy("shard", "bucket").orderBy("doc_id", "size", "text_crc32")))
    return numbered.join(base, ["shard", "bucket"]).select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("base") + F.col("k") - 1).alias("slot"), "grown_shard", "rack", "region")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    tree = even_tree(41)
    return shard(table(spark, sf_dir, "documents"), tree[:40], grown=tree[40])
