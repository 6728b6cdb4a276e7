"""Connected components by alternating large-star and small-star steps (a distributed union-find)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

#: Links that a task takes at least: a few links aren't dealt over as many tasks as a large shuffle has.
TASK_LINKS = 100_000
#: Links of a round whose nodes may pass through the driver.
BROADCAST_LINKS = 100_000


def _least(pairs: DataFrame, many: bool) -> DataFrame:
    """(u, v) with m, the smallest of u and all its v. The minimum has a partial sum in each task, so a hub's links don't meet in one.
    many: by sorted shuffles, whatever Spark takes the nodes for, which goes by the links' files."""
    least = pairs.groupBy(F.col("u").alias("g")).agg(F.min("v").alias("m"))
    least = least.hint("merge") if many else least
    return pairs.join(least, pairs.u == least.g).select("u", "v", F.least("u", "m").alias("m"))


def _large(edges: DataFrame, many: bool) -> DataFrame:
    """Each node's larger neighbours, linked to the least of it and its neighbours: as many links as before at most."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _least(both, many).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")


def _small(edges: DataFrame, many: bool) -> DataFrame:
    """Each node and its smaller neighbours, linked to the least of these. u > v in all links."""
    near = _least(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")), many)
    links = near.select(F.col("v").alias("u"), F.col("m").alias("v")).union(near.select("u", F.col("m").alias("v")))
    return links.where("u <> v").distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether each u > v has one v, which has no smaller neighbour itself."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("up"), F.lit(0).alias("down")).union(edges.select("v", F.lit(0), F.lit(1)))
    per = ends.groupBy("n").agg(F.sum("up").alias("up"), F.max("down").alias("down"))
    return per.where("up > 1 OR up = 1 AND down = 1").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(u, v) links, either way round, of any ordered type -> (node, root): root is the smallest node that node reaches.

    Only nodes of links between different nodes are returned; null ends are dropped; repeated links count once.
    Each round is a table in the shared folder, so a lost executor doesn't replay the rounds.
    """

    now = written(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v").distinct(), "links")
    while True:
        rows = now.count()
        tasks, many = max(2, rows // TASK_LINKS), rows > BROADCAST_LINKS
        now = now.coalesce(tasks)
        if _stars(now):
            break
        now = written(_small(_large(now, many), many).coalesce(tasks), "links")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())
