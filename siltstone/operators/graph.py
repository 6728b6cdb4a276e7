"""Recursive operators over edges (child, parent, pos): several levels of a frontier are joined at a time, pointers of first
parents are doubled. Each round is a written table in the shared folder."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Levels of the first round, and at most; a round takes twice as many as the one before it.
LEVELS, MOST_LEVELS = 6, 24


def _shared(spark: SparkSession) -> str:
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not path:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        path = tempfile.mkdtemp(prefix="siltstone-")
        spark.sparkContext.setCheckpointDir(path)
    return path


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{_shared(spark).rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder; its lineage is cut."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def closure(edges: DataFrame, starts: DataFrame, most: int | None = None) -> DataFrame:
    """(start, node, depth): all that each start reaches, itself at depth 0, at the least depth. starts has a column start,
    the node itself or, with a column node beside it, a name for a set of nodes.

    The edges are written once. A round joins the frontier to them some levels deep, drops what its start has seen and
    writes what is left, so rounds, not levels, cost jobs."""
    edges = written(edges.select("child", "parent").where("child is not null and parent is not null").distinct(), "edges")
    node = "node" if "node" in starts.columns else "start"
    seen = starts.select("start", F.col(node).alias("node")).where("start is not null and node is not null").distinct().withColumn("depth", F.lit(0))
    front = seen = written(seen, "reached")
    level, levels = 0, LEVELS
    while most is None or level < most:
        step, new = front, None
        for _ in range(levels if most is None else min(levels, most - level)):
            level += 1
            step = step.join(edges, F.col("node") == F.col("child")).select("start", F.col("parent").alias("node")).distinct().withColumn("depth", F.lit(level))
            new = step if new is None else new.unionByName(step)
        new = new.groupBy("start", "node").agg(F.min("depth").alias("depth"))
        found = written(new.join(seen.select("start", "node"), ["start", "node"], "left_anti"), "reached")
        seen = seen.unionByName(found)
        front = found.where(F.col("depth") == level)
        if front.isEmpty():
            break
        levels = min(MOST_LEVELS, 2 * levels)
    return seen


def one(edges: DataFrame, node) -> DataFrame:
    return edges.sparkSession.range(1).select(F.lit(node).cast("long").alias("start"))


def is_ancestor(edges: DataFrame, old, new) -> bool:
    """Whether new reaches old; a commit reaches itself."""
    return not closure(edges, one(edges, new)).where(F.col("node") == old).isEmpty()


def merge_bases(edges: DataFrame, a, b) -> DataFrame:
    """(node, depth_a, depth_b, criss_cross): common ancestors that no other common ancestor reaches, in the order of depths
    and node. Empty if unrelated; criss_cross tells that there is more than one. Both sides are followed at once."""
    both = closure(edges, one(edges, a).withColumn("node", F.col("start")).withColumn("start", F.lit(0)).unionByName(one(edges, b).withColumn("node", F.col("start")).withColumn("start", F.lit(1))))
    at = lambda k, name: F.min(F.when(F.col("start") == k, F.col("depth"))).alias(name)
    common = written(both.groupBy("node").agg(at(0, "depth_a"), at(1, "depth_b")).where("depth_a is not null and depth_b is not null"), "common")
    # an ancestor of a common ancestor is common itself, and has a child among them
    inner = common.select(F.col("node").alias("child")).join(edges, "child").select(F.col("parent").alias("node"))
    best = written(common.join(inner, "node", "left_anti"), "bases")
    return best.withColumn("criss_cross", F.lit(best.limit(2).count() > 1)).orderBy(F.col("depth_a") + F.col("depth_b"), "node")


def first_parents(edges: DataFrame, start, steps: int | None = None) -> DataFrame:
    """(node, depth) along first parents. Pointers are doubled: after k rounds the walk has 2^k commits, so a history of a
    million commits takes twenty rounds."""
    jump = written(edges.where("pos = 0").select(F.col("child").alias("at"), F.col("parent").alias("to")), "jump")
    path, far = one(edges, start).select(F.col("start").alias("node"), F.lit(0).cast("long").alias("depth")), 1
    while True:
        further = path.join(jump, F.col("node") == F.col("at")).select(F.col("to").alias("node"), (F.col("depth") + far).alias("depth"))
        further = written(further if steps is None else further.where(F.col("depth") <= steps), "walk")
        if further.isEmpty():
            return path
        path, far = path.unionByName(further), 2 * far
        step = jump.select(F.col("at").alias("to"), F.col("to").alias("next"))
        jump = written(jump.join(step, "to").select("at", F.col("next").alias("to")), "jump")


def nth_first_parent(edges: DataFrame, start, n: int) -> DataFrame:
    """(node): the n-th commit along first parents; empty past the root."""
    return first_parents(edges, start, n).where(F.col("depth") == n).select("node")


def negotiate(edges: DataFrame, want: DataFrame, have: DataFrame) -> DataFrame:
    """(node) that is reachable from want and not from have. Both are followed at once."""
    sets = [x.select(F.lit(k).alias("start"), F.col("start").alias("node")) for k, x in enumerate((want, have))]
    sides = closure(edges, sets[0].unionByName(sets[1])).groupBy("node").agg(F.max("start").alias("side"))
    return sides.where("side = 0").select("node")


def rebase_range(edges: DataFrame, onto, tip) -> DataFrame:
    """(node, step): the commits to replay, oldest first: the tip's first parents that onto doesn't reach."""
    walk, have = first_parents(edges, tip), closure(edges, one(edges, onto)).select("node")
    new = written(walk.join(have, "node", "left_anti"), "replay")
    return new.select("node", (F.lit(new.agg(F.max("depth")).first()[0]) - F.col("depth")).alias("step"))


def bisect_next(edges: DataFrame, bad, good: list[int], skip: list[int] = ()) -> DataFrame:
    """(node, left): the middle of the first-parent chain between bad and the nearest good, and how many are left."""
    chain = first_parents(edges, bad)
    near = chain.where(F.col("node").isin(list(good))).agg(F.min("depth")).first()[0]
    open_ = chain.where("depth > 0" if near is None else f"depth > 0 and depth < {near}").where(~F.col("node").isin(list(skip)) if skip else F.lit(True)).select("node", "depth")
    n = open_.count()
    return open_.orderBy("depth").offset(n // 2).limit(1).select("node", F.lit(n).cast("long").alias("left"))


def resolve_symbolic(refs: DataFrame, most: int = 10) -> DataFrame:
    """refs (name, target, symbolic) -> name, target, hops: symbolic ones followed up to ten times; null target if circular or missing."""
    now = refs.select("name", F.col("symbolic").alias("next"), "target", F.lit(0).alias("hops"))
    for _ in range(most):
        to = refs.select(F.col("name").alias("next"), F.col("symbolic").alias("s2"), F.col("target").alias("t2"))
        now = now.join(to, "next", "left").select("name", F.col("s2").alias("next"), F.coalesce("target", "t2").alias("target"), (F.col("hops") + F.col("next").isNotNull().cast("int")).alias("hops"))
    return now.select("name", "target", "hops")


def reachable_objects(refs: DataFrame, edges: DataFrame, commits: DataFrame, entries: DataFrame, bases: DataFrame) -> DataFrame:
    """(oid) of all objects that refs (node) reach: commits through edges, their trees, through entries (tree, oid) the
    trees and blobs below, and through bases (oid, base) the objects that deltas among them are made from.

    commits (n, oid, tree). One closure over commits, one over trees, one over delta bases."""
    live = closure(edges, refs.select(F.lit(0).alias("start"), F.col("node"))).select(F.col("node").alias("n"))
    there = written(commits.join(live, "n", "left_semi").select("oid", "tree"), "live")
    below = entries.select(F.col("tree").alias("child"), F.col("oid").alias("parent"))
    trees = closure(below, there.select(F.lit(0).alias("start"), F.col("tree").alias("node"))).select(F.col("node").alias("oid"))
    found = written(there.select("oid").unionByName(trees).distinct(), "found")
    needed = closure(bases.select(F.col("oid").alias("child"), F.col("base").alias("parent")), found.select(F.lit(0).alias("start"), F.col("oid").alias("node")))
    return needed.select(F.col("node").alias("oid")).distinct()
