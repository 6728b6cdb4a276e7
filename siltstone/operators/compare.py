"""Comparison and merging of trees (path, mode, oid): full outer joins and their classes."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _sided(tree: DataFrame, side: str) -> DataFrame:
    return tree.select("path", F.col("oid").alias(f"{side}_oid"), F.col("mode").alias(f"{side}_mode"))


def tree_diff(old: DataFrame, new: DataFrame, compare_mode: bool = True) -> DataFrame:
    """path, change: added, deleted, modified or unchanged; by oid, and by mode if compare_mode."""
    same = F.col("a_oid").eqNullSafe(F.col("b_oid"))
    if compare_mode:
        same &= F.col("a_mode").eqNullSafe(F.col("b_mode"))
    change = F.when(F.col("a_oid").isNull(), "added").when(F.col("b_oid").isNull(), "deleted").when(same, "unchanged").otherwise("modified")
    return _sided(old, "a").join(_sided(new, "b"), "path", "full_outer").select("path", "a_oid", "b_oid", change.alias("change"))


def three_way(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """One row a path, with the three sides' oid and mode and the kind of conflict, or clean. Modes don't make conflicts."""
    sides = [_sided(t, s) for t, s in ((base, "base"), (ours, "ours"), (theirs, "theirs"))]
    j = reduce(lambda a, b: a.join(b, "path", "full_outer"), sides)
    b, o, t = (F.col(f"{s}_oid") for s in ("base", "ours", "theirs"))
    has = lambda c: c.isNotNull()
    kind = (
        F.when(has(b) & has(o) & has(t) & (b != o) & (b != t) & (o != t), "ModifyModify")
        .when(has(b) & has(o) & ~has(t) & (b != o), "ModifyDelete")
        .when(has(b) & ~has(o) & has(t) & (b != t), "DeleteModify")
        .when(~has(b) & has(o) & has(t) & (o != t), "AddAdd")
        .otherwise("clean")
    )
    return j.withColumn("kind", kind)


def merge(base: DataFrame, ours: DataFrame, theirs: DataFrame, strategy: str = "recursive") -> DataFrame:
    """path, oid, mode, side of the merged tree. recursive gives no tree where any path is in conflict (three_way lists
    them, merged_paths has the others); ours and theirs settle conflicts: each honours its own deletions and takes the
    other side's additions."""
    if strategy == "recursive" and not three_way(base, ours, theirs).where("kind <> 'clean'").isEmpty():
        return merged_paths(base, ours, theirs).where(F.lit(False))
    return merged_paths(base, ours, theirs, strategy)


def merged_paths(base: DataFrame, ours: DataFrame, theirs: DataFrame, strategy: str = "recursive") -> DataFrame:
    """As merge(), but recursive has all paths that aren't in conflict: what a merge in progress can write already."""
    j = three_way(base, ours, theirs)
    b, o, t = (F.col(f"{s}_oid") for s in ("base", "ours", "theirs"))
    if strategy == "recursive":
        side = F.when(F.col("kind") != "clean", None).when(o.eqNullSafe(b), "theirs").otherwise("ours")
    elif strategy == "ours":
        side = F.when(b.isNull() & o.isNull(), "theirs").otherwise("ours")
    elif strategy == "theirs":
        side = F.when(b.isNull() & t.isNull(), "ours").otherwise("theirs")
    else:
        raise ValueError(strategy)
    j = j.withColumn("side", side)
    pick = lambda what: F.when(F.col("side") == "ours", F.col(f"ours_{what}")).when(F.col("side") == "theirs", F.col(f"theirs_{what}"))
    return j.select("path", pick("oid").alias("oid"), pick("mode").alias("mode"), "side").where("oid is not null")


def three_way_sets(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, only_ours, only_theirs, both, as two diffs against the base say. Unlike three_way, a path that one side
    changes and the other deletes is in both sides' own sets."""
    a = tree_diff(base, ours).where("change <> 'unchanged'").select("path", F.col("change").alias("ours"), F.col("b_oid").alias("x"))
    c = tree_diff(base, theirs).where("change <> 'unchanged'").select("path", F.col("change").alias("theirs"), F.col("b_oid").alias("y"))
    same = F.col("ours").eqNullSafe(F.col("theirs")) & F.col("x").eqNullSafe(F.col("y"))
    return a.join(c, "path", "full_outer").select("path", F.col("ours").isNotNull().alias("by_ours"), F.col("theirs").isNotNull().alias("by_theirs"), F.coalesce(same, F.lit(False)).alias("same_change"))


def status(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """path, staged (index against head), unstaged (worktree against index, or head where not staged)."""
    h, i, w = (_sided(t, s) for t, s in ((head, "h"), (index, "i"), (work, "w")))
    j = h.join(i, "path", "full_outer").join(w, "path", "full_outer")
    known: Column = F.coalesce("i_oid", "h_oid")
    staged = F.when(F.col("i_oid").isNull(), None).when(F.col("h_oid").isNull(), "new").when(F.col("i_oid") != F.col("h_oid"), "modified")
    unstaged = F.when(F.col("w_oid").isNull(), "deleted").when(known.isNull(), "untracked").when(known != F.col("w_oid"), "modified")
    return j.select("path", staged.alias("staged"), unstaged.alias("unstaged")).where("staged is not null or unstaged is not null")


def apply_index(parent: DataFrame, index: DataFrame, deleted: DataFrame) -> DataFrame:
    """The next tree: the parent's files without deleted ones, overlaid by the index."""
    return parent.join(deleted, "path", "left_anti").join(index, "path", "left_anti").unionByName(index)


def checkout(now: DataFrame, target: DataFrame) -> DataFrame:
    """change, files: what a differential checkout does, by oid."""
    return tree_diff(now, target, compare_mode=False).groupBy("change").agg(F.count("*").alias("files"))


def overlaps(a: DataFrame, b: DataFrame, key: str, strict: bool = True) -> DataFrame:
    """Interval join of (key, id, lo, hi): pairs on one key whose ranges overlap, with the length. Touching ends overlap
    only if not strict."""
    x, y = (t.select(F.col(key).alias(key + s), F.col("id").alias("id" + s), F.col("lo").alias("lo" + s), F.col("hi").alias("hi" + s)) for t, s in ((a, "_a"), (b, "_b")))
    lo, hi = F.greatest("lo_a", "lo_b"), F.least("hi_a", "hi_b")
    return x.join(y, (F.col(key + "_a") == F.col(key + "_b")) & ((lo < hi) if strict else (lo <= hi))).select(F.col(key + "_a").alias(key), "id_a", "id_b", (hi - lo).alias("overlap"))
