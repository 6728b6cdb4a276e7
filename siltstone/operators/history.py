"""What makes history: picks, reverts, rebases, stashes and resets are three-way merges or overlays of trees; and the
queries over many commits at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import compare


def settled(base: DataFrame, ours: DataFrame, theirs: DataFrame) -> DataFrame:
    """path, mode, oid, conflict: the merged tree with conflicting paths as ours has them."""
    j = compare.three_way(base, ours, theirs)
    theirs_wins = (F.col("kind") == "clean") & F.col("ours_oid").eqNullSafe(F.col("base_oid"))
    pick = lambda c: F.when(theirs_wins, F.col(f"theirs_{c}")).otherwise(F.col(f"ours_{c}"))
    return j.select("path", pick("mode").alias("mode"), pick("oid").alias("oid"), F.when(F.col("kind") != "clean", F.col("kind")).alias("conflict")).where("oid is not null or conflict is not null")


def cherry_pick(head: DataFrame, parent: DataFrame, picked: DataFrame) -> DataFrame:
    """What picked changed in its parent, done to head."""
    return settled(parent, head, picked)


def revert(head: DataFrame, commit: DataFrame, parent: DataFrame) -> DataFrame:
    """What commit changed in its parent, undone in head."""
    return settled(commit, head, parent)


def rebase(onto: DataFrame, steps: list[tuple[DataFrame, DataFrame]]) -> tuple[DataFrame, DataFrame]:
    """Replays (parent, commit) trees, oldest first, onto a tree -> the last tree, and the conflicts (step, path,
    conflict) of all steps; a conflicting path stays as it is so far. A plan's depth is the number of steps."""
    tree, found = onto, []
    for n, (parent, commit) in enumerate(steps):
        out = settled(parent, tree, commit)
        found.append(out.where("conflict is not null").select(F.lit(n).alias("step"), "path", "conflict"))
        tree = out.where("oid is not null").select("path", "mode", "oid")
    conflicts = found[0]
    for x in found[1:]:
        conflicts = conflicts.unionByName(x)
    return tree, conflicts


def stash(head: DataFrame, index: DataFrame, work: DataFrame) -> DataFrame:
    """path, oid, source of the saved tree: the index's entry, or else the worktree's, or else the head's."""
    j = None
    for side, t in (("index", index), ("work", work), ("head", head)):
        t = t.select("path", F.col("oid").alias(side))
        j = t if j is None else j.join(t, "path", "full_outer")
    source = F.when(F.col("index").isNotNull(), "index").when(F.col("work").isNotNull(), "work").otherwise("head")
    return j.select("path", F.coalesce("index", "work", "head").alias("oid"), source.alias("source"))


def reset_paths(index: DataFrame, target: DataFrame, chosen) -> DataFrame:
    """The index with the chosen paths (a condition) as target has them; those that it lacks leave the index."""
    return index.where(~chosen).unionByName(target.where(chosen))


def changes_by_commit(files: DataFrame, edges: DataFrame) -> DataFrame:
    """files (commit, path, oid), edges (child, parent, pos) -> commit, added, deleted, modified against the first parent.
    One full outer join for all commits; a commit without a parent adds all of its files."""
    first = edges.where("pos = 0").select("child", "parent")
    new = files.select("commit", "path", F.col("oid").alias("new"))
    old = first.join(files, F.col("parent") == F.col("commit")).select(F.col("child").alias("commit"), "path", F.col("oid").alias("old"))
    j = new.join(old, ["commit", "path"], "full_outer")
    n = lambda cond, name: F.count_if(cond).alias(name)
    return j.groupBy("commit").agg(n(F.col("old").isNull(), "added"), n(F.col("new").isNull(), "deleted"), n(F.col("old") != F.col("new"), "modified"))


def chains(deltas: DataFrame, most: int = 10) -> DataFrame:
    """deltas (id, base) -> id, root, depth, ok: where chains of bases end. By doubling, so a chain of `most` takes about
    log2(most) joins; ok is false where a chain is longer or comes back to itself, and root and depth are null there."""
    at = deltas.select("id", F.col("base").alias("node"), F.lit(1).alias("depth"))
    for _ in range(max(1, most).bit_length()):
        step = at.select(F.col("id").alias("node"), F.col("node").alias("next"), F.col("depth").alias("more"))
        at = at.join(step, "node", "left").select("id", F.coalesce("next", "node").alias("node"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"))
    inner = deltas.select(F.col("id").alias("node"), F.lit(True).alias("inner"))
    ok = F.col("inner").isNull() & (F.col("depth") <= most)
    return at.join(inner, "node", "left").select("id", F.when(ok, F.col("node")).alias("root"), F.when(ok, F.col("depth")).cast("long").alias("depth"), ok.alias("ok"))


def flatten(entries: DataFrame, root: str, most: int = 64) -> DataFrame:
    """entries (tree, name, oid, is_dir) -> path, oid of all files under the root tree; one join a level of directories."""
    level = entries.where(F.col("tree") == root).select(F.col("name").alias("path"), "oid", "is_dir")
    out = level.where("not is_dir").select("path", "oid")
    inner = entries.select(F.col("tree").alias("oid"), "name", F.col("oid").alias("child"), F.col("is_dir").alias("deeper"))
    for _ in range(most):
        level = level.where("is_dir").join(inner, "oid").select(F.concat_ws("/", "path", "name").alias("path"), F.col("child").alias("oid"), F.col("deeper").alias("is_dir"))
        if level.where("is_dir").isEmpty():
            return out.unionByName(level.select("path", "oid"))
        out = out.unionByName(level.where("not is_dir").select("path", "oid"))
    raise ValueError(f"directories deeper than {most}")


def swap_refs(refs: DataFrame, updates: DataFrame) -> DataFrame:
    """refs (name, target), updates (name, expected, new) -> name, target, result: created, updated, deleted (new is
    null) or stale, where the ref isn't what the update expects and stays."""
    now = refs.select("name", F.col("target").alias("now"))
    result = F.when(~F.col("now").eqNullSafe(F.col("expected")), "stale").when(F.col("new").isNull(), "deleted").when(F.col("now").isNull(), "created").otherwise("updated")
    j = updates.join(now, "name", "left").withColumn("result", result)
    return j.select("name", F.when(F.col("result") == "stale", F.col("now")).otherwise(F.col("new")).alias("target"), "result")
