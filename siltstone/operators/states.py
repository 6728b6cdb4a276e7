"""What a log of commands leaves: stashes, bisect and rebase sessions, branches, migrations; who may do what; and files by
path at a tree."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.scalar import valid_ref_name

#: What a role may do.
PERMISSIONS = {"read": "repo:read", "write": "repo:read repo:write", "admin": "repo:read repo:write repo:admin user:manage"}


def stash_lists(log: DataFrame) -> DataFrame:
    """log (repo, seq, op, id) -> repo, pos, id of what is stashed, newest at 0. `save` puts on top, `pop` and `drop` take
    the top away (of an empty list nothing), `clear` takes all; others change nothing. Running windows, no lists: a save
    stays if the height never falls below its own later, after the last clear."""
    w = W.partitionBy("repo").orderBy("seq")
    sofar, in_epoch = w.rowsBetween(W.unboundedPreceding, 0), W.partitionBy("repo", "epoch")
    step = F.when(F.col("op") == "save", 1).when(F.col("op").isin("pop", "drop"), -1).otherwise(0)
    x = log.withColumn("epoch", F.count_if(F.col("op") == "clear").over(sofar)).withColumn("last", F.max("epoch").over(W.partitionBy("repo"))).where("epoch = last")
    running = in_epoch.orderBy("seq").rowsBetween(W.unboundedPreceding, 0)
    x = x.withColumn("sum", F.sum(step).over(running)).withColumn("height", F.col("sum") - F.least(F.lit(0), F.min("sum").over(running)))
    later = F.min("height").over(in_epoch.orderBy(F.desc("seq")).rowsBetween(W.unboundedPreceding, -1))  # a growing frame
    kept = x.withColumn("later", later).where((F.col("op") == "save") & (F.col("later").isNull() | (F.col("later") >= F.col("height"))))
    return kept.select("repo", (F.row_number().over(W.partitionBy("repo").orderBy(F.desc("seq"))) - 1).alias("pos"), "id")


def _since_start(log: DataFrame, ends: list[str]) -> DataFrame:
    """Rows from the last start of each session on; none of a session that one of `ends` closed after it."""
    closes = F.col("op").isin("start", *ends)
    last = log.where(closes).groupBy("session").agg(F.max(F.struct("seq", "op")).alias("m")).where("m.op = 'start'").select("session", F.col("m.seq").alias("began"))
    return log.join(last, "session").where("seq >= began")


def bisect_marks(log: DataFrame) -> DataFrame:
    """log (session, seq, op, commit) of start (whose commit is bad), bad, good, skip and reset -> session, mark, commit,
    each once, of the sessions that are open: the state that a log replays to. A commit may have several marks."""
    mark = F.when(F.col("op") == "start", "bad").otherwise(F.col("op"))
    return _since_start(log, ["reset"]).where(F.col("op").isin("start", "bad", "good", "skip")).select("session", mark.alias("mark"), "commit").where("commit is not null").distinct()


def rebase_progress(log: DataFrame) -> DataFrame:
    """log (session, seq, op, steps) of start (with the number of commits), continue, skip and abort -> session, steps,
    done, skipped, finished of the sessions that weren't aborted. continue and skip go one commit on, not past the end."""
    x = _since_start(log, ["abort"]).groupBy("session").agg(F.max(F.when(F.col("op") == "start", F.col("steps"))).alias("steps"), F.count_if(F.col("op").isin("continue", "skip")).alias("moves"))
    n = F.row_number().over(W.partitionBy("session").orderBy("seq"))
    moves = _since_start(log, ["abort"]).where(F.col("op").isin("continue", "skip")).select("session", "op", n.alias("n"))
    skipped = moves.join(x.select("session", "steps"), "session").where("op = 'skip' and n <= steps").groupBy("session").agg(F.count("*").alias("skipped"))
    done = F.least("steps", "moves")
    return x.join(skipped, "session", "left").select("session", "steps", done.alias("done"), F.coalesce("skipped", F.lit(0)).alias("skipped"), (done == F.col("steps")).alias("finished"))


def migration_progress(objects: DataFrame, results: DataFrame) -> DataFrame:
    """objects (run, key), results (run, key, ok) -> run, total, migrated, failed, remaining, progress. A key migrates once
    however often it is tried; failures count as often as they happen, and none is migrated by them."""
    total = objects.groupBy("run").agg(F.count("*").alias("total"))
    tried = results.groupBy("run").agg(F.countDistinct(F.when(F.col("ok"), F.col("key"))).alias("migrated"), F.count_if(~F.col("ok")).alias("failed"))
    n = lambda c: F.coalesce(c, F.lit(0))
    progress = F.when(n("total") == 0, 1.0).otherwise(n("migrated") / F.col("total"))
    return total.join(tried, "run", "full_outer").select("run", n("total").alias("total"), n("migrated").alias("migrated"), n("failed").alias("failed"), F.greatest(F.lit(0), n("total") - n("migrated")).alias("remaining"), F.round(progress, 6).alias("progress"))


def to_migrate(objects: DataFrame, results: DataFrame) -> DataFrame:
    """What a resumed run still has to do."""
    return objects.join(results.where("ok"), ["run", "key"], "left_anti")


def granted(requests: DataFrame) -> DataFrame:
    """requests (role, needs: array, ...) with `any_of` and `all_of`: whether the role has one or all of the needs. Unknown
    roles have nothing; of no needs all are had and none is any."""
    table = F.create_map(*(x for role, p in PERMISSIONS.items() for x in (F.lit(role), F.array(*map(F.lit, p.split())))))
    own = F.coalesce(F.try_element_at(table, F.col("role")), F.array().cast("array<string>"))
    return requests.withColumn("any_of", F.arrays_overlap("needs", own)).withColumn("all_of", F.size(F.array_except("needs", own)) == 0)


def branch_results(refs: DataFrame, requests: DataFrame, head: str, protected: DataFrame) -> DataFrame:
    """refs (name, target), requests (id, op, branch, to, force), protected (branch) -> id, result, each request against
    the refs as given: `invalid`, `missing`, `exists`, `current` (head can't be deleted), `protected`, or `ok`. Ops are
    create, delete, rename (to another name) and switch."""
    now = refs.where(F.col("name").startswith("refs/heads/")).select(F.substring("name", 12, 1 << 20).alias("branch"))
    has = lambda df, on, name: df.select(F.col("branch").alias(on), F.lit(True).alias(name))
    j = requests.join(has(now, "branch", "there"), "branch", "left").join(has(now, "to", "taken"), "to", "left").join(has(protected, "branch", "kept"), "branch", "left")
    op, there = F.col("op"), F.col("there").isNotNull()
    new = F.when(op == "create", F.col("branch")).when(op == "rename", F.col("to"))
    taken = ((op == "create") & there) | ((op == "rename") & F.col("taken").isNotNull())
    result = F.when(new.isNotNull() & ~valid_ref_name(new), "invalid").when((op != "create") & ~there, "missing").when(taken, "exists")
    result = result.when((op == "delete") & (F.col("branch") == head), "current").when((op == "delete") & F.col("kept").isNotNull() & ~F.coalesce("force", F.lit(False)), "protected")
    return j.select("id", result.otherwise("ok").alias("result"))


def entries_at(entries: DataFrame, wanted: DataFrame, most: int = 64) -> DataFrame:
    """entries (tree, name, oid, is_dir), wanted (id, root, path) -> id, oid, is_dir of the paths that are there. One join a
    component, of the paths wanted alone; nothing is flattened. The empty path is the root. Slashes at the ends and doubled
    ones don't matter."""
    parts = F.filter(F.split("path", "/"), lambda x: x != "")
    at = wanted.select("id", parts.alias("parts"), F.col("root").alias("oid"), F.lit(True).alias("is_dir"))
    depth = wanted.agg(F.max(F.size(parts))).first()[0] or 0
    if depth > most:
        raise ValueError(f"paths deeper than {most}")
    inner = entries.select(F.col("tree").alias("oid"), F.col("name").alias("part"), F.col("oid").alias("child"), F.col("is_dir").alias("deeper"))
    out = at.where(F.size("parts") == 0)
    for n in range(1, depth + 1):
        step = at.where((F.size("parts") >= n) & F.col("is_dir")).withColumn("part", F.get("parts", F.lit(n - 1)))
        at = step.join(inner, ["oid", "part"]).select("id", "parts", F.col("child").alias("oid"), F.col("deeper").alias("is_dir"))
        out = out.unionByName(at.where(F.size("parts") == n))
    return out.select("id", "oid", "is_dir")


def overlaid(now: DataFrame, target: DataFrame) -> DataFrame:
    """A worktree after target's files were put over it: nothing is removed. Over an empty one it is a fresh checkout."""
    return target.unionByName(now.join(target.select("path"), "path", "left_anti").select(*target.columns))
