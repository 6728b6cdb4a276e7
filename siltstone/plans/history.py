"""Queries over commits, trees and refs: picks, rebases, chains, updates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import compare, graph, history, measures
from ..sources import repository as repo
from ..sources.repository import with_tables
from .registry import query


def _trees(s, d):
    return [repo.tree(s, d, x) for x in ("base", "ours", "theirs")]


def _settled(b: str, o: str, t: str) -> str:
    """SQL of a three-way merge of three tables; conflicting paths stay as the second has them."""
    clash = "((b.oid <> o.oid AND b.oid <> t.oid AND o.oid <> t.oid) OR (t.oid IS NULL AND b.oid <> o.oid) OR (o.oid IS NULL AND b.oid <> t.oid) OR (b.oid IS NULL AND o.oid <> t.oid))"
    take = f"CASE WHEN coalesce({clash}, false) THEN o.oid WHEN o.oid IS NOT DISTINCT FROM b.oid THEN t.oid ELSE o.oid END"
    return f"SELECT path, {take} AS oid, coalesce({clash}, false) AS conflict FROM {b} b FULL JOIN {o} o USING (path) FULL JOIN {t} t USING (path) WHERE {take} IS NOT NULL OR coalesce({clash}, false)"


def _shown(tree):
    return tree.select("path", "oid", F.col("conflict").isNotNull().alias("conflict"))


@query(with_tables("base ours theirs", _settled("base", "theirs", "ours")))
def cherry_pick(s, d):
    base, ours, theirs = _trees(s, d)
    return _shown(history.cherry_pick(theirs, base, ours))


@query(with_tables("base ours theirs", _settled("ours", "theirs", "base")))
def revert(s, d):
    base, ours, theirs = _trees(s, d)
    return _shown(history.revert(theirs, ours, base))


REBASED = f"one AS ({_settled('base', 'theirs', 'ours')}), two AS ({_settled('ours', '(SELECT path, oid FROM one WHERE oid IS NOT NULL)', 'base')})"


@query(with_tables("base ours theirs", "SELECT path, oid FROM two WHERE oid IS NOT NULL", REBASED))
def rebase_tree(s, d):
    """A commit and its revert, replayed onto their tree."""
    base, ours, theirs = _trees(s, d)
    return history.rebase(theirs, [(base, ours), (ours, base)])[0].select("path", "oid")


@query(with_tables("base ours theirs", "SELECT 0 AS step, path FROM one WHERE conflict UNION ALL SELECT 1, path FROM two WHERE conflict", REBASED))
def rebase_conflicts(s, d):
    base, ours, theirs = _trees(s, d)
    return history.rebase(theirs, [(base, ours), (ours, base)])[1].select("step", "path")


@query(with_tables("base ours theirs", "SELECT path, coalesce(i.oid, w.oid, h.oid) AS oid, CASE WHEN i.oid IS NOT NULL THEN 'index' WHEN w.oid IS NOT NULL THEN 'work' ELSE 'head' END AS source FROM base h FULL JOIN (SELECT * FROM ours WHERE path LIKE 'dir1%') i USING (path) FULL JOIN theirs w USING (path)"))
def stash_tree(s, d):
    base, ours, theirs = _trees(s, d)
    return history.stash(base, ours.where(F.col("path").startswith("dir1")), theirs)


@query(with_tables("base ours", "SELECT path, oid FROM ours WHERE path NOT LIKE 'dir4/%' UNION ALL SELECT path, oid FROM base WHERE path LIKE 'dir4/%'"))
def reset_paths(s, d):
    base, ours, _ = _trees(s, d)
    return history.reset_paths(ours, base, F.col("path").startswith("dir4/")).select("path", "oid")


@query(with_tables("ours theirs", "SELECT NOT EXISTS (SELECT path, oid FROM ours EXCEPT SELECT path, oid FROM theirs) AND NOT EXISTS (SELECT path, oid FROM theirs EXCEPT SELECT path, oid FROM ours) AS equal"))
def tree_equality(s, d):
    _, ours, theirs = _trees(s, d)
    return compare.tree_diff(ours, theirs, compare_mode=False).agg((F.count_if(F.col("change") != "unchanged") == 0).alias("equal"))


FILES = "files AS (SELECT l_orderkey + 1 AS n, l_linenumber AS path, min(l_partkey) AS oid FROM lineitem GROUP BY ALL)"


@query(with_tables("edges", "SELECT coalesce(a.n, b.n) AS \"commit\", count(*) FILTER (b.oid IS NULL) AS added, count(*) FILTER (a.oid IS NULL) AS deleted, count(*) FILTER (a.oid <> b.oid) AS modified FROM files a FULL JOIN (SELECT child AS n, path, oid FROM edges JOIN files ON parent = n AND pos = 0) b ON a.n = b.n AND a.path = b.path GROUP BY 1", FILES))
def log_stat(s, d):
    li = repo.table(s, d, "lineitem").groupBy((F.col("l_orderkey") + 1).alias("commit"), F.col("l_linenumber").alias("path")).agg(F.min("l_partkey").alias("oid"))
    return history.changes_by_commit(li, repo.commit_parents(s, d))


REACH = "ra AS (SELECT CAST(995 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.parent, depth + 1 FROM ra r JOIN edges e ON e.child = r.node), rb AS (SELECT CAST(840 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.parent, depth + 1 FROM rb r JOIN edges e ON e.child = r.node)"


@query(with_tables("edges", "SELECT node, a.depth AS depth_a, b.depth AS depth_b FROM (SELECT node, min(depth) AS depth FROM ra GROUP BY node) a JOIN (SELECT node, min(depth) AS depth FROM rb GROUP BY node) b USING (node) WHERE node NOT IN (SELECT parent FROM edges WHERE child IN (SELECT node FROM ra INTERSECT SELECT node FROM rb))", REACH))
def merge_base_distances(s, d):
    out = graph.merge_bases(repo.commit_parents(s, d), 995, 840)
    return out.select("node", F.col("depth_a").cast("long").alias("depth_a"), F.col("depth_b").cast("long").alias("depth_b"))


@query(with_tables("edges", "SELECT node AS old, EXISTS (SELECT 1 FROM reach r WHERE r.node = v.node) AS is_ancestor FROM (VALUES (CAST(2 AS BIGINT)), (62), (332), (996), (997), (5)) v(node)", "reach AS (SELECT CAST(997 AS BIGINT) AS node UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node)"))
def ancestry_tests(s, d):
    """Fast-forward tests: whether each old tip is an ancestor of the new one."""
    edges = repo.commit_parents(s, d)
    asked = s.createDataFrame([(x,) for x in (2, 62, 332, 996, 997, 5)], "old long")
    seen = graph.closure(edges, graph.one(edges, 997)).select(F.col("node").alias("old"), F.lit(True).alias("there"))
    return asked.join(seen, "old", "left").select("old", F.coalesce("there", F.lit(False)).alias("is_ancestor"))


@query(with_tables("commits edges", "SELECT count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts, count(DISTINCT author) AS authors FROM commits WHERE n IN (SELECT node FROM reach)", "reach AS (SELECT CAST(1400 AS BIGINT) AS node UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node)"))
def commit_stats(s, d):
    edges = repo.commit_parents(s, d)
    seen = graph.closure(edges, graph.one(edges, 1400)).select(F.col("node").alias("n"))
    return repo.commits(s, d).join(seen, "n", "left_semi").agg(F.count("*").alias("commits"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.countDistinct("author").alias("authors"))


@query("""WITH RECURSIVE deltas AS (SELECT p_partkey AS id, p_partkey - 1 AS base FROM part WHERE p_partkey % 13 <> 0),
  walk AS (SELECT id, base AS node, CAST(1 AS BIGINT) AS depth FROM deltas UNION ALL SELECT w.id, x.base, depth + 1 FROM walk w JOIN deltas x ON x.id = w.node WHERE depth < 20),
  last AS (SELECT id, max_by(node, depth) AS root, max(depth) AS depth FROM walk GROUP BY id)
  SELECT id, CASE WHEN depth <= 10 THEN root END AS root, CASE WHEN depth <= 10 THEN depth END AS depth, depth <= 10 AS ok FROM last""")
def delta_chains(s, d):
    deltas = repo.table(s, d, "part").where("p_partkey % 13 <> 0").select(F.col("p_partkey").alias("id"), (F.col("p_partkey") - 1).alias("base"))
    return history.chains(deltas)


@query("SELECT r_name || '/' || n_name || '/' || c_name AS path, sha256('file:' || c_custkey) AS oid FROM region JOIN nation ON n_regionkey = r_regionkey JOIN customer ON c_nationkey = n_nationkey")
def flat_files(s, d):
    """Trees of regions, nations and customers, as paths."""
    of = lambda df, tree, name, oid, is_dir: df.select(F.expr(tree).alias("tree"), F.col(name).alias("name"), F.expr(oid).alias("oid"), F.lit(is_dir).alias("is_dir"))
    r, n, c = (repo.table(s, d, x) for x in ("region", "nation", "customer"))
    entries = of(r, "'root'", "r_name", "concat('r', r_regionkey)", True).unionByName(of(n, "concat('r', n_regionkey)", "n_name", "concat('n', n_nationkey)", True)).unionByName(of(c, "concat('n', c_nationkey)", "c_name", "sha2(concat('file:', c_custkey), 256)", False))
    return history.flatten(entries, "root")


@query("""WITH RECURSIVE r AS (SELECT n_nationkey AS k, CASE WHEN n_nationkey % 5 <> 0 THEN CAST(floor(n_nationkey / 2) AS BIGINT) WHEN n_nationkey = 15 THEN 15 END AS next FROM nation),
  walk AS (SELECT k, k AS "at", next, 0 AS hops FROM r UNION ALL SELECT w.k, r.k, r.next, hops + 1 FROM walk w JOIN r ON r.k = w.next WHERE hops < 10)
  SELECT 'ref' || k AS name, max(CASE WHEN next IS NULL THEN 1000 + "at" END) AS target FROM walk GROUP BY k""")
def symbolic_refs(s, d):
    """Symbolic refs followed; one points to itself."""
    to = F.expr("CASE WHEN n_nationkey % 5 <> 0 THEN concat('ref', n_nationkey div 2) WHEN n_nationkey = 15 THEN 'ref15' END")
    refs = repo.table(s, d, "nation").select(F.expr("concat('ref', n_nationkey)").alias("name"), to.alias("symbolic"), F.when(to.isNull(), 1000 + F.col("n_nationkey")).alias("target"))
    return graph.resolve_symbolic(refs).select("name", "target")


UPDATES = "SELECT name, CASE WHEN length(name) % 3 = 0 THEN target ELSE target + length(name) % 2 END AS expected, CASE WHEN length(name) % 5 <> 0 THEN target + 7 END AS new FROM refs UNION ALL SELECT name || '-new', CASE WHEN length(name) % 2 = 0 THEN target END, target FROM refs"


@query(with_tables("refs", f"SELECT name, CASE WHEN now IS DISTINCT FROM expected THEN now ELSE new END AS target, CASE WHEN now IS DISTINCT FROM expected THEN 'stale' WHEN new IS NULL THEN 'deleted' WHEN now IS NULL THEN 'created' ELSE 'updated' END AS result FROM ({UPDATES}) LEFT JOIN (SELECT name, target AS now FROM refs) USING (name)"))
def ref_updates(s, d):
    refs = repo.refs(s, d)
    old = refs.selectExpr("name", "CASE WHEN length(name) % 3 = 0 THEN target ELSE target + length(name) % 2 END AS expected", "CASE WHEN length(name) % 5 <> 0 THEN target + 7 END AS new")
    new = refs.selectExpr("concat(name, '-new') AS name", "CASE WHEN length(name) % 2 = 0 THEN target END AS expected", "target AS new")
    return history.swap_refs(refs, old.unionByName(new))


@query(with_tables("refs", "SELECT name FROM refs WHERE name LIKE 'refs/remotes/%' AND replace(name, 'refs/remotes/', '') NOT IN (SELECT n_name FROM nation WHERE n_regionkey < 3)"))
def stale_remotes(s, d):
    there = repo.table(s, d, "nation").where("n_regionkey < 3").select(F.concat(F.lit("refs/remotes/"), "n_name").alias("name"))
    return measures.missing(repo.refs(s, d).where(F.col("name").startswith("refs/remotes/")).select("name"), there, "name")


@query(with_tables("refs commits", """SELECT rev, coalesce(max(n1), max(n2), max(n3)) AS n FROM (
  SELECT rev, c.n AS n1, CASE WHEN count(a.n) OVER (PARTITION BY rev) = 1 THEN a.n END AS n2, r.target AS n3
  FROM (SELECT oid AS rev FROM commits WHERE n % 100 = 1 UNION ALL SELECT substr(oid, 1, 9) FROM commits WHERE n % 100 = 2 UNION ALL SELECT replace(name, 'refs/heads/', '') FROM refs WHERE name LIKE 'refs/heads/%') q
  LEFT JOIN commits c ON c.oid = rev LEFT JOIN commits a ON length(rev) = 9 AND substr(a.oid, 1, 9) = rev LEFT JOIN refs r ON r.name = 'refs/heads/' || rev) GROUP BY rev"""))
def revisions(s, d):
    """Whole ids, abbreviated ids of nine digits (null if ambiguous) and branch names, to commits."""
    c, r = repo.commits(s, d).select("n", "oid"), repo.refs(s, d).where(F.col("name").startswith("refs/heads/")).select(F.substring("name", 12, 1000).alias("rev"), F.col("target").alias("n3"))
    asked = c.where("n % 100 = 1").select(F.col("oid").alias("rev")).unionByName(c.where("n % 100 = 2").select(F.substring("oid", 1, 9).alias("rev"))).unionByName(r.select("rev"))
    short = c.groupBy(F.substring("oid", 1, 9).alias("rev")).agg(F.when(F.count("*") == 1, F.max("n")).alias("n2"))
    return asked.distinct().join(c.select(F.col("oid").alias("rev"), F.col("n").alias("n1")), "rev", "left").join(short, "rev", "left").join(r, "rev", "left").select("rev", F.coalesce("n1", "n2", "n3").alias("n"))
