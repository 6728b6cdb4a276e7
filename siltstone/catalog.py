"""All queries of the engine and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .functions import filetypes, scalar
from .operators import compare, content, graph, measures
from .operators.media import hash_matches, sign_hash
from .plans import decisions, deltas, files, history, media, models, rules, states  # noqa: F401 (their queries register)
from .plans.registry import oracle_sql, queries, query  # noqa: F401
from .sources import repository as repo
from .sources.repository import with_tables
from .streaming import logs

FLAGSHIP = "three_way_conflicts"


def _trees(s: SparkSession, d: str) -> list[DataFrame]:
    return [repo.tree(s, d, x) for x in ("base", "ours", "theirs")]


J3 = "base b FULL JOIN ours o USING (path) FULL JOIN theirs t USING (path)"
KIND = """CASE WHEN b.oid <> o.oid AND b.oid <> t.oid AND o.oid <> t.oid THEN 'ModifyModify' WHEN t.oid IS NULL AND b.oid <> o.oid THEN 'ModifyDelete'
  WHEN o.oid IS NULL AND b.oid <> t.oid THEN 'DeleteModify' WHEN b.oid IS NULL AND o.oid <> t.oid THEN 'AddAdd' ELSE 'clean' END"""


# comparison and merging


@query(with_tables("base ours", "SELECT path, o.oid AS new_oid, CASE WHEN b.oid IS NULL THEN 'added' WHEN o.oid IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM base b FULL JOIN ours o USING (path) WHERE b.oid IS DISTINCT FROM o.oid OR b.mode IS DISTINCT FROM o.mode"))
def tree_diff(s, d):
    return compare.tree_diff(*_trees(s, d)[:2]).where("change <> 'unchanged'").select("path", F.col("b_oid").alias("new_oid"), "change")


@query(with_tables("base ours theirs", f"SELECT path, {KIND} AS kind FROM {J3}"))
def three_way_conflicts(s, d):
    return compare.three_way(*_trees(s, d)).select("path", "kind")


@query(with_tables("base ours theirs", f"SELECT kind, count(*) AS paths FROM (SELECT {KIND} AS kind FROM {J3}) GROUP BY kind"))
def conflict_stats(s, d):
    return compare.three_way(*_trees(s, d)).groupBy("kind").agg(F.count("*").alias("paths"))


@query(with_tables("base ours theirs", f"SELECT path, CASE WHEN o.oid IS NOT DISTINCT FROM b.oid THEN t.oid ELSE o.oid END AS oid, CASE WHEN o.oid IS NOT DISTINCT FROM b.oid THEN t.mode ELSE o.mode END AS mode FROM {J3} WHERE {KIND} = 'clean' AND CASE WHEN o.oid IS NOT DISTINCT FROM b.oid THEN t.oid ELSE o.oid END IS NOT NULL"))
def merge_paths(s, d):
    return compare.merged_paths(*_trees(s, d)).select("path", "oid", "mode")


@query(with_tables("base ours theirs", "SELECT path, o.oid, CASE WHEN o.oid = b.oid THEN b.mode ELSE o.mode END AS mode FROM ours o LEFT JOIN base b USING (path)"))
def merge_recursive(s, d):
    """A merge without conflicts, of our tree and an unchanged one; and one with conflicts, which has no tree."""
    base, ours, theirs = _trees(s, d)
    return compare.merge(base, ours, base).unionByName(compare.merge(base, ours, theirs)).select("path", "oid", "mode")


@query(with_tables("base ours theirs", f"SELECT path, coalesce(o.oid, t.oid) AS oid FROM {J3} WHERE o.oid IS NOT NULL OR (b.oid IS NULL AND t.oid IS NOT NULL)"))
def merge_ours(s, d):
    return compare.merge(*_trees(s, d), strategy="ours").select("path", "oid")


@query(with_tables("base ours theirs", f"SELECT path, coalesce(t.oid, o.oid) AS oid FROM {J3} WHERE t.oid IS NOT NULL OR (b.oid IS NULL AND o.oid IS NOT NULL)"))
def merge_theirs(s, d):
    return compare.merge(*_trees(s, d), strategy="theirs").select("path", "oid")


CHANGED = "({0}.oid IS DISTINCT FROM b.oid OR {0}.mode IS DISTINCT FROM b.mode)"


@query(with_tables("base ours theirs", f"SELECT path, {CHANGED.format('o')} AS by_ours, {CHANGED.format('t')} AS by_theirs, {CHANGED.format('o')} AND {CHANGED.format('t')} AND o.oid IS NOT DISTINCT FROM t.oid AS same_change FROM {J3} WHERE {CHANGED.format('o')} OR {CHANGED.format('t')}"))
def three_way_sets(s, d):
    return compare.three_way_sets(*_trees(s, d))


@query(with_tables("base ours theirs", """SELECT path, CASE WHEN o.oid IS NULL THEN NULL WHEN b.oid IS NULL THEN 'new' WHEN b.oid <> o.oid THEN 'modified' END AS staged,
  CASE WHEN t.oid IS NULL THEN 'deleted' WHEN coalesce(o.oid, b.oid) IS NULL THEN 'untracked' WHEN coalesce(o.oid, b.oid) <> t.oid THEN 'modified' END AS unstaged
  FROM (SELECT * FROM base) b FULL JOIN (SELECT * FROM ours WHERE path LIKE 'dir1%') o USING (path) FULL JOIN theirs t USING (path)
  WHERE (o.oid IS NOT NULL AND (b.oid IS NULL OR b.oid <> o.oid)) OR t.oid IS NULL OR coalesce(o.oid, b.oid) IS NULL OR coalesce(o.oid, b.oid) <> t.oid"""))
def status(s, d):
    base, ours, theirs = _trees(s, d)
    return compare.status(base, ours.where(F.col("path").startswith("dir1")), theirs)


@query(with_tables("base ours theirs", "SELECT path, oid FROM base WHERE path NOT IN (SELECT path FROM ours WHERE path LIKE 'dir1%') AND path NOT IN (SELECT path FROM base WHERE path LIKE 'dir2/%') UNION ALL SELECT path, oid FROM ours WHERE path LIKE 'dir1%'"))
def commit_tree(s, d):
    base, ours, _ = _trees(s, d)
    return compare.apply_index(base, ours.where(F.col("path").startswith("dir1")), base.where(F.col("path").startswith("dir2/")).select("path")).select("path", "oid")


@query(with_tables("ours theirs", "SELECT CASE WHEN o.oid IS NULL THEN 'added' WHEN t.oid IS NULL THEN 'deleted' WHEN o.oid = t.oid THEN 'unchanged' ELSE 'modified' END AS change, count(*) AS files FROM ours o FULL JOIN theirs t USING (path) GROUP BY 1"))
def checkout_counts(s, d):
    return compare.checkout(*_trees(s, d)[1:])


SEGMENT = "seg AS (SELECT l_partkey AS track, l_linenumber AS ln, l_orderkey AS id, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) AS lo, date_diff('day', DATE '1990-01-01', CAST(l_shipdate AS DATE)) + l_quantity AS hi FROM lineitem)"


@query(f"WITH {SEGMENT} SELECT x.track, x.id AS id_a, y.id AS id_b, least(x.hi, y.hi) - greatest(x.lo, y.lo) AS overlap FROM seg x JOIN seg y ON x.track = y.track AND x.ln = 1 AND y.ln = 2 AND x.lo < y.hi AND x.hi > y.lo")
def timeline_overlaps(s, d):
    day = F.date_diff(F.col("l_shipdate").cast("date"), F.lit("1990-01-01").cast("date"))
    seg = repo.table(s, d, "lineitem").select("l_linenumber", F.col("l_partkey").alias("track"), F.col("l_orderkey").alias("id"), day.alias("lo"), (day + F.col("l_quantity")).alias("hi"))
    return compare.overlaps(seg.where("l_linenumber = 1"), seg.where("l_linenumber = 2"), "track")


# graph


def _closure_sql(start: str, name: str = "reach") -> str:
    return f"{name} AS (SELECT CAST({start} AS BIGINT) AS node UNION SELECT e.parent FROM {name} r JOIN edges e ON e.child = r.node)"


@query(with_tables("edges", "SELECT node, min(depth) AS depth FROM reach GROUP BY node", "reach AS (SELECT CAST(997 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION SELECT e.parent, depth + 1 FROM reach r JOIN edges e ON e.child = r.node)"))
def ancestors(s, d):
    e = repo.commit_parents(s, d)
    return graph.closure(e, graph.one(e, 997)).select("node", F.col("depth").cast("long").alias("depth"))


@query(with_tables("edges", "SELECT node FROM (SELECT node FROM ra INTERSECT SELECT node FROM rb) WHERE node NOT IN (SELECT parent FROM edges WHERE child IN (SELECT node FROM ra INTERSECT SELECT node FROM rb))", _closure_sql("995", "ra") + ", " + _closure_sql("840", "rb")))
def merge_base(s, d):
    return graph.merge_bases(repo.commit_parents(s, d), 995, 840).select("node")


@query(with_tables("edges", "SELECT child AS node, CAST(rank() OVER (ORDER BY child) - 1 AS BIGINT) AS step FROM (SELECT node AS child FROM walk WHERE node NOT IN (SELECT node FROM onto))", _closure_sql("840", "onto") + ", walk AS (SELECT CAST(995 AS BIGINT) AS node UNION ALL SELECT e.parent FROM walk w JOIN edges e ON e.child = w.node AND e.pos = 0)"))
def rebase_commits(s, d):
    return graph.rebase_range(repo.commit_parents(s, d), 840, 995)


@query(with_tables("edges", "SELECT node FROM walk WHERE depth = 3", "walk AS (SELECT CAST(1234 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT e.parent, depth + 1 FROM walk w JOIN edges e ON e.child = w.node AND e.pos = 0)"))
def third_first_parent(s, d):
    return graph.nth_first_parent(repo.commit_parents(s, d), 1234, 3)


@query(with_tables("edges", "SELECT node, depth FROM walk", "walk AS (SELECT CAST(1234 AS BIGINT) AS node, CAST(0 AS BIGINT) AS depth UNION ALL SELECT e.parent, depth + 1 FROM walk w JOIN edges e ON e.child = w.node AND e.pos = 0)"))
def first_parent_walk(s, d):
    return graph.first_parents(repo.commit_parents(s, d), 1234).select("node", F.col("depth").cast("long").alias("depth"))


@query(with_tables("edges", "SELECT node FROM w WHERE node NOT IN (SELECT node FROM h)", "w AS (SELECT CAST(start AS BIGINT) AS node FROM (VALUES (990), (1000), (1405)) v(start) UNION SELECT e.parent FROM w JOIN edges e ON e.child = w.node), h AS (SELECT CAST(start AS BIGINT) AS node FROM (VALUES (495), (333)) v(start) UNION SELECT e.parent FROM h JOIN edges e ON e.child = h.node)"))
def negotiation(s, d):
    of = lambda *x: s.createDataFrame([(i,) for i in x], "start long")
    return graph.negotiate(repo.commit_parents(s, d), of(990, 1000, 1405), of(495, 333))


@query(with_tables("edges", "SELECT node, CAST(10 AS BIGINT) AS \"left\" FROM walk WHERE depth = 6", "walk AS (SELECT CAST(1400 AS BIGINT) AS node, 0 AS depth UNION ALL SELECT e.parent, depth + 1 FROM walk w JOIN edges e ON e.child = w.node AND e.pos = 0)"))
def bisect_midpoint(s, d):
    return graph.bisect_next(repo.commit_parents(s, d), 1400, [])


@query(with_tables("edges refs", "SELECT o_orderkey + 1 AS n FROM orders WHERE o_orderkey + 1 NOT IN (SELECT node FROM reach)", "reach AS (SELECT target AS node FROM refs WHERE name LIKE 'refs/heads/%' UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node)"))
def unreachable_commits(s, d):
    starts = repo.refs(s, d).where(F.col("name").startswith("refs/heads/")).select(F.lit(1).alias("x"), F.col("target").alias("start"))
    seen = graph.closure(repo.commit_parents(s, d), starts).select(F.col("node").alias("n")).distinct()
    return measures.missing(repo.commits(s, d).select("n"), seen, "n")


# logs, filters, order


@query(with_tables("commits", "SELECT n, substr(oid, 1, 7) AS short, string_split(message, chr(10))[1] AS summary FROM commits WHERE (contains(author, '0042') OR contains(email, '0042')) AND contains(message, 'fix')"))
def log_filter(s, d):
    hit = (F.col("author").contains("0042") | F.col("email").contains("0042")) & F.col("message").contains("fix")
    return repo.commits(s, d).where(hit).select("n", F.substring("oid", 1, 7).alias("short"), F.split("message", "\n")[0].alias("summary"))


@query(with_tables("commits", "SELECT n, oid FROM commits ORDER BY ts DESC, oid LIMIT 20 OFFSET 10"))
def log_page(s, d):
    return repo.commits(s, d).orderBy(F.desc("ts"), "oid").offset(10).limit(20).select("n", "oid")


@query(with_tables("commits", "SELECT substr(oid, 1, 4) AS prefix, count(*) AS hits FROM commits GROUP BY 1 HAVING count(*) > 1"))
def ambiguous_prefixes(s, d):
    return repo.commits(s, d).groupBy(F.substring("oid", 1, 4).alias("prefix")).agg(F.count("*").alias("hits")).where("hits > 1")


@query(with_tables("commits", "SELECT author, email, count(*) AS commits, min(ts) AS first_ts, max(ts) AS last_ts FROM commits GROUP BY ALL ORDER BY commits DESC, author, email LIMIT 10"))
def author_leaderboard(s, d):
    return measures.leaderboard(repo.commits(s, d))


@query("SELECT user_id, event_id, lag(event_id) OVER w AS old, count(*) OVER (PARTITION BY user_id) - row_number() OVER w AS pos FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def reflog_positions(s, d):
    return measures.positions(repo.events(s, d).withColumn("value", F.col("event_id")), "user_id", "ts", "event_id").select("user_id", "event_id", "old", "pos")


@query("SELECT user_id, event_id FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3")
def reflog_newest(s, d):
    return measures.positions(repo.events(s, d), "user_id", "ts", "event_id").where("pos < 3").select("user_id", "event_id")


@query("SELECT event_type, max_by(event_id, (ts, event_id)) AS event_id FROM events GROUP BY event_type")
def last_operation(s, d):
    return repo.events(s, d).groupBy("event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("SELECT p_partkey AS id, 'v' || (p_size % 7) || '.' || p_size || '.' || (p_partkey % 13) AS tag, row_number() OVER (ORDER BY p_size % 7 DESC, p_size DESC, p_partkey % 13 DESC, p_partkey) AS rank FROM part QUALIFY rank <= 50")
def tag_versions(s, d):
    tags = repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), F.expr("concat('v', cast(p_size % 7 as string), '.', cast(p_size as string), '.', cast(p_partkey % 13 as string))").alias("tag"))
    top = tags.orderBy(measures.version_order(F.col("tag")).desc(), "id").limit(50)
    return top.withColumn("rank", F.row_number().over(W.orderBy(measures.version_order(F.col("tag")).desc(), "id")).cast("long"))


@query(with_tables("refs", "SELECT CASE WHEN name LIKE 'refs/heads/%' THEN 'branch' WHEN name LIKE 'refs/tags/%' THEN 'tag' ELSE 'remote' END AS namespace, count(*) AS refs FROM refs GROUP BY 1"))
def ref_counts(s, d):
    return repo.refs(s, d).groupBy(scalar.ref_namespace(F.col("name")).alias("namespace")).agg(F.count("*").alias("refs"))


@query(with_tables("base", "SELECT path FROM base WHERE regexp_matches(path, '^dir1[^/]*/STANDARD[^/]*/.*[.]psd$') OR regexp_matches(path, '^(.*/)?7[^/]*[.]mp4$')"))
def glob_filter(s, d):
    p = F.col("path")
    return _trees(s, d)[0].where(p.rlike(scalar.glob_regex("dir1*/STANDARD*/**.psd")) | p.rlike(scalar.glob_regex("**/7*.mp4"))).select("path")


# integrity


@query(with_tables("refs", "SELECT name, target FROM refs WHERE target NOT IN (SELECT o_orderkey + 1 FROM orders)"))
def broken_refs(s, d):
    return measures.missing(repo.refs(s, d).withColumnRenamed("target", "n"), repo.commits(s, d), "n").select("name", F.col("n").alias("target"))


@query(with_tables("commits", "SELECT n, tree FROM commits WHERE tree NOT IN (SELECT 'tree:' || p_partkey FROM part WHERE p_partkey % 7 <> 0)"))
def missing_trees(s, d):
    have = repo.table(s, d, "part").where("p_partkey % 7 <> 0").select(F.concat(F.lit("tree:"), F.col("p_partkey").cast("string")).alias("tree"))
    return measures.missing(repo.commits(s, d).select("n", "tree"), have, "tree").select("n", "tree")


@query(with_tables("base ours", "SELECT path AS key, CASE WHEN o.path IS NULL THEN 'missing' WHEN b.oid <> o.oid THEN 'checksum' WHEN b.size <> o.size THEN 'size' ELSE 'ok' END AS result FROM base b LEFT JOIN ours o USING (path)"))
def migration_verify(s, d):
    a, b = (t.select(F.col("path").alias("key"), F.col("oid").alias("checksum"), "size") for t in _trees(s, d)[:2])
    return measures.verify(a, b)


@query(with_tables("refs commits", """SELECT 'ref' AS category, 'error' AS severity, count(*) AS issues FROM refs WHERE target NOT IN (SELECT n FROM commits)
  UNION ALL SELECT 'tree', 'critical', count(*) FROM commits WHERE tree NOT IN (SELECT 'tree:' || p_partkey FROM part WHERE p_partkey % 7 <> 0)"""))
def fsck_report(s, d):
    of = lambda df, c, v: df.agg(F.count("*").alias("issues")).select(F.lit(c).alias("category"), F.lit(v).alias("severity"), "issues")
    return of(broken_refs(s, d), "ref", "error").unionByName(of(missing_trees(s, d), "tree", "critical"))


STORED = "stored AS (SELECT key, size, 'tree:' || (part % 100) AS tree, split_part(key, '/', 2) AS at FROM objects), bases AS (SELECT x.key AS oid, y.key AS base FROM stored x JOIN stored y ON x.key LIKE 'deltas/%' AND y.at = split_part(x.at, '_', 1) || '_' || (CAST(split_part(x.at, '_', 2) AS INT) - 1))"
LIVE = f"{STORED}, reach AS (SELECT target AS node FROM refs WHERE name NOT LIKE 'refs/remotes/%' UNION SELECT e.parent FROM reach r JOIN edges e ON e.child = r.node), need AS (SELECT key AS oid FROM stored WHERE tree IN (SELECT tree FROM commits WHERE n IN (SELECT node FROM reach)) UNION SELECT b.base FROM need JOIN bases b ON b.oid = need.oid)"


def _dangling(s, d) -> DataFrame:
    """Objects that no branch or tag reaches, through commits, trees and the bases of deltas. An object lies in its part's tree; a delta is made from the order's line before it."""
    objects = repo.objects(s, d).select("key", "size", F.concat(F.lit("tree:"), (F.col("part") % 100).cast("string")).alias("tree"), F.substring_index("key", "/", -1).alias("at"))
    before = F.concat(F.substring_index("at", "_", 1), F.lit("_"), (F.substring_index("at", "_", -1).cast("int") - 1).cast("string"))
    bases = objects.where(F.col("key").startswith("deltas/")).select(F.col("key").alias("oid"), before.alias("at")).join(objects.select("at", F.col("key").alias("base")), "at").select("oid", "base")
    tips = repo.refs(s, d).where(~F.col("name").startswith("refs/remotes/")).select(F.col("target").alias("node"))
    live = graph.reachable_objects(tips, repo.commit_parents(s, d), repo.commits(s, d).select("n", "oid", "tree"), objects.select("tree", F.col("key").alias("oid")), bases)
    return measures.missing(objects.select("key", "size"), live.withColumnRenamed("oid", "key"), "key")


@query(with_tables("objects commits refs edges", "SELECT key FROM stored WHERE key NOT IN (SELECT oid FROM need)", LIVE))
def dangling_objects(s, d):
    return _dangling(s, d).select("key")


@query(with_tables("objects commits refs edges", "SELECT count(*) AS deleted, round(sum(size), 2) AS reclaimed FROM stored WHERE key NOT IN (SELECT oid FROM need)", LIVE))
def gc_stats(s, d):
    return _dangling(s, d).agg(F.count("*").alias("deleted"), F.round(F.sum("size"), 2).alias("reclaimed"))


# measures


@query(with_tables("objects", "SELECT CASE WHEN key LIKE 'chunks/%' THEN 'chunks' WHEN key LIKE 'deltas/%' THEN 'deltas' ELSE 'loose' END AS namespace, count(*) AS objects, round(sum(size), 2) AS bytes FROM objects GROUP BY 1"))
def storage_stats(s, d):
    return measures.storage_by_namespace(repo.objects(s, d))


@query(with_tables("objects", "SELECT part, count(*) AS ops, round(sum(size) / sum(stored), 6) AS original_to_stored, round(sum(stored) / sum(size), 6) AS stored_to_original, round((1 - sum(stored) / sum(size)) * 100, 4) AS saved_percent FROM objects GROUP BY part"))
def compression_by_part(s, d):
    return measures.compression(repo.objects(s, d), "part")


@query("SELECT event_type, user_id % 3 AS bucket, count(*) AS ops, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events GROUP BY GROUPING SETS ((event_type), (user_id % 3), ())")
def grouped_metrics(s, d):
    e = repo.events(s, d).withColumn("bucket", F.col("user_id") % 3)
    return e.groupingSets([["event_type"], ["bucket"], []], "event_type", "bucket").agg(F.count("*").alias("ops"), F.round(F.sum("value"), 2).alias("total"), F.min("value").alias("least"), F.max("value").alias("most"))


BOUNDS = [1.0, 5.0, 10.0, 25.0, 50.0, 100.0, 250.0, 500.0, 1000.0, 2500.0, 5000.0, 10000.0]


@query(f"SELECT event_type, le, count(*) FILTER (value <= le) AS cumulative FROM events CROSS JOIN (SELECT unnest([{', '.join(f'{b}::DOUBLE' for b in BOUNDS)}]) AS le) GROUP BY event_type, le")
def latency_histogram(s, d):
    return measures.histogram(repo.events(s, d), "event_type", "value", BOUNDS)


@query("SELECT event_type, user_id % 3 AS backend, json_extract_string(props, '$.k') AS status, count(*) AS n FROM events GROUP BY ALL")
def operation_counters(s, d):
    return repo.events(s, d).groupBy("event_type", (F.col("user_id") % 3).alias("backend"), F.get_json_object("props", "$.k").alias("status")).agg(F.count("*").alias("n"))


@query(with_tables("base", "SELECT CASE WHEN path LIKE '%.psd' THEN 'creative' WHEN path LIKE '%.mp4' THEN 'video' ELSE 'other' END AS category, CASE WHEN path LIKE '%.psd' OR path LIKE '%.mp4' THEN 'media' WHEN path LIKE '%.txt' THEN 'text' ELSE 'other' END AS class, count(*) AS files, CAST(sum(size) AS BIGINT) AS bytes FROM base GROUP BY ALL ORDER BY files DESC, category, class"))
def category_stats(s, d):
    path = F.col("path")
    n = _trees(s, d)[0].groupBy(filetypes.category(path).alias("category"), filetypes.file_class(path).alias("class")).agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))
    return n.orderBy(F.desc("files"), "category", "class")


@query(with_tables("ours", "SELECT sha256(string_agg(dir || ' ' || hash, chr(10) ORDER BY dir)) AS hash, CAST(sum(files) AS BIGINT) AS files, CAST(sum(executable) AS BIGINT) AS executable FROM (SELECT dir, sha256(string_agg(mode || ' ' || path || ' ' || oid, chr(10) ORDER BY path)) AS hash, count(*) AS files, count(*) FILTER (mode = '100755') AS executable FROM (SELECT *, regexp_extract(path, '^(.*)/[^/]*$', 1) AS dir FROM ours) GROUP BY dir)"))
def tree_hash(s, d):
    """Directories are hashed first, then the list of directories."""
    return measures.tree_hash(_trees(s, d)[1])


@query("SELECT min(l_quantity) AS x0, max(l_quantity) AS x1, min(l_discount) AS y0, max(l_discount) AS y1, min(l_tax) AS z0, max(l_tax) AS z1, l_partkey AS part FROM lineitem GROUP BY l_partkey")
def bounding_boxes(s, d):
    at = lambda c, n: (F.min(c).alias(n + "0"), F.max(c).alias(n + "1"))
    return repo.table(s, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(*at("l_quantity", "x"), *at("l_discount", "y"), *at("l_tax", "z"))


# content


@query(with_tables("lines", "SELECT doc_id, seq, chunk_oid, size, CAST(coalesce(sum(size + 1) OVER (PARTITION BY doc_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM lines"))
def chunk_offsets(s, d):
    return measures.offsets(repo.lines(s, d), 1)


@query(with_tables("lines", "SELECT CAST(sum(refs) AS BIGINT) AS refs, count(*) AS chunks, round(1 - count(*) / sum(refs), 6) AS by_count, round(1 - sum(size) / sum(refs * size), 6) AS by_bytes FROM (SELECT count(*) AS refs, max(size) AS size FROM lines GROUP BY chunk_oid)"))
def dedup_ratio(s, d):
    return measures.dedup_ratio(repo.lines(s, d))


@query(with_tables("lines", "SELECT chunk_oid, count(*) AS refs, count(DISTINCT doc_id) AS blobs FROM lines GROUP BY chunk_oid"))
def chunk_refcounts(s, d):
    return measures.chunk_references(repo.lines(s, d))


@query(with_tables("lines", "SELECT doc_id, count(*) AS chunks, CAST(sum(size) AS BIGINT) AS bytes FROM lines GROUP BY doc_id"))
def manifest_totals(s, d):
    return repo.lines(s, d).groupBy("doc_id").agg(F.count("*").alias("chunks"), F.sum("size").alias("bytes"))


@query("SELECT doc_id, sha256(coalesce(text, '')) AS restored FROM documents")
def chunk_round_trip(s, d):
    cut = repo.table(s, d, "documents").select("doc_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("seq", "line"))
    return cut.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("seq", "line"))).alias("x")).select("doc_id", F.sha2(F.array_join("x.line", "\n"), 256).alias("restored"))


@query("SELECT page_id, k AS seq, k * 1000 AS \"offset\", length(part) // 2 AS size, sha256(unhex(part)) AS oid FROM (SELECT page_id, k, substr(x, k * 2000 + 1, 2000) AS part FROM (SELECT page_id, x, unnest(range((length(x) + 1999) // 2000)) AS k FROM (SELECT page_id, hex(encode(html)) AS x FROM pages)))")
def fixed_chunks(s, d):
    return content.fixed_chunks(repo.table(s, d, "pages"), "page_id", "html", 1000)


@query()
def content_chunks(s, d):
    return content.content_chunks(repo.table(s, d, "documents"), "doc_id", "text", 256, 1024, 8192)


@query()
def similar_bases(s, d):
    docs = repo.table(s, d, "documents").select(F.col("doc_id").alias("id"), F.col("lang").alias("type"), F.octet_length("text").cast("long").alias("size"), content.sample_hashes(F.col("text").cast("binary")).alias("samples"))
    return content.best_bases(docs)


@query()
def delta_sizes(s, d):
    docs = repo.table(s, d, "documents").select("doc_id", F.col("text").cast("binary").alias("x"))
    pairs = similar_bases(s, d).select("id", "base").join(docs.select(F.col("doc_id").alias("id"), "x"), "id").join(docs.select(F.col("doc_id").alias("base"), F.col("x").alias("b")), "base")
    made = pairs.select("id", "base", "x", "b", content.zstd_delta("x", "b").alias("delta"))
    ratio = F.octet_length("delta") / F.greatest(F.lit(1), F.octet_length("x"))
    return made.select("id", "base", F.round(ratio, 4).alias("ratio"), (content.zstd_undelta("delta", "b") == F.col("x")).alias("restored")).where("ratio < 0.8")


@query("SELECT doc_id, round(log2(sum(n)) - sum(n * log2(n)) / sum(n), 6) AS bits FROM (SELECT doc_id, c, count(*) AS n FROM (SELECT doc_id, unnest(regexp_extract_all(substr(hex(encode(text)), 1, 8192), '(..)', 1)) AS c FROM documents) GROUP BY ALL) GROUP BY doc_id")
def byte_entropy(s, d):
    return content.byte_entropy(repo.table(s, d, "documents"), "doc_id", "text")


@query("WITH h AS (SELECT vec_id, array_to_string(list_transform(embedding, lambda x: CASE WHEN x > 0 THEN '1' ELSE '0' END), '') AS bits FROM embeddings), c AS (SELECT bits, CAST(bits AS BIT) AS x, min(vec_id) AS id FROM h GROUP BY bits) SELECT c.id AS a, e.id AS b, 1 - bit_count(xor(c.x, e.x)) / 64.0 AS similarity FROM c JOIN c e ON c.id < e.id WHERE 1 - bit_count(xor(c.x, e.x)) / 64.0 >= 0.85 UNION ALL SELECT c.id, h.vec_id, 1.0 FROM h JOIN c USING (bits) WHERE h.vec_id > c.id")
def perceptual_matches(s, d):
    return hash_matches(repo.table(s, d, "embeddings").select(F.col("vec_id").alias("id"), sign_hash(F.col("embedding")).alias("hash")))


@query(with_tables("base", "SELECT path, 'objects/' || substr(oid, 1, 2) || '/' || substr(oid, 3, 2) || '/' || oid AS stored_at, CASE WHEN size <= 1024 THEN 'tiny' WHEN size <= 102400 THEN 'small' ELSE 'medium' END AS class FROM base"))
def shard_paths(s, d):
    return _trees(s, d)[0].select("path", scalar.shard_path(F.col("oid")).alias("stored_at"), filetypes.size_class(F.col("size")).alias("class"))


# streams


@query("SELECT time_bucket(INTERVAL 10 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY ALL")
def audit_windows(s, d):
    return logs.drained(logs.per_window(logs.event_stream(s, d)), "start", "event_type")


@query("SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY event_type")
def stream_totals(s, d):
    return logs.drained(logs.running(logs.event_stream(s, d)), "event_type")


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, user_id, count(*) AS n FROM events GROUP BY ALL HAVING count(*) > 1")
def rate_limit(s, d):
    return logs.drained(logs.over_limit(logs.event_stream(s, d), 1, "1 hour"), "start", "user_id")


@query("SELECT user_id AS ref, count(*) AS entries, max_by(event_id, (ts, event_id)) AS id FROM events GROUP BY user_id")
def reflog_stream(s, d):
    """The newest entry of each ref of a growing log."""
    log = logs.event_stream(s, d).select(F.col("user_id").alias("ref"), F.col("event_id").alias("id"), "ts")
    return logs.drained(logs.newest(log, "ts", "id"), "ref")


@query("SELECT w.event_id AS request, w.user_id AS want FROM events w JOIN events t ON t.event_id - 3 = w.event_id AND w.event_type IN ('view', 'click') AND t.event_type IN ('signup', 'error') AND t.ts >= w.ts AND t.ts <= w.ts + INTERVAL 10 MINUTE")
def wants_answered(s, d):
    """Requests of a stream that another one answers within ten minutes."""
    wants = logs.event_stream(s, d).where("event_type IN ('view', 'click')").select(F.col("event_id").alias("request"), "ts", F.col("user_id").alias("want"))
    takes = logs.event_stream(s, d).where("event_type IN ('signup', 'error')").select((F.col("event_id") - 3).alias("request"), "ts")
    return logs.drained(logs.answered(wants, takes), "request", "want", mode="append")
