"""Queries over paths, files, objects and text formats."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import measures
from ..sources import repository as repo
from ..sources.repository import with_tables
from .registry import query


@query(with_tables("base", "SELECT path FROM base WHERE regexp_matches(path, '^dir1/') OR regexp_matches(path, '^(.*/)?STANDARD[^/]*/') OR (regexp_matches(path, '[.]psd$') AND NOT regexp_matches(path, '/4[^/]*[.]psd$'))"))
def ignored_files(s, d):
    t = repo.tree(s, d, "base")
    return t.where(scalar.ignored(F.col("path"), ["# rules", "/dir1", "*.psd", "!4*.psd", "STANDARD*/"])).select("path")


@query(with_tables("base theirs", "SELECT path FROM theirs t WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.path = t.path AND b.size = t.size AND b.mode = t.mode)"))
def stat_cache_misses(s, d):
    """Files to hash again: those without an equal record of the last look."""
    return repo.tree(s, d, "theirs").join(repo.tree(s, d, "base"), ["path", "size", "mode"], "left_anti").select("path")


@query(with_tables("base", "SELECT path, oid, CASE WHEN size % 7 <> 0 THEN size END AS size FROM base"))
def pointer_files(s, d):
    """Files written as pointers and read back; text that isn't a pointer gives null, but the path's id is known."""
    t = repo.tree(s, d, "base")
    text = F.when(F.col("size") % 7 != 0, scalar.pointer("https://example.org/pointer/v1", F.col("oid"), F.col("size"))).otherwise("some text\nof two lines")
    return t.withColumn("p", scalar.parse_pointer(text)).select("path", F.coalesce("p.oid", "oid").alias("oid"), F.col("p.size").alias("size"))


@query(with_tables("commits edges", "SELECT c.oid AS new, p.oid AS old, c.author AS name, c.email, CAST(epoch(CAST(c.ts AS TIMESTAMP)) AS BIGINT) AS seconds, replace(c.message, chr(10), ' ') AS message FROM commits c JOIN edges ON child = c.n AND pos = 0 JOIN commits p ON p.n = parent"))
def reflog_lines(s, d):
    """Reflog entries written as lines and read back."""
    c = repo.commits(s, d)
    first = repo.commit_parents(s, d).where("pos = 0").select(F.col("child").alias("n"), "parent")
    old = c.select(F.col("n").alias("parent"), F.col("oid").alias("old"))
    line = scalar.reflog_line(F.col("old"), F.col("oid"), F.col("author"), F.col("email"), F.unix_timestamp(F.col("ts").cast("timestamp")), F.col("message"))
    return c.join(first, "n").join(old, "parent").select(scalar.parse_reflog(line).alias("x")).select("x.*")


@query("SELECT p_partkey AS id, CASE WHEN n < 1024 THEN n || ' bytes' WHEN n < 1048576 THEN printf('%.2f KB', n / 1024.0) WHEN n < 1073741824 THEN printf('%.2f MB', n / 1048576.0) ELSE printf('%.2f GB', n / 1073741824.0) END AS human FROM (SELECT p_partkey, CAST(p_size AS BIGINT) * p_size * p_size * (p_partkey % 10) * (p_partkey % 10) * (p_partkey % 10) * 32 AS n FROM part)")
def human_sizes(s, d):
    n = F.expr("cast(p_size as bigint) * p_size * p_size * (p_partkey % 10) * (p_partkey % 10) * (p_partkey % 10) * 32")
    return repo.table(s, d, "part").select(F.col("p_partkey").alias("id"), scalar.human_bytes(n).alias("human"))


@query("SELECT event_id, CASE WHEN a < 60 THEN a || ' seconds' WHEN a < 3600 THEN (a // 60) || ' minutes' WHEN a < 86400 THEN (a // 3600) || ' hours' ELSE (a // 86400) || ' days' END || ' ago' AS age FROM (SELECT event_id, (event_id * 97) % 600000 AS a FROM events)")
def ages(s, d):
    return repo.events(s, d).select("event_id", scalar.time_ago((F.col("event_id") * 97) % 600000).alias("age"))


#: Names beside the refs', some of which are refused.
ASKED = ["HEAD", "a..b", "x.lock", "a@{1}", "feature/one", "/a", "a b", "a~1", "x/.y", "a|b", "a<b", 'a"b', "a*", ".a", "a.", "a//b", "a/"]
VALUES = ", ".join(f"('{x}')" for x in ASKED)


@query(with_tables("refs", f"""SELECT name, CASE WHEN name = 'HEAD' OR name LIKE 'refs/%' THEN name ELSE 'refs/heads/' || name END AS full_name,
  len(list_filter(['\\', ':', '?', '*', '"', '<', '>', '|', '..', '//', '@{{'], lambda x: contains(name, x))) = 0 AND name[1] NOT IN ('.', '/') AND name[-1] NOT IN ('.', '/') AND NOT ends_with(name, '.lock') AS valid
  FROM (SELECT name FROM refs UNION ALL SELECT * FROM (VALUES {VALUES}))"""))
def ref_names(s, d):
    more = s.range(1).select(F.explode(F.array(*map(F.lit, ASKED))).alias("name"))
    return repo.refs(s, d).select("name").unionByName(more).select("name", scalar.full_ref(F.col("name")).alias("full_name"), scalar.valid_ref_name(F.col("name")).alias("valid"))


@query(with_tables("base", "SELECT path || tail AS path, safe FROM base, (VALUES ('', true), ('/../x', false), ('/..x', true)) v(tail, safe)"))
def safe_paths(s, d):
    tails = F.explode(F.array(*(F.lit(x) for x in ("", "/../x", "/..x"))))
    t = repo.tree(s, d, "base").select(F.col("path").alias("p"), tails.alias("tail")).select(F.concat("p", "tail").alias("path"))
    return t.select("path", scalar.safe_path(F.col("path")).alias("safe"))


# objects


@query(with_tables("ours base", "SELECT DISTINCT oid FROM ours WHERE oid NOT IN (SELECT oid FROM base)"))
def dedup_put(s, d):
    return measures.first_copies(repo.tree(s, d, "ours"), repo.tree(s, d, "base")).select("oid")


@query(with_tables("base ours theirs", "SELECT path, CASE WHEN oid IN (SELECT oid FROM ours WHERE path LIKE 'dir1%') THEN 'cache' WHEN oid IN (SELECT oid FROM ours) THEN 'loose' WHEN oid IN (SELECT oid FROM theirs) THEN 'pack' END AS place FROM base"))
def object_places(s, d):
    base, ours, theirs = (repo.tree(s, d, x) for x in ("base", "ours", "theirs"))
    return measures.located(base.select("path", "oid"), {"cache": ours.where(F.col("path").startswith("dir1")), "loose": ours, "pack": theirs}).select("path", "place")


@query(with_tables("lines", "SELECT DISTINCT chunk_oid FROM lines WHERE chunk_oid NOT IN (SELECT chunk_oid FROM lines WHERE doc_id % 3 <> 0)"))
def orphan_chunks(s, d):
    """Chunks of which no reachable manifest has a reference."""
    lines = repo.lines(s, d).select("doc_id", "chunk_oid")
    return measures.missing(lines.select("chunk_oid").distinct(), lines.where("doc_id % 3 <> 0"), "chunk_oid")


@query(with_tables("base", "SELECT count(*) AS objects, CAST(sum(size) AS BIGINT) AS bytes, count(*) AS ends FROM base"))
def pack_totals(s, d):
    """An index of packs: every object lies in one pack, right after the one before it."""
    x = measures.pack_index(repo.tree(s, d, "base").select("oid", F.col("size").alias("stored")), 16)
    per = x.groupBy("pack").agg(F.count("*").alias("n"), F.sum("stored").alias("bytes"), F.max(F.col("offset") + F.col("stored")).alias("end"), F.countDistinct("offset").alias("at"))
    return per.agg(F.sum("n").alias("objects"), F.sum("end").alias("bytes"), F.sum("at").alias("ends"))


# reports


@query("SELECT 'operations_total{type=\"' || event_type || '\",backend=\"' || (user_id % 3) || '\"} ' || count(*) AS line FROM events GROUP BY event_type, user_id % 3")
def prometheus_lines(s, d):
    n = repo.events(s, d).groupBy(F.col("event_type").alias("type"), (F.col("user_id") % 3).alias("backend")).agg(F.count("*").alias("n"))
    return measures.prometheus(n, "operations_total", ["type", "backend"], "n")


@query("SELECT '{\"type\":\"' || event_type || '\",\"operations\":' || count(*) || ',\"users\":' || count(DISTINCT user_id) || '}' AS json FROM events GROUP BY event_type")
def json_report(s, d):
    n = repo.events(s, d).groupBy(F.col("event_type").alias("type")).agg(F.count("*").alias("operations"), F.countDistinct("user_id").alias("users"))
    return n.select(F.to_json(F.struct("type", "operations", "users")).alias("json"))


@query("SELECT user_id % 3 AS backend, max_by(value, (ts, event_id)) AS last FROM events GROUP BY 1")
def throughput_gauge(s, d):
    return repo.events(s, d).groupBy((F.col("user_id") % 3).alias("backend")).agg(F.max_by("value", F.struct("ts", "event_id")).alias("last"))


@query("SELECT event_type, round(avg(CASE WHEN value < 50 THEN 1.0 ELSE 0.0 END), 6) AS hit_rate FROM events GROUP BY event_type")
def cache_hit_rate(s, d):
    return repo.events(s, d).groupBy("event_type").agg(F.round(F.avg((F.col("value") < 50).cast("double")), 6).alias("hit_rate"))


@query("SELECT user_id, event_id, round(sum(value) OVER w, 2) AS running, count(*) OVER w AS seen FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)")
def running_gauges(s, d):
    from pyspark.sql import Window as W

    w = W.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(W.unboundedPreceding, 0)
    return repo.events(s, d).select("user_id", "event_id", F.round(F.sum("value").over(w), 2).alias("running"), F.count("*").over(w).alias("seen"))


@query("WITH p AS (SELECT l_orderkey AS key, l_linenumber * 20 AS lo, l_linenumber * 20 + l_quantity AS hi FROM lineitem), x AS (SELECT key, lo, max(hi) OVER (PARTITION BY key ORDER BY lo, hi ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS \"end\" FROM p) SELECT key, \"end\" AS lo, CAST(lo AS DOUBLE) AS hi FROM x WHERE lo > \"end\"")
def coverage_gaps(s, d):
    p = repo.table(s, d, "lineitem").select(F.col("l_orderkey").alias("key"), (F.col("l_linenumber") * 20).cast("double").alias("lo"), (F.col("l_linenumber") * 20 + F.col("l_quantity")).cast("double").alias("hi"))
    return measures.uncovered(p, "key")


@query(with_tables("base ours", "SELECT result, count(*) AS n FROM (SELECT CASE WHEN o.path IS NULL THEN 'missing' WHEN b.oid <> o.oid THEN 'checksum' WHEN b.size <> o.size THEN 'size' ELSE 'ok' END AS result FROM base b LEFT JOIN ours o USING (path)) GROUP BY result"))
def verification_report(s, d):
    a, b = (repo.tree(s, d, x).select(F.col("path").alias("key"), F.col("oid").alias("checksum"), "size") for x in ("base", "ours"))
    return measures.verify(a, b).groupBy("result").agg(F.count("*").alias("n"))
