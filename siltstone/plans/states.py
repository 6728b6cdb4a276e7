"""Queries over logs of commands and over states between calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import states
from ..sources import repository as repo
from ..sources.repository import with_tables
from .registry import query

_STASH = "CASE WHEN event_type IN ('view', 'click') THEN 'save' WHEN event_type = 'signup' THEN 'pop' WHEN event_type = 'purchase' THEN 'drop' WHEN event_id % 5 = 0 THEN 'clear' ELSE 'apply' END"


@query(f"""WITH RECURSIVE ops AS (SELECT user_id, event_id, {_STASH} AS op, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events),
  st AS (SELECT DISTINCT user_id, CAST(0 AS BIGINT) AS k, CAST([] AS BIGINT[]) AS l FROM ops
    UNION ALL SELECT s.user_id, o.k, CASE o.op WHEN 'save' THEN list_prepend(o.event_id, s.l) WHEN 'pop' THEN s.l[2:] WHEN 'drop' THEN s.l[2:] WHEN 'clear' THEN [] ELSE s.l END FROM st s JOIN ops o ON o.user_id = s.user_id AND o.k = s.k + 1)
  SELECT repo, i - 1 AS pos, l[i] AS id FROM (SELECT user_id AS repo, l, unnest(range(1, len(l) + 1)) AS i FROM (SELECT user_id, arg_max(l, k) AS l FROM st GROUP BY user_id))""")
def stash_lists(s, d):
    """Every user's commands, as the list that they leave."""
    return states.stash_lists(repo.events(s, d).selectExpr("user_id AS repo", "event_id AS seq", f"{_STASH} AS op", "event_id AS id"))


_BISECT = "CASE event_type WHEN 'view' THEN 'good' WHEN 'click' THEN 'bad' WHEN 'signup' THEN 'skip' WHEN 'purchase' THEN CASE WHEN event_id % 4 = 0 THEN 'start' ELSE 'good' END ELSE CASE WHEN event_id % 9 = 0 THEN 'reset' ELSE 'bad' END END"


@query(f"""WITH l AS (SELECT user_id AS session, event_id AS seq, {_BISECT} AS op, event_id % 20 AS commit FROM events)
  SELECT DISTINCT session, CASE op WHEN 'start' THEN 'bad' ELSE op END AS mark, commit FROM l x WHERE op <> 'reset'
    AND NOT EXISTS (SELECT 1 FROM l y WHERE y.session = x.session AND y.op IN ('start', 'reset') AND y.seq > x.seq)
    AND EXISTS (SELECT 1 FROM l z WHERE z.session = x.session AND z.op = 'start' AND z.seq <= x.seq AND NOT EXISTS (SELECT 1 FROM l y WHERE y.session = x.session AND y.op = 'reset' AND y.seq > z.seq))""")
def bisect_marks(s, d):
    return states.bisect_marks(repo.events(s, d).selectExpr("user_id AS session", "event_id AS seq", f"{_BISECT} AS op", "event_id % 20 AS commit"))


_REBASE = "CASE event_type WHEN 'view' THEN 'continue' WHEN 'click' THEN 'skip' WHEN 'signup' THEN CASE WHEN event_id % 7 = 0 THEN 'abort' ELSE 'continue' END WHEN 'purchase' THEN CASE WHEN event_id % 3 = 0 THEN 'start' ELSE 'show' END ELSE 'show' END"


@query(f"""WITH l AS (SELECT user_id AS session, event_id AS seq, {_REBASE} AS op, event_id % 12 + 1 AS steps FROM events),
  b AS (SELECT session, max_by(op, seq) AS op, max(seq) AS began FROM l WHERE op IN ('start', 'abort') GROUP BY session),
  o AS (SELECT b.session, began, steps FROM b JOIN l ON l.session = b.session AND l.seq = began WHERE b.op = 'start'),
  m AS (SELECT o.session, l.op, row_number() OVER (PARTITION BY o.session ORDER BY l.seq) AS n FROM o JOIN l ON l.session = o.session AND l.seq > began WHERE l.op IN ('continue', 'skip'))
  SELECT o.session, steps, least(steps, count(m.n)) AS done, count(*) FILTER (m.op = 'skip' AND m.n <= steps) AS skipped, count(m.n) >= steps AS finished FROM o LEFT JOIN m USING (session) GROUP BY o.session, steps""")
def rebase_progress(s, d):
    return states.rebase_progress(repo.events(s, d).selectExpr("user_id AS session", "event_id AS seq", f"{_REBASE} AS op", "event_id % 12 + 1 AS steps"))


@query("""WITH o AS (SELECT o_orderkey % 25 AS run, o_orderkey AS key FROM orders), r AS (SELECT l_orderkey % 25 AS run, l_orderkey AS key, l_linenumber % 3 <> 0 AS ok FROM lineitem WHERE l_orderkey % 25 <> 7)
  SELECT run, total, coalesce(migrated, 0) AS migrated, coalesce(failed, 0) AS failed, total - coalesce(migrated, 0) AS remaining, round(coalesce(migrated, 0) / total, 6) AS progress
  FROM (SELECT run, count(*) AS total FROM o GROUP BY run) LEFT JOIN (SELECT run, count(DISTINCT key) FILTER (ok) AS migrated, count(*) FILTER (NOT ok) AS failed FROM r GROUP BY run) USING (run)""")
def migration_progress(s, d):
    """Orders as objects, lines as tries to migrate them; one run has made none."""
    o = repo.table(s, d, "orders").selectExpr("o_orderkey % 25 AS run", "o_orderkey AS key")
    r = repo.table(s, d, "lineitem").where("l_orderkey % 25 <> 7").selectExpr("l_orderkey % 25 AS run", "l_orderkey AS key", "l_linenumber % 3 <> 0 AS ok")
    return states.migration_progress(o, r)


_ROLE = "CASE user_id % 4 WHEN 0 THEN 'read' WHEN 1 THEN 'write' WHEN 2 THEN 'admin' ELSE 'guest' END"
_NEED = ("CASE WHEN event_id % 3 = 0 THEN 'repo:write' ELSE 'repo:read' END", "CASE WHEN event_id % 5 = 0 THEN 'user:manage' ELSE 'repo:read' END")


@query(f"""WITH p(role, need) AS (VALUES ('read', 'repo:read'), ('write', 'repo:read'), ('write', 'repo:write'), ('admin', 'repo:read'), ('admin', 'repo:write'), ('admin', 'repo:admin'), ('admin', 'user:manage')),
  r AS (SELECT event_id, {_ROLE} AS role, {_NEED[0]} AS a, {_NEED[1]} AS b FROM events), c AS (SELECT event_id, (role, a) IN (SELECT (role, need) FROM p) AS x, (role, b) IN (SELECT (role, need) FROM p) AS y FROM r)
  SELECT event_id, x OR y AS any_of, x AND y AS all_of FROM c""")
def granted_requests(s, d):
    r = repo.events(s, d).selectExpr("event_id", f"{_ROLE} AS role", f"array({', '.join(_NEED)}) AS needs")
    return states.granted(r).select("event_id", "any_of", "all_of")


_BRANCHES = {"branch": "CASE p_partkey % 3 WHEN 0 THEN 'b' || (p_partkey % 40) WHEN 1 THEN 'main' ELSE 'n..' || p_partkey END", "to": "CASE p_partkey % 4 WHEN 0 THEN 'b' || (p_partkey % 50) WHEN 1 THEN 'free' || p_partkey ELSE 'a.lock' END", "op": "CASE p_size % 4 WHEN 0 THEN 'create' WHEN 1 THEN 'delete' WHEN 2 THEN 'rename' ELSE 'switch' END", "force": "p_size % 8 < 4"}


@query(f"""WITH h AS (SELECT 'b' || s_suppkey AS branch FROM supplier WHERE s_suppkey % 2 = 0 UNION ALL SELECT 'main'), q AS (SELECT p_partkey AS id, {', '.join(f'{v} AS "{k}"' for k, v in _BRANCHES.items())} FROM part),
  x AS (SELECT *, branch IN (SELECT branch FROM h) AS there, "to" IN (SELECT branch FROM h) AS taken FROM q)
  SELECT id, CASE op WHEN 'create' THEN CASE WHEN contains(branch, '..') THEN 'invalid' WHEN there THEN 'exists' ELSE 'ok' END
    WHEN 'rename' THEN CASE WHEN ends_with("to", '.lock') THEN 'invalid' WHEN NOT there THEN 'missing' WHEN taken THEN 'exists' ELSE 'ok' END
    WHEN 'delete' THEN CASE WHEN NOT there THEN 'missing' WHEN branch = 'main' THEN 'current' WHEN branch IN ('b0', 'b6', 'b12', 'b18', 'b24') AND NOT force THEN 'protected' ELSE 'ok' END
    ELSE CASE WHEN there THEN 'ok' ELSE 'missing' END END AS result FROM x""")
def branch_requests(s, d):
    heads = repo.table(s, d, "supplier").where("s_suppkey % 2 = 0").selectExpr("concat('refs/heads/b', s_suppkey) AS name", "s_suppkey AS target").unionByName(s.range(1).selectExpr("'refs/heads/main' AS name", "id AS target"))
    protected = s.createDataFrame([(f"b{n}",) for n in range(0, 30, 6)], "branch string")
    return states.branch_results(heads, repo.table(s, d, "part").selectExpr("p_partkey AS id", *(f"{v} AS {k}" for k, v in _BRANCHES.items())), "main", protected)


@query("""WITH w AS (SELECT c_custkey AS id, n_regionkey, n_nationkey, r_name, n_name, c_name FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)
  SELECT id, CASE id % 4 WHEN 1 THEN 'n' || n_nationkey WHEN 2 THEN 'r' || n_regionkey ELSE sha256('file:' || id) END AS oid, id % 4 IN (1, 2) AS is_dir FROM w WHERE id % 4 <> 3""")
def path_lookup(s, d):
    """Files, directories and paths that aren't there, looked up in nested trees."""
    r, n, c = (repo.table(s, d, x) for x in ("region", "nation", "customer"))
    of = lambda df, tree, name, oid, is_dir: df.selectExpr(f"{tree} AS tree", f"{name} AS name", f"{oid} AS oid", f"{is_dir} AS is_dir")
    entries = of(r, "'root'", "r_name", "concat('r', r_regionkey)", "true").unionByName(of(n, "concat('r', n_regionkey)", "n_name", "concat('n', n_nationkey)", "true")).unionByName(of(c, "concat('n', c_nationkey)", "c_name", "sha2(concat('file:', c_custkey), 256)", "false"))
    named = c.join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).join(F.broadcast(r), F.col("n_regionkey") == F.col("r_regionkey"))
    path = "CASE c_custkey % 4 WHEN 0 THEN concat_ws('/', r_name, n_name, c_name) WHEN 1 THEN concat_ws('/', r_name, n_name) WHEN 2 THEN concat('/', r_name, '//') ELSE concat_ws('/', r_name, n_name, c_name, 'x') END"
    return states.entries_at(entries, named.selectExpr("c_custkey AS id", "'root' AS root", f"{path} AS path"))


@query(with_tables("ours theirs", "SELECT path, oid FROM theirs UNION ALL SELECT path, oid FROM ours WHERE path NOT IN (SELECT path FROM theirs)"))
def overlay_checkout(s, d):
    ours, theirs = (repo.tree(s, d, x).select("path", "oid") for x in ("ours", "theirs"))
    return states.overlaid(ours, theirs)
