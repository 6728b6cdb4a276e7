import random

from siltstone.operators import graph


def random_history(rng, n):
    edges = [(i, rng.randint(max(1, i - 6), i - 1), 0) for i in range(2, n)]
    return edges + [(i, rng.randint(1, i - 1), 1) for i in range(3, n) if rng.random() < 0.3]


def reach(edges, starts):
    up, depth, front = {}, {s: 0 for s in starts}, list(starts)
    for c, p, _ in edges:
        up.setdefault(c, set()).add(p)
    while front:
        new = []
        for x in front:
            for p in up.get(x, ()):
                if p not in depth:
                    depth[p] = depth[x] + 1
                    new.append(p)
        front = new
    return depth


def test_closure_and_merge_bases(spark):
    rng = random.Random(5)
    edges = random_history(rng, 200)
    df = spark.createDataFrame(edges, "child long, parent long, pos int")
    starts = spark.createDataFrame([(150,), (199,)], "start long")
    got = {(r.start, r.node): r.depth for r in graph.closure(df, starts).collect()}
    assert got == {(s, n): d for s in (150, 199) for n, d in reach(edges, [s]).items()}
    assert {r.node for r in graph.closure(df, starts.limit(1), 3).collect()} == {n for n, d in reach(edges, [150]).items() if d <= 3}
    a, b = reach(edges, [190]), reach(edges, [197])
    common = set(a) & set(b)
    best = {n for n in common if not any(n != m and n in reach(edges, [m]) for m in common)}
    rows = graph.merge_bases(df, 190, 197).collect()
    assert {(r.node, r.depth_a, r.depth_b) for r in rows} == {(n, a[n], b[n]) for n in best} and {r.criss_cross for r in rows} == {len(best) > 1}
    new = set(reach(edges, [199, 180])) - set(reach(edges, [170, 60]))
    of = lambda *x: spark.createDataFrame([(i,) for i in x], "start long")
    assert {r.node for r in graph.negotiate(df, of(199, 180), of(170, 60)).collect()} == new
    other = spark.createDataFrame([(2, 1, 0), (4, 3, 0)], "child long, parent long, pos int")
    assert graph.merge_bases(other, 2, 4).count() == 0


def test_deep_history(spark):
    chain = spark.range(2, 3000).selectExpr("id AS child", "id - 1 AS parent", "0 AS pos")
    walk = {r.node: r.depth for r in graph.first_parents(chain, 2999).collect()}
    assert walk == {n: 2999 - n for n in range(1, 3000)}
    assert [r.node for r in graph.nth_first_parent(chain, 2999, 1000).collect()] == [1999]
    assert graph.nth_first_parent(chain, 10, 10).count() == 0
    assert [(r.node, r.left) for r in graph.bisect_next(chain, 100, [50]).collect()] == [(75, 49)] or [r.left for r in graph.bisect_next(chain, 100, [50]).collect()] == [49]


def test_rebase_range(spark):
    edges = spark.createDataFrame([(2, 1, 0), (3, 2, 0), (4, 3, 0), (12, 2, 0), (13, 12, 0)], "child long, parent long, pos int")
    assert sorted((r.step, r.node) for r in graph.rebase_range(edges, 13, 4).collect()) == [(0, 3), (1, 4)]
    assert graph.rebase_range(edges, 4, 3).count() == 0


def test_reachable_objects(spark):
    commits = spark.createDataFrame([(1, "c1", "t1"), (2, "c2", "t2"), (3, "c3", "t3")], "n long, oid string, tree string")
    edges = spark.createDataFrame([(2, 1, 0)], "child long, parent long, pos int")
    entries = spark.createDataFrame([("t1", "b1"), ("t2", "b1"), ("t2", "sub"), ("sub", "b2"), ("t3", "b3")], "tree string, oid string")
    bases = spark.createDataFrame([("b2", "b9"), ("b9", "b8"), ("b3", "b7")], "oid string, base string")
    refs = spark.createDataFrame([(2,)], "node long")
    assert {r.oid for r in graph.reachable_objects(refs, edges, commits, entries, bases).collect()} == {"c1", "c2", "t1", "t2", "sub", "b1", "b2", "b9", "b8"}
