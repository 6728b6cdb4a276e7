import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from siltstone.llm import linededup, simhash
from siltstone.llm.components import components

from . import data


def groups(nodes, links):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randint(0, 400), rng.randint(0, 400)) for _ in range(260)] + [(1000 + i, 1001 + i) for i in range(60)] + [(5000, 5001 + i) for i in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "u long, v long")).collect()}
    want = groups({x for e in links for x in e}, links)
    assert got == {k: v for k, v in want.items() if k in got}
    assert set(got) == {x for a, b in links if a != b for x in (a, b)}
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0


def brute_fingerprint(text):
    words = (text or "").encode().translate(bytes(c + 32 if 65 <= c <= 90 else c for c in range(256)))
    words = [w for w in __import__("re").split(rb"[\x20\x09-\x0d]+", words) if w]
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints():
    texts = [r[1] or "" for r in data.rows()]
    assert simhash.fingerprints(texts).tolist() == [brute_fingerprint(t) for t in texts]


def test_golay_neighbours():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 1 << 23, 300)
    near, has = simhash.nearby(words)
    assert set(has.sum(1).tolist()) <= {1, 6}
    for w, n, h in zip(words.tolist(), near, has, strict=True):
        mine = set(n[h].tolist())
        for k in (1, 2):
            for bits in rng.permuted(np.tile(np.arange(23), (20, 1)), axis=1)[:, :k]:
                other, there = simhash.nearby(np.array([w ^ sum(1 << int(b) for b in bits)]))
                assert mine & set(other[0][there[0]].tolist())


def test_links_lose_none(spark):
    rng = np.random.default_rng(3)
    fps = {0, (1 << 64) - 1}
    for _ in range(60):
        x = int(rng.integers(0, 1 << 63)) * 2 + 1
        fps.add(x)
        for k in range(1, 8):
            for _ in range(3):
                fps.add(x ^ sum(1 << int(b) for b in rng.choice(64, k, replace=False)))
    signed = sorted(np.array(sorted(fps), np.uint64).view(np.int64).tolist())
    got = {(r.u, r.v) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()}
    assert got == {(a, b) for a, b in combinations(signed, 2) if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4}
    assert len(got) > 500


def joins(df):
    """The joins of the plan that has run."""
    df.collect()
    return set(re.findall(r"\w+Join\b", df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]))


def test_keys_do_not_pass_through_the_driver(spark):
    fps = simhash.written(spark.range(3000).select(F.xxhash64(F.expr("id div 2")).bitwiseXOR(F.col("id") % 2).alias("fp")), "fps")
    assert int(spark.conf.get("spark.sql.autoBroadcastJoinThreshold").removesuffix("b")) >= 10 << 20  # far more than Spark takes the keys for
    assert joins(simhash.links(fps)) == {"SortMergeJoin"}


def broadcasts(spark, run):
    """Rows of each broadcast while run() went on."""
    store = spark._jsparkSession.sharedState().statusStore()
    since = store.executionsCount()
    run()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    out, done = [], store.executionsList()
    for i in range(since, done.size()):
        k = done.apply(i).executionId()
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(j) for j in range(nodes.size())):
            if node.name().startswith("BroadcastExchange"):
                own = {node.metrics().apply(m).name(): node.metrics().apply(m).accumulatorId() for m in range(node.metrics().size())}
                found = values.get(own["number of output rows"])
                out += [int(found.get().replace(",", ""))] if found.isDefined() else []
    return out


def test_broadcasts_have_a_row_a_document_at_most(spark):
    rng = random.Random(12)
    docs = simhash.written(spark.createDataFrame([(i, data.prose(rng, 12)) for i in range(1500)], "doc_id long, text string"), "docs")
    assert max([0, *broadcasts(spark, lambda: simhash.near_duplicates(docs).collect())]) <= 1500
    assert max(broadcasts(spark, lambda: simhash.one_of_each(docs).collect())) <= 1500


def test_only_few_rows_pass_through_the_driver(spark, monkeypatch):
    rng = random.Random(13)
    texts = [data.prose(rng, 300) for _ in range(60)]
    docs = simhash.written(spark.createDataFrame([(i, f"{texts[i % 60]} {i // 120}") for i in range(1500)], "doc_id long, text string"), "docs")
    got = []
    plain = broadcasts(spark, lambda: got.append(sorted(simhash.near_duplicates(docs).collect())))
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 100)
    monkeypatch.setattr("siltstone.llm.components.BROADCAST_LINKS", 50)
    few = broadcasts(spark, lambda: got.append(sorted(simhash.near_duplicates(docs).collect())))
    assert max(plain) > 100 >= max([0, *few])
    assert got[0] == got[1] and len({r.component_id for r in got[1]}) < len({r.fingerprint for r in got[1]}) < 1500
    docs = docs.withColumn("text", F.lit("the same words"))  # one fingerprint: its documents must not be the smaller side
    assert max(broadcasts(spark, lambda: simhash.near_duplicates(docs).collect())) <= 100


def test_kept_rows_pass_through_the_driver_if_few(spark, monkeypatch):
    docs = data.table(spark)
    few = simhash.one_of_each(docs)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", 10)
    many = simhash.one_of_each(docs)
    assert joins(few) == {"BroadcastHashJoin"} and joins(many) == {"SortMergeJoin"}
    assert sorted(map(str, few.collect())) == sorted(map(str, many.collect()))


def test_near_duplicates(spark):
    rows = data.rows()
    got = simhash.near_duplicates(data.table(spark)).collect()
    fp = [brute_fingerprint(r[1]) for r in rows]
    links = [(a, b) for a, b in combinations(sorted(set(fp)), 2) if bin(a ^ b).count("1") <= 4]
    root = groups(set(fp), links)
    least = {}
    for r, f in zip(rows, fp, strict=True):
        if r[0] is not None:
            least[root[f]] = min(least.get(root[f], r[0]), r[0])
    key = lambda x: (x[0] is not None, x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((r[0], f"{f:016x}", least.get(root[f])) for r, f in zip(rows, fp, strict=True)), key=key)
    kept = simhash.one_of_each(data.table(spark))
    assert kept.columns == data.table(spark).columns
    ids = [r.doc_id for r in kept.collect()]
    assert sorted(i for i in ids if i is not None) == sorted(set(least.values())) and ids.count(None) == 1
    assert simhash.near_duplicates(data.table(spark, [])).count() == 0 and simhash.one_of_each(data.table(spark, [])).count() == 0


def variants(rng, n):
    """Lines of which some are near copies, at all similarities."""
    out = []
    for _ in range(n):
        line = " ".join(rng.choice(data.WORDS) + rng.choice(["", "ing", "ed"]) for _ in range(rng.randint(8, 60)))
        out.append(line)
        for _ in range(rng.choice([0, 0, 1, 4])):
            words = line.split()
            for _ in range(rng.randint(1, 3)):
                words[rng.randrange(len(words))] = rng.choice(data.OTHER)
            out.append(" ".join(words))
    return out


def test_signatures_estimate_jaccard():
    rng = random.Random(4)
    lines = [linededup.normal(x) for x in variants(rng, 200)] + ["short", "tiny x", "12345678"]
    sig = linededup.signatures(lines)
    pairs = [(i, i + 1) for i in range(0, len(lines) - 1)]
    gap = [abs((sig[a] == sig[b]).mean() - linededup.jaccard(lines[a], lines[b])) for a, b in pairs]
    assert np.mean(gap) < 0.06 and linededup.signatures(["short"]).tolist() == sig[-3:-2].tolist()


def test_line_recall_against_brute_force(spark):
    rng = random.Random(6)
    lines = sorted(set(variants(rng, 500)))
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, len(lines), 10)], "doc_id long, text string")
    h = {x: xxhash.xxh64_intdigest(x.encode(), 42) - (1 << 64 if xxhash.xxh64_intdigest(x.encode(), 42) >> 63 else 0) for x in lines}
    got = {r.h: r.root for r in linededup.line_classes(docs).collect()}
    sets = [{t[i : i + 8] for i in range(max(1, len(t) - 7))} for t in map(linededup.normal, lines)]
    links = [(a, b) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    root = groups(range(len(lines)), links)
    same = [got.get(h[lines[a]], h[lines[a]]) == got.get(h[lines[b]], h[lines[b]]) for a, b in links]
    assert len(links) > 100 and np.mean(same) >= 0.98
    back = {v: k for k, v in h.items()}
    at = {x: i for i, x in enumerate(lines)}
    assert all(root[at[back[a]]] == root[at[back[b]]] for a, b in got.items())  # no wrong merges


def family(rng, n):
    """Lines of one template, most pairs too far apart, all in common buckets."""
    base = [rng.choice(data.WORDS) + rng.choice(["", "ing", "ed"]) for _ in range(60)]
    out = []
    for _ in range(n):
        words = list(base)
        for at in rng.sample(range(60), rng.randint(1, 12)):
            words[at] = rng.choice(data.OTHER) + rng.choice(data.WORDS)
        out.append(" ".join(words))
    return out


def test_no_link_of_a_bucket_is_lost(spark):
    rng = random.Random(8)
    lines = sorted({x for _ in range(3) for x in family(rng, 150)} | set(variants(rng, 60)))
    docs = spark.createDataFrame([(i, "\n".join(lines[i : i + 10])) for i in range(0, len(lines), 10)], "doc_id long, text string")
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in lines]
    h = [x - (1 << 64) if x >> 63 else x for x in h]
    got = {r.h: r.root for r in linededup.line_classes(docs).collect()}
    own = [linededup.normal(x) for x in lines]
    bands = [set(x) for x in linededup.band_keys(linededup.signatures(own)).tolist()]
    links = [(h[a], h[b]) for a, b in combinations(range(len(lines)), 2) if bands[a] & bands[b] and linededup.jaccard(own[a], own[b]) >= 0.8]
    root, size = groups(h, links), {}
    for x in h:
        size[root[x]] = size.get(root[x], 0) + 1
    assert got == {x: r for x, r in root.items() if size[r] > 1} and len(set(got.values())) > 20
    # the first step alone loses some
    buckets = linededup._buckets(linededup._banded(linededup._lines(docs.select("text"))))
    met = {(r.u, r.v) for r in linededup._near_first(buckets).collect()}
    near = {(min(e), max(e)) for e in links} & met
    assert groups(h, near) != root


def test_outlines_bound_the_difference():
    rng = random.Random(9)
    own = [linededup.normal(x) for x in [*family(rng, 30), *variants(rng, 20), "short", "tiny x"]]
    size, words = linededup.outlines(own)
    for a, b in combinations(range(len(own)), 2):
        x, y = linededup.shingles(own[a]), linededup.shingles(own[b])
        assert size[a] == len(x) and sum(bin(int(u ^ v) & (1 << 64) - 1).count("1") for u, v in zip(words[a], words[b], strict=True)) <= len(x ^ y)


def test_dedup_lines(spark):
    long = "the quick brown fox jumps over the lazy dog while the old man reads a very long newspaper in the sun"
    docs = [(3, f"{long}\nonly here at three\n\n{long}  ", 1), (1, f"\t{long}!\nfirst line of one", 1), (2, None, 1), (4, "", 1), (5, "  \n", 1), (6, long, 1), (None, "nobody's line\nfirst line of one", 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, n_lines long")
    got = {r[0]: (r[1], r[4], r[3]) for r in linededup.dedup_lines(df, lines="all_lines").collect()}
    assert got[1] == (docs[1][1], 0, 2) or got[1] == (docs[1][1], 2, 0)
    by = {r.doc_id: r for r in linededup.dedup_lines(df, lines="all_lines").collect()}
    assert by[1].text == docs[1][1] and by[1].n_removed == 0 and by[1].all_lines == 2
    assert by[3].text == "only here at three\n" and by[3].n_removed == 2
    assert by[2].text is None and by[4].text == "" and by[5].text == "  \n" and by[6].text == "" and by[6].n_removed == 1
    assert by[None].text == "nobody's line" and by[None].n_removed == 1
    kept = linededup.without_repeated_lines(df)
    assert kept.columns == df.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, None}
    assert linededup.dedup_lines(data.table(spark, [])).count() == 0
    table = data.table(spark)
    assert linededup.dedup_lines(table).count() == table.count()
