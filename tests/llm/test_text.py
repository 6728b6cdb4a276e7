import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from siltstone.llm import decontaminate, langid, quality, secrets, sharding, threads

from . import data


def key(x):
    return tuple((v is not None, v) for v in x)


def bench_words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def brute_contamination(docs, bench):
    wins = {}
    for item, text in bench:
        w = bench_words(text)
        for i in range(max(1, len(w) - 9) if w else 0):
            wins.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    out = []
    for doc_id, text in docs:
        w, hit, items = bench_words(text), set(), set()
        for n in {len(x) for x in wins}:
            for i in range(len(w) - n + 1):
                if found := wins.get(tuple(w[i : i + n])):
                    hit |= set(range(i, i + n))
                    items |= found
        out.append((doc_id, len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit)))
    return out


def test_contamination(spark):
    rng = random.Random(8)
    bench = [(i, data.prose(rng, n, data.WORDS + data.OTHER)) for i, n in enumerate([12, 30, 10, 4, 1, 9, 25])] + [(7, None), (8, "!!"), (9, ""), (10, "Straße ÄPFEL zero"), (11, data.prose(rng, 15))]
    bench[4] = (4, "Xylophon")
    docs = [(r[0], r[1]) for r in data.rows()]
    for i in range(30):
        n, text = rng.choice(bench)
        docs.append((200 + i, data.prose(rng, 40) + " " + (text or "").upper() + "; " + (text or "") + " " + data.prose(rng, rng.randint(0, 5))))
    df, b = spark.createDataFrame([(*d, 1, 2) for d in docs], "doc_id long, text string, hits int, n_words int"), spark.createDataFrame(bench, "item_id long, text string")
    want = sorted(brute_contamination(docs, bench), key=key)
    for most in (1000, 0):  # constants, a join
        got = [tuple(r)[:6] for r in decontaminate.contamination(df, b, most=most).collect()]
        assert sorted(got, key=key) == want
        left = decontaminate.uncontaminated(df, b, most=most)
        assert left.columns == df.columns and sorted((r.doc_id is not None, r.doc_id or 0) for r in left.collect()) == sorted((w[0] is not None, w[0] or 0) for w in want if not w[5])
        for r in decontaminate.contamination(df, b, most=most).collect():
            assert sum(x.b - x.a for x in r.spans) == r.n_hit and all(x.b < y.a for x, y in zip(r.spans, r.spans[1:], strict=False))
    assert sum(w[5] for w in want) > 20
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(df, none).where("contaminated").count() == 0
    assert decontaminate.contamination(df.limit(0), b).count() == 0


def test_contamination_of_a_very_long_text_and_many_items(spark):
    rng = random.Random(15)
    shared = data.prose(rng, 30)
    bench = [(i, f"{shared} {data.prose(rng, 12)}") for i in range(60)]
    docs = [(1, data.prose(rng, 400_000) + " " + " ".join(bench[3][1] for _ in range(300)))] + [(10 + i, f"{data.prose(rng, 5)} {shared}") for i in range(40)]
    assert len(docs[0][1]) > 2_000_000
    want = sorted(brute_contamination(docs, bench), key=key)
    df, b = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    for most in (100_000, 0):
        assert sorted((tuple(r)[:6] for r in decontaminate.contamination(df, b, most=most).collect()), key=key) == want


def brute_stats(text):
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", text or "") if x]
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    rep = {i + j for i in range(len(w) - 2) if n[tuple(w[i : i + 3])] > 1 for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(rep)


def test_quality(spark):
    rng = random.Random(9)
    rows = [list(r) for r in data.rows()]
    for i in range(30):
        rows.append([300 + i, " ".join(f"{rng.choice(data.WORDS).upper()}###{rng.randint(0, 9)}" for _ in range(120)) + "\n\nx y z\nx y z", "en", "s", 1, 1, "", "", "", ""])
    df = data.table(spark, [tuple(r) for r in rows])
    trusted = spark.createDataFrame([(r[0],) for r in rows if r[0] is not None and r[0] < 60], "doc_id long")
    got = quality.assess(df, quality.learn(df, trusted)).collect()
    want = sorted(((r[0], *brute_stats(r[1])) for r in rows), key=key)
    assert sorted(((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in got), key=key) == want
    for r in got:
        assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
        assert r.kept == (not r.base_failed and r.score >= quality.THRESHOLD)
    by = {r.doc_id: r.score for r in got}
    assert max(by[i] for i in range(300, 330)) < min(by[i] for i in range(60))
    # the model against plain counting
    ratio = quality.learn(df, trusted)
    good = {r[0] for r in rows if r[0] is not None and r[0] < 60}
    raw, target = Counter(), Counter()
    m = (1 << 64) - 1
    grams = {}
    for i, r in enumerate(rows):
        crc = [zlib.crc32(x) for x in (r[1] or "").encode().split()]
        g = [(c * 0x9E3779B97F4A7C15 & m) >> 48 for c in crc] + [(((a * 0xBF58476D1CE4E5B9 + b + 1) & m) * 0x9E3779B97F4A7C15 & m) >> 48 for a, b in zip(crc, crc[1:], strict=False)]
        grams[i] = g
        raw.update(g)
        if r[0] in good:
            target.update(g)
    n, t = sum(raw.values()), sum(target.values())
    plain = np.array([np.log((target[b] + 1) / (t + 65536)) - np.log((raw[b] + 1) / (n + 65536)) for b in range(65536)])
    assert np.allclose(ratio, plain)
    scores = sorted((r.score for r in got))
    assert np.allclose(scores, sorted(float(np.mean(plain[g])) if g else 0.0 for g in grams.values()))
    assert quality.assess(data.table(spark, []), np.zeros(quality.BUCKETS)).count() == 0
    assert not quality.learn(data.table(spark, []), trusted).any()


def test_quality_of_a_very_long_text():
    rng = random.Random(13)
    text = " ".join(f"w{i}" for i in range(2_200_000)) + " w0 w1 w2 " + " ".join(f"v{rng.randint(0, 60)}" for _ in range(3000))
    _, _, ids, n, numbers = quality._words([text, "a b c a b c"])
    assert len(numbers) > 1 << 21 and quality.repeated(ids, n).tolist() == [brute_stats(text)[4], 6]


def test_quality_scores_do_not_depend_on_neighbours():
    rng = random.Random(14)
    texts, ratio = [data.prose(rng, rng.randint(0, 90)) for _ in range(200)], np.random.default_rng(1).normal(size=quality.BUCKETS)
    scored = lambda ts: quality.scores(*quality._words(ts)[2:], ratio).tolist()
    assert scored(texts) == [scored([t])[0] for t in texts] == scored(texts[100:])[-100:][:0] + [x for a in range(0, 200, 7) for x in scored(texts[a : a + 7])]


def brute_base(text):
    out = []
    for k, (pattern, good) in enumerate(
        [
            (r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']? *[:=] *["']?([A-Za-z0-9+/_.=-]+)""", lambda m: len(m[2]) >= 6),
            (r"AKIA[A-Z0-9]+", lambda m: len(m[0]) >= 20),
            (r"[0-9a-f]+", lambda m: len(m[0]) >= 24),
        ]
    ):
        out += [(m.start(), k, m.end()) for m in re.finditer(pattern, text) if good(m)]
    return ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(out))


def test_secrets(spark):
    rng = random.Random(10)
    live, example = "Zk3" + "".join(rng.choices("abcXYZ0189", k=30)), "Qp7" + "".join(rng.choices("abcXYZ0189", k=30))
    docs = [(i, f"ümlaut 😀 {rng.choice(['password', 'Token', 'API_KEY', 'apikey', 'PASSWD'])}{rng.choice(['=', ' : ', chr(34) + ' = ' + chr(39)])}{''.join(rng.choices('abc0', k=rng.randint(3, 30)))} AKIA{''.join(rng.choices('ABC1', k=rng.randint(10, 22)))} {''.join(rng.choices('0123456789abcdef', k=rng.randint(20, 60)))}", "s1") for i in range(40)]
    docs += [(50, f"see {live} here", "s1"), (51, f"and token={live}", "s1"), (52, f"{example}", "s1"), (53, f"x {example} y", "s2"), (54, None, "s2"), (55, "", None), (56, f"{live}", "s1"), (56, f"{live}", "s1"), (None, f"password: {live}", "s1")]
    got = secrets.secrets(spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, source string, rid long")).collect()
    by = sorted(((r.doc_id, r.base_sha256, r.n_assign, r.n_access, r.n_hex) for r in got), key=key)
    want = []
    for d, text, _ in docs:
        base = brute_base(text or "")
        kinds = Counter(x.split(":")[0] for x in base.split(",") if x)
        want.append((d, hashlib.sha256(base.encode()).hexdigest(), kinds["assign"], kinds["access"], kinds["hex"]))
    assert by == sorted(want, key=key)
    spans = {r.doc_id: r for r in got}
    assert spans[50].spans == f"owned:4:{4 + len(live)}" and spans[50].n_new == 1
    assert spans[51].spans.startswith("assign:4:") and spans[51].n_new == 0 and spans[51].n_owned == 1
    assert spans[52].spans == "" and spans[52].n_example == 1 and spans[53].n_example == 1
    assert spans[54].spans == "" and spans[54].base_sha256 == hashlib.sha256(b"").hexdigest()
    assert secrets.secrets(data.table(spark, [])).count() == 0 and secrets.secrets(data.table(spark)).count() == data.table(spark).count()


def test_secrets_judged_by_repositories_and_owners(spark):
    rng = random.Random(11)
    live, near, example, template, few = ("Ab1" + "".join(rng.choices("defXYZ2345", k=30)) for _ in range(5))
    docs = [(i, f"my {live} key", f"s{i % 2}") for i in range(30)]  # copies of one text under two owners
    docs += [(100 + i, f"{data.prose(rng, 30)} {'same words stand around this value on both sides ' * 2}{near} {'and here too ' * 5}", f"s{i}") for i in range(2)]  # near copies
    docs += [(200 + i, f"{i} {example}", "hot") for i in range(150)]  # many repositories under one owner
    docs += [(400 + i, f"{i}{' ' * 50}{template}", f"s{i % 3}") for i in range(20)]  # many, alike around the value
    docs += [(500 + i, f"{i} {few}", "s1") for i in range(20)]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    want = {0: (1, 0, "3:36:1:1"), 100: (1, 0, "2:2"), 200: (0, 1, "150:1"), 400: (0, 1, "20:3"), 500: (1, 0, "20:1")}
    for d, text, _ in docs:
        n_owned, n_example, counts = want[next(k for k in reversed(want) if k <= d)]
        r = got[d]
        assert (r.n_owned, r.n_example, r.n_new) == (n_owned, n_example, n_owned) and r.candidates.endswith(counts), r
        assert r.spans == (f"owned:{':'.join(r.candidates.split(':')[:2])}" if n_owned else "")


def test_secrets_of_any_length(spark):
    rng = random.Random(12)
    runs = ["Zk3" + "".join(rng.choices("abcXYZ0189+/", k=n)) + "z" for n in (252, 253, 254, 1000, 100_000)]
    docs = [(i, f"key {x}.", "s1") for i, x in enumerate(runs)] + [(10, f"see {runs[3]} there", "s2"), (11, f"path/{'dir/' * 80}{runs[0]}", "s1")]
    got = {r.doc_id: r for r in secrets.secrets(spark.createDataFrame(docs, "doc_id long, text string, source string")).collect()}
    for i in (0, 1, 2, 4):
        assert got[i].spans == f"owned:4:{4 + len(runs[i])}"
    assert got[3].n_example == got[10].n_example == 1 and got[3].spans == ""  # of two owners
    assert got[11].spans == f"owned:0:{len(docs[-1][1])}"


def test_marginals_equal_brute_force():
    rng = np.random.default_rng(1)
    counts = np.array([1, 2, 5, 3])
    emit, step = rng.random((11, 3)) + 0.01, rng.random((3, 3)) + 0.01
    got = langid.marginals(emit, counts, step, chunk=2)
    a = 0
    for n in counts.tolist():
        total = np.zeros((n, 3))
        for path in np.ndindex(*[3] * n):
            p = (np.full(3, 1 / 3) @ step)[path[0]] * emit[a, path[0]]
            for t in range(1, n):
                p *= step[path[t - 1], path[t]] * emit[a + t, path[t]]
            for t in range(n):
                total[t, path[t]] += p
        assert np.allclose(got[a : a + n], total / total.sum(1, keepdims=True))
        a += n


def test_language(spark):
    df = data.table(spark)
    model = langid.learn(df)
    got = langid.predict(df, model).collect()
    rows = data.rows()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    for r in rows:
        p = by[r[0]]
        if r[0] is not None:
            assert p.held_out == (zlib.crc32(str(r[0]).encode()) % 4 == 2)
        assert (p.lang_pred == "und") == (not any(c.isalpha() for c in r[1] or "")) and 0 <= p.score <= 1
    held = [by[r[0]].lang_pred == r[2] for r in rows if r[0] is not None and r[0] < 60 and by[r[0]].held_out]
    assert len(held) > 5 and all(held)
    mixed = " ".join(data.WORDS) + " " + " ".join(data.OTHER)
    labels = langid.Labeller(model).label([mixed])[0][2]
    n = len(langid.words(" ".join(data.WORDS)))
    assert (labels[: n - 2] == model.labels.index("en")).mean() > 0.9 and (labels[n + 2 :] == model.labels.index("de")).mean() > 0.9
    kept = langid.identified(df)
    assert kept.columns == df.columns and {103, 104, 105, 106}.isdisjoint(r.doc_id for r in kept.collect())
    assert langid.predict(data.table(spark, []), None).count() == 0 and langid.learn(data.table(spark, [])) is None
    nolang = data.table(spark, [(1, "hello there", None, *[None] * 7), (2, "12", None, *[None] * 7)])
    assert [r.doc_id for r in langid.identified(nolang).collect()] == [1]
    one = data.table(spark, [(1, "hello there", "en", *[None] * 7)])
    assert [(r.lang_pred, r.score) for r in langid.predict(one, langid.learn(one)).collect()] == [("en", 1.0)]


def test_language_of_long_documents(spark):
    rng = random.Random(16)
    rows = [(i, data.prose(rng, 40, data.OTHER if i % 2 else data.WORDS), "de" if i % 2 else "en") for i in range(40)]
    rows += [(100 + i, data.prose(rng, 5000, data.WORDS), "xx") for i in range(8)] + [(200, data.prose(rng, 450_000, data.OTHER), None)]
    assert all(len(r[1]) > langid.MOST_CHARS for r in rows[40:]) and len(rows[-1][1]) > 2_000_000
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.learn(df)
    assert model.labels == ["de", "en"]  # long documents aren't learned from, but labelled whole
    got = {r.doc_id: r for r in langid.predict(df, model).collect()}
    assert {got[100 + i].lang_pred for i in range(8)} == {"en"} and got[200].lang_pred == "de" and got[200].n_words == len(langid.words(rows[-1][1]))
    few = langid.learn(df, most=3)
    assert few.labels == ["de", "en"] and langid.learn(df, most=3, most_labels=1).labels == ["de"]


def test_language_of_long_words(spark):
    long = "abcdefghijklmnopqrstuvwxyz" * 3
    marked = f"^{long}$"
    grams = Counter(zlib.crc32(f"n{marked[i : i + k]}".encode()) % langid.FEATURES for k in (2, 3) for i in range(len(marked) - k + 1))
    assert not grams - Counter(langid.word_features(long))
    model = langid.learn(data.table(spark))
    glued = lambda words: "".join(w for w in words if w.isalpha())
    one, plain = glued(data.OTHER) * 1000, langid._LONG
    langid._LONG = 10
    summed = model.emissions([one, "wald"])
    langid._LONG = 1 << 40
    assert np.allclose(model.emissions([one, "wald"]), summed)
    langid._LONG = plain
    for head, tail, lang in ((data.WORDS, data.OTHER, "de"), (data.OTHER, data.WORDS, "en")):
        assert langid.Labeller(model).label([glued(head)[:60] + glued(tail) * 4])[0][0] == lang


def brute_descent(spark, ids, tree):
    """Shard of each id by plain descent over the draws of all nodes."""
    nodes = {lv: sharding.children(tree, lv) for lv in sharding.LEVELS}
    cols = [sharding.draw(F.col("doc_id"), lv, n, w).alias(f"{lv}{n}") for lv in nodes for n, w in nodes[lv].items()]
    out = {}
    for r in spark.createDataFrame([(i,) for i in ids], "doc_id long").select("doc_id", *cols).collect():
        left = tree
        for lv in sharding.LEVELS:
            best = min({getattr(x, lv) for x in left}, key=lambda n: (r[f"{lv}{n}"], n))
            left = [x for x in left if getattr(x, lv) == best]
        out[r.doc_id] = left[0].shard
    return out


def test_sharding(spark):
    rows = data.rows(n=60) + [(i, f"t{i}", "en", "s", 1, 1, "", "", "", "") for i in range(1000, 3000)]
    df, tree = data.table(spark, rows), sharding.even_tree(41)
    got = sharding.shard(df, tree[:40], tree[40], bucket_rows=7).collect()
    for r in got:
        assert r.grown_shard in (r.shard, 40) and r.region == r.shard // 8 and r.rack == r.shard // 4
    bytes_of = Counter((r[0], len((r[1] or "").encode()) + 16, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in got) == bytes_of
    for s in range(40):
        assert sorted(r.slot for r in got if r.shard == s) == list(range(sum(r.shard == s for r in got)))
    moved = sum(r.grown_shard == 40 for r in got)
    assert 20 < moved < 90
    n = Counter(r.shard for r in got)
    assert max(n.values()) < 2.5 * min(n.values())
    at = {r.doc_id: r.shard for r in got}
    ids = [k for k in at if k is not None]
    assert {k: at[k] for k in ids} == brute_descent(spark, ids, tree[:40])
    assert {r.doc_id: r.grown_shard for r in got if r.doc_id is not None} == brute_descent(spark, ids, tree)
    assert sharding.shard(data.table(spark, []), tree).count() == 0


def test_levels_confine_movement(spark):
    tree = sharding.even_tree(40)
    df = spark.createDataFrame([(i, "") for i in range(6000)], "doc_id long, text string")
    placed = lambda t: {r.doc_id: r.shard for r in sharding.shard(df, t).collect()}
    at, of = placed(tree), {x.shard: x for x in tree}

    def moves(changed, by):
        new = placed([sharding.Leaf(x.shard, x.rack, x.region, x.weight * by if x.shard in changed else x.weight) for x in tree])
        return [(of[at[k]], of[new[k]]) for k in at if at[k] != new[k]]

    for changed, by in (([5], 2.0), ([5], 0.5), ([5], 0.0), ([4, 5, 6, 7], 2.0), ([4, 5, 6, 7], 0.5)):
        got, whole_rack = moves(changed, by), len(changed) == 4
        assert got
        for old, new in got:
            one, other = (new, old) if by > 1 else (old, new)  # the side that must lie in the changed subtree
            if one.region != other.region:
                assert one.region == 0
            elif one.rack != other.rack:
                assert one.rack == 1
            else:
                assert one.shard == 5 and not whole_rack
    # other racks and regions for the same shards place rows otherwise
    mixed = [sharding.Leaf(x.shard, x.shard % 10, x.shard % 10 % 5) for x in tree]
    assert sum(at[k] != v for k, v in placed(mixed).items()) > 3000
    # weights that stay the same for the rack move rows within it only
    within = placed([sharding.Leaf(x.shard, x.rack, x.region, {4: 1.5, 5: 0.5}.get(x.shard, 1.0)) for x in tree])
    assert {(at[k] // 4, v // 4) for k, v in within.items() if at[k] != v} == {(1, 1)}


def test_quotes(spark):
    msgs = [
        (1, 0, "user", "Hello all. The build is broken!\nIt fails on line 7."),
        (1, 1, "a", "On Monday X wrote:\n> Hello all. The build\n> is   BROKEN!\n\nI will fix it."),
        (1, 2, "b", "> > It fails on line 7.\n> I will fix it.\nThanks a lot."),
        (1, 3, "c", ">It fails on line 7.\nReally?"),
        (1, 4, "d", "> nobody said this.\nOh."),
        (1, 5, "e", "> Thanks a lot.\n> Really?\n> I will fix it.\nYes."),
        (2, 0, "user", "> Hello all.\nOther thread."),
        (2, 1, "a", None),
        (2, 2, "a", ""),
        (2, 3, "a", "Other thread."),
        (2, 4, "b", "> Other thread.\nLast."),
        (None, 0, "a", "> Other thread."),
        (None, None, "a", "Other thread."),
    ]
    df = spark.createDataFrame([(*m, 1, "x") for m in msgs], "conv_id long, turn long, role string, text string, rid int, path string")
    got = {(r.conv_id, r.turn): r for r in threads.link_quotes(df).collect()}
    assert len(got) == len(msgs)
    assert [got[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, None, 3] or [got[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, None, 2]
    assert got[1, 1].text == "\nI will fix it." and got[1, 2].text == "Thanks a lot." and got[1, 2].levels == 2
    assert got[1, 2].depth == 2 and got[1, 2].root == 0 and got[1, 4].depth == 0 and got[1, 4].n_quoted == 1 and got[1, 4].n_linked == 0
    assert got[2, 4].reply_to == 0 and got[2, 0].reply_to is None and got[2, 1].text is None
    order = [r.turn for r in sorted((r for k, r in got.items() if k[0] == 1), key=lambda r: (r.root, r.turn))]
    for r in got.values():
        if r.reply_to is not None and r.conv_id == 1:
            assert order.index(r.reply_to) < order.index(r.turn)
    assert threads.link_quotes(df.limit(0)).count() == 0
    chain = [(5, t, "u", f"> line number {t - 1} of all.\nline number {t} of all.") for t in range(40)]
    deep = threads.link_quotes(spark.createDataFrame(chain, "conv_id long, turn long, role string, text string"))
    assert {r.turn: r.depth for r in deep.collect()} == {t: t for t in range(40)}


def test_quotes_of_long_attributions_large_turns_and_repeated_rows(spark):
    says, big = f"On Monday {'x' * 1000} wrote:", 12_345_678_901
    msgs = [(1, big, "a", "The first words here."), (1, big + 1, "b", f"{says}\n> The first words here.\nA second thing."), (1, big + 2, "c", f"{says}\n> {says}\n> A second thing.\nEnd.")]
    msgs += [(2, 0, "a", "Said twice."), (2, 0, "a", "Said twice."), (2, 1, "b", "> Said twice.\nYes."), (2, 1, "b", "> Said twice.\nYes.")]
    got = threads.link_quotes(spark.createDataFrame(msgs, "conv_id long, turn long, role string, text string")).collect()
    one = {r.turn: r for r in got if r.conv_id == 1}
    assert [(one[big + k].reply_to, one[big + k].root, one[big + k].depth) for k in range(3)] == [(None, big, 0), (big, big, 1), (big + 1, big, 2)]
    assert one[big + 1].text == "A second thing." and one[big + 2].n_quoted == 1
    assert sorted((r.turn, r.reply_to, r.root, r.depth) for r in got if r.conv_id == 2 and r.turn) == [(1, 0, 0, 1)] * 2
    assert [(r.reply_to, r.depth) for r in got if r.conv_id == 2 and not r.turn] == [(None, 0)] * 2


def test_quotes_equal_sql(spark):
    import duckdb

    rng = random.Random(11)
    said, rows = {}, []
    for c in range(30):
        for t in range(rng.randint(1, 12)):
            own = [f"{rng.choice(data.WORDS)} {rng.choice(data.OTHER)} {rng.randint(0, 30)}{rng.choice('.!?')}" for _ in range(rng.randint(0, 4))]
            quote = [rng.choice(["> ", ">", ">> ", " > > "]) + x for x in rng.sample(said.get(c, []), min(len(said.get(c, [])), rng.randint(0, 3)))]
            said.setdefault(c, []).extend(own)
            rows.append((c, t, "u", None if rng.random() < 0.05 else "\n".join(["On day Z wrote:"] * bool(quote) + quote + own)))
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    conversations = df.toPandas()  # noqa: F841
    got = threads.link_quotes(df)
    want = duckdb.sql(threads.ORACLE)
    assert sorted(map(key, got.select(*want.columns).collect())) == sorted(map(key, want.fetchall()))
