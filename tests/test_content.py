import random

from siltstone.operators import content


def test_boundaries_cover_any_length():
    rng = random.Random(1)
    for n in (0, 1, 11, 63, 64, 65, 5000, 40000):
        data = rng.randbytes(n)
        ends = content.boundaries(data, 256, 1024, 8192)
        assert ends == sorted(set(ends)) and (ends[-1] if ends else 0) == n
        assert all(b - a <= 8192 for a, b in zip([0, *ends], ends, strict=False))


def test_sample_hashes(spark):
    """Windows hashed a column at a time give what a loop over bytes gives."""
    rows = [(0, None), (1, b""), (2, b"a"), (3, b"ab" * 9000), (4, bytes(range(256)) * 3)]

    def plain(x):
        out = []
        for i in range(1, 11):
            h = 0xCBF29CE484222325
            for byte in x[i * len(x) // 11 :][:1024]:
                h = (h ^ byte) * 0x100000001B3 % 2**64
            out.append(h - 2**64 if h >> 63 else h)
        return out

    got = spark.createDataFrame(rows, "k int, x binary").select("k", content.sample_hashes("x").alias("h")).collect()
    assert {r.k: r.h for r in got} == {k: None if x is None else plain(x) for k, x in rows}


def brute_bases(items, recent):
    """The last objects newest first, a better score strictly replaces the best."""
    out = {}
    for n, (i, kind, size, samples, is_delta) in enumerate(items):
        best = 0.3
        for j, k2, s2, x2, d2 in reversed(items[max(0, n - recent) : n]):
            ratio = min(size, s2) / max(size, s2, 1)
            if kind != k2 or d2 or ratio < 0.8 or not samples or not x2:
                continue
            score = 0.7 * sum(x in x2 for x in samples) / min(len(samples), len(x2)) + 0.3 * ratio
            if score > best:
                best, out[i] = score, (j, round(score, 6))
    return out


def test_best_bases_equal_brute_force(spark):
    rng = random.Random(4)
    items = [(3 * i + 7, rng.choice("ab"), rng.randint(80, 110), [rng.choice([1, 1, 2, 3, rng.randint(4, 30)]) for _ in range(rng.choice([0, 3, 10, 10]))], rng.random() < 0.2) for i in range(400)]
    df = spark.createDataFrame(items, "id long, type string, size long, samples array<long>, is_delta boolean").repartition(5)
    for recent in (50, 3):
        got = {r.id: (r.base, r.score) for r in content.best_bases(df, recent=recent).collect()}
        assert got == brute_bases(items, recent) and len(got) > 100
    assert content.best_bases(df.limit(0)).count() == 0
    assert [r.n for r in content.numbered(df.select("id"), "id", "n").orderBy("id").collect()] == list(range(400))


def test_deltas_come_back(spark):
    rows = [(b"abc" * 500, b"abc" * 400 + b"x"), (b"", b"base"), (b"new", b""), (None, b"base"), (bytes(range(256)) * 9, bytes(range(256)) * 9)]
    df = spark.createDataFrame(rows, "x binary, b binary").withColumn("d", content.zstd_delta("x", "b"))
    got = df.select("x", "d", content.zstd_undelta("d", "b").alias("back")).collect()
    assert all(r.back == r.x for r in got) and len(got[0].d) < 100
