from pyspark.sql import functions as F

from siltstone.operators import deltas, states


def test_chains_that_cannot_be_read(spark):
    docs = spark.createDataFrame([(0, b"abc" * 50), (1, b"abc" * 60), (2, b""), (3, b"xyz")], "id long, x binary")
    before = docs.select((F.col("id") + 1).alias("id"), F.col("x").alias("b"))
    made = docs.join(before, "id").select("id", (F.col("id") - 1).alias("base"), deltas.container(F.col("x"), F.col("b")).alias("data"))
    more = spark.createDataFrame([(10, 11, b"ZD"), (11, 10, b"ZD"), (12, 99, b"ZD"), (13, 0, b"nothing"), (14, 0, b"ZD\x00\x05broken")], "id long, base long, data binary")
    stored = docs.where("id = 0").selectExpr("id", "cast(null as bigint) AS base", "x AS data").unionByName(made).unionByName(more)
    got = {r["id"]: (r["depth"], r["data"] if r["data"] is None else bytes(r["data"])) for r in deltas.read_chains(stored, stored.select("id")).collect()}
    assert [got[n] for n in range(4)] == [(0, b"abc" * 50), (1, b"abc" * 60), (2, b""), (3, b"xyz")]
    assert [got[n][1] for n in range(10, 15)] == [None] * 5
    assert {r["id"]: r["data"] is None for r in deltas.read_chains(stored, stored.select("id"), most=2).collect()}[3]


def test_varints_beyond_the_bounds(spark):
    n = spark.createDataFrame([(-1,), (0,), (127,), (128,), (16383,), (16384,), ((1 << 32) - 1,), (1 << 32,)], "n long")
    got = [r[0] for r in n.select(deltas.varint(F.col("n"))).collect()]
    assert got == [None, "00", "7F", "8001", "FF7F", "808001", "FFFFFFFF0F", None]


def test_stashes_of_an_empty_list(spark):
    log = spark.createDataFrame([("a", 1, "pop", 1), ("a", 2, "save", 2), ("a", 3, "save", 3), ("a", 4, "drop", 4), ("b", 1, "save", 1), ("b", 2, "clear", 2), ("c", 1, "drop", 1)], "repo string, seq int, op string, id int")
    assert [tuple(r) for r in states.stash_lists(log).collect()] == [("a", 0, 2)]


def test_paths_of_any_depth(spark):
    entries = spark.createDataFrame([("r", "d", "t1", True), ("t1", "f", "o", False)], "tree string, name string, oid string, is_dir boolean")
    wanted = spark.createDataFrame([(1, "r", ""), (2, "r", "d/f"), (3, "r", "/d/"), (4, "r", "d/f/x"), (5, "r", "q"), (6, "none", "d")], "id int, root string, path string")
    assert sorted(tuple(r) for r in states.entries_at(entries, wanted).collect()) == [(1, "r", True), (2, "o", False), (3, "t1", True)]
    assert states.entries_at(entries, wanted.limit(0)).count() == 0
