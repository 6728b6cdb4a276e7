import datetime
import random

from pyspark.sql import functions as F

from siltstone.operators import compare, storage
from siltstone.sources import worktree
from siltstone.streaming import logs


def test_objects_are_verified(spark):
    rng = random.Random(3)
    data = [b"", b"a", b"text " * 300, rng.randbytes(2000), b"\x78\x9cnot zlib", b"\0zero", b"\x28\xb5\x2f\xfdnot zstd"]
    rows = [(x, s) for x in data for s in ("store", "zlib", "zstd-fast", "zstd-best", "brotli")]
    df = spark.createDataFrame(rows, "data binary, strategy string")
    packed = df.withColumn("p", storage.compress("data", "strategy"))
    got = packed.select("data", "strategy", "p", storage.decompress("p").alias("back")).collect()
    assert all(r.back == r.data and len(r.p) <= len(r.data) + 1 for r in got)
    assert {r.strategy for r in got if r.data == data[2] and len(r.p) < 200} == {"zlib", "zstd-fast", "zstd-best", "brotli"}
    stored = storage.put(df)
    assert stored.count() == len(data) and storage.put(df, stored).count() == 0
    bad = stored.select("oid", F.when(F.col("size") == 1, F.lit(b"\0b")).otherwise(F.col("data")).alias("data"))
    read = storage.get(bad, stored.select("oid").union(spark.createDataFrame([("none",)], "oid string"))).collect()
    assert sorted(r.result for r in read) == ["corrupt", "missing"] + ["ok"] * (len(data) - 1)
    assert {bytes(r.data) for r in read if r.result == "ok"} == set(data) - {b"a"}


def test_packs(spark):
    rng = random.Random(5)
    data = [rng.randbytes(rng.choice([0, 1, 50, 3000])) for _ in range(200)]
    objects = spark.createDataFrame([(x,) for x in set(data)], "data binary").select(storage.object_id(F.col("data")).alias("oid"), "data")
    index = storage.pack_index(objects, 5000, 3)
    packs = storage.write_packs(objects, index)
    assert max(len(r.data) for r in packs.collect()) < 5000 + 3000 and packs.count() > 10
    got = storage.read_packs(packs, index, objects.select("oid").union(spark.createDataFrame([("none",)], "oid string"))).collect()
    assert sorted(bytes(r.data) for r in got if r.result == "ok") == sorted(set(data)) and [r.oid for r in got if r.result != "ok"] == ["none"]
    gone = storage.read_packs(packs.limit(0), index, objects.select("oid"))
    assert {r.result for r in gone.collect()} == {"missing"}
    stats = storage.repack_stats(objects, index.limit(7)).first()
    assert (stats.packed, stats.loose) == (7, len(set(data)) - 7)


def test_object_kinds(spark):
    oid = "a" * 64
    data = [f"tree {oid}\nauthor x".encode(), f"100644 a file.txt {oid}\n".encode(), b"hello", b"", b"tree of life"]
    df = spark.createDataFrame(list(enumerate(data)), "i int, x binary")
    assert [r.k for r in df.orderBy("i").select(storage.object_kind(F.col("x")).alias("k")).collect()] == ["commit", "tree", "blob", "blob", "blob"]


def test_worktree(spark, tmp_path):
    root = tmp_path / "work"
    for name, text in {"a.txt": "one", "d/b.txt": "two", "d/c.log": "three", ".repo/HEAD": "x", "e f.txt": "5"}.items():
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text(text)
    now = worktree.stat(spark, str(root), ["*.log"])
    assert {(r.path, r.size) for r in now.collect()} == {("a.txt", 3), ("d/b.txt", 3), ("e f.txt", 1)}
    tree = worktree.scan(spark, str(root), ["*.log"])
    head = spark.createDataFrame(tree.collect(), tree.schema)
    cache = spark.createDataFrame(now.collect(), now.schema)
    (root / "a.txt").write_text("changed")
    (root / "new.txt").write_text("n")
    (root / "d/b.txt").unlink()
    assert {r.path for r in worktree.changed(worktree.stat(spark, str(root), ["*.log"]), cache).collect()} == {"a.txt", "new.txt"}
    staged = {r.path: r.change for r in worktree.staged(head, worktree.scan(spark, str(root), ["*.log"])).collect()}
    assert staged == {"a.txt": "modified", "new.txt": "added", "d/b.txt": "deleted"}


def test_merge_with_conflicts_gives_no_tree(spark):
    tree = lambda **x: spark.createDataFrame([(p, "100644", o) for p, o in x.items()], "path string, mode string, oid string")
    base, ours, theirs = tree(a="1", b="1", c="1"), tree(a="2", b="1", c="1", d="9"), tree(a="3", b="1")
    assert compare.merge(base, ours, theirs).count() == 0
    assert {(r.path, r.oid) for r in compare.merged_paths(base, ours, theirs).collect()} == {("b", "1"), ("d", "9")}
    assert {(r.path, r.oid) for r in compare.merge(base, ours, theirs, "ours").collect()} == {("a", "2"), ("b", "1"), ("c", "1"), ("d", "9")}
    assert {(r.path, r.oid) for r in compare.merge(base, ours, tree(a="1", b="5")).collect()} == {("a", "2"), ("b", "5"), ("d", "9")}


def test_late_events_are_left_out(spark, tmp_path):
    at = lambda h, m: datetime.datetime(2024, 1, 1, h, m)
    batches = [[(1, at(10, 0), 1.0), (1, at(10, 5), 2.0)], [(2, at(12, 0), 3.0)], [(2, at(12, 2), 0.5)], [(1, at(10, 1), 50.0), (2, at(12, 1), 4.0)], [(2, at(14, 0), 5.0)]]
    for n, rows in enumerate(batches):
        spark.createDataFrame([(u, t, "x", v) for u, t, v in rows], "user_id long, ts timestamp, event_type string, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/{n}")
    schema = "user_id long, ts timestamp, event_type string, value double"
    files = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))
    got = {(r.start.hour, r.n, r.total) for r in logs.drained(logs.per_window(files), "start", "event_type").collect()}
    assert got == {(10, 2, 3.0), (12, 3, 7.5), (14, 1, 5.0)}  # the value 50 came when its window was closed
