"""Rules held against facts written out by hand, apart from the queries' SQL."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import filetypes as ft
from siltstone.functions import scalar

MB = 1 << 20


def values(spark, rows, schema, column):
    return [r[0] for r in spark.createDataFrame([(i, *(r if isinstance(r, tuple) else (r,))) for i, r in enumerate(rows)], f"i int, {schema}").orderBy("i").select(column).collect()]


def test_types(spark):
    names = ["a.HEIC", "b/c.usda", "x.docx", "y.ai", "z.aiff", "pdf", ".mp4", "a.b/c", "k.kra", "n.nk", "t.ts"]
    assert values(spark, names, "p string", ft.category(F.col("p"))) == ["image", "3d", "office", "creative", "audio", "other", "other", "other", "other", "other", "other"]
    assert values(spark, names, "p string", ft.media_type(F.col("p"))) == ["image", "model3d", "unknown", "vfx", "audio", "unknown", "unknown", "unknown", "psd", "vfx", "video"]


def test_eligibility(spark):
    rows = [("a.csv", 5 * MB, True), ("a.csv", 5 * MB - 1, False), ("a.wav", 10 * MB, False), ("a.wav", 10 * MB + 1, True), ("a.png", 500 * MB, False), ("a.unheard", 10 * MB + 1, True), ("noext", 6 * MB, False), ("a.docx", 5 * MB, True)]
    assert values(spark, [r[:2] for r in rows], "p string, n long", ft.chunked(F.col("p"), F.col("n"))) == [r[2] for r in rows]
    rows = [("a.txt", 1, True), ("a.mov", 1, True), ("a.mp4", 100 * MB, False), ("a.mp4", 100 * MB + 1, True), ("a.glb", MB, False), ("a.glb", MB + 1, True), ("a.ai", 50 * MB + 1, True), ("a.ai", 50 * MB, False), ("a.zip", 900 * MB, False), ("a", 60 * MB, True)]
    assert values(spark, [r[:2] for r in rows], "p string, n long", ft.delta_wanted(F.col("p"), F.col("n"))) == [r[2] for r in rows]
    rows = [("blob", "a.txt", 1024, True), ("blob", "a.txt", 1023, False), ("blob", "a.xyz", 1024, False), ("blob", None, 1025, True), ("blob", "a.mp4", 100 * 1024, False), ("blob", "a.zip", 9 * MB, False), ("tree", None, 3, True), ("commit", "a.zip", 3, True)]
    assert values(spark, [r[:3] for r in rows], "k string, p string, n long", ft.packed(F.col("k"), F.col("p"), F.col("n"))) == [r[3] for r in rows]


def test_strategies_and_classes(spark):
    rows = [("a.py", 10, "brotli"), ("a.json", 500 * MB, "zstd-default"), ("a.flac", 1, "zstd-best"), ("a.pth", 1, "zstd-fast"), ("a.blend", 1, "zstd-default"), ("a.usdz", 1, "store"), ("a.7Z", 1, "store"), ("Makefile", 1, "zstd-default")]
    assert values(spark, [r[:2] for r in rows], "p string, n long", ft.strategy(F.col("p"), F.col("n"))) == [r[2] for r in rows]
    t = ft.base_thresholds(F.col("p"))
    assert [tuple(x) for x in values(spark, ["a.pdf", "a.toml", "a.blend", None, "a.zip", "a.mov"], "p string", t)] == [(0.15, 0.5), (0.95, 0.8), (0.4, 0.7), (0.3, 0.8), (0.3, 0.8), (0.5, 0.7)]
    assert values(spark, [0, 1024, 1025, 102400, 102401, 10 * MB, 10 * MB + 1, 100 * MB, 100 * MB + 1], "n long", ft.size_class(F.col("n"))) == ["tiny"] * 2 + ["small"] * 2 + ["medium"] * 2 + ["large"] * 2 + ["huge"]
    assert values(spark, [3.99, 4.0, 6.0, 7.5], "x double", ft.entropy_class(F.col("x"))) == ["very low", "low", "medium", "high"]
    data = [b"", b"\x1f\x8b12", b"\xff\xd8\xff\x00", b"plain text\n", bytes(range(32)) * 3, b"BZh9", b"\0\0\0\x18ftypisom...", "größe".encode()]
    assert values(spark, data, "x binary", ft.pattern_class(F.col("x"))) == ["binary", "compressed", "media", "text", "binary", "compressed", "media", "text"]
    rows = [("tiny", "low", "binary", "brotli-best"), ("small", "low", "binary", "brotli-default"), ("small", "medium", "text", "zstd-default"), ("medium", "very low", "text", "brotli-default"), ("medium", "low", "text", "zstd-default"), ("huge", "low", "text", "zstd-fast"), ("huge", "high", "text", "store"), ("tiny", "low", "media", "store")]
    assert values(spark, [r[:3] for r in rows], "a string, b string, c string", ft.profile_strategy(F.col("a"), F.col("b"), F.col("c"))) == [r[3] for r in rows]
    rows = [(0.97, 0.96, 0.99, "identical"), (0.97, 0.96, 0.9, "minor"), (0.5, 0.7, 0.9, "conflict"), (0.5, 0.9, 0.9, "asymmetric"), (0.9, 0.9, 0.9, "minor")]
    assert values(spark, [r[:3] for r in rows], "a double, b double, c double", ft.image_change(F.col("a"), F.col("b"), F.col("c"))) == [r[3] for r in rows]


def test_names_ages_sizes(spark):
    rows = {"main": True, "a b": True, "a~b": True, "x/.y": True, 'a"b': False, "a<b": False, "a|b": False, ".a": False, "a.": False, "a//b": False, "a..b": False, "x.lock": False, "a@{0}": False, "": False, "/a": False, "a/": False, "a:b": False}
    assert values(spark, list(rows), "p string", scalar.valid_ref_name(F.col("p"))) == list(rows.values())
    assert values(spark, [0, 59, 60, 3599, 3600, 86399, 86400, 10**9], "n long", scalar.time_ago(F.col("n"))) == ["0 seconds ago", "59 seconds ago", "1 minutes ago", "59 minutes ago", "1 hours ago", "23 hours ago", "1 days ago", "11574 days ago"]
    assert values(spark, [0, 60, 1023, 1024, 1536, MB, 1 << 30, 5 << 40], "n long", scalar.human_bytes(F.col("n"))) == ["0 bytes", "60 bytes", "1023 bytes", "1.00 KB", "1.50 KB", "1.00 MB", "1.00 GB", "5120.00 GB"]
    assert values(spark, [(5, None), (None, "x"), (None, None), (5, "x")], "t long, s string", scalar.valid_ref(F.col("t"), F.col("s"))) == [True, True, False, False]


def test_pointers_codecs_magic(spark):
    oid = "ab" * 32
    texts = [f"version v\noid sha256:{oid}\nsize 5\n", f"size 5\r\n\r\noid sha256:{oid}\r\nversion v", f"version v\noid sha256:{oid}", f"version v\noid sha256:{oid[:-1]}\nsize 5", f"version v\noid md5:{oid}\nsize 5", f"version v\noid sha256:{oid}\nsize -5", f"version v\noid sha256:{oid}\nsize 5\nother x", f"version {'v' * 600}\noid sha256:{oid}\nsize 5", f"version v\nsize 4\noid sha256:{oid}\nsize 5"]
    got = values(spark, texts, "p string", scalar.parse_pointer(F.col("p")))
    assert [x and tuple(x) for x in got] == [(oid, 5), (oid, 5), None, None, None, None, None, None, (oid, 5)]
    heads = {b"\x28\xb5\x2f\xfdx": "zstd", b"BRT\x01": "brotli", b"\x78\x9c": "zlib", b"\x78\xda1": "zlib", b"\x58\x85": "store", b"\x78": "store", b"": "store", b"\x78\x9d": "store"}
    assert values(spark, list(heads), "x binary", scalar.codec(F.col("x"))) == list(heads.values())
    data = {b"ship\nnow": "text", b"total 10\n": "text", b"a\0b": "binary", ("x" * 511 + "é" * 9).encode(): "text", b"x" * 511 + b"\xff" * 9: "binary", b"\xc3": "binary", b"%PDF-1": "pdf", b"RIFF....WAVE": "wav"}
    assert values(spark, list(data), "x binary", scalar.magic_type(F.col("x"))) == list(data.values())


@pytest.mark.parametrize(("glob", "yes", "no"), [("v[0-9].*", "v1.2", "va.2"), ("[!a]b", "cb", "ab"), ("v1*", "v10", "v2"), ("a?c", "abc", "a/c")])
def test_globs(spark, glob, yes, no):
    assert values(spark, [yes, no], "p string", scalar.matches_glob(F.col("p"), glob)) == [True, False]


def test_globs_that_are_none_keep_all(spark):
    assert values(spark, ["a", "b"], "p string", scalar.matches_glob(F.col("p"), "v[0-9")) == [True, True]
