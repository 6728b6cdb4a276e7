import random
import struct

from pyspark.sql import functions as F

from siltstone.operators import media, models


def box(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I4s", len(body) + 8, kind) + body


def chunk(kind: bytes, body: bytes) -> bytes:
    return kind + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def test_boxes():
    x = box(b"ftyp", b"isom") + box(b"moov", box(b"trak", box(b"tkhd", b"1234"))) + struct.pack(">I4sQ", 1, b"mdat", 20) + b"wide"
    assert media.taken_apart(x) == [("ftyp", 0, 12), ("moov", 12, 28), ("trak", 20, 20), ("tkhd", 28, 12), ("mdat", 40, 20)]
    assert media.taken_apart(x + b"\0\0\0\0mdatrest")[-1] == ("mdat", 60, 12)  # to the end
    assert media.taken_apart(x[:-1])[-1] == ("rest", 40, 19)  # cut off


def test_chunks():
    inner = chunk(b"LIST", b"movi" + chunk(b"00dc", b"abc"))
    x = chunk(b"RIFF", b"AVI " + inner + chunk(b"idx1", b"12"))
    assert media.taken_apart(x) == [("RIFF:AVI ", 0, len(x)), ("LIST:movi", 12, 24), ("00dc", 24, 11), ("idx1", 36, 10)]


def test_glb():
    body = struct.pack("<I4s", 4, b"JSON") + b"{}  " + struct.pack("<I4s", 2, b"BIN\0") + b"ab"
    assert media.taken_apart(b"glTF" + struct.pack("<II", 2, 12 + len(body)) + body) == [("header", 0, 12), ("JSON", 12, 12), ("BIN", 24, 10)]


def test_elements():
    x = b"\x1aE\xdf\xa3\x81a" + b"\x18\x53\x80\x67\xff" + b"\x1f\x43\xb6\x75\x40\x03abc" + b"\xec\x80"
    assert media.taken_apart(x) == [("EBML", 0, 6), ("Segment", 6, 16), ("Cluster", 11, 9), ("Void", 20, 2)]


def test_psd():
    x = b"8BPS\0\1" + b"\0" * 20 + b"\0\0\0\0" + b"\0\0\0\1r" + b"\0\0\0\2ll" + b"pix"
    assert media.taken_apart(x) == [("header", 0, 26), ("colours", 26, 4), ("resources", 30, 5), ("layers", 35, 6), ("pixels", 41, 3)]


def test_model_text():
    x = b"g a\n" + b"v 1 2 3\n" * 4 + b"g b\nv 1\n"
    got = list(media.model_text(x, 20, 1000))
    assert got == [("lines", 0, 36), ("lines", 36, 8)]
    assert sum(n for _, _, n in media.model_text(x, 8, 12)) == len(x)


def test_odd_content(spark):
    rows = [(1, None), (2, b""), (3, b"plain"), (4, b"RIFF"), (5, b"\0\0\0\0ftyp")]
    got = media.segments(spark.createDataFrame(rows, "k int, x binary"), "k", "x").collect()
    assert sorted((r.k, r.type, r.offset, r.size) for r in got) == [(3, "data", 0, 5), (4, "rest", 0, 4), (5, "ftyp", 0, 8)]


def test_hash_matches(spark):
    """All similar pairs of whole 64-bit hashes, against brute force: 9 unlike bits are similar, 10 aren't, wherever they are."""
    rng = random.Random(4)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    hashes = [rng.getrandbits(64) for _ in range(40)]
    for h in hashes[:30]:
        for n in (0, 1, 8, 9, 10, 11):
            hashes.append(h ^ sum(1 << k for k in rng.sample(range(64), n)))
    hashes += [hashes[0] ^ 0x1FF << k for k in range(0, 56, 5)] + [hashes[1] ^ ((1 << 48) - 1), 0, (1 << 64) - 1] + [hashes[2]] * 50
    rows = list(enumerate(hashes)) + [(9999, None)]
    got = media.hash_matches(spark.createDataFrame([(i, None if h is None else signed(h)) for i, h in rows], "id long, hash long")).collect()
    first = {}
    for i, h in enumerate(hashes):
        first.setdefault(h, i)
    want = {(first[h], i, 1.0) for i, h in enumerate(hashes) if first[h] != i}
    ids = sorted((i, h) for h, i in first.items())
    want |= {(a, b, 1 - (x ^ y).bit_count() / 64) for k, (a, x) in enumerate(ids) for b, y in ids[k + 1 :] if 1 - (x ^ y).bit_count() / 64 >= 0.85}
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert sum(s == 1 - 9 / 64 for *_, s in want) > 30


def test_models_of_bytes(spark):
    stl = bytes(80) + (70_000).to_bytes(4, "little")
    made = [("a.stl", stl), ("a.STL", b"short"), ("a.fbx", b"Kaydara FBX Binary  \0\x1a\0"), ("a.fbx", b"other bytes that are long enough"), ("a.obj", b"v 1 2 3\n\xff"), ("a.obj", b""), ("a.glb", b"glTF\2\0"), ("a.ply", b"ply\n"), ("a.xyz", b"v 1 2 3"), ("a.obj", None)]
    df = spark.createDataFrame([(i, *m) for i, m in enumerate(made)], "i int, path string, data binary")
    got = {r["i"]: r["m"] for r in df.select("i", models.model_info(F.col("path"), F.col("data")).alias("m")).collect()}
    assert (got[0]["vertices"], got[0]["faces"]) == (210_000, 70_000)
    assert got[2]["rigged"] and got[6]["animated"]
    assert got[5]["vertices"] == 0 and got[5]["box"] is None
    assert [got[i] for i in (1, 3, 4, 7, 8, 9)] == [None] * 6
