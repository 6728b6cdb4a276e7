import random
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing, token_files, tokens
from siltstone.llm.packing import Packer, pack

from . import data

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def plain():
    t = Tokenizer.from_file(PATH)  # untouched, as the contracts have it
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())


def test_cached_pieces_equal_plain_encoding(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_MOST_PIECES", 300)
    rng = random.Random(5)
    marks = ["a", "b", "The", " ", "  ", "\n", "\t", ",", "'s", "é", "1", "23", " ", "　", "<|endoftext|>", "😀", "\r\n", "\x1f", "日本", "ab "]
    enc = tokens.Encoder(PATH)
    for _ in range(60):
        texts = ["".join(rng.choices(marks, k=rng.randint(0, 30))) for _ in range(10)] + ["", " ", "\n", data.prose(rng, 50)]
        ids, n = enc.encode(texts)
        assert ids.tolist() == [i for t in texts for i in plain(t)]
        assert n.tolist() == [len(plain(t)) for t in texts]


def test_texts_cut_in_parts_equal_plain_encoding(plain, monkeypatch):
    monkeypatch.setattr(tokens, "_TOGETHER", 3000)
    monkeypatch.setattr(tokens, "_BLOCK", 1)
    rng = random.Random(6)
    texts = [" ".join("".join(rng.choices("abcdé1,", k=rng.randint(1, 6))) for _ in range(rng.choice([0, 1, 20, 1500]))) for _ in range(40)] + ["", "a  b", "x<|endoftext|>y"]
    ids, n = tokens.Encoder(PATH).encode(texts)
    assert ids.tolist() == [i for t in texts for i in plain(t)] and n.tolist() == [len(plain(t)) for t in texts]


def test_memory_of_an_encoder_over_many_different_words():
    code = """
import re, sys
from siltstone.llm.tokens import Encoder
peak = lambda: int(re.search(r"VmHWM:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024
enc = Encoder(sys.argv[1])
enc.encode(["a b"])
before = peak()
for k in range(5):
    enc.encode([" ".join(f"w{i:x}" for i in range(a, a + 1000)) for a in range(200_000 * k, 200_000 * (k + 1), 1000)])
print(peak() - before)
"""
    got = subprocess.run([sys.executable, "-c", code, PATH], capture_output=True, text=True, check=True, cwd=Path(tokens.__file__).parents[2]).stdout
    assert float(got) < 180  # MB


def test_packing_of_batches_cut_in_parts(spark, plain, monkeypatch):
    monkeypatch.setattr(packing, "MOST_CHARS", 500)
    docs = data.table(spark).coalesce(1)
    rows = pack(docs, PATH).collect()
    ids = {r[0]: [*plain(r[1]), 1] for r in data.rows()}
    assert all(r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) for r in rows)
    check_pieces(rows, sum(len([*plain(r[1]), 1]) for r in data.rows()))


def test_token_files(spark, plain):
    rows = [(r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in token_files.token_files(data.table(spark).repartition(5), PATH).collect()]
    want = {}
    for r in data.rows():
        want.setdefault(r[0], []).append(crc([*plain(r[1]), 2]))
    assert sorted(((r[0] is not None, r[0] or 0, r[3]) for r in rows)) == sorted((k is not None, k or 0, c) for k, v in want.items() for c in v)
    rows.sort(key=lambda r: r[1])
    keys = [r[0] for r in rows]
    assert keys[0] is None and keys[1:] == sorted(keys[1:])
    assert [r[1] for r in rows] == np.cumsum([0, *(r[2] for r in rows)])[:-1].tolist()


def test_token_files_of_an_empty_table(spark):
    assert token_files.token_files(data.table(spark, []), PATH).count() == 0


def check_pieces(rows, lengths):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    used = []
    for parts in by.values():
        parts.sort(key=lambda r: r.offset)
        assert [p.offset for p in parts] == np.cumsum([0, *(p.length for p in parts)])[:-1].tolist()
        used.append((parts[0].tier, sum(p.length for p in parts)))
        assert all(u <= t for t, u in used)
    assert sum(u for _, u in used) == lengths
    return used


def test_packing(spark, plain):
    rows = pack(data.table(spark).coalesce(2), PATH).collect()
    ids = {r[0]: [*plain(r[1]), 1] for r in data.rows()}
    for r in rows:
        assert r.ids_crc32 == crc(ids[r.doc_id][r.start : r.start + r.length]) and r.doc_tokens == len(ids[r.doc_id])
    for key in ids:
        parts = sorted((r.start, r.length) for r in rows if r.doc_id == key and key != 107)
        assert key == 107 or (parts[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(parts, parts[1:], strict=False)) and sum(parts[-1]) == len(ids[key]))
    used = check_pieces(rows, sum(len([*plain(r[1]), 1]) for r in data.rows()))
    assert sum(t != u for t, u in used) <= 2  # the last of each task
    assert pack(data.table(spark, []), PATH).count() == 0


def brute_windows(batches, tiers):
    """The packing rule with plain lists: (tier, [(document, start, length)]) of each window, batch after batch."""
    out, items = [], []
    for k, batch in enumerate(batches):
        for doc, n in batch:
            for a in range(0, n, max(tiers)):
                if n - a >= max(tiers):
                    out.append((max(tiers), [(doc, a, max(tiers))]))
                else:
                    items.append((n - a, doc, a))
        while items:
            tier = min(t for t in tiers if t >= max(items)[0])
            total = sum(x[0] for x in items)
            if total < tier:
                if k < len(batches) - 1:
                    break
                tier = min(t for t in tiers if t >= total)
            room, parts = tier, []
            while room and items:
                fits = [x for x in items if x[0] <= room]
                n, doc, a = max(fits) if fits else min(items)
                items.remove((n, doc, a))
                if n > room:
                    items.append((n - room, doc, a + room))
                parts.append((doc, a, min(n, room)))
                room -= parts[-1][2]
            out.append((tier, parts))
    return out


@pytest.mark.parametrize("seed", range(5))
def test_packer_fills_windows(seed):
    rng, p, tiers = random.Random(seed), Packer(3, (256, 512, 1024, 2048)), (256, 512, 1024, 2048)
    batches = [[(100 * b + d, rng.choice([1, 5, 255, 256, 257, 2047, 2048, 2049, 9000, rng.randint(1, 3000)])) for d in range(100)] for b in range(8)]
    done = []
    for b in batches:
        for d, n in b:
            p.add(d, n)
        done += p.pack(last=b is batches[-1])
    seqs = {}
    for d, s, n, q, o, tier, k in done:
        seqs.setdefault(q, (tier, k, []))[2].append((o, d, s, n))
    got = [(t, [(d, s, n) for _, d, s, n in sorted(x)]) for _, (t, _, x) in sorted(seqs.items())]
    assert sorted(got) == sorted(brute_windows(batches, tiers))
    assert sum(t != sum(x[2] for x in w) for t, w in got) <= 1 and {t for t, _ in got} == set(tiers)
    for tier in tiers:
        assert sorted(k for t, k, _ in seqs.values() if t == tier) == list(range(sum(t == tier for t, _ in got)))


def test_step_groups_are_full_across_tasks(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(i, data.prose(rng, rng.choice([5, 60, 150, 300, 900, 2500]))) for i in range(300)], "doc_id long, text string").repartition(7)
    rows = pack(docs, PATH, step_ids=8192).collect()
    groups = {}
    for q, tier, g in {(r.sequence_id, r.tier, r.step_group) for r in rows}:
        groups.setdefault(g, []).append(tier)
    assert all(len(set(x)) == 1 for x in groups.values()) and len({r.sequence_id >> 36 for r in rows}) == 7
    short = [x[0] for x in groups.values() if sum(x) != 8192]
    assert len(short) == len(set(short)) and all(sum(x) <= 8192 for x in groups.values()) and len(groups) > 10


def test_special_strings_and_long_texts(spark):
    rng, untouched = random.Random(3), Tokenizer.from_file(PATH)
    long = data.prose(rng, 60) + " <|endoftext|>" + " ".join(rng.choice(data.WORDS) for _ in range(400_000))
    docs = [(1, "x <|endoftext|> y"), (2, "<|endoftext|>"), (3, "a<|endoftext|>b\n<|endoftext|> \n"), (4, long), (5, " ".join(rng.choice(data.OTHER) for _ in range(400_000)))]
    want = {d: untouched.encode(t, add_special_tokens=False).ids for d, t in docs}
    assert len(want[1]) == 4 and len(long) > 2_000_000
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = {r.doc_id: (r.n_tokens, r.ids_crc32) for r in token_files.token_files(df, PATH).collect()}
    assert got == {d: (len(x) + 1, crc([*x, 2])) for d, x in want.items()}
    rows = pack(df, PATH).collect()
    for r in rows:
        assert r.ids_crc32 == crc([*want[r.doc_id], 1][r.start : r.start + r.length]) and r.doc_tokens == len(want[r.doc_id]) + 1
    check_pieces(rows, sum(len(x) + 1 for x in want.values()))
