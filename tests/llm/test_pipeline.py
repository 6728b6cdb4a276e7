"""run() on small tables against a brute-force chain of its five stages."""

import random
from itertools import combinations

from tokenizers import Tokenizer

import corpus_pipeline
from siltstone.llm import langid, linededup
from siltstone.llm.token_files import default_vocabulary

from . import data
from .test_dedup import brute_fingerprint, groups
from .test_text import brute_contamination
from .test_tokens import check_pieces, crc


def by_language(docs, model):
    got = {d: langid.Labeller(model).label([t or ""])[0] for d, t in docs}
    return [(d, t) for d, t in docs if got[d][0] != "und" and got[d][1] >= 0.5]


def by_lines(docs):
    cut = {d: t.split("\n") for d, t in docs}
    lines = sorted({x.strip() for ls in cut.values() for x in ls} - {""})
    sets = [linededup.shingles(linededup.normal(x)) for x in lines]
    root = groups(range(len(lines)), [(a, b) for a, b in combinations(range(len(lines)), 2) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])])
    at, seen, out = {x: root[i] for i, x in enumerate(lines)}, set(), []
    for d, _ in sorted(docs):
        left = []
        for x in cut[d]:
            if x.strip() and at[x.strip()] in seen:
                continue
            if x.strip():
                seen.add(at[x.strip()])
            left.append(x)
        if any(x.strip() for x in left) or not any(x.strip() for x in cut[d]):
            out.append((d, "\n".join(left)))
    return out


def by_fingerprint(docs):
    fp = {d: brute_fingerprint(t) for d, t in docs}
    root = groups(set(fp.values()), [(a, b) for a, b in combinations(sorted(set(fp.values())), 2) if (a ^ b).bit_count() <= 4])
    least = {}
    for d, _ in sorted(docs):
        least.setdefault(root[fp[d]], d)
    return [(d, t) for d, t in docs if d in least.values()]


def test_run_equals_brute_force(spark, tmp_path):
    rng = random.Random(21)
    bench = [(i, data.prose(rng, 25)) for i in range(4)]
    rows = [(r[0], r[1], r[2], r[3]) for r in data.rows()[:67]]
    assert len({r[0] for r in rows}) == 67
    header = "this line of a header is repeated at the top of a good many documents of the corpus"
    flat = [(i, " ".join(data.prose(rng, 120).split())) for i in range(300, 306)]
    rows += [(i, t, "en", "s") for i, t in flat] + [(i + 10, "\n".join(" ".join(t.split()[k : k + 8]) for k in range(0, 120, 8)), "en", "s") for i, t in flat]  # the same words, other lines
    rows += [(200 + i, f"{header}\n{data.prose(rng, 60)}", "en", "s") for i in range(8)] + [(220, header, "en", "s"), (221, header + "!", "en", "s")]
    rows += [(240 + i, f"{data.prose(rng, 30)} {' '.join(t.split())} {data.prose(rng, 30)}", "en", "s") for i, t in bench]
    spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()

    steps = [[(r[0], r[1]) for r in rows]]
    steps.append(by_language(steps[-1], langid.learn(spark.read.parquet(f"{tmp_path}/documents.parquet"))))
    steps.append(by_lines(steps[-1]))
    steps.append(by_fingerprint(steps[-1]))
    hit = {w[0] for w in brute_contamination(steps[-1], bench) if w[5]}
    steps.append([(d, t) for d, t in steps[-1] if d not in hit])
    sizes = [len(x) for x in steps]
    assert sizes == sorted(set(sizes), reverse=True) and len(corpus_pipeline.STAGES) == len(sizes)  # each stage has work
    tok = Tokenizer.from_file(default_vocabulary())
    ids = {d: [*tok.encode(t, add_special_tokens=False).ids, 1] for d, t in steps[-1]}
    assert {r.doc_id for r in got} == set(ids)
    for d, own in ids.items():
        parts = sorted((r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got if r.doc_id == d)
        assert sum(p[1] for p in parts) == len(own) and [p[0] for p in parts] == [sum(p[1] for p in parts[:k]) for k in range(len(parts))]
        assert all(c == crc(own[s : s + n]) and total == len(own) for s, n, c, total in parts)
    check_pieces(got, sum(map(len, ids.values())))
