"""Small tables with the cases that every operator must bear: nulls, empty and long texts, ties, repeated rows, clashing columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, hits string, at_file string, h string, word_list string"
WORDS = "the of and river stone light green mountain walked quietly under bright morning children apples window garden table yellow paper winter summer house letter music".split()
OTHER = "der und die Straße über grün ein nicht Wald schön früh Kinder Äpfel Fenster Garten Tisch gelb Papier Winter Sommer Haus Brief Musik für".split()


def prose(rng, n, words=WORDS):
    out = []
    for i in range(n):
        out.append(rng.choice(words) + rng.choice(["", "", "", "", ",", ".", ".\n"]))
    return " ".join(out)


def rows(seed=3, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        de = i % 3 == 0
        out.append((i, prose(rng, rng.randint(30, 200), OTHER if de else WORDS), "de" if de else "en", f"src{i % 4}"))
    base = out[1][1]
    out += [(100, base, "en", "src0"), (101, base, "en", "src1"), (102, base.replace("river", "lake", 1), "en", "src2")]
    out += [(103, None, "en", "src1"), (104, "", "en", None), (105, " \n\t ", None, "src1"), (106, "123 456 !!!", None, "src2")]
    out += [(107, "x", "en", "src2"), (107, "x", "en", "src2"), (108, prose(rng, 6000), "en", "src3"), (None, prose(rng, 80), "en", "src3"), (109, prose(rng, 80), None, None)]
    out += [(110, "a  b \n c  d \t e", "en", "src0"), (111, "Ünï😀code　text Ärger ÄÖ <|endoftext|>", "de", "src0")]
    return [(*r, None if r[1] is None else len(r[1]), 5, "hit", "f", "h", None) for r in out]


def table(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
