"""Small cases with known answers: bases of chains, candidates, ignore rules."""

import pytest
from pyspark.sql import functions as F

from siltstone.functions import scalar
from siltstone.operators import content, history


def test_chain_that_turns_back(spark):
    rows = [(1, 2), (2, 3), (3, 1), (5, 6), *((k, k + 1) for k in range(10, 22))]
    got = {r.id: (r.root, r.depth, r.ok) for r in history.chains(spark.createDataFrame(rows, "id long, base long")).collect()}
    assert all(got[k] == (None, None, False) for k in (1, 2, 3, 10, 11))
    assert got[5] == (6, 1, True) and got[12] == (22, 10, True) and got[21] == (22, 1, True)


def test_best_bases(spark):
    """An item's base is among the 50 before it; ties go to the newest."""
    rows = [(k, "a", 100, [1, 2, 3]) for k in range(1, 200)] + [(200, "a", 100, [1, 2, 9]), (201, "b", 100, [1, 2, 3]), (202, "a", 10, [1, 2, 3])]
    got = {r.id: (r.base, r.score) for r in content.best_bases(spark.createDataFrame(rows, "id long, type string, size long, samples array<long>")).collect()}
    assert all(got[k] == (k - 1, 1.0) for k in range(2, 200))
    assert got[200][0] == 199 and got[200][1] == pytest.approx(0.7 * 2 / 3 + 0.3, abs=1e-6)
    assert set(got) == set(range(2, 201))


def test_ignored(spark):
    rules = ["*.log", "!keep.log", "build/", "/top"]
    want = {"a.log": True, "x/keep.log": False, "build/keep.log": True, "x/build/a.c": True, "build": False, "top": True, "x/top": False, "a.c": False}
    got = spark.createDataFrame([(p,) for p in want], "p string").select("p", scalar.ignored(F.col("p"), rules).alias("i")).collect()
    assert {r.p: r.i for r in got} == want
