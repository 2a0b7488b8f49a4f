"""Exact top-k search against brute force in Python's integers."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sightline.llm import exact_topk

SCHEMA = "vec_id long, embedding array<double>, score string, block int, id string"


def _brute(rows, k):
    usable = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    clip = lambda x: max(-exact_topk.LARGEST, min(exact_topk.LARGEST, x))
    out = []
    for q, a in usable:
        if q % 50 == 0:
            best = sorted((-clip(sum(clip(x) * clip(y) for x, y in zip(a, b))), c) for c, b in usable if c != q)[:k]
            out += [(q, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    return sorted(out)


def _found(spark, rows, k=5, parts=3):
    df = spark.createDataFrame([(i, v, "s", 1, "x") for i, v in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, exact_topk.top_matches(exact_topk.integer_vectors(df), F.col("id") % 50 == 0, k).collect()))


@pytest.mark.parametrize("spread", [0.2, 40.0, 1e7])
def test_equals_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(exact_topk, "CANDIDATE_ROWS", 64)
    monkeypatch.setattr(exact_topk, "QUERY_ROWS", 4)
    rng = random.Random(int(spread))
    rows = [(i, [rng.gauss(0, spread) for _ in range(8)]) for i in range(-100, 400)]
    rows += [(1000 + i, rows[i % 7][1]) for i in range(200)]  # many ties
    assert _found(spark, rows) == _brute(rows, 5)


def test_beyond_the_floats(spark):
    rng = random.Random(4)
    rows = [(i, [rng.choice([1e300, -3e5, 7e6, 2.0**48, -(2.0**50)]) if rng.random() < 0.3 else rng.random() for _ in range(4)]) for i in range(120)]
    assert _found(spark, rows) == _brute(rows, 5)


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, None), (2, [None, 1.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, []), (6, [1.0]), (7, [0.5, -1.0, 9.0]), (None, [1.0, 1.0]), (50, [1.0, 2.0]), (8, [1.0, 2.0]), (8, [1.0, 2.0])]
    assert _found(spark, rows) == _brute(rows, 5)
    assert [r for r in _found(spark, rows, k=2) if r[0] == 0] == [(0, 1, 8, 327680), (0, 2, 8, 327680)]
    assert _found(spark, [(0, [1.0])]) == [] and _found(spark, [(3, [1.0])]) == []
    assert _found(spark, [(0, [1.0]), (1, [2.0])]) == [(0, 1, 1, 131072)]
    empty = spark.createDataFrame([], SCHEMA)
    assert exact_topk.top_matches(exact_topk.integer_vectors(empty), F.col("id") % 50 == 0).count() == 0


def test_all_equal_vectors(spark):
    rows = [(i, [1.0, 1.0]) for i in range(300)]
    assert _found(spark, rows) == _brute(rows, 5)
