import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from meshnet.llm import exact_topk as op

SCHEMA = "vec_id long, embedding array<float>, score long, block long"


def brute(rows, k=10):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    least = {}
    for i, v in rows:
        if (i, v) != (None, None) and i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            least[i] = min(least.get(i, v), v)
    out = []
    for q in sorted(i for i in least if i % 100 == 0):
        own = [math.floor(1024 * x) for x in least[q]]
        found = sorted((-max(-(2**63) + 1, min(2**63 - 1, sum(a * b for a, b in zip(own, v, strict=False)))), i) for i, v in good if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


def result(df):
    return sorted(tuple(r) for r in op.top_k(df, F.col("vec_id") % 100 == 0).collect())


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0) for i, v in rows], SCHEMA).repartition(3)


def floats(table):
    return [[float(np.float32(x)) for x in row] for row in table]


@pytest.mark.parametrize("dim", [1, 8, 64])
def test_same_as_brute_force(spark, dim):
    rng = np.random.default_rng(dim)
    rows = list(enumerate(floats(rng.normal(0, 0.2, (900, dim)))))
    rows += [(1000 + i, rows[0][1]) for i in range(30)]  # copies of a query: ties
    assert result(frame(spark, rows)) == brute(rows)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (100, [-1.0, 0.5, 3.0]), (200, [nan, 1.0]), (300, [inf]), (400, None), (500, []), (1, [None, 1.0]),
            (2, [0.25, 0.5]), (3, [0.25, 0.5]), (3, [0.25, 0.5]), (None, [9.0, 9.0]), (0, [1.0, 2.0]), (600, [2.0**40, -(2.0**40)]), (4, [2.0**40, 1.0])]
    assert result(frame(spark, rows)) == brute(rows)
    wide = spark.createDataFrame([(*r, 0) for r in rows] if len(rows[0]) > 2 else rows, "vec_id long, embedding array<double>")
    huge = spark.createDataFrame([(7, [1e306, 1.0]), (700, [-1.7e308]), (800, [1e-320, 5e305])], "vec_id long, embedding array<double>")
    picked = F.col("vec_id") % 100 == 0
    with_huge = op.top_k(wide.unionByName(huge), picked).collect()
    assert sorted(map(tuple, with_huge)) == sorted(map(tuple, op.top_k(wide, picked).collect()))
    assert result(frame(spark, rows[:1])) == [] and result(frame(spark, [])) == []


def test_small_groups(spark, monkeypatch):
    for name, value in (("BLOCK", 16), ("SEGMENT", 3), ("QUERIES", 2), ("SORTED", 240)):
        monkeypatch.setattr(op, name, value)
    rows = list(enumerate(floats(np.random.default_rng(0).normal(0, 0.2, (700, 6)))))
    assert result(frame(spark, rows)) == brute(rows)


def test_terms_that_cancel(spark):
    """A bound far below the terms of its sum: rounding takes more than the bound itself."""
    big = 2.0**21
    rows = [(0, [big, 1 / 1024, big]), (1, [big, 300 / 1024, -big]), (2, [0.0, 100 / 1024, 0.0]), (3, [0.0, 200 / 1024, 0.0])]
    assert result(frame(spark, rows)) == brute(rows)


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 6), st.integers(1, 4))
def test_search_of_large_components(seed, dim, k):
    """Components up to 2^40 in pairs that cancel, so that scores are small beside their terms."""
    rng = np.random.default_rng(seed)
    half = np.floor(rng.normal(0, 2.0 ** rng.integers(0, 41), (24, dim)))
    table = np.concatenate([half, -half + rng.integers(-3, 4, half.shape)], axis=1)[rng.permutation(24)]
    table[:, :dim], table[:, dim:] = (table[:, rng.permutation(2 * dim)][:, c] for c in (slice(dim), slice(dim, None)))
    queries = np.tile(np.floor(rng.normal(0, 2.0 ** rng.integers(0, 41), (2, dim))), 2)
    blocks = [(np.arange(i, i + 4), table[i : i + 4], table[i : i + 4].max(axis=0), table[i : i + 4].min(axis=0)) for i in range(0, 24, 4)]
    clip = lambda x: max(-(2**63) + 1, min(2**63 - 1, x))
    for floored in (False, True):
        floors = op._floors(np.array([-1, 5]), queries, blocks[1][0], blocks[1][1], k) if floored else None
        best, who, _ = op.search(np.array([-1, 5]), queries, blocks, k, floors)
        for q, own, scores, names in zip(queries, (-1, 5), best.tolist(), who.tolist(), strict=True):
            every = sorted((-clip(sum(int(a) * int(b) for a, b in zip(q, v, strict=True))), i) for i, v in enumerate(table) if i != own)
            assert [(-s, i) for s, i in zip(scores, names, strict=True)] == every[:k]


def test_floors_go_with_queries(spark, monkeypatch):
    """Copies fill a query's own block, so its floor leaves out all other blocks."""
    rng = np.random.default_rng(2)
    rows = list(enumerate(floats(rng.normal(0, 0.01, (1500, 8)))))
    rows += [(2000 + i, [1.0] * 8) for i in range(300)]
    assert result(frame(spark, rows)) == brute(rows)
    table = np.array([[1.0, 2.0], [3.0, 4.0], [5.0, 6.0]])
    got = op._floors(np.array([7]), np.array([[1.0, 1.0]]), np.array([7, 8, 9]), table, 2)
    assert got.tolist() == [7] and op._floors(np.array([7]), table[:1], np.array([7]), table[:1], 2).tolist() == [op._NONE]


def test_blocks_beyond_the_bound_are_not_scored():
    rng = np.random.default_rng(4)
    blocks = []
    for b in range(20):
        table = np.floor(100 * rng.normal(b, 0.01, (16, 3)))
        blocks.append((np.arange(16) + 16 * b, table, table.max(axis=0), table.min(axis=0)))
    queries = np.array([[1.0, 1.0, 1.0]])
    best, who, scored = op.search(np.array([-1]), queries, blocks, 10)
    assert scored == 1 and set(who[0]) <= set(range(304, 320))
    every = np.concatenate([b[1] for b in blocks]) @ queries[0]
    assert best[0].tolist() == sorted(every, reverse=True)[:10]
