"""Hard negatives and the threshold index against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from catalogspark.llm import negatives as n

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def brute(rows, every=100, k=5, scale=256):
    clean = [(i, [int(np.floor(scale * float(x))) for x in v], label) for i, v, label in rows
             if i is not None and label is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    asked = {}
    for i, v, label in clean:
        if i % every == 0:
            asked[i] = min(asked.get(i, (label, v)), (label, v))
    out = []
    for a, (label, q) in asked.items():
        found = [(-sum(x * y for x, y in zip(q, v)), i, other) for i, v, other in clean if i != a and len(v) == len(q)]
        for s, i, _ in sorted(f for f in found if f[2] == label)[:k]:
            inside = sorted((t, j) for t, j, other in found if other != label and 80 * -s <= 100 * -t <= 100 * -s)[:k]
            out += [(a, i, rank + 1, j, -s, -t) for rank, (t, j) in enumerate(inside)]
    return sorted(out)


def vectors(rng, n_rows, dims, labels=4, spread=0.2):
    centres = [[rng.gauss(0, 1) for _ in range(dims)] for _ in range(labels)]
    return [(i, [float(np.float32(c * 0.1 + rng.gauss(0, spread))) for c in centres[rng.randrange(labels)]], rng.randrange(labels)) for i in range(n_rows)]


@pytest.mark.parametrize("dims,ratio", [(64, 100.0), (64, 250.0), (5, 30.0), (5, -1.0), (1, 3.0), (17, 1e9)])
def test_index_leaves_no_pair_out(dims, ratio):
    rng = np.random.default_rng(dims)
    rows, queries = rng.integers(-60, 60, (700, dims)).astype(float), rng.integers(-60, 60, (33, dims)).astype(float)
    rows[:50] = rows[0]
    rows[50] = 0
    norms = np.maximum(np.sqrt((queries ** 2).sum(axis=1)), 1e-9)
    least = np.maximum(ratio * norms, np.quantile(queries @ rows.T, 0.9, axis=1)) if ratio > 0 else np.full(33, -5.0)
    index = n.ThresholdIndex(rows, (least / norms).min())
    q, r = index.candidates(queries, least)
    exact = queries @ rows.T
    assert {(a, b) for a, b in zip(*np.nonzero(exact >= least[:, None]))} <= set(zip(q.tolist(), r.tolist()))
    if ratio == 250.0:
        # Most leading dimensions are not indexed, and most pairs are given up.
        assert index.first.mean() > 10 and len(q) < 0.5 * exact.size


@pytest.mark.parametrize("shard_rows,dims", [(4096, 16), (150, 16), (40, 3)])
def test_equals_brute_force(spark, monkeypatch, shard_rows, dims):
    monkeypatch.setattr(n, "SHARD_ROWS", shard_rows)
    monkeypatch.setattr(n, "GROUP_ANCHORS", 5)
    rng = random.Random(dims)
    rows = vectors(rng, 900, dims)
    rows += [(1000 + i, rows[7][1], 1) for i in range(60)]  # copies and ties
    got = n.hard_negatives(spark.createDataFrame(rows, SCHEMA).repartition(6))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_defined_results(spark):
    rng = random.Random(9)
    rows = vectors(rng, 60, 4, labels=2)
    nan, inf = float("nan"), float("inf")
    rows += [(None, [1.0] * 4, 0), (200, None, 0), (300, [], 0), (400, [1.0, None, 1.0, 1.0], 0), (500, [nan] * 4, 1), (600, [inf] * 4, 1),
             (700, [0.5] * 4, None), (800, [0.0] * 4, 0), (900, [0.5] * 3, 0), (901, [0.5] * 3, 1), (902, [0.5] * 3, 0), (0, [0.3] * 4, 1), (5, rows[5][1], 1), (5, rows[5][1], 1)]
    df = spark.createDataFrame(rows, SCHEMA)
    for c in ("id", "v", "dim", "shard", "rank", "nth"):
        df = df.withColumn(c, F.lit("x"))
    assert sorted(tuple(r) for r in n.hard_negatives(df).collect()) == brute(rows)


def test_negative_and_zero_scores_have_no_window(spark):
    rows = [(0, [1.0, 0.0], 0), (1, [-1.0, 0.0], 0), (2, [-0.9, 0.0], 1), (3, [0.0, 1.0], 0), (4, [0.0, -1.0], 1), (5, [0.0, 0.0], 2)]
    got = sorted(tuple(r) for r in n.hard_negatives(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == brute(rows) == [(0, 3, 1, 4, 0, 0), (0, 3, 2, 5, 0, 0)]


def test_large_numbers_are_exact(spark):
    rows = [(i, [float((i * 7919) % 1000 * 2 ** 20), 2.0 ** 30 * (i % 3), -2.0 ** 30], i % 2) for i in range(40)]
    assert sorted(tuple(r) for r in n.hard_negatives(spark.createDataFrame(rows, SCHEMA), every=20, scale=1).collect()) == brute(rows, every=20, scale=1)


def test_empty(spark):
    assert n.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert n.hard_negatives(spark.createDataFrame([(0, [1.0], 1)], SCHEMA)).count() == 0
