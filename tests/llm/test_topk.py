import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from idloom.llm import topk

SCHEMA = "vec_id long, embedding array<float>, score int, rank string"


def brute(rows, k=20, step=20):
    vs = []
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            vs.append((i, [math.floor(64 * float(np.float32(x))) for x in v]))
    out = []
    for i, q in vs:
        if i % step == 0:
            best = sorted((-sum(a * b for a, b in zip(q, c)), j) for j, c in vs if j != i)[:k]  # noqa: B905
            out += [(i, n + 1, j, max(-(1 << 63), min((1 << 63) - 1, -s))) for n, (s, j) in enumerate(best)]
    return sorted(out)


def run(spark, rows, k=20, step=20, block=4096):
    df = spark.createDataFrame([(i, v, 1, "x") for i, v in rows], SCHEMA)
    return sorted(tuple(r) for r in topk.top_k(df, F.col("vec_id") % step == 0, k=k, block=block).collect())


@pytest.mark.parametrize("spread", [0.1, 1.5])
def test_against_brute_force(spark, spread):
    r = random.Random(8)
    rows = [(i, [r.gauss(0, 1) * s for _ in range(24)]) for i in range(700) for s in [math.exp(r.gauss(0, spread))]]
    assert run(spark, rows, block=10) == run(spark, rows) == brute(rows)


def test_pruned_buckets(monkeypatch):
    monkeypatch.setattr(topk, "BUCKET", 32)
    r = np.random.default_rng(2)
    v = np.floor(64 * r.normal(size=(800, 32)) * np.exp(r.normal(size=(800, 1))))
    ids = np.arange(800)
    best = topk.retrieve(ids[:40], v[:40], ids, v, 7)
    for q in range(40):
        want = sorted((-int(v[q] @ v[c]), c) for c in range(800) if c != q)[:7]
        assert list(zip((-best.scores[q]).tolist(), best.ids[q].tolist(), strict=True)) == want


def test_odd_vectors(spark):
    rows = [(0, [1.0, 2.0]), (20, None), (40, [1.0, None]), (60, [float("nan"), 1.0]), (80, [float("inf"), 0.0]), (None, [1.0, 1.0]), (100, []), (1, [0.5]), (2, [1.0, 2.0, 3.0]), (3, [-1.0, -1.0]), (4, [1.0, 2.0]), (5, [1.0, 2.0])]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == []
    big = [(0, [3e37, -3e37]), (1, [3e37, 1.0]), (2, [1e20, 1e20]), (20, [1e8, 1e8]), (3, [1e9, 1.0])]
    assert run(spark, big) == brute(big)


def test_ties_and_repeats(spark):
    rows = [(i, [1.0, 0.0]) for i in range(1, 60)] + [(7, [1.0, 0.0])]
    assert run(spark, rows, k=3) == [(20, 1, 1, 4096), (20, 2, 2, 4096), (20, 3, 3, 4096), (40, 1, 1, 4096), (40, 2, 2, 4096), (40, 3, 3, 4096)]
    twice = [(0, [1.0]), (0, [2.0]), (1, [1.0]), (2, [3.0])]
    assert run(spark, twice, k=2) == sorted([(0, 1, 2, 12288), (0, 2, 1, 4096), (0, 1, 2, 24576), (0, 2, 1, 8192)])
