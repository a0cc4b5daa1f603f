"""Hard negatives against all pairs, scored in plain integers."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docstrata.llm import negatives

DDL = "vec_id long, label int, embedding array<double>, v string, means int"


def brute(rows, every=100, positives=5, k=10):
    held = {}
    for vec_id, label, vec in rows:
        if vec_id is None or label is None or vec is None or any(x is None or not math.isfinite(x) for x in vec):
            continue
        v = [math.floor(256 * x) for x in vec]
        held[vec_id] = min(held.get(vec_id, (label, v)), (label, v))
    ends = -(1 << 63), (1 << 63) - 1
    out = []
    for a, (la, va) in held.items():
        if a % every:
            continue
        scored = [(-min(max(sum(x * y for x, y in zip(va, v)), ends[0]), ends[1]), b, lb) for b, (lb, v) in held.items() if b != a]
        scored.sort()
        for ps, p, _ in [x for x in scored if x[2] == la][:positives]:
            fit = [(s, b) for s, b, lb in scored if lb != la and 30 * -ps <= 100 * -s <= 90 * -ps][:k]
            out += [(a, p, r + 1, b, -ps, -s) for r, (s, b) in enumerate(fit)]
    return sorted(out)


def run(spark, rows, **options):
    frame = spark.createDataFrame([(i, y, v, "x", 7) for i, y, v in rows], DDL)
    return sorted(tuple(r) for r in negatives.mine_negatives(frame, **options).collect())


def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, dims))
    v = centres[rng.integers(0, 6, n)] * rng.uniform(0.2, 1, (n, 1)) + rng.normal(size=(n, dims)) * 0.3
    v[: n // 3] = np.round(v[: n // 3])  # ties
    v[n // 2 : n // 2 + 40] = v[n // 2]  # copies
    return [(int(i), int(y), [float(x) for x in row]) for i, y, row in zip(rng.permutation(n), rng.integers(0, 4, n), v)]


@pytest.mark.parametrize("dims,parts", [(64, 1), (10, 3), (3, 2)])
def test_clusters_ties_and_copies(spark, monkeypatch, dims, parts):
    """In one block, and over a grid of several blocks on both sides."""
    monkeypatch.setattr(negatives, "_sides", lambda *_: (parts, parts + 1))
    rows = clustered(1200, dims, dims)
    got = run(spark, rows, anchor=F.col("vec_id") % 30 == 0)
    assert got == brute(rows, 30) and got


def test_edges(spark):
    rng = random.Random(5)
    rows = [(i, i % 3, [rng.uniform(-1, 1) for _ in range(5)]) for i in range(1, 60)]
    rows += [(100, 1, [1.0, 0.5, 0.25, 0.1, 0.0]), (200, 2, [0.0] * 5), (300, 9, [1.0] * 5), (None, 1, [1.0] * 5), (400, None, [1.0] * 5),
             (500, 1, None), (600, 1, [1.0, None, 1.0, 1.0, 1.0]), (700, 1, [float("nan")] * 5), (800, 1, [float("inf")] + [0.0] * 4),
             (1000, 1, []), (1100, 1, [2.0, 1.0]), (100, 2, [9.0] * 5), (7, 1, [0.1] * 5), (7, 1, [0.1] * 5), (1200, 4, [1e9] * 5),
             (1201, 4, [2e9] * 5), (1202, 5, [1.5e9] * 5)]
    assert run(spark, rows) == brute(rows)
    assert run(spark, []) == [] and run(spark, rows[:59]) == []


@pytest.mark.parametrize("dims", [1, 7, 64])
def test_bounds_hold_at_every_level(dims):
    rng = np.random.default_rng(dims)
    v = np.floor(rng.normal(size=(80, dims)) * 200).astype(np.int64)
    means, deviations = negatives.summaries(v.astype(float))
    table = pa.table({"vec_id": np.arange(80), "label": np.zeros(80, np.int32), "v": pa.array(v.tolist(), pa.list_(pa.int64())),
                      "means": pa.array(means.tolist()), "deviations": pa.array(deviations.tolist())})
    block = negatives.Block(table, dims, int(np.abs(v).max()))
    exact, widths = v @ v.T, []
    for level in range(len(negatives.LEVELS)):
        low, high = negatives._bounds(block, slice(0, 80), block, level)
        assert (low <= exact).all() and (exact <= high).all()
        widths.append((high - low).sum())
    assert widths[0] >= widths[1] >= widths[2]


def test_bounds_leave_few_pairs_open_in_clusters():
    """Vectors with structure along the segments are mostly excluded without an exact score."""
    rng = np.random.default_rng(3)
    v = np.repeat(rng.integers(-100, 100, (1000, 16)), 4, axis=1) + rng.integers(-3, 4, (1000, 64))
    means, deviations = negatives.summaries(v.astype(float))
    table = pa.table({"vec_id": np.arange(1000), "label": np.zeros(1000, np.int32), "v": pa.array(v.tolist(), pa.list_(pa.int64())),
                      "means": pa.array(means.tolist()), "deviations": pa.array(deviations.tolist())})
    block, scored = negatives.Block(table, 64, 110), []
    found = negatives.positives_of(block, block, 5)
    assert len(found) == 5000
    for r, at, scores in negatives.refined(block, block, lambda rows: np.ones((rows.stop - rows.start, 1000), bool),
                                           lambda _: (np.array([2e5]), np.array([np.inf])), lambda r, s, _: s):
        scored.append(len(at))
        assert ((v @ v[r] >= 2e5) <= np.isin(np.arange(1000), at)).all()
    assert sum(scored) < 0.2 * 1e6
