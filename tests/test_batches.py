import math
import sys

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st
from pyspark import cloudpickle

from docstrata.operators import embedding


def greedy(tokens, max_rows, max_tokens):
    ids, batch, rows, total = [], 0, 0, 0
    for t in tokens:
        if rows and (rows == max_rows or total + t > max_tokens):
            batch, rows, total = batch + 1, 0, 0
        rows, total = rows + 1, total + t
        ids.append(batch)
    return ids


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 60), max_size=80), st.integers(1, 8), st.integers(1, 100))
def test_sub_batches_are_greedy(tokens, max_rows, max_tokens):
    spans = embedding.sub_batches(np.array(tokens, dtype=np.int64), max_rows, max_tokens)
    ids = [n for n, (a, b) in enumerate(spans) for _ in range(a, b)]
    assert ids == greedy(tokens, max_rows, max_tokens)


def test_limits_of_a_model_call():
    thirty = [math.ceil(2000 / 2.5)] * 30
    spans = embedding.sub_batches(np.array(thirty))
    assert [b - a for a, b in spans] == [8, 8, 8, 6]
    assert embedding.sub_batches(np.array([16_000])) == [(0, 1)]


@pytest.mark.parametrize("block_rows,group_blocks", [(4, 1), (5, 3), (7, 4096), (64, 2)])
def test_parallel_packing_equals_sequential(spark, block_rows, group_blocks):
    """One key holds most of the rows and spans many blocks."""
    rng = np.random.default_rng(block_rows)
    sizes = {"hot": 403, "a": 1, "b": 4, "c": 5, "d": 9, "e": 64}
    rows = [(k, i, "x" * int(rng.integers(0, 60))) for k, n in sizes.items() for i in range(n)]
    frame = spark.createDataFrame(rows, "path string, n int, text string").repartition(6)
    packed = embedding.pack_batches(frame, "path", "n", max_rows=4, max_tokens=40, block_rows=block_rows, group_blocks=group_blocks)
    got = {(r["path"], r["n"]): r["batch_id"] for r in packed.collect()}
    want = {}
    for key, n in sizes.items():
        tokens = [math.ceil(len(t) / 2.5) for k, _, t in rows if k == key]
        want |= {(key, i): b for i, b in enumerate(greedy(tokens, 4, 40))}
    assert got == want


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Flaky:
    """Fails on its first calls, then works."""

    def __init__(self, failures):
        self.failures = failures

    def embed(self, texts):
        if self.failures:
            self.failures -= 1
            raise RuntimeError("busy")
        return np.ones((len(texts), 4))


def test_retries_and_quarantine(spark):
    frame = spark.createDataFrame([(i, "text") for i in range(5)], "id int, text string").coalesce(1)
    ok, dead = embedding.split_failures(embedding.embed(frame, embedder=lambda: Flaky(3)))
    assert ok.count() == 5 and dead.count() == 0
    assert [round(x, 6) for x in ok.first()["vector"]] == [0.5] * 4
    ok, dead = embedding.split_failures(embedding.embed(frame, embedder=lambda: Flaky(4), max_rows=2))
    assert sorted(r["id"] for r in dead.collect()) == [0, 1]
    assert {r["error"] for r in dead.collect()} == {"RuntimeError: busy"}
    assert embedding.failure_counts(dead, "id").count() == 2


def test_hash_embedder_matches_expression(spark):
    from docstrata.functions import vectors as vx

    raw = embedding.HashEmbedder(30).embed(["passage: hi"])[0]
    assert raw[:8].tolist() == [
        0.6640625, -0.8828125, -0.921875, 0.8125, -0.2734375, -0.3359375, -0.0078125, 0.953125,
    ]
    row = spark.createDataFrame([("passage: hi",)], "t string").select(vx.hash_values("t", 30).alias("v")).first()
    assert row["v"] == raw.tolist()


def test_zero_vector_stays(spark):
    from docstrata.functions import vectors as vx

    row = spark.createDataFrame([([0.0, 0.0],)], "v array<double>").select(vx.l2_normalize("v").alias("v")).first()
    assert row["v"] == [0.0, 0.0]


def test_texts_are_read_once(spark):
    """The rows are used for keys, blocks and numbers; what makes their texts must run once."""
    read = spark.sparkContext.accumulator(0)

    def count(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    rows = spark.range(200).selectExpr("id % 2 as path", "id div 2 as n", "repeat('x', 900) as text")
    packed = embedding.pack_batches(rows.mapInArrow(count, rows.schema), "path", "n", block_rows=32)
    assert packed.count() == 200 and read.value == 200
