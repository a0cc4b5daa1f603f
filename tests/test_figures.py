import math
import random

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from docstrata.operators import evaluation, lookups, stats
from docstrata.sources import store
from docstrata.streaming import feed, maintain

RUNS = "query_id int, doc_id string, score double, rank int"


def judged(spark, results, relevant):
    runs = spark.createDataFrame(
        [(q, d, 1.0 - 0.1 * n, n + 1) for q, docs in results.items() for n, d in enumerate(docs)], RUNS
    )
    qrels = spark.createDataFrame([(q, d) for q, docs in relevant.items() for d in docs], "query_id int, doc_id string")
    queries = spark.createDataFrame([(q,) for q in relevant], "query_id int")
    return lookups.with_relevance(runs, qrels), lookups.relevant_counts(queries, qrels)


def values(frame, column):
    return {r["query_id"]: r[column] for r in frame.collect()}


def test_hand_computed_metrics(spark):
    run, queries = judged(
        spark,
        {1: ["doc1", "doc2", "doc3", "doc4"], 2: ["doc4", "doc1"], 3: ["doc5", "doc6"]},
        {1: {"doc1", "doc3"}, 2: {"doc1"}, 3: {"doc1", "doc2"}, 4: {"doc9"}},
    )
    assert values(evaluation.precision_at(run, queries, 1), "precision") == {1: 1.0, 2: 0.0, 3: 0.0, 4: 0.0}
    assert values(evaluation.precision_at(run, queries, 3), "precision")[1] == pytest.approx(2 / 3)
    assert values(evaluation.precision_at(run, queries, 0), "precision")[1] == 0.0
    assert values(evaluation.precision_at(run, queries, 5), "precision")[2] == 0.5
    assert values(evaluation.recall_at(run, queries, 3), "recall") == {1: 1.0, 2: 1.0, 3: 0.0, 4: 0.0}
    assert values(evaluation.reciprocal_rank(run, queries), "rr") == {1: 1.0, 2: 0.5, 3: 0.0, 4: 0.0}
    first_two = queries.where("query_id <= 2")
    assert evaluation.mrr(run, first_two).first()["mrr"] == 0.75
    overall = evaluation.overall_report(run.where("query_id <= 2"), first_two).first()
    assert overall["p1"] == 0.5 and overall["mrr"] == 0.75 and overall["queries"] == 2


def test_recall_of_rows_and_of_documents(spark):
    run, queries = judged(spark, {1: ["a", "a", "b"]}, {1: {"a"}})
    assert values(evaluation.recall_at(run, queries, 3), "recall") == {1: 2.0}
    assert values(evaluation.recall_at(run, queries, 3, distinct_docs=True), "recall") == {1: 1.0}


@pytest.mark.parametrize(
    "p1,p3,rr,name,gate",
    [(0.8, 0.9, 0.85, "EXCELLENT", True), (0.8, 0.9, 0.8, "VERY GOOD", True), (0.6, 0.75, 0.65, "GOOD", False),
     (0.5, 0.65, 0.1, "FAIR", False), (0.9, 0.5, 0.9, "POOR", False)],
)
def test_grades(spark, p1, p3, rr, name, gate):
    row = evaluation.grade(spark.createDataFrame([(p1, p3, rr)], "p1 double, p3 double, mrr double")).first()
    assert (row["grade"], row["gate_passed"]) == (name, gate)


def test_histogram_edges(spark):
    run = spark.createDataFrame([(x,) for x in (0.0, 0.199999, 0.2, 0.8, 1.0)], "score double")
    got = {r["bin"]: r["hits"] for r in evaluation.score_histogram(run).collect()}
    assert got == {"0.0-0.2": 2, "0.2-0.4": 1, "0.4-0.6": 0, "0.6-0.8": 0, "0.8-1.0": 2}


def percentile(values_, p):
    return sorted(values_)[math.floor(len(values_) * p)]


@pytest.mark.parametrize("seed", [2, 5])
def test_latency_of_a_hot_group(spark, seed):
    """Heavy tails over thirty decades, heavy ties, a constant group and a single value."""
    rng = random.Random(seed)
    groups = {
        "hot": [rng.choice([1.0, 2.0, 2.0, 1e9 * rng.random(), rng.random()]) for _ in range(3000)],
        "tail": [10 ** rng.uniform(-16, 15) for _ in range(2000)],
        "flat": [7.0] * 50,
        "one": [-3.5],
        "few": [-1.0, 0.0, 5.0],
    }
    frame = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "op string, ms double")
    for row in stats.latency_stats(frame.repartition(5), "op").collect():
        vs = groups[row["op"]]
        assert (row["samples"], row["min"], row["max"]) == (len(vs), min(vs), max(vs))
        assert [row["p50"], row["p95"], row["p99"]] == [percentile(vs, p) for p in (0.5, 0.95, 0.99)]


def test_breakdown_and_bottlenecks(spark):
    profile = spark.createDataFrame(
        [("embedding", 50.0, True), ("parsing", 30.0, True), ("dbWrite", 15.0, True), ("hashCheck", 5.0, True),
         ("total", 100.0, True), ("parsing", 0.0, True), ("parsing", 99.0, False)],
        "op string, ms double, ok boolean",
    )
    table = stats.operation_breakdown(profile)
    assert {r["op"]: r["percent"] for r in table.collect()} == {
        "embedding": 50.0, "parsing": 30.0, "dbWrite": 15.0, "hashCheck": 5.0,
    }
    assert [r["op"] for r in stats.bottlenecks(table).collect()] == ["embedding"]


def walk(ops):
    total = 0
    for op in ops:
        total = max(0, total + (1 if op == "add" else -1 if op == "unlink" else 0))
    return total


EVENTS = "folder string, op string, ts timestamp, event_id long"


def event_rows(ops):
    from datetime import datetime, timedelta

    start = datetime(2024, 1, 1)
    return [("/f", op, start + timedelta(seconds=20 * i), i) for i, op in enumerate(ops)]


@settings(max_examples=12, deadline=None)
@given(ops=st.lists(st.sampled_from(["add", "unlink", "unlink", "change"]), min_size=1, max_size=40))
def test_totals_never_fall_below_zero(spark, ops):
    rows = feed.folder_totals(spark.createDataFrame(event_rows(ops), EVENTS)).collect()
    assert [r["total"] for r in rows] == ([walk(ops)] if set(ops) - {"change"} else [])


def test_totals_over_micro_batches(spark, tmp_path):
    rng = random.Random(1)
    ops = [rng.choice(["add", "unlink"]) for _ in range(60)]
    rows = event_rows(ops)
    source = tmp_path / "events"
    for n in range(3):
        spark.createDataFrame(rows[20 * n : 20 * n + 20], EVENTS).coalesce(1).write.mode("append").parquet(str(source))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(source))
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("folder", T.StringType()), T.StructField("total", T.LongType())])
    totals = store.SnapshotTable(spark, str(tmp_path / "totals"), schema, "folder", "folder", None, buckets=2)
    totals.create()
    maintain.maintain_totals(stream, totals, str(tmp_path / "progress")).awaitTermination()
    assert [r["total"] for r in totals.read().collect()] == [walk(ops)]


def test_status_line(spark):
    counters = spark.createDataFrame([("queued", 2), ("processing", 1), ("done", 9)], "state string, files long")
    assert feed.status_line(counters).first()["line"] == "Indexing (3 remaining)"
    assert feed.status_line(counters.where("state = 'done'")).first()["line"] == "Ready"


def test_debounce_keeps_the_last_operation(spark):
    events = spark.createDataFrame(
        [("/a", "add", 0, 1), ("/a", "change", 500, 2), ("/a", "unlink", 500, 3), ("/a", "add", 5000, 4)],
        "path string, op string, ms long, event_id long",
    ).withColumn("ts", F.timestamp_millis("ms"))
    rows = feed.debounce(events).orderBy("opened").collect()
    assert [(r["op"], r["changes"]) for r in rows] == [("unlink", 3), ("add", 1)]


def test_no_slice_of_a_heavy_tail_is_ranked_whole(spark):
    """The one hot group lies in several slices, and each percentile ranks one of them."""
    rng = random.Random(1)
    frame = spark.createDataFrame([("g", rng.lognormvariate(0, 9)) for _ in range(4000)], "op string, ms double")
    plan = stats.latency_stats(frame, "op")._jdf.queryExecution().executedPlan().toString()
    assert "slice" in plan and "Window" in plan
    row = stats.latency_stats(frame, "op").first()
    assert row["samples"] == 4000 and row["p50"] < row["p95"] < row["p99"] <= row["max"]


def test_slope_of_a_constant_over_many_rows(spark):
    """Merged partial means of 200 000 ones are not exactly one."""
    points = spark.range(200_000, numPartitions=7).selectExpr("'a' as g", "1 as x", "id % 97 * 1.1D as y")
    varied = spark.createDataFrame([("b", x, 3.0 * x + 1) for x in range(5)], "g string, x int, y double")
    hollow = spark.createDataFrame([("c", 1, 2.0), ("c", 2, None), ("c", 1, 5.0)], "g string, x int, y double")
    rows = points.unionByName(varied).unionByName(hollow)
    assert sorted(map(tuple, stats.slope(rows, "x", "y", "g").collect())) == [("a", 0.0), ("b", pytest.approx(3.0)), ("c", 0.0)]
