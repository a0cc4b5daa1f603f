"""Retrieval-quality metrics over judged runs.

A judged run is `(query_id, doc_id, score, rank, relevant)`, from `lookups.with_relevance` or
`lookups.with_class_relevance`; `queries(query_id, n_relevant)` lists every query, found or not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.frames import attach, values_frame

# Grade, and the least precision at 1, precision at 3 and mean reciprocal rank it asks for.
GRADES = [
    ("EXCELLENT", 0.80, 0.90, 0.85),
    ("VERY GOOD", 0.70, 0.85, 0.75),
    ("GOOD", 0.60, 0.75, 0.65),
    ("FAIR", 0.50, 0.65, 0.0),
]
LOWEST_GRADE = "POOR"

# The release gate.
GATE_P1 = 0.70
GATE_P3 = 0.85

# Score histogram bins; the last one includes its upper end.
SCORE_BINS = [
    ("0.0-0.2", 0.0, 0.2),
    ("0.2-0.4", 0.2, 0.4),
    ("0.4-0.6", 0.4, 0.6),
    ("0.6-0.8", 0.6, 0.8),
    ("0.8-1.0", 0.8, 1.0),
]


def _hits_within(k: int) -> Column:
    return F.count(F.when(F.col("relevant") & (F.col("rank") <= k), 1))


def _precision(k: int) -> Column:
    if k == 0:
        return F.lit(0.0)
    shown = F.least(F.lit(k), F.count("*"))
    return _hits_within(k) / shown


def _per_query(judged: DataFrame, queries: DataFrame, **metrics: Column) -> DataFrame:
    """One grouped aggregate of the runs; queries without results get zeros."""
    measured = judged.groupBy("query_id").agg(*[m.alias(name) for name, m in metrics.items()])
    return (
        queries.select("query_id", "n_relevant")
        .join(measured, "query_id", "left")
        .select("query_id", "n_relevant", *[F.coalesce(name, F.lit(0)).alias(name) for name in metrics])
    )


def precision_at(judged: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Relevant hits in the first k over the hits shown there; 0 without hits."""
    return _per_query(judged, queries, precision=_precision(k)).select("query_id", "precision")


def recall_at(judged: DataFrame, queries: DataFrame, k: int, distinct_docs: bool = False) -> DataFrame:
    """Relevant hits in the first k over the relevant documents; 0 when there are none.

    Hits count once each, so several chunks of one document can lift it above 1; `distinct_docs` counts
    documents instead.
    """
    if distinct_docs:
        inside = judged.where(F.col("relevant") & (F.col("rank") <= k)).select("query_id", "doc_id").distinct()
        counted = _per_query(inside, queries, found=F.count("*"))
    else:
        counted = _per_query(judged, queries, found=_hits_within(k))
    share = F.when(F.col("n_relevant") > 0, F.col("found") / F.col("n_relevant")).otherwise(0.0)
    return counted.select("query_id", share.alias("recall"))


def _reciprocal() -> Column:
    return F.coalesce(1.0 / F.min(F.when(F.col("relevant"), F.col("rank"))), F.lit(0.0))


def reciprocal_rank(judged: DataFrame, queries: DataFrame) -> DataFrame:
    return _per_query(judged, queries, rr=_reciprocal()).select("query_id", "rr")


def mrr(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """Mean reciprocal rank over all queries."""
    return reciprocal_rank(judged, queries).agg(F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr"))


def query_report(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """Per query: precision at 1, 3, 5 and 10, recall at 10, reciprocal rank, scores, relevant found and total."""
    report = _per_query(
        judged,
        queries,
        p1=_precision(1),
        p3=_precision(3),
        p5=_precision(5),
        p10=_precision(10),
        found10=_hits_within(10),
        rr=_reciprocal(),
        avg_score=F.avg("score"),
        found=F.count(F.when(F.col("relevant"), 1)),
        top_relevant=F.max(F.when((F.col("rank") == 1) & F.col("relevant"), 1).otherwise(0)),
    )
    recall = F.when(F.col("n_relevant") > 0, F.col("found10") / F.col("n_relevant")).otherwise(0.0)
    return report.withColumn("r10", recall).drop("found10")


def overall_report(judged: DataFrame, queries: DataFrame) -> DataFrame:
    """One row: means over the queries and score figures over all hits."""
    means = query_report(judged, queries).agg(
        F.count("*").alias("queries"),
        *[F.avg(c).alias(c) for c in ("p1", "p3", "p5", "p10", "r10")],
        F.avg("rr").alias("mrr"),
    )
    scores = judged.agg(
        *[
            F.coalesce(fn("score"), F.lit(0.0)).alias(f"{name}_score")
            for name, fn in (("avg", F.avg), ("min", F.min), ("max", F.max))
        ]
    )
    return attach(means, scores)


def score_histogram(judged: DataFrame) -> DataFrame:
    """`(bin, hits)` for five bins, empty ones included."""
    name = F.lit(None).cast("string")
    for label, low, high in SCORE_BINS:
        inside = (F.col("score") >= low) & (F.col("score") < high)
        if high == 1.0:
            inside = inside | (F.col("score") == 1.0)
        name = F.when(name.isNull() & inside, label).otherwise(name)
    counted = judged.groupBy(name.alias("bin")).agg(F.count("*").alias("hits"))
    bins = values_frame(judged.sparkSession, [(b[0],) for b in SCORE_BINS], "bin string")
    return bins.join(counted, "bin", "left").select("bin", F.coalesce("hits", F.lit(0)).alias("hits"))


def category_report(report: DataFrame, categories: DataFrame) -> DataFrame:
    """Per category of `categories(query_id, category)`: success rate, mean precision at 1 and 3, mean
    reciprocal rank."""
    return (
        report.join(categories, "query_id")
        .groupBy("category")
        .agg(
            F.count("*").alias("queries"),
            F.avg("top_relevant").alias("success_rate"),
            F.avg("p1").alias("p1"),
            F.avg("p3").alias("p3"),
            F.avg("rr").alias("mrr"),
        )
    )


def grade(overall: DataFrame) -> DataFrame:
    """Adds `grade` and whether the release gate is passed."""
    name = F.lit(LOWEST_GRADE)
    for label, p1, p3, rr in reversed(GRADES):
        name = F.when((F.col("p1") >= p1) & (F.col("p3") >= p3) & (F.col("mrr") >= rr), label).otherwise(name)
    passed = (F.col("p1") >= GATE_P1) & (F.col("p3") >= GATE_P3)
    return overall.withColumn("grade", name).withColumn("gate_passed", passed)


def check_bounds(runs: DataFrame, expectations: DataFrame) -> DataFrame:
    """`expectations(query_id, doc_id, min_score, max_score)` against the first hit of the expected document.

    A missing or zero `max_score` sets no upper bound.
    """
    first = runs.groupBy("query_id", "doc_id").agg(F.min_by("score", "rank").alias("score"))
    cases = expectations.join(first, ["query_id", "doc_id"], "left")
    upper = F.coalesce(F.col("max_score"), F.lit(0.0))
    inside = (F.col("score") >= F.col("min_score")) & ((upper == 0.0) | (F.col("score") <= upper))
    return cases.select(
        "query_id",
        "doc_id",
        "score",
        F.coalesce(inside, F.lit(False)).alias("passed"),
        F.when(F.col("score").isNull(), "File not found in results").alias("reason"),
    )
