"""Plan shapes that must hold at scale, with broadcasting by size switched off."""

import re

import pytest

import __spark_entry__ as contract

QUERIES = contract.queries()
EAGER = ("s8", "s9", "s10", "w1", "w2", "w3", "w4", "w5", "w6", "w7_folder_totals_stream", "w8_progress", "q6")


def plan_of(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.fixture()
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


@pytest.mark.parametrize("name", sorted(n for n in QUERIES if not n.startswith(EAGER)))
def test_no_cross_joins(name, spark, sf, no_broadcast):
    plan = plan_of(QUERIES[name](spark, sf))
    assert not re.search("CartesianProduct|BroadcastNestedLoopJoin", plan)


def test_listing_reads_no_text(spark, sf):
    plan = plan_of(QUERIES["p7_plan_reindex"](spark, sf))
    assert "text:string" not in plan


def test_topk_limits_before_the_shuffle(spark, sf):
    assert "WindowGroupLimit" in plan_of(QUERIES["q2_batch_topk"](spark, sf))


def test_filter_is_pushed_before_ranking(spark, sf):
    assert "GreaterThanOrEqual(label,5)" in plan_of(QUERIES["q3_filtered_topk"](spark, sf))


def test_chunking_reads_key_and_text_only(spark, sf):
    from docstrata.operators import chunking

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = plan_of(chunking.chunk_sentences(docs, "doc_id"))
    assert "Exchange" not in plan
    assert re.search(r"ReadSchema: struct<doc_id:bigint,text:string>", plan)


def test_remove_folders_reads_a_stored_chunk_table(spark, sf):
    plan = contract.queries()["m5_remove_folders"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "regexp_extract_all" not in plan
