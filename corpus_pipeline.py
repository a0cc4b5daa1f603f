"""A corpus pipeline over `documents`: each stage calls one operator of docstrata.llm on what its predecessor kept.

Every stage is a function of (spark, docs, sf_dir); its result is written as Parquet and read again for the next one.
All stages but the last return the columns of `documents`, extra columns included. Nulls, empty and repeated rows are
treated as the operators say; no stage fails on them or on an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.llm import bpe, decontaminate, line_dedup, minhash, quality
from docstrata.llm.queries import VOCABULARY, table
from docstrata.llm.shared import settle


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail the rules, or whose source does, go."""
    return quality.keep_good(docs)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that a document with a smaller id holds go; every document stays, if only with an empty text. n_chars
    follows the text."""
    name = "deduped" + "_" * max(map(len, docs.columns))  # no column of `docs`
    cleaned = line_dedup.dedup_lines(docs, result=name)
    changed = F.col(f"{name}.n_dropped") > 0
    new = {"text": F.col(f"{name}.text"), "n_chars": F.length(f"{name}.text")}
    kinds = dict(docs.dtypes)
    return cleaned.select(
        *[
            F.when(changed, new[c].cast(kinds[c])).otherwise(F.col(c)).alias(c) if c in new else F.col(f"`{c}`")
            for c in docs.columns
        ]
    )


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays, the one with the smallest id."""
    return minhash.keep_first(docs)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold an item of `benchmark`, as it is or with other parameters, go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids, and the digests of the ids and of the text they decode to."""
    return bpe.digests(bpe.tokenized(docs, VOCABULARY), "ids")


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_benchmark_leaks),
    ("bpe_encoding", encode),
]

#: Near-duplicates over all pairs and byte-pair merges have no SQL form that ends in useful time; the tests hold the
#: rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return docs
