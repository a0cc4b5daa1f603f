"""The registered queries opN_<name>, each over its whole table, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import public_tokenizers

from docstrata.llm import (
    bpe, decontaminate, language, licenses, line_dedup, lm, minhash, negatives, page_text, quality, resample, revisits,
    substrings,
)

#: The tokenizer file; every executor has the package.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).select(
        "doc_id", "license", F.round("dice", 6).alias("dice"),
        F.array_join("licenses", ",").alias("licenses"), F.size("matches").alias("n_matches"),
    )


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "deduped.n_lines", "deduped.n_dropped", F.sha2("deduped.text", 256).alias("kept_sha256")
    )


def op5_host_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judged(table(spark, sf_dir, "documents"))


def op6_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = revisits.resolve_revisits(revisits.captures_of_pages(table(spark, sf_dir, "pages")))
    fields = F.transform(F.array_sort(F.map_keys("headers")), lambda k: F.concat(k, F.lit("="), F.element_at("headers", k)))
    return found.withColumn("headers", F.array_join(fields, "\n"))


def op7_template_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_page_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = page_text.extract_text(table(spark, sf_dir, "pages"))
    return found.withColumn("n_chars", F.length("text").cast("long"))


def op9_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(bpe.tokenized(table(spark, sf_dir, "documents"), VOCABULARY))


def op10_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substrings.dedup_substrings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "deduped.n_words", "deduped.n_removed", F.sha2("deduped.text", 256).alias("kept_sha256")
    )


def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return negatives.mine_negatives(table(spark, sf_dir, "embeddings"), label=moved)


QUERIES: dict[str, Query] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_license_scan": op2_license_scan,
    "op3_language_id": op3_language_id,
    "op4_line_dedup": op4_line_dedup,
    "op5_host_quality": op5_host_quality,
    "op6_revisit_resolution": op6_revisit_resolution,
    "op7_template_decontamination": op7_template_decontamination,
    "op8_page_text": op8_page_text,
    "op9_bpe_roundtrip": op9_bpe_roundtrip,
    "op10_lm_score": op10_lm_score,
    "op11_importance_resampling": op11_importance_resampling,
    "op12_substring_dedup": op12_substring_dedup,
    "op13_hard_negatives": op13_hard_negatives,
}

ORACLES: dict[str, str] = {
    "op2_license_scan": licenses.SQL,
    "op4_line_dedup": line_dedup.SQL,
    "op5_host_quality": quality.SQL,
    "op11_importance_resampling": resample.SQL,
    "op12_substring_dedup": substrings.SQL,
    "op13_hard_negatives": negatives.SQL,
}
