"""Corpus listing: files with size and modification time, filtered by extension, bundle and exclusion."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.functions import paths


def bundle_suffixes(patterns: Sequence[str]) -> list[str]:
    """`**/*.app/**` -> `.app`; patterns without such a part are ignored."""
    found = (re.search(r"\*\.([^/]+)", pattern) for pattern in patterns)
    return ["." + m.group(1) for m in found if m]


def excluded(path: Column, exclude: Sequence[str]) -> Column:
    """Plain patterns are substrings; those with `*` or `?` are globs."""
    hit = F.lit(False)
    for pattern in exclude:
        if "*" in pattern or "?" in pattern:
            hit = hit | path.rlike(paths.glob_to_regex(pattern))
        else:
            hit = hit | path.contains(pattern)
    return hit


def in_bundle(path: Column, bundles: Sequence[str]) -> Column:
    """True when any path component ends with a bundle suffix."""
    suffixes = bundle_suffixes(bundles)
    if not suffixes:
        return F.lit(False)
    alternatives = "|".join(re.escape(s) for s in suffixes)
    return path.rlike(rf"(?:{alternatives})(?:/|\z)")


def filter_supported(
    listing: DataFrame,
    exts: Sequence[str] = (),
    bundles: Sequence[str] = (),
    exclude: Sequence[str] = (),
) -> DataFrame:
    """Listing rows with a supported extension, outside bundles and not excluded.

    Extensions compare without case and with or without a leading dot; an empty list supports all.
    """
    path = F.col("path")
    keep = ~in_bundle(path, bundles) & ~excluded(path, exclude)
    if exts:
        keep = keep & F.lower(paths.extension(path)).isin([e.lower().lstrip(".") for e in exts])
    return listing.where(keep)


def skipped_bundles(listing: DataFrame, bundles: Sequence[str]) -> DataFrame:
    """Bundle directories met while listing, each once: `(bundle)`."""
    suffixes = bundle_suffixes(bundles)
    alternatives = "|".join(re.escape(s) for s in suffixes) or r"(?!)"
    root = F.regexp_extract("path", rf"\A(.*?(?:{alternatives}))/", 1)
    return listing.select(root.alias("bundle")).where("bundle <> ''").distinct()


def list_files(spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """`(path, size_bytes, mtime_ms)` of every file below the roots; file content is never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(list(roots))
    return files.select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"),
        F.col("length").alias("size_bytes"),
        F.unix_millis("modificationTime").alias("mtime_ms"),
    )


def list_corpus(
    spark: SparkSession,
    roots: Sequence[str],
    exclude: Sequence[str] = (),
    bundles: Sequence[str] = (),
    exts: Sequence[str] = (),
) -> DataFrame:
    """Recursive listing of several roots with all filters applied."""
    return filter_supported(list_files(spark, roots), exts, bundles, exclude)
