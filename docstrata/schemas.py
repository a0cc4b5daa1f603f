"""Explicit schemas of the persisted tables."""

from __future__ import annotations

from pyspark.sql import types as T

CHUNKS = T.StructType(
    [
        T.StructField("id", T.StringType(), False),
        T.StructField("path", T.StringType(), False),
        T.StructField("mtime_ms", T.LongType()),
        T.StructField("page", T.IntegerType(), False),
        T.StructField("offset", T.LongType(), False),
        T.StructField("text", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("type", T.StringType()),
        T.StructField("title", T.StringType()),
        T.StructField("chunk_index", T.IntegerType()),
    ]
)

# Chunks whose model calls kept failing.
DEAD_LETTERS = T.StructType([*[CHUNKS[c] for c in ("id", "path", "page", "offset", "text")], T.StructField("error", T.StringType())])

STATUS = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("status", T.StringType(), False),
        T.StructField("parser_version", T.IntegerType()),
        T.StructField("chunk_count", T.IntegerType()),
        T.StructField("error_message", T.StringType()),
        T.StructField("last_modified", T.TimestampType()),
        T.StructField("indexed_at", T.TimestampType()),
        T.StructField("file_hash", T.StringType()),
        T.StructField("last_retry", T.TimestampType()),
    ]
)

LISTING = T.StructType(
    [
        T.StructField("path", T.StringType(), False),
        T.StructField("size_bytes", T.LongType()),
        T.StructField("mtime_ms", T.LongType()),
    ]
)

# The states a status row may take.
STATUSES = ("indexed", "failed", "error", "queued", "outdated", "deleted")
