"""Splitting documents into chunks."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.frames import salted_join
from docstrata.functions import paths, text as tx

# Token targets of a chunk and of the overlap between neighbours.
TARGET_TOKENS = 500
OVERLAP_TOKENS = 60
CHARS_PER_TOKEN = 4


def sentence_chunks(
    sentences: Sequence[str], target: int, overlap: int
) -> list[tuple[int, int, int]]:
    """Runs of sentences `(first, end, offset)` that form the chunks.

    A run always is contiguous, so its joined length comes from prefix sums of `length + 1`.
    """
    runs = []
    ends = [0]
    first = tokens = 0
    for i, sentence in enumerate(sentences):
        size = -(-len(sentence) // CHARS_PER_TOKEN)
        if i > first and tokens + size > target:
            runs.append((first, i, ends[first]))
            while first < i and -(-(ends[i] - ends[first] - 1) // CHARS_PER_TOKEN) > overlap:
                first += 1
            tokens = -(-(ends[i] - ends[first] - 1) // CHARS_PER_TOKEN) if first < i else 0
        tokens += size
        ends.append(ends[i] + len(sentence) + 1)
    runs.append((first, len(sentences), ends[first]))
    return runs


def chunk_sentences(
    docs: DataFrame,
    key: str | Sequence[str],
    text: str = "text",
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Sentence-aware overlapping chunks: `(key..., chunk_index, offset, text)`.

    `key` may list any columns to carry along (path, page, file statistics), so that later steps need no
    join to get them back. One pass without a shuffle; each document is folded in full inside its Arrow batch.
    """
    keys = [key] if isinstance(key, str) else list(key)
    source = docs.select(*keys, F.col(text).alias("text"))
    schema = T.StructType(
        [
            *[f for f in source.schema.fields if f.name != "text"],
            T.StructField("chunk_index", T.IntegerType()),
            T.StructField("offset", T.LongType()),
            T.StructField("text", T.StringType()),
        ]
    )
    pattern = tx.SENTENCE_BREAK
    whitespace = tx.WHITESPACE

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = re.compile(pattern).split
        for batch in batches:
            rows, index, offsets, texts = [], [], [], []
            for row, value in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if not value or not value.strip(whitespace):
                    continue
                sentences = split(value)
                for n, (first, end, offset) in enumerate(sentence_chunks(sentences, target, overlap)):
                    rows.append(row)
                    index.append(n)
                    offsets.append(offset)
                    texts.append(" ".join(sentences[first:end]))
            take = pa.array(rows, pa.int64())
            carried = [batch.column(c).take(take) for c in range(batch.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(
                [
                    *carried,
                    pa.array(index, pa.int32()),
                    pa.array(offsets, pa.int64()),
                    pa.array(texts, batch.schema.field(batch.num_columns - 1).type),
                ],
                names=schema.names,
            )

    return source.mapInArrow(fold, schema)


def chunk_pages(
    pages: DataFrame,
    key: str | Sequence[str] = "path",
    target: int = TARGET_TOKENS,
    overlap: int = OVERLAP_TOKENS,
) -> DataFrame:
    """Sentence chunks within each page; `chunk_index` and `offset` restart per page."""
    keys = [key] if isinstance(key, str) else list(key)
    return chunk_sentences(pages, [*keys, "page"], "text", target, overlap)


def chunk_fixed(
    docs: DataFrame,
    text: str = "text",
    size: int = 800,
    overlap: int = 100,
    max_chunks: int | None = None,
) -> DataFrame:
    """Fixed windows over whitespace-collapsed text, adding `chunk_index` and `offset` to the input columns.

    Windows start every `max(size - overlap, 1)` characters until one reaches the end. `max_chunks` is the
    caller's cap per document; by default whole texts are kept.
    """
    step = max(size - overlap, 1)
    flat = docs.withColumn(text, tx.collapse_whitespace(text, tx.WORD_SEPARATORS))
    count = F.ceil(F.greatest(F.length(text) - size, F.lit(0)) / F.lit(step)).cast("int") + 1
    if max_chunks is not None:
        count = F.least(count, F.lit(max_chunks))
    # One pass over the text: look ahead for a window, move on by a step. Substrings by position would scan the
    # text from its start for every window. A blank text has no window and so no row.
    windows = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{1,{size}}})).{{1,{step}}}"), F.lit(1))
    kept = [F.col(c) for c in docs.columns if c != text]
    out = flat.select(*kept, F.posexplode(F.slice(windows, F.lit(1), count)).alias("chunk_index", text))
    return out.withColumn("offset", F.col("chunk_index").cast("long") * step)


def chunk_rows(chunks: DataFrame) -> DataFrame:
    """Chunk-table rows from chunks that already carry `path` and `mtime_ms` (and optionally `page`)."""
    page = F.coalesce(F.col("page"), F.lit(0)) if "page" in chunks.columns else F.lit(0)
    vector = F.col("vector") if "vector" in chunks.columns else F.lit(None)
    return chunks.select(
        paths.chunk_id("path", page, "offset").alias("id"),
        "path",
        F.coalesce(F.col("mtime_ms"), F.lit(0)).cast("long").alias("mtime_ms"),
        page.cast("int").alias("page"),
        F.coalesce(F.col("offset"), F.lit(0)).cast("long").alias("offset"),
        "text",
        vector.cast("array<float>").alias("vector"),
        paths.file_type("path").alias("type"),
        paths.basename("path").alias("title"),
        F.col("chunk_index").cast("int").alias("chunk_index"),
    )


def with_file_stats(chunks: DataFrame, listing: DataFrame) -> DataFrame:
    """Adds each chunk's own file's `mtime_ms` and `size_bytes`; a file may hold any share of the chunks."""
    stats = listing.select("path", "mtime_ms", "size_bytes")
    return salted_join(chunks, stats, "path", "left", ["path", "chunk_index"])


def assemble_chunks(chunks: DataFrame, vectors: DataFrame | None, listing: DataFrame) -> DataFrame:
    """Chunk-table rows for chunks, their vectors and their files.

    `vectors` is keyed `(path, page, chunk_index)`; pass None when the chunks carry their vector already,
    which is how the indexing job works and needs no join.
    """
    rows = chunks if "page" in chunks.columns else chunks.withColumn("page", F.lit(0))
    if vectors is not None:
        keyed = vectors if "page" in vectors.columns else vectors.withColumn("page", F.lit(0))
        rows = rows.join(keyed.select("path", "page", "chunk_index", "vector"), ["path", "page", "chunk_index"])
    return chunk_rows(with_file_stats(rows, listing))
