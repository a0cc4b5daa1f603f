"""The two whole jobs: index a corpus, search it."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata.frames import values_frame
from docstrata.operators import chunking, embedding, lookups, maintenance, search
from docstrata.plans import reindex
from docstrata.session import ensure_checkpoint_dir, fresh_dir
from docstrata.sources import documents, walk
from docstrata.sources.store import NO_BATCH, SnapshotTable


def chunk_corpus(
    docs: DataFrame, target: int = chunking.TARGET_TOKENS, overlap: int = chunking.OVERLAP_TOKENS
) -> DataFrame:
    """`docs(path, text, mtime_ms[, page])` -> chunks that carry their file's columns; no shuffle, no join."""
    carried = [c for c in ("path", "mtime_ms", "page") if c in docs.columns]
    return chunking.chunk_sentences(docs, carried, "text", target, overlap)


def _embedded(docs: DataFrame, embedder: Callable[[], embedding.Embedder], target: int, overlap: int) -> DataFrame:
    """Chunks with `vector` or `error`. They are spread by their content before the model runs: one long file must not
    keep one task busy."""
    chunks = chunk_corpus(docs, target, overlap)
    place = [c for c in ("path", "page", "chunk_index") if c in chunks.columns]
    return embedding.embed(chunks.repartition(F.xxhash64(*place)), "text", embedder)


def index_corpus(
    docs: DataFrame,
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
    target: int = chunking.TARGET_TOKENS,
    overlap: int = chunking.OVERLAP_TOKENS,
) -> tuple[DataFrame, DataFrame]:
    """`(chunk rows, dead-letter rows)` of documents. Each of the two runs the model when it is read."""
    ok, dead = embedding.split_failures(_embedded(docs, embedder, target, overlap))
    return chunking.chunk_rows(ok), dead


def write_embedded(
    docs: DataFrame,
    registry: DataFrame,
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
) -> tuple[DataFrame, DataFrame]:
    """`(chunk rows, dead-letter rows)` of documents, read from a written table, so that the model runs once.

    File types whose parser has its own chunk size or overlap (columns `chunk_tokens`, `overlap_tokens` of the
    registry) are chunked by these.
    """
    spark = docs.sparkSession
    sizes = [(chunking.TARGET_TOKENS, chunking.OVERLAP_TOKENS)]
    parts = docs
    if {"chunk_tokens", "overlap_tokens"} <= set(registry.columns):
        target = F.coalesce("chunk_tokens", F.lit(chunking.TARGET_TOKENS))
        overlap = F.coalesce("overlap_tokens", F.lit(chunking.OVERLAP_TOKENS))
        own = registry.select("ext", target.cast("int").alias("__target"), overlap.cast("int").alias("__overlap"))
        # A pair or two of a registry of a dozen rows.
        sizes = sorted({*sizes, *map(tuple, own.select("__target", "__overlap").distinct().collect())})
        parts = lookups.with_parser(docs, own)
    path = fresh_dir(spark, "embedded")
    for target, overlap in sizes:
        mine = parts
        if len(sizes) > 1:
            fits = (F.col("__target") == target) & (F.col("__overlap") == overlap)
            default = (target, overlap) == (chunking.TARGET_TOKENS, chunking.OVERLAP_TOKENS)
            mine = parts.where(F.coalesce(fits, F.lit(default)))
        written = _embedded(mine, embedder, target, overlap)
        written.write.mode("append").parquet(path)
    ok, dead = embedding.split_failures(spark.read.schema(written.schema).parquet(path))
    id_and_place = chunking.chunk_rows(dead.withColumn("vector", F.lit(None))).select("id", "path", "page", "offset", "text", "chunk_index")
    keys = ["path", "page", "chunk_index"] if "page" in dead.columns else ["path", "chunk_index"]
    why = dead.select(*keys, "error")
    return chunking.chunk_rows(ok), id_and_place.join(why, keys).select("id", "path", "page", "offset", "text", "error")


def index_files(
    docs: DataFrame,
    files: DataFrame,
    registry: DataFrame,
    chunks: SnapshotTable,
    status: SnapshotTable,
    now_ms: int,
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
    batch_id: int = NO_BATCH,
    dead_letters: SnapshotTable | None = None,
) -> None:
    """Indexes documents into the stores: their chunks replace earlier ones, their status rows are updated.

    `docs(path, text, mtime_ms, error_kind, error_message[, page])`. Chunks whose model calls kept failing go to
    `dead_letters`, if there is such a table, and their files become `error` with the count and the message.
    """
    readable = docs.where("error_kind is null and text is not null")
    rows, dead = write_embedded(readable, registry, embedder)
    paths_of_docs = docs.select("path")
    chunks.replace(paths_of_docs, rows, batch_id)
    if dead_letters is not None:
        dead_letters.replace(paths_of_docs, dead, batch_id)
    written = chunks.read_for(paths_of_docs).select("path")
    outcomes = maintenance.index_outcomes(docs.select("path", "error_kind", "error_message"), written, registry, dead)
    status.upsert(maintenance.status_rows(outcomes, files, now_ms), batch_id)


def index_tree(
    spark: SparkSession,
    roots: list[str],
    registry: DataFrame,
    chunks: SnapshotTable,
    status: SnapshotTable,
    now_ms: int,
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
    dead_letters: SnapshotTable | None = None,
    exclude: Sequence[str] = (),
    bundles: Sequence[str] = (),
    force: bool = False,
    opened: Accumulator | None = None,
    **checks: bool,
) -> DataFrame:
    """The whole job over file trees: list, plan, read, chunk, embed, store, record. Returns the plan it carried out.
    `opened` counts the files it reads.

    Files to index are new ones and those the plan names; recorded files below the roots that are gone lose their
    chunks and become `deleted`. Files of a type without an extractor are recorded as `failed`.
    """
    enabled = [r.ext for r in registry.where("enabled").select("ext").collect()]  # a dozen
    files = walk.walk_corpus(spark, roots, exclude, bundles, enabled)
    folders = values_frame(spark, [(r.rstrip("/") or "/", i) for i, r in enumerate(roots)], "folder string, position int")
    path = fresh_dir(spark, "plan")
    # The plan depends on the status table, which this job changes: fix it before the first write.
    reindex.plan_reindex(files, status.read(), folders, registry, now_ms, force, **checks).where(
        "action <> 'skip'"
    ).write.parquet(path)
    plan = spark.read.parquet(path)
    wanted, gone = plan.where("action = 'index'").select("path"), plan.where("action = 'remove'").select("path")
    # Only the planned files are opened. They are dealt evenly, since a listing keeps those of a folder together.
    planned = files.join(wanted, "path", "left_semi").repartition(F.xxhash64("path"))
    docs = documents.ingest_named(planned, opened)
    unread = wanted.where(~documents.has_extractor("path")).select(
        "path", F.lit(None).cast("string").alias("text"), F.lit(None).cast("long").alias("mtime_ms"),
        F.lit("parse").alias("error_kind"), F.lit("No extractor for this file type").alias("error_message"),
    )
    columns = ["path", "text", "mtime_ms", "error_kind", "error_message"]
    index_files(docs.select(columns).unionByName(unread), files, registry, chunks, status, now_ms, embedder, dead_letters=dead_letters)
    chunks.replace(gone, spark.createDataFrame([], chunks.schema))
    if dead_letters is not None:
        dead_letters.replace(gone, spark.createDataFrame([], dead_letters.schema))
    status.upsert(maintenance.status_rows(maintenance.deleted_outcomes(gone), files, now_ms))
    return plan


def save_chunks(rows: DataFrame, table: str, path: str, buckets: int = 64) -> DataFrame:
    """Writes chunk rows as a table bucketed by id, and reads it. Hits then fetch their texts from the buckets they are in:
    neither the look-up nor a semi-join moves the chunks. `buckets` should give files of some hundred MB."""
    # Dealt as the buckets are, so that every bucket is one file.
    rows.repartition(buckets, "id").write.bucketBy(buckets, "id").sortBy("id").option("path", path).saveAsTable(table)
    return rows.sparkSession.table(table)


def search_text(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
    where: Column | str | None = None,
    prefix: str = "",
) -> DataFrame:
    """`queries(query_id, text)` -> projected hits; errors of the model reach the caller."""
    asked = embedding.embed(queries.select("query_id", "text"), "text", embedder, prefix=prefix)
    checked = asked.withColumn(
        "vector", F.when(F.col("error").isNull(), F.col("vector")).otherwise(F.raise_error(F.col("error")))
    )
    # The ranking reads the query vectors more than once; the model must not run again for that.
    ensure_checkpoint_dir(queries.sparkSession)
    vectors = checked.select("query_id", "vector").checkpoint()
    return search.project_hits(search.batch_topk(chunks, vectors, k, where=where), chunks)
