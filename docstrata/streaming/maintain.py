"""Applying the change feed to the stores, one micro-batch at a time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from docstrata.frames import key_filter
from docstrata.operators import embedding, maintenance
from docstrata.plans import indexing
from docstrata.session import ensure_checkpoint_dir
from docstrata.sources.store import SnapshotTable
from docstrata.streaming import feed


def loader(files: DataFrame) -> Callable[[DataFrame], DataFrame]:
    """`load` of `apply_changes` from a table of files: of their texts hardly more is shuffled than what is asked for."""

    def load(paths: DataFrame) -> DataFrame:
        return files.where(key_filter(paths, "path")("path")).join(paths, "path", "left_semi")

    return load


def apply_changes(
    events: DataFrame,
    batch_id: int,
    load: Callable[[DataFrame], DataFrame],
    chunks: SnapshotTable,
    status: SnapshotTable,
    registry: DataFrame,
    embedder: Callable[[], embedding.Embedder],
    now_ms: int,
    dead_letters: SnapshotTable | None = None,
) -> None:
    """Applies one batch of events `(path, op, ts, event_id)` or of debounced ones `(path, op, ..., settled)`.

    `load(paths)` gives `(path, size_bytes, mtime_ms, text)` of files that exist. The last event of a path
    decides. Both stores remember the batch id, so a replayed batch changes nothing.
    """
    moment = F.col("settled") if "settled" in events.columns else F.struct("ts", "event_id")
    last = events.groupBy("path").agg(F.max_by("op", moment).alias("op"))
    wanted = last.where("op <> 'unlink'").select("path")
    docs = load(wanted)
    routed = feed.route(
        last, docs.select("path", "size_bytes", "mtime_ms"), status.read_for(last), registry, now_ms
    )
    # A file that is gone by now is deleted, whatever was to be done with it.
    there = docs.select("path", F.lit(True).alias("there"))
    action = F.when((F.col("action") == "index") & F.col("there").isNull(), "delete").otherwise(F.col("action"))
    # The decision depends on the status table, which this batch changes: fix it before the first write.
    ensure_checkpoint_dir(events.sparkSession)
    decided = (
        routed.where("action <> 'ignore'").join(there, "path", "left").select("path", action.alias("action")).checkpoint(eager=True)
    )
    to_index = decided.where("action = 'index'").select("path")
    to_delete = decided.where("action = 'delete'").select("path")

    found = docs.join(to_index, "path", "left_semi")
    rows, dead = indexing.write_embedded(found.select("path", "text", "mtime_ms"), registry, embedder)
    chunks.replace(decided.select("path"), rows, batch_id)
    if dead_letters is not None:
        dead_letters.replace(decided.select("path"), dead, batch_id)

    written = chunks.read_for(to_index).select("path")
    outcomes = maintenance.index_outcomes(
        found.select(
            "path", F.lit(None).cast("string").alias("error_kind"), F.lit("").alias("error_message")
        ),
        written,
        registry,
        dead,
    )
    listing = docs.select("path", "size_bytes", "mtime_ms")
    deleted = maintenance.deleted_outcomes(to_delete)
    status.upsert(maintenance.status_rows(outcomes.unionByName(deleted), listing, now_ms), batch_id)


def maintain(
    stream: DataFrame,
    load: Callable[[DataFrame], DataFrame],
    chunks: SnapshotTable,
    status: SnapshotTable,
    registry: DataFrame,
    checkpoint: str,
    now_ms: Callable[[], int],
    embedder: Callable[[], embedding.Embedder] = embedding.HashEmbedder,
    dead_letters: SnapshotTable | None = None,
    **trigger,
) -> StreamingQuery:
    """Starts the maintenance query; `trigger` is passed on, `availableNow=True` by default."""

    def write(batch: DataFrame, batch_id: int) -> None:
        apply_changes(batch, batch_id, load, chunks, status, registry, embedder, now_ms(), dead_letters)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )


def maintain_totals(stream: DataFrame, totals: SnapshotTable, checkpoint: str, **trigger) -> StreamingQuery:
    """Running files per folder, kept in a `(folder, total)` table."""

    def write(batch: DataFrame, batch_id: int) -> None:
        if not totals.applied(batch_id):
            moves = feed.folder_moves(batch)
            current = totals.read_for(moves).join(moves.select("folder"), "folder", "left_semi")
            totals.upsert(feed.apply_moves(current, moves), batch_id)

    return (
        stream.writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
