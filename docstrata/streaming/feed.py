"""The file change feed as Structured Streaming: sources, debounce, suppression, counters.

Every operator is a plain DataFrame function that works on a stream and on a static table alike. Event time is
`ts`; the watermark is one hour, and later events are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState

from docstrata.frames import instant, salted_join
from docstrata.functions import paths
from docstrata.plans import reindex

WATERMARK_SECONDS = 3600
WATERMARK = f"{WATERMARK_SECONDS} seconds"

# Event-time width of the slices in which running totals are computed.
SLICE_SECONDS = 60


def file_stream(spark: SparkSession, root: str, max_files: int = 10_000) -> DataFrame:
    """New files as a stream `(path, size_bytes, ts, content)`. A path is emitted once: rewritten and removed files come
    from `listing_changes`."""
    files = (
        spark.readStream.format("binaryFile")
        .schema("path string, modificationTime timestamp, length long, content binary")
        .option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", max_files)
        .load(root)
    )
    return files.select(
        F.regexp_replace("path", r"^file:/*", "/").alias("path"),
        F.col("length").alias("size_bytes"),
        F.col("modificationTime").alias("ts"),
        "content",
    )


def listing_changes(before: DataFrame, after: DataFrame, now_ms: int) -> DataFrame:
    """Events `(path, op, ts, event_id, fingerprint)` that lead from one listing to the next: `add`, `change` (another
    size or time) and `unlink`. Each path has one event at most; `fingerprint` is that of the new state, or of the old
    one where the file is gone."""
    old = before.select("path", F.struct("size_bytes", "mtime_ms").alias("old"))
    both = old.join(after.select("path", F.struct("size_bytes", "mtime_ms").alias("new")), "path", "full")
    op = (
        F.when(F.col("old").isNull(), "add").when(F.col("new").isNull(), "unlink")
        .when(~F.col("old").eqNullSafe(F.col("new")), "change")
    )
    state = F.coalesce("new", "old")
    return both.withColumn("op", op).where("op is not null").select(
        "path", "op", F.timestamp_millis(F.lit(now_ms)).alias("ts"), F.xxhash64("path", "op").alias("event_id"),
        paths.fingerprint("path", state["size_bytes"], state["mtime_ms"]).alias("fingerprint"),
    )


def with_event_time(events: DataFrame) -> DataFrame:
    """`ts` as a timestamp with the watermark."""
    return instant(events, "ts").withWatermark("ts", WATERMARK)


def debounce(events: DataFrame, quiet: str = "1 second") -> DataFrame:
    """`(path, op, changes, opened, settled)`: bursts of changes of a file closer than `quiet` become one event
    with the last operation; equal times are ordered by `event_id`."""
    return (
        with_event_time(events)
        .groupBy(F.session_window("ts", quiet), "path")
        .agg(
            F.max_by("op", F.struct("ts", "event_id")).alias("op"),
            F.count("*").alias("changes"),
        )
        .select(
            "path",
            "op",
            "changes",
            F.col("session_window.start").alias("opened"),
            F.col("session_window.end").alias("settled"),
        )
    )


def _same_as_before(rows: pd.DataFrame, last: tuple | None) -> np.ndarray:
    """Which of the ordered rows of one path repeat the row before them within the watermark."""
    op, mark, ts = rows["op"].to_numpy(), rows["fingerprint"].to_numpy(), rows["ts"]
    before = ts.shift().to_numpy(copy=True)
    same = np.zeros(len(rows), dtype=bool)
    same[1:] = (op[1:] == op[:-1]) & (mark[1:] == mark[:-1])
    if last is not None and len(rows):
        same[0] = op[0] == last[0] and mark[0] == last[1]
        before[0] = np.datetime64(last[2])
    return same & (ts.to_numpy() - before <= np.timedelta64(WATERMARK_SECONDS, "s"))


def suppress_in_flight(events: DataFrame) -> DataFrame:
    """Events without those that repeat the one before them on their path: same `op` and `fingerprint`, at most an hour
    later. An unlink between two equal additions so keeps the second one.

    On a stream the last event of a path is its state, dropped an hour after it; events count in the order of
    (ts, event_id) within a micro-batch and micro-batches in turn.
    """
    timed = with_event_time(events)
    if not timed.isStreaming:
        order = Window.partitionBy("path").orderBy("ts", "event_id")
        before = F.lag(F.struct("op", "fingerprint", "ts")).over(order)
        marked = timed.withColumn("__before", before)
        repeats = (
            (F.col("__before.op") == F.col("op"))
            & (F.col("__before.fingerprint") == F.col("fingerprint"))
            & (F.unix_micros("ts") - F.unix_micros("__before.ts") <= WATERMARK_SECONDS * 1_000_000)
        )
        return marked.where(~F.coalesce(repeats, F.lit(False))).drop("__before")
    kept = ["path", "op", "fingerprint", "ts", "event_id"]
    schema = T.StructType([timed.schema[c] for c in kept])

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        rows = pd.concat(list(parts)).sort_values(["ts", "event_id"])
        last = state.get if state.exists else None
        fresh = rows[~_same_as_before(rows, last)]
        end = rows.iloc[-1]
        state.update((end["op"], end["fingerprint"], end["ts"].to_pydatetime()))
        expiry = int(end["ts"].timestamp() * 1000) + WATERMARK_SECONDS * 1000
        state.setTimeoutTimestamp(max(expiry, state.getCurrentWatermarkMs() + 1))
        yield fresh[kept]

    return timed.select(kept).groupBy("path").applyInPandasWithState(
        run, schema, "op string, fingerprint string, ts timestamp", "append", "EventTimeTimeout"
    )


def route(
    events: DataFrame, listing: DataFrame, status: DataFrame, registry: DataFrame, now_ms: int
) -> DataFrame:
    """`(path, op, action)`: added files are indexed where the re-index rule asks for it, changed ones always,
    unlinked ones deleted; unsupported files are ignored.

    The events meet listing and status by path, and the rule is evaluated for these files only.
    """
    due = reindex.rule_for(events, listing, status, registry, now_ms)
    supported = F.coalesce(F.col("enabled"), F.lit(False))
    action = (
        F.when(F.col("op") == "unlink", "delete")
        .when(~supported, "ignore")
        .when(F.col("op") == "change", "index")
        .when(F.coalesce(F.col("due"), F.lit(False)), "index")
        .otherwise("ignore")
    )
    return due.select(*events.columns, action.alias("action"))


def track_completion(chunk_events: DataFrame) -> DataFrame:
    """Progress of each run over a file from `(path, run, started, total, processed, errors)`:
    `(path, run, started, total, processed, errors, complete)`.

    `run` names one indexing of the file (its fingerprint, say) and `started` its time, so a later run starts anew.
    Failed chunks count as processed. A native aggregate: events of a file are combined before the shuffle, so a file
    with most of the events costs no more than others. On a stream with a watermark on `started`, the row of a run is
    dropped from the state once the watermark has passed its start.
    """
    return (
        chunk_events.groupBy("path", "run", "started")
        .agg(
            F.max("total").alias("total"),
            F.sum("processed").alias("processed"),
            F.sum("errors").alias("errors"),
        )
        .withColumn("complete", F.col("processed") >= F.col("total"))
    )


def progress(events: DataFrame) -> DataFrame:
    """Number of files per state."""
    return events.groupBy("state").agg(F.count("*").alias("files"))


def status_line(counters: DataFrame) -> DataFrame:
    """`(remaining, line)` from the counters: what is queued or in work is still to do."""
    left = F.coalesce(
        F.sum(F.when(F.col("state").isin("queued", "processing"), F.col("files"))), F.lit(0)
    ).cast("long")
    row = counters.agg(left.alias("remaining"))
    text = F.concat(F.lit("Indexing ("), F.col("remaining"), F.lit(" remaining)"))
    return row.withColumn("line", F.when(F.col("remaining") > 0, text).otherwise("Ready"))


def folder_moves(events: DataFrame) -> DataFrame:
    """`(folder, net, lowest)` of ordered add/unlink events `(folder, op, ts, event_id)`.

    `net` is the sum of the +1/-1 steps and `lowest` the least running sum; together they give the effect on any
    starting total, because a total that never falls below zero ends at `max(start + net, net - lowest)`.
    Running sums are taken inside time slices and then over the slices, so a busy folder is many tasks' work.
    """
    step = F.when(F.col("op") == "add", 1).when(F.col("op") == "unlink", -1)
    steps = events.select(
        "folder",
        "event_id",
        F.col("ts").cast("timestamp").alias("ts"),
        step.alias("step"),
    ).where("step is not null")
    sliced = steps.withColumn("slice", F.floor(F.unix_seconds("ts") / SLICE_SECONDS))
    inside = (
        Window.partitionBy("folder", "slice").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    )
    per_slice = (
        sliced.withColumn("run", F.sum("step").over(inside))
        .groupBy("folder", "slice")
        .agg(F.sum("step").alias("net"), F.min("run").alias("lowest"))
    )
    earlier = Window.partitionBy("folder").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum("net").over(earlier), F.lit(0))
    return (
        per_slice.withColumn("lowest", F.col("lowest") + offset)
        .groupBy("folder")
        .agg(F.sum("net").alias("net"), F.min("lowest").alias("lowest"))
    )


def apply_moves(totals: DataFrame, moves: DataFrame) -> DataFrame:
    """`(folder, total)` after the moves; folders seen first start at zero."""
    start = F.coalesce("total", F.lit(0))
    net, lowest = F.coalesce("net", F.lit(0)), F.coalesce("lowest", F.lit(0))
    return totals.join(moves, "folder", "full").select(
        "folder", F.greatest(start + net, net - lowest, F.lit(0)).cast("long").alias("total")
    )


def folder_totals(events: DataFrame) -> DataFrame:
    """Totals of a whole feed from zero; the batch twin of `maintain_totals`."""
    moves = folder_moves(events)
    return apply_moves(moves.select("folder", F.lit(0).alias("total")), moves)
