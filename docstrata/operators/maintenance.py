"""Keeping the chunk and status tables current: upserts, deletions, replacements, backfills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.frames import attach, salted_join
from docstrata.functions import paths
from docstrata.operators import lookups
from docstrata.schemas import STATUSES

# Messages stored with a status row.
NO_TEXT = "No text content extracted"
UPGRADED = "Parser upgraded to v"
DOC_RETRY = "Retrying with improved .doc parser"

# The word-processor extension and version whose earlier failures are retried.
RETRY_EXTENSION = "doc"
RETRY_VERSION = 2


def _millis(ms: int | Column) -> Column:
    return F.timestamp_millis(F.lit(ms) if isinstance(ms, int) else ms)


def last_per_key(df: DataFrame, key: str, order: str) -> DataFrame:
    """One row per key, the one with the highest `order`.

    An aggregate rather than a window: rows are reduced before the shuffle, however often a key repeats.
    """
    whole = F.struct(*df.columns)
    return df.groupBy(key).agg(F.max_by(whole, order).alias("__row")).select("__row.*")


def upsert(base: DataFrame, new: DataFrame, key: str = "id", order: str | None = "chunk_index") -> DataFrame:
    """Rows of `new` replace those of `base` with the same key; keys repeated inside `new` keep their last row."""
    latest = last_per_key(new, key, order) if order else new
    kept = base.join(new.select(key).distinct(), key, "left_anti")
    return kept.select(*base.columns).unionByName(latest.select(*base.columns))


def delete_paths(base: DataFrame, doomed: DataFrame) -> DataFrame:
    """Rows whose path is not listed; a path may own any share of the rows."""
    spread = [c for c in ("id",) if c in base.columns] or ["path"]
    return salted_join(base, doomed.select("path").distinct(), "path", "left_anti", spread).select(*base.columns)


def delete_where(base: DataFrame, predicate: Column | str) -> DataFrame:
    """Rows for which the predicate does not hold; unknown does not delete."""
    condition = F.expr(predicate) if isinstance(predicate, str) else predicate
    return base.where(~F.coalesce(condition, F.lit(False)))


def replace_paths(base: DataFrame, new: DataFrame) -> DataFrame:
    """All chunks of the paths in `new` give way to the chunks in `new`."""
    latest = last_per_key(new, "id", "chunk_index")
    return delete_paths(base, new).unionByName(latest.select(*base.columns))


def remove_folders(
    chunks: DataFrame, status: DataFrame, folders: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Both tables without the rows below the folders, and `(removed_chunks, removed_files)`."""
    removed = lookups.in_folders(chunks.select("id", "path"), folders).agg(F.count("*").alias("removed_chunks"))
    files = lookups.in_folders(status.select("path"), folders).agg(F.count("*").alias("removed_files"))
    return (
        lookups.outside_folders(chunks, folders),
        lookups.outside_folders(status, folders),
        attach(removed, files),
    )


def diff_folders(old: DataFrame, new: DataFrame) -> DataFrame:
    """`(folder, change, total, indexed)`: kept folders keep their counts, new ones start at zero, and
    those no longer listed are `removed`."""
    current = old.select("folder", "total", "indexed").withColumn("__old", F.lit(True))
    wanted = new.select("folder").distinct().withColumn("__new", F.lit(True))
    both = current.join(wanted, "folder", "full")
    change = (
        F.when(F.col("__new").isNull(), "removed").when(F.col("__old").isNull(), "added").otherwise("kept")
    )
    return both.select(
        "folder",
        change.alias("change"),
        F.coalesce("total", F.lit(0)).cast("long").alias("total"),
        F.coalesce("indexed", F.lit(0)).cast("long").alias("indexed"),
    )


def clear(table: DataFrame) -> DataFrame:
    """The empty table of the same schema."""
    return table.limit(0)


def index_outcomes(
    docs: DataFrame, chunks: DataFrame, registry: DataFrame, dead_letters: DataFrame | None = None
) -> DataFrame:
    """Status of every processed file, one row each: `(path, status, error_message, chunk_count, parser_version)`.

    `docs(path, error_kind, error_message)` may have several rows a file, such as pages: an error of one is the file's.
    `parse` errors and texts without chunks are `failed`, any other kind is `error`, and so is a file with chunks among
    `dead_letters(path, error)`, whatever else of it was written; the rest is `indexed`. Only an indexed file and one
    with dead letters have a chunk count.
    """
    first = F.min(F.when(F.col("error_kind").isNotNull(), F.struct("error_kind", "error_message"))).alias("__e")
    files = docs.groupBy("path").agg(first).select("path", "__e.error_kind", "__e.error_message")
    counts = chunks.groupBy("path").agg(F.count("*").alias("__n"))
    joined = files.join(counts, "path", "left")
    if dead_letters is None:
        joined = joined.withColumn("__dead", F.lit(0)).withColumn("__why", F.lit(""))
    else:
        lost = dead_letters.groupBy("path").agg(F.count("*").alias("__dead"), F.min("error").alias("__why"))
        joined = joined.join(lost, "path", "left").withColumn("__dead", F.coalesce("__dead", F.lit(0)))
    n, dead = F.coalesce("__n", F.lit(0)), F.col("__dead")
    kind = F.col("error_kind")
    state = (
        F.when(kind == "parse", "failed")
        .when(kind.isNotNull() | (dead > 0), "error")
        .when(n == 0, "failed")
        .otherwise("indexed")
    )
    lost_some = F.concat(dead.cast("string"), F.lit(" of "), (dead + n).cast("string"), F.lit(" chunks failed: "), F.col("__why"))
    message = (
        F.when(kind.isNotNull(), F.coalesce("error_message", F.lit("")))
        .when(dead > 0, lost_some).when(n == 0, NO_TEXT).otherwise("")
    )
    version = F.when(kind.isNull() | (kind == "parse"), F.coalesce("version", F.lit(0))).otherwise(0)
    return lookups.with_parser(joined, registry).select(
        "path",
        state.alias("status"),
        message.alias("error_message"),
        F.when(kind.isNull(), n).otherwise(0).cast("int").alias("chunk_count"),
        version.cast("int").alias("parser_version"),
    )


def deleted_outcomes(gone: DataFrame) -> DataFrame:
    """Outcomes of files that no longer exist."""
    return gone.select(
        "path",
        F.lit("deleted").alias("status"),
        F.lit("").alias("error_message"),
        F.lit(0).alias("chunk_count"),
        F.lit(0).alias("parser_version"),
    )


def status_rows(outcomes: DataFrame, listing: DataFrame, now_ms: int) -> DataFrame:
    """Full status rows of outcomes; `last_retry` is stamped for failures only."""
    now = _millis(now_ms)
    files = listing.select("path", "size_bytes", "mtime_ms")
    return outcomes.join(files, "path", "left").select(
        "path",
        "status",
        F.coalesce("parser_version", F.lit(0)).cast("int").alias("parser_version"),
        F.coalesce("chunk_count", F.lit(0)).cast("int").alias("chunk_count"),
        F.coalesce("error_message", F.lit("")).alias("error_message"),
        F.coalesce(_millis(F.col("mtime_ms")), now).alias("last_modified"),
        now.alias("indexed_at"),
        F.when(
            F.col("mtime_ms").isNotNull(), paths.fingerprint("path", "size_bytes", "mtime_ms")
        ).otherwise("").alias("file_hash"),
        F.when(F.col("status").isin("failed", "error"), now).alias("last_retry"),
    )


def upsert_status(status: DataFrame, outcomes: DataFrame, listing: DataFrame, now_ms: int) -> DataFrame:
    """Status table after the outcomes were recorded, one row per path."""
    return upsert(status, status_rows(outcomes, listing, now_ms).select(*status.columns), "path", None)


def backfill_status(chunks: DataFrame, status: DataFrame, listing: DataFrame) -> DataFrame:
    """Status rows for files that have chunks but no status and still exist; version and chunk count start at 1."""
    orphans = lookups.unstatused_paths(chunks, status)
    modified = _millis(F.col("mtime_ms"))
    return orphans.join(listing, "path").select(
        "path",
        F.lit("indexed").alias("status"),
        F.lit(1).alias("parser_version"),
        F.lit(1).alias("chunk_count"),
        F.lit("").alias("error_message"),
        modified.alias("last_modified"),
        modified.alias("indexed_at"),
        paths.fingerprint("path", "size_bytes", "mtime_ms").alias("file_hash"),
        F.lit(None).cast("timestamp").alias("last_retry"),
    )


def drop_orphans(status: DataFrame, listing: DataFrame) -> DataFrame:
    """Status rows whose file still exists."""
    return status.join(listing.select("path"), "path", "left_semi")


def _reset(status: DataFrame, when: Column, values: dict[str, Column]) -> DataFrame:
    """Applies `values` to the rows selected by `when`, blanking what indexing will fill in again."""
    blank = {
        "chunk_count": F.lit(0),
        "error_message": F.lit(""),
        "last_modified": F.lit(None),
        "indexed_at": F.lit(None),
        "file_hash": F.lit(""),
        "last_retry": F.lit(None),
    }
    changes = {**blank, **values}
    return status.select(
        *[
            (
                F.when(when, changes[f.name].cast(f.dataType)).otherwise(F.col(f.name)).alias(f.name)
                if f.name in changes
                else F.col(f.name)
            )
            for f in status.schema.fields
        ]
    )


def backfill_versions(status: DataFrame, now_ms: int) -> DataFrame:
    """Rows without a parser version get version 1; of these, failed ones get `now` as last retry."""
    return _reset(
        status,
        F.col("parser_version").isNull(),
        {
            "parser_version": F.lit(1),
            "last_retry": F.when(F.col("status") == "failed", _millis(now_ms)),
        },
    )


def parser_upgrades(status: DataFrame, registry: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(status, summary)` after a parser upgrade.

    Indexed rows below the current version become `outdated`; failed word-processor rows below the fixing
    version become `queued`. `summary(ext, files)` counts them, the latter as `doc_retries`.
    """
    ext = paths.file_type("path")
    marked = status.withColumn("ext", ext).join(registry.select("ext", "version"), "ext", "left")
    below = F.coalesce(F.col("parser_version"), F.lit(0))
    outdated = (F.col("status") == "indexed") & F.coalesce(below < F.col("version"), F.lit(False))
    retry = (
        F.col("status").isin("failed", "error")
        & (F.col("ext") == RETRY_EXTENSION)
        & F.coalesce(F.col("version") == RETRY_VERSION, F.lit(False))
        & (below < RETRY_VERSION)
    )
    changed = _reset(
        marked,
        outdated | retry,
        {
            "status": F.when(outdated, "outdated").otherwise("queued"),
            "parser_version": below,
            "error_message": F.when(outdated, F.concat(F.lit(UPGRADED), F.col("version"))).otherwise(DOC_RETRY),
        },
    ).select(*status.columns)
    summary = (
        marked.where(outdated | retry)
        .groupBy(F.when(outdated, F.col("ext")).otherwise("doc_retries").alias("ext"))
        .agg(F.count("*").alias("files"))
    )
    return changed, summary


def index_counts(chunks: DataFrame) -> DataFrame:
    """`(chunks, files)`: rows and distinct paths, from one count per path."""
    per_path = chunks.groupBy("path").agg(F.count("*").alias("n"))
    return per_path.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("chunks"), F.count("*").alias("files")
    )


def unknown_statuses(status: DataFrame, allowed: Sequence[str] = STATUSES) -> DataFrame:
    """Rows whose status is outside the enumeration; none in a sound table."""
    return status.where(~F.col("status").isin(*allowed))
