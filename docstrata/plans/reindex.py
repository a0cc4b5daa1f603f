"""Deciding which files to index again, which to remove, and why."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.frames import attach, salted_join
from docstrata.functions import paths
from docstrata.operators import lookups

# Hours between retries of a failed file, and the plan sizes that call for a warning.
RETRY_HOURS = 24
MANY_TO_INDEX = 10_000
MANY_TO_REMOVE = 100

# Reason -> category.
CATEGORIES = {
    "new-file": "new",
    "modified": "modified",
    "retry-failed": "failed",
    "outdated": "outdated",
    "parser-upgraded": "outdated",
}


def _present(c: str) -> Column:
    return F.coalesce(F.col(c), F.lit("")) != ""


def retry_due(last_retry: Column | str, now_ms: int, hours: int = RETRY_HOURS) -> Column:
    """Never retried, or more than `hours` ago."""
    at = F.col(last_retry) if isinstance(last_retry, str) else last_retry
    return at.isNull() | (F.lit(now_ms) - F.unix_millis(at) > hours * 3_600_000)


def _current(listing: DataFrame, status: DataFrame, registry: DataFrame, how: str = "left") -> DataFrame:
    """Listing with status, parser version and the file's present fingerprint."""
    known = listing.select("path", "size_bytes", "mtime_ms")
    joined = lookups.with_status(known, status, how).withColumn("ext", paths.file_type("path"))
    versions = registry.select("ext", F.col("version").alias("current_version"), "enabled")
    return joined.join(versions, "ext", "left").withColumn(
        "current_hash", paths.fingerprint("path", "size_bytes", "mtime_ms")
    )


def _version_behind() -> Column:
    stored = F.coalesce(F.col("parser_version"), F.lit(0))
    return F.coalesce(
        (F.col("current_version") > 0) & ((stored == 0) | (stored < F.col("current_version"))), F.lit(False)
    )


def _modified() -> Column:
    """Fingerprints differ when both are known, else the file is newer than recorded, else assumed changed."""
    return (
        F.when(_present("current_hash") & _present("file_hash"), F.col("current_hash") != F.col("file_hash"))
        .when(F.col("last_modified").isNotNull(), F.col("mtime_ms") > F.unix_millis("last_modified"))
        .otherwise(True)
    )


def _reason(
    now_ms: int,
    force: bool,
    retry_hours: int = RETRY_HOURS,
    check_parser_version: bool = True,
    check_modified: bool = True,
    retry_failed: bool = True,
) -> Column:
    """The first applicable reason, null for a file that is up to date; a check that is off applies to no file."""
    failed = F.col("status").isin("failed", "error")
    return (
        F.when(F.lit(force), "force-reindex")
        .when(~F.col("has_status"), "new-file")
        .when(F.col("status") == "outdated", "outdated")
        .when(F.lit(check_parser_version) & _version_behind(), "parser-upgraded")
        .when(F.lit(check_modified) & _modified(), "modified")
        .when(F.lit(retry_failed) & failed & retry_due("last_retry", now_ms, retry_hours), "retry-failed")
    )


def index_decision(
    listing: DataFrame,
    status: DataFrame,
    registry: DataFrame,
    now_ms: int,
    force: bool = False,
    retry_hours: int = RETRY_HOURS,
    **checks: bool,
) -> DataFrame:
    """`(path, has_status, reason)` for every listed file; a null reason means up to date.

    The first applicable reason wins. `check_parser_version`, `check_modified` and `retry_failed` switch checks off.
    """
    reason = _reason(now_ms, force, retry_hours, **checks)
    return _current(listing, status, registry).select("path", "has_status", reason.alias("reason"))


def _reindex_rule(now_ms: int, retry_hours: int = RETRY_HOURS) -> Column:
    failed = F.col("status").isin("failed", "error")
    return (
        F.when(F.coalesce(F.col("current_version"), F.lit(0)) == 0, False)
        .when(~F.col("has_status"), True)
        .when(F.coalesce(F.col("file_hash"), F.lit("")) != F.col("current_hash"), True)
        .when(_version_behind(), True)
        .when(failed & retry_due("last_retry", now_ms, retry_hours), True)
        .otherwise(False)
    )


def should_reindex(listing: DataFrame, status: DataFrame, registry: DataFrame, now_ms: int) -> DataFrame:
    """`(path, reindex)` by the fingerprint-first rule; files no parser handles are never indexed."""
    return _current(listing, status, registry).select("path", _reindex_rule(now_ms).alias("reindex"))


def rule_for(events: DataFrame, listing: DataFrame, status: DataFrame, registry: DataFrame, now_ms: int) -> DataFrame:
    """`events(path, ...)` with `enabled` (of the file type) and `due`, the fingerprint-first rule for listed files.

    The events meet the listing and the status table by path; a path with most of the events is salted.
    """
    spread = events.columns
    files = listing.select("path", F.struct("size_bytes", "mtime_ms").alias("__file"))
    known = status.select("path", F.struct("status", "parser_version", "file_hash", "last_retry").alias("__known"))
    typed = events.withColumn("__ext", paths.file_type("path"))
    versions = registry.select(F.col("ext").alias("__ext"), F.col("version").alias("__version"), "enabled")
    met = salted_join(salted_join(typed.join(versions, "__ext", "left"), files, "path", "left", spread), known, "path", "left", spread)
    row = met.select(
        "*", F.col("__known").isNotNull().alias("has_status"), "__known.*", F.col("__version").alias("current_version"),
        paths.fingerprint("path", F.col("__file.size_bytes"), F.col("__file.mtime_ms")).alias("current_hash"),
    )
    due = F.when(F.col("__file").isNotNull(), _reindex_rule(now_ms)).otherwise(False)
    return row.select(*events.columns, "enabled", due.alias("due"))


def scan_changes(
    listing: DataFrame, status: DataFrame, registry: DataFrame, queued: DataFrame, now_ms: int
) -> DataFrame:
    """`(path, category, hash_checked)` with category new, modified or skipped.

    Queued and unsupported files are skipped. The fingerprint is only checked again for files newer than
    their index time.
    """
    waiting = queued.select("path").distinct().withColumn("queued", F.lit(True))
    supported = registry.where("enabled").select(
        F.col("ext").alias("long_ext"), F.lit(True).alias("supported")
    )
    rows = (
        _current(listing, status, registry)
        .join(waiting, "path", "left")
        .withColumn("long_ext", paths.extended_extension("path"))
        .join(supported, "long_ext", "left")
    )
    ignored = F.col("queued").isNotNull() | F.col("supported").isNull()
    rule = _reindex_rule(now_ms)
    newer = F.coalesce(F.col("mtime_ms") > F.unix_millis("indexed_at"), F.lit(False))
    checked = ~ignored & F.col("has_status") & ~rule & newer
    category = (
        F.when(ignored, "skipped")
        .when(~F.col("has_status"), "new")
        .when(rule, "modified")
        .when(newer & (F.coalesce(F.col("file_hash"), F.lit("")) != F.col("current_hash")), "modified")
        .otherwise("skipped")
    )
    return rows.select("path", category.alias("category"), checked.alias("hash_checked"))


def scan_summary(scanned: DataFrame) -> DataFrame:
    return scanned.agg(
        *[
            F.count(F.when(F.col("category") == c, 1)).alias(f"{c}_files")
            for c in ("new", "modified", "skipped")
        ],
        F.count(F.when(F.col("hash_checked"), 1)).alias("hash_calculations"),
    )


def categorize(decisions: DataFrame) -> DataFrame:
    """`(path, category)`: new, modified, failed, outdated or skipped."""
    category = F.lit(None).cast("string")
    for reason, name in CATEGORIES.items():
        category = F.when(F.col("reason") == reason, name).otherwise(category)
    return decisions.select(
        "path", F.when(F.col("reason").isNull(), "skipped").otherwise(category).alias("category")
    )


def scan_stats(categorized: DataFrame) -> DataFrame:
    names = ("new", "modified", "failed", "skipped", "outdated")
    counts = {c: F.count(F.when(F.col("category") == c, 1)) for c in names}
    return categorized.agg(
        F.count("category").alias("total"),
        *[count.alias(f"{c}_files") for c, count in counts.items()],
        F.count(F.when(F.col("category") != "skipped", 1)).alias("to_process"),
    )


def plan_reindex(
    listing: DataFrame,
    status: DataFrame,
    folders: DataFrame,
    registry: DataFrame,
    now_ms: int,
    force: bool = False,
    retry_hours: int = RETRY_HOURS,
    **checks: bool,
) -> DataFrame:
    """`(path, action, reason, has_status)`: `index` with a reason, `skip`, or `remove` for recorded files of
    a watched folder that are no longer listed.

    Listed and vanished files come out of one full join of the two tables; the directories of recorded files meet the
    folder list apart. `checks` as in `index_decision`.
    """
    rows = _current(listing, status, registry, "full").withColumn("__dir", paths.parent_dir("path"))
    watched = lookups.folder_of_dirs(status.select("path"), folders).select("__dir", F.lit(True).alias("__watched"))
    known = salted_join(rows, watched, "__dir", "left", ["path"]).where(F.col("listed") | F.col("__watched"))
    reason = F.when(F.col("listed"), _reason(now_ms, force, retry_hours, **checks)).alias("reason")
    action = F.when(~F.col("listed"), "remove").when(F.col("reason").isNull(), "skip").otherwise("index")
    return known.select("path", "listed", reason, "has_status").select("path", action.alias("action"), "reason", "has_status")


def plan_stats(plan: DataFrame) -> DataFrame:
    """One row of counts over the listed files; files without a status count as new whatever the reason."""
    listed = F.col("action") != "remove"
    reason = F.col("reason")
    new = (reason == "new-file") | ~F.col("has_status")
    is_new = F.coalesce(new, F.lit(False))

    def count(condition: Column) -> Column:
        return F.count(F.when(listed & condition, 1))

    return plan.agg(
        count(F.lit(True)).alias("total_files"),
        count(is_new).alias("new_files"),
        count(~is_new & (reason == "modified")).alias("modified_files"),
        count(~is_new & (reason == "retry-failed")).alias("failed_files"),
        count(~is_new & reason.isNull()).alias("skipped_files"),
        count(~is_new & reason.isin("outdated", "parser-upgraded")).alias("outdated_files"),
    )


def group_by_reason(plan: DataFrame) -> DataFrame:
    """`(reason, path, group_size)` of the files to index.

    Groups stay rows: a reason may cover most of the corpus, so it is never gathered into one value. The
    sizes are a handful of rows.
    """
    chosen = plan.where("action = 'index'").select("reason", "path")
    sizes = chosen.groupBy("reason").agg(F.count("*").alias("group_size"))
    return chosen.join(F.broadcast(sizes), "reason")  # one row per reason, of which there are six


def group_by_directory(listing: DataFrame) -> DataFrame:
    """`(directory, path)`: a projection; writers partition or sort by `directory` as they need."""
    return listing.select(paths.parent_dir("path").alias("directory"), "path")


def directory_sizes(listing: DataFrame) -> DataFrame:
    return group_by_directory(listing).groupBy("directory").agg(F.count("*").alias("files"))


def validate_plan(plan: DataFrame, stats: DataFrame) -> DataFrame:
    """One row `(valid, warnings, errors)`."""
    per_path = (
        plan.where("action <> 'skip'")
        .groupBy("action", "path")
        .agg(F.count("*").alias("n"))
        .groupBy("action")
        .agg(F.sum("n").alias("n"), F.max("n").alias("most"))
    )

    def of(action: str, column: str) -> Column:
        return F.coalesce(F.max(F.when(F.col("action") == action, F.col(column))), F.lit(0))

    sizes = per_path.agg(
        of("index", "n").alias("to_index"), of("remove", "n").alias("to_remove"), of("index", "most").alias("most")
    )
    row = attach(sizes, stats)
    parts = F.col("new_files") + F.col("modified_files") + F.col("failed_files")
    parts = parts + F.col("skipped_files") + F.col("outdated_files")

    def messages(*items: Column) -> Column:
        return F.filter(F.array(*items), lambda m: m.isNotNull())

    warnings = messages(
        F.when(
            F.col("to_index") > MANY_TO_INDEX,
            F.concat(F.lit("Large reindex operation: "), F.col("to_index"), F.lit(" files")),
        ),
        F.when(
            F.col("to_remove") > MANY_TO_REMOVE,
            F.concat(F.lit("Many files to remove: "), F.col("to_remove"), F.lit(" files")),
        ),
        F.when(parts != F.col("total_files"), F.lit("Stats totals do not match total file count")),
    )
    errors = messages(F.when(F.col("most") > 1, F.lit("Duplicate files detected in reindex plan")))
    return row.select((F.size(errors) == 0).alias("valid"), warnings.alias("warnings"), errors.alias("errors"))
