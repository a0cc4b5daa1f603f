"""Checked queries: look-ups, index maintenance, re-index planning, stores."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.operators import lookups, maintenance, stats
from docstrata.plans import reindex
from docstrata.session import fresh_dir
from docstrata.sources import reports, store
from docstrata.workload import tables as t
from docstrata.workload.registry import query
from docstrata.workload.tables import NOW_MS, oracle

_CHUNK = ["id", "path", "page", "offset", "text", "chunk_index"]
_CHUNK_SQL = 'id, path, page, "offset", text, cast(chunk_index as int) as chunk_index'
_STATUS_SQL = (
    "path, status, parser_version, chunk_count, error_message, last_modified_ms, indexed_at_ms, file_hash, last_retry_ms"
)


def _all(spark, sf):
    return t.listing(spark, sf), t.status(spark, sf), t.registry(spark)


def _labelled(spark, sf, condition):
    """Paths of documents whose label satisfies the condition."""
    labels = t.given(spark, sf, "labels").where(condition)
    return t.listing(spark, sf).join(labels, "doc_id").select("path")


_POOR = "(select f.path from listing f join labels b on f.doc_id = b.doc_id where b.quality = 0)"


# Look-ups


@query(
    "j1_with_status",
    oracle("select path, size_bytes, has_status, status, chunk_count from current", "current"),
)
def with_status(spark, sf):
    listing, status, _ = _all(spark, sf)
    return lookups.with_status(listing, status).select("path", "size_bytes", "has_status", "status", "chunk_count")


@query("j2_missing_files", oracle("select path from gone", "gone"))
def missing_files(spark, sf):
    listing, status, _ = _all(spark, sf)
    return lookups.missing_files(status, listing, t.folders(spark)).select("path")


@query(
    "j3_unstatused_paths",
    oracle("select distinct path from chunks where path not in (select path from status)", "chunks", "status"),
)
def unstatused_paths(spark, sf):
    return lookups.unstatused_paths(t.chunks(spark, sf), t.status(spark, sf))


@query(
    "j4_with_parser",
    oracle(
        """
select l.path, r.parser, r.label, r.category, r.version from listing l left join registry r on r.ext = lower(l.ext)
""",
        "listing",
        "registry",
    ),
)
def with_parser(spark, sf):
    rows = lookups.with_parser(t.listing(spark, sf).select("path"), t.registry(spark))
    return rows.select("path", "parser", "label", "category", "version")


@query(
    "j5_assign_folder",
    oracle(
        """
select l.path, (select arg_min(f.folder, f.position) from folders f where starts_with(l.path, f.folder || '/')) as folder
from listing l
""",
        "listing",
        "folders",
    ),
)
def assign_folder(spark, sf):
    return lookups.assign_folder(t.listing(spark, sf).select("path"), t.folders(spark))


@query(
    "j6_in_folders",
    oracle(
        "select distinct l.path from listing l join removed f on starts_with(l.path, f.folder || '/')",
        "listing",
        "removed",
    ),
)
def in_folders(spark, sf):
    return lookups.in_folders(t.listing(spark, sf).select("path"), t.removed_folders(spark))


@query(
    "j8_with_file_stats",
    oracle(
        'select c.id, l.mtime_ms, l.size_bytes from chunks c join listing l on l.path = c.path', "chunks", "listing"
    ),
)
def with_file_stats(spark, sf):
    from docstrata.operators.chunking import with_file_stats as join_stats

    rows = t.chunks(spark, sf).drop("mtime_ms")
    return join_stats(rows, t.listing(spark, sf)).select("id", "mtime_ms", "size_bytes")


# Maintenance

_LATEST = "(select * from new_chunks qualify row_number() over (partition by id order by chunk_index desc) = 1)"


@query(
    "m1_upsert",
    oracle(
        f"""
select {_CHUNK_SQL} from chunks where id not in (select id from new_chunks)
union all select {_CHUNK_SQL} from {_LATEST} n
""",
        "chunks",
        "new_chunks",
    ),
)
def upsert(spark, sf):
    return maintenance.upsert(t.chunks(spark, sf), t.new_chunks(spark, sf)).select(*_CHUNK)


@query(
    "m2_delete_paths",
    oracle(f"select {_CHUNK_SQL} from chunks where path not in {_POOR}", "chunks", "listing"),
)
def delete_paths(spark, sf):
    return maintenance.delete_paths(t.chunks(spark, sf), _labelled(spark, sf, "quality = 0")).select(*_CHUNK)


@query(
    "m3_delete_where",
    oracle(
        f"select {_CHUNK_SQL} from chunks where not (starts_with(path, '/src2/') and \"offset\" >= 700)", "chunks"
    ),
)
def delete_where(spark, sf):
    kept = maintenance.delete_where(t.chunks(spark, sf), "startswith(path, '/src2/') and offset >= 700")
    return kept.select(*_CHUNK)


@query(
    "m4_replace_paths",
    oracle(
        f"""
select {_CHUNK_SQL} from chunks where path not in (select path from new_chunks)
union all select {_CHUNK_SQL} from {_LATEST} n
""",
        "chunks",
        "new_chunks",
    ),
)
def replace_paths(spark, sf):
    return maintenance.replace_paths(t.chunks(spark, sf), t.new_chunks(spark, sf)).select(*_CHUNK)


_UNDER = "exists (select 1 from removed f where starts_with(x.path, f.folder || '/'))"


@query(
    "m5_remove_folders",
    oracle(
        f"""
select 'chunk' as kind, id as name from chunks x where not {_UNDER}
union all select 'status', path from status x where not {_UNDER}
union all select 'removed_chunks', cast(count(*) as varchar) from chunks x where {_UNDER}
union all select 'removed_files', cast(count(*) as varchar) from status x where {_UNDER}
""",
        "chunks",
        "status",
        "removed",
    ),
)
def remove_folders(spark, sf):
    """From a stored chunk table, read several times: the corpus must not be cut for each."""
    path = fresh_dir(spark, "chunks")
    t.chunks(spark, sf).select("id", "path").write.parquet(path)
    chunks, status, counts = maintenance.remove_folders(
        spark.read.parquet(path), t.status(spark, sf), t.removed_folders(spark)
    )
    totals = counts.select(
        F.explode(
            F.array(
                F.struct(F.lit("removed_chunks").alias("kind"), F.col("removed_chunks").cast("string").alias("name")),
                F.struct(F.lit("removed_files").alias("kind"), F.col("removed_files").cast("string").alias("name")),
            )
        ).alias("x")
    ).select("x.*")
    return (
        chunks.select(F.lit("chunk").alias("kind"), F.col("id").alias("name"))
        .union(status.select(F.lit("status"), "path"))
        .union(totals)
    )


@query(
    "m6_diff_folders",
    oracle(
        """
select coalesce(o.folder, n.folder) as folder, case when n.folder is null then 'removed' when o.folder is null then 'added' else 'kept' end as change,
       cast(coalesce(o.total, 0) as bigint) as total, cast(coalesce(o.indexed, 0) as bigint) as indexed
from (select '/' || source as folder, count(*) as total, count(*) filter (lang = 'en') as indexed from documents group by source) o
full join (select distinct '/src' || user_id as folder from events) n on n.folder = o.folder
"""
    ),
)
def diff_folders(spark, sf):
    """Folders holding documents against folders seen in the change feed."""
    old = t.given(spark, sf, "documents").groupBy(F.concat(F.lit("/"), "source").alias("folder")).agg(
        F.count("*").alias("total"), F.count(F.when(F.col("lang") == "en", 1)).alias("indexed")
    )
    new = t.events(spark, sf).select(F.col("path").alias("folder"))
    return maintenance.diff_folders(old, new)


@query(
    "m7_clear_and_replan",
    oracle(
        "select path, 'index' as action, 'force-reindex' as reason, false as has_status from listing", "listing"
    ),
)
def clear_and_replan(spark, sf):
    listing, status, registry = _all(spark, sf)
    return reindex.plan_reindex(
        listing, maintenance.clear(status), t.folders(spark), registry, NOW_MS, force=True
    )


_OUTCOMES = """
, counted as (select path, count(*) as n from chunks group by path),
outcome as (select l.path, case when starts_with(l.path, '/src4/') then 'failed' when starts_with(l.path, '/src5/') then 'error'
                 when coalesce(c.n, 0) = 0 then 'failed' else 'indexed' end as status,
       case when starts_with(l.path, '/src4/') then 'PDF: bad xref' when starts_with(l.path, '/src5/') then 'disk full'
            when coalesce(c.n, 0) = 0 then 'No text content extracted' else '' end as error_message,
       cast(case when starts_with(l.path, '/src4/') or starts_with(l.path, '/src5/') then 0 else coalesce(c.n, 0) end as int) as chunk_count,
       case when starts_with(l.path, '/src5/') then 0 else r.version end as parser_version, l.size_bytes, l.mtime_ms
from listing l left join counted c on c.path = l.path left join registry r on r.ext = lower(l.ext))
"""


def _with_outcomes(body: str, *ctes: str) -> str:
    return oracle("@@", "chunks", "listing", "registry", *ctes).replace(" @@", _OUTCOMES) + body


def _outcomes(spark, sf):
    """One folder whose files fail to parse, one whose files break off, one whose files come out empty."""
    folder = F.element_at(F.split("path", "/"), 2)
    docs = t.listing(spark, sf).select(
        "path",
        F.when(folder == "src4", "parse").when(folder == "src5", "io").alias("error_kind"),
        F.when(folder == "src4", "PDF: bad xref").when(folder == "src5", "disk full").alias("error_message"),
    )
    return maintenance.index_outcomes(docs, t.chunks(spark, sf).select("path"), t.registry(spark))


@query(
    "s7_index_outcomes",
    _with_outcomes("select path, status, error_message, chunk_count, parser_version from outcome"),
)
def index_outcomes(spark, sf):
    return _outcomes(spark, sf)


@query(
    "m8_upsert_status",
    _with_outcomes(
        f"""
select {_STATUS_SQL} from status where path not in (select path from outcome)
union all
select path, status, parser_version, chunk_count, error_message, mtime_ms, {NOW_MS}, md5(concat(path, ':', size_bytes, ':', mtime_ms)),
       case when status in ('failed', 'error') then {NOW_MS} end from outcome
""",
        "status",
    ),
)
def upsert_status(spark, sf):
    listing, status, _ = _all(spark, sf)
    return t.status_ms(maintenance.upsert_status(status, _outcomes(spark, sf), listing, NOW_MS))


@query(
    "m9_backfill_status",
    oracle(
        """
select l.path, 'indexed' as status, 1 as parser_version, 1 as chunk_count, '' as error_message, l.mtime_ms as last_modified_ms,
       l.mtime_ms as indexed_at_ms, md5(concat(l.path, ':', l.size_bytes, ':', l.mtime_ms)) as file_hash, cast(null as bigint) as last_retry_ms
from listing l where l.path in (select path from chunks) and l.path not in (select path from status)
""",
        "chunks",
        "status",
        "listing",
    ),
)
def backfill_status(spark, sf):
    listing, status, _ = _all(spark, sf)
    return t.status_ms(maintenance.backfill_status(t.chunks(spark, sf), status, listing))


@query(
    "m10_drop_orphans",
    oracle(f"select {_STATUS_SQL} from status where path in (select path from listing)", "status"),
)
def drop_orphans(spark, sf):
    listing, status, _ = _all(spark, sf)
    return t.status_ms(maintenance.drop_orphans(status, listing))


@query(
    "m11_backfill_versions",
    oracle(
        f"""
select path, status, coalesce(parser_version, 1) as parser_version, case when v then 0 else chunk_count end as chunk_count,
       case when v then '' else error_message end as error_message, case when v then null else last_modified_ms end as last_modified_ms,
       case when v then null else indexed_at_ms end as indexed_at_ms, case when v then '' else file_hash end as file_hash,
       case when v then case when status = 'failed' then {NOW_MS} end else last_retry_ms end as last_retry_ms
from (select *, parser_version is null as v from status) s
""",
        "status",
    ),
)
def backfill_versions(spark, sf):
    return t.status_ms(maintenance.backfill_versions(t.status(spark, sf), NOW_MS))


_UPGRADES = """
, marked as (select s.*, x.ext, r.version,
    s.status = 'indexed' and r.version is not null and coalesce(s.parser_version, 0) < r.version as outdated,
    s.status in ('failed', 'error') and x.ext = 'doc' and coalesce(s.parser_version, 0) < 2 as retry
  from status s join (select path, lower(regexp_extract(path, '\\.([^./]+)$', 1)) as ext from status) x on x.path = s.path
  left join registry r on r.ext = x.ext)
"""


def _with_upgrades(body: str) -> str:
    return oracle("@@", "status", "registry").replace(" @@", _UPGRADES) + body


@query(
    "m12_parser_upgrades",
    _with_upgrades(
        """
select path, case when outdated then 'outdated' when retry then 'queued' else status end as status,
       case when outdated or retry then coalesce(parser_version, 0) else parser_version end as parser_version,
       case when outdated or retry then 0 else chunk_count end as chunk_count,
       case when outdated then 'Parser upgraded to v' || version when retry then 'Retrying with improved .doc parser' else error_message end as error_message,
       case when outdated or retry then null else last_modified_ms end as last_modified_ms,
       case when outdated or retry then null else indexed_at_ms end as indexed_at_ms,
       case when outdated or retry then '' else file_hash end as file_hash,
       case when outdated or retry then null else last_retry_ms end as last_retry_ms from marked
"""
    ),
)
def parser_upgrades(spark, sf):
    changed, _ = maintenance.parser_upgrades(t.status(spark, sf), t.registry(spark))
    return t.status_ms(changed)


@query(
    "m12_upgrade_summary",
    _with_upgrades(
        "select case when outdated then ext else 'doc_retries' end as ext, count(*) as files from marked where outdated or retry group by 1"
    ),
)
def upgrade_summary(spark, sf):
    _, summary = maintenance.parser_upgrades(t.status(spark, sf), t.registry(spark))
    return summary


@query(
    "m13_index_counts",
    oracle("select count(*) as chunks, count(distinct path) as files from chunks", "chunks"),
)
def index_counts(spark, sf):
    return maintenance.index_counts(t.chunks(spark, sf))


# Planning


@query("p3_index_decision", oracle("select * from decision", "decision"))
def index_decision(spark, sf):
    return reindex.index_decision(*_all(spark, sf), NOW_MS)


@query("p4_should_reindex", oracle("select path, reindex from rule", "rule"))
def should_reindex(spark, sf):
    return reindex.should_reindex(*_all(spark, sf), NOW_MS)


_SCAN = f"""
, scan as (select r.path, case when q.path is not null then 'skipped' when not has_status then 'new' when reindex then 'modified'
               else 'skipped' end as category,
         q.path is null and has_status and not reindex and mtime_ms > indexed_at_ms as hash_checked
  from rule r left join (select distinct path from {_POOR} p) q on q.path = r.path)
"""


def _with_scan(body: str) -> str:
    return oracle("@@", "rule", "listing").replace(" @@", _SCAN) + body


def _scanned(spark, sf):
    return reindex.scan_changes(*_all(spark, sf), _labelled(spark, sf, "quality = 0"), NOW_MS)


@query("p5_scan_changes", _with_scan("select path, category, coalesce(hash_checked, false) as hash_checked from scan"))
def scan_changes(spark, sf):
    return _scanned(spark, sf)


@query(
    "p5_scan_summary",
    _with_scan(
        """
select count(*) filter (category = 'new') as new_files, count(*) filter (category = 'modified') as modified_files,
       count(*) filter (category = 'skipped') as skipped_files, count(*) filter (hash_checked) as hash_calculations from scan
"""
    ),
)
def scan_summary(spark, sf):
    return reindex.scan_summary(_scanned(spark, sf))


@query("p6_categorize", oracle("select path, category from category", "category"))
def categorize(spark, sf):
    return reindex.categorize(index_decision(spark, sf))


def _plan(spark, sf):
    listing, status, registry = _all(spark, sf)
    return reindex.plan_reindex(listing, status, t.folders(spark), registry, NOW_MS)


@query("p7_plan_reindex", oracle("select * from plan", "plan"))
def plan_reindex(spark, sf):
    return _plan(spark, sf)


_STATS = """
select count(*) as total_files, count(*) filter (reason = 'new-file' or not has_status) as new_files,
       count(*) filter (reason = 'modified') as modified_files, count(*) filter (reason = 'retry-failed') as failed_files,
       count(*) filter (reason is null) as skipped_files, count(*) filter (reason in ('outdated', 'parser-upgraded')) as outdated_files
from plan where action <> 'remove'
"""


@query("p8_plan_stats", oracle(_STATS, "plan"))
def plan_stats(spark, sf):
    return reindex.plan_stats(_plan(spark, sf))


@query(
    "p9_group_by_reason",
    oracle(
        "select reason, path, count(*) over (partition by reason) as group_size from plan where action = 'index'", "plan"
    ),
)
def group_by_reason(spark, sf):
    return reindex.group_by_reason(_plan(spark, sf))


@query(
    "p10_validate_plan",
    oracle(
        """
, n as (select 3 * count(*) filter (action = 'index') as i, 3 * count(*) filter (action = 'remove') as r,
        count(distinct path) filter (action = 'index') as d from plan)
select d = i as valid, 'warning' as kind, 'Large reindex operation: ' || i || ' files' as message from n where i > 10000
union all select d = i, 'warning', 'Many files to remove: ' || r || ' files' from n where r > 100
union all select d = i, 'warning', 'Stats totals do not match total file count' from n
union all select d = i, 'error', 'Duplicate files detected in reindex plan' from n where d <> i
""",
        "plan",
    ),
)
def validate_plan(spark, sf):
    """The plan listed three times over, against the counts of the single one, so that the checks fire."""
    plan = _plan(spark, sf)
    tripled = plan.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(3)))).drop("copy")
    wrong = reindex.plan_stats(plan).withColumn("total_files", F.col("total_files") + 1)
    row = reindex.validate_plan(tripled, wrong)
    kinds = [
        row.select("valid", F.lit(kind).alias("kind"), F.explode(source).alias("message"))
        for kind, source in (("warning", "warnings"), ("error", "errors"))
    ]
    return kinds[0].union(kinds[1])


@query(
    "p11_group_by_directory",
    oracle("select regexp_replace(path, '/[^/]*$', '') as directory, path from listing", "listing"),
)
def group_by_directory(spark, sf):
    return reindex.group_by_directory(t.listing(spark, sf))


@query(
    "p11_directory_sizes",
    oracle(
        "select regexp_replace(path, '/[^/]*$', '') as directory, count(*) as files from listing group by 1", "listing"
    ),
)
def directory_sizes(spark, sf):
    return reindex.directory_sizes(t.listing(spark, sf))


@query(
    "p12_scan_stats",
    oracle(
        """
select count(*) as total, count(*) filter (category = 'new') as new_files, count(*) filter (category = 'modified') as modified_files,
       count(*) filter (category = 'failed') as failed_files, count(*) filter (category = 'skipped') as skipped_files,
       count(*) filter (category = 'outdated') as outdated_files, count(*) filter (category <> 'skipped') as to_process from category
""",
        "category",
    ),
)
def scan_stats(spark, sf):
    return reindex.scan_stats(categorize(spark, sf))


@query("p13_retry_due", oracle("select path, due from current where has_status", "current"))
def retry_due(spark, sf):
    listing, status, _ = _all(spark, sf)
    known = status.join(listing.select("path"), "path", "left_semi")
    return known.select("path", reindex.retry_due("last_retry", NOW_MS).alias("due"))


@query(
    "a1_index_stats",
    oracle(
        """
select f.folder, coalesce(a.total_files, 0) as total_files, coalesce(a.indexed_files, 0) as indexed_files,
       (select count(*) from chunks) as all_chunks, (select count(*) from status where status = 'indexed') as all_indexed
from folders f left join (
  select folder, count(*) filter (kind = 'listed') as total_files, count(*) filter (kind = 'indexed') as indexed_files from (
    select kind, (select arg_min(g.folder, g.position) from folders g where starts_with(x.path, g.folder || '/')) as folder
    from (select 'listed' as kind, path from listing union all select 'indexed', path from status where status = 'indexed') x) y
  group by folder) a on a.folder = f.folder
""",
        "chunks",
        "status",
        "folders",
    ),
)
def index_stats(spark, sf):
    listing, status, _ = _all(spark, sf)
    return stats.index_stats(t.chunks(spark, sf), status, listing, t.folders(spark))


# Stores and reports


@query(
    "s8_chunk_store",
    oracle(
        f"""
select {_CHUNK_SQL} from (
  select * from chunks where path not in (select path from new_chunks)
  union all select * from {_LATEST} n) x where path not in {_POOR} and type = 'md'
""",
        "chunks",
        "new_chunks",
        "listing",
    ),
)
def chunk_store(spark, sf):
    """Written, its re-cut files replaced, its poor files deleted, read back with a filter."""
    table = store.chunk_store(spark, fresh_dir(spark, "chunks"), buckets=8)
    table.create()
    table.overwrite(t.chunks(spark, sf))
    table.replace(_labelled(spark, sf, "true"), t.new_chunks(spark, sf), batch_id=1)
    poor = _labelled(spark, sf, "quality = 0")
    table.replace(poor, table.read().limit(0), batch_id=2)
    return table.read().where("type = 'md'").select(*_CHUNK)


@query(
    "s9_status_store",
    oracle("select path, status, error_message from status where status <> 'indexed'", "status"),
)
def status_store(spark, sf):
    table = store.status_store(spark, fresh_dir(spark, "status"), buckets=8)
    table.create()
    table.upsert(t.status(spark, sf))
    table.upsert(t.status(spark, sf).where("status <> 'indexed'"), batch_id=1)
    return table.read().where("status <> 'indexed'").select("path", "status", "error_message")


@query("s10_report_json", oracle(_STATS, "plan"))
def report_json(spark, sf):
    """A report written and read back."""
    path = fresh_dir(spark, "report")
    report = reindex.plan_stats(_plan(spark, sf))
    reports.write_report(report, path, "json")
    return spark.read.schema(report.schema).json(path)


@query("s10_report_csv", oracle(_STATS, "plan"))
def report_csv(spark, sf):
    path = fresh_dir(spark, "report")
    report = reindex.plan_stats(_plan(spark, sf))
    reports.write_report(report, path, "csv")
    return spark.read.schema(report.schema).option("header", True).csv(path)

