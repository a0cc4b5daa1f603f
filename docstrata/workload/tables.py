"""Inputs of the checked queries: the given tables, and tables both engines derive from them.

Each derived table is stated once as SQL text that Spark and the checking engine both understand; `{documents}`
stands for a table, `{S}` for the string type.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docstrata import registry as parsers
from docstrata.frames import instant, values_frame
from docstrata.operators import chunking, search
from docstrata.sources.documents import read_corpus

# Fixed moment of all time-dependent rules: 2025-01-01 00:00 UTC.
NOW_MS = 1_735_689_600_000

# White-space class and sentence break in the checking engine's regular-expression dialect.
SQL_WS = r"[\s\x0b\x{00a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]"

SQL_SEPARATORS = SQL_WS.replace(r"\x{feff}", r"\x1c-\x1f\x{0085}")

FOLDERS = [("/src3/en", 0), *[(f"/src{i}", i + 1) for i in range(20)], ("/empty", 21)]
REMOVED_FOLDERS = [("/src1", 0), ("/src3/", 1)]

# A digest of the id spreads files over types, versions and states.
_CORPUS = """
select doc_id, source, lang, text, h, ext, n_chars as size_bytes, 1700000000000 + doc_id * 1000 as mtime_ms,
       concat('/', source, '/', lang, '/', case when substr(h, 5, 1) = '0' then 'Tool.app/' else '' end,
              cast(doc_id as {S}), '.', case when substr(h, 7, 1) = '0' then upper(ext) else ext end) as path
from (select d.*, case when h < '2' then 'pdf' when h < '4' then 'docx' when h < '6' then 'doc'
                       when h < '7' then 'rtf' when h < '8' then 'xlsx' when h < 'a' then 'csv'
                       when h < 'b' then 'tsv' when h < 'e' then 'txt' else 'md' end as ext
      from (select *, md5(cast(doc_id as {S})) as h from {documents}) d) x
"""

_LISTING = "select doc_id, path, ext, h, source, size_bytes, mtime_ms from ({corpus}) c"

# Labelled documents are the files already known: their labels decide the recorded state. Files without a
# label are new; poor ones also had an earlier copy that is gone.
_STATUS = """
select path, status, cast(case when substr(h, 2, 1) = '0' then null when substr(h, 2, 1) < '4' then cur - 1
                               else cur end as int) as parser_version,
       cast(1 + floor(size_bytes / 2000.0) as int) as chunk_count,
       case when status in ('failed', 'error') then 'PDF: broken' else '' end as error_message,
       mtime_ms as last_modified_ms,
       mtime_ms + case when substr(h, 6, 1) < '8' then 60000 else -60000 end as indexed_at_ms,
       case when substr(h, 3, 1) = '0' then ''
            else md5(concat(path, ':', cast(size_bytes as {S}), ':',
                            cast(mtime_ms - case when substr(h, 3, 1) < '4' then 1 else 0 end as {S}))) end as file_hash,
       case when status not in ('failed', 'error') then cast(null as bigint)
            when substr(h, 4, 1) < '5' then 1735689600000 - 86400000
            when substr(h, 4, 1) < '9' then 1735689600000 - 3600000
            when substr(h, 4, 1) < 'd' then 1735689600000 - 172800000 else cast(null as bigint) end as last_retry_ms
from (select l.*, case when b.toxic = 1 and b.quality = 0 then 'failed' when b.toxic = 1 then 'error'
                       when b.quality = 0 then 'outdated' else 'indexed' end as status,
             case l.ext when 'pdf' then 3 when 'doc' then 2 when 'txt' then 4 when 'md' then 4 else 1 end as cur
      from ({listing}) l join {labels} b on l.doc_id = b.doc_id) s
union all
select concat('/', source, '/gone/', cast(l.doc_id as {S}), '.', ext), 'indexed', 1, 1, '', mtime_ms, mtime_ms, '',
       cast(null as bigint)
from ({listing}) l join {labels} b on l.doc_id = b.doc_id where b.quality = 0
"""


def _fill(sql: str, tables: dict[str, str], string: str) -> str:
    for _ in range(3):
        for name, text in tables.items():
            sql = sql.replace("{" + name + "}", text)
    return sql.replace("{S}", string)


_NESTED = {"listing": _LISTING, "corpus": _CORPUS}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus, for text work."""
    return read_corpus(spark, f"{sf_dir}/documents.parquet", "doc_id")


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spark_sql(text: str, **frames: DataFrame) -> DataFrame:
    spark = next(iter(frames.values())).sparkSession
    return spark.sql(_fill(text, _NESTED, "string"), **frames)


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(_CORPUS, documents=documents(spark, sf_dir))


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _spark_sql(_LISTING, documents=given(spark, sf_dir, "documents"))


def status(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _spark_sql(
        _STATUS, documents=given(spark, sf_dir, "documents"), labels=given(spark, sf_dir, "labels")
    )
    return rows.select(
        "path",
        "status",
        "parser_version",
        "chunk_count",
        "error_message",
        F.timestamp_millis("last_modified_ms").alias("last_modified"),
        F.timestamp_millis("indexed_at_ms").alias("indexed_at"),
        "file_hash",
        F.timestamp_millis("last_retry_ms").alias("last_retry"),
    )


def status_ms(df: DataFrame) -> DataFrame:
    """Status rows with times as milliseconds, for comparison."""
    return df.select(
        "path",
        "status",
        "parser_version",
        "chunk_count",
        "error_message",
        F.unix_millis("last_modified").alias("last_modified_ms"),
        F.unix_millis("indexed_at").alias("indexed_at_ms"),
        "file_hash",
        F.unix_millis("last_retry").alias("last_retry_ms"),
    )


def registry(spark: SparkSession) -> DataFrame:
    return parsers.registry_frame(spark)


def folders(spark: SparkSession) -> DataFrame:
    return values_frame(spark, FOLDERS, "folder string, position int")


def removed_folders(spark: SparkSession) -> DataFrame:
    return values_frame(spark, REMOVED_FOLDERS, "folder string, position int")


def chunks(spark: SparkSession, sf_dir: str, size: int = 800, overlap: int = 100) -> DataFrame:
    """Chunk rows of the whole corpus (fixed windows, no vectors)."""
    cut = chunking.chunk_fixed(corpus(spark, sf_dir), "text", size, overlap)
    return chunking.chunk_rows(cut.select("path", "mtime_ms", "chunk_index", "offset", "text"))


def new_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunk rows of the labelled documents after they were cut anew: some ids stay, some vanish, some appear."""
    again = corpus(spark, sf_dir).join(given(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    cut = chunking.chunk_fixed(again, "text", 600, 250)
    return chunking.chunk_rows(cut.select("path", "mtime_ms", "chunk_index", "offset", "text"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given embeddings as a chunk-vector table."""
    return given(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("id"), F.col("embedding").alias("vector"), "label"
    )


def classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return given(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "label")


def runs(spark: SparkSession, sf_dir: str, k: int = 10) -> DataFrame:
    """Retrieval runs: every vector asks for its nearest others."""
    table = vectors(spark, sf_dir)
    asked = table.select(F.col("id").alias("query_id"), "vector")
    wide = search.batch_topk(table, asked, k + 1)
    return search._rank(wide.where("query_id <> id").drop("rank"), k).select(
        "query_id",
        F.col("id").alias("doc_id"),
        F.round(F.greatest(F.lit(0.0), 1.0 - F.col("distance")), 6).alias("score"),
        "rank",
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The given events as a change feed and as operation timings."""
    return change_feed(given(spark, sf_dir, "events"))


def change_feed(raw: DataFrame) -> DataFrame:
    op = (
        F.when(F.col("event_type") == "purchase", "change")
        .when(F.col("event_type") == "error", "unlink")
        .otherwise("add")
    )
    return instant(raw, "ts").select(
        "event_id",
        "ts",
        "user_id",
        "event_type",
        "value",
        op.alias("op"),
        F.concat(F.lit("/src"), F.col("user_id").cast("string")).alias("path"),
    )


# The same tables for the checking engine.

_VARCHAR = "varchar"
_OWN = {"documents": "documents", "labels": "labels"}


def _chunk_sql(source: str, size: int, step: int) -> str:
    return f"""
select sha1(concat(path, ':0:', cast(chunk_index * {step} as varchar))) as id, path, mtime_ms, cast(0 as int) as page,
       chunk_index * {step} as "offset", substr(t, chunk_index * {step} + 1, {size}) as text, chunk_index, type, title
from (select path, mtime_ms, t, type, title,
             unnest(range(0, cast(1 + ceil(greatest(length(t) - {size}, 0) / {step}.0) as bigint))) as chunk_index
      from (select path, mtime_ms, lower(ext) as type, string_split(path, '/')[-1] as title,
                   trim(regexp_replace(text, '{SQL_SEPARATORS}+', ' ', 'g')) as t from {source}) f where length(t) > 0) e
"""


_CTES: dict[str, tuple[str, tuple[str, ...]]] = {
    "corpus": (_fill(_CORPUS, _OWN, _VARCHAR), ()),
    "listing": (_fill(_LISTING, {"corpus": "select * from corpus"}, _VARCHAR), ("corpus",)),
    "status": (
        _fill(_STATUS, {"listing": "select * from listing", **_OWN}, _VARCHAR),
        ("listing",),
    ),
    "registry": (
        "select * from (values "
        + ", ".join(f"('{e}', '{p}', '{n}', '{c}', {v}, true)" for e, p, n, c, v in parsers.PARSERS)
        + ") as t(ext, parser, label, category, version, enabled)",
        (),
    ),
    "folders": (
        "select * from (values " + ", ".join(f"('{f}', {p})" for f, p in FOLDERS) + ") as t(folder, position)",
        (),
    ),
    "removed": (
        "select * from (values "
        + ", ".join(f"('{f.rstrip('/')}')" for f, _ in REMOVED_FOLDERS)
        + ") as t(folder)",
        (),
    ),
    "chunks": (_chunk_sql("corpus", 800, 700), ("corpus",)),
    "new_chunks": (
        _chunk_sql("(select c.* from corpus c join labels b on c.doc_id = b.doc_id)", 600, 350),
        ("corpus",),
    ),
    "runs": (
        """
select query_id, doc_id, greatest(0.0::double, round(1.0 - distance, 6)) as score, rank from (
  select query_id, doc_id, distance, row_number() over (partition by query_id order by distance, doc_id) as rank from (
    select q.vec_id as query_id, d.vec_id as doc_id,
           round(1.0 - list_cosine_similarity(q.embedding::double[], d.embedding::double[]), 6) as distance
    from embeddings q join embeddings d on q.vec_id <> d.vec_id) p) r where rank <= 10
""",
        (),
    ),
    "judged": (
        """
select r.*, q.label = d.label as relevant from runs r join embeddings q on q.vec_id = r.query_id
join embeddings d on d.vec_id = r.doc_id
""",
        ("runs",),
    ),
    "asked": (
        "select vec_id as query_id, count(*) over (partition by label) - 1 as n_relevant from embeddings",
        (),
    ),
    "report": (
        """
select a.query_id, a.n_relevant, coalesce(p1, 0) as p1, coalesce(p3, 0) as p3, coalesce(p5, 0) as p5,
       coalesce(p10, 0) as p10, coalesce(rr, 0) as rr, coalesce(avg_score, 0) as avg_score, coalesce(found, 0) as found,
       coalesce(top_relevant, 0) as top_relevant,
       case when a.n_relevant > 0 then coalesce(found10, 0) / a.n_relevant::double else 0 end as r10
from asked a left join (
  select query_id, count(*) filter (relevant and rank <= 1) / least(1, count(*))::double as p1,
         count(*) filter (relevant and rank <= 3) / least(3, count(*))::double as p3,
         count(*) filter (relevant and rank <= 5) / least(5, count(*))::double as p5,
         count(*) filter (relevant and rank <= 10) / least(10, count(*))::double as p10,
         count(*) filter (relevant and rank <= 10) as found10,
         coalesce(1.0 / min(rank) filter (relevant), 0) as rr, avg(score) as avg_score,
         count(*) filter (relevant) as found, max(case when rank = 1 and relevant then 1 else 0 end) as top_relevant
  from judged group by query_id) m on m.query_id = a.query_id
""",
        ("judged", "asked"),
    ),
    "feed": (
        """
select event_id, ts, user_id, event_type, value, '/src' || user_id as path,
       case event_type when 'purchase' then 'change' when 'error' then 'unlink' else 'add' end as op from events
""",
        (),
    ),
    "current": (
        """
select l.path, l.size_bytes, l.mtime_ms, lower(l.ext) as ext, s.path is not null as has_status, s.status, s.parser_version,
       s.chunk_count, s.error_message, s.last_modified_ms, s.indexed_at_ms, s.file_hash, s.last_retry_ms,
       r.version as current_version, md5(concat(l.path, ':', l.size_bytes, ':', l.mtime_ms)) as current_hash,
       r.version is not null and r.version > 0
         and (coalesce(s.parser_version, 0) = 0 or s.parser_version < r.version) as behind,
       s.last_retry_ms is null or 1735689600000 - s.last_retry_ms > 24 * 3600000 as due
from listing l left join status s on s.path = l.path left join registry r on r.ext = lower(l.ext)
""",
        ("listing", "status", "registry"),
    ),
    "decision": (
        """
select path, has_status, case when not has_status then 'new-file' when status = 'outdated' then 'outdated'
       when behind then 'parser-upgraded'
       when case when coalesce(file_hash, '') <> '' then file_hash <> current_hash
                 when last_modified_ms is not null then mtime_ms > last_modified_ms else true end then 'modified'
       when status in ('failed', 'error') and due then 'retry-failed' end as reason from current
""",
        ("current",),
    ),
    "rule": (
        """
select *, case when current_version is null then false when not has_status then true
     when coalesce(file_hash, '') <> current_hash then true when behind then true
     when status in ('failed', 'error') and due then true else false end as reindex from current
""",
        ("current",),
    ),
    "gone": (
        """
select distinct s.path from status s join folders f on starts_with(s.path, f.folder || '/')
where s.path not in (select path from listing)
""",
        ("status", "folders", "listing"),
    ),
    "plan": (
        """
select path, case when reason is null then 'skip' else 'index' end as action, reason, has_status from decision
union all select path, 'remove', null, true from gone
""",
        ("decision", "gone"),
    ),
    "category": (
        """
select path, case when reason is null then 'skipped' when reason = 'new-file' then 'new'
     when reason = 'retry-failed' then 'failed' when reason = 'modified' then 'modified' else 'outdated' end as category
from decision
""",
        ("decision",),
    ),
}


def oracle(body: str, *ctes: str) -> str:
    """SQL text with the named derived tables, and those they need, in front."""
    ordered: list[str] = []

    def need(name: str) -> None:
        for other in _CTES[name][1]:
            need(other)
        if name not in ordered:
            ordered.append(name)

    for name in ctes:
        need(name)
    head = ", ".join(f"{name} as ({_CTES[name][0]})" for name in ordered)
    return f"with recursive {head} {body}" if head else body
