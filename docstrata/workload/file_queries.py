"""Checked queries over real files, written by tasks from `documents`: listing, the index job, the change stream."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.plans import indexing
from docstrata.session import fresh_dir
from docstrata.sources import store, walk
from docstrata.streaming.folder_source import FolderChanges
from docstrata.workload import tables as t
from docstrata.workload.registry import query
from docstrata.workload.text_queries import _collapse, sentence_chunk_sql


def write_files(rows: DataFrame) -> None:
    """Writes `rows(path, text)` as files; a null text takes the file away."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                system, inner, _ = walk._opened(path)
                if text is None:
                    system.delete_file(inner)
                    continue
                system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
                with system.open_output_stream(inner) as out:
                    out.write(text.encode())
            yield batch.select(["path"]).slice(0, 0)

    rows.select("path", "text").mapInArrow(write, "path string").count()


def _docs(spark, sf) -> DataFrame:
    """Documents with a visible character, and their place in the tree."""
    rows = t.documents(spark, sf).where(r"text rlike '[^\\x20\\x09-\\x0D\\u00A0\\u3000]'")
    folder = F.concat(F.coalesce("source", F.lit("none")), F.when(F.col("source") == "src3", ".app").otherwise(""))
    return rows.select("doc_id", "text", F.concat_ws("/", folder, F.coalesce("lang", F.lit("none")), F.concat("doc_id", F.lit(".txt"))).alias("rel"))


_DOCS = r"""
docs as (
  select doc_id, text, coalesce(source, 'none') || case when source = 'src3' then '.app' else '' end || '/' || coalesce(lang, 'none')
    || '/' || doc_id || '.txt' as rel
  from documents where regexp_matches(text, '[^\x20\x09-\x0D\x{00A0}\x{3000}]'))
"""


def _at(root: str) -> Column:
    return F.concat(F.lit(f"{root}/"), "rel")


def _relative(df: DataFrame, root: str) -> DataFrame:
    inner = walk._opened(root)[1]
    return df.withColumn("path", F.substring("path", len(inner) + 2, 2**31 - 1))


@query(
    "s1_walk_tree",
    f"with {_DOCS} select rel as path, strlen(text) as size_bytes from docs where rel not like '%.app/%' and rel not like '%/de/%'",
)
def walk_tree(spark, sf):
    """The files outside a bundle and an excluded folder, listed by levels."""
    root = fresh_dir(spark, "files")
    write_files(_docs(spark, sf).select(_at(root).alias("path"), "text"))
    found = walk.walk_corpus(spark, [root], ["/de/"], ["**/*.app/**"], ["txt"])
    return _relative(found, root).select("path", "size_bytes")


_OLD, _NEW = "doc_id % 3 <> 0", "doc_id % 3 = 0"
_CHANGED, _GONE = f"{_OLD} and doc_id % 5 = 1", f"{_OLD} and doc_id % 5 <> 1 and doc_id % 7 = 2"


def _second_state(docs: DataFrame, root: str) -> DataFrame:
    """What leads from the first state of the tree, two thirds of the documents, to the second."""
    text = F.when(F.expr(_GONE), F.lit(None)).when(F.expr(_CHANGED), F.concat("text", F.lit(" More."))).otherwise(F.col("text"))
    return docs.where(f"{_NEW} or ({_CHANGED}) or ({_GONE})").select(_at(root).alias("path"), text.alias("text"))


@query(
    "w1_folder_changes",
    f"""
with {_DOCS}
select 1 as trigger, rel as path, 'add' as op, strlen(text) as size_bytes from docs where {_OLD}
union all select 2, rel, 'add', strlen(text) from docs where {_NEW}
union all select 2, rel, 'change', strlen(text) + 6 from docs where {_CHANGED}
union all select 2, rel, 'unlink', strlen(text) from docs where {_GONE}
""",
)
def folder_changes(spark, sf):
    """A folder followed over three triggers: filled, changed, left as it is."""
    root, out, progress = (fresh_dir(spark, x) for x in ("files", "events", "progress"))
    spark.dataSource.register(FolderChanges)
    docs = _docs(spark, sf)
    source = spark.readStream.format("folder_changes").option("path", root).option("state", f"{progress}/listings")
    steps = [docs.where(_OLD).select(_at(root).alias("path"), "text"), _second_state(docs, root), None]
    for trigger, step in enumerate(steps, 1):
        if step is not None:
            write_files(step)
        write = lambda df, k, n=trigger: df.withColumn("trigger", F.lit(n)).write.mode("overwrite").parquet(f"{out}/{n}-{k}")
        running = source.load().writeStream.foreachBatch(write).option("checkpointLocation", f"{progress}/checkpoint")
        running.trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.option("recursiveFileLookup", "true").parquet(out)
    return _relative(rows, root).select("trigger", "path", "op", "size_bytes")


@query(
    "p13_index_tree",
    f"""
with {_DOCS},
state as (select rel, {_collapse("case when " + _CHANGED + " then text || ' More.' else text end")} as text, {_GONE} as gone from docs),
kept as (select rel, text from state where not gone),
cut as ({sentence_chunk_sql("kept", "rel", 500, 60)})
select rel as path, case when gone then 'deleted' else 'indexed' end as status,
  case when gone then 0 else (select count(distinct "offset") from cut where cut.rel = state.rel) end::int as chunk_count
from state
""",
)
def index_tree(spark, sf):
    """The whole index job over a tree, then once more after files were added, changed and removed. The second run may
    open the added and the changed files only. Of chunks that begin at one offset, and so share their id, the last is
    stored and counted; it contains the others."""
    root = fresh_dir(spark, "files")
    docs = _docs(spark, sf)
    chunks, status = store.chunk_store(spark, fresh_dir(spark, "chunks"), buckets=8), store.status_store(spark, fresh_dir(spark, "status"), buckets=8)
    for table in (chunks, status):
        table.create()
    write_files(docs.where(_OLD).select(_at(root).alias("path"), "text"))
    indexing.index_tree(spark, [root], t.registry(spark), chunks, status, t.NOW_MS)
    write_files(_second_state(docs, root))
    indexing.index_tree(spark, [root], t.registry(spark), chunks, status, t.NOW_MS)
    return _relative(status.read(), root).select("path", "status", "chunk_count")
