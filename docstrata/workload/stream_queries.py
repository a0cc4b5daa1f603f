"""Checked queries: the change feed, run as streams over the given events and compared with their batch meaning."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.session import fresh_dir
from docstrata.sources import store
from docstrata.streaming import feed, maintain
from docstrata.workload import tables as t
from docstrata.workload.registry import query
from docstrata.workload.tables import NOW_MS, oracle
from docstrata.workload.text_queries import sentence_chunk_sql


def event_stream(spark, sf) -> DataFrame:
    """The events table as a stream of change events."""
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    raw = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(sf)
    return t.change_feed(raw)


def event_batches(spark, sf) -> DataFrame:
    """The same in three micro-batches in order of time."""
    rows = spark.read.parquet(f"{sf}/events.parquet")
    cuts = rows.select(F.expr("percentile_approx(unix_micros(cast(ts as timestamp)), array(0.33, 0.66))")).first()[0]
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    part = F.when(micros <= cuts[0], 0).when(micros <= cuts[1], 1).otherwise(2)
    path = fresh_dir(spark, "events")
    for k in range(3):
        rows.where(part == k).coalesce(1).write.mode("append").parquet(f"{path}/part={k}")
        time.sleep(1.1)  # the file source goes by modification time
    raw = (
        spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(path)
    )
    return t.change_feed(raw)


def drain(stream: DataFrame, mode: str) -> DataFrame:
    """Runs a stream over what is there; its output with the number of the micro-batch in `batch`."""
    spark = stream.sparkSession
    out, checkpoint = fresh_dir(spark, "stream"), fresh_dir(spark, "progress")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    running = (
        stream.writeStream.outputMode(mode)
        .foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    running.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.IntegerType())])
    return spark.read.schema(schema).parquet(out)


def newest(output: DataFrame, *key: str) -> DataFrame:
    """Last state of each key over the micro-batches of an update or complete stream."""
    columns = [c for c in output.columns if c != "batch"]
    return output.groupBy(*key).agg(F.max_by(F.struct(*columns), "batch").alias("row")).select("row.*")


def _with_files(spark, sf, events: DataFrame) -> DataFrame:
    """Events moved from users to files: user n works on document n."""
    files = t.listing(spark, sf).select(F.col("doc_id").alias("user_id"), F.col("path").alias("file"))
    moved = events.join(files, "user_id", "left").withColumn("path", F.coalesce("file", "path"))
    return moved.select("event_id", "ts", "path", "op")


_FILE_EVENTS = """
, moved as (select f.event_id, f.ts, coalesce(l.path, f.path) as path, f.op from feed f left join listing l on l.doc_id = f.user_id)
"""


@query(
    "w1_event_source",
    oracle("select event_id, epoch_us(ts) as ts_us, path, op from feed", "feed"),
)
def event_source(spark, sf):
    out = drain(event_stream(spark, sf), "append")
    return out.select("event_id", F.unix_micros("ts").alias("ts_us"), "path", "op")


@query(
    "w2_debounce",
    oracle(
        """
, marked as (select *, case when ts - lag(ts) over (partition by path order by ts, event_id) <= interval 2 hour then 0 else 1 end as opens from feed),
numbered as (select *, sum(opens) over (partition by path order by ts, event_id) as burst from marked)
select path, arg_max(op, (ts, event_id)) as op, count(*) as changes, epoch_us(min(ts)) as opened_us,
       epoch_us(max(ts) + interval 2 hour) as settled_us
from numbered group by path, burst
having max(ts) + interval 2 hour <= (select date_trunc('milliseconds', max(ts)) - interval 1 hour from feed)
""",
        "feed",
    ),
)
def debounce(spark, sf):
    """Bursts with a quiet period of two hours; those still open at the watermark are not final yet."""
    out = drain(feed.debounce(event_stream(spark, sf), "2 hours"), "append")
    return out.select(
        "path", "op", "changes", F.unix_micros("opened").alias("opened_us"), F.unix_micros("settled").alias("settled_us")
    )


@query(
    "w3_route",
    oracle(
        """
@@ select m.event_id, m.path, m.op, case when m.op = 'unlink' then 'delete' when r.current_version is null then 'ignore'
     when m.op = 'change' then 'index' when r.reindex then 'index' else 'ignore' end as action
from moved m left join rule r on r.path = m.path
""",
        "feed",
        "rule",
    ).replace(" \n@@", _FILE_EVENTS),
)
def route(spark, sf):
    events = _with_files(spark, sf, event_stream(spark, sf))
    routed = feed.route(events, t.listing(spark, sf), t.status(spark, sf), t.registry(spark), NOW_MS)
    return drain(routed, "append").select("event_id", "path", "op", "action")


_MAINTAINED = """
, last as (select path, arg_max(op, (ts, event_id)) as op from moved group by path),
decided as (select l.path, case when l.op = 'unlink' then 'delete' when r.current_version is null then 'ignore'
     when l.op = 'change' then 'index' when r.reindex then 'index' else 'ignore' end as action
  from last l left join rule r on r.path = l.path),
cut as (select * from (@@) z),
fresh as (select sha1(concat(path, ':0:', "offset")) as id, * from cut where path in (select path from decided where action = 'index'))
"""
_CUT = sentence_chunk_sql("corpus", "path", 500, 60)


def _maintained(body: str) -> str:
    head = oracle("@@", "feed", "rule", "chunks")
    return head.replace(" @@", _FILE_EVENTS + _MAINTAINED.replace("@@", _CUT)) + body


def _maintain(spark, sf):
    """The stores after the feed ran over them."""
    corpus = t.corpus(spark, sf).select("path", "size_bytes", "mtime_ms", "text")
    chunks = store.chunk_store(spark, fresh_dir(spark, "chunks"), buckets=8)
    status = store.status_store(spark, fresh_dir(spark, "status"), buckets=8)
    for table, rows in ((chunks, t.chunks(spark, sf)), (status, t.status(spark, sf))):
        table.create()
        table.overwrite(rows)
    running = maintain.maintain(
        _with_files(spark, sf, event_stream(spark, sf)),
        maintain.loader(corpus),
        chunks,
        status,
        t.registry(spark),
        fresh_dir(spark, "progress"),
        lambda: NOW_MS,
    )
    running.awaitTermination()
    return chunks, status


@query(
    "w4_maintain_chunks",
    _maintained(
        """
select id, path, "offset", text from chunks where path not in (select path from decided where action <> 'ignore')
union all select id, path, "offset", text from fresh qualify row_number() over (partition by id order by chunk_index desc) = 1
"""
    ),
)
def maintain_chunks(spark, sf):
    chunks, _ = _maintain(spark, sf)
    return chunks.read().select("id", "path", "offset", "text")


@query(
    "w4_maintain_status",
    _maintained(
        """
select path, status, chunk_count, last_retry_ms from status where path not in (select path from decided where action <> 'ignore')
union all
select path, case when action = 'delete' then 'deleted' when n > 0 then 'indexed' else 'failed' end,
       cast(case when action = 'delete' then 0 else n end as int), cast(null as bigint)
from (select d.path, d.action, (select count(distinct f.id) from fresh f where f.path = d.path) as n from decided d where action <> 'ignore') x
"""
    ),
)
def maintain_status(spark, sf):
    _, status = _maintain(spark, sf)
    return status.read().select(
        "path", "status", "chunk_count", F.unix_millis("last_retry").alias("last_retry_ms")
    )


_SUPPRESSED = oracle(
    """
, marked as (select event_id, path, op, ts, lag(op) over w as op_before, lag(ts) over w as ts_before from feed
  window w as (partition by path order by ts, event_id))
select event_id, path, op from marked where not coalesce(op_before = op and ts - ts_before <= interval 1 hour, false)
""",
    "feed",
)


def _marked(events: DataFrame) -> DataFrame:
    return events.withColumn("fingerprint", F.md5(F.concat_ws(":", "path", "op")))


@query("w5_suppress_in_flight", _SUPPRESSED)
def suppress_in_flight(spark, sf):
    return drain(feed.suppress_in_flight(_marked(event_stream(spark, sf))), "append").select("event_id", "path", "op")


@query("w5_suppress_in_batches", _SUPPRESSED)
def suppress_in_batches(spark, sf):
    """The same over three micro-batches, so that what was seen before is state."""
    return drain(feed.suppress_in_flight(_marked(event_batches(spark, sf))), "append").select("event_id", "path", "op")


@query("w5_suppress_static", _SUPPRESSED)
def suppress_static(spark, sf):
    return feed.suppress_in_flight(_marked(t.events(spark, sf))).select("event_id", "path", "op")


_COMPLETION = oracle(
    """
select path, epoch_us(date_trunc('day', ts)) as started_us, 3 as total, count(*) as processed,
       count(*) filter (op = 'unlink') as errors, count(*) >= 3 as complete
from feed group by path, date_trunc('day', ts)
""",
    "feed",
)


def _completion(stream: DataFrame) -> DataFrame:
    started = F.date_trunc("day", "ts")
    chunk_events = stream.select(
        "path",
        started.cast("string").alias("run"),
        started.alias("started"),
        F.lit(3).alias("total"),
        F.lit(1).alias("processed"),
        F.when(F.col("op") == "unlink", 1).otherwise(0).alias("errors"),
    ).withWatermark("started", "30 days")
    found = newest(drain(feed.track_completion(chunk_events), "update"), "path", "started")
    return found.select("path", F.unix_micros("started").alias("started_us"), "total", "processed", "errors", "complete")


@query("w6_track_completion", _COMPLETION)
def track_completion(spark, sf):
    """Every event is a processed chunk, an unlink a failed one; the events of a day are a run."""
    return _completion(event_stream(spark, sf))


@query("w6_track_in_batches", _COMPLETION)
def track_in_batches(spark, sf):
    return _completion(event_batches(spark, sf))


_TOTALS = oracle(
    """
, steps as (select path as folder, sum(case op when 'add' then 1 else -1 end) over (partition by path order by ts, event_id) as run,
       case op when 'add' then 1 else -1 end as step from feed where op in ('add', 'unlink'))
select folder, cast(sum(step) - least(0, min(run)) as bigint) as total from steps group by folder
""",
    "feed",
)


@query("w7_folder_totals_stream", _TOTALS)
def folder_totals_stream(spark, sf):
    schema = T.StructType([T.StructField("folder", T.StringType()), T.StructField("total", T.LongType())])
    totals = store.SnapshotTable(spark, fresh_dir(spark, "totals"), schema, "folder", "folder", None, buckets=4)
    totals.create()
    events = event_stream(spark, sf).withColumnRenamed("path", "folder")
    maintain.maintain_totals(events, totals, fresh_dir(spark, "progress")).awaitTermination()
    return totals.read()


@query("w7_folder_totals", _TOTALS)
def folder_totals(spark, sf):
    return feed.folder_totals(t.events(spark, sf).withColumnRenamed("path", "folder"))


_STATES = """
select case op when 'add' then 'queued' when 'change' then 'processing' else 'error' end as state, count(*) as files from feed group by 1
"""


def _states(events: DataFrame) -> DataFrame:
    state = F.when(F.col("op") == "add", "queued").when(F.col("op") == "change", "processing").otherwise("error")
    return events.select(state.alias("state"))


@query("w8_progress", oracle(_STATES, "feed"))
def progress(spark, sf):
    return newest(drain(feed.progress(_states(event_stream(spark, sf))), "complete"), "state")


@query(
    "w8_status_line",
    oracle(
        "select count(*) as remaining, 'Indexing (' || count(*) || ' remaining)' as line from feed where op <> 'unlink'", "feed"
    ),
)
def status_line(spark, sf):
    return feed.status_line(feed.progress(_states(t.events(spark, sf))))
