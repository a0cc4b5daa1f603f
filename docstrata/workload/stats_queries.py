"""Checked queries: profiles and latency figures over the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from docstrata.operators import stats
from docstrata.workload import tables as t
from docstrata.workload.registry import query

# Event types stand for operations; errors are failed files.
_OPS = {"click": "embedding", "view": "parsing", "signup": "dbWrite", "purchase": "hashCheck", "error": "total"}
_OP_SQL = "case event_type " + " ".join(f"when '{k}' then '{v}'" for k, v in _OPS.items()) + " end"


def _op():
    out = F.lit(None).cast("string")
    for event, op in _OPS.items():
        out = F.when(F.col("event_type") == event, op).otherwise(out)
    return out


def _round(df, *columns):
    return df.withColumns({c: F.round(c, 4) for c in columns})


def _profile(spark, sf):
    return t.events(spark, sf).select(_op().alias("op"), F.col("value").alias("ms"), (F.col("value") < 100).alias("ok"))


_BREAKDOWN = f"""
select op, count(*) as calls, sum(ms) as total_ms, avg(ms) as avg_ms, min(ms) as min_ms, max(ms) as max_ms,
       sum(ms) / sum(sum(ms)) over () * 100 as percent
from (select {_OP_SQL} as op, value as ms from events where value < 100) e where op <> 'total' and ms <> 0 group by op
"""


@query(
    "a2_operation_breakdown",
    f"""
select op, calls, round(total_ms, 4) as total_ms, round(avg_ms, 4) as avg_ms, min_ms, max_ms, round(percent, 4) as percent
from ({_BREAKDOWN}) b
""",
)
def operation_breakdown(spark, sf):
    return _round(stats.operation_breakdown(_profile(spark, sf)), "total_ms", "avg_ms", "percent")


@query(
    "a2_breakdown_from_maps",
    """
select op, cast(count(*) as bigint) as calls, round(sum(ms), 4) as total_ms from (
  select 'parsing' as op, value as ms from events union all select 'embedding', value * 3 from events) e where ms <> 0 group by op
""",
)
def breakdown_from_maps(spark, sf):
    """Profile records with their timings as a map."""
    records = t.events(spark, sf).select(
        F.lit(True).alias("ok"),
        F.create_map(F.lit("parsing"), "value", F.lit("embedding"), F.col("value") * 3, F.lit("total"), F.col("value") * 4)
        .alias("timings"),
    )
    report = stats.operation_breakdown(stats.explode_timings(records))
    return _round(report, "total_ms").select("op", "calls", "total_ms")


@query(
    "a3_file_type_breakdown",
    """
select event_type as ext, count(*) as files, round(avg(coalesce(ms, 0)), 4) as avg_ms, cast(sum(user_id) as bigint) as total_size,
       round(avg(user_id), 4) as avg_size
from (select *, case when value < 300 then value end as ms from events) e group by event_type
""",
)
def file_type_breakdown(spark, sf):
    files = t.events(spark, sf).select(
        F.col("event_type").alias("ext"),
        F.col("user_id").alias("size_bytes"),
        F.when(F.col("value") < 300, F.col("value")).alias("total_ms"),
    )
    return _round(stats.file_type_breakdown(files), "avg_ms", "avg_size")


@query(
    "a4_bottlenecks",
    f"""
select b.op, round(percent, 4) as percent, round(total_ms, 4) as total_ms
from (select *, row_number() over (order by total_ms desc, op) as place from ({_BREAKDOWN}) x) b
join (values ('embedding', 40.0), ('parsing', 30.0), ('dbWrite', 20.0), ('hashCheck', 10.0)) as l(op, threshold) on l.op = b.op
where place <= 3 and percent > threshold
""",
)
def bottlenecks(spark, sf):
    found = stats.bottlenecks(stats.operation_breakdown(_profile(spark, sf)))
    return _round(found, "percent", "total_ms")


@query(
    "a5_run_summary",
    """
select count(*) as files, count(*) filter (event_type <> 'error') as succeeded, count(*) filter (event_type = 'error') as failed,
       max(s + value * 1000) - min(s) as duration_ms, round((max(s + value * 1000) - min(s)) / count(*), 4) as avg_file_ms,
       round(count(*) / ((max(s + value * 1000) - min(s)) / 1000), 8) as files_per_second,
       max(value) as peak_mb, round(avg(value), 4) as avg_mb,
       round(sum(case when value > 200 then value else 0 end) / (max(s + value * 1000) - min(s)) * 100, 6) as throttled_percent
from (select *, (epoch_us(ts) // 1000)::double as s from events) e
""",
)
def run_summary(spark, sf):
    rows = t.events(spark, sf)
    start = F.unix_millis("ts").cast("double")
    files = rows.select(
        start.alias("start_ms"), (start + F.col("value") * 1000).alias("end_ms"), (F.col("event_type") != "error").alias("ok")
    )
    memory = rows.select(
        F.col("value").alias("rss_mb"), F.when(F.col("value") > 200, F.col("value")).otherwise(0.0).alias("throttled_ms")
    )
    report = _round(stats.run_summary(files, memory), "avg_file_ms", "avg_mb")
    return report.withColumns(
        {"files_per_second": F.round("files_per_second", 8), "throttled_percent": F.round("throttled_percent", 6)}
    )


def _latency_sql(by: str) -> str:
    return f"""
select {by}, count(*) as samples, min(value) as min, max(value) as max, round(avg(value), 8) as avg,
       max(value) filter (rn = floor(n * 0.50)) as p50, max(value) filter (rn = floor(n * 0.95)) as p95,
       max(value) filter (rn = floor(n * 0.99)) as p99
from (select {by}, value, row_number() over (partition by {by} order by value) - 1 as rn, count(*) over (partition by {by}) as n
      from events) e group by {by}
"""


def _latency(spark, sf, by):
    return stats.latency_stats(t.events(spark, sf), by, "value").withColumn("avg", F.round("avg", 8))


@query("a6_latency_stats", _latency_sql("event_type"))
def latency_stats(spark, sf):
    return _latency(spark, sf, "event_type")


@query("a6_latency_by_user", _latency_sql("user_id"))
def latency_by_user(spark, sf):
    return _latency(spark, sf, "user_id")


@query(
    "a7_throughput",
    """
select *, round(t / max(case when threads = 1 then t end) over (partition by text_size, batch_size), 6) as speedup,
       round(t, 4) as texts_per_s
from (select text_size, batch_size, threads, count(*) as requests, count(*) * batch_size / (sum(value) / threads / 1000) as t,
             round(count(*) * batch_size * text_size / (sum(value) / threads / 1000), 4) as chars_per_s,
             round(count(*) / (sum(value) / threads / 1000), 4) as batches_per_s,
             round(count(*) filter (value < 100) / count(*) * 100, 4) as success_rate
      from (select case when event_type in ('click', 'view') then 500 else 2000 end as text_size,
                   case when event_type in ('click', 'error') then 32 else 64 end as batch_size,
                   case when hour(ts) < 8 then 1 when hour(ts) < 16 then 2 else 4 end as threads, value from events) x
      group by text_size, batch_size, threads) y
""".replace("select *,", "select text_size, batch_size, threads, requests, chars_per_s, batches_per_s, success_rate,"),
)
def throughput(spark, sf):
    samples = t.events(spark, sf).select(
        F.when(F.col("event_type").isin("click", "view"), 500).otherwise(2000).alias("text_size"),
        F.when(F.col("event_type").isin("click", "error"), 32).otherwise(64).alias("batch_size"),
        F.when(F.hour("ts") < 8, 1).when(F.hour("ts") < 16, 2).otherwise(4).alias("threads"),
        F.col("value").alias("ms"),
        (F.col("value") < 100).alias("ok"),
    )
    report = stats.throughput(samples).withColumn("speedup", F.round("speedup", 6))
    return _round(report, "texts_per_s", "chars_per_s", "batches_per_s", "success_rate")


@query(
    "a8_slope",
    """
select event_type, round(case when min(x) = max(x) then 0 else regr_slope(value, x) end, 6) as slope
from (select event_type, value, case when event_type = 'view' then 1 else user_id end as x from events) e group by event_type
""",
)
def slope(spark, sf):
    """One group with a constant x."""
    points = t.events(spark, sf).withColumn("x", F.when(F.col("event_type") == "view", 1).otherwise(F.col("user_id")))
    return stats.slope(points, "x", "value", "event_type").withColumn("slope", F.round("slope", 6))
