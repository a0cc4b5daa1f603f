"""Index statistics, pipeline profiles and latency figures."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.frames import attach, values_frame
from docstrata.functions import paths
from docstrata.operators import lookups
from docstrata.session import fresh_dir

# Operation -> share of total time (percent) above which it is a bottleneck.
BOTTLENECKS = [("embedding", 40.0), ("parsing", 30.0), ("dbWrite", 20.0), ("hashCheck", 10.0)]

# The percentiles of a latency report.
PERCENTILES = {"p50": 0.50, "p95": 0.95, "p99": 0.99}


def index_stats(chunks: DataFrame, status: DataFrame, listing: DataFrame, folders: DataFrame) -> DataFrame:
    """`(folder, total_files, indexed_files, all_chunks, all_indexed)`, one row per watched folder.

    Files are counted per directory first; only directories meet the folder list.
    """
    indexed = status.where("status = 'indexed'").select("path")
    directory = paths.parent_dir("path").alias("directory")
    per_dir = (
        listing.select(directory, F.lit(1).alias("total"), F.lit(0).alias("indexed"))
        .unionByName(indexed.select(directory, F.lit(0).alias("total"), F.lit(1).alias("indexed")))
        .groupBy("directory")
        .agg(F.sum("total").alias("total"), F.sum("indexed").alias("indexed"))
    )
    # A directory stands for its files: any name below it has the same folder.
    placed = lookups.assign_folder(
        per_dir.withColumn("path", F.concat("directory", F.lit("/."))), folders
    )
    per_folder = (
        placed.where("folder is not null")
        .groupBy("folder")
        .agg(F.sum("total").alias("total_files"), F.sum("indexed").alias("indexed_files"))
    )
    counted = (
        folders.select("folder")
        .join(per_folder, "folder", "left")
        .select(
            "folder",
            F.coalesce("total_files", F.lit(0)).cast("long").alias("total_files"),
            F.coalesce("indexed_files", F.lit(0)).cast("long").alias("indexed_files"),
        )
    )
    with_chunks = attach(counted, chunks.agg(F.count("*").alias("all_chunks")))
    return attach(with_chunks, indexed.agg(F.count("*").alias("all_indexed")))


def explode_timings(profile: DataFrame) -> DataFrame:
    """Profile records with a `timings` map -> one row per file and operation `(..., op, ms)`."""
    kept = [c for c in profile.columns if c != "timings"]
    return profile.select(*kept, F.explode("timings").alias("op", "ms"))


def operation_breakdown(profile: DataFrame) -> DataFrame:
    """`(op, calls, total_ms, avg_ms, min_ms, max_ms, percent)` over the operations of successful files.

    `profile(op, ms, ok)`; the whole-file timer `total` and empty timings do not count.
    """
    used = profile.where((F.col("op") != "total") & (F.col("ms") != 0) & F.col("ok"))
    per_op = used.groupBy("op").agg(
        F.count("*").alias("calls"),
        F.sum("ms").alias("total_ms"),
        F.avg("ms").alias("avg_ms"),
        F.min("ms").alias("min_ms"),
        F.max("ms").alias("max_ms"),
    )
    # The window spans one row per operation kind.
    return per_op.withColumn("percent", F.col("total_ms") / F.sum("total_ms").over(Window.partitionBy()) * 100)


def file_type_breakdown(files: DataFrame) -> DataFrame:
    """`files(ext, size_bytes, total_ms)` -> `(ext, files, avg_ms, total_size, avg_size)`; no timing counts as 0."""
    return files.groupBy("ext").agg(
        F.count("*").alias("files"),
        F.avg(F.coalesce("total_ms", F.lit(0.0))).alias("avg_ms"),
        F.sum("size_bytes").alias("total_size"),
        F.avg("size_bytes").alias("avg_size"),
    )


def bottlenecks(
    breakdown: DataFrame, thresholds: Sequence[tuple[str, float]] = tuple(BOTTLENECKS), n: int = 3
) -> DataFrame:
    """`(op, percent, total_ms)` of the `n` longest operations that exceed their own threshold."""
    limits = values_frame(breakdown.sparkSession, list(thresholds), "op string, threshold double")
    longest = breakdown.orderBy(F.desc("total_ms"), "op").limit(n)
    return longest.join(limits, "op").where("percent > threshold").select("op", "percent", "total_ms")


def run_summary(files: DataFrame, memory: DataFrame) -> DataFrame:
    """One row over `files(start_ms, end_ms, ok)` and `memory(rss_mb, throttled_ms)`.

    Duration is the wall-clock span of the run; average file time is that span over the number of files.
    """
    runs = files.agg(
        F.count("*").alias("files"),
        F.count(F.when(F.col("ok"), 1)).alias("succeeded"),
        F.count(F.when(~F.col("ok"), 1)).alias("failed"),
        (F.max("end_ms") - F.min("start_ms")).alias("duration_ms"),
    )
    samples = memory.agg(
        F.max("rss_mb").alias("peak_mb"),
        F.avg("rss_mb").alias("avg_mb"),
        F.sum("throttled_ms").alias("throttled_ms"),
    )
    return attach(runs, samples).select(
        "files",
        "succeeded",
        "failed",
        "duration_ms",
        (F.col("duration_ms") / F.col("files")).alias("avg_file_ms"),
        (F.col("files") / (F.col("duration_ms") / 1000)).alias("files_per_second"),
        "peak_mb",
        "avg_mb",
        (F.col("throttled_ms") / F.col("duration_ms") * 100).alias("throttled_percent"),
    )


def latency_stats(samples: DataFrame, by: str, value: str = "ms") -> DataFrame:
    """`(by, samples, min, max, avg, p50, p95, p99)`, a percentile being the element at place `floor(n * p)` of
    the sorted values.

    No group is ever sorted whole, whatever its size or the spread of its values. Equal values are counted first; the
    counts are dealt into slices by range of (group, value), written, and summed by slice; only the slice that holds a
    wanted place is ranked.
    """
    spark = samples.sparkSession
    rows = samples.select(F.col(by).alias("g"), F.col(value).cast("double").alias("v")).where("v is not null")
    counted = rows.groupBy("g", "v").agg(F.count("*").alias("c"))
    dealt = counted.repartitionByRange("g", "v").withColumn("slice", F.spark_partition_id())
    path = fresh_dir(spark, "ranks")
    dealt.write.parquet(path)
    held = spark.read.schema(dealt.schema).parquet(path)
    slices = held.groupBy("g", "slice").agg(
        F.sum("c").alias("c"), F.min("v").alias("low"), F.max("v").alias("high"), F.sum(F.col("v") * F.col("c")).alias("total")
    )
    earlier = Window.partitionBy("g").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    slices = slices.withColumn("before", F.coalesce(F.sum("c").over(earlier), F.lit(0)))
    groups = slices.groupBy("g").agg(
        F.sum("c").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"), (F.sum("total") / F.sum("c")).alias("avg")
    )
    places = F.array(
        *[
            F.struct(F.lit(name).alias("p"), F.floor(F.col("n") * F.lit(share)).cast("long").alias("at"))
            for name, share in PERCENTILES.items()
        ]
    )

    def holds(at: Column) -> Column:
        return (at >= F.col("before")) & (at < F.col("before") + F.col("c"))

    wanted = (
        slices.join(groups.select("g", "n"), "g")
        .select("g", "slice", "before", F.explode(F.filter(places, lambda t: holds(t["at"]))).alias("t"))
        .select("g", "slice", F.col("t.p").alias("p"), (F.col("t.at") - F.col("before")).alias("rest"))
    )
    inside = Window.partitionBy("g", "slice", "p").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    picked = (
        held.join(wanted, ["g", "slice"])
        .withColumn("before", F.coalesce(F.sum("c").over(inside), F.lit(0)))
        .where(holds(F.col("rest")))
        .groupBy("g")
        .agg(*[F.max(F.when(F.col("p") == name, F.col("v"))).alias(name) for name in PERCENTILES])
    )
    return groups.join(picked, "g").select(
        F.col("g").alias(by),
        F.col("n").alias("samples"),
        F.col("low").alias("min"),
        F.col("high").alias("max"),
        "avg",
        *PERCENTILES,
    )


def throughput(samples: DataFrame, by: Sequence[str] = ("text_size", "batch_size")) -> DataFrame:
    """Rates per configuration and thread count, and the speed-up over the one-thread row of the configuration.

    `samples(text_size, batch_size, threads, ms, ok)`, one row per request; threads run side by side, so the
    run lasts the summed time divided by the threads.
    """
    seconds = F.sum("ms") / F.col("threads") / 1000
    texts = F.count("*") * F.col("batch_size")
    rates = samples.groupBy(*by, "threads").agg(
        F.count("*").alias("requests"),
        (texts / seconds).alias("texts_per_s"),
        (texts * F.col("text_size") / seconds).alias("chars_per_s"),
        (F.count("*") / seconds).alias("batches_per_s"),
        (F.count(F.when(F.col("ok"), 1)) / F.count("*") * 100).alias("success_rate"),
    )
    single = F.max(F.when(F.col("threads") == 1, F.col("texts_per_s"))).over(Window.partitionBy(*by))
    return rates.withColumn("speedup", F.col("texts_per_s") / single)


def slope(df: DataFrame, x: str, y: str, by: str) -> DataFrame:
    """`(by, slope)` of the least-squares line; 0 when `x` does not vary."""
    # Merged partial means of a constant may be off by a last digit, and its variance then is not 0.
    used = F.when(F.col(y).isNotNull(), F.col(x))
    line = F.when(F.min(used) < F.max(used), F.regr_slope(y, x))
    return df.groupBy(by).agg(F.coalesce(line, F.lit(0.0)).alias("slope"))


def text_profile(df: DataFrame, text: str = "text", by: str | None = None) -> DataFrame:
    """Count, lengths, estimated tokens and non-ASCII share of a batch of texts."""
    n = F.length(text)
    odd = F.regexp_count(text, F.lit(r"[^\x00-\x7F]"))
    grouped = df.groupBy(by) if by else df.groupBy()
    return grouped.agg(
        F.count(text).alias("texts"),
        F.sum(n).cast("long").alias("total_chars"),
        F.avg(n).alias("avg_chars"),
        F.min(n).alias("min_chars"),
        F.max(n).alias("max_chars"),
        F.sum(paths.est_tokens(text, 2.5)).cast("long").alias("est_tokens"),
        F.sum(odd).cast("long").alias("non_ascii"),
        (F.sum(odd) / F.sum(n) * 100).alias("non_ascii_percent"),
    )
