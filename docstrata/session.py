"""Session construction and the few session-level settings the library relies on."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark import SparkConf, SparkContext
from pyspark.sql import SparkSession

# Settings that change results or plan shape; anything already set by the cluster wins.
_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    # Bursts of one file are merged before the shuffle as well as after it.
    "spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true",
    # A malformed character in one file becomes a replacement character instead of failing the job.
    "spark.sql.legacy.codingErrorAction": "true",
    # Checkpoint files go with the frames that read them.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def build_session(app_name: str = "docstrata", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the library defaults for what neither the cluster nor `conf` has set."""
    running = SparkSession.getActiveSession()
    if running is None:
        # Starts the JVM with the caller's settings; then those of spark-submit can be read.
        SparkContext._ensure_initialized(conf=SparkConf(loadDefaults=False).setAll(list(conf.items())))
        given = SparkConf()
    else:
        given = running.sparkContext.getConf()
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    chosen = {k: v for k, v in _DEFAULTS.items() if not given.contains(k)} | conf
    return builder.config(map=chosen).getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach: the cluster's `spark.checkpoint.dir`.

    In local mode a temporary folder stands in where that setting is absent; executors on other machines would each
    write to a folder of their own there, so on a cluster its absence is an error.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get(
        "spark.checkpoint.dir"
    )
    if configured:
        return configured
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    fallback = getattr(shared_dir, "_fallback", None)
    if fallback is None:
        fallback = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        shared_dir._fallback = fallback
    return fallback


def fresh_dir(spark: SparkSession, label: str) -> str:
    """New, unused path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    """Makes `DataFrame.checkpoint` usable; a folder configured by the cluster is kept."""
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
