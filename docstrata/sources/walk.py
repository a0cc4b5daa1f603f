"""Listing file trees level by level in tasks, and reading the files a plan names.

The directories of a level are listed by tasks; what is excluded or lies in a bundle is cut before it is opened, and the
next level holds only the directories that are left. The driver sees counts, never paths. Files are opened by name, each
once, so that a job for a few changed files reads these only.

Paths and URIs are opened with Arrow's file systems (local ones, `s3://`, `hdfs://`, `gs://`, ...); Hadoop's `s3a://` is
the same store.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.accumulators import Accumulator
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import paths
from docstrata.session import fresh_dir
from docstrata.sources.listing import excluded, filter_supported, in_bundle

#: Bytes of file content that a task holds in one batch; a larger file is a batch of its own.
BATCH_BYTES = 32 << 20
#: Directories listed by one task of a level, so that a wide level is dealt to many.
TASK_DIRECTORIES = 64

_ENTRY = "path string, is_dir boolean, size_bytes long, mtime_ms long"
_FOUND = f"level int, {_ENTRY}, skipped string, error string"


@dataclass
class Walk:
    """`files(path, size_bytes, mtime_ms)`; `directories(path, level)`, those that were opened; `skipped(path, reason)`,
    directories cut as `excluded` or `bundle`; `failed(path, error)`, those that could not be listed."""

    files: DataFrame
    directories: DataFrame
    skipped: DataFrame
    failed: DataFrame


def _opened(path: str) -> tuple[pafs.FileSystem, str, str]:
    """(file system, path within it, what stands before such a path in a URI)."""
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path, ""
    uri = re.sub("^s3[an]://", "s3://", path)
    system, inner = pafs.FileSystem.from_uri(uri)
    if isinstance(system, pafs.LocalFileSystem):
        return system, inner, ""
    return system, inner, path[: len(path) - len(re.sub(r"^[a-z0-9]+://", "", uri))] if uri.startswith("s3:") else path[: path.index(inner)]


def below(directory: Column, exclude: Sequence[str]) -> Column:
    """Whether every path below a directory is excluded: a plain pattern stands in the directory's path, or a glob that
    ends in `**` matches any name in it."""
    hit = F.lit(False)
    for pattern in exclude:
        if "*" not in pattern and "?" not in pattern:
            hit = hit | F.concat(directory, F.lit("/")).contains(pattern)
        elif pattern.endswith("**"):
            hit = hit | F.concat(directory, F.lit("/\uffff")).rlike(paths.glob_to_regex(pattern))
    return hit


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The entries of directories (path); a directory that cannot be listed is one row with its error."""
    names = ["path", "is_dir", "size_bytes", "mtime_ms", "error"]
    kinds = [pa.string(), pa.bool_(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        for path in batch.column(0).to_pylist():
            try:
                system, inner, front = _opened(path)
                infos = system.get_file_info(pafs.FileSelector(inner))
            except OSError as failure:
                rows = [(path, True, None, None, str(failure)[:500])]
            else:
                rows = [
                    (front + i.path, i.type == pafs.FileType.Directory, i.size, None if i.mtime_ns is None else i.mtime_ns // 1_000_000, None)
                    for i in infos if i.type in (pafs.FileType.Directory, pafs.FileType.File)
                ]
            for at in range(0, len(rows), 10_000):
                columns = zip(*rows[at : at + 10_000], strict=True)
                yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def walk(spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), bundles: Sequence[str] = ()) -> Walk:
    """Lists everything below the roots. A directory whose own path is excluded is cut with all it holds. A root that does not exist is a `failed` row. Links to directories are not
    followed twice: a path that repeats within a level is opened once."""
    at = fresh_dir(spark, "walk")
    front = spark.createDataFrame([(r.rstrip("/") or "/",) for r in roots], "path string").distinct()
    level, n = 0, front.count()
    while n:
        tasks = max(1, -(-n // TASK_DIRECTORIES))
        listed = front.repartition(tasks, "path").mapInArrow(_list, f"{_ENTRY}, error string")
        cut = F.when(excluded(F.col("path"), exclude) | below(F.col("path"), exclude), "excluded").when(in_bundle(F.col("path"), bundles), "bundle")
        marked = listed.withColumn("skipped", F.when(F.col("is_dir") & F.col("error").isNull(), cut))
        marked.select(F.lit(level).alias("level"), "path", "is_dir", "size_bytes", "mtime_ms", "skipped", "error").write.parquet(f"{at}/level={level}-found")
        found = spark.read.schema(_FOUND).parquet(f"{at}/level={level}-found")
        front = found.where("is_dir and skipped is null and error is null").select("path").distinct()
        n, level = front.count(), level + 1
    every = spark.read.schema(_FOUND).parquet(*[f"{at}/level={k}-found" for k in range(level)]) if level else spark.createDataFrame([], _FOUND)
    dirs = every.where("is_dir")
    opened = spark.createDataFrame([(r.rstrip("/") or "/", 0) for r in roots], "path string, level int").distinct()
    opened = opened.union(dirs.where("skipped is null and error is null").select("path", F.col("level") + 1)).distinct()
    files = filter_supported(every.where("not is_dir").select("path", "size_bytes", "mtime_ms"), (), bundles, exclude).distinct()
    return Walk(
        files, opened, dirs.where("skipped is not null").select("path", F.col("skipped").alias("reason")),
        dirs.where("error is not null").select("path", "error"),
    )


def walk_corpus(
    spark: SparkSession, roots: Sequence[str], exclude: Sequence[str] = (), bundles: Sequence[str] = (), exts: Sequence[str] = ()
) -> DataFrame:
    """The files of supported extensions, as `listing.list_corpus` gives them, without opening what is cut."""
    return filter_supported(walk(spark, roots, exclude, bundles).files, exts)


def read_named(files: DataFrame, opened: Accumulator | None = None) -> DataFrame:
    """`files(path, ...)` with `content` and `read_error`: the bytes of each file, opened by the task that needs them. A
    file that is gone or cannot be read has no content and the reason. `opened` counts the files."""
    kind = T.StructType([*files.schema.fields, T.StructField("content", T.BinaryType()), T.StructField("read_error", T.StringType())])
    at = files.columns.index("path")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held, size, begin = [], 0, 0
            for k, path in enumerate(batch.column(at).to_pylist()):
                content, error = None, None
                try:
                    system, inner, _ = _opened(path)
                    with system.open_input_stream(inner) as stream:
                        content = stream.read()
                except OSError as failure:
                    error = str(failure)[:500]
                if opened is not None:
                    opened.add(1)
                held.append((content, error))
                size += len(content or b"")
                if size >= BATCH_BYTES or k == batch.num_rows - 1:
                    part = batch.slice(begin, k + 1 - begin)
                    columns = [pa.array([h[j] for h in held], t) for j, t in enumerate((pa.binary(), pa.string()))]
                    yield pa.RecordBatch.from_arrays([*part.columns, *columns], names=kind.names)
                    held, size, begin = [], 0, k + 1

    return files.mapInArrow(read, kind)
