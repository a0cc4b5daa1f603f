"""Look-ups between listing, status, registry, folders and relevance judgements, as joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.frames import salted_join
from docstrata.functions import paths


def with_status(listing: DataFrame, status: DataFrame, how: str = "left") -> DataFrame:
    """Listing rows with the columns of their status row; `has_status` tells absence from nulls.

    With `how="full"` status rows without a listed file are kept too, and `listed` tells them apart. Both sides
    hold a path once, so neither has a hot key.
    """
    known = status.withColumn("has_status", F.lit(True))
    joined = listing.withColumn("listed", F.lit(True)).join(known, "path", how)
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("has_status", "listed")}
    return joined.withColumns(flags) if how == "full" else joined.withColumns(flags).drop("listed")


def unstatused_paths(chunks: DataFrame, status: DataFrame) -> DataFrame:
    """Paths of chunks without a status row, each once."""
    return chunks.select("path").distinct().join(status.select("path"), "path", "left_anti")


def with_parser(df: DataFrame, registry: DataFrame) -> DataFrame:
    """Adds the registry columns of each row's file type; nulls when no parser handles it.

    The registry is a literal relation of a dozen rows, so the join is planned as a broadcast.
    """
    typed = df if "ext" in df.columns else df.withColumn("ext", paths.file_type("path"))
    return typed.join(registry, "ext", "left")


def supported_extensions(registry: DataFrame, enabled_only: bool = False) -> DataFrame:
    rows = registry.where("enabled") if enabled_only else registry
    return rows.select("ext").distinct()


def folder_of_dirs(df: DataFrame, folders: DataFrame) -> DataFrame:
    """`(__dir, folder)` of the directories of `df` that lie in a folder, the first listed folder winning.

    Directories are made distinct first; each meets the folder list by equality on its ancestors.
    """
    listed = folders if "position" in folders.columns else folders.withColumn("position", F.lit(0))
    keyed = listed.select(F.rtrim("folder", F.lit("/")).alias("__key"), "folder", "position")
    dirs = df.select(paths.parent_dir("path").alias("__dir")).distinct()
    climbed = dirs.select("__dir", F.explode(paths.ancestors("__dir")).alias("__key"))
    return (
        climbed.join(keyed, "__key")
        .groupBy("__dir")
        .agg(F.min_by("folder", F.struct("position", "folder")).alias("folder"))
    )


def assign_folder(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Adds `folder`: the first folder of `folders(folder, position)` containing the path, else null.

    Directories, not files, meet the folder list; a directory with most of the files is salted.
    """
    keyed = df.withColumn("__dir", paths.parent_dir("path"))
    return salted_join(keyed, folder_of_dirs(df, folders), "__dir", "left", ["path"]).drop("__dir")


def _by_folders(df: DataFrame, folders: DataFrame, inside: bool) -> DataFrame:
    keyed = df.withColumn("__dir", paths.parent_dir("path"))
    dirs = folder_of_dirs(df, folders).select("__dir")
    how = "left_semi" if inside else "left_anti"
    return salted_join(keyed, dirs, "__dir", how, ["path"]).select(*df.columns)


def in_folders(df: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows whose path lies below one of the folders; `/docs` does not contain `/docs-old/a`."""
    return _by_folders(df, folders, True)


def outside_folders(df: DataFrame, folders: DataFrame) -> DataFrame:
    return _by_folders(df, folders, False)


def missing_files(status: DataFrame, listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Status rows in a watched folder whose file is no longer listed."""
    gone = status.join(listing.select("path"), "path", "left_anti")
    return in_folders(gone, folders)


def valid_paths(listing: DataFrame, folders: DataFrame) -> DataFrame:
    """Rows with an absolute, plain path inside a watched folder."""
    return in_folders(listing.where(paths.safe_path("path")), folders)


def with_relevance(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """Adds `relevant` to `runs(query_id, doc_id, ...)` from the judged pairs `qrels(query_id, doc_id)`."""
    judged = qrels.select("query_id", "doc_id").distinct().withColumn("relevant", F.lit(True))
    return runs.join(judged, ["query_id", "doc_id"], "left").withColumn(
        "relevant", F.coalesce("relevant", F.lit(False))
    )


def relevant_counts(queries: DataFrame, qrels: DataFrame) -> DataFrame:
    """`(query_id, n_relevant)` for every query."""
    counts = qrels.groupBy("query_id").agg(F.countDistinct("doc_id").alias("n_relevant"))
    return (
        queries.select("query_id")
        .join(counts, "query_id", "left")
        .select("query_id", F.coalesce("n_relevant", F.lit(0)).alias("n_relevant"))
    )


def with_class_relevance(runs: DataFrame, classes: DataFrame) -> DataFrame:
    """`relevant` where query and document share their class in `classes(doc_id, label)`.

    Judging the hits by their two labels avoids spelling out every pair of a class.
    """
    of_query = classes.select(F.col("doc_id").alias("query_id"), F.col("label").alias("__query_label"))
    of_doc = classes.select("doc_id", F.col("label").alias("__doc_label"))
    return (
        runs.join(of_query, "query_id", "left")
        .transform(lambda df: salted_join(df, of_doc, "doc_id", "left", ["query_id"]))
        .withColumn("relevant", F.coalesce(F.col("__query_label") == F.col("__doc_label"), F.lit(False)))
        .drop("__query_label", "__doc_label")
    )


def class_relevant_counts(classes: DataFrame) -> DataFrame:
    """`(query_id, n_relevant)`: the other members of each document's class, counted once per class."""
    sizes = classes.groupBy("label").agg((F.count("*") - 1).alias("n_relevant"))
    keyed = salted_join(classes, sizes, "label", "inner", ["doc_id"])
    return keyed.select(F.col("doc_id").alias("query_id"), "n_relevant")
