"""Approximate and exact search over a two-level tree of cells.

A top centroid stands for some hundreds of leaf centroids, a leaf for the vectors nearest to it. A vector goes to its
nearest top and to the nearest leaf of that top, so that assigning it needs the tops and the leaves of one of them, never
all leaves. Every cell knows its radius, the distance of its farthest member: by the triangle inequality no member is
nearer to a query than the distance of the centroid less the radius. That makes exact searches that skip cells.

Distances between vectors and centroids are Euclidean; for the cosine metric the vectors have unit length there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.functions import vectors as vx
from docstrata.operators import search
from docstrata.operators.search import _matrix, _unit_rows
from docstrata.session import ensure_checkpoint_dir

#: Rows of a top cell that one task assigns to its leaves.
TASK_ROWS = 50_000
#: Training rows of each leaf; centroids only decide which vectors share a cell.
LEAF_SAMPLE = 64
#: Rows of a leaf that the default number of cells aims at.
LEAF_ROWS = 1_000
#: What rounding a distance to `search.SCORE_DIGITS` digits can hide.
SLACK = 1e-6

_TOPS = "top int, vector array<double>, radius double"
_LEAVES = "leaf long, top int, vector array<double>, radius double"


@dataclass
class CellTree:
    """`tops(top, vector, radius)`, `leaves(leaf, top, vector, radius)`, `cells`: the chunks with `top` and `leaf`, and
    `delta`: rows stored since, with their `batch`; a null vector takes the id away."""

    tops: DataFrame
    leaves: DataFrame
    cells: DataFrame
    metric: str
    delta: DataFrame | None = None

    def newest(self) -> DataFrame:
        """The last delta row of each id."""
        cols = [c for c in self.delta.columns if c != "batch"]
        return self.delta.groupBy("id").agg(F.max_by(F.struct(*cols), "batch").alias("r")).select("r.*")


def _points(vectors: np.ndarray, metric: str) -> np.ndarray:
    return _unit_rows(vectors) if metric == "cosine" else vectors


def _nearest(points: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of the nearest centroid of each point, of equally near ones the first; in blocks, so that memory
    does not grow with the number of centroids."""
    place, least = np.zeros(len(points), np.int64), np.full(len(points), np.inf)
    lengths = (points * points).sum(axis=1)
    step = max(1, min(len(centroids), int(search.MATRIX_ELEMENTS**0.5)))
    rows = max(1, search.MATRIX_ELEMENTS // step)
    for begin in range(0, len(points), rows):
        part = slice(begin, begin + rows)
        for first in range(0, len(centroids), step):
            c = centroids[first : first + step]
            d = (c * c).sum(axis=1) - 2.0 * (points[part] @ c.T)
            low = d.argmin(axis=1)
            d = d[np.arange(len(low)), low]
            nearer = d < least[part]
            place[part][nearer], least[part][nearer] = first + low[nearer], d[nearer]
    return place, np.sqrt(np.maximum(least + lengths, 0.0))


def _with_top(rows: DataFrame, tops: DataFrame, metric: str) -> DataFrame:
    """Adds `top` and `top_away`, the distance to its centroid."""
    size = tops.agg(F.sum(8 * F.size("vector"))).first()[0] or 0
    if size > search.BROADCAST_BYTES:
        raise ValueError(f"{size} bytes of top centroids; use fewer tops with more leaves each")
    held = tops.orderBy("top").select("top", "vector").toArrow()  # bounded by the check above
    shared = rows.sparkSession.sparkContext.broadcast((held.column("top").to_numpy(), _matrix(held.column("vector"))))
    at = rows.columns.index("vector")
    schema = T.StructType([*rows.schema.fields, T.StructField("top", T.IntegerType()), T.StructField("top_away", T.DoubleType())])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, centroids = shared.value
        for batch in batches:
            if batch.num_rows:
                place, away = _nearest(_points(_matrix(batch.column(at)), metric), centroids)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names[place], pa.int32()), pa.array(away)], names=schema.names)

    return rows.where("vector is not null").mapInArrow(choose, schema)


def _with_leaf(rows: DataFrame, leaves: DataFrame, metric: str) -> DataFrame:
    """Adds `leaf` and `away`. A top cell with many rows is dealt to several tasks, each with the leaves of that top."""
    parts = rows.groupBy("top").agg(F.ceil(F.count("*") / TASK_ROWS).cast("int").alias("parts"))
    columns = rows.columns
    dealt = rows.join(parts, "top").withColumn("part", F.pmod(F.xxhash64("id"), "parts").cast("int")).select(*columns, "part")
    met = leaves.select("top", "leaf", "vector").join(parts, "top").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    schema = T.StructType([*rows.schema.fields, T.StructField("leaf", T.LongType()), T.StructField("away", T.DoubleType())])

    def choose(own: pa.Table, cells: pa.Table) -> pa.Table:
        own = own.select(columns)
        cells = cells.sort_by("leaf")
        if not own.num_rows or not cells.num_rows:
            place, away = np.zeros(0, np.int64), np.zeros(0)
            own = own.slice(0, 0)
        else:
            place, away = _nearest(_points(_matrix(own.column("vector")), metric), _matrix(cells.column("vector")))
        return own.append_column("leaf", pa.array(cells.column("leaf").to_numpy()[place], pa.int64())).append_column("away", pa.array(away))

    return dealt.groupBy("top", "part").cogroup(met.groupBy("top", "part")).applyInArrow(choose, schema)


def assign_tree(chunks: DataFrame, tops: DataFrame, leaves: DataFrame, metric: str = "cosine", at: str | None = None) -> CellTree:
    """The tree of given centroids, `tops(top, vector)` and `leaves(leaf, top, vector)`, every top with one leaf at least.

    With a path, the tree is stored there and read back; without, its parts are computed whenever they are used.
    """
    placed = _with_leaf(_with_top(chunks, tops, metric), leaves, metric)
    if at:
        _write_cells(placed, f"{at}/cells")
        placed = chunks.sparkSession.read.parquet(f"{at}/cells")
    reach = placed.groupBy("top", "leaf").agg(F.max("away").alias("radius"), F.max("top_away").alias("top_radius"))
    leaves = leaves.select("leaf", "top", F.col("vector").cast("array<double>").alias("vector")).join(reach.select("leaf", "radius"), "leaf")
    tops = tops.select("top", F.col("vector").cast("array<double>").alias("vector")).join(
        reach.groupBy("top").agg(F.max("top_radius").alias("radius")), "top"
    )
    tree = CellTree(tops.select("top", "vector", "radius"), leaves.select("leaf", "top", "vector", "radius"),
                    placed.select(*chunks.columns, "top", "leaf"), metric)
    return _stored(tree, at) if at else tree


def build_tree(
    chunks: DataFrame,
    n_tops: int | None = None,
    branch: int | None = None,
    metric: str = "cosine",
    seed: int = 7,
    max_iter: int = 10,
    training: DataFrame | None = None,
    at: str | None = None,
) -> CellTree:
    """Trains the two levels and assigns every chunk.

    By default there are as many tops as leaves in a top, and about `LEAF_ROWS` rows a leaf. The tops are trained on all
    chunks, or the caller's `training` rows; the leaves of a top on at most `LEAF_SAMPLE` rows a leaf, those of the
    smallest hash.
    """
    if n_tops is None or branch is None:
        side = max(1, round((chunks.count() / LEAF_ROWS) ** 0.5))
        n_tops, branch = n_tops or side, branch or side
    training = (chunks if training is None else training).select("id", "vector").where("vector is not null")
    vector = vx.l2_normalize("vector") if metric == "cosine" else F.col("vector").cast("array<double>")
    features = training.select(array_to_vector(vector).alias("features"))
    model = KMeans(k=n_tops, seed=seed, maxIter=max_iter).fit(features)
    centres = [(k, [float(x) for x in c]) for k, c in enumerate(model.clusterCenters())]  # n_tops rows
    tops = chunks.sparkSession.createDataFrame(centres, "top int, vector array<double>")

    placed = _with_top(training, tops, metric)
    first = Window.partitionBy("top").orderBy(F.xxhash64("id"), "id")
    sample = placed.withColumn("k", F.row_number().over(first)).where(F.col("k") <= LEAF_SAMPLE * branch)

    def train(rows: pa.Table) -> pa.Table:
        top = rows.column("top")[0].as_py()
        leaves = _means(_points(_matrix(rows.sort_by("k").column("vector")), metric), branch, max_iter)
        return pa.table([pa.array([top * branch + k for k in range(len(leaves))], pa.int64()), pa.array([top] * len(leaves), pa.int32()),
                         pa.array(leaves.tolist(), pa.list_(pa.float64()))], names=["leaf", "top", "vector"])

    leaves = sample.groupBy("top").applyInArrow(train, "leaf long, top int, vector array<double>")
    if at:
        leaves.write.parquet(f"{at}/trained")
        leaves = chunks.sparkSession.read.parquet(f"{at}/trained")
    return assign_tree(chunks, tops, leaves, metric, at)


def _means(points: np.ndarray, k: int, rounds: int) -> np.ndarray:
    centroids = np.unique(points, axis=0)
    centroids = centroids[np.linspace(0, len(centroids) - 1, min(k, len(centroids))).astype(int)]
    for _ in range(rounds):
        place, _ = _nearest(points, centroids)
        n = np.bincount(place, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, place, points)
        moved = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], centroids)
        if np.array_equal(moved, centroids):
            break
        centroids = moved
    return centroids


def _write_cells(placed: DataFrame, path: str) -> None:
    """A folder a top, its rows by leaf, so that a scan skips other tops' files and other leaves' row groups. A top with
    many rows is written by several tasks."""
    salt = F.pmod(F.xxhash64("leaf", "id"), F.lit(8))
    spread = placed.repartition("top", salt).sortWithinPartitions("top", "leaf")
    spread.write.partitionBy("top").parquet(path)


def _stored(tree: CellTree, at: str) -> CellTree:
    tree.tops.withColumn("metric", F.lit(tree.metric)).write.parquet(f"{at}/tops")
    tree.leaves.write.parquet(f"{at}/leaves")
    delta = [c for c in tree.cells.columns if c not in ("top", "leaf")]
    tree.cells.select(*delta, F.lit(0).cast("long").alias("batch")).limit(0).write.parquet(f"{at}/delta")
    return open_tree(tree.cells.sparkSession, at)


def open_tree(spark: SparkSession, at: str) -> CellTree:
    """A stored tree with the rows stored since."""
    tops, delta = spark.read.parquet(f"{at}/tops"), spark.read.parquet(f"{at}/delta")
    metric = tops.select("metric").first()
    cells = spark.read.parquet(f"{at}/cells").drop("top_away", "away")
    leaves = spark.read.parquet(f"{at}/leaves")
    return CellTree(tops.drop("metric"), leaves, cells, metric[0] if metric else "cosine", delta if delta.limit(1).count() else None)


def store_rows(at: str, rows: DataFrame) -> None:
    """Adds rows to a stored tree, or replaces those of the same ids; a null vector takes an id away. They are searched
    exactly until the tree is built anew. One writer at a time."""
    delta = rows.sparkSession.read.parquet(f"{at}/delta")
    batch = (delta.agg(F.max("batch")).first()[0] or 0) + 1
    columns = [F.col(c) if c in rows.columns else F.lit(None).cast(dict(delta.dtypes)[c]).alias(c) for c in delta.columns if c != "batch"]
    rows.select(*columns, F.lit(batch).cast("long").alias("batch")).write.mode("append").parquet(f"{at}/delta")


def _lined_up(tree: CellTree, queries: DataFrame) -> DataFrame:
    """Queries as points of the tree's space."""
    vector = vx.l2_normalize("vector") if tree.metric == "cosine" else F.col("vector").cast("array<double>")
    return queries.where("vector is not null").select("query_id", vector.alias("vector"))


def nearest_leaves(tree: CellTree, queries: DataFrame, n_tops: int, n_leaves: int) -> DataFrame:
    """Adds `tops` and `cells`: a query's nearest tops, and of these its nearest leaves. The leaves are searched as the
    chunks are, by top cell, so that no task holds them all. Written, since a search reads its queries several times."""
    ensure_checkpoint_dir(queries.sparkSession)
    asked = _lined_up(tree, queries)
    tops = search.nearest_in_cells(tree.tops.select(F.col("top").alias("id"), "vector"), asked, n_tops, "l2")
    named = tops.groupBy("query_id").agg(F.collect_list("id").alias("cells"))
    met = asked.join(named, "query_id").checkpoint()
    leaves = tree.leaves.select(F.col("leaf").alias("id"), "vector", F.col("top").alias("cell"))
    found = search.nearest_in_cells(leaves, met, n_leaves, "l2").groupBy("query_id").agg(F.collect_list("id").alias("cells"))
    tops = met.select("query_id", F.col("cells").alias("tops"))
    return queries.join(tops, "query_id").join(found, "query_id").checkpoint()


def _within(tree: CellTree, asked: DataFrame, k: int, where: Column | str | None) -> DataFrame:
    """k nearest rows of the stored cells that each query names, replaced and removed ids left out."""
    # At most as many numbers as there are tops; other tops' folders are not read.
    wanted = [r[0] for r in asked.select(F.explode("tops")).distinct().collect()]
    rows = tree.cells.where(F.col("top").isin(wanted))
    rows = rows if where is None else rows.where(where)
    if tree.delta is not None:
        rows = rows.join(tree.delta.select("id").distinct(), "id", "left_anti")
    rows = rows.select("id", "vector", F.col("leaf").alias("cell"))
    return search.nearest_in_cells(rows, asked.select("query_id", "vector", "cells"), k, tree.metric)


def _with_delta(tree: CellTree, hits: DataFrame, queries: DataFrame, k: int, where: Column | str | None) -> DataFrame:
    if tree.delta is None:
        return hits
    fresh = search.batch_topk(tree.newest(), queries.select("query_id", "vector"), k, tree.metric, where)
    return search._rank(hits.drop("rank").unionByName(fresh.drop("rank")), k)


def probe_tree(
    tree: CellTree, queries: DataFrame, k: int = 10, n_tops: int = 2, n_leaves: int = 8, where: Column | str | None = None
) -> DataFrame:
    """Approximate k nearest chunks per query, among the rows that pass `where`: exact within the `n_leaves` nearest leaves
    of the `n_tops` nearest tops, and within the rows stored since. With as many as there are, the result is exact."""
    hits = _within(tree, nearest_leaves(tree, queries.select("query_id", "vector"), n_tops, n_leaves), k, where)
    return _with_delta(tree, hits, queries, k, where)


def open_leaves(tree: CellTree, queries: DataFrame) -> DataFrame:
    """`(query_id, leaf, top)`: the leaves that may hold a row within the distance `limit` of a query, by their radii; all,
    where limit is null. `queries(query_id, vector, limit)`."""
    asked = _lined_up(tree, queries).join(queries.select("query_id", "limit"), "query_id")
    query_type = search._arrow_type(queries.schema["query_id"].dataType)
    names = ["query_id", "leaf", "top"]
    # A distance of unit vectors is the root of twice the cosine distance.
    reach = F.col("limit") + SLACK
    asked = asked.withColumn("reach", F.sqrt(2 * reach) if tree.metric == "cosine" else reach)

    def judge(cells: pa.Table, met: pa.Table) -> pa.Table:
        q, c = _matrix(met.column("vector")), _matrix(cells.column("vector"))
        reach = met.column("reach").to_numpy(zero_copy_only=False).astype(np.float64)
        reach[np.isnan(reach)] = np.inf
        rows, columns = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        step = max(1, search.MATRIX_ELEMENTS // max(1, len(c)))
        for begin in range(0, len(q) if len(c) else 0, step):
            d = search._distances(q[begin : begin + step], c, "l2") - cells.column("radius").to_numpy()
            row, column = np.nonzero(d <= reach[begin : begin + step, None] + 1e-9)
            rows.append(row + begin), columns.append(column)
        row, column = pa.array(np.concatenate(rows)), pa.array(np.concatenate(columns))
        ids = search._combined(met.column("query_id")).take(row).cast(query_type)
        return pa.Table.from_arrays([ids, *(search._combined(cells.column(c)).take(column) for c in names[1:])], names=names)

    schema = T.StructType([queries.schema["query_id"], T.StructField("leaf", T.LongType()), T.StructField("top", T.IntegerType())])
    return search.over_grid(tree.leaves, "leaf", asked, "query_id", judge, schema)


def exact_topk(
    tree: CellTree, queries: DataFrame, k: int = 10, where: Column | str | None = None, n_tops: int = 2, n_leaves: int = 8
) -> DataFrame:
    """Exact k nearest chunks of every query among the rows that pass `where`, without reading cells that are too far.

    Probes widen until every query has k rows, or has seen all leaves; the k-th distance then limits which other leaves
    the query still has to see. The result is that of `search.batch_topk`.
    """
    queries = queries.select("query_id", "vector").where("vector is not null")
    n_tops_all, n_leaves_all = tree.tops.count(), tree.leaves.count()
    n_queries = queries.count()
    while True:
        asked = nearest_leaves(tree, queries, n_tops, n_leaves)
        hits = _with_delta(tree, _within(tree, asked, k, where), queries, k, where).checkpoint()
        full = n_tops >= n_tops_all and n_leaves >= n_leaves_all
        if full or hits.where(F.col("rank") == k).count() == n_queries:
            break
        n_tops, n_leaves = 2 * n_tops, 4 * n_leaves
    if full:
        return hits
    limits = hits.where(F.col("rank") == k).select("query_id", F.col("distance").alias("limit"))
    seen = asked.select("query_id", F.explode("cells").alias("leaf"))
    left = open_leaves(tree, queries.join(limits, "query_id", "left")).join(seen, ["query_id", "leaf"], "left_anti")
    cells = left.groupBy("query_id").agg(F.collect_list("leaf").alias("cells"), F.collect_set("top").alias("tops"))
    more = _within(tree, queries.join(cells, "query_id").checkpoint(), k, where)
    return search._rank(hits.drop("rank").unionByName(more.drop("rank")), k)


def probes_for(tree: CellTree, queries: DataFrame, k: int = 10, recall: float = 0.9, n_tops: int = 1, n_leaves: int = 1) -> tuple[int, int]:
    """(n_tops, n_leaves) that reach `recall` at k on the given queries, doubled from a small start."""
    ensure_checkpoint_dir(queries.sparkSession)
    exact = exact_topk(tree, queries, k).checkpoint()
    wanted = exact.count()
    n_tops_all, n_leaves_all = tree.tops.count(), tree.leaves.count()
    while n_tops < n_tops_all or n_leaves < n_leaves_all:
        found = probe_tree(tree, queries, k, n_tops, n_leaves)
        if exact.join(found, ["query_id", "id"], "left_semi").count() >= recall * wanted:
            break
        n_tops, n_leaves = min(2 * n_tops, n_tops_all), min(2 * n_leaves, n_leaves_all)
    return n_tops, n_leaves
