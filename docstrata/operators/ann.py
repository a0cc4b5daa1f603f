"""Approximate search: vectors grouped into cells around centroids; a query visits its nearest cells only."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.frames import salt
from docstrata.functions import vectors as vx
from docstrata.operators.search import _distances, _matrix, _unit_rows, nearest_in_cells


@dataclass
class IvfIndex:
    """`centroids` is one row per cell; `cells` is the chunk table plus its cell."""

    centroids: np.ndarray
    cells: DataFrame
    metric: str


def default_cells(rows: int) -> int:
    """As many cells as rows in a cell, at every size."""
    return max(1, int(rows**0.5))


def _features(chunks: DataFrame, metric: str) -> DataFrame:
    """On unit vectors the nearest centroid by Euclidean distance is the nearest by angle."""
    vector = vx.l2_normalize("vector") if metric == "cosine" else F.col("vector").cast("array<double>")
    return chunks.withColumn("__features", array_to_vector(vector))


def build_ivf(
    chunks: DataFrame,
    n_cells: int | None = None,
    metric: str = "cosine",
    seed: int = 7,
    max_iter: int = 10,
    training: DataFrame | None = None,
) -> IvfIndex:
    """Trains the centroids and assigns every chunk to its cell.

    All chunks take part in the training unless the caller names other `training` rows; centroids only decide
    which vectors share a cell.
    """
    if n_cells is None:
        n_cells = default_cells(chunks.count())
    featured = _features(chunks, metric)
    model = KMeans(
        k=n_cells,
        seed=seed,
        maxIter=max_iter,
        featuresCol="__features",
        predictionCol="cell",
    ).fit((featured if training is None else _features(training, metric)).select("__features"))
    return IvfIndex(np.array(model.clusterCenters()), model.transform(featured).drop("__features"), metric)


def assign_cells(chunks: DataFrame, centroids: np.ndarray, metric: str = "cosine") -> IvfIndex:
    """The index of given centroids: every chunk belongs to the nearest one, of equally near ones to the first."""
    cells = nearest_cells(chunks, centroids, 1, metric).withColumn("cell", F.get("cells", F.lit(0)).cast("int")).drop("cells")
    return IvfIndex(centroids, cells, metric)


def maybe_build_ivf(chunks: DataFrame, min_rows: int, **options) -> IvfIndex | None:
    """The index, or None while the table has at most `min_rows` rows; the limit is the caller's choice between exact
    and approximate search."""
    return build_ivf(chunks, **options) if chunks.count() > min_rows else None


def write_ivf(index: IvfIndex, path: str, salts: int = 8) -> None:
    """Stores the celled chunks partitioned by cell. A cell is written by several tasks, so that one holding
    a large share of the vectors becomes several files rather than one task's work."""
    spread = index.cells.withColumn("__salt", salt(["id"], salts))
    spread.repartition("cell", "__salt").drop("__salt").write.mode("overwrite").partitionBy("cell").parquet(path)


def nearest_cells(queries: DataFrame, centroids: np.ndarray, nprobe: int, metric: str = "cosine") -> DataFrame:
    """Adds `cells array<long>`: the `nprobe` nearest cells of each query."""
    schema = T.StructType([*queries.schema.fields, T.StructField("cells", T.ArrayType(T.LongType()))])
    at = queries.columns.index("vector")
    shared = queries.sparkSession.sparkContext.broadcast(centroids)

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            q, c = _matrix(batch.column(at)), shared.value
            if metric == "cosine":
                q = _unit_rows(q)
            d = _distances(q, c, "l2") if len(q) else np.empty((0, len(c)))
            picked = np.argsort(d, axis=1, kind="stable")[:, :nprobe]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(picked.tolist(), pa.list_(pa.int64()))], names=schema.names
            )

    return queries.where("vector is not null").mapInArrow(choose, schema)


def probe_ivf(index: IvfIndex, queries: DataFrame, k: int = 10, nprobe: int = 4) -> DataFrame:
    """Approximate k nearest chunks per query, exact within the probed cells; with as many probes as cells
    the result is the exact one."""
    asked = nearest_cells(queries.select("query_id", "vector"), index.centroids, nprobe, index.metric)
    # At most as many numbers as there are cells; over a table partitioned by cell the scan skips all others.
    wanted = sorted(r[0] for r in asked.select(F.explode("cells")).distinct().collect())
    rows = index.cells.select("id", "vector", "cell").where(F.col("cell").isin(wanted))
    return nearest_in_cells(rows, asked, k, index.metric)


def recall_at(approximate: DataFrame, exact: DataFrame) -> DataFrame:
    """Share of the exact hits that the approximate search returned, over all queries."""
    both = exact.select("query_id", "id").join(
        approximate.select("query_id", "id").withColumn("found", F.lit(1)), ["query_id", "id"], "left"
    )
    return both.agg(F.avg(F.coalesce("found", F.lit(0))).alias("recall"))
