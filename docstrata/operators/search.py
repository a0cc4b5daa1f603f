"""Vector search: exact top-k for one or many queries, hit projection and grouping, file-name search."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.frames import salted_join
from docstrata.functions import vectors as vx

# Scores are rounded before ranking, so that ties are ties in every engine; ids break them.
SCORE_DIGITS = 6

# Queries are sent to the executors whole only up to this size; beyond it both sides are shuffled in cells.
BROADCAST_BYTES = 64 * 1024 * 1024
# Bytes of either side's vectors in one task of the grid, and the least rows of a side worth a task.
GRID_BYTES = 32 * 1024 * 1024
LEAST_SIDE = 2_000
# Queries ranked at a time within a task.
QUERY_BLOCK = 4_096

# Candidates per wanted row beyond which ties are cut by id before they are collected.
TIES = 8

# Elements of one score matrix held in memory.
MATRIX_ELEMENTS = 4_000_000
# Rows that set the first limits, and pairs computed exactly at a time.
FIRST_ROWS = 256
EXACT_PAIRS = 20_000


def _matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    lengths = np.diff(column.offsets.to_numpy()) if rows else np.zeros(0)
    if rows and (lengths != lengths[0]).any():
        raise ValueError(f"vectors of different lengths: {int(lengths.min())} and {int(lengths.max())}")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else flat.reshape(0, 0)


def _unit_rows(m: np.ndarray) -> np.ndarray:
    length = np.sqrt((m * m).sum(axis=1, keepdims=True))
    return np.divide(m, length, out=np.zeros_like(m), where=length > 0)


def _distances(q: np.ndarray, v: np.ndarray, metric: str) -> np.ndarray:
    if metric == "cosine":
        return 1.0 - q @ v.T
    squares = (q * q).sum(axis=1)[:, None] + (v * v).sum(axis=1)[None, :] - 2.0 * (q @ v.T)
    return np.sqrt(np.maximum(squares, 0.0))


class _Rows:
    """Vectors as the metric compares them, and the same in single precision for a first look."""

    def __init__(self, vectors: np.ndarray, metric: str):
        self.exact = _unit_rows(vectors) if metric == "cosine" else vectors
        self.quick = self.exact.astype(np.float32)
        self.length = np.sqrt(np.einsum("ij,ij->i", self.exact, self.exact))
        if metric != "cosine":
            self.quick = np.column_stack([self.quick, (-0.5 * self.length**2).astype(np.float32)])
        # Squares of longer vectors leave single precision.
        self.plain = bool((self.length < 1e15).all())

    def part(self, at: int, n: int) -> _Rows:
        out = object.__new__(_Rows)
        out.exact, out.quick, out.length, out.plain = self.exact[at : at + n], self.quick[at : at + n], self.length[at : at + n], self.plain
        return out


class _TopK:
    """Running k nearest rows per query, ordered by (distance, id)."""

    def __init__(self, queries: np.ndarray, k: int, metric: str):
        self.metric, self.k = metric, k
        self.queries = _unit_rows(queries) if metric == "cosine" else queries
        self.length = np.sqrt(np.einsum("ij,ij->i", self.queries, self.queries))
        self.limit = np.full(len(queries), np.inf)
        self.found = np.zeros(len(queries), dtype=np.int64)
        self.d = np.full((len(queries), k), np.inf)
        self.ids: np.ndarray | None = None

    def add(self, ids: pa.Array, vectors: np.ndarray | _Rows, members: np.ndarray | None = None) -> None:
        """Offers rows to all queries, or to those at the positions `members`."""
        if not len(ids):
            return
        members = np.arange(len(self.queries)) if members is None else members
        rows = vectors if isinstance(vectors, _Rows) else _Rows(vectors, self.metric)
        for begin in range(0, len(members), QUERY_BLOCK):
            part = members[begin : begin + QUERY_BLOCK]
            most = max(1, MATRIX_ELEMENTS // len(part))
            # The first rows set the limits; later blocks grow with what was seen, so that few rows of each pass.
            at, step = 0, most if np.isfinite(self.limit[part]).all() else max(FIRST_ROWS, 2 * self.k)
            while at < len(ids):
                n = min(step, most)
                self._block(ids.slice(at, n), rows.part(at, n), part)
                at, step = at + n, 2 * step

    def _block(self, ids: pa.Array, rows: _Rows, members: np.ndarray) -> None:
        limit = self.limit[members]
        ready = np.isfinite(limit) & (self.length[members] < 1e15) if rows.plain else np.zeros(len(members), dtype=bool)
        if ready.any():
            near = self._near(rows, members[ready], limit[ready])
            if near is not None:
                row, col, d = near
                self._merge(members[ready][row], d, ids, col)
                members, limit = members[~ready], limit[~ready]
        if not len(members):
            return
        d = np.round(_distances(self.queries[members], rows.exact, self.metric), SCORE_DIGITS) + 0.0
        if d.shape[1] > self.k:
            limit = np.minimum(limit, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        keep = d <= limit[:, None]
        if np.count_nonzero(keep) > TIES * self.k * len(members):
            # Many equal distances, as between copies: of these only the smallest ids can matter.
            order = pc.sort_indices(ids)
            ids, d = ids.take(order), d[:, order.to_numpy()]
            below, equal = d < limit[:, None], d == limit[:, None]
            room = self.k - below.sum(axis=1)
            keep = below | (equal & (np.cumsum(equal, axis=1) <= room[:, None]))
        row, col = np.nonzero(keep)
        self._merge(members[row], d[row, col], ids, col)

    def _near(self, rows: _Rows, members: np.ndarray, limit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(place in members, row, distance) of the rows within the limits; None where too many are close to them.

        Products in single precision leave out what is too far by more than their error; the rest is computed exactly."""
        q, far = self.queries[members], limit + 10.0**-SCORE_DIGITS
        quick, length = q.astype(np.float32), self.length[members]
        error = (q.shape[1] + 16) * 2.0**-23
        if self.metric == "cosine":
            least = 1.0 - far - error
        else:
            quick = np.column_stack([quick, np.ones(len(quick), dtype=np.float32)])
            longest = rows.length.max()
            least = 0.5 * (length**2 - far**2) - error * (length**2 + far**2 + length * longest + longest**2)
        close = quick @ rows.quick.T >= least.astype(np.float32)[:, None]
        if np.count_nonzero(close) > TIES * self.k * len(members):
            return None
        row, col = np.divmod(np.flatnonzero(close), close.shape[1])
        d = np.empty(len(row))
        for begin in range(0, len(row), EXACT_PAIRS):
            i, j = row[begin : begin + EXACT_PAIRS], col[begin : begin + EXACT_PAIRS]
            product = np.einsum("ij,ij->i", q[i], rows.exact[j])
            if self.metric != "cosine":
                product = np.sqrt(np.maximum(length[i] ** 2 + rows.length[j] ** 2 - 2.0 * product, 0.0))
            d[begin : begin + EXACT_PAIRS] = 1.0 - product if self.metric == "cosine" else product
        d = np.round(d, SCORE_DIGITS) + 0.0
        keep = d <= limit[row]
        return row[keep], col[keep], d[keep]

    def _merge(self, q: np.ndarray, dist: np.ndarray, ids: pa.Array, col: np.ndarray) -> None:
        """Adds candidates, rows `col` of `ids`, to the queries `q`."""
        if not len(q):
            return
        # Only the candidates' ids leave Arrow: few, once the first rows have set the limits.
        names = np.array(ids.take(pa.array(col)).to_pylist())
        changed = np.unique(q)
        if self.ids is None:
            self.ids = np.zeros((len(self.queries), self.k), dtype=names.dtype)
        else:
            self.ids = self.ids.astype(np.result_type(self.ids, names), copy=False)
            held, place = np.nonzero(np.arange(self.k) < self.found[changed][:, None])
            held = changed[held]
            q, dist = np.concatenate([q, held]), np.concatenate([dist, self.d[held, place]])
            names = np.concatenate([names, self.ids[held, place]])
        order = np.lexsort((names, dist, q))
        q, dist, names = q[order], dist[order], names[order]
        place = np.arange(len(q)) - np.searchsorted(q, q, side="left")
        keep = place < self.k
        self.d[q[keep], place[keep]], self.ids[q[keep], place[keep]] = dist[keep], names[keep]
        self.found[changed] = np.minimum(np.searchsorted(q, changed, side="right") - np.searchsorted(q, changed), self.k)
        self.limit[changed] = self.d[changed, self.k - 1]

    def batch(self, query_ids: pa.Array, schema: pa.Schema) -> pa.RecordBatch | None:
        if self.ids is None:
            return None
        q, place = np.nonzero(np.arange(self.k) < self.found[:, None])
        return pa.RecordBatch.from_arrays(
            [
                query_ids.take(pa.array(q)).cast(schema.field(0).type),
                pa.array(self.ids[q, place].tolist(), schema.field(1).type),
                pa.array(self.d[q, place], pa.float64()),
            ],
            schema=schema,
        )


def _combined(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    if isinstance(column, pa.ChunkedArray):
        return column.combine_chunks() if column.num_chunks != 1 else column.chunk(0)
    return column


def _hit_schema(chunks: DataFrame, queries: DataFrame) -> T.StructType:
    return T.StructType(
        [
            T.StructField("query_id", queries.schema["query_id"].dataType),
            T.StructField("id", chunks.schema["id"].dataType),
            T.StructField("distance", T.DoubleType()),
        ]
    )


def _rank(local: DataFrame, k: int) -> DataFrame:
    """Final ranking of the partial results; Spark drops rows past `k` before the shuffle as well."""
    nearest = Window.partitionBy("query_id").orderBy("distance", "id")
    return local.withColumn("rank", F.row_number().over(nearest)).where(F.col("rank") <= k)


def _queries_size(queries: DataFrame) -> tuple[int, int]:
    """Number of queries and bytes of all that would be sent: ids, vectors (as doubles) and cells."""
    ids = F.octet_length(F.col("query_id").cast("string")) + 50
    row = queries.select(F.count("*"), F.sum(8 * (F.size("vector") + F.size("cells")) + ids)).first()
    return int(row[0]), int(row[1] or 0)


def nearest_in_cells(
    chunks: DataFrame,
    queries: DataFrame,
    k: int,
    metric: str,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """k nearest `chunks(id, vector[, cell])` per `queries(query_id, vector[, cells])`, ranked."""
    return _rank(_candidates(chunks, queries, k, metric, broadcast_bytes), k)


def _candidates(
    chunks: DataFrame, queries: DataFrame, k: int, metric: str, broadcast_bytes: int = BROADCAST_BYTES
) -> DataFrame:
    """`(query_id, id, distance)`: at most k rows per query and task, among them the k nearest.

    With cells, a query meets the rows of the cells it names only. Small query sets travel to the data: each
    task scores its Arrow batches as one matrix product and keeps k rows per query, so neither the chunk table
    nor the pairs are shuffled. Larger ones meet the data in bounded (cell, row group, query group) cells.
    """
    celled = "cell" in chunks.columns
    cell = F.col("cell").cast("long") if celled else F.lit(0).cast("long")
    chunks = chunks.select("id", "vector", cell.alias("cell")).where("vector is not null")
    cells = F.col("cells").cast("array<long>") if celled else F.array(F.lit(0).cast("long"))
    queries = queries.select("query_id", "vector", cells.alias("cells")).where("vector is not null")
    schema = _hit_schema(chunks, queries)

    count, size = _queries_size(queries)
    if count == 0:
        return chunks.sparkSession.createDataFrame([], schema)
    if size <= broadcast_bytes:
        table = queries.toArrow()  # bounded by the size check
        asked = (table.column("query_id").to_pylist(), _matrix(table.column("vector")), _combined(table.column("cells")))
        return _broadcast_nearest(chunks, asked, k, metric, schema, celled)
    return _celled_nearest(chunks, queries, k, metric, schema, count, celled)


def _broadcast_nearest(chunks, asked, k, metric, schema, celled) -> DataFrame:
    """`asked`: query ids, their matrix, and their cells as an Arrow list array."""
    payload = chunks.sparkSession.sparkContext.broadcast(asked)
    query_type = _arrow_type(schema["query_id"].dataType)
    id_type = _arrow_type(schema["id"].dataType)
    out = pa.schema([("query_id", query_type), ("id", id_type), ("distance", pa.float64())])

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, matrix, cells = payload.value
        members: dict[int, np.ndarray] = {}
        if celled:
            named, position = cells.flatten().to_numpy(), cells.value_parent_indices().to_numpy()
            order = np.argsort(named, kind="stable")
            starts = np.flatnonzero(np.diff(named[order], prepend=-1))
            members = dict(zip(named[order][starts].tolist(), np.split(position[order], starts[1:]), strict=True))
        top = _TopK(matrix, k, metric)
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, vectors = batch.column(0), _matrix(batch.column(1))
            if not celled:
                top.add(ids, vectors)
                continue
            batch_cells = batch.column(2).to_numpy(zero_copy_only=False)
            for c in np.unique(batch_cells):
                if c in members:
                    here = np.flatnonzero(batch_cells == c)
                    top.add(ids.take(pa.array(here)), vectors[here], members[c])
        found = top.batch(pa.array(query_ids, query_type), out)
        if found is not None:
            yield found

    return chunks.mapInArrow(score, schema)


def _side(rows: int, queries: int, dims: int, tasks: int) -> int:
    """Rows, and queries, of one cell of the grid. Over a fixed number of tasks both sides are repeated least, namely with
    the root of their product, where cells are square; memory sets the upper limit."""
    square = int((rows * queries / max(1, tasks)) ** 0.5)
    return max(1, min(max(square, LEAST_SIDE), GRID_BYTES // (8 * max(1, dims))))


def _sizes(rows: DataFrame, queries: DataFrame) -> tuple[int, int, int]:
    n, dims = rows.agg(F.count("*"), F.max(F.size("vector"))).first()
    return n, queries.count(), dims or 1


def over_grid(rows: DataFrame, row_id: str, queries: DataFrame, query_id: str, go, schema) -> DataFrame:
    """`go(rows, queries)` over every pair of groups of both sides, hashed by their ids into a grid."""
    n, m, dims = _sizes(rows, queries)
    side = _side(n, m, dims, 2 * rows.sparkSession.sparkContext.defaultParallelism)
    down, across = max(1, -(-n // side)), max(1, -(-m // side))
    left = rows.withColumn("__i", F.pmod(F.xxhash64(row_id), F.lit(down))).withColumn("__j", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    right = queries.withColumn("__j", F.pmod(F.xxhash64(query_id), F.lit(across))).withColumn("__i", F.explode(F.sequence(F.lit(0), F.lit(down - 1))))
    cell = [F.col("__i").cast("int").alias("i"), F.col("__j").cast("int").alias("j")]
    left, right = left.select("*", *cell).drop("__i", "__j"), right.select("*", *cell).drop("__i", "__j")
    return left.groupBy("i", "j").cogroup(right.groupBy("i", "j")).applyInArrow(go, schema)


def _celled_nearest(chunks, queries, k, metric, schema, query_count, celled) -> DataFrame:
    """Both sides hashed into groups of bounded size within each cell; every group pair is one task's work.

    The numbers of groups of a cell follow from its rows and its queries, so a cell holding most of either is split into
    as many groups as its size asks for.
    """
    asked = queries.withColumn("cell", F.explode("cells"))
    n, m, dims = _sizes(chunks, asked)
    side = F.lit(_side(n, m, dims, 2 * chunks.sparkSession.sparkContext.defaultParallelism))
    if celled:
        row_groups = chunks.groupBy("cell").agg(F.ceil(F.count("*") / side).cast("int").alias("row_groups"))
        query_groups = asked.groupBy("cell").agg(F.ceil(F.count("*") / side).cast("int").alias("query_groups"))
        groups = row_groups.join(query_groups, "cell")
        rows, asked = chunks.join(groups, "cell"), asked.join(groups, "cell")
    else:
        groups = [F.ceil(F.lit(x) / side).cast("int").alias(c) for x, c in ((max(n, 1), "row_groups"), (m, "query_groups"))]
        rows, asked = chunks.select("*", *groups), asked.select("*", *groups)
    left = (
        rows.withColumn("row_group", F.pmod(F.xxhash64("id"), F.col("row_groups")).cast("int"))
        .withColumn("query_group", F.explode(F.sequence(F.lit(0), F.col("query_groups") - 1)))
        .select("cell", "row_group", "query_group", "id", "vector")
    )
    right = (
        asked.withColumn("row_group", F.explode(F.sequence(F.lit(0), F.col("row_groups") - 1)))
        .withColumn("query_group", F.pmod(F.xxhash64("query_id"), F.col("query_groups")).cast("int"))
        .select("cell", "row_group", "query_group", "query_id", "vector")
    )
    query_type = _arrow_type(schema["query_id"].dataType)
    out = pa.schema(
        [("query_id", query_type), ("id", _arrow_type(schema["id"].dataType)), ("distance", pa.float64())]
    )

    def score(rows: pa.Table, asked: pa.Table) -> pa.Table:
        if rows.num_rows == 0 or asked.num_rows == 0:
            return out.empty_table()
        ids, vectors, found = _combined(rows.column("id")), _Rows(_matrix(rows.column("vector")), metric), []
        for begin in range(0, asked.num_rows, QUERY_BLOCK):
            part = asked.slice(begin, QUERY_BLOCK)
            top = _TopK(_matrix(part.column("vector")), k, metric)
            top.add(ids, vectors)
            found.append(top.batch(_combined(part.column("query_id")), out))
        return pa.Table.from_batches([b for b in found if b is not None], out)

    keys = ["cell", "row_group", "query_group"]
    return left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(score, schema)


def _arrow_type(data_type: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(data_type)


def batch_topk(
    chunks: DataFrame,
    queries: DataFrame,
    k: int = 10,
    metric: str = "cosine",
    where: Column | str | None = None,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Exact k nearest chunks of every query: `(query_id, id, distance, rank)`.

    `chunks(id, vector, ...)`, `queries(query_id, vector)`; `where` filters the chunks before ranking.
    """
    pool = chunks if where is None else chunks.where(where)
    return nearest_in_cells(pool.select("id", "vector"), queries, k, metric, broadcast_bytes)


def topk(
    chunks: DataFrame,
    query_vec: Sequence[float],
    k: int = 10,
    metric: str = "cosine",
    where: Column | str | None = None,
) -> DataFrame:
    """Exact k nearest chunks of one query vector: `(id, distance)` in order."""
    pool = (chunks if where is None else chunks.where(where)).select("id", "vector").where("vector is not null")
    schema = T.StructType(
        [T.StructField("query_id", T.LongType()), pool.schema["id"], T.StructField("distance", T.DoubleType())]
    )
    asked = ([0], np.array([list(query_vec)], dtype=np.float64), pa.array([[0]], pa.list_(pa.int64())))
    found = _broadcast_nearest(pool, asked, k, metric, schema, False)
    return found.select("id", "distance").orderBy("distance", "id").limit(k)


def project_hits(ranked: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits with their chunk's columns: `(query_id, id, path, page, offset, text, score, title, rank)`.

    The chunk table is first cut down to the chunks that were hit, each once; these few rows then meet the
    hits, of which a popular chunk may have very many.
    """
    columns = ["id", "path", "page", "offset", "text", "title"]
    hit = chunks.select(*columns).join(ranked.select("id").distinct(), "id", "left_semi")
    spread = [c for c in ("query_id",) if c in ranked.columns] or ["distance"]
    joined = salted_join(ranked, hit, "id", "inner", spread)
    return joined.select(
        *[c for c in ("query_id",) if c in ranked.columns],
        "id",
        "path",
        F.coalesce("page", F.lit(0)).alias("page"),
        F.coalesce("offset", F.lit(0)).cast("long").alias("offset"),
        F.coalesce("text", F.lit("")).alias("text"),
        vx.score("distance").alias("score"),
        F.coalesce("title", F.lit("")).alias("title"),
        *[c for c in ("rank",) if c in ranked.columns],
    )


def group_hits(hits: DataFrame) -> DataFrame:
    """Hits per query and file with best score, hit count and the place of the file in the result list."""
    files = hits.groupBy("query_id", "path").agg(
        F.max("score").alias("best_score"),
        F.count("*").alias("hits"),
        F.min("rank").alias("first_rank"),
    )
    by_rank = Window.partitionBy("query_id").orderBy("first_rank", "path")
    return files.withColumn("position", F.row_number().over(by_rank))


def file_hits(hits: DataFrame, path: Column | str) -> DataFrame:
    """All hits of one file in rank order; `path` is a path or a column naming it per row."""
    wanted = F.lit(path) if isinstance(path, str) else path
    return hits.where(F.col("path") == wanted).orderBy("query_id", "rank")


def search_files(
    status: DataFrame, text: str, in_flight: DataFrame | None = None, limit: int = 30
) -> DataFrame:
    """File-name search: the first `limit` status rows whose path contains `text`, whatever the case.

    The substring filter and the top-`limit` cut run before the look-up of files in flight.
    """
    found = (
        status.where(F.lower("path").contains(text.lower()))
        .select("path", "status", "chunk_count", "error_message", "last_modified")
        .orderBy("path")
        .limit(limit)
    )
    shown = F.col("status")
    if in_flight is not None:
        marked = in_flight.select("path").distinct().withColumn("__busy", F.lit(True))
        found = found.join(marked, "path", "left")
        shown = F.when(F.col("__busy"), F.lit("queued")).otherwise(shown)
    return found.select(
        "path",
        shown.alias("status"),
        F.coalesce("chunk_count", F.lit(0)).alias("chunks"),
        F.col("error_message").alias("error"),
        F.col("last_modified").alias("modified"),
    ).orderBy("path")
