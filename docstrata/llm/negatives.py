"""Hard negatives of anchor vectors, by inner product with segment summaries.

Every vector is cut into segments; a segment's mean and deviation (the length of what is left without the mean) are
stored with it. Over a segment of n components, the inner product of two vectors is n times the product of the means,
give or take at most the product of the deviations. Summed over one, four and all segments these give ever closer bounds
of a score; coarse summaries follow from fine ones. What the bounds of one level cannot exclude goes to the next, and
what none excludes is scored exactly, in integers.

Anchors and vectors are dealt into blocks by hash, and every block of anchors meets every block of vectors in one task: a
grid whose sides follow from both sizes, so that a task's memory does not depend on them. A first pass finds each anchor's
positives, a second the negatives in the window of scores that each positive sets; a task returns a few rows an anchor.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import settle

POSITIVES = 5
NEGATIVES = 10
LOWEST, HIGHEST = 30, 90  # percent of the positive's score
SEGMENTS = 16
LEVELS = (1, 4, 16)
BLOCK_BYTES = 32 << 20
LEAST_BLOCK = 4096  # vectors; smaller blocks would cost more than they spread
_STRIP = 64  # anchors whose bounds a task holds at a time
_PROBE = 256  # scores that set a first floor
_DENSE = 0.2  # share of pairs above which a product of matrices is cheaper than one by one


def summaries(v: np.ndarray, segments: int = SEGMENTS) -> tuple[np.ndarray, np.ndarray]:
    """(means, deviations) of the segments of each row; the last segment is filled up with zeros."""
    width = max(1, -(-v.shape[1] // segments))
    parts = np.zeros((len(v), segments * width))
    parts[:, : v.shape[1]] = v
    parts = parts.reshape(len(v), segments, width)
    means = parts.mean(axis=2)
    return means, np.sqrt(((parts - means[:, :, None]) ** 2).sum(axis=2))


def coarser(means: np.ndarray, deviations: np.ndarray, width: int, segments: int) -> tuple[np.ndarray, np.ndarray]:
    """Summaries of fewer segments from finer ones of `width` components each."""
    fine = means.reshape(len(means), segments, means.shape[1] // segments)
    whole = fine.mean(axis=2)
    spread = width * ((fine - whole[:, :, None]) ** 2).sum(axis=2)
    return whole, np.sqrt(spread + (deviations.reshape(fine.shape) ** 2).sum(axis=2))


class Block:
    """Vectors of a task, by ascending id, with their summaries at all levels."""

    def __init__(self, table: pa.Table, dims: int, peak: float):
        ids = table.column("vec_id").to_numpy()
        order = np.argsort(ids, kind="stable")
        self.ids, self.labels = ids[order], table.column("label").to_numpy()[order]
        self.exact = _kind(dims, peak)
        self.v = _padded(table.column("v"), dims)[order].astype(self.exact)
        means, deviations = (_padded(table.column(c), SEGMENTS, np.float64)[order] for c in ("means", "deviations"))
        width = max(1, -(-dims // SEGMENTS))
        self.levels = []
        for n in LEVELS:
            m, d = coarser(means, deviations, width, n) if n < SEGMENTS else (means, deviations)
            self.levels.append((m * np.sqrt(width * SEGMENTS // n), d))

    def scores(self, row: int, other: Block, at: np.ndarray) -> np.ndarray:
        return other.v[at] @ self.v[row]


def _kind(dims: int, peak: float):
    """The cheapest type in which sums of `dims` products of numbers up to `peak` are exact."""
    most = dims * peak * peak
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else object


def _padded(column: pa.ChunkedArray, width: int, kind=np.int64) -> np.ndarray:
    lists = column.combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    out = np.zeros((len(lists), width), kind)
    sizes = lists.value_lengths().fill_null(0).to_numpy()
    out[np.arange(width) < sizes[:, None]] = lists.flatten().to_numpy(zero_copy_only=False)
    return out


def _bounds(anchors: Block, rows: slice, vectors: Block, level: int, at=slice(None)) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of all scores, widened by what rounding may take."""
    (ma, da), (mv, dv) = anchors.levels[level], vectors.levels[level]
    mid, give = ma[rows] @ mv[at].T, da[rows] @ dv[at].T
    give += 1e-9 * (np.abs(mid) + give) + 1e-6
    return mid - give, mid + give


def best(scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the `k` highest scores, highest first, ties by place."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        more = np.flatnonzero(scores > edge)
        held = np.sort(np.concatenate([more, np.flatnonzero(scores == edge)[: k - len(more)]]))
    else:
        held = np.arange(len(scores))
    return held[np.argsort(-scores[held], kind="stable")]


def refined(anchors: Block, vectors: Block, able, windows_of, narrowed):
    """For each anchor: (row, places, scores) of the vectors whose score the bounds leave open, exactly scored.

    `able(rows)` says which pairs take part, `windows_of(row)` gives the windows (lowest, highest) of scores that count,
    as arrays; `narrowed(row, windows, scores)` raises their lower ends by scores that are known already.
    """
    for begin in range(0, len(anchors.ids), _STRIP):
        rows = slice(begin, min(begin + _STRIP, len(anchors.ids)))
        open_ = able(rows)
        span = [windows_of(r) for r in range(rows.start, rows.stop)]
        for level in range(len(LEVELS)):
            dense = open_.mean() > _DENSE if open_.size else True
            if dense:
                lower, upper = _bounds(anchors, rows, vectors, level)
            for k, r in enumerate(range(rows.start, rows.stop)):
                at = np.flatnonzero(open_[k])
                if not len(at):
                    continue
                if dense:
                    low, high = lower[k, at], upper[k, at]
                else:
                    low, high = (b[0] for b in _bounds(anchors, slice(r, r + 1), vectors, level, at))
                if level == 0:
                    # Scores of the vectors with the highest bounds set the first floor.
                    probe = at[np.argpartition(-high, _PROBE)[:_PROBE]] if len(at) > _PROBE else at
                    span[k] = narrowed(r, span[k], anchors.scores(r, vectors, probe))
                open_[k, at] = _meets(low, high, *span[k])
        for k, r in enumerate(range(rows.start, rows.stop)):
            at = np.flatnonzero(open_[k])
            yield r, at, anchors.scores(r, vectors, at)


def _meets(low: np.ndarray, high: np.ndarray, lowest: np.ndarray, highest: np.ndarray) -> np.ndarray:
    out = np.zeros(len(low), bool)
    for a, b in zip(lowest, highest, strict=True):
        out |= (high >= a) & (low <= b)
    return out


def _long(scores) -> pa.Array:
    """Scores as longs; sums beyond them stay at their ends."""
    ends = -(1 << 63), (1 << 63) - 1
    return pa.array([min(max(int(s), ends[0]), ends[1]) for s in scores], pa.int64())


def positives_of(anchors: Block, vectors: Block, k: int):
    """(anchor, positive, score) of the `k` best vectors of the anchor's label in a block."""

    def able(rows):
        return (anchors.labels[rows][:, None] == vectors.labels) & (anchors.ids[rows][:, None] != vectors.ids)

    def narrowed(_, windows, scores):
        if len(scores) < k:
            return windows
        return np.array([np.partition(scores, len(scores) - k)[len(scores) - k]]), windows[1]

    out = []
    for r, at, scores in refined(anchors, vectors, able, lambda _: (np.array([-np.inf]), np.array([np.inf])), narrowed):
        out += [(anchors.ids[r], vectors.ids[at[p]], scores[p]) for p in best(scores, k)]
    return out


def negatives_of(anchors: Block, vectors: Block, windows: list, k: int):
    """(anchor, number of the window, negative, score) of the `k` best vectors of other labels in each window."""

    def able(rows):
        some = np.fromiter((len(windows[r][0]) > 0 for r in range(rows.start, rows.stop)), bool)
        return (anchors.labels[rows][:, None] != vectors.labels) & some[:, None]

    def narrowed(_, span, scores):
        lowest = span[0].copy()
        for w, (a, b) in enumerate(zip(*span, strict=True)):
            held = scores[(scores >= a) & (scores <= b)]
            if len(held) >= k:
                lowest[w] = np.partition(held, len(held) - k)[len(held) - k]
        return lowest, span[1]

    out = []
    for r, at, scores in refined(anchors, vectors, able, lambda r: windows[r], narrowed):
        for w, (a, b) in enumerate(zip(*windows[r], strict=True)):
            inside = np.flatnonzero((scores >= a) & (scores <= b))
            out += [(anchors.ids[r], w, vectors.ids[at[inside[p]]], scores[inside[p]]) for p in best(scores[inside], k)]
    return out


def _prepared(vectors: DataFrame, id_col: str, vector_col: str, label: Column) -> DataFrame:
    """(vec_id, label, v, means, deviations): integer vectors with their summaries, one row an id."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & (F.abs(x) < float("inf")))
    scaled = F.transform(vector_col, lambda x: F.floor(256 * x.cast("double")))
    rows = vectors.where(F.col(id_col).isNotNull() & label.isNotNull() & F.col(vector_col).isNotNull() & finite)
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), label.cast("int").alias("label"), scaled.alias("v"))
    single = rows.groupBy("vec_id").agg(F.min(F.struct("label", "v")).alias("r")).select("vec_id", "r.*")
    dims = single.agg(F.max(F.size("v"))).first()[0] or 0

    def summarise(batches):
        for batch in batches:
            means, deviations = summaries(_padded(pa.chunked_array([batch.column(2)]), dims, np.float64))
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), SEGMENTS).cast(pa.list_(pa.float64())) for x in (means, deviations)]
            yield pa.record_batch([*batch.columns, *lists], names=[*batch.schema.names, "means", "deviations"])

    return settle(single.mapInArrow(summarise, "vec_id long, label int, v array<long>, means array<double>, deviations array<double>"), "vectors")


def _met(anchors: DataFrame, vectors: DataFrame, sides: tuple[int, int], go, schema: str) -> DataFrame:
    """`go` over every block of anchors with every block of vectors."""
    down, across = sides

    def dealt(df, own, n, other, m):
        return df.withColumn(own, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(other, F.explode(F.sequence(F.lit(0), F.lit(m - 1))))

    left = dealt(anchors, "i", down, "j", across).groupBy("i", "j")
    return left.cogroup(dealt(vectors, "j", across, "i", down).groupBy("i", "j")).applyInArrow(go, schema)


def _sides(n_anchors: int, n_vectors: int, dims: int, tasks: int) -> tuple[int, int]:
    """Numbers of blocks of anchors and of vectors: as large as a task can hold, but enough of them for all tasks."""
    block = max(1, BLOCK_BYTES // (8 * (dims + 2 * SEGMENTS)))
    down = max(1, -(-n_anchors // block))
    spread = min(-(-tasks // down), -(-n_vectors // LEAST_BLOCK))
    return down, max(1, -(-n_vectors // block), spread)


def mine_negatives(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label: Column | None = None,
    anchor: Column | None = None,
    positives: int = POSITIVES,
    negatives: int = NEGATIVES,
    lowest: int = LOWEST,
    highest: int = HIGHEST,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    Components x are floor(256 x); a score is the inner product of two such vectors. Anchors are the rows where `anchor`
    (an expression over vec_id and label, by default vec_id divisible by 100) holds; an anchor's positives are the
    `positives` best other vectors of its label, and for each of these the `negatives` best vectors of other labels
    whose score is `lowest` to `highest` percent of the positive's. Higher scores come first, ties by smaller id.

    Rows with a null id, label or vector, or a null or non-finite component, take no part. Of rows that repeat an id the
    one with the smallest label, then the smallest vector, counts. Shorter vectors are filled up with zeros. Scores
    beyond a long stay at its ends. An anchor without positives, or a positive without negatives, gives no row; empty
    tables give none. Other columns, whatever their names, are ignored.
    """
    held = _prepared(vectors, id_col, vector_col, F.col("label") if label is None else label)
    chosen = F.col("vec_id") % 100 == 0 if anchor is None else anchor
    peak_of = F.greatest(F.array_max("v").cast("double"), -F.array_min("v").cast("double"))
    n, n_anchors, dims, peak = held.agg(F.count("*"), F.count_if(chosen), F.max(F.size("v")), F.max(peak_of)).first()
    dims, peak = dims or 0, peak or 0
    sides = _sides(n_anchors, n, dims, held.sparkSession.sparkContext.defaultParallelism * 2)
    starts = held.where(chosen)

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        found = positives_of(Block(left, dims, peak), Block(right, dims, peak), positives)
        a, p, s = zip(*found, strict=True) if found else ((), (), ())
        return pa.table([pa.array(a, pa.int64()), pa.array(p, pa.int64()), _long(s)], names=["anchor_id", "positive_id", "score"])

    first = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "positive_id")
    pairs = _met(starts, held, sides, near, "anchor_id long, positive_id long, score long")
    pairs = pairs.withColumn("k", F.row_number().over(first)).where(F.col("k") <= positives)
    by_anchor = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("k", "positive_id", "score"))).alias("positives"))
    aimed = settle(starts.join(by_anchor, F.col("vec_id") == F.col("anchor_id")).drop("anchor_id"), "positives")

    def far(left: pa.Table, right: pa.Table) -> pa.Table:
        anchors, known = Block(left, dims, peak), {}
        for vec_id, held in zip(left.column("vec_id").to_pylist(), left.column("positives").to_pylist(), strict=True):
            known[vec_id] = held
        windows = []
        for vec_id in anchors.ids.tolist():
            s = [int(p["score"]) for p in known[vec_id]]
            windows.append((np.array([-(-lowest * x // 100) for x in s], anchors.exact), np.array([highest * x // 100 for x in s], anchors.exact)))
        found = negatives_of(anchors, Block(right, dims, peak), windows, negatives)
        a, w, b, s = zip(*found, strict=True) if found else ((), (), (), ())
        met = [known[x][k] for x, k in zip(a, w, strict=True)]
        return pa.table(
            [pa.array(a, pa.int64()), pa.array([p["positive_id"] for p in met], pa.int64()), pa.array(b, pa.int64()),
             pa.array([p["score"] for p in met], pa.int64()), _long(s)],
            names=["anchor_id", "positive_id", "negative_id", "positive_score", "negative_score"],
        )

    found = _met(aimed, held, sides, far, "anchor_id long, positive_id long, negative_id long, positive_score long, negative_score long")
    order = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")
    found = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= negatives)
    return found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


#: DuckDB SQL of op13.
SQL = r"""
with v as (
  select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    list_transform(embedding, lambda x: floor(256 * x::double)) as v
  from embeddings
  where label is not null and embedding is not null
    and len(list_filter(embedding, lambda x: x is not null and isfinite(x))) = len(embedding)),
scored as (
  select a.vec_id as a, b.vec_id as b, a.label = b.label as same, list_dot_product(a.v, b.v)::bigint as s
  from v a join v b on a.vec_id % 100 = 0 and a.vec_id <> b.vec_id),
pos as (
  select a, b, s from scored where same
  qualify row_number() over (partition by a order by s desc, b) <= 5)
select p.a as anchor_id, p.b as positive_id, row_number() over (partition by p.a, p.b order by n.s desc, n.b)::int as rank,
  n.b as negative_id, p.s as positive_score, n.s as negative_score
from pos p join scored n on p.a = n.a and not n.same and 30 * p.s <= 100 * n.s and 100 * n.s <= 90 * p.s
qualify row_number() over (partition by p.a, p.b order by n.s desc, n.b) <= 10
"""
