"""Near-duplicates by circulant MinHash.

Two permutations of the universe Z_D (D = 2^32) make all coordinates of a signature: sigma scatters the shingles, and
coordinate k is the least pi((sigma(x) - k) mod D), the same pi circularly shifted k times. Groups of coordinates are
band keys; documents that share a band key are candidates, and candidates are confirmed by the exact Jaccard
similarity of their full shingle sets.

How the work is bounded, whatever the groups of copies:

* Documents with equal sets form a class; only its smallest id goes on (an aggregate, so a class may hold any share of
  all rows).
* In each bucket every member is first compared with the smallest one only: as many pairs as members. Copies of one
  text are thereby in one component, and a bucket within one component is done.
* A remaining bucket is split by the distance from that smallest member and by set size: linked documents differ
  little in both, so the copies of the smallest member leave a bucket that a few other documents are in as well.
* Of what remains, members of buckets of up to `SMALL` are paired, once for all buckets; larger buckets are dealt into
  blocks of bounded size that tasks compare two by two, giving only the links. No pair of a bucket is skipped, unless
  both are already connected or the bounds exclude a link.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import combine, discard, key_filter, packed, pieces, settle, text_rows, unpacked, word_hashes

SHINGLE = 5
PERCENT = 75
BANDS, ROWS = 40, 5  # a pair at 0.75 shares no band with a probability of 2e-5
SMALL = 32
BLOCK = 512_000

_U32 = np.uint32
_CHUNK = 2048  # shingles per block of the signature matrix


def _sigma(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _U32(16))
    x *= _U32(0x7FEB352D)
    x ^= x >> _U32(15)
    x *= _U32(0x846CA68B)
    x ^= x >> _U32(16)
    return x


def _pi(x: np.ndarray) -> np.ndarray:
    x *= _U32(0x9E3779B1)
    x ^= x >> _U32(15)
    x *= _U32(0x85EBCA77)
    x ^= x >> _U32(13)
    x *= _U32(0xC2B2AE3D)
    x ^= x >> _U32(16)
    return x


def signature(shingles: np.ndarray, size: int) -> np.ndarray:
    """`size` coordinates (uint32) of a non-empty set of 64-bit shingle hashes."""
    scattered = _sigma(shingles.astype(np.uint32))
    shifts = np.arange(size, dtype=np.uint32)[:, None]
    least = np.full(size, 0xFFFFFFFF, dtype=np.uint32)
    for begin in range(0, len(scattered), _CHUNK):
        np.minimum(least, _pi(scattered[None, begin : begin + _CHUNK] - shifts).min(axis=1), out=least)
    return least


def shingle_sets(column: pa.Array, shingle: int) -> Iterator[np.ndarray]:
    """For every row the sorted distinct hashes of its word shingles."""
    empty = np.zeros(0, dtype=np.uint64)
    for _, part in pieces(column):
        bounds, words = word_hashes(part)
        n = len(words) - shingle + 1
        windows = combine([words[j : n + j] for j in range(shingle)]) if n > 0 else empty
        for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
            if end - begin >= shingle:
                yield np.unique(windows[begin : end - shingle + 1])
            elif end > begin:
                yield combine([words[i : i + 1] for i in range(begin, end)], seed=100 + int(end - begin))
            else:
                yield empty


def _signed(docs: DataFrame, shingle: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, (c1, c2) the class of equal sets, keys: the band keys."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("c1", pa.int64()), ("c2", pa.int64()), ("keys", pa.list_(pa.int64()))]
    )

    def sign(batches):
        labels = np.arange(bands, dtype=np.uint64)
        for batch in batches:
            sizes, c1, c2, keys = [], [], [], []
            for found in shingle_sets(batch.column(1), shingle):
                sizes.append(len(found))
                if not len(found):
                    c1.append(0), c2.append(0), keys.append(None)
                    continue
                # Two sums over the set, of differently mixed elements, and its size name the class.
                n = np.full(1, len(found), dtype=np.uint64)
                one = combine([combine([found], seed=7).sum(keepdims=True), n], seed=8)
                two = combine([combine([found], seed=9).sum(keepdims=True), n], seed=10)
                c1.append(int(one.view(np.int64)[0])), c2.append(int(two.view(np.int64)[0]))
                least = signature(found, bands * rows).astype(np.uint64).reshape(bands, rows)
                keys.append(combine([labels, *least.T], seed=11).view(np.int64))
            yield pa.record_batch([batch.column(0), pa.array(sizes, pa.int64()), pa.array(c1, pa.int64()), pa.array(c2, pa.int64()), pa.array(keys, pa.list_(pa.int64()))], schema=schema)

    return docs.mapInArrow(sign, "doc_id long, n_shingles long, c1 long, c2 long, keys array<long>")


def _sets(docs: DataFrame, shingle: int) -> DataFrame:
    def build(batches):
        for batch in batches:
            found = [s.view(np.int64) for s in shingle_sets(batch.column(1), shingle)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "shingles"])

    return docs.mapInArrow(build, "doc_id long, shingles array<long>")


def _compared(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(a, b, zone, linked) of distinct pairs (a, b), from their full sets. zone is the Jaccard distance in units of the
    greatest distance of a link, rounded down."""
    left = sets.select(F.col("doc_id").alias("a"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb")).cast("long")
    met = pairs.join(right, "b").join(left, "a").select("a", "b", both.alias("n"), (F.size("sa").cast("long") + F.size("sb")).alias("m"))
    return met.selectExpr(
        "a", "b",
        f"cast(100 * (m - 2 * n) div ({100 - percent} * (m - n)) as int) as zone",
        f"100 * n >= {percent} * (m - n) as linked",
    )


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node reachable over the links (a, b). Rounds of neighbour minima and pointer
    jumping; every round is a written table."""
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other")
    both = settle(both, "links")
    labels = both.groupBy("node").agg(F.min("other").alias("low")).select("node", F.least("node", "low").alias("label"))
    labels = held = settle(labels, "labels")
    while True:
        near = (
            both.join(labels.select(F.col("node").alias("other"), F.col("label").alias("seen")), "other")
            .groupBy("node").agg(F.min("seen").alias("seen"))
        )
        lower = labels.join(near, "node").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        ends = labels.select(F.col("node").alias("label"), F.col("label").alias("end"))
        moved = settle(
            lower.join(ends, "label").select("node", "old", F.least("label", "end").alias("label")), "labels"
        )
        changed = moved.where("label <> old").limit(1).count()
        discard(held)
        held, labels = moved, moved.select("node", "label")
        if not changed:
            discard(both)
            return labels


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    shingle: int = SHINGLE,
    percent: int = PERCENT,
    bands: int = BANDS,
    rows: int = ROWS,
) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of `docs`.

    Words are `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased; a document's set holds its distinct `shingle`-word shingles,
    or its whole word sequence where that is shorter. Documents with 100 * |both| >= percent * |either| are linked,
    component_id is the smallest id reachable and kept says that this is the document itself.

    Null, empty or blank texts have no shingles and no links. Rows that repeat an id give a row each. A null id takes
    no part in the comparison: its component is null and it is kept. An empty table gives an empty result. Other
    columns are ignored.
    """
    texts = text_rows(docs, id_col, text_col)
    signed = settle(_signed(texts, shingle, bands, rows), "signed")
    classes = signed.where("n_shingles > 0 and doc_id is not null").groupBy("c1", "c2").agg(
        F.min(F.struct("doc_id", "keys")).alias("first")
    )
    first = settle(classes.select("c1", "c2", F.col("first.doc_id").alias("rep"), F.col("first.keys").alias("keys")), "classes")
    narrow = settle(signed.drop("keys"), "classed")
    discard(signed)
    labels = _linked(texts, first.select(F.col("rep").alias("doc_id"), "keys"), shingle, percent)
    named = first.select("c1", "c2", "rep").join(labels, F.col("rep") == F.col("node"), "left").select(
        "c1", "c2", F.coalesce("label", "rep").alias("component")
    )
    component = F.when(F.col("n_shingles") > 0, F.col("component")).otherwise(F.col("doc_id"))
    return narrow.join(named, ["c1", "c2"], "left").select(
        "doc_id", "n_shingles",
        F.when(F.col("doc_id").isNotNull(), component).alias("component_id"),
    ).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_first(docs: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, without the near copies of a document with a smaller id. Of rows that repeat an
    id one stays; rows with a null id all stay. Rows with equal columns elsewhere, clashing names included, are left
    as they are."""
    found = near_duplicates(docs, id_col, **options)
    dropped = found.where(~F.col("kept")).select("doc_id").distinct()
    rows = packed(docs).withColumn("doc_id", F.col(f"row.`{id_col}`").cast("long"))
    left = rows.join(dropped, "doc_id", "left_anti")
    # The window meets the rows as the join has dealt and sorted them.
    left = left.withColumn("alone", F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id()))
    again = F.row_number().over(Window.partitionBy("doc_id", "alone").orderBy("doc_id"))
    left = left.withColumn("again", again).where("again = 1")
    return left.select(unpacked(left, docs.columns))


def _linked(texts: DataFrame, reps: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, label) of every representative that is linked with another one."""
    members = reps.select("doc_id", F.explode("keys").alias("bucket"))
    live = members.groupBy("bucket").agg(F.min("doc_id").alias("pivot"), F.count("*").alias("n")).where("n > 1")
    live = settle(live.drop("n"), "live")
    # Most keys are their document's alone, and most documents have no other; neither has to be shuffled to be dropped.
    members = settle(members.where(key_filter(live, "bucket")("bucket")).join(live, "bucket"), "buckets")
    wanted = settle(members.select("doc_id").distinct(), "wanted")
    near = texts.where(key_filter(wanted, "doc_id")("doc_id"))
    discard(live)
    sets = settle(_sets(near.join(wanted, "doc_id", "left_semi"), shingle).dropDuplicates(["doc_id"]), "sets")
    discard(wanted)
    pairs = members.where("doc_id <> pivot").select(F.col("pivot").alias("a"), F.col("doc_id").alias("b")).distinct()
    stars = settle(_compared(pairs, sets, percent), "stars")
    links = stars.where("linked").select("a", "b")
    labels = components(links)

    met = members.join(stars, [F.col("pivot") == F.col("a"), F.col("doc_id") == F.col("b")])
    sizes = sets.select("doc_id", F.size("shingles").alias("size"))
    left = settle(_unfinished(_split(met.select("bucket", "doc_id", "zone").join(sizes, "doc_id"), percent), labels), "unfinished")
    counted = left.groupBy("bucket").agg(F.count("*").alias("n"), F.sum(F.greatest("size", F.lit(1000))).alias("weight"))
    few = left.join(counted.where(F.col("n") <= SMALL).select("bucket"), "bucket", "left_semi")
    one = few.select("bucket", F.col("doc_id").alias("a"), F.col("label").alias("la"), F.col("far").alias("fa"), F.col("large").alias("ga"))
    # Two members of both the upper zone, or both the upper class, also meet in the bucket where these are the lower ones.
    met = one.join(few, "bucket").where("a < doc_id and la <> label and not (fa and far) and not (ga and large)")
    pairs = met.select("a", F.col("doc_id").alias("b")).distinct()
    found = _compared(pairs.join(stars, ["a", "b"], "left_anti"), sets, percent).where("linked").select("a", "b")
    many = left.drop("far", "large").join(counted.where(F.col("n") > SMALL).select("bucket", "weight"), "bucket").join(sets, "doc_id")
    found = settle(found.union(_blockwise(many, percent)), "links")
    labels = components(links.union(found)) if found.limit(1).count() else labels
    discard(members, sets, stars, left, found)
    return labels


def _split(met: DataFrame, percent: int) -> DataFrame:
    """Splits the members (bucket, doc_id, zone, size) of each bucket where no link can lie: linked documents are in one
    zone of distance from the bucket's pivot or in two adjacent ones (triangle inequality), and likewise in one class of
    set sizes or two adjacent ones. Each two adjacent zones and classes make a bucket; `far` and `large` mark a member of
    the upper ones."""
    base = math.log(100 / percent) + 0.005  # above the greatest ratio of sizes, so that rounding splits no link
    rank = F.floor(F.log("size") / base).cast("int")

    def lower_and_upper(value, upper: str):
        return F.explode(F.array(*[F.struct((value - k).alias("low"), F.lit(bool(k)).alias(upper)) for k in (0, 1)]))

    return (
        met.select("bucket", "doc_id", "size", lower_and_upper(F.col("zone"), "far").alias("z"), rank.alias("rank"))
        .select("bucket", "doc_id", "size", "z", lower_and_upper(F.col("rank"), "large").alias("r"))
        .select(F.xxhash64("bucket", "z.low", "r.low").alias("bucket"), "doc_id", "size", "z.far", "r.large")
    )


def _blockwise(members: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) across components within buckets (bucket, doc_id, label, size, weight, shingles) of any size.

    A bucket is dealt into blocks of about `BLOCK` shingles, and every two blocks are compared by one task: the exact
    sizes of all intersections are a product of two 0/1 matrices over the shingles that occur more than once.
    """
    n = F.ceil(F.col("weight") / BLOCK).cast("int")
    own = F.pmod(F.xxhash64("doc_id"), F.col("n")).cast("int")
    dealt = members.withColumn("n", n).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    dealt = dealt.select(
        "bucket", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "doc_id", "label", "shingles"
    )

    def compare(table: pa.Table) -> pa.Table:
        i, j, own, ids, labels = (table.column(k).to_numpy() for k in range(1, 6))
        held = table.column(6).combine_chunks()
        sizes = np.diff(held.offsets.to_numpy())
        _, code, times = np.unique(held.flatten().to_numpy(), return_inverse=True, return_counts=True)
        row = np.repeat(np.arange(len(ids)), sizes)
        often = times[code] > 1
        row, (_, code) = row[often], np.unique(code[often], return_inverse=True)
        both = np.zeros((len(ids), len(ids)), np.float32)
        order = np.argsort(code, kind="stable")
        row, code = row[order], code[order]
        for low in range(0, int(code[-1]) + 1 if len(code) else 0, _CHUNK):
            part = slice(*np.searchsorted(code, [low, low + _CHUNK]))
            hits = np.zeros((len(ids), _CHUNK), np.float32)
            hits[row[part], code[part] - low] = 1
            both += hits @ hits.T
        either = sizes[:, None] + sizes[None, :] - both
        near = (100 * both >= percent * either) & (ids[:, None] < ids[None, :]) & (labels[:, None] != labels[None, :])
        near &= (i == j)[:, None] | (own[:, None] != own[None, :])
        a, b = np.nonzero(near)
        return pa.table({"a": pa.array(ids[a], pa.int64()), "b": pa.array(ids[b], pa.int64())})

    return dealt.groupBy("bucket", "i", "j").applyInArrow(compare, "a long, b long").distinct()


def _unfinished(members: DataFrame, labels: DataFrame) -> DataFrame:
    """Members of buckets that span several components, with their component."""
    named = members.join(labels, F.col("doc_id") == F.col("node"), "left").select(
        *members.columns, F.coalesce("label", "doc_id").alias("label")
    )
    spread = named.groupBy("bucket").agg(
        F.min("label").alias("low"), F.max("label").alias("high"), F.min("far").alias("all_far"), F.min("large").alias("all_large")
    )
    # Where all members are of the upper zone, or class, the bucket in which these are the lower ones has them all.
    spread = spread.where("low <> high and not all_far and not all_large")
    return named.join(spread.select("bucket"), "bucket", "left_semi")
