"""Target-distribution importance resampling over hashed word n-grams, with segment deduplication.

Texts are drawn with probability in proportion to how much likelier their features are in a target corpus than in the
raw one. Most of the features of a crawl stand in lines that occur many times, so the work goes by line:

1. Newlines cut every text into lines; a line is its words joined by one space. Equal lines become one row with the
   number of their occurrences (a partial aggregate first, so a line with any share of all rows costs a row a task).
2. The buckets of a distinct line's n-grams are computed once; corpus counts are these, times the occurrences.
3. N-grams that cross lines belong to the text: they are hashed from the two last words before a line and the two first
   of it, and added separately to the counts and to the text's weight.
4. The gains of the buckets, a table of fixed size, give every distinct line and every crossing list one number; lines
   give theirs back to the texts that hold them. Lines with over 1/`FREQUENT` of all occurrences, at most `FREQUENT`, are
   broadcast; all others meet their texts in a join whose keys are that small.
5. Gumbel noise from the id turns the largest scores into a draw without replacement. Ranks come from slices of the
   global order, a task a slice.
"""

from __future__ import annotations

import functools
import math
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.ordering import SLICE, sliced
from docstrata.llm.shared import settle

BUCKETS = 10_000
ORDERS = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
FREQUENT = 4096

#: A-Z lower-cased; every other ASCII byte that is in no word, newlines apart, becomes a space.
_FOLD = bytes(b if b > 127 or b == 10 or chr(b).isalnum() else 32 for b in range(256)).lower()
_LONGEST = 64  # bytes of a word with its space; longer ones are hashed one by one


def segments(text: bytes) -> list[bytes]:
    """The lines of a text that hold a word, each as its words joined by one space."""
    return [x for line in text.translate(_FOLD).split(b"\n") if (x := b" ".join(line.split()))]


@functools.cache
def _shifts() -> np.ndarray:
    """[n, j, b]: what the checksum b << 8 j becomes when n zero bytes follow. Checksums are linear, so that of two texts
    is this of the first, by the length of the second, exclusive or that of the second."""
    nil = [bytes(n) for n in range(_LONGEST + 1)]
    return np.array(
        [[[zlib.crc32(z, b << 8 * j) ^ zlib.crc32(z) for b in range(256)] for j in range(4)] for z in nil], np.uint32
    )


def _followed(before: np.ndarray, sizes: np.ndarray, after: np.ndarray, words: list[bytes], space: bytes) -> np.ndarray:
    """Checksums of texts with the checksums `before`, each followed by `space` and a word, together of the given `sizes`
    and with the checksums `after`."""
    table, n = _shifts(), np.minimum(sizes, _LONGEST)
    out = after.copy()
    for j in range(4):
        out ^= table[n, j, (before >> np.uint32(8 * j)) & np.uint32(255)]
    for k in np.flatnonzero(sizes > _LONGEST):
        out[k] = zlib.crc32(space + words[k], int(before[k]))
    return out


def line_buckets(lines: list[bytes], buckets: int = BUCKETS, orders: int = ORDERS) -> tuple[np.ndarray, np.ndarray]:
    """(buckets of all runs of 1 to `orders` words within a line, number of them by line), line after line."""
    words, counts = [], []
    for line in lines:
        own = line.split(b" ")
        words += own
        counts.append(len(own))
    counts = np.array(counts, np.int64)
    place = np.arange(len(words)) - np.repeat(np.cumsum(counts) - counts, counts)
    runs = np.zeros((len(words), orders), np.uint32)
    runs[:, 0] = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 1
    after = _followed(np.full(len(words), zlib.crc32(b" "), np.uint32), sizes - 1, runs[:, 0], words, b"")
    for k in range(1, orders):
        runs[1:, k] = _followed(runs[:-1, k - 1], sizes[1:], after[1:], words[1:], b" ")
    there = place[:, None] >= np.arange(orders)
    ends = np.cumsum(there.sum(axis=1))[np.cumsum(counts) - 1] if len(lines) else np.zeros(0, np.int64)
    return (runs[there] % np.uint32(buckets)).astype(np.int32), np.diff(ends, prepend=0)


def crossing_buckets(lines: list[bytes], buckets: int = BUCKETS, orders: int = ORDERS) -> list[int]:
    """The bucket of every run of 2 to `orders` words that begins in one line and ends in a later one."""
    found: list[int] = []
    held: list[bytes] = []
    for line in lines:
        first = line.split(b" ", orders - 1)[: orders - 1]
        near = held + first
        for end in range(len(held), len(near)):
            for begin in range(max(0, end - orders + 1), len(held)):
                found.append(zlib.crc32(b" ".join(near[begin : end + 1])) % buckets)
        last = line.rsplit(b" ", orders - 1)
        held = (held + last[1 - len(last) :] if len(last) == orders else held + last)[1 - orders :] if orders > 1 else []
    return found


def _packed(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def _cut(column: pa.Array) -> Iterator[list[bytes]]:
    for text in column.cast(pa.binary()).to_pylist():
        yield segments(text or b"")


def _texts(docs: DataFrame, buckets: int, orders: int) -> DataFrame:
    """A row a text: doc_id, n_words, n_features, crossing (buckets), keys (a digest a line, repeats included)."""

    def read(batches):
        for batch in batches:
            words, crossing, keys = [], [], []
            for lines in _cut(batch.column(1)):
                words.append(sum(x.count(b" ") + 1 for x in lines))
                crossing.append(crossing_buckets(lines, buckets, orders))
                keys.append([xxhash.xxh3_128_digest(x) for x in lines])
            runs = [sum(max(0, n - k) for k in range(orders)) for n in words]
            yield pa.record_batch(
                [batch.column(0), pa.array(words, pa.int64()), pa.array(runs, pa.int64()), pa.array(crossing, pa.list_(pa.int32())), pa.array(keys, pa.list_(pa.binary()))],
                names=["doc_id", "n_words", "n_features", "crossing", "keys"],
            )

    return docs.mapInArrow(read, "doc_id long, n_words long, n_features long, crossing array<int>, keys array<binary>")


def _lines(docs: DataFrame, buckets: int, orders: int) -> DataFrame:
    """A row a distinct line: key, times, inner (the buckets of its runs)."""

    def cut(batches):
        for batch in batches:
            held = Counter(line for lines in _cut(batch.column(0)) for line in lines)
            yield pa.record_batch([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], names=["line", "n"])

    def read(batches):
        for batch in batches:
            lines = batch.column(0).to_pylist()
            keys = pa.array([xxhash.xxh3_128_digest(x) for x in lines], pa.binary())
            inner = _packed(*line_buckets(lines, buckets, orders))
            yield pa.record_batch([keys, batch.column(1), inner], names=["key", "times", "inner"])

    distinct = docs.select("text").mapInArrow(cut, "line binary, n long").groupBy("line").agg(F.sum("n").alias("times"))
    return distinct.mapInArrow(read, "key binary, times long, inner array<int>")


def _counts(rows: DataFrame, buckets: int) -> DataFrame:
    """(bucket, n) of each task over rows (times, list of buckets)."""

    def add(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            sizes = batch.column(1).value_lengths().fill_null(0).to_numpy()
            times = np.repeat(batch.column(0).to_numpy(), sizes)
            np.add.at(total, batch.column(1).flatten().to_numpy(), times)
        hit = np.flatnonzero(total)
        yield pa.record_batch([pa.array(hit, pa.int32()), pa.array(total[hit])], names=["bucket", "n"])

    return rows.mapInArrow(add, "bucket int, n long")


def _prepared(docs: DataFrame, label: str, buckets: int, orders: int) -> tuple[DataFrame, DataFrame, np.ndarray]:
    """(texts, lines, count of each bucket) of rows (doc_id, text), the tables written."""
    # The number of a row is written with it, so that it stays the same wherever it is read.
    texts = settle(_texts(docs, buckets, orders).withColumn("row", F.monotonically_increasing_id()), f"{label}-texts")
    lines = settle(_lines(docs, buckets, orders), f"{label}-lines")
    parts = _counts(lines.select("times", "inner"), buckets).union(
        _counts(texts.select(F.lit(1).cast("long").alias("times"), F.col("crossing").alias("inner")), buckets)
    )
    counts = np.zeros(buckets, np.int64)
    # At most `buckets` rows.
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n")).collect():
        counts[bucket] = n
    return texts, lines, counts


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln of the ratio of the smoothed shares of each bucket), target over raw."""
    n = len(raw)
    s, t = float(raw.sum() + n), float(target.sum() + n)
    return np.array(
        [math.floor(1000 * math.log((float(b) + 1) * s / ((float(a) + 1) * t))) for a, b in zip(raw, target, strict=True)], np.int64
    )


def _weighed(rows: DataFrame, gain: np.ndarray, keep: str) -> DataFrame:
    """The columns `keep` (DDL) and `gain`, the sum over the list of buckets in the last column."""

    def weigh(batches):
        for batch in batches:
            held = batch.column(batch.num_columns - 1)
            ends = np.cumsum(held.value_lengths().fill_null(0).to_numpy())
            sums = np.concatenate([[0], np.cumsum(gain[held.flatten().to_numpy()])])
            own = np.diff(sums[np.concatenate([[0], ends])])
            yield pa.record_batch([*batch.columns[:-1], pa.array(own, pa.int64())], names=[*batch.schema.names[:-1], "gain"])

    return rows.mapInArrow(weigh, f"{keep}, gain long")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """floor(1000 * Gumbel noise) from the digest of `seed:doc_id`."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def resample(
    docs: DataFrame,
    target: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    target_text_col: str = "text",
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    orders: int = ORDERS,
    frequent: int = FREQUENT,
) -> DataFrame:
    """doc_id, n_features, weight, score, rank (all long) for every row of `docs`; rank 1, 2, ... marks the drawn ones.

    Words are `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+` with A-Z lower-cased; features are all runs of 1 to `orders` words of
    the whole text, hashed by CRC-32 into `buckets`. A bucket's gain is floor(1000 ln) of its smoothed share in `target`
    over that in `docs`, the weight the sum of gains, the score adds Gumbel noise from the id. Of the N rows with
    `least_words` words the floor(percent * N / 100) highest scores are drawn, ties going to the smaller id.

    A null or empty text has no features and weight 0. A null id has no noise: its score and rank are null and it does
    not count in N. Rows that repeat an id are rows of their own with equal noise; equal ones come in an undefined order
    among themselves. Empty tables give no rows, or gains from the smoothing alone. Other columns, whatever their names,
    are ignored.
    """
    raw = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    wanted = target.select(F.lit(None).cast("long").alias("doc_id"), F.col(target_text_col).cast("string").alias("text"))
    texts, lines, held = _prepared(raw, "raw", buckets, orders)
    _, _, aim = _prepared(wanted, "target", buckets, orders)
    gain = gains(held, aim)

    worth = settle(_weighed(lines.select("key", "times", "inner"), gain, "key binary, times long"), "line-gains")
    total = worth.agg(F.sum("times")).first()[0] or 0
    often = F.col("times") * frequent > total
    holds = texts.select("row", F.explode("keys").alias("key"))
    known = F.broadcast(worth.where(often).select("key", F.col("gain").alias("common")))  # fewer than `frequent` rows
    split = holds.join(known, "key", "left")
    common = split.where("common is not null").select("row", F.col("common").alias("gain"))
    rare = split.where("common is null").select("row", "key").join(worth.where(~often).select("key", "gain"), "key").select("row", "gain")
    nothing = [F.lit(None).cast("long").alias(c) for c in ("doc_id", "n_words", "n_features")]
    own = _weighed(
        texts.select("row", "doc_id", "n_words", "n_features", "crossing"), gain, "row long, doc_id long, n_words long, n_features long"
    ).select("row", "gain", "doc_id", "n_words", "n_features")
    weights = own.union(common.union(rare).select("row", "gain", *nothing)).groupBy("row").agg(
        F.sum("gain").alias("weight"), *[F.max(c).alias(c) for c in ("doc_id", "n_words", "n_features")]
    )
    return _ranked(weights.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), percent, least_words)


def _ranked(scored: DataFrame, percent: int, least_words: int) -> DataFrame:
    able = (F.col("n_words") >= least_words) & F.col("score").isNotNull()
    scored = settle(scored.withColumn("last", F.when(able, 0).otherwise(1)).withColumn("down", -F.col("score")), "scores")
    order = ["last", "down", "doc_id", "row"]
    dealt = sliced(scored, order, "ranked")
    sizes = dealt.groupBy(SLICE).agg(F.count("*").alias("n"), F.sum(1 - F.col("last")).alias("able"))
    # A row a slice: as many as partitions.
    before = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    starts = sizes.select(
        SLICE, F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"),
        F.floor(percent * F.sum("able").over(every) / 100).alias("quota"),
    )
    place = F.row_number().over(Window.partitionBy(SLICE).orderBy(*order)) + F.col("start")
    ranked = dealt.join(starts, SLICE).withColumn("place", place)
    drawn = (F.col("last") == 0) & (F.col("place") <= F.col("quota"))
    return ranked.select("doc_id", "n_features", "weight", "score", F.when(drawn, F.col("place")).cast("long").alias("rank"))


#: DuckDB SQL of op11. CRC-32 by bytes, from a table of 256 remainders made by its rule.
SQL = r"""
with recursive rem(b, c, k) as (
  select range, range, 0 from range(256)
  union all select b, case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from rem where k < 8),
crc as (select list(c order by b) as t from rem where k = 8),
texts as (
  select doc_id, 0 as target, text from documents union all select item_id, 1, text from benchmark),
words as (
  select row_number() over () as r, doc_id, target, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from texts),
places as (select r, target, w, unnest(range(1, len(w) + 1)) as i from words),
runs as (
  select r, target, array_to_string(list_slice(w, i, i + k - 1), ' ') as f
  from places, (select unnest([1, 2, 3]) as k) where i + k - 1 <= len(w)),
per as (select r, target, f, count(*) as n from runs group by all),
codes as (
  select f, xor(list_reduce(list_prepend(4294967295::bigint, list_transform(range(len(h) // 2),
      lambda i: ('0x' || h[2 * i + 1 : 2 * i + 2])::bigint)),
    lambda c, b: xor(c >> 8, t[xor(c & 255, b) + 1])), 4294967295) % 10000 as bucket
  from (select distinct f, hex(encode(f)) as h from per), crc),
counts as (
  select bucket, coalesce(sum(n) filter (where target = 0), 0) as s, coalesce(sum(n) filter (where target = 1), 0) as t
  from per join codes using (f) group by bucket),
gain as (
  select bucket, floor(1000 * ln((t + 1)::double * ((select sum(s) from counts) + 10000)::double
    / ((s + 1)::double * ((select sum(t) from counts) + 10000)::double)))::bigint as g from counts),
weights as (select r, sum(n) as n_features, sum(n * g) as weight from per join codes using (f) join gain using (bucket)
  where target = 0 group by r),
scored as (
  select doc_id, len(w) >= 20 as able, coalesce(n_features, 0) as n_features, coalesce(weight, 0) as weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('42:' || doc_id)[1:8])::bigint + 0.5) / 4294967296)))::bigint as score
  from words left join weights using (r) where target = 0),
ranked as (
  select *, row_number() over (partition by able order by score desc, doc_id) as k, count(*) over (partition by able) as n
  from scored)
select doc_id, n_features::bigint as n_features, weight::bigint as weight, score::bigint as score,
  case when able and k <= floor(5 * n / 100) then k end as rank
from ranked
"""
