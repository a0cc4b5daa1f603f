"""Passages that repeat across documents, by seed and extend.

A window is `least` consecutive words. Its anchor is the run of `seed` words with the smallest hash in it (winnowing), so
equal windows have equal anchors at equal offsets, and every window of a text has one. Windows of a text with the same
anchor are one range of starts: a text gives some n / 20 anchored ranges, not n windows.

1. Texts of equal words are one class; its smallest id goes on, the others repeat it whole.
2. Anchored ranges with equal words from end to end are one class too; all but its smallest id repeat it whole. Both are
   aggregates, so a class may hold any share of all rows.
3. Anchors that several classes share are the seeds. In rounds, each range of a seed is extended to the left and to the
   right along the smallest id of its group (as many pairs as ranges): windows within the common words are repeats of
   it. The others can only repeat a range that leaves the common words at the same place with the same next word, which
   names their group in the next round. Every round makes the common words longer, so the rounds end; a group within
   one id is done.
4. A maximal repeat is the union of a text's repeated windows; its words go.

Hashes find the seeds and groups, and a clash of these only costs work: what counts as equal is compared word by word,
as 64-bit hashes. No pair of copies is listed, no group is gathered.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import combine, discard, mix64, pieces, settle, text_rows, word_hashes

LEAST = 50
SEED = 12

_SLICE = 1 << 23
_PLACE = np.uint64((1 << 24) - 1)
_U64 = np.uint64


def anchors(words: np.ndarray, bounds: np.ndarray, least: int = LEAST, seed: int = SEED) -> tuple[np.ndarray, ...]:
    """(row, anchor, content, at, low, high) of the anchored ranges of texts laid end to end: the anchor's hash, a hash of
    all words of the range, the place of the anchor and of the first and last window, counted within the row."""
    n = len(words) - least + 1
    if n <= 0:
        return tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.int32, np.int32, np.int32))
    runs = combine([words[j : len(words) - seed + 1 + j] for j in range(seed)], seed=21)
    width = least - seed + 1
    place = np.empty(n, np.int64)
    for begin in range(0, n, _SLICE):
        part = runs[begin : min(begin + _SLICE, n) + width - 1]
        # The order: upper bits of the hash, then the place, so that ties go to the left.
        low = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)
        span = 1
        while span < width:
            step = min(span, width - span)
            low = np.minimum(low[:-step], low[step:])
            span += step
        place[begin : begin + len(low)] = begin + (low & _PLACE).astype(np.int64)
    row = np.searchsorted(bounds, np.arange(n), "right") - 1
    inside = np.arange(n) + least <= bounds[row + 1]
    starts = np.flatnonzero(inside)
    if not len(starts):
        return anchors(words[:0], bounds, least, seed)
    place, row = place[starts], row[starts]
    new = np.ones(len(starts), bool)
    new[1:] = (place[1:] != place[:-1]) | (row[1:] != row[:-1])
    first = np.flatnonzero(new)
    last = np.append(first[1:], len(starts)) - 1
    low, high, at, row = starts[first], starts[last], place[first], row[first]
    end = high + least - seed
    steps = -(-(2 * least - seed) // seed)
    held = [runs[np.minimum(low + seed * k, end)] for k in range(steps)]
    content = combine([*held, (at - low).astype(np.uint64), (high - low).astype(np.uint64)], seed=22)
    begin = bounds[row]
    return row, runs[at].view(np.int64), content.view(np.int64), *((x - begin).astype(np.int32) for x in (at, low, high))


def fingerprints(words: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes (columns) of each row's sequence of words."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), 2), np.int64)
    some = np.flatnonzero(sizes)
    if len(some):
        place = (np.arange(len(words)) - np.repeat(bounds[:-1], sizes)).astype(np.uint64)
        for k in (0, 1):
            mixed = mix64(words + place * _U64((0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)[k]))
            total = np.add.reduceat(mixed, bounds[:-1][some])
            out[some, k] = combine([total, sizes[some].astype(np.uint64)], seed=23 + k).view(np.int64)
    return out


_ANCHORS = "array<struct<anchor:bigint,content:bigint,at:int,low:int,high:int>>"


def _signed(texts: DataFrame, least: int, seed: int) -> DataFrame:
    """doc_id, tx, n_words, (c1, c2) the class of equal words, ranges."""

    def sign(batches):
        for batch in batches:
            for begin, part in pieces(batch.column(2)):
                bounds, words = word_hashes(part, fold=False)
                row, *columns = anchors(words, bounds, least, seed)
                ends = np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)
                items = pa.StructArray.from_arrays([pa.array(c) for c in columns], names=["anchor", "content", "at", "low", "high"])
                prints = fingerprints(words, bounds)
                yield pa.record_batch(
                    [*(batch.column(k).slice(begin, len(part)) for k in (0, 1)), pa.array(np.diff(bounds)), pa.array(prints[:, 0]),
                     pa.array(prints[:, 1]), pa.ListArray.from_arrays(pa.array(ends), items)],
                    names=["doc_id", "tx", "n_words", "c1", "c2", "ranges"],
                )

    return texts.mapInArrow(sign, f"doc_id long, tx long, n_words long, c1 long, c2 long, ranges {_ANCHORS}")


_RANGE = "g long, doc_id long, tx long, at int, low int, high int, left binary, right binary"


def _contexts(rows: DataFrame, least: int) -> DataFrame:
    """Ranges with the hashes of their words: `left` outwards from the anchor, `right` from the anchor's first word on;
    low and high are counted from the anchor. Rows are (doc_id, tx, text, ranges)."""

    def read(batches):
        for batch in batches:
            ids, txs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            wanted = batch.column(3)
            for begin, part in pieces(batch.column(2)):
                bounds, words = word_hashes(part, fold=False)
                out = []
                for k in range(len(part)):
                    own = words[bounds[k] : bounds[k + 1]]
                    for r in wanted[begin + k].as_py():
                        g, at, low, high = r["anchor"], r["at"], r["low"], r["high"]
                        left, right = own[low:at][::-1], own[at : high + least]
                        out.append((g, ids[begin + k], txs[begin + k], at, low - at, high - at, left.tobytes(), right.tobytes()))
                yield _ranges(*([list(c) for c in zip(*out)] if out else [[]] * 8))

    return rows.mapInArrow(read, _RANGE)


def _ranges(*columns) -> pa.RecordBatch:
    kinds = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()] * 2
    names = ["g", "doc_id", "tx", "at", "low", "high", "left", "right"]
    return pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


def _matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, sizes): a row of hashes for each value, zeros after its end."""
    values = column.to_pylist()
    sizes = np.fromiter((len(v) // 8 for v in values), np.int64, len(values))
    out = np.zeros((len(values), int(sizes.max(initial=0)) + 1), np.uint64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer(b"".join(values), np.uint64)
    return out, sizes


def _common(mine: pa.Array, other: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(length of the common beginning, hash of the next word of `mine` or 0)."""
    (a, na), (b, nb) = _matrix(mine), _matrix(other)
    width = min(a.shape[1], b.shape[1])
    equal = (a[:, :width] == b[:, :width]) & (np.arange(width) < np.minimum(na, nb)[:, None])
    n = equal.argmin(axis=1)  # the last column is past an end
    return n, a[np.arange(len(a)), n]


def _extend(rows: DataFrame, least: int) -> DataFrame:
    """Extends ranges along their group's first one. `cut` rows hold repeated windows (low to high, from the anchor), the
    others what is left for the groups of the next round."""

    def go(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, low, high = (batch.column(k).to_numpy() for k in (1, 4, 5))
            first = batch.column(8).to_numpy()
            l, left = _common(batch.column(6), batch.column(9))
            r, right = _common(batch.column(7), batch.column(10))
            g = batch.column(0).to_numpy().astype(np.int64).view(np.uint64)
            nil = np.zeros(len(ids), np.int64)
            one, two = np.maximum(low, -l), np.minimum(high, r - least)
            parts = [
                (True, one, two, nil.view(np.uint64), (one <= two) & (first < ids)),
                (False, low, np.minimum(high, -l - 1), combine([g, l.astype(np.uint64), left], seed=25), low < -l),
                (False, np.maximum(one, r - least + 1), high, combine([g, r.astype(np.uint64), right], seed=26), np.maximum(one, r - least + 1) <= high),
            ]
            for cut, begin, end, group, some in parts:
                at = np.flatnonzero(some)
                kept = batch.take(pa.array(at))
                sides = [pa.nulls(len(at), pa.binary())] * 2 if cut else [kept.column(6), kept.column(7)]
                yield pa.record_batch(
                    [pa.array(np.full(len(at), cut)), pa.array(group[at].view(np.int64)), kept.column(1), kept.column(2), kept.column(3),
                     pa.array(begin[at], pa.int32()), pa.array(end[at], pa.int32()), *sides],
                    names=["cut", "g", "doc_id", "tx", "at", "low", "high", "left", "right"],
                )

    return rows.mapInArrow(go, f"cut boolean, {_RANGE}")


def _seeded(texts: DataFrame, reps: DataFrame, least: int) -> DataFrame:
    """(doc_id, tx, low, high): repeated windows of the representatives, from the start of the text."""
    ranges = reps.select("doc_id", "tx", F.explode("ranges").alias("r")).select("doc_id", "tx", "r.*")
    classes = ranges.groupBy("anchor", "content").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    classes = settle(classes, "range-classes")
    shared = classes.groupBy("anchor").agg(
        F.min("first").alias("low"), F.max("last").alias("high"), F.count("*").alias("n")
    ).where("low < high").select("anchor", "n")
    live = settle(classes.join(shared, "anchor").select("anchor", "content", "first", "n"), "live")
    met = settle(ranges.join(live, ["anchor", "content"]), "met")
    discard(classes, live)
    cuts = met.where("doc_id > first").select("doc_id", "tx", "low", "high")
    wanted = met.where("doc_id = first and n > 1").groupBy("doc_id", "tx").agg(
        F.collect_list(F.struct("anchor", "at", "low", "high")).alias("ranges")
    )
    held = texts.join(wanted, ["doc_id", "tx"]).dropDuplicates(["doc_id", "tx"]).select("doc_id", "tx", "text", "ranges")
    rows = begin = settle(_contexts(held, least), "ranges")
    while True:
        # Pieces of a text with equal words are one, whatever else differs.
        head = F.struct("doc_id", "tx", "at", "left", "right")
        pivots = rows.groupBy("g").agg(F.min(head).alias("p"), F.max("doc_id").alias("high")).where("p.doc_id < high")
        pivots = settle(pivots.select("g", "p.*").toDF("g", "first", "ftx", "fat", "fleft", "fright"), "pivots")
        if not pivots.limit(1).count():
            return cuts
        # A hot seed's rows meet one row here; Spark splits such a join between two plain tables.
        pairs = rows.join(pivots, "g").where("not (doc_id = first and tx = ftx and at = fat)")
        pairs = pairs.select(*rows.columns, "first", "fleft", "fright")
        found = settle(_extend(pairs, least), "extended")
        discard(pivots, *([begin] if rows is begin else []))
        cuts = cuts.union(found.where("cut").selectExpr("doc_id", "tx", "at + low", "at + high"))
        rows = found.where("not cut").drop("cut")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: int = SEED) -> DataFrame:
    """doc_id, tx (a hash of the text), n_words, cuts: array<struct<low, high>>, the first and last starts of windows that a
    document with a smaller id holds too. Only rows with such windows, once for equal (doc_id, text)."""
    texts = _texts(docs, id_col, text_col)
    signed = settle(_signed(texts, least, seed), "signed")
    able = signed.where((F.col("n_words") >= least) & F.col("doc_id").isNotNull())
    reps = able.groupBy("c1", "c2").agg(F.min(F.struct("doc_id", "tx", "ranges")).alias("r"))
    reps = settle(reps.select("c1", "c2", "r.*"), "representatives")
    parts = _seeded(texts, reps, least).groupBy("doc_id", "tx").agg(F.collect_set(F.struct("low", "high")).alias("cuts"))
    named = reps.select("c1", "c2", F.col("doc_id").alias("first"), F.col("tx").alias("rtx"))
    whole = F.array(F.struct(F.lit(0).alias("low"), (F.col("n_words") - least).cast("int").alias("high")))
    met = able.drop("ranges").join(named, ["c1", "c2"])
    copies = met.where("doc_id > first").select("doc_id", "tx", "n_words", whole.alias("cuts"))
    own = met.where("doc_id = first").select("doc_id", "tx", "n_words", "rtx")
    own = own.join(parts.withColumnRenamed("tx", "rtx"), ["doc_id", "rtx"]).select("doc_id", "tx", "n_words", "cuts")
    return copies.union(own).dropDuplicates(["doc_id", "tx"])


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return text_rows(docs, id_col, text_col).select("doc_id", F.xxhash64("text").alias("tx"), "text")


def _clean(least: int):
    @F.arrow_udf("struct<text: string, n_words: bigint, n_removed: bigint>")
    def clean(text: pa.Array, cuts: pa.Array) -> pa.Array:
        kept, n_words, n_removed = [], [], []
        for body, spans in zip(text.cast(pa.binary()).to_pylist(), cuts.to_pylist(), strict=True):
            words = (body or b"").split()
            n_words.append(len(words))
            if spans:
                gone = np.zeros(len(words) + 1, np.int64)
                np.add.at(gone, [s["low"] for s in spans], 1)
                np.add.at(gone, [s["high"] + least for s in spans], -1)
                words = [words[k] for k in np.flatnonzero(np.cumsum(gone)[:-1] == 0)]
            n_removed.append(n_words[-1] - len(words))
            kept.append(b" ".join(words))
        return pa.StructArray.from_arrays(
            [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64())],
            names=["text", "n_words", "n_removed"],
        )

    return clean


def dedup_substrings(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = LEAST, seed: int = SEED, result: str = "deduped"
) -> DataFrame:
    """`docs` with a struct column `result`: text (the words that stay, joined by one space), n_words, n_removed.

    Words are `[^\\x20\\x09-\\x0D]+`, unchanged. A word goes if a window of `least` words covers it whose words also start
    in a row with a smaller id; windows are judged on the input. Repeats within a row, or between rows that repeat an id,
    remove nothing; such rows are judged each on its own. A null, empty or blank text has no words. A row without an id
    loses nothing and counts for no window. `result` replaces a column of that name; all others pass through, whatever
    their names. An empty table gives an empty result.
    """
    found = settle(repeated_passages(docs, id_col, text_col, least, seed), "passages")
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns])
    text = F.col(f"row.`{text_col}`").cast("string")
    packed = docs.select(row.alias("row")).select("row", F.col(f"row.`{id_col}`").cast("long").alias("doc_id"), F.xxhash64(text).alias("tx"))
    joined = packed.join(found.select("doc_id", "tx", "cuts"), ["doc_id", "tx"], "left")
    kept = [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c != result]
    return joined.withColumn("clean", _clean(least)(text, F.col("cuts"))).select(*kept, F.col("clean").alias(result))


#: DuckDB SQL of op12.
SQL = r"""
with words as (
  select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as w from documents),
places as (select doc_id, w, unnest(range(1, len(w) + 1)) as i from words),
starts as (
  select doc_id, i, w[i] as word,
    case when i + 49 <= len(w) then md5(array_to_string(list_slice(w, i, i + 49), ' ')) end as win from places),
firsts as (select win, min(doc_id) as first from starts where win is not null group by win),
marked as (select s.doc_id, i, word, coalesce(first < s.doc_id, false) as again from starts s left join firsts using (win)),
cut as (
  select doc_id, i, word, bool_or(again) over (partition by doc_id order by i rows between 49 preceding and current row) as gone
  from marked)
select d.doc_id, count(i) as n_words, count(i) filter (where gone) as n_removed,
  sha256(coalesce(string_agg(word, ' ' order by i) filter (where not gone), '')) as kept_sha256
from documents d left join cut using (doc_id) group by d.doc_id
"""
