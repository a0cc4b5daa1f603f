"""Benchmark decontamination by template canonicalisation.

Benchmark items and documents become token sequences in which numbers, names and units are typed placeholders. Windows
of such templates are hash-joined, so that an item is found when its words stand but its parameters are others. The
values in the slots of one occurrence then have to be consistent: a value of the item stands for one value of the
document wherever it comes. Windows in which it stands for another one than in most of them do not count.

Beside the templates go plain windows of all tokens, case-folded and without placeholders, of items of any length: an
exact copy is found whatever the item consists of and however it is capitalised. So is a part of an item, copied word by
word, that is too short for the share: a run of `RUN_LEAST` windows, which are 20 tokens. Items of under `LEAST_PLAIN`
tokens say nothing within a longer text; for them the document has to be the item.

A Bloom filter of the items' windows, of bounded size, goes to the tasks that read the documents; only windows that
pass it shuffle, and they are joined exactly. It sorts out rows only: whatever its size, the result is the same.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.line_dedup import SEGMENT_BYTES, Bloom, _merged, filter_bits
from docstrata.llm.shared import combine, hash_runs, pieces, settle, text_bytes, without

WINDOW = 8
LEAST_TOKENS = 5  # a shorter item has no template, only a plain window
LEAST_PLAIN = 4
RUN_LEAST = 13
SHARE_LEAST = 0.5

#: Words that are a unit after a number.
UNITS = (
    "percent pct mm cm m km inch inches ft feet foot yard yards mile miles mg g gram grams kg kilogram kilograms ton tons "
    "ounce ounces pound pounds lb lbs ml l liter liters litre litres gallon gallons second seconds sec minute minutes min "
    "hour hours h day days week weeks month months year years dollar dollars cent cents euro euros eur usd degree degrees "
    "celsius fahrenheit watt watts kw volt volts mph kmh hz mb gb tb apples oranges marbles books coins"
).split()

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
_MARKS = np.array([0, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3], dtype=np.uint64)

_TOKEN = np.zeros(256, dtype=bool)
_TOKEN[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_DIGIT = np.zeros(256, dtype=bool)
_DIGIT[48:58] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[[10, 33, 46, 63]] = True  # \n ! . ?


def _unit_hashes() -> np.ndarray:
    column = next(pieces(pa.array(UNITS)))[1]
    data, offsets = text_bytes(column)
    return np.unique(hash_runs(data, _TOKEN[data], offsets)[1])


_UNITS = _unit_hashes()


def template(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(bounds, canonical, kinds, values) of the tokens of a slice from `pieces`.

    Tokens are runs of ASCII letters and digits and of other characters from U+0080. A run that begins with a digit is
    a number, and runs joined to it by one of `. , :` are part of it. A unit is a word of `UNITS` right after a number.
    A name is a capitalised token that begins no sentence, with those that follow it after one space. canonical is the
    token's hash or the mark of its kind, values the hash of what stands there.
    """
    data, offsets = text_bytes(column)
    starts, values = hash_runs(data, _TOKEN[data], offsets)
    n = len(starts)
    if not n:
        return np.zeros(len(offsets), dtype=np.int64), values, np.zeros(0, dtype=np.int8), values
    ends = starts + np.add.reduceat(_TOKEN[data].astype(np.int64), starts)
    row = np.searchsorted(offsets, starts, "right") - 1
    linked = np.zeros(n, dtype=bool)  # to the token before, in the same row
    linked[1:] = row[1:] == row[:-1]
    gap = np.zeros(n, dtype=np.int64)
    gap[1:] = starts[1:] - ends[:-1]
    before = data[np.maximum(starts - 1, 0)]
    stops = np.concatenate([[0], np.cumsum(_STOP[data])])
    opens = np.ones(n, dtype=bool)
    opens[1:] = ~linked[1:] | (stops[starts[1:]] > stops[ends[:-1]])

    number = _DIGIT[data[starts]]
    head = data[starts]
    second = data[np.minimum(starts + 1, len(data) - 1)]
    capital = ((head >= 65) & (head <= 90)) | ((head == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    name = capital & ~opens
    unit = np.zeros(n, dtype=bool)
    unit[1:] = number[:-1] & linked[1:] & np.isin(values[1:], _UNITS) & ~number[1:]
    kinds = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, LITERAL))).astype(np.int8)

    same = np.zeros(n, dtype=bool)
    same[1:] = (kinds[1:] == kinds[:-1]) & linked[1:] & (gap[1:] == 1)
    joined = same & (((kinds == NUMBER) & np.isin(before, [44, 46, 58])) | ((kinds == NAME) & (before == 32)))
    keep = np.flatnonzero(~joined)
    # The value of a joined run depends on the order of its parts.
    run = np.cumsum(~joined) - 1
    depth = (np.arange(n) - keep[run]).astype(np.uint64)
    merged = np.add.reduceat(values * (depth * np.uint64(2) + np.uint64(1)), keep)
    kinds = kinds[keep]
    canonical = np.where(kinds == LITERAL, merged, _MARKS[kinds])
    return np.searchsorted(row[keep], np.arange(len(offsets))), canonical, kinds, merged


def windows(column: pa.Array, lengths: list[int]):
    """For every slice: (first row, bounds, {length: (starts, hashes)}, kinds, values). Windows lie in one row and at
    least half of their tokens are literal."""
    for begin, part in pieces(column):
        bounds, canonical, kinds, values = template(part)
        ends = np.repeat(bounds[1:], np.diff(bounds))
        literal = np.concatenate([[0], np.cumsum(kinds == LITERAL)])
        found = {}
        for length in lengths:
            n = len(canonical) - length + 1
            if n <= 0:
                continue
            at = np.arange(n)
            fits = (at + length <= ends[:n]) & (2 * (literal[at + length] - literal[at]) >= length)
            at = at[fits]
            found[length] = at, combine([canonical[at + j] for j in range(length)], seed=20 + length)
        yield begin, bounds, found, kinds, values


def plain_windows(column: pa.Array, lengths: list[int]):
    """For every slice: (first row, bounds, {length: (starts, hashes)}) of the case-folded tokens. Windows lie in one row; one
    of under `LEAST_PLAIN` tokens is a whole row."""
    for begin, part in pieces(pc.utf8_lower(column.cast(pa.large_string()))):
        data, offsets = text_bytes(part)
        starts, values = hash_runs(data, _TOKEN[data], offsets)
        bounds = np.searchsorted(starts, offsets)
        begins, ends = (np.repeat(x, np.diff(bounds)) for x in (bounds[:-1], bounds[1:]))
        found = {}
        for length in lengths:
            n = len(values) - length + 1
            if n > 0:
                at = np.arange(n)
                fits = at + length <= ends[:n]
                if length < LEAST_PLAIN:
                    fits &= (at == begins[:n]) & (at + length == ends[:n])
                at = at[fits]
                found[length] = at, combine([values[at + j] for j in range(length)], seed=60 + length)
        yield begin, bounds, found


def every_window(column: pa.Array, lengths: list[int], plain_lengths: list[int]):
    """(is plain, first row, bounds, windows, kinds, values) of every slice; plain windows have no slots."""
    if lengths:
        for begin, bounds, found, kinds, values in windows(column, lengths):
            yield False, begin, bounds, found, kinds, values
    if plain_lengths:
        for begin, bounds, found in plain_windows(column, plain_lengths):
            yield True, begin, bounds, found, None, None


_HIT = "window long, id long, place int, slots array<long>"


def _rows(ids: list, starts, hashes, length: int, row_of, bounds, kinds, values) -> pa.RecordBatch:
    slots = [[]] * len(starts) if kinds is None else []
    for at in starts if kinds is not None else ():
        inside = np.flatnonzero(kinds[at : at + length]) + at
        # The kind is part of the value.
        slots.append((values[inside] ^ _MARKS[kinds[inside]]).view(np.int64))
    return pa.record_batch(
        [
            pa.array(hashes.view(np.int64)), pa.array([ids[r] for r in row_of], pa.int64()),
            pa.array((starts - bounds[row_of]).astype(np.int32)), pa.array(slots, pa.list_(pa.int64())),
        ],
        names=["window", "id", "place", "slots"],
    )


def _item_windows(items: DataFrame) -> DataFrame:
    """Windows of the items (id, text), with `n`, the tokens of the window: `WINDOW`, or the whole shorter item; `plain`
    tells those of all tokens from those of the template."""

    def cut(batches):
        lengths = list(range(LEAST_TOKENS, WINDOW + 1))
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for plain, begin, bounds, found, kinds, values in every_window(batch.column(1), lengths, list(range(1, WINDOW + 1))):
                for length, (starts, hashes) in found.items():
                    row = np.searchsorted(bounds, starts, "right") - 1
                    size = (bounds[1:] - bounds[:-1])[row]
                    take = (size >= WINDOW) if length == WINDOW else (size == length)
                    if take.any():
                        out = _rows(ids[begin:], starts[take], hashes[take], length, row[take], bounds, kinds, values)
                        out = out.append_column("n", pa.array(np.full(out.num_rows, length, np.int32)))
                        yield out.append_column("plain", pa.array(np.full(out.num_rows, plain)))

    return items.mapInArrow(cut, f"{_HIT}, n int, plain boolean")


def _window_filter(items: DataFrame) -> Bloom:
    n_bits = filter_bits(items.count())

    def fill(batches):
        bloom = Bloom(n_bits)
        for batch in batches:
            bloom.add(batch.column(0).to_numpy().view(np.uint64))
        parts = bloom.bytes.reshape(-1, SEGMENT_BYTES)
        for k in np.flatnonzero(parts.any(axis=1)):
            bits = pa.array([parts[k].tobytes()])
            yield pa.record_batch([pa.array([k], pa.int32()), bits, bits], names=["segment", "once", "twice"])

    whole = Bloom(n_bits)
    segments = whole.bytes.reshape(-1, SEGMENT_BYTES)
    task_bits = items.select("window").mapInArrow(fill, "segment int, once binary, twice binary")
    for k, bits in _merged(task_bits, len(segments)).collect():  # at most MAX_BITS / 8 bytes
        segments[k] = np.frombuffer(bits, np.uint8)
    return whole


def _suspected(texts: DataFrame, known: Bloom, lengths: list[int], plain_lengths: list[int]) -> DataFrame:
    shipped = texts.sparkSession.sparkContext.broadcast(known.bytes.tobytes())
    n_bits = len(known.bytes) * 8

    def find(batches):
        bloom = Bloom(n_bits, shipped.value)
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for _, begin, bounds, found, kinds, values in every_window(batch.column(1), lengths, plain_lengths):
                for length, (starts, hashes) in found.items():
                    hit = bloom.holds(hashes)
                    if hit.any():
                        row = np.searchsorted(bounds, starts[hit], "right") - 1
                        yield _rows(ids[begin:], starts[hit], hashes[hit], length, row, bounds, kinds, values)

    return texts.mapInArrow(find, _HIT)


def _occurrence(windows: pa.Array) -> pa.Array:
    """Of the windows (place, slots) of an occurrence: the places of those whose slots agree, whether all their values are
    the item's own, and the longest run of places."""
    out = []
    for rows in windows.to_pylist():
        stands = defaultdict(Counter)
        for row in rows:
            for slot in row["slots"]:
                stands[slot["item_slots"]][slot["slots"]] += 1
        for_ = {own: min(c, key=lambda value: (-c[value], value)) for own, c in stands.items()}
        kept = [r for r in rows if all(for_[x["item_slots"]] == x["slots"] for x in r["slots"])]
        places, run, longest = sorted({r["place"] for r in kept}), 0, 0
        for k, place in enumerate(places):
            run = run + 1 if k and place == places[k - 1] + 1 else 1
            longest = max(longest, run)
        own = all(x["item_slots"] == x["slots"] for r in kept for x in r["slots"])
        out.append({"places": places, "own": own, "longest": longest})
    return pa.array(out, pa.struct([("places", pa.list_(pa.int32())), ("own", pa.bool_()), ("longest", pa.int32())]))


def find_leaks(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    share_least: float = SHARE_LEAST,
) -> DataFrame:
    """doc_id, item_id, n_windows (of the item), n_found, share, verbatim: one row for each document and item where at
    least `share_least` of the item's template windows stand in the document with consistent slots, or of its plain
    windows, or a run of `RUN_LEAST` plain windows does; the figures are those of the templates where they reach the share,
    else those of the plain windows.

    verbatim: all slot values are the item's own, or all of its plain windows stand there. Windows have 8 tokens, or the whole item where it has fewer; items under
    5 canonical tokens and windows with more placeholders than words are looked for as plain windows only. Rows with a null id are
    left out; null and empty texts hold nothing; rows that repeat an id count as one document or item. Other columns
    are ignored; empty tables give an empty result.
    """
    asked = items.select(F.col(item_id_col).cast("long").alias("id"), F.col(item_text_col).cast("string").alias("text"))
    cut = settle(_item_windows(asked.where("id is not null").dropDuplicates()), "item-windows")
    sizes = cut.select("plain", "n").distinct().collect()  # at most 12 rows
    lengths, plain_lengths = (sorted(r.n for r in sizes if r.plain == kind) for kind in (False, True))
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hits = _suspected(texts.where("id is not null"), _window_filter(cut), lengths, plain_lengths)
    totals = cut.groupBy(F.col("id").alias("item_id"), "plain").agg(F.countDistinct("place").alias("n_windows"))
    theirs = cut.select("window", "plain", F.col("id").alias("item_id"), F.col("place").alias("item_place"), F.col("slots").alias("item_slots"))
    met = hits.join(theirs, "window").select(
        F.col("id").alias("doc_id"), "item_id", "plain", "item_place", (F.col("place") - F.col("item_place")).alias("shift"),
        F.arrays_zip("item_slots", "slots").alias("slots"),
    )
    # An occurrence of the item lies on one shift; it has as many rows as the item has windows.
    rows = F.collect_set(F.struct(F.col("item_place").alias("place"), "slots"))
    seen = met.groupBy("doc_id", "item_id", "plain", "shift").agg(rows.alias("rows"))
    judged = F.arrow_udf(_occurrence, "struct<places: array<int>, own: boolean, longest: int>")
    kept = seen.select("doc_id", "item_id", "plain", judged("rows").alias("o"))
    found = kept.groupBy("doc_id", "item_id", "plain").agg(
        F.size(F.array_distinct(F.flatten(F.collect_set("o.places")))).cast("long").alias("n_found"),
        F.bool_and("o.own").alias("own"), F.max("o.longest").alias("longest"),
    )
    share = F.col("n_found") / F.col("n_windows")
    enough = (share >= share_least) | (F.col("plain") & (F.col("longest") >= RUN_LEAST))
    reached = found.join(totals, ["item_id", "plain"]).where(enough)
    verbatim = F.when(F.col("plain"), F.col("n_found") == F.col("n_windows")).otherwise(F.col("own"))
    figures = F.struct("n_windows", "n_found", F.round(share, 6).alias("share"), verbatim.alias("verbatim"))
    return reached.groupBy("doc_id", "item_id").agg(F.min_by(figures, "plain").alias("f")).select("doc_id", "item_id", "f.*")


def drop_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", **options) -> DataFrame:
    """The rows of `docs`, all columns, whatever their names, without the documents that hold an item. Rows with a null id
    stay."""
    leaks = find_leaks(docs, items, id_col, **options).select("doc_id").distinct()
    return without(docs, id_col, leaks)
