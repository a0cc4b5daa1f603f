"""Lines that repeat across documents, found with two Bloom filters.

1. Every task adds the hashes of its documents' lines to two Bloom filters: "seen once" and, for hashes that were there
   already, "seen twice". Filters of two tasks merge as once = a | b, twice = A | B | (a & b): a line that both tasks
   saw has all its bits in a and in b. They are merged in segments, each streamed through one task.
2. Lines whose hash is in the merged "twice" filter are suspected; only these shuffle, as SHA-256 digests. The filter
   has no false negatives, so no repeat is lost; false suspects have one document and fall out.
3. Of a confirmed key the smallest doc_id is the first occurrence; the other documents get the keys to drop.

The filter is sized by the counted lines up to `MAX_BITS`; beyond that it passes more false suspects, never less repeats.
Only this filter is broadcast.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docstrata.llm.shared import packed, settle, text_rows, unpacked

LEAST_CHARS = 10
BITS_PER_LINE = 12
MAX_BITS = 1 << 28  # 32 MiB
SEGMENT_BYTES = 1 << 14
PROBES = 3
SLICE_ROWS = 512


def line_key(line: bytes) -> bytes:
    """The line without `[\\x20\\x09-\\x0D]` at its ends, A-Z lower-cased."""
    return line.strip(b" \t\n\x0b\x0c\r").lower()


def counts(key: bytes, least_chars: int) -> bool:
    """Whether a key is long enough, in code points."""
    return len(key) >= least_chars and (key.isascii() or len(key.decode()) >= least_chars)


def _long_keys(text: bytes, least_chars: int) -> set[bytes]:
    return {k for k in map(line_key, text.split(b"\n")) if counts(k, least_chars)}


def _texts(column: pa.Array) -> list[bytes | None]:
    return column.cast(pa.binary()).to_pylist()


def _slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Some rows at a time, so that no task holds the lines of a whole batch."""
    for batch in batches:
        for k in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(k, SLICE_ROWS)


class Bloom:
    """A Bloom filter of a power of two of bits over 64-bit hashes."""

    def __init__(self, n_bits: int, data: bytes | None = None):
        self.mask = np.uint64(n_bits - 1)
        self.bytes = np.frombuffer(data, np.uint8) if data else np.zeros(n_bits // 8, np.uint8)

    def places(self, hashes: np.ndarray, probe: int) -> np.ndarray:
        step = (hashes >> np.uint64(32)) | np.uint64(1)
        return (hashes + np.uint64(probe) * step) & self.mask

    def add(self, hashes: np.ndarray) -> None:
        for probe in range(PROBES):
            at = self.places(hashes, probe)
            np.bitwise_or.at(self.bytes, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def holds(self, hashes: np.ndarray) -> np.ndarray:
        """Whether each hash may be there. Most are not, and their first bit says so: the next one is read for the rest."""
        left = np.arange(len(hashes))
        for probe in range(PROBES):
            at = self.places(hashes[left], probe)
            left = left[(self.bytes[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1]
        held = np.zeros(len(hashes), dtype=bool)
        held[left] = True
        return held


def filter_bits(n_lines: int, most: int = MAX_BITS) -> int:
    return min(most, max(SEGMENT_BYTES * 8, 1 << (BITS_PER_LINE * max(n_lines, 1) - 1).bit_length()))


def _hashes(keys) -> np.ndarray:
    return np.fromiter((xxhash.xxh3_64_intdigest(k) for k in keys), np.uint64)


def _task_filters(texts: DataFrame, n_bits: int, least_chars: int) -> DataFrame:
    """The non-empty segments of each task's two filters."""

    def fill(batches):
        once, twice = Bloom(n_bits), Bloom(n_bits)
        for batch in _slices(batches):
            keys = [k for text in _texts(batch.column(1)) if text for k in _long_keys(text, least_chars)]
            found, times = np.unique(_hashes(keys), return_counts=True)
            twice.add(found[(times > 1) | once.holds(found)])
            once.add(found)
        a, b = once.bytes.reshape(-1, SEGMENT_BYTES), twice.bytes.reshape(-1, SEGMENT_BYTES)
        for k in np.flatnonzero(a.any(axis=1)):
            row = [pa.array([k], pa.int32()), pa.array([a[k].tobytes()]), pa.array([b[k].tobytes()])]
            yield pa.record_batch(row, names=["segment", "once", "twice"])

    return texts.where("doc_id is not null").mapInArrow(fill, "segment int, once binary, twice binary")


def _merged(parts: DataFrame, n_segments: int) -> DataFrame:
    """(segment, twice) of all tasks. A task holds the segments dealt to it, not the rows."""

    def merge(batches):
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for k, once, twice in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                a, b = np.frombuffer(once, np.uint8), np.frombuffer(twice, np.uint8)
                if k in held:
                    held[k] = held[k][0] | a, held[k][1] | b | (held[k][0] & a)
                else:
                    held[k] = a, b
        for k, (_, b) in held.items():
            yield pa.record_batch([pa.array([k], pa.int32()), pa.array([b.tobytes()])], names=["segment", "twice"])

    return parts.repartition(min(n_segments, 512), "segment").mapInArrow(merge, "segment int, twice binary")


def repeated_filter(texts: DataFrame, least_chars: int = LEAST_CHARS, most_bits: int = MAX_BITS) -> Bloom:
    """The merged "seen twice" filter of the rows (doc_id, text)."""
    breaks = F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit("")))
    n_lines = texts.select(F.sum(breaks + 1)).first()[0] or 0
    n_bits = filter_bits(n_lines, most_bits)
    whole = Bloom(n_bits)
    segments = whole.bytes.reshape(-1, SEGMENT_BYTES)
    # At most MAX_BITS / 8 bytes in all, whatever the input.
    for k, twice in _merged(_task_filters(texts, n_bits, least_chars), len(segments)).collect():
        segments[k] = np.frombuffer(twice, np.uint8)
    return whole


def _suspects(texts: DataFrame, known: Bloom, least_chars: int) -> DataFrame:
    """(key, doc_id): SHA-256 of each suspected key of a document, once a document."""
    shipped = texts.sparkSession.sparkContext.broadcast(known.bytes.tobytes())
    n_bits = len(known.bytes) * 8

    def find(batches):
        twice = Bloom(n_bits, shipped.value)
        for batch in _slices(batches):
            digests, ids = [], []
            for doc_id, text in zip(batch.column(0).to_pylist(), _texts(batch.column(1)), strict=True):
                keys = list(_long_keys(text, least_chars)) if text else []
                if keys:
                    hits = [k for k, hit in zip(keys, twice.holds(_hashes(keys)), strict=True) if hit]
                    digests += [hashlib.sha256(k).digest() for k in hits]
                    ids += [doc_id] * len(hits)
            yield pa.record_batch([pa.array(digests, pa.binary()), pa.array(ids, pa.int64())], names=["key", "doc_id"])

    return texts.where("doc_id is not null").mapInArrow(find, "key binary, doc_id long")


def _clean(least_chars: int):
    kind = pa.struct([("text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])

    def some(rows: pa.RecordBatch) -> pa.Array:
        kept, n_lines, n_dropped = [], [], []
        for body, drop in zip(_texts(rows.column(0)), rows.column(1).to_pylist(), strict=True):
            lines = (body or b"").split(b"\n")
            n_lines.append(len(lines))
            if drop:
                drop = set(drop)
                lines = [x for x in lines if not (counts(k := line_key(x), least_chars) and hashlib.sha256(k).digest() in drop)]
                body = b"\n".join(lines)
            n_dropped.append(n_lines[-1] - len(lines))
            kept.append(body or b"")
        columns = [pa.array(kept, pa.binary()).cast(pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
        return pa.StructArray.from_arrays(columns, fields=list(kind))

    @F.arrow_udf("struct<text: string, n_lines: bigint, n_dropped: bigint>")
    def clean(text: pa.Array, keys: pa.Array) -> pa.Array:
        rows = pa.RecordBatch.from_arrays([text, keys], names=["text", "keys"])
        return pa.concat_arrays([pa.array([], kind), *map(some, _slices([rows]))])

    return clean


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    least_chars: int = LEAST_CHARS,
    result: str = "deduped",
) -> DataFrame:
    """`docs` with a struct column `result`: text (the lines that stay, joined by \\n), n_lines, n_dropped.

    Keys of at least `least_chars` code points that occur in two documents lose all their lines except in the smallest
    doc_id that holds them; there also repeated lines stay. A null or empty text is one empty line. Rows that repeat an
    id are one document. A row without an id is left as it is and counts for no key. `result` replaces a column of that name, all others pass through,
    whatever their names; an empty table gives an empty result.
    """
    texts = text_rows(docs, id_col, text_col)
    suspects = settle(_suspects(texts, repeated_filter(texts, least_chars), least_chars), "suspects")
    repeated = suspects.groupBy("key").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last")
    # A hot key's rows meet one row here. Spark splits such a join between two plain tables, so the sums are one.
    repeated = settle(repeated.select("key", "first"), "repeated")
    drops = (
        suspects.join(repeated, "key").where("doc_id > first")
        .groupBy(F.col("doc_id").alias("__doc")).agg(F.collect_set("key").alias("__keys"))
    )
    joined = packed(docs).join(drops, F.col(f"row.`{id_col}`").cast("long") == F.col("__doc"), "left")
    cleaned = joined.withColumn("clean", _clean(least_chars)(F.col(f"row.`{text_col}`").cast("string"), F.col("__keys")))
    kept = unpacked(cleaned, [c for c in docs.columns if c != result])
    return cleaned.select(*kept, F.col("clean").alias(result))


#: DuckDB SQL of op4.
SQL = r"""
with l as (
  select doc_id, unnest(lines) as line, generate_subscripts(lines, 1) as i
  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as lines from documents)),
k as (
  select *, translate(regexp_replace(line, '^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$', '', 'g'),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key from l),
r as (select key, min(doc_id) as first from k where length(key) >= 10 group by key having count(distinct doc_id) > 1),
d as (select k.*, r.first is not null and k.doc_id <> r.first as dropped from k left join r on k.key = r.key)
select doc_id, count(*) as n_lines, count(*) filter (where dropped) as n_dropped,
  sha256(coalesce(string_agg(line, chr(10) order by i) filter (where not dropped), '')) as kept_sha256
from d group by doc_id
"""
