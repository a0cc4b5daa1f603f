"""Helpers shared by the operators: written intermediate tables and word hashing inside Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.frames import key_filter  # noqa: F401, also for the operators
from docstrata.session import fresh_dir

#: Bytes of text hashed at a time; bounds the arrays a task holds, whatever the batch size. A longer text is a piece
#: of its own.
PIECE_BYTES = 1 << 20

_MASK = (1 << 64) - 1
_U64 = np.uint64


def settle(df: DataFrame, label: str) -> DataFrame:
    """Writes `df` as Parquet below the cluster's shared folder and reads it back, which cuts its lineage."""
    path = fresh_dir(df.sparkSession, label)
    df.write.parquet(path)
    table = df.sparkSession.read.schema(df.schema).parquet(path)
    table.settled_at = path
    return table


def discard(*tables: DataFrame) -> None:
    """Deletes tables of `settle` that nothing will read any more."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.settled_at)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def text_rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id (as a long) and the text, whatever other columns there are."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def packed(df: DataFrame) -> DataFrame:
    """All columns of `df` as one struct column `row`, so that none of them can clash with a column of ours."""
    return df.select(F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))


def unpacked(df: DataFrame, columns: list[str]) -> list[Column]:
    return [F.col(f"row.`{c}`").alias(c) for c in columns]


def without(docs: DataFrame, id_col: str, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is not among `ids(doc_id)`."""
    rows = packed(docs)
    left = rows.join(ids.select("doc_id"), F.col(f"row.`{id_col}`").cast("long") == F.col("doc_id"), "left_anti")
    return left.select(unpacked(left, docs.columns))


def _splitmix(seed: int, n: int) -> np.ndarray:
    out, state = [], seed
    for _ in range(n):
        state = (state + 0x9E3779B97F4A7C15) & _MASK
        z = ((state ^ (state >> 30)) * 0xBF58476D1CE4E5B9) & _MASK
        z = ((z ^ (z >> 27)) * 0x94D049BB133111EB) & _MASK
        out.append((z ^ (z >> 31)) & _MASK)
    return np.array(out, dtype=np.uint64)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit; works in place."""
    x ^= x >> _U64(33)
    x *= _U64(0xFF51AFD7ED558CCD)
    x ^= x >> _U64(33)
    x *= _U64(0xC4CEB9FE1A85EC53)
    x ^= x >> _U64(33)
    return x


_BYTES = _splitmix(1, 256)
_POSITION = _splitmix(2, 64) | _U64(1)
_STEP = _U64(0x9FB21C651E98DF25)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(column: pa.Array, limit: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, slice) of a string column, each slice of at most `limit` bytes or of one row."""
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    begin = 0
    while begin < len(column):
        end = int(np.searchsorted(offsets, offsets[begin] + limit, "right")) - 1
        end = min(max(end, begin + 1), len(column))
        yield begin, column.slice(begin, end - begin)
        begin = end


def word_hashes(column: pa.Array, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, hashes): 64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased if `fold`, of a slice from
    `pieces`; the words of row r are hashes[bounds[r]:bounds[r + 1]]."""
    data, offsets = text_bytes(column)
    starts, hashes = hash_runs(data, ~_SPACE[data], offsets, fold)
    return np.searchsorted(starts, offsets), hashes


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a slice from `pieces`; row r is bytes[offsets[r]:offsets[r + 1]]."""
    offsets = np.frombuffer(column.buffers()[1], dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if offsets[-1] == offsets[0]:
        return np.zeros(0, dtype=np.uint8), np.zeros(len(column) + 1, dtype=np.int64)
    return np.frombuffer(column.buffers()[2], dtype=np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def hash_runs(data: np.ndarray, inside: np.ndarray, offsets: np.ndarray, fold: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(starts, hashes) of the runs of bytes that are `inside`, A-Z lower-cased if `fold`; a run ends with its row."""
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    heads = offsets[:-1][offsets[:-1] < offsets[1:]]
    first[heads] = inside[heads]
    starts = np.flatnonzero(first)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    place = np.cumsum(first) - 1
    np.maximum(place, 0, out=place)
    place = np.arange(len(data), dtype=np.int64) - starts[place]
    np.maximum(place, 0, out=place)
    longest = int(place.max()) + 1
    powers = _POSITION if longest <= len(_POSITION) else _long_powers(longest)
    parts = _BYTES[_LOWER[data] if fold else data]
    parts *= powers[place]
    parts[~inside] = 0
    return starts, mix64(np.add.reduceat(parts, starts))


def _long_powers(n: int) -> np.ndarray:
    tail = np.full(n - len(_POSITION), _STEP, dtype=np.uint64)
    tail[0] *= _POSITION[-1]
    return np.concatenate([_POSITION, np.cumprod(tail, dtype=np.uint64)])


def combine(parts: list[np.ndarray], seed: int = 3) -> np.ndarray:
    """Order-aware hash of equally long hash arrays."""
    factors = _splitmix(seed, len(parts)) | _U64(1)
    total = np.full(len(parts[0]), _U64(seed), dtype=np.uint64)
    for part, factor in zip(parts, factors, strict=True):
        total += part * factor
    return mix64(total)
