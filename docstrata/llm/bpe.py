"""Byte-pair encoding and decoding with the vocabulary file of a public byte-level tokenizer.

The merges of a piece are found with a segment tree over the ranks of its adjacent pairs: the root holds the least rank
and, of equal ones, the leftmost pair; a merge changes the leaves of three pairs at most, each in logarithmic time,
until the root holds no rank. A piece of n bytes so takes O(n log n), however long it is. Short pieces need no tree: many
are the columns of one array and take their steps together.

Texts are split as the file says: special tokens first, then by the byte-level pattern. Pieces repeat, so each task
keeps the ids of those it has met, in a table of bounded size.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from functools import cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Fixed value: the pattern of byte-level pre-tokenization.
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
CACHE_PIECES = 100_000  # of each of two generations, and those of one slice of texts
SHORT_BYTES = 64
SLICE_ROWS = 256
FOREST_ROWS = 8_192
_NONE = 1 << 60
_IDLE = np.int64(1 << 60)


class RankTree:
    """Least (rank, place) of an array of ranks, with point updates."""

    def __init__(self, ranks: list[int]):
        self.size = size = 1 << max(len(ranks) - 1, 0).bit_length()
        # A node is rank * 2^32 + place: the least node is the leftmost of the least rank.
        leaves = [(r << 32) + i for i, r in enumerate(ranks)]
        self.nodes = nodes = [_NONE << 32] * size + leaves + [_NONE << 32] * (size - len(leaves))
        for k in range(size - 1, 0, -1):
            a, b = nodes[2 * k], nodes[2 * k + 1]
            nodes[k] = a if a < b else b

    def set(self, place: int, rank: int) -> None:
        nodes, k = self.nodes, self.size + place
        nodes[k] = (rank << 32) + place
        k >>= 1
        while k:
            a, b = nodes[2 * k], nodes[2 * k + 1]
            least = a if a < b else b
            if nodes[k] == least:
                break
            nodes[k] = least
            k >>= 1

    def top(self) -> tuple[int, int]:
        return self.nodes[1] >> 32, self.nodes[1] & 0xFFFFFFFF


def merge(ids: list[int], pairs: dict[tuple[int, int], tuple[int, int]]) -> list[int]:
    """All merges of a piece. pairs: (left, right) -> (rank, merged id)."""
    n = len(ids)
    if n < 2:
        return ids
    none = (_NONE, 0)
    tree = RankTree([pairs.get(p, none)[0] for p in zip(ids, ids[1:], strict=False)])
    ids = list(ids)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    while True:
        rank, at = tree.top()
        if rank >= _NONE:
            break
        gone = after[at]
        ids[at] = pairs[ids[at], ids[gone]][1]
        ids[gone] = -1
        right = after[at] = after[gone]
        if gone < n - 1:
            tree.set(gone, _NONE)
        if right < n:
            before[right] = at
            tree.set(at, pairs.get((ids[at], ids[right]), none)[0])
        else:
            tree.set(at, _NONE)
        left = before[at]
        if left >= 0:
            tree.set(left, pairs.get((ids[left], ids[at]), none)[0])
    return [i for i in ids if i >= 0]


class PairTable:
    """Ranks of id pairs and the ids they merge to, as arrays."""

    def __init__(self, pairs: dict[tuple[int, int], tuple[int, int]], n_ids: int):
        self.n_ids = n_ids
        keys = np.array([a * n_ids + b for a, b in pairs], dtype=np.int64)
        ranks = np.array([rank for rank, _ in pairs.values()], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = np.append(keys[order], -1), ranks[order]
        self.merged = np.zeros(int(ranks.max(initial=-1)) + 1, dtype=np.int32)
        self.merged[ranks] = [merged for _, merged in pairs.values()]

    def leaves(self, left: np.ndarray, right: np.ndarray, place: np.ndarray) -> np.ndarray:
        """rank * 256 + place of the pairs, `_IDLE` where they do not merge."""
        wanted = left.astype(np.int64) * self.n_ids + right
        at = np.searchsorted(self.keys[:-1], wanted)
        found = self.keys[at] == wanted
        return np.where(found, (self.ranks[np.where(found, at, 0)] << 8) + place if len(self.ranks) else _IDLE, _IDLE)


def merge_forest(rows: list[bytes], start: np.ndarray, table: PairTable) -> list[list[int]]:
    """All merges of many pieces of at most `SHORT_BYTES` bytes, a merge a piece at each step. A piece is a column; `pairs`
    has rank and place of the pair that begins in each place, so a column's least entry is its next merge."""
    if not rows:
        return []
    lengths = np.array([len(r) for r in rows])
    place = np.arange(lengths.max())[:, None]
    inside = place < lengths
    ids = np.full((len(rows), len(place)), -1, dtype=np.int32)
    ids[inside.T] = start[np.frombuffer(b"".join(rows), dtype=np.uint8)]
    ids = np.ascontiguousarray(ids.T)
    pairs = np.full(ids.shape, _IDLE, dtype=np.int64)
    at, piece = np.nonzero(place < lengths - 1)
    pairs[at, piece] = table.leaves(ids[at, piece], ids[at + 1, piece], at)
    after = np.broadcast_to(place + 1, ids.shape).astype(np.int64)
    before = np.broadcast_to(place - 1, ids.shape).astype(np.int64)

    while True:
        least = pairs.min(axis=0)
        piece = np.flatnonzero(least < _IDLE)
        if not len(piece):
            break
        at, merged = least[piece] & 255, table.merged[least[piece] >> 8]
        gone, left = after[at, piece], before[at, piece]
        right = after[gone, piece]
        ids[at, piece], ids[gone, piece] = merged, -1
        after[at, piece] = right
        pairs[gone, piece] = pairs[at, piece] = _IDLE
        # The pairs with the neighbours change, where there are neighbours.
        has = right < lengths[piece]
        one, low, high = piece[has], at[has], right[has]
        before[high, one] = low
        pairs[low, one] = table.leaves(merged[has], ids[high, one], low)
        has = left >= 0
        one, low = piece[has], left[has]
        pairs[low, one] = table.leaves(ids[low, one], merged[has], low)
    ids = ids.T
    kept = ids >= 0
    values, ends = ids[kept].tolist(), np.cumsum(kept.sum(axis=1)).tolist()
    return [values[a:b] for a, b in zip([0, *ends], ends, strict=False)]


def byte_letters() -> list[str]:
    """The visible letter that stands for each byte in a byte-level vocabulary: printable Latin-1 characters stand for
    themselves, the others are numbered from U+0100."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Vocabulary, merges and special tokens of a byte-level BPE file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, form = spec["model"], spec["pre_tokenizer"]
        if model["type"] != "BPE" or form["type"] != "ByteLevel" or spec["normalizer"] or form["add_prefix_space"]:
            raise ValueError(f"{path} is no byte-level BPE file without a normalizer")
        vocab, letters = model["vocab"], byte_letters()
        value = {c: b for b, c in enumerate(letters)}
        self.bytes = {i: bytes(value[c] for c in token) for token, i in vocab.items()}
        self.start = [vocab[c] for c in letters]
        self.pairs = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair.split(" ") if isinstance(pair, str) else pair
            self.pairs[vocab[a], vocab[b]] = rank, vocab[a + b]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: token.encode() for token, i in self.special.items()}
        n_ids = max(self.bytes) + 1
        self.starts, self.table = np.array(self.start, dtype=np.int32), PairTable(self.pairs, n_ids)
        self.spelled = [self.bytes.get(i, b"") for i in range(n_ids)]
        self.spellings = pa.array(self.spelled, pa.binary())
        longest = sorted(self.special, key=len, reverse=True)
        self.cut = regex.compile("(" + "|".join(map(regex.escape, longest)) + ")") if longest else None
        self.find = regex.compile(PIECES).findall
        self.forget()

    def forget(self) -> None:
        """Empties the two generations of met pieces, each a piece's row of a table of ids: when the younger is full, it
        becomes the older one."""
        self.young: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.young_ids = self.old_ids = pa.array([], pa.list_(pa.int32()))

    def token_ids(self, texts: list[str]) -> pa.ListArray:
        """Token ids of each text."""
        pieces = [self._pieces(t) for t in texts]
        rows, ids = self._met(set(chain.from_iterable(pieces)))
        by_piece = ids.take(pa.array(map(rows.__getitem__, chain.from_iterable(pieces)), pa.int32()))
        ends = np.cumsum([0, *map(len, pieces)])
        return pa.ListArray.from_arrays(by_piece.offsets.take(pa.array(ends)), by_piece.values)

    def _pieces(self, text: str) -> list[str]:
        """The special tokens of a text, and the pieces of what is between them; no piece holds a special token."""
        if not self.cut:
            return self.find(text)
        parts = self.cut.split(text)
        return list(chain.from_iterable([part] if j % 2 else self.find(part) for j, part in enumerate(parts)))

    def encode_all(self, texts: list[str]) -> list[list[int]]:
        return self.token_ids(texts).to_pylist()

    def encode(self, text: str) -> list[int]:
        return self.encode_all([text])[0]

    def _met(self, pieces: set[str]) -> tuple[dict[str, int], pa.ListArray]:
        """(rows, ids): the ids of a given piece are ids[rows[piece]]. Short pieces are kept in the younger generation."""
        if len(self.young) >= CACHE_PIECES:
            self.old, self.old_ids = self.young, self.young_ids
            self.young, self.young_ids = {}, self.young_ids.slice(0, 0)
        unknown = pieces.difference(self.young)
        new = unknown.difference(self.old)
        known = list(unknown.difference(new))
        fresh = [(p, p.encode()) for p in new.difference(self.special)]
        fresh.sort(key=lambda x: len(x[1]))  # rows of like length share an array
        short = bisect_right(fresh, SHORT_BYTES, key=lambda x: len(x[1]))
        parts = [self.young_ids, self.old_ids.take(pa.array(map(self.old.__getitem__, known), pa.int32()))]
        for low in range(0, short, FOREST_ROWS):
            group = [b for _, b in fresh[low : min(low + FOREST_ROWS, short)]]
            parts.append(pa.array(merge_forest(group, self.starts, self.table), pa.list_(pa.int32())))
        self.young |= zip([*known, *(p for p, _ in fresh[:short])], count(len(self.young)))
        self.young_ids = pa.concat_arrays(parts)

        own = [*new.intersection(self.special), *(p for p, _ in fresh[short:])]
        if not own:
            return self.young, self.young_ids
        found = [[self.special[p]] if p in self.special else merge([self.start[c] for c in p.encode()], self.pairs) for p in own]
        ids = pa.concat_arrays([self.young_ids, pa.array(found, pa.list_(pa.int32()))])
        return self.young | dict(zip(own, count(len(self.young)))), ids

    def decode(self, ids: list[int]) -> str:
        """Bytes that are no UTF-8 become U+FFFD; an unknown id has no bytes."""
        try:
            parts = b"".join(map(self.spelled.__getitem__, ids))
        except IndexError:
            parts = b"".join(self.bytes.get(i, b"") for i in ids)
        return parts.decode("utf-8", "replace")

    def decode_all(self, ids: pa.ListArray) -> pa.Array:
        """`decode` of each list of ids of the vocabulary."""
        joined = pc.binary_join(pa.ListArray.from_arrays(ids.offsets, self.spellings.take(ids.values)), b"")
        try:
            return joined.cast(pa.string())
        except pa.ArrowInvalid:  # no UTF-8
            return pa.array([b.decode("utf-8", "replace") for b in joined.to_pylist()], pa.string())


@cache
def codec(path: str) -> Codec:
    """One codec for each file and Python worker."""
    return Codec(path)


def _by_slices(column: pa.Array, run, kind: pa.DataType) -> pa.Array:
    """`run` of the list of values, as an Arrow array made a slice at a time."""
    parts = [pa.array(run(column.slice(k, SLICE_ROWS).to_pylist()), kind) for k in range(0, len(column), SLICE_ROWS)]
    return pa.concat_arrays(parts) if parts else pa.array([], kind)


def encode(text: Column, path: str) -> Column:
    """array<int>: the token ids of a text; none for a null or empty one."""

    def encoded(texts: pa.Array) -> pa.Array:
        run = codec(path).encode_all
        return _by_slices(texts, lambda ts: run([t or "" for t in ts]), pa.list_(pa.int32()))

    return F.arrow_udf(encoded, "array<int>")(text)


def decode(ids: Column, path: str) -> Column:
    """The text of token ids; empty for null."""

    def decoded(rows: pa.Array) -> pa.Array:
        run = codec(path).decode
        return _by_slices(rows, lambda ids: [run(i or []) for i in ids], pa.string())

    return F.arrow_udf(decoded, "string")(ids)


def tokenized(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids, decoded of every row of `docs`.

    Null and empty texts have no tokens and decode to an empty text; repeated rows give a row each, an empty table an
    empty result; other columns are ignored. `path` names a file that every executor has. No shuffle: a text is encoded
    where it is read.
    """

    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = [rows.schema["doc_id"], T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    schema = T.StructType(kinds)

    # One pass for both: as two functions, Spark would encode once for the ids and once more for what is decoded. Results
    # leave in small batches, so that neither side holds those of a whole input batch.
    def roundtrip(batches):
        own = codec(path)
        for batch in batches:
            for k in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(k, SLICE_ROWS)
                ids = own.token_ids([t or "" for t in part.column(1).to_pylist()])
                columns = [ids.value_lengths().cast(pa.int64()), ids, own.decode_all(ids)]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=schema.names)
        own.forget()  # a worker that goes on with other work has its memory for that

    return rows.mapInArrow(roundtrip, schema)


def digests(tokens: DataFrame, *more: str) -> DataFrame:
    """doc_id, n_tokens, the columns `more`, and SHA-256 of the ids joined by commas and of the decoded text."""
    joined = F.array_join(F.col("ids").cast("array<string>"), ",")
    return tokens.select(
        "doc_id", "n_tokens", *more, F.sha2(joined, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )
