"""Language-model scores from an n-gram trie in Elias-Fano levels.

Spark counts words, pairs and triples of the training texts; tasks write the model, one folder for each range of word
ids, below the cluster's shared folder, and the tasks that score map its files into memory.

Level 1 holds the hashes of all words; a word's id is its place in their order. Level 2 holds the followers of each word
and level 3 those of each pair, whatever their counts. (With a `LEAST_COUNT` above 1 rarer ones are left out; a triple
that is kept has both its pairs in level 2.) A shard of words whose contexts stand for many tokens is split into cells by
ranges of the follower's id, so that no task holds all that follows a very frequent word; the triples of a pair lie in
the pair's cell. Followers are summed up along their level, so that each level is one monotone sequence, and monotone pointers mark where
each context's followers end. A triple's last word is not an id but its place among the followers of the middle word
(context-relative), which is smaller and is known from level 2 when the pair is looked up.

Probabilities are smoothed by absolute discounting, interpolated down to the counts of single words, quantised to
1/1024 of a decade and rounded down. What is not kept backs off with the quantised weight of its context.
"""

from __future__ import annotations

import json
import math
import mmap
import re
import sys
import uuid
from collections import OrderedDict
from dataclasses import dataclass, fields
from functools import cache

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docstrata.llm.elias_fano import EliasFano
from docstrata.llm.shared import pieces, settle, word_hashes
from docstrata.session import fresh_dir

DISCOUNT = 0.75
LEAST_COUNT = 1
STEPS = 1024  # of a decade
SHARD_WORDS = 1 << 18
SHARD_TOKENS = 1 << 22
CELL_TOKENS = 1 << 23  # a shard that stands for more, because of frequent words, is split by followers
GATHER = 1 << 21  # n-grams a task sums up before it hands them on

#: Bytes of text whose tokens are looked up together: so many a cell, at least and at most. Every look-up goes through
#: all cells that the tokens need, so the more cells, the more tokens it takes to pay for that. A task holds some twenty
#: numbers a token.
LOOK_UP_BYTES = 1 << 14, 1 << 22, 1 << 24

#: Files of words, and cells of levels, that a worker keeps mapped. Where Python keeps a handle for each, fewer.
OPEN_FILES = 4096 if sys.version_info >= (3, 13) else 128

#: Words are 63-bit hashes; these two are no word's.
END, BEGIN = 1, 2


# -- texts to tokens ---------------------------------------------------------------------------------------------------


def token_stream(part: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, bounds) of a slice from `pieces`: each row is BEGIN, its words, END. Hashed a small piece at a time, as
    that takes far more memory than the tokens."""
    found = [word_hashes(p) for _, p in pieces(part)]
    words = np.concatenate([w for _, w in found])
    bounds = np.concatenate([[0], np.cumsum(np.concatenate([np.diff(b) for b, _ in found]))])
    n = np.diff(bounds) + 2
    ends = np.cumsum(n)
    stream = np.empty(int(ends[-1]), dtype=np.int64)
    inner = np.ones(len(stream), dtype=bool)
    inner[ends - 1] = inner[ends - n] = False
    stream[ends - 1], stream[ends - n] = END, BEGIN
    stream[inner] = np.maximum((words >> np.uint64(1)).view(np.int64), 3)
    return stream, np.concatenate([[0], ends])


def _packs(limits: list[int]) -> bool:
    """Whether rows of numbers below the limits fit into one number each."""
    return len(limits) == 1 or math.prod(limits) < 1 << 63


def _packed(columns: list[np.ndarray], limits: list[int]) -> list[np.ndarray]:
    """The columns as one, which is smaller and sorts faster, if they fit."""
    if not _packs(limits):
        return columns
    key = columns[0].copy()
    for column, limit in zip(columns[1:], limits[1:], strict=True):
        key *= limit
        key += column
    return [key]


def _sums(columns: list[np.ndarray], limits: list[int], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of what `_packed` gave, in order and unpacked, and how often each occurs or the sum of its weights."""
    if _packs(limits) and weights is None:
        columns = [np.sort(columns[0])]
    else:
        order = np.argsort(columns[0]) if len(columns) == 1 else np.lexsort(columns[::-1])
        columns = [c[order] for c in columns]
        weights = weights[order] if weights is not None else None
    n = len(columns[0])
    fresh = np.ones(n, dtype=bool)
    if n:
        fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    at = np.flatnonzero(fresh)
    counts = np.diff(at, append=n) if weights is None or not n else np.add.reduceat(weights, at)
    columns = [c[at] for c in columns]
    if _packs(limits):
        key, columns = columns[0], []
        for limit in limits[:0:-1]:
            key, column = np.divmod(key, limit)
            columns.insert(0, column)
        columns.insert(0, key)
    return columns, counts


def _body(columns: list[np.ndarray], counts: np.ndarray) -> bytes:
    """Columns of sorted rows and their counts in few bytes: differences, by bytes of equal rank, compressed."""
    numbers = [*[np.diff(c, prepend=0) for c in columns], counts]
    planes = np.concatenate([np.ascontiguousarray(x, dtype="<i8").view(np.uint8).reshape(-1, 8).T.ravel() for x in numbers])
    return len(counts).to_bytes(8, "little") + pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def _columns(body: bytes, n_columns: int) -> list[np.ndarray]:
    """The columns and counts of a `_body`."""
    n = int.from_bytes(body[:8], "little")
    planes = np.frombuffer(pa.decompress(body[8:], 8 * n * (n_columns + 1), codec="zstd", asbytes=True), np.uint8)
    numbers = [np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes.reshape(n_columns + 1, 8, n)]
    return [*[np.cumsum(x) for x in numbers[:-1]], numbers[-1]]


def blocks(texts: pa.Array, n_cells: int) -> list[pa.Array]:
    """Slices of a string column, each to be looked up at once."""
    each, least, most = LOOK_UP_BYTES
    return [part for _, part in pieces(texts, min(max(n_cells * each, least), most))]


def _by_cell(texts: DataFrame, grams, limits: list[int]) -> DataFrame:
    """Rows (s, body): what the tasks have summed up of the n-grams that `grams(part)` gives as columns of numbers below
    the limits, the first of them the cell `s`. A cell's rows may repeat an n-gram; it has as many as tokens at most."""

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for part in blocks(batch.column(0), limits[0]):
                held.append(_packed(grams(part), limits))
                n += len(held[-1][0])
                if n >= GATHER:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def flush(held):
        columns, counts = _sums([np.concatenate(c) for c in zip(*held, strict=True)], limits)
        cells, bodies = [], []
        for cell, part in _runs(columns[0]):
            cells.append(cell)
            bodies.append(_body(_packed([c[part] for c in columns[1:]], limits[1:]), counts[part]))
        return pa.record_batch([pa.array(cells, pa.int64()), pa.array(bodies, pa.binary())], names=["s", "body"])

    return texts.mapInArrow(count, "s long, body binary")


def _cell_sums(table: pa.Table, limits: list[int]) -> tuple[np.ndarray, ...]:
    """The columns after `s`, and the counts, of a cell's n-grams seen `LEAST_COUNT` times, in order."""
    width = 1 if _packs(limits[1:]) else len(limits) - 1
    parts = [_columns(b.as_buffer().to_pybytes(), width) for b in table.column("body").drop_null()]
    if not parts:
        return tuple(np.zeros(0, dtype=np.int64) for _ in limits)
    *columns, counts = [np.concatenate(c) for c in zip(*parts, strict=True)]
    columns, counts = _sums(columns, limits[1:], counts)
    often = counts >= LEAST_COUNT
    return *[c[often] for c in columns], counts[often]


def _runs(keys: np.ndarray) -> list[tuple[int, slice]]:
    """(key, slice) of ascending keys."""
    heads = np.flatnonzero(np.diff(keys, prepend=-1)).tolist()
    return [(int(keys[a]), slice(a, b)) for a, b in zip(heads, [*heads[1:], len(keys)])]


def _counted(texts: DataFrame, grams, names: list[str], limits: list[int]) -> DataFrame:
    """Sums of the n-grams that `grams(part)` gives as columns of numbers below the limits, over all texts (text)."""

    def count(batches):
        held, n = [], 0
        for batch in batches:
            for _, part in pieces(batch.column(0)):
                held.append(_packed(grams(part), limits))
                n += len(held[-1][0])
                if n >= GATHER:
                    yield flush(held)
                    held, n = [], 0
        if held:
            yield flush(held)

    def flush(held):
        columns, counts = _sums([np.concatenate(c) for c in zip(*held, strict=True)], limits)
        return pa.record_batch([pa.array(c, pa.int64()) for c in [*columns, counts]], names=[*names, "c"])

    found = texts.mapInArrow(count, ", ".join(f"{k} long" for k in [*names, "c"]))
    return found.groupBy(*names).agg(F.sum("c").alias("c"))


# -- files -------------------------------------------------------------------------------------------------------------


def _file_system(path: str) -> tuple[pafs.FileSystem, str]:
    path = re.sub("^s3[an]://", "s3://", path)  # Hadoop's names of the same store
    return pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)


def save(folder: str, label: str, arrays: dict[str, np.ndarray]) -> None:
    """One file of flat arrays, after a line that says where each begins. It appears whole or not at all, and repeated
    tasks write the same."""
    system, base = _file_system(folder)
    system.create_dir(base, recursive=True)
    held, at = {}, 0
    for name, array in arrays.items():
        held[name] = [array.dtype.str, len(array), at]
        at += -(-array.nbytes // 64) * 64
    head = json.dumps(held).encode()
    head += b" " * (-(len(head) + 1) % 64) + b"\n"
    draft = f"{base}/.{label}-{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        out.write(head)
        for array in arrays.values():
            out.write(np.ascontiguousarray(array).data.cast("B") if array.nbytes else b"")
            out.write(bytes(-array.nbytes % 64))
    system.move(draft, f"{base}/{label}.arrays")


def _content(path: str):
    """A file's bytes, mapped into memory without a file handle where it is one of the machine's."""
    system, base = _file_system(path)
    if not isinstance(system, pafs.LocalFileSystem):
        with system.open_input_file(base) as file:
            return file.read()
    with open(base, "rb") as file:
        untracked = {"trackfd": False} if sys.version_info >= (3, 13) else {}
        return mmap.mmap(file.fileno(), 0, access=mmap.ACCESS_READ, **untracked)


def load(folder: str, label: str) -> dict[str, np.ndarray]:
    """The arrays of a file that `save` wrote."""
    content = _content(f"{folder}/{label}.arrays")
    end = content.find(b"\n") + 1
    held = json.loads(content[:end])
    return {k: np.frombuffer(content, kind, n, end + at) if n else np.zeros(0, kind) for k, (kind, n, at) in held.items()}


class Opened:
    """What `open_one(key)` gave, of the `most` keys used last."""

    def __init__(self, open_one, most: int):
        self.open_one, self.most, self.held = open_one, most, OrderedDict()

    def __getitem__(self, key):
        if key in self.held:
            self.held.move_to_end(key)
        else:
            self.held[key] = self.open_one(key)
            if len(self.held) > self.most:
                self.held.popitem(last=False)
        return self.held[key]


def sequence_arrays(name: str, seq: EliasFano) -> dict[str, np.ndarray]:
    return {
        f"{name}-head": np.array([seq.size, seq.bits]), f"{name}-low": seq.low, f"{name}-high": seq.high, f"{name}-ones": seq.ones,
        f"{name}-zeros": seq.zeros,
    }


def sequence_of(arrays: dict[str, np.ndarray], name: str) -> EliasFano:
    size, bits = map(int, arrays[f"{name}-head"])
    return EliasFano(size, bits, *[arrays[f"{name}-{k}"] for k in ("low", "high", "ones", "zeros")])


# -- levels ------------------------------------------------------------------------------------------------------------


def quantise(p: np.ndarray) -> np.ndarray:
    """Codes of probabilities, rounded down; 0 is the least."""
    return np.clip(np.ceil(-np.log10(np.maximum(p, 1e-60)) * STEPS), 0, 65_535).astype(np.uint16)


def decades(codes: np.ndarray) -> np.ndarray:
    """log10 of quantised probabilities."""
    return codes.astype(np.float64) / -STEPS


@dataclass
class Level:
    """Followers of the contexts 0..n-1. `ends` are the pointers, `sums` the followers summed up along the level."""

    ends: EliasFano
    sums: EliasFano
    probability: np.ndarray
    backoff: np.ndarray  # of the contexts

    @staticmethod
    def sequences(n_contexts: int, context: np.ndarray, follower: np.ndarray) -> dict:
        """Files of a level's followers; the rows are in order of (context, follower)."""
        ends = np.cumsum(np.bincount(context, minlength=n_contexts)) if len(context) else np.zeros(n_contexts, np.int64)
        return {**sequence_arrays("ends", EliasFano.build(ends)), **sequence_arrays("sums", EliasFano.build(summed_up(ends, follower)))}

    @staticmethod
    def weights(p: np.ndarray, backoff: np.ndarray) -> dict:
        return {"probability": quantise(p), "backoff": quantise(backoff)}

    @staticmethod
    def load(folder: str, weighed: bool = True) -> Level:
        held = load(folder, "followers")
        weights = load(folder, "weights") if weighed else {}
        weights = [weights.get(k, np.zeros(0, np.uint16)) for k in ("probability", "backoff")]
        return Level(sequence_of(held, "ends"), sequence_of(held, "sums"), *weights)

    def start(self, context: np.ndarray) -> np.ndarray:
        """Place of the first follower of each context."""
        return np.where(context > 0, self.ends.access(np.maximum(context - 1, 0)), 0)

    def base(self, start: np.ndarray) -> np.ndarray:
        """What was summed up before a place."""
        return np.where(start > 0, self.sums.access(np.maximum(start - 1, 0)), 0) if self.sums.size else start * 0

    def find(self, contexts: np.ndarray, back: np.ndarray, follower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place, rank among the context's followers) of each follower of contexts[back], both -1 where the follower is
        negative or not kept."""
        start, end = self.ends.around(contexts)
        place = np.full(len(back), -1, dtype=np.int64)
        if self.sums.size:
            base, first = self.sums.around(np.minimum(start, self.sums.size - 1))
            asked = np.flatnonzero(follower >= 0)
            at = back[asked]
            want, head, begin, stop = base[at] + follower[asked] + 1, first[at], start[at], end[at]
            found = np.where((head == want) & (begin < stop), begin, -1)
            more = np.flatnonzero((head < want) & (begin + 1 < stop))  # contexts with one follower need no search
            other = self.sums.find(want[more])
            found[more] = np.where((other > begin[more]) & (other < stop[more]), other, -1)
            place[asked] = found
        return place, np.where(place >= 0, place - start[back], -1)

    def follower(self, place: np.ndarray) -> np.ndarray:
        """The follower at each place."""
        return self.sums.access(place) - self.base(self.start(self.context(place))) - 1

    def context(self, place: np.ndarray) -> np.ndarray:
        """The context at each place: the first whose end lies beyond it."""
        return np.searchsorted(self.ends.access(np.arange(self.ends.size)), place, "right")


def summed_up(ends: np.ndarray, follower: np.ndarray) -> np.ndarray:
    """follower + 1, plus the last sum of the contexts before: ascending over the whole level."""
    if not len(follower):
        return follower
    starts = np.concatenate([[0], ends[:-1]])
    filled = ends > starts
    last = np.where(filled, follower[np.maximum(ends - 1, 0)] + 1, 0)
    before = np.cumsum(last) - last
    return follower + 1 + np.repeat(before, ends - starts)


# -- the model ---------------------------------------------------------------------------------------------------------


@dataclass
class Facts:
    """What the driver knows of a model: a few numbers, and one for each shard."""

    path: str
    tokens: int  # N
    types: int  # V
    shift: int  # shard of a word = hash >> shift
    bases: tuple[int, ...]  # first id of each shard, and the number of ids
    cells: tuple[int, ...]  # first cell of each shard, and the number of cells


class Model:
    """Look-ups in a model's mapped files."""

    def __init__(self, facts: Facts):
        self.facts = facts
        self.bases = np.array(facts.bases, dtype=np.int64)
        self.cells = np.array(facts.cells, dtype=np.int64)
        self._words = Opened(self._open_words, OPEN_FILES)
        self._levels = Opened(lambda key: Level.load(f"{facts.path}/level{key[0]}/{key[1]}"), OPEN_FILES)

    def _open_words(self, shard: int) -> tuple[EliasFano, np.ndarray]:
        held = load(f"{self.facts.path}/words/{shard}", "words")
        return sequence_of(held, "words"), held["counts"]

    def words(self, shard: int) -> EliasFano:
        return self._words[shard][0]

    def counts(self, shard: int) -> np.ndarray:
        return self._words[shard][1]

    def level(self, n: int, cell: int) -> Level:
        return self._levels[n, cell]

    def cell(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The cell of pairs of ids. Without a follower (-1) the shard's first: a context's backoff is in all of its cells."""
        shard = np.searchsorted(self.bases, a, "right") - 1
        first, n = self.cells[shard], np.diff(self.cells)[shard]
        return first + np.maximum(b, 0) * n // max(int(self.bases[-1]), 1)

    def shard_of(self, cell: int) -> int:
        return int(np.searchsorted(self.cells, cell, "right")) - 1

    def first_follower(self, cell: np.ndarray) -> np.ndarray:
        """The least id that a follower in the cell can have."""
        shard = np.searchsorted(self.cells, cell, "right") - 1
        n = np.diff(self.cells)[shard]
        return -(-(cell - self.cells[shard]) * self.bases[-1] // n)

    def _by_shard(self, keys: np.ndarray, bounds: np.ndarray):
        """(shard, slice) of ascending keys."""
        cuts = np.searchsorted(keys, bounds)
        return [(s, slice(a, b)) for s, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)) if a < b]

    def ids(self, stream: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, counts) of word hashes; -1 and 0 where a word is unknown."""
        words, back = np.unique(stream, return_inverse=True)
        ids, counts = np.full(len(words), -1, dtype=np.int64), np.zeros(len(words), dtype=np.int64)
        bounds = np.arange(len(self.bases)) << self.facts.shift
        bounds[-1] = np.iinfo(np.int64).max
        for s, part in self._by_shard(words, bounds):
            found = self.words(s).find(words[part] - (s << self.facts.shift))
            held = self.counts(s)
            counts[part] = np.where(found >= 0, held[np.maximum(found, 0)] if len(held) else 0, 0)
            ids[part] = np.where(found >= 0, found + self.bases[s], -1)
        return ids[back], counts[back]

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, ...]:
        """(cell, place, rank, log10 p, log10 backoff of a) of pairs of ids; place is -1 where the pair is not kept, the
        backoff 0 where a is unknown. Ranks count from the least id of the cell, so they name the cell too, ascend with
        the follower and stay below the number of ids."""
        live = np.flatnonzero(a >= 0)
        homes, back, (home, first, follower) = _looked_up(self.cell(a[live], b[live]), a[live], b[live])
        cell, place, rank = np.full(len(a), -1), np.full(len(a), -1), np.full(len(a), -1)
        logp, backoff = np.zeros(len(a)), np.zeros(len(a))
        own = np.full(len(home), -1), np.full(len(home), -1), np.zeros(len(home)), np.zeros(len(home))
        for c, part in homes:
            level = self.level(2, c)
            contexts, at = _heads(first[part] - self.bases[self.shard_of(c)])
            found, ranks = level.find(contexts, at, follower[part])
            own[0][part], own[1][part] = found, np.where(found >= 0, ranks + self.first_follower(c), -1)
            own[2][part] = np.where(found >= 0, decades(level.probability[found]) if level.sums.size else 0.0, 0.0)
            own[3][part] = decades(level.backoff[contexts])[at]
        cell[live] = home[back]
        for whole, part in zip((place, rank, logp, backoff), own, strict=True):
            whole[live] = part[back]
        return cell, place, rank, logp, backoff

    def score(self, part: pa.Array) -> list[np.ndarray]:
        """n_tokens, n_known, base_score, score of the rows of a slice from `pieces`."""
        stream, bounds = token_stream(part)
        ids, counts = self.ids(stream)
        n, v = self.facts.tokens, self.facts.types
        single = np.log10((counts + 0.5) / (n + 0.5 * (v + 1)))
        token = stream != BEGIN
        before = np.concatenate([[-1], ids[:-1]])
        before[~token] = -1
        # A pair is kept only if both its words were seen often enough.
        often = token & (counts >= LEAST_COUNT) & (np.concatenate([[0], counts[:-1]]) >= LEAST_COUNT)
        cell, place, rank, logp, backoff = self.pairs(before, np.where(often, ids, -1))

        total = np.where(place >= 0, logp, backoff + single)

        # The pair before a token is its context in level 3.
        context, home = np.concatenate([[-1], place[:-1]]), np.concatenate([[-1], cell[:-1]])
        context[~token] = -1
        live = np.flatnonzero(context >= 0)
        homes, back, (_, first, follower) = _looked_up(home[live], context[live], rank[live])
        hit, own = np.zeros(len(first), bool), np.zeros(len(first))
        for c, span in homes:
            level = self.level(3, c)
            contexts, at = _heads(first[span])
            found, _ = level.find(contexts, at, follower[span])
            hit[span] = found >= 0
            low = decades(level.backoff[contexts])[at]
            own[span] = np.where(found >= 0, decades(level.probability[found]), low) if level.sums.size else low
        total[live] = np.where(hit[back], own[back], total[live] + own[back])

        heads = bounds[:-1]
        known = (counts > 0) & token
        return [
            np.add.reduceat(token.astype(np.int64), heads), np.add.reduceat(known.astype(np.int64), heads),
            np.add.reduceat(np.where(token, single, 0.0), heads), np.add.reduceat(np.where(token, total, 0.0), heads),
        ]


def _heads(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct values, place of each among them) of ascending keys."""
    fresh = np.ones(len(keys), dtype=bool)
    fresh[1:] = keys[1:] != keys[:-1]
    return keys[fresh], np.cumsum(fresh) - 1


def _looked_up(home: np.ndarray, context: np.ndarray, follower: np.ndarray):
    """(runs of equal cells, place of each row, the distinct rows) of (cell, context, follower), distinct rows in order:
    look-ups then go through a level once, from its beginning to its end."""
    columns = [home, context, follower + 1]
    limits = [int(c.max(initial=0)) + 1 for c in columns]
    key = _packed(columns, limits)
    order = np.argsort(key[0]) if len(key) == 1 else np.lexsort(key[::-1])
    fresh = np.ones(len(order), dtype=bool)
    if len(order):
        fresh[1:] = np.logical_or.reduce([(k := c[order])[1:] != k[:-1] for c in key])
    back = np.empty(len(order), np.int64)
    back[order] = np.cumsum(fresh) - 1
    rows = order[fresh]
    held = home[rows], context[rows], follower[rows]
    return _runs(held[0]), back, held


@cache
def open_model(path: str, *rest) -> Model:
    """One for each model and Python worker."""
    return Model(Facts(path, *rest))


def _opened(facts: Facts) -> Model:
    return open_model(*[getattr(facts, f.name) for f in fields(Facts)])


def train(texts: DataFrame) -> Facts:
    """Writes the model of the rows (text), nulls being empty, and returns where it is."""
    spark = texts.sparkSession
    path = fresh_dir(spark, "lm")
    texts = texts.select(F.coalesce("text", F.lit("")).alias("text"))

    vocabulary = settle(_counted(texts, lambda part: [token_stream(part)[0]], ["word"], [1 << 63]), "lm-words")
    row = vocabulary.where(F.col("word") != BEGIN).agg(F.sum("c"), F.count("*"), F.lit(1)).first()
    tokens, types = int(row[0] or 0), int(row[1])
    # A shard of the model is built by one task: its words and, roughly, the tokens it stands for are bounded.
    n_shards = 1 << max(0, math.ceil(math.log2(max(types / SHARD_WORDS, tokens / SHARD_TOKENS, 1))))
    shift = 63 - n_shards.bit_length() + 1

    def words(key: tuple, table: pa.Table) -> pa.Table:
        s = key[0].as_py()
        table = table.drop_null()
        word, count = table.column("word").to_numpy(), table.column("c").to_numpy()
        order = np.argsort(word)
        save(f"{path}/words/{s}", "words", {**sequence_arrays("words", EliasFano.build(word[order] - (s << shift))), "counts": count[order]})
        return pa.table({"s": [s], "n": [len(word)], "c": [int(count.sum())]})

    # A row for each shard, so that one without words has its files too. The word 0 stands for none.
    every = spark.range(n_shards).select(F.col("id").alias("s"), F.lit(None).cast("long").alias("word"), F.lit(None).cast("long").alias("c"))

    def sharded(rows: DataFrame, build) -> dict[int, tuple[int, int]]:
        """`build` of the rows of each shard or cell, in a task each; its counts by shard or cell."""
        def of(key: tuple, table: pa.Table) -> pa.Table:
            return build(key, table)

        return {r.s: (r.n, r.c) for r in rows.groupBy("s").applyInArrow(of, "s long, n long, c long").collect()}

    home = F.expr(f"shiftright(word, {shift})") if shift < 63 else F.lit(0)
    sizes = sharded(vocabulary.select(home.cast("long").alias("s"), "word", "c").unionByName(every), words)
    bases = (0, *np.cumsum([sizes[s][0] for s in range(n_shards)]).tolist())
    cells = (0, *np.cumsum([max(1, -(-sizes[s][1] // CELL_TOKENS)) for s in range(n_shards)]).tolist())
    n_cells = cells[-1]
    facts = Facts(path, tokens, types, shift, bases, cells)

    def pair_ids(part: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        stream, _ = token_stream(part)
        ids, counts = _opened(facts).ids(stream)
        return stream, ids, counts

    def pairs(part: pa.Array) -> list[np.ndarray]:
        stream, ids, counts = pair_ids(part)
        # A pair cannot be seen more often than its words.
        good = (stream[1:] != BEGIN) & (counts[1:] >= LEAST_COUNT) & (counts[:-1] >= LEAST_COUNT)
        a, b = ids[:-1][good], ids[1:][good]
        return [_opened(facts).cell(a, b), a, b]

    def level2(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        a, b, c = _cell_sums(table, pair_limits)
        model = _opened(facts)
        s = model.shard_of(cell)
        a = a - facts.bases[s]
        mass = np.bincount(a, c - DISCOUNT, minlength=len(model.counts(s))).astype(np.float64)
        save(f"{path}/level2/{cell}", "followers", Level.sequences(len(mass), a, b))
        save(f"{path}/level2/{cell}", "counts", {"counts": c, "mass": mass})
        if facts.cells[s + 1] - facts.cells[s] == 1:
            weigh2(cell, a, b, c, mass)
        return pa.table({"s": [cell], "n": [len(a)], "c": [0]})

    def weigh2(cell: int, a: np.ndarray, b: np.ndarray, c: np.ndarray, mass: np.ndarray) -> None:
        """Probabilities of a cell; `mass` is what the followers of each context take in all cells of the shard."""
        model = _opened(facts)
        s = model.shard_of(cell)
        seen = model.counts(s).astype(np.float64)
        back = 1 - mass / seen if len(seen) else seen
        single = np.zeros(len(b))
        by_b = np.argsort(b, kind="stable")
        for t, cut in model._by_shard(b[by_b], model.bases):
            single[by_b[cut]] = model.counts(t)[b[by_b[cut]] - facts.bases[t]]
        single = (single + 0.5) / (tokens + 0.5 * (types + 1))
        p = (c - DISCOUNT) / seen[a] + back[a] * single if len(a) else single
        save(f"{path}/level2/{cell}", "weights", Level.weights(p, back))

    def finish2(batches):
        for batch in batches:
            for cell in batch.column(0).to_pylist():
                s = _opened(facts).shard_of(cell)
                level = Level.load(f"{path}/level2/{cell}", weighed=False)
                mass = sum(load(f"{path}/level2/{k}", "counts")["mass"] for k in range(facts.cells[s], facts.cells[s + 1]))
                at = np.arange(level.sums.size)
                weigh2(cell, level.context(at), level.follower(at), load(f"{path}/level2/{cell}", "counts")["counts"], mass)
                yield pa.record_batch([pa.array([cell], pa.int64())], names=["s"])

    def dealt(grams, limits: list[int]) -> DataFrame:
        """The n-grams by cell, and a row for each cell, so that one without any has its files too."""
        none = spark.range(n_cells).select(F.col("id").alias("s"), F.lit(None).cast("binary").alias("body"))
        return _by_cell(texts, grams, limits).unionByName(none)

    pair_limits = [n_cells, bases[-1], bases[-1]]
    n_pairs = max(n for n, _ in sharded(dealt(pairs, pair_limits), level2).values())
    split = [k for s in range(n_shards) if cells[s + 1] - cells[s] > 1 for k in range(cells[s], cells[s + 1])]
    if split:
        spark.createDataFrame([(k,) for k in split], "s long").repartition(len(split)).mapInArrow(finish2, "s long").count()

    def triples(part: pa.Array) -> list[np.ndarray]:
        stream, ids, counts = pair_ids(part)
        ids = np.where(counts >= LEAST_COUNT, ids, -1)
        before = np.concatenate([[-1], ids[:-1]])
        before[stream == BEGIN] = -1
        cell, place, rank, *_ = _opened(facts).pairs(before, ids)
        good = (place[:-1] >= 0) & (place[1:] >= 0)
        return [cell[:-1][good], place[:-1][good], rank[1:][good]]

    def level3(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        node, rank, c = _cell_sums(table, triple_limits)
        model = _opened(facts)
        seen = load(f"{path}/level2/{cell}", "counts")["counts"].astype(np.float64)
        back = 1 - np.bincount(node, c - DISCOUNT, minlength=len(seen)) / seen if len(seen) else seen
        below = np.zeros(len(node))
        if len(node):
            middle = model.level(2, cell).follower(node)
            # The rank is the last word's, among the followers of the middle one.
            homes = model.cell(middle, rank)
            by = np.argsort(homes, kind="stable")
            for home, part in _runs(homes[by]):
                at = by[part]
                level = model.level(2, home)
                context = middle[at] - facts.bases[model.shard_of(home)]
                below[at] = decades(level.probability[level.start(context) + rank[at] - model.first_follower(home)])
        p = (c - DISCOUNT) / seen[node] + back[node] * 10**below if len(node) else below
        save(f"{path}/level3/{cell}", "followers", Level.sequences(len(seen), node, rank))
        save(f"{path}/level3/{cell}", "weights", Level.weights(p, back))
        return pa.table({"s": [cell], "n": [len(node)], "c": [0]})

    triple_limits = [n_cells, n_pairs, bases[-1]]
    sharded(dealt(triples, triple_limits), level3)
    return facts


def score(text: Column, facts: Facts) -> Column:
    """struct n_tokens, n_known, base_score, score of a text."""

    def scored(texts: pa.Array) -> pa.Array:
        model = _opened(facts)
        found = [model.score(part) for part in blocks(texts, facts.cells[-1])]
        kinds = (pa.int64(), pa.int64(), pa.float64(), pa.float64())
        arrays = [pa.array(np.concatenate([f[k] for f in found]) if found else [], kind) for k, kind in enumerate(kinds)]
        return pa.StructArray.from_arrays(arrays, names=["n_tokens", "n_known", "base_score", "score"])

    return F.arrow_udf(scored, "struct<n_tokens: bigint, n_known: bigint, base_score: double, score: double>")(text)


def score_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, held_fold: int = 1
) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    A row is held out where crc32(id as text) mod `folds` is `held_fold`; the model learns from all others. Tokens are
    the words `[^\\x20\\x09-\\x0D]+` with A-Z lower-cased and one end; base_score is the sum of
    log10((c + 0.5) / (N + 0.5 (V + 1))) over them. A null text is empty: one token. A row with a null id is held out.
    Repeated rows count each. An empty table gives an empty result, and without training texts N and V are 0. Other
    columns are ignored.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % folds == held_fold, F.lit(True))
    facts = train(rows.where(~held))
    return rows.select("doc_id", held.alias("held_out"), score(F.col("text"), facts).alias("s")).select(
        "doc_id", "held_out", "s.n_tokens", "s.n_known", F.lit(facts.tokens).cast("long").alias("train_tokens"), "s.base_score", "s.score"
    )
