"""Embedding jobs: a pluggable model inside Arrow batches, token-bounded sub-batches, quarantined failures."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata.frames import salted_join
from docstrata.functions import paths
from docstrata.functions.vectors import BYTE_CENTRE, DIGEST_BYTES
from docstrata.session import ensure_checkpoint_dir

# Limits of one model call, retries after the first attempt, characters per token.
MAX_ROWS = 32
MAX_TOKENS = 7000
MAX_RETRIES = 3
BATCH_CHARS_PER_TOKEN = 2.5

# Rows per block of the parallel packing, and blocks per group of blocks; any block of at least MAX_ROWS rows
# gives the same batches.
PACK_BLOCK = 4096
PACK_GROUP = 4096


class Embedder(Protocol):
    """A model: texts in, one vector per text out."""

    def embed(self, texts: list[str]) -> np.ndarray: ...


class HashEmbedder:
    """Deterministic stand-in for a model: the NumPy form of `hash_embed`, before normalisation."""

    def __init__(self, dim: int = 64):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        raw = b"".join(hashlib.sha1(t.encode("utf-8")).digest() for t in texts)
        digest = np.frombuffer(raw, dtype=np.uint8).reshape(len(texts), DIGEST_BYTES).astype(np.float64)
        return ((digest - BYTE_CENTRE) / BYTE_CENTRE)[:, np.arange(self.dim) % DIGEST_BYTES]


def _next_starts(tokens: np.ndarray, max_rows: int, max_tokens: int) -> np.ndarray:
    """For every row, the row after the batch that would start there."""
    n = len(tokens)
    sums = np.concatenate([[0], np.cumsum(tokens)])
    at = np.arange(n)
    fit = np.searchsorted(sums, sums[:-1] + max_tokens, side="right") - 1
    return np.minimum(np.minimum(np.maximum(fit, at + 1), at + max_rows), n)


def sub_batches(tokens: np.ndarray, max_rows: int = MAX_ROWS, max_tokens: int = MAX_TOKENS) -> list[tuple[int, int]]:
    """Greedy consecutive batches `(first, end)` within both limits; an oversized row stands alone."""
    follow = _next_starts(np.asarray(tokens, dtype=np.int64), max_rows, max_tokens)
    spans, start = [], 0
    while start < len(follow):
        spans.append((start, int(follow[start])))
        start = int(follow[start])
    return spans


def _group_edges(table: pa.Table, columns: int) -> list[int]:
    """Starts of the runs of equal values in the first `columns` columns of a sorted table, and its end."""
    change = np.zeros(max(table.num_rows - 1, 0), dtype=bool)
    for c in range(columns):
        values = table.column(c).combine_chunks()
        change |= pc.not_equal(values[1:], values[:-1]).to_numpy(zero_copy_only=False).astype(bool)
    return [0, *(np.flatnonzero(change) + 1).tolist(), table.num_rows]


def _unit(vectors: np.ndarray) -> np.ndarray:
    length = np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
    return np.divide(vectors, length, out=vectors.copy(), where=length > 0)


def embed(
    df: DataFrame,
    text: str = "text",
    embedder: Callable[[], Embedder] = HashEmbedder,
    normalize: bool = True,
    prefix: str = "",
    max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS,
    max_retries: int = MAX_RETRIES,
) -> DataFrame:
    """Adds `vector array<float>` and `error string`.

    `embedder` builds the model once per task, so the number of partitions is the number of model replicas.
    A call that keeps failing after `max_retries` leaves its rows with a null vector and the message. A model that
    cannot be built fails the job.
    """
    schema = T.StructType(
        [
            *df.schema.fields,
            T.StructField("vector", T.ArrayType(T.FloatType())),
            T.StructField("error", T.StringType()),
        ]
    )
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for batch in batches:
            texts = [t or "" for t in batch.column(at).to_pylist()]
            tokens = np.array([int(np.ceil(len(t) / BATCH_CHARS_PER_TOKEN)) for t in texts], dtype=np.int64)
            vectors: list = [None] * len(texts)
            errors: list = [None] * len(texts)
            if model is None and texts:
                model = embedder()
            for first, end in sub_batches(tokens, max_rows, max_tokens):
                message = None
                for _ in range(max_retries + 1):
                    try:
                        result = np.asarray(
                            model.embed([prefix + t for t in texts[first:end]]), dtype=np.float64
                        )
                        if len(result) != end - first:
                            raise ValueError("model returned a different number of vectors")
                    except Exception as failure:  # a model may raise anything
                        message = f"{type(failure).__name__}: {failure}"
                        continue
                    message = None
                    vectors[first:end] = list(_unit(result) if normalize else result)
                    break
                if message is not None:
                    errors[first:end] = [message] * (end - first)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(vectors, pa.list_(pa.float32())), pa.array(errors, pa.string())],
                names=schema.names,
            )

    return df.mapInArrow(run, schema)


def split_failures(embedded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """`(ok, dead_letter)`: rows with a vector, and rows whose model calls kept failing."""
    failed = F.col("error").isNotNull()
    return embedded.where(~failed).drop("error"), embedded.where(failed).drop("vector")


def failure_counts(dead_letter: DataFrame, by: str = "path") -> DataFrame:
    return dead_letter.groupBy(by).agg(F.count("*").alias("failed_chunks"))


def pack_batches(
    df: DataFrame,
    key: str,
    order: str,
    text: str = "text",
    max_rows: int = MAX_ROWS,
    max_tokens: int = MAX_TOKENS,
    block_rows: int = PACK_BLOCK,
    group_blocks: int = PACK_GROUP,
) -> DataFrame:
    """Greedy token-bounded batches per key in `order` (0, 1, 2, ... per key): `(key, order, tokens, batch_id)`.

    Greedy packing is sequential, yet a batch spans at most `max_rows` rows, so a block of rows is fully
    described by where a batch entering it at each of its first `max_rows` rows leaves it. Blocks are described
    in parallel and joined into descriptions of groups of blocks; the groups are chained per key, then the blocks
    of each group, and each block numbers its own rows. A key holding most of the rows is thus worked on by as
    many tasks as it has blocks, and the one chain per key has a row per `block_rows * group_blocks` rows.
    """
    if block_rows < max_rows:
        raise ValueError("block_rows must be at least max_rows")
    key_type = df.schema[key].dataType.simpleString()
    rows = df.select(
        F.col(key).alias("k"),
        F.col(order).cast("long").alias("o"),
        paths.est_tokens(text, BATCH_CHARS_PER_TOKEN).alias("tokens"),
    ).withColumn("block", F.floor(F.col("o") / block_rows).cast("long"))
    # Three numbers a row, written: the texts they come from, often cut on the way, are read once.
    ensure_checkpoint_dir(df.sparkSession)
    rows = rows.checkpoint()

    # Keys of a single block, the usual case, start at their first row and need no description.
    long_keys = rows.where("block > 0").select("k").distinct()

    # The first rows of a block are also sent to the block before it, whose last batches may reach over.
    halo = F.when(
        (F.col("block") > 0) & (F.col("o") - F.col("block") * block_rows < max_rows),
        F.array("block", F.col("block") - 1),
    ).otherwise(F.array("block"))
    long_rows = salted_join(rows, long_keys, "k", "left_semi", ["o"])
    widened = long_rows.select("k", "o", "tokens", F.explode(halo).alias("block"))

    def describe(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("o")
        block = int(pdf["block"].iloc[0])
        follow = _next_starts(pdf["tokens"].to_numpy(), max_rows, max_tokens)
        own = int((pdf["o"] < (block + 1) * block_rows).sum())
        exits = np.zeros(own, dtype=np.int64)
        calls = np.zeros(own, dtype=np.int64)
        for i in range(own - 1, -1, -1):
            nxt = int(follow[i])
            exits[i] = exits[nxt] if nxt < own else nxt - own
            calls[i] = 1 + (calls[nxt] if nxt < own else 0)
        entries = min(own, max_rows)
        late = range(max_rows - entries)
        return pd.DataFrame(
            {
                "k": [pdf["k"].iloc[0]],
                "block": [block],
                "exits": [[*exits[:entries].tolist(), *late]],
                "calls": [[*calls[:entries].tolist(), *[0 for _ in late]]],
            }
        )

    described = (
        widened.groupBy("k", "block")
        .applyInPandas(describe, f"k {key_type}, block long, exits array<long>, calls array<long>")
        .withColumn("part", F.floor(F.col("block") / group_blocks).cast("long"))
    )

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("block")
        at, calls = np.arange(max_rows), np.zeros(max_rows, dtype=np.int64)
        for block_exits, block_calls in zip(pdf["exits"], pdf["calls"]):
            calls = calls + np.asarray(block_calls)[at]
            at = np.asarray(block_exits)[at]
        return pd.DataFrame(
            {"k": [pdf["k"].iloc[0]], "part": [pdf["part"].iloc[0]], "exits": [at.tolist()], "calls": [calls.tolist()]}
        )

    def chain(pdf: pd.DataFrame, unit: str, entry: int, number: int) -> pd.DataFrame:
        """Where each unit is entered and the number of its first batch, walking from the first unit on."""
        pdf = pdf.sort_values(unit)
        entries, numbers = [], []
        for exits, calls in zip(pdf["exits"], pdf["calls"]):
            entries.append(entry)
            numbers.append(number)
            number += int(calls[entry])
            entry = int(exits[entry])
        return pd.DataFrame({"k": pdf["k"], unit: pdf[unit], "entry": entries, "number": numbers})

    parts = (
        described.groupBy("k", "part")
        .applyInPandas(compose, f"k {key_type}, part long, exits array<long>, calls array<long>")
        .groupBy("k")
        .applyInPandas(
            lambda pdf: chain(pdf, "part", 0, 0), f"k {key_type}, part long, entry long, number long"
        )
    )
    chained = (
        described.join(parts, ["k", "part"])
        .groupBy("k", "part")
        .applyInPandas(
            lambda pdf: chain(pdf, "block", int(pdf["entry"].iloc[0]), int(pdf["number"].iloc[0])),
            f"k {key_type}, block long, entry long, number long",
        )
    )

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def number(table: pa.Table) -> pa.RecordBatch:
            edges = _group_edges(table, 2)
            tokens = table.column("tokens").to_numpy()
            entry, first = table.column("entry").to_numpy(), table.column("number").to_numpy()
            ids = np.empty(table.num_rows, dtype=np.int64)
            for begin, end in zip(edges[:-1], edges[1:]):
                follow = _next_starts(tokens[begin:end], max_rows, max_tokens)
                opens = np.zeros(end - begin, dtype=np.int64)
                at = int(entry[begin])
                while at < end - begin:
                    opens[at] = 1
                    at = int(follow[at])
                ids[begin:end] = first[begin] + np.cumsum(opens) - 1
            out = table.select(["k", "o", "tokens"]).append_column("batch_id", pa.array(ids))
            return out.combine_chunks().to_batches()[0]

        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            last = _group_edges(held, 2)[-2] if held.num_rows else 0
            if last > 0:  # the last group may go on in the next batch
                yield number(held.slice(0, last))
                held = held.slice(last)
        if held is not None and held.num_rows:
            yield number(held)

    return (
        rows.join(chained, ["k", "block"], "left")
        .select(
            "k",
            "block",
            "o",
            "tokens",
            F.coalesce("entry", F.lit(0)).alias("entry"),
            F.coalesce("number", F.lit(0)).alias("number"),
        )
        .repartition("k", "block")
        .sortWithinPartitions("k", "block", "o")
        .mapInArrow(assign, f"k {key_type}, o long, tokens long, batch_id long")
        .select(F.col("k").alias(key), F.col("o").alias(order), "tokens", "batch_id")
    )
