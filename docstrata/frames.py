"""Small DataFrame helpers shared by the operators."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_SALTS = 8


def _literal(value) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, str):
        return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"
    if isinstance(value, float):
        return f"{value!r}D"
    return repr(value)


def values_frame(spark: SparkSession, rows: Sequence[tuple], ddl: str) -> DataFrame:
    """Literal relation of a few configuration rows; its exact size is known to the optimizer,
    so a join with it is planned as a broadcast without a hint."""
    schema = T._parse_datatype_string(ddl)
    names = ", ".join(f"`{f.name}`" for f in schema.fields)
    casts = ", ".join(f"cast(`{f.name}` as {f.dataType.simpleString()}) as `{f.name}`" for f in schema.fields)
    if not rows:
        empty = ", ".join(f"cast(null as {f.dataType.simpleString()}) as `{f.name}`" for f in schema.fields)
        return spark.sql(f"select {empty} where false")
    body = ", ".join("(" + ", ".join(_literal(v) for v in row) + ")" for row in rows)
    return spark.sql(f"select {casts} from values {body} as t({names})")


def salt(columns: Sequence[str], salts: int = DEFAULT_SALTS):
    """Salt computed from row content, so a recomputed task places its rows identically."""
    return F.pmod(F.xxhash64(*[F.col(c) for c in columns]), F.lit(salts)).cast("int")


def salted_join(
    left: DataFrame,
    right: DataFrame,
    on: Sequence[str] | str,
    how: str,
    spread: Sequence[str],
    salts: int = DEFAULT_SALTS,
) -> DataFrame:
    """Equi-join whose left side may hold a hot key.

    Left rows of one key are spread over `salts` sub-keys (by a hash of `spread`); the right side, which
    must be the small, unique-key side, is repeated once per sub-key. Spark still turns this into a
    broadcast join when the right side is measured below its threshold.
    """
    keys = [on] if isinstance(on, str) else list(on)
    salted_left = left.withColumn("__salt", salt(spread, salts))
    salted_right = right.withColumn(
        "__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    return salted_left.join(salted_right, [*keys, "__salt"], how).drop("__salt")


#: Bits of a key filter, 32 MiB at most; beyond it more keys pass that are not in it.
MAX_FILTER_BITS = 1 << 28


def key_filter(keys: DataFrame, column: str, most_bits: int = MAX_FILTER_BITS):
    """A function of a column that is true for all values of `column` in `keys` and for few others: a bitmap of hashes, of
    16 bits a key up to `most_bits`. It cuts down what an exact join shuffles."""
    spark, n = keys.sparkSession, keys.count()
    n_bits = min(most_bits, max(1 << 15, 1 << (16 * max(n, 1) - 1).bit_length()))

    def place(c) -> Column:
        return F.pmod(F.xxhash64(c), F.lit(n_bits)) + 1  # bitmaps count from 1

    parts = keys.select(place(column).alias("at")).groupBy(F.bitmap_bucket_number("at").alias("k")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("bits")
    )
    held = np.zeros(n_bits // 8, np.uint8)
    for k, bits in parts.collect():  # n_bits / 8 bytes at most
        held[(k - 1) * len(bits) : k * len(bits)] = np.frombuffer(bits, np.uint8)
    shared = spark.sparkContext.broadcast(held.tobytes())

    @F.arrow_udf("boolean")
    def known(at: pa.Array) -> pa.Array:
        at = at.to_numpy() - 1
        bits = np.frombuffer(shared.value, np.uint8)
        return pa.array(((bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1).astype(bool))

    return lambda c: known(place(c))


def instant(df: DataFrame, column: str) -> DataFrame:
    """`column` as a timestamp; times without a zone are UTC, whatever the session's zone."""
    if dict(df.dtypes)[column] != "timestamp_ntz":
        return df.withColumn(column, F.col(column).cast("timestamp"))
    local = F.convert_timezone(F.lit("UTC"), F.current_timezone(), F.col(column))
    return df.withColumn(column, local.cast("timestamp"))


def attach(df: DataFrame, one_row: DataFrame) -> DataFrame:
    """Adds the columns of a one-row result to every row, as a scalar subquery."""
    packed = one_row.select(F.struct("*").alias("__row")).scalar()
    return df.withColumn("__row", packed).select(*df.columns, "__row.*")
