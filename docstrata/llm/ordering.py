"""Looking back and ahead in a table ordered as a whole, without gathering a key in one task.

Rows are dealt into slices by range of the full order, so that a key with any share of the rows lies in several slices,
and written; windows run within a slice, and one row a slice carries what its neighbours need.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docstrata.llm.shared import settle

SLICE = "__slice"


def sliced(df: DataFrame, order: Sequence[str], label: str) -> DataFrame:
    """`df` dealt by range of `order` and written; `__slice` numbers the slices in that order."""
    return settle(df.repartitionByRange(*order).withColumn(SLICE, F.spark_partition_id()), label)


def _rows(order: Sequence[str]):
    return Window.partitionBy(SLICE).orderBy(*order)


def with_others(slices: DataFrame, order: Sequence[str], key: Column, value: Column) -> DataFrame:
    """The rows with `__before` and `__after`: `value` of the nearest rows before and after that differ in `key`, however
    many rows with the same key are between; null where there are none."""
    held = slices.withColumn("__key", key).withColumn("__value", value)
    found = held
    for name, forward in (("__before", True), ("__after", False)):
        rows = Window.partitionBy(SLICE).orderBy(*[F.col(c).asc() if forward else F.col(c).desc() for c in order])
        prior = F.lag(F.struct("__key", "__value")).over(rows)
        found = found.withColumn("__prior", prior)
        other = F.when(F.col("__prior.__key") != F.col("__key"), F.struct("__prior.__value"))
        found = found.withColumn(name, F.last(other, ignorenulls=True).over(rows.rowsBetween(Window.unboundedPreceding, 0)))
    found = found.drop("__prior")
    rank = F.struct(*order)
    last = F.struct("__key", "__value", "__before", "__after")
    across = found.groupBy(SLICE).agg(F.min_by(last, rank).alias("first"), F.max_by(last, rank).alias("last"))
    # A row a slice: as many as partitions. What a slice's first rows of one key look back to lies in earlier slices.
    for name, near, far, side in (("__before", "first", "last", F.col(SLICE).asc()), ("__after", "last", "first", F.col(SLICE).desc())):
        walk = Window.orderBy(side)
        across = across.withColumn("__prior", F.lag(far).over(walk))
        other = F.when(F.col("__prior.__key") != F.col(f"{far}.__key"), F.struct("__prior.__value"))
        at_end = F.coalesce(F.col(f"{far}.{name}"), other)
        across = across.withColumn("__carried", F.last(at_end, ignorenulls=True).over(walk.rowsBetween(Window.unboundedPreceding, -1)))
        into = F.when(F.col("__prior.__key") == F.col(f"{near}.__key"), F.col("__carried")).otherwise(F.struct("__prior.__value"))
        across = across.withColumn(f"{name}_into", into)
    across = across.select(SLICE, "__before_into", "__after_into")
    near = [F.coalesce(F.col(c), F.col(f"{c}_into"))["__value"].alias(c) for c in ("__before", "__after")]
    return found.join(across, SLICE).select(*[c for c in slices.columns if c != SLICE], *near)


def with_last(slices: DataFrame, order: Sequence[str], value: Column) -> DataFrame:
    """The rows with `__last`: the last non-null `value` of an earlier row in the order, null where there is none."""
    held = slices.withColumn("__value", value)
    rank = F.struct(*order)
    ends = held.groupBy(SLICE).agg(F.max_by("__value", F.when(F.col("__value").isNotNull(), rank)).alias("last"))
    earlier = Window.orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.select(SLICE, F.last("last", ignorenulls=True).over(earlier).alias("__carried"))
    before = _rows(order).rowsBetween(Window.unboundedPreceding, -1)
    return (
        held.withColumn("__own", F.last("__value", ignorenulls=True).over(before)).join(ends, SLICE)
        .withColumn("__last", F.coalesce("__own", "__carried")).drop("__value", "__own", "__carried", SLICE)
    )
