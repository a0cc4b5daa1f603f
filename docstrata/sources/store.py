"""Bucketed Parquet tables that are updated by replacing whole buckets.

A table is a folder with `data/version=N/bucket=B/*.parquet` and `log/`, a small JSON table with one row per
bucket written. A reader takes each bucket from its newest logged version, so a version counts only once its
log rows are there: a failed or repeated write leaves readers untouched. One writer at a time.

Rows that stay lie in their bucket already: tasks write them where they read them. Only new rows, and those that a bitmap
of key hashes cannot tell from deleted ones, are shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docstrata import schemas
from docstrata.frames import key_filter, salt, salted_join
from docstrata.operators.maintenance import last_per_key
from docstrata.session import fresh_dir

_LOG = "version int, bucket int, batch_id long"
NO_BATCH = -1

#: Files of a bucket by its salts, on average, from which its rows are shuffled into few files again.
MOST_FILES = 4


class SnapshotTable:
    """Key-bucketed table; `key` decides the bucket, `row_key` identifies a row."""

    def __init__(
        self,
        spark: SparkSession,
        root: str,
        schema: T.StructType,
        key: str = "path",
        row_key: str = "id",
        order: str | None = None,
        buckets: int = 64,
        salts: int = 8,
    ):
        self.spark, self.root, self.schema = spark, root.rstrip("/"), schema
        self.key, self.row_key, self.order = key, row_key, order
        self.buckets, self.salts = buckets, salts
        self._stored = (
            T.StructType(list(schema.fields))
            .add("version", T.IntegerType())
            .add("bucket", T.IntegerType())
        )

    def _bucket(self):
        return F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")

    def create(self) -> None:
        """Starts an empty table with an empty log."""
        self._append_log(0, list(range(self.buckets)), NO_BATCH)

    def _append_log(self, version: int, buckets: list[int], batch_id: int) -> None:
        rows = self.spark.range(1).select(
            F.lit(version).cast("int").alias("version"),
            F.explode(F.array(*[F.lit(b) for b in buckets])).alias("bucket"),
            F.lit(batch_id).cast("long").alias("batch_id"),
        )
        rows.coalesce(1).write.mode("append").json(f"{self.root}/log")

    def _log(self) -> DataFrame:
        return self.spark.read.schema(_LOG).json(f"{self.root}/log")

    def _newest(self) -> dict[int, list[int]]:
        """Version -> the buckets read from it; at most one entry per bucket."""
        rows = self._log().groupBy("bucket").agg(F.max("version").alias("version")).collect()
        out: dict[int, list[int]] = {}
        for row in rows:
            out.setdefault(row["version"], []).append(row["bucket"])
        return out

    def applied(self, batch_id: int) -> bool:
        """Whether this batch was committed already."""
        return not self._log().where(F.col("batch_id") == batch_id).isEmpty()

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """Current rows, of the given buckets if any; filters and column selection reach the scan."""
        wanted = None if buckets is None else set(buckets)
        sources = {
            version: sorted(b for b in held if wanted is None or b in wanted)
            for version, held in self._newest().items()
            if version > 0
        }
        sources = {version: held for version, held in sources.items() if held}
        if not sources:
            return self.spark.createDataFrame([], self.schema)
        live = reduce(
            lambda a, b: a | b,
            [(F.col("version") == v) & F.col("bucket").isin(held) for v, held in sources.items()],
        )
        rows = (
            self.spark.read.schema(self._stored)
            .option("basePath", f"{self.root}/data")
            .parquet(*[f"{self.root}/data/version={v}" for v in sources])
        )
        return rows.where(live).select(*self.schema.names)

    def read_for(self, keys: DataFrame) -> DataFrame:
        """Current rows of the buckets that hold the given keys."""
        return self.read(self._touched(keys))

    def where_key(self, value: str) -> DataFrame:
        """Point look-up on the key: one bucket is read."""
        bucket = self.spark.range(1).select(
            F.pmod(F.xxhash64(F.lit(value)), F.lit(self.buckets)).cast("int")
        ).first()[0]
        return self.read([bucket]).where(F.col(self.key) == value)

    def _dealt(self, rows: DataFrame) -> DataFrame:
        """Rows by bucket; one that holds a large share of them is still written by several tasks."""
        spread = salt([self.row_key], self.salts)
        placed = rows.select(*self.schema.names).withColumn("bucket", self._bucket()).withColumn("__salt", spread)
        return placed.repartition("bucket", "__salt")

    def _crowded(self, buckets: list[int]) -> bool:
        """Whether these buckets lie in many files, which writes in place would keep."""
        live = {(f"version={v}", f"bucket={b}") for v, held in self._newest().items() for b in held if b in buckets}
        files = [name for name in self.read(buckets).inputFiles() if tuple(name.split("/")[-3:-1]) in live]
        return len(files) > MOST_FILES * self.salts * len(buckets)

    def _commit(self, rows: DataFrame | None, touched: list[int], batch_id: int, staying: DataFrame | None = None) -> int:
        """Writes the next version of the buckets: `rows`, dealt by `_dealt`, and `staying` as they were read."""
        version = 1 + self._log().agg(F.max("version")).first()[0]
        parts = [] if rows is None else [rows]
        if staying is not None:
            placed = self._dealt(staying) if self._crowded(touched) else staying.withColumn("bucket", self._bucket())
            parts.append(placed)
        columns = [*self.schema.names, "bucket"]
        whole = reduce(DataFrame.unionByName, [part.select(*columns) for part in parts])
        whole.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/data/version={version}")
        self._append_log(version, touched, batch_id)
        return version

    def overwrite(self, rows: DataFrame, batch_id: int = NO_BATCH) -> int:
        """Replaces the whole table."""
        return self._commit(self._dealt(rows), list(range(self.buckets)), batch_id)

    def clear(self) -> int:
        return self.overwrite(self.spark.createDataFrame([], self.schema))

    def _touched(self, keyed: DataFrame) -> list[int]:
        """Buckets of the given keys; at most `buckets` numbers reach the driver."""
        return [row[0] for row in keyed.select(self._bucket().alias("bucket")).distinct().collect()]

    def replace(self, keys: DataFrame, new: DataFrame, batch_id: int = NO_BATCH) -> int | None:
        """Deletes all rows of `keys`, then adds `new`, whose rows must belong to these keys.

        Only buckets with such keys are rewritten, and `keys` and `new` are computed once. Of rows of `new` that repeat
        key and row key the last by the table's order stays. A batch that was committed before is not applied again.
        """
        if batch_id != NO_BATCH and self.applied(batch_id):
            return None
        path = fresh_dir(self.spark, "keys")
        listed = keys.select(self.key).distinct()
        listed.write.parquet(path)
        gone = self.spark.read.schema(listed.schema).parquet(path)
        touched = self._touched(gone)
        if not touched:
            self._delete(path)
            return None
        held = self.read(touched)
        suspect = key_filter(gone, self.key)
        staying = held.where(~suspect(self.key))
        spared = salted_join(held.where(suspect(self.key)), gone, self.key, "left_anti", [self.row_key], self.salts)
        moved = self._dealt(spared).unionByName(self._last(self._dealt(new)))
        version = self._commit(moved, touched, batch_id, staying)
        self._delete(path)
        return version

    def _last(self, dealt: DataFrame) -> DataFrame:
        """The last row of a key and row key, where the table has an order; rows are together already."""
        if not self.order:
            return dealt
        last = F.max_by(F.struct(*self.schema.names), self.order).alias("__row")
        same = {"__key": F.col(self.key), "__row_key": F.col(self.row_key)}
        rows = dealt.withColumns(same).groupBy("bucket", "__salt", *same).agg(last)
        return rows.select("__row.*", "bucket", "__salt")

    def upsert(self, new: DataFrame, batch_id: int = NO_BATCH) -> int | None:
        """Adds `new`, replacing rows with the same row key; an empty input changes nothing. Of rows that repeat a key
        the last by `order` stays, or any one where the table has no order.

        `new` is read several times: pass stored rows or cheap ones.
        """
        if batch_id != NO_BATCH and self.applied(batch_id):
            return None
        touched = self._touched(new)
        if not touched:
            return None
        added = last_per_key(new, self.row_key, self.order) if self.order else new.dropDuplicates([self.row_key])
        kept = self.read(touched).join(new.select(self.row_key).distinct(), self.row_key, "left_anti")
        rows = kept.select(*self.schema.names).unionByName(added.select(*self.schema.names))
        return self._commit(self._dealt(rows), touched, batch_id)

    def vacuum(self) -> int:
        """Deletes bucket folders that a newer version has replaced; returns their number.

        For use when no reader works on an older state of the table.
        """
        live = {(v, b) for v, held in self._newest().items() for b in held}
        removed = 0
        for row in self._log().where("version > 0").select("version", "bucket").distinct().collect():
            if (row["version"], row["bucket"]) not in live:
                removed += self._delete(f"{self.root}/data/version={row['version']}/bucket={row['bucket']}")
        return removed

    def _delete(self, folder: str) -> bool:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        return bool(path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True))

    def delete_where(self, predicate: str) -> int | None:
        """Deletes the rows for which the predicate holds; only buckets that hold such rows are rewritten."""
        hit = F.coalesce(F.expr(predicate), F.lit(False))
        touched = self._touched(self.read().where(hit))
        return self._commit(None, touched, NO_BATCH, self.read(touched).where(~hit)) if touched else None


def chunk_store(spark: SparkSession, root: str, buckets: int = 64) -> SnapshotTable:
    """Chunk table, bucketed by path so that a file's chunks are replaced together."""
    return SnapshotTable(spark, root, schemas.CHUNKS, "path", "id", "chunk_index", buckets)


def dead_letter_store(spark: SparkSession, root: str, buckets: int = 16) -> SnapshotTable:
    """Chunks whose model calls kept failing, bucketed by path."""
    return SnapshotTable(spark, root, schemas.DEAD_LETTERS, "path", "id", None, buckets)


def status_store(spark: SparkSession, root: str, buckets: int = 16) -> SnapshotTable:
    return SnapshotTable(spark, root, schemas.STATUS, "path", "path", None, buckets)
