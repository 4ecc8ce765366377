"""A keyed Parquet table whose changes rewrite only the buckets they touch."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from moodloom.operators.grouping import keep_first
from moodloom.session import settle

BUCKET = "bucket_no"


class KeyedTable:
    """Rows in hash buckets of ``keys``, in folders that are never changed.

    A change writes the touched buckets into a new folder and then a new version of
    the list of folders, one small file that Spark commits by a single rename. A
    reader takes the newest list, so it sees the state before or after a change; a
    job that dies half-way leaves the old state, and running it again is safe. One
    writer at a time. Folders that no list names any more may be cleaned from outside.

    Driver and list hold one row per bucket and change kept in it: ``replace`` and
    ``remove`` leave one folder per touched bucket, ``insert_new`` adds one. A bucket
    with very many rows is written as several files (``rebalance``).

    Null keys are equal to each other. A ``replace`` with several rows of one key
    stores all of them.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, buckets: int = 64):
        if BUCKET in schema.names:
            raise ValueError(f"{BUCKET} names the buckets")
        self.spark, self.path, self.keys, self.schema, self.buckets = spark, path, list(keys), schema, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias(BUCKET)

    def folders(self) -> list[tuple[int, str]]:
        """(bucket, folder) of the newest state."""
        kind = f"{BUCKET} int, folder string, version int"
        try:
            lists = self.spark.read.schema(kind).parquet(f"{self.path}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return []
        newest = lists.agg(F.max("version").alias("version"))
        return [(r[BUCKET], r["folder"]) for r in lists.join(newest, "version").where(f"{BUCKET} >= 0").collect()]

    def version(self) -> int:
        """Number of changes so far."""
        try:
            lists = self.spark.read.schema("version int").parquet(f"{self.path}/lists")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return 0
        return lists.agg(F.max("version")).first()[0] or 0

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets."""
        wanted = None if buckets is None else set(buckets)
        at = [f"{self.path}/{f}/{BUCKET}={b}" for b, f in self.folders() if wanted is None or b in wanted]
        if not at:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*at)

    def replace(self, rows: DataFrame, gone: DataFrame | None = None, settled: bool = False) -> None:
        """Store ``rows`` instead of all rows with their keys, and drop the keys in ``gone``.

        ``settled`` says that ``rows`` read settled tables where they lie, so they are not written twice.
        """
        fresh = rows.select(*self.schema.names, self._bucket())
        if not settled:
            fresh = settle(fresh)
        out = fresh.select(*self.keys)
        if gone is not None:
            out = out.unionByName(gone.select(*self.keys))
        out = settle(out.distinct())
        touched = self._touched(out)
        kept = self._without(self.read(touched), out).select(*self.schema.names, self._bucket())
        self._publish(kept.unionByName(fresh), touched)

    def insert_new(self, rows: DataFrame, order: Sequence[str]) -> None:
        """Add the first row, in ``order``, of every key that is not stored; no stored file changes."""
        first = settle(keep_first(rows, self.keys, order).select(*self.schema.names))
        stored = self.read(self._touched(first))
        self._publish(self._without(first, stored).select(*self.schema.names, self._bucket()), ())

    def remove(self, gone: DataFrame) -> None:
        """Drop all rows whose key is in ``gone``."""
        out = settle(gone.select(*self.keys).distinct())
        touched = self._touched(out)
        self._publish(self._without(self.read(touched), out).select(*self.schema.names, self._bucket()), touched)

    def _touched(self, rows: DataFrame) -> list[int]:
        return [r[0] for r in rows.select(self._bucket()).distinct().collect()]

    def _without(self, rows: DataFrame, out: DataFrame) -> DataFrame:
        names = {k: f"_out{i}" for i, k in enumerate(self.keys)}
        other = out.select(*[F.col(k).alias(n) for k, n in names.items()])
        same = reduce(lambda a, b: a & b, [rows[k].eqNullSafe(other[n]) for k, n in names.items()])
        return rows.join(other, same, "left_anti")

    def _publish(self, rows: DataFrame, touched: Sequence[int]) -> None:
        folder = f"rows/{uuid.uuid4().hex}"
        rows.hint("rebalance", BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{folder}")
        written = self.spark.read.schema(f"{BUCKET} int").parquet(f"{self.path}/{folder}").select(BUCKET).distinct().collect()
        out = set(touched)
        now = [(b, f) for b, f in self.folders() if b not in out] + [(r[0], folder) for r in written]
        version = self.version() + 1
        # A list without buckets still needs a row: an empty table is a state too.
        lines = self.spark.createDataFrame(now or [(-1, "")], f"{BUCKET} int, folder string")
        lines.coalesce(1).withColumn("version", F.lit(version)).write.mode("append").partitionBy("version").parquet(
            f"{self.path}/lists"
        )
