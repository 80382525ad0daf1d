"""Keyed tables that are kept on disk and changed in place, a few buckets at a time.

Rows lie in buckets by a hash of their key.  A change writes the buckets that it touches beside
the old ones, checks them, and then writes a new version of the table's list of folders.  A
reader takes the last complete version, so a change that stops half-way changes nothing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from moodspark.sources import keyed

VERSION = "bucket int, folder string, n_rows bigint"
BUCKET = "_bucket"


class StoredTable:
    """A table below ``path`` with the given key columns.  Null is a key like any other."""

    def __init__(self, spark: SparkSession, path: str, schema: str, keys: Sequence[str], buckets: int = 64):
        self.spark, self.path, self.schema = spark, path.rstrip("/"), schema
        self.keys, self.buckets = list(keys), buckets

    def versions(self) -> list[int]:
        """Numbers of the complete versions, oldest first."""
        folder = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        files = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(folder):
            return []
        names = [s.getPath() for s in files.listStatus(folder)]
        done = [p.getName() for p in names if files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))]
        return sorted(int(n) for n in done)

    def _folders(self) -> dict[int, tuple[str, int]]:
        """Folder and rows of each bucket that has rows; a row for each bucket at most."""
        known = self.versions()
        if not known:
            return {}
        rows = self.spark.read.schema(VERSION).json(f"{self.path}/versions/{known[-1]}").collect()
        return {r.bucket: (r.folder, r.n_rows) for r in rows}

    def read(self, only: Sequence[int] | None = None) -> DataFrame:
        """The last complete version, or some of its buckets."""
        folders = [f"{self.path}/{f}" for b, (f, _) in sorted(self._folders().items()) if only is None or b in only]
        if not folders:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*folders)

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _change(self, delta: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame]) -> None:
        """Put merge(old rows, delta) in place of the buckets that the delta's keys fall into."""
        before = self._folders()
        touched = [r[0] for r in delta.select(self._bucket().alias("b")).distinct().collect()]
        if not touched:
            return
        merged = merge(self.read(touched), delta).withColumn(BUCKET, self._bucket())
        written = f"data/{uuid.uuid4().hex}"
        # a bucket with very many rows is dealt over several files by the values of its rows
        values = [c for c in merged.columns if c != BUCKET]
        merged.repartition(BUCKET, F.pmod(F.xxhash64(*values), F.lit(8))).write.partitionBy(BUCKET).parquet(f"{self.path}/{written}")
        back = self.spark.read.schema(f"{self.schema}, {BUCKET} int").parquet(f"{self.path}/{written}")
        counted = back.groupBy(BUCKET, self._bucket().alias("own")).agg(F.count("*").alias("n")).collect()
        if any(r[BUCKET] != r.own or r.own not in touched for r in counted):
            raise ValueError(f"rows in a bucket that is not theirs: {self.path}/{written}")
        rows = [(b, f, n) for b, (f, n) in before.items() if b not in touched]
        rows += [(r.own, f"{written}/{BUCKET}={r.own}", r.n) for r in counted]
        self._switch(rows)

    def _switch(self, rows: list[tuple]) -> None:
        number = (self.versions() or [0])[-1] + 1
        # fails if another change has begun to write the same version
        self.spark.createDataFrame(rows, VERSION).coalesce(1).write.mode("error").json(f"{self.path}/versions/{number}")

    def upsert(self, delta: DataFrame, order: Sequence[str]) -> None:
        """Insert or replace by key; of several rows for a key the last one counts."""
        self._change(delta, lambda old, new: keyed.upsert(old, new, self.keys, order))

    def insert_missing(self, delta: DataFrame, order: Sequence[str]) -> None:
        """Add rows whose key is not there yet; of several rows for a key the first one counts."""
        self._change(delta, lambda old, new: keyed.insert_missing(old, new, self.keys, order))

    def replace_children(self, delta: DataFrame, refreshed: DataFrame, spread_by: Sequence[str]) -> None:
        """In a table keyed by parent: drop the children of refreshed parents, then add the new ones."""
        parents = refreshed.select(*self.keys).distinct()
        empty = parents.select(*[F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in delta.schema])
        marked = delta.withColumn("_new", F.lit(True)).unionByName(empty.withColumn("_new", F.lit(False)))

        def merge(old: DataFrame, both: DataFrame) -> DataFrame:
            new = both.where("_new").drop("_new")
            return keyed.replace_children(old, new, parents, self.keys, spread_by)

        self._change(marked, merge)
