"""Results kept under keys in Parquet: written again they replace what was there, deleted by whole or partial keys, read back one row a key.

Rows lie in folders by a hash of their key. A write reads the folders that it touches, puts its rows in place of those with their keys, and replaces these folders together when all is
written (Spark's dynamic partition overwrite): the same write twice leaves the same rows, and one that fails before its commit leaves the old ones. One writer at a time.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

BUCKETS = 64
_BUCKET = "_bucket"


class KeyedStore:
    """A store at a path with key columns. Null is a key like any other. The columns are those of the first write; a later one needs the same."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), keys, buckets

    def _folder(self, name: str = ""):
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return path.getFileSystem(self.spark._jsc.hadoopConfiguration()), path

    def exists(self) -> bool:
        files, path = self._folder()
        return files.exists(path) and any(s.getPath().getName().startswith(f"{_BUCKET}=") for s in files.listStatus(path))

    def _rows(self) -> DataFrame:
        return self.spark.read.parquet(self.path)

    def read(self) -> DataFrame | None:
        """All rows; None before the first write."""
        return self._rows().drop(_BUCKET) if self.exists() else None

    def _same(self, a: str, b: str, keys: list[str]) -> Column:
        return reduce(lambda x, y: x & y, [F.col(f"{a}.`{k}`").eqNullSafe(F.col(f"{b}.`{k}`")) for k in keys])

    def _bucketed(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn(_BUCKET, F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int"))

    def _replace(self, rows: DataFrame, touched: list[int]) -> None:
        """Put rows in place of the touched folders; one that is left without rows goes."""
        out = rows.repartition(self.buckets, _BUCKET).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(_BUCKET)
        left = {r[0] for r in rows.select(_BUCKET).distinct().collect()}
        out.parquet(self.path)
        for bucket in set(touched) - left:
            files, path = self._folder(f"{_BUCKET}={bucket}")
            files.delete(path, True)

    def write(self, rows: DataFrame, order: list[str] | None = None) -> None:
        """Put rows under their keys. Of several rows with one key the last in an order counts; without an order they must not differ in key."""
        if order:
            last = F.row_number().over(Window.partitionBy(*self.keys).orderBy(*[F.desc(c) for c in order]))
            rows = rows.withColumn("_n", last).where("_n = 1").drop("_n")
        new = self._bucketed(rows)
        touched = [r[0] for r in new.select(_BUCKET).distinct().collect()]
        if not touched:
            return
        if self.exists():
            old = self._rows().where(F.col(_BUCKET).isin(touched))
            kept = old.alias("o").join(new.select(*self.keys).alias("n"), self._same("o", "n", self.keys), "left_anti")
            new = kept.select(*new.columns).unionByName(new)
        self._replace(new, touched)

    def delete(self, some: DataFrame) -> int:
        """Delete the rows that match rows of some, by all columns of it, which are keys or other columns of the store; returns how many there were."""
        if not self.exists():
            return 0
        rows, on = self._rows(), some.columns
        gone = rows.alias("o").join(some.distinct().alias("n"), self._same("o", "n", on), "left_semi")
        counts = {r[0]: r[1] for r in gone.groupBy(_BUCKET).count().collect()}
        if counts:
            left = rows.where(F.col(_BUCKET).isin(list(counts))).alias("o").join(some.distinct().alias("n"), self._same("o", "n", on), "left_anti")
            self._replace(left, list(counts))
        return sum(counts.values())

    def register(self, rows: DataFrame) -> None:
        """Write rows whose keys are new; a row that is there already must be equal in every column, else nothing is written and it is an error."""
        if self.exists():
            there = self._rows().drop(_BUCKET)
            told = rows.select(*there.columns)
            known = told.alias("a").join(there.select(*self.keys).alias("b"), self._same("a", "b", self.keys), "left_semi")
            other = known.alias("a").join(there.alias("b"), self._same("a", "b", there.columns), "left_anti").head()
            if other is not None:
                raise ValueError(f"{ {k: other[k] for k in self.keys} } is registered with other values")
            rows = told.alias("a").join(there.select(*self.keys).alias("b"), self._same("a", "b", self.keys), "left_anti")
        self.write(rows)

    def missing(self, planned: DataFrame) -> DataFrame:
        """The rows of planned whose keys the store doesn't have: what a resumed run still has to do."""
        if not self.exists():
            return planned
        return planned.alias("a").join(self._rows().select(*self.keys).alias("b"), self._same("a", "b", self.keys), "left_anti")
