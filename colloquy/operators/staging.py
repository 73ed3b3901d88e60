"""Results kept between the steps of a run, and tables dealt by conversation once for all that follows."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new folder that all executors share, under spark.checkpoint.dir. Only a local session, where all is one machine, may leave that unset."""
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not root:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: a folder that all executors share is needed")
        root = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def kept(df: DataFrame) -> DataFrame:
    """df written as a table in the shared folder and read back: computed once, survives lost executors, and cuts the plan."""
    at = shared_folder(df.sparkSession, "kept")
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)


def stage(rows: DataFrame, table: str, key: str, order: list[str], buckets: int = 64) -> DataFrame:
    """rows as a table dealt into buckets by key and sorted within them, read back: grouping, windows and chunks by key need no shuffle from then on.

    The table is replaced. Each bucket is one file, written by one task that gets all rows of its keys, so choose the number of buckets by the size of the table.
    """
    rows.repartition(buckets, key).sortWithinPartitions(key, *order).write.mode("overwrite").bucketBy(buckets, key).sortBy(key, *order).saveAsTable(table)
    return rows.sparkSession.table(table)


def staged_keys(spark: SparkSession, table: str, key: str) -> DataFrame:
    """The distinct keys of a staged table, UNRESOLVED last."""
    rows = spark.table(table).select(key).distinct()
    return rows.orderBy(rows[key].cast("string") == "UNRESOLVED", key)
