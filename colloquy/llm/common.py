"""Helpers shared by the training-data operators: shared storage, blocking and components."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Keep at most this many rows on the broadcast side of a join; larger sides are shuffled.
BROADCAST_ROWS = 20_000

#: White space between words: the space and U+0009 to U+000D.
SPACES = "\\x20\\x09-\\x0D"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Only a local session, where all is one machine, may leave it unset."""
    context = spark.sparkContext
    found = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = context.getCheckpointDir()
        found = found.rpartition("/")[0] if found else None
    if not found:
        if not (context.master or "").startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir is not set: the operators need a folder that all executors share")
        found = f"file://{tempfile.mkdtemp(prefix='colloquy-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def new_folder(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"


def stored(df: DataFrame, label: str, codec: str = "zstd") -> DataFrame:
    """Write df as a Parquet table in the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    at = new_folder(spark, label)
    df.write.option("compression", codec).parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def dropped(df: DataFrame) -> None:
    """Remove the files of a table from stored() that nothing reads any longer."""
    spark = df.sparkSession
    folder = df.inputFiles()[:1]
    if folder and (root := shared_dir(spark)) and folder[0].split(":", 1)[-1].lstrip("/").startswith(root.split(":", 1)[-1].lstrip("/")):
        path = spark._jvm.org.apache.hadoop.fs.Path(folder[0]).getParent()
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df with a broadcast hint if it has been counted to be small, else as it is."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def fresh(columns: list[str], name: str) -> str:
    """A column name that isn't among columns, whatever their case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed(df: DataFrame, **more: Column) -> tuple[DataFrame, str, list[str]]:
    """df written with a number of its own for every row, and more columns: (table, name of the number, names of the others).

    Rows that are equal, share an identifier or have none can be told apart by it.
    """
    names = [fresh(df.columns, f"_{k}") for k in ("row", *more)]
    return stored(df.withColumns(dict(zip(names, (F.monotonically_increasing_id(), *more.values()), strict=True))), "keyed"), names[0], names[1:]


def by_group(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """From batches sorted by the long column key: batches that end where a key ends, each with its groups' bounds.

    Only the last group of a batch is carried on, so a task holds a batch and one group. For groups of bounded size only: large ones are
    split by a count before they are dealt out.
    """
    kept: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        if kept and kept[0].column(key)[0].as_py() != keys[0]:
            yield _whole(kept, key)
            kept = []
        cut = int(np.searchsorted(keys, keys[-1], "left"))
        if cut:
            yield _whole([*kept, batch.slice(0, cut)], key)
            kept = []
        kept.append(batch.slice(cut))
    if kept:
        yield _whole(kept, key)


def _whole(parts: list[pa.RecordBatch], key: str) -> tuple[pa.RecordBatch, np.ndarray]:
    one = parts[0]
    if len(parts) > 1:
        one, *more = pa.Table.from_batches(parts).combine_chunks().to_batches()
        if more:  # Arrow splits a binary column beyond 2 GB
            raise ValueError(f"a group of {key} doesn't fit one Arrow batch")
    keys = one.column(key).to_numpy(zero_copy_only=False)
    return one, np.concatenate(([0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]))


def in_cells(rows: DataFrame, largest: int) -> DataFrame:
    """rows (bucket, id, n: rows of the bucket, more) dealt to cells of about `largest` rows, two chunks of that size at most.

    A bucket of at most `largest` rows is a cell. A larger one is cut into chunks by a hash of id, and each pair of chunks (and
    each chunk with itself) is a cell, so that no task gets it whole and each pair of its rows meets in one cell. own: the
    cell's rows are to be compared among each other; else those with is_left with the others.
    """
    chunks = F.ceil(F.col("n") / F.lit(largest)).cast("int")
    chunk = F.pmod(F.xxhash64("id", F.lit(1)), chunks).cast("int")
    return (
        rows.withColumn("_chunk", chunk).withColumn("_other", F.explode(F.sequence(F.lit(0), chunks - 1)))
        .withColumn("cell", F.when(chunks == 1, F.col("bucket")).otherwise(F.xxhash64("bucket", F.least("_chunk", "_other"), F.greatest("_chunk", "_other"))))
        .withColumn("own", F.col("_chunk") == F.col("_other")).withColumn("is_left", F.col("_chunk") <= F.col("_other")).drop("_chunk", "_other", "n")
    )


def compared(cells: DataFrame, compare: Callable, out_schema: str, largest: int, compare_many: Callable) -> DataFrame:
    """compare's rows over all cells of in_cells(). compare(left, right): two batches, right None for the pairs within left; it
    returns a batch of out_schema or None. compare_many(batch, bounds, which) does the same for many groups of a sorted batch at once."""

    def run(batches):
        for batch, bounds in by_group(batches, "cell"):
            sizes = np.diff(bounds)
            own = batch.column("own").to_numpy(zero_copy_only=False).astype(bool)[bounds[:-1]]
            which = np.flatnonzero((sizes > 1) & own)
            if len(which):
                found = compare_many(batch, bounds, which)
                if found is not None and found.num_rows:
                    yield found
            for i in np.flatnonzero((sizes > 1) & ~own):
                block = batch.slice(bounds[i], sizes[i])
                left = block.column("is_left").to_numpy(zero_copy_only=False).astype(bool)
                if left.any() and not left.all():
                    found = compare(block.filter(pa.array(left)), block.filter(pa.array(~left)))
                    if found is not None and found.num_rows:
                        yield found

    return cells.repartition("cell").sortWithinPartitions("cell").mapInArrow(run, out_schema)


#: Nodes of a round of components() that are joined by broadcast, at most: those with over a thousandth of all edges' ends.
HOT_NODES, HOT_DEGREE = 1000, 100


def components(edges: DataFrame) -> DataFrame:
    """Connected components of edges(a, b): one row (node, root) per node of an edge, root its smallest node.

    Alternates large-star and small-star steps until no edge changes. Each step is a grouped minimum
    (combined before the shuffle) and an equi-join; every round is a table in the shared folder. The nodes with over a thousandth of
    all edges' ends, of which there are at most HOT_NODES, are joined by broadcast, so no task gets all edges of a hub.
    Null ends and loops are ignored; no edges give no rows.
    """
    now = stored(
        edges.where(F.col("a").isNotNull() & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
        .select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(),
        "edges",
    )
    mark = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
    before = None
    while mark != before:
        both = now.select("a", "b").unionByName(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        lows = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count("*").alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "lows")
        hot = lows.where(F.col("n") > max(HOT_DEGREE, 2 * mark[0] // HOT_NODES)).select("a", "m")
        if hot.head(1):
            hot = F.broadcast(hot)
            rest = both.join(hot.select("a"), "a", "left_anti").join(lows.select("a", "m"), "a")
            joined = both.join(hot, "a").unionByName(rest)
        else:
            joined = both.join(lows.select("a", "m"), "a")
        large = joined.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        down = large.groupBy("a").agg(F.min("b").alias("m"))
        step = large.join(down, "a").select("a", "b", "m")
        tiny = step.select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(step.select("a", F.col("m").alias("b")))
        after = stored(tiny.where("a <> b").distinct(), "edges")
        before, mark = mark, after.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).head()
        dropped(now)
        dropped(lows)
        now = after
    stars = now.groupBy("a").agg(F.min("b").alias("root")).select(F.col("a").alias("node"), "root")
    return stars.unionByName(stars.select(F.col("root").alias("node"), "root").distinct())


# -- hashes of bytes and words in numpy -------------------------------------------------------------


def hash_tables(seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A random number for each octet, and odd multipliers."""
    random = np.random.default_rng(seed)
    return random.integers(0, 2**64, 256, dtype=np.uint64), random.integers(0, 2**64, 16, dtype=np.uint64) | np.uint64(1)


def stir(x: np.ndarray, mix: np.ndarray) -> np.ndarray:
    """Spread all bits of 64-bit numbers over all bits."""
    x = (x ^ (x >> np.uint64(31))) * mix[0]
    x = (x ^ (x >> np.uint64(29))) * mix[1]
    return x ^ (x >> np.uint64(32))
