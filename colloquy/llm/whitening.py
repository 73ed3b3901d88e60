"""Whitening of embeddings: principal components of the covariance, counted in tiles.

Components become whole numbers near their means, so that sums of products are whole, too. The distinct vectors are cut into row blocks and
column blocks. Column blocks meet by row block, each pair of dimension blocks is a tile, and a tile's products are summed within a task and
then per tile. The tiles make up the covariance, a matrix of the vectors' length squared, which alone is decomposed on the driver; each row is
then projected where it lies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .vectors import finite, whole

FACTOR, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Dimensions of a tile's side, numbers of a column block, and numbers of tiles that a task holds before it passes them on.
TILE, BLOCK_NUMBERS, HELD_NUMBERS = 32, 131_072, 4_000_000
#: Whole numbers below this are exact as doubles with their products and sums over a block.
LARGEST = 2**40


def _packed(batch, name: str, length: int) -> np.ndarray:
    """A batch's packed whole vectors as a matrix."""
    return np.frombuffer(b"".join(batch.column(name).to_pylist()), "<i8").reshape(-1, length)


def _sums(rows: DataFrame, length: int) -> list[int]:
    """The exact sum of each dimension over rows (x): a task's sums are one row, Spark adds them up."""

    def summed(batches):
        total = np.zeros(length, np.int64)
        for batch in batches:
            total += _packed(batch, "x", length).sum(0)
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    each = rows.select("x").mapInArrow(summed, "s array<long>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    return [r.s for r in each.orderBy("k").collect()]


def column_blocks(fit: DataFrame, centre: np.ndarray, tile: int = TILE) -> DataFrame:
    """(row_block, side, z): fit's vectors less centre, cut into row blocks and column blocks of `tile` dimensions, packed as doubles.

    fit is a written table, so a task that runs again cuts the same blocks.
    """
    length = len(centre)
    rows = max(1, BLOCK_NUMBERS // tile)

    def cut(batches):
        first = TaskContext.get().partitionId() << 32
        for batch in batches:
            z = (_packed(batch, "x", length) - centre).astype(np.float64)
            for s in range(0, len(z), rows):
                sides = [np.ascontiguousarray(z[s : s + rows, d : d + tile]).tobytes() for d in range(0, length, tile)]
                number = pa.array(np.full(len(sides), first, np.int64))
                first += 1
                yield pa.RecordBatch.from_arrays([number, pa.array(np.arange(len(sides), dtype=np.int32)), pa.array(sides, pa.binary())], names=["row_block", "side", "z"])

    return fit.select("x").mapInArrow(cut, "row_block long, side int, z binary")


def tiles(blocks: DataFrame, length: int, tile: int = TILE) -> DataFrame:
    """(i, j, t): for each pair of column blocks i <= j the sum over all row blocks of their product, packed as doubles."""
    width = [min(tile, length - d) for d in range(0, length, tile)]
    pairs = blocks.select("row_block", F.col("side").alias("i"), F.col("z").alias("left")).join(
        blocks.select("row_block", F.col("side").alias("j"), F.col("z").alias("right")), "row_block"
    ).where("i <= j")

    def told(held):
        keys = sorted(held)
        return pa.RecordBatch.from_arrays(
            [pa.array([i for i, _ in keys], pa.int32()), pa.array([j for _, j in keys], pa.int32()), pa.array([held[k].tobytes() for k in keys], pa.binary())], names=["i", "j", "t"]
        )

    def multiply(batches):
        held, numbers = {}, 0
        for batch in batches:
            for i, j, left, right in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "left", "right")), strict=True):
                product = np.frombuffer(left).reshape(-1, width[i]).T @ np.frombuffer(right).reshape(-1, width[j])
                if (i, j) in held:
                    held[i, j] += product
                    continue
                if numbers + product.size > HELD_NUMBERS:
                    yield told(held)
                    held, numbers = {}, 0
                held[i, j] = product
                numbers += product.size
        if held:
            yield told(held)

    def add(batches):
        key, total = None, None
        for batch in batches:
            for i, j, t in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "t")), strict=True):
                part = np.frombuffer(t).reshape(width[i], width[j])
                if key == (i, j):
                    total = total + part
                    continue
                if key:
                    yield told({key: total})
                key, total = (i, j), part
        if key:
            yield told({key: total})

    partial = pairs.select("i", "j", "left", "right").mapInArrow(multiply, "i int, j int, t binary")
    return partial.repartition("i", "j").sortWithinPartitions("i", "j").mapInArrow(add, "i int, j int, t binary")


def covariance(fit: DataFrame, n: int, sums: list[int], tile: int = TILE) -> np.ndarray:
    """The covariance, divisor n, of fit's vectors (x), of which there are n with these sums."""
    length = len(sums)
    centre = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n for s in sums], np.int64).astype(np.longdouble) / n  # what whole centres leave of the means, below 1
    products = np.zeros((length, length), np.longdouble)
    found = tiles(stored(column_blocks(fit, centre, tile), "blocks"), length, tile)
    for r in found.toLocalIterator():
        a, b = r.i * tile, r.j * tile
        t = np.frombuffer(r.t).reshape(min(tile, length - a), -1)
        products[a : a + t.shape[0], b : b + t.shape[1]] = t
        products[b : b + t.shape[1], a : a + t.shape[0]] = t.T
    return (products / n - np.outer(rest, rest)).astype(np.float64)


def _squares(gap: np.ndarray) -> pa.Array:
    """The sum of squares of each row of whole numbers, as decimals where 64 bits might not hold it."""
    top = int(np.abs(gap).max(initial=0))
    exact = (gap * gap).sum(1).tolist() if top * top * gap.shape[1] < 2**63 else [sum(int(g) * int(g) for g in row) for row in gap]
    return pa.array([pa.scalar(e, pa.decimal128(38, 0)) for e in exact], pa.decimal128(38, 0))


def whiten(embeddings: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error) for each row of embeddings (vec_id, embedding) and component.

    Rows whose vector is null, empty or holds a null or non-finite component are left out, as are those of another length than the
    commonest. Rows with one vec_id, or without, are told each; equal vectors are fitted once. Components along which the vectors don't vary
    (an eigenvalue within rounding of zero) can't be scaled and are left out, so a single vector gives no rows. The sign of a component is
    that which makes its largest entry positive. deviation is a decimal(38,0). Components of 2**34 and more in size fail. An empty table
    gives no rows; other columns are ignored.
    """
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    rows, length = finite(embeddings)

    def numbers(batches):
        for batch in batches:
            x = whole(batch.column(1), FACTOR, length, LARGEST) + OFFSET
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in x.astype("<i8")], pa.binary())], names=["vec_id", "x"])

    kept = stored(rows.select("vec_id", "v").mapInArrow(numbers, "vec_id long, x binary"), "whole")
    fit = stored(kept.select("x").distinct(), "fit")
    n = fit.count()
    if not n:
        return embeddings.sparkSession.createDataFrame([], schema)
    sums = _sums(fit, length)
    v = covariance(fit, n, sums, tile)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    trace = float(np.trace(v))
    rank = int((values > max(trace, 0) * length * 2.0**-50).sum())
    taken = min(components, rank)
    if not taken:
        return embeddings.sparkSession.createDataFrame([], schema)
    largest = np.abs(vectors).argmax(0)
    vectors = vectors * np.where(vectors[largest, np.arange(length)] < 0, -1.0, 1.0)
    scaled = vectors[:, :taken] / np.sqrt(values[:taken])
    centre = np.array([s // n for s in sums], np.int64)
    left = np.array([s % n for s in sums], np.int64)
    rest = left.astype(np.longdouble) / n

    def project(batch):
        z = _packed(batch, "x", length) - centre
        return z, (z - rest).astype(np.float64) @ scaled

    def moments(batches):
        """Sums of the whitened values and of their products: a row a task."""
        s, p = np.zeros(taken), np.zeros((taken, taken))
        for batch in batches:
            w = project(batch)[1]
            s += w.sum(0)
            p += w.T @ w
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([s, p.reshape(-1)]).tolist()], pa.list_(pa.float64()))], names=["s"])

    each = fit.mapInArrow(moments, "s array<double>").select(F.posexplode("s").alias("k", "s")).groupBy("k").agg(F.sum("s").alias("s"))
    flat = np.array([r.s for r in each.orderBy("k").collect()]) / n
    identity_error = float(np.abs(flat[taken:].reshape(taken, taken) - np.outer(flat[:taken], flat[:taken]) - np.eye(taken)).max())
    explained = [float(e / trace) for e in values[:taken]]

    def told(batches):
        for batch in batches:
            z, w = project(batch)
            top = max(int(np.abs(z).max(initial=0)), 1) * n + n
            gap = z * n - left if top < 2**63 else z.astype(object) * n - left.astype(object)
            each = np.repeat(np.arange(len(z)), taken)
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, taken + 1, dtype=np.int32), len(z))), pa.array(np.full(len(each), n)),
                 _squares(gap).take(pa.array(each)), pa.array(w.reshape(-1)), pa.array(np.tile(explained, len(z))), pa.array(np.full(len(each), identity_error))],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return kept.mapInArrow(told, schema)
