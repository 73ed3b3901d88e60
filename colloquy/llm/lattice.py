"""Embedding near-duplicates by lattice hashing.

Each table projects unit vectors to eight random orthonormal directions and decodes the scaled projection to
the nearest point of the E8 lattice; a label with many vectors takes two or three such codes of other directions together, so that cells get finer as it grows and the number of unlike vectors that
a vector meets stays small. A vector goes to its own lattice cell and to the neighbouring cells it is closest to, in every table. Cells are counted first; only those with two vectors
or more get the vectors, of cells with the same vectors one, and large ones are dealt out in blocks. Vectors of one label that share a cell are compared by cosine in double
precision, each pair in one cell only, so that links are counted exactly once.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations, product

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import compared, components, dropped, in_cells, small, stored

MIN_COSINE = 0.93
PROBES, SEED = 3, 20


@dataclass(frozen=True)
class Level:
    """How vectors of a label are hashed: the lattice codes that make up a key, tables, scale, and keys a vector has in a table; and the vectors up to which a label takes it."""

    codes: int
    tables: int
    scale: float
    keys: int
    most: int | None


#: Measured at cosines of 0.93 to 0.95 in 64 and 768 dimensions: each level finds 0.97 or more of the pairs; unlike vectors meet 8e-3, 3e-5 and 1e-6 times.
LEVELS = (Level(1, 5, 4.6, 4, 4096), Level(2, 5, 4.0, 8, 1 << 20), Level(3, 8, 3.4, 12, None))
#: Vectors of one cell that are compared in one step; larger cells are split into pairs of chunks.
LARGEST_BUCKET = 2048


def roots() -> np.ndarray:
    """The 240 shortest vectors of E8: steps from a lattice point to its neighbours."""
    out = [[s * (k == i) + t * (k == j) for k in range(8)] for i, j in combinations(range(8), 2) for s in (1, -1) for t in (1, -1)]
    out += [[x / 2 for x in signs] for signs in product((1, -1), repeat=8) if np.prod(signs) == 1]
    return np.array(out, float)


def nearest_points(y: np.ndarray) -> np.ndarray:
    """The nearest E8 point to each row: the better of the nearest in D8 and in D8 shifted by a half."""

    def d8(z):
        r = np.rint(z)
        gap = z - r
        odd = np.flatnonzero(r.sum(1) % 2 != 0)
        worst = np.abs(gap[odd]).argmax(1)
        r[odd, worst] += np.where(gap[odd, worst] >= 0, 1.0, -1.0)
        return r

    a, b = d8(y), d8(y - 0.5) + 0.5
    closer = ((y - a) ** 2).sum(1) <= ((y - b) ** 2).sum(1)
    return np.where(closer[:, None], a, b)


def projections(dim: int, count: int, seed: int = SEED) -> list[np.ndarray]:
    """Orthonormal projections to eight dimensions, scaled so that lengths stay comparable across dimensions."""
    rng = np.random.default_rng(seed)
    return [np.linalg.qr(rng.standard_normal((max(dim, 8), 8)))[0][:dim] * np.sqrt(dim / 8) for _ in range(count)]


def _codes(y: np.ndarray, probes: int, mix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of each row's own lattice point and of its closest neighbours, and how much further from the row each of them lies."""
    steps = roots()
    own = nearest_points(y)
    along = (y - own) @ steps.T
    order = np.argpartition(-along, probes, axis=1)[:, :probes] if probes else np.zeros((len(y), 0), int)
    near = np.concatenate([own[:, None, :], own[:, None, :] + steps[order]], axis=1)
    further = np.concatenate([np.zeros((len(y), 1)), 2 - 2 * np.take_along_axis(along, order, 1)], axis=1)
    return (np.rint(near * 2).astype(np.int64).view(np.uint64) * mix).sum(2), further


def cells(x: np.ndarray, label: np.ndarray, level: Level, probes: int = PROBES) -> np.ndarray:
    """Bucket numbers of unit vectors, a row per vector: in each table the level's number of combinations of its codes and their neighbours, the closest ones."""
    mix = np.random.default_rng(SEED + 1).integers(1, 2**63, 11, dtype=np.uint64) | np.uint64(1)
    combos = np.array(list(product(range(probes + 1), repeat=level.codes)))
    planes = projections(x.shape[1], level.codes * level.tables, SEED + 2 * level.codes)
    out = []
    for t in range(level.tables):
        found = [_codes(x @ p * level.scale / 2, probes, mix[:8]) for p in planes[t * level.codes : (t + 1) * level.codes]]
        further = sum(f[:, combos[:, k]] for k, (_, f) in enumerate(found))
        chosen = np.argsort(further, axis=1, kind="stable")[:, : level.keys]
        key = np.zeros(chosen.shape, np.uint64)
        for k, (code, _) in enumerate(found):
            key = key * mix[10] + np.take_along_axis(code, combos[chosen][:, :, k], 1)
        key += label.astype(np.int64).view(np.uint64)[:, None] * mix[8] + mix[9:10] * np.array([t + 1 + 64 * level.codes], np.uint64)
        key ^= key >> np.uint64(29)
        out.append(key * mix[9])
    return np.concatenate(out, axis=1).view(np.int64)


def _compare(min_cosine: float):
    def pairs(a, b, ka, kb, bucket, same):
        """New links (rows of a, rows of b) in blocks; a pair counts in the least key that both have."""
        edges = []
        for s in range(0, len(a), 512):
            for u in range(s if same else 0, len(b), 512):
                near = a[s : s + 512] @ b[u : u + 512].T >= min_cosine
                if same and u == s:
                    near = np.triu(near, 1)
                i, j = np.nonzero(near)
                for w in range(0, len(i), 65536):
                    p, q = s + i[w : w + 65536], u + j[w : w + 65536]
                    first = _meet_first(ka[p], kb[q], np.full(len(p), bucket))
                    edges.append((p[first], q[first]))
        return edges

    def read(batch):
        x = np.frombuffer(b"".join(batch.column("v").to_pylist()), np.float64).reshape(batch.num_rows, -1)
        return batch.column("id").to_numpy(zero_copy_only=False), x, batch.column("keys"), batch.column("copies").to_numpy(zero_copy_only=False)

    def told(ids, copies, i, j):
        """Each linked row's links, counted with the copies of the partner, and one partner; a forest is enough for the components."""
        links = np.bincount(i, copies[j], len(ids)) + np.bincount(j, copies[i], len(ids))
        root = _forest(len(ids), i, j)
        hit = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_arrays([pa.array(ids[hit]), pa.array(links[hit].astype(np.int64)), pa.array(ids[root[hit]])], names=["a", "links", "b"])

    def compare(left, right):
        bucket = left.column("bucket")[0].as_py()
        ia, xa, ka, ca = read(left)
        ib, xb, kb, cb = (ia, xa, ka, ca) if right is None else read(right)
        edges = pairs(xa, xb, _padded(ka, 0), _padded(kb, 1), bucket, right is None)
        if not edges:
            return None
        both = right is not None
        i = np.concatenate([e[0] for e in edges])
        j = np.concatenate([e[1] for e in edges]) + both * len(ia)
        return told(np.concatenate([ia, ib]) if both else ia, np.concatenate([ca, cb]) if both else ca, i, j)

    def compare_many(batch, bounds, which, few=24):
        """Groups of up to `few` vectors by shifting the whole batch against itself, others one by one; all their links in one batch."""
        ids, copies, bucket = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "copies", "bucket"))
        sizes = np.diff(bounds)
        group = np.repeat(np.arange(len(sizes)), sizes)
        raw = batch.column("v").to_pylist()
        if len({len(v) for v in raw}) > 1:
            few = 0
        edges = []
        if few and (sizes[which] <= few).any():
            x = np.frombuffer(b"".join(raw), np.float64).reshape(batch.num_rows, -1)
            ka, kb = _padded(batch.column("keys"), 0), _padded(batch.column("keys"), 1)
            for shift in range(1, int(min(few, sizes[which].max()))):
                i = np.flatnonzero((group[shift:] == group[:-shift]) & (sizes[group[shift:]] <= few))
                for s in range(0, len(i), 65536):
                    p = i[s : s + 65536]
                    p = p[np.einsum("ij,ij->i", x[p], x[p + shift]) >= min_cosine]
                    p = p[_meet_first(ka[p], kb[p + shift], bucket[p])]
                    edges.append((p, p + shift))
        for g in which[sizes[which] > few]:
            block = batch.slice(bounds[g], sizes[g])
            own = _padded(block.column("keys"), 0), _padded(block.column("keys"), 1)
            vectors = np.frombuffer(b"".join(raw[bounds[g] : bounds[g + 1]]), np.float64).reshape(sizes[g], -1)
            edges += [(bounds[g] + i, bounds[g] + j) for i, j in pairs(vectors, vectors, *own, int(bucket[bounds[g]]), True)]
        if not edges:
            return None
        return told(ids, copies, np.concatenate([e[0] for e in edges]), np.concatenate([e[1] for e in edges]))

    return compare, compare_many


def _padded(keys, side: int) -> np.ndarray:
    """Lists of keys as a matrix, filled up with a number that the other side doesn't have."""
    ends = keys.offsets.to_numpy() - keys.offsets[0].as_py()
    flat = keys.flatten().to_numpy(zero_copy_only=False)
    sizes = np.diff(ends)
    out = np.full((len(sizes), int(sizes.max(initial=1))), np.iinfo(np.int64).max - side)
    out[np.repeat(np.arange(len(sizes)), sizes), np.arange(len(flat)) - np.repeat(ends[:-1], sizes)] = flat
    return out


def _meet_first(x: np.ndarray, y: np.ndarray, bucket: np.ndarray) -> np.ndarray:
    """Whether rows of x and y, keys in rising order, share no key that is less than bucket."""
    first = np.ones(len(x), bool)
    left = np.arange(len(x))
    for n in range(x.shape[1]):
        left = left[x[left, n] < bucket[left]]
        if not len(left):
            break
        shared = (y[left] == x[left, n][:, None]).any(1)
        first[left[shared]] = False
        left = left[~shared]
    return first


def _forest(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """The smallest index of each node's component, by repeated minimum over the edges."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[i], root[j])
        before = root.copy()
        np.minimum.at(root, i, low)
        np.minimum.at(root, j, low)
        root = root[root]
        if (before == root).all():
            return root


def usable(embeddings: DataFrame) -> DataFrame:
    """(id, label, v): unit vectors as packed doubles, of the rows that may link."""

    def run(batches):
        for batch in batches:
            vectors = batch.column(2)
            ends = vectors.offsets.to_numpy()
            sizes = np.diff(ends)
            flat = vectors.values.to_numpy(zero_copy_only=False)  # nulls become NaN
            good = ~(vectors.is_null().to_numpy(zero_copy_only=False) | batch.column(0).is_null().to_numpy(zero_copy_only=False) | batch.column(1).is_null().to_numpy(zero_copy_only=False))
            ids, labels, out = [], [], []
            for size in np.unique(sizes[good & (sizes > 0)]):
                at = np.flatnonzero(good & (sizes == size))
                x = flat[ends[at][:, None] + np.arange(size)[None, :]]
                with np.errstate(all="ignore"):
                    top = np.abs(x).max(1)
                    real = np.isfinite(top) & (top > 0)
                    at, x = at[real], x[real] / top[real][:, None]
                x /= np.sqrt((x * x).sum(1))[:, None]
                ids.append(batch.column(0).take(pa.array(at)))
                labels.append(batch.column(1).take(pa.array(at)))
                out.append(pa.array([v.tobytes() for v in x], pa.binary()))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.concat_arrays(labels), pa.concat_arrays(out)], names=["id", "label", "v"])

    rows = embeddings.select(F.col("vec_id").cast("long"), F.col("label").cast("long"), F.col("embedding").cast("array<double>"))
    return rows.mapInArrow(run, "id long, label long, v binary")


def _with_level(one: DataFrame, levels: tuple[Level, ...]) -> DataFrame:
    """one with the number of its label's level, by the label's counted size. Labels of the first level are not joined, so the other side has a row per thousands of vectors."""
    sizes = one.groupBy("label").agg(F.count("*").alias("_size"))
    level = F.lit(len(levels) - 1)
    for n in range(len(levels) - 2, -1, -1):
        level = F.when(F.col("_size") <= levels[n].most, n).otherwise(level)
    large = small(stored(sizes.where(F.col("_size") > (levels[0].most or 0)).select("label", level.alias("level")), "levels")) if len(levels) > 1 else None
    if large is None:
        return one.withColumn("level", F.lit(0))
    return one.join(large, "label", "left").withColumn("level", F.coalesce("level", F.lit(0)))


def bucketed(one: DataFrame, levels: tuple[Level, ...] = LEVELS, probes: int = PROBES) -> DataFrame:
    """(bucket, id): the cells of the vectors one (label, v, no)."""

    def spread(batches):
        for batch in batches:
            vectors, labels, ids, level = batch.column(0).to_pylist(), *(batch.column(n).to_numpy(zero_copy_only=False) for n in (1, 2, 3))
            lengths = np.array([len(v) for v in vectors])
            for size, which in sorted(set(zip(lengths.tolist(), level.tolist(), strict=True))):
                at = np.flatnonzero((lengths == size) & (level == which))
                for s in range(0, len(at), 2048):
                    part = at[s : s + 2048]
                    x = np.frombuffer(b"".join(vectors[n] for n in part), np.float64).reshape(len(part), -1)
                    keys = cells(x, labels[part] * 4099 + size, levels[which], probes)
                    yield pa.RecordBatch.from_arrays([pa.array(keys.reshape(-1)), pa.array(np.repeat(ids[part], keys.shape[1]))], names=["bucket", "id"])

    return _with_level(one, levels).select("v", "label", "no", "level").mapInArrow(spread, "bucket long, id long")


def near_duplicates(embeddings: DataFrame, min_cosine: float = MIN_COSINE, levels: tuple[Level, ...] = LEVELS, probes: int = PROBES, largest: int = LARGEST_BUCKET) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row of embeddings (vec_id, embedding, label).

    Null vectors, zero vectors, vectors that hold null or non-finite components, and rows without label or
    vec_id link with nothing: no links, their own component. Vectors of unlike lengths don't link. Equal
    vectors of a label are compared once and counted with their number. Rows with the same vec_id are
    counted as vectors of their own but share a row's result. An empty table gives no rows. Other columns are ignored.
    """
    units = stored(usable(embeddings), "units")
    one = units.groupBy("label", "v").agg(F.min("id").alias("id"), F.count("*").alias("copies"))
    # two vectors of one vec_id stay apart by a number of their own
    one = stored(one.withColumn("no", F.monotonically_increasing_id()), "vectors")
    keys = stored(bucketed(one, levels, probes), "keys")
    # of cells with the same vectors one is enough: told by their number and two sums of bits
    marks = [F.bit_xor(F.xxhash64("id", F.lit(n))).alias(f"x{n}") for n in (1, 2)]
    sizes = keys.groupBy("bucket").agg(F.count("*").alias("n"), *marks).where("n > 1").groupBy("n", "x1", "x2").agg(F.min("bucket").alias("bucket"))
    sizes = stored(sizes.select("bucket", "n"), "sizes")
    # a vector has a table's number of keys for each, so these lists are short
    shared = keys.join(sizes, "bucket").groupBy("id").agg(F.collect_list(F.struct("bucket", "n")).alias("b"))
    held = one.select(F.col("no").alias("id"), "copies", "v").join(shared, "id").withColumn("keys", F.array_sort(F.transform("b", lambda x: x["bucket"])))
    rows = held.select(F.explode("b").alias("x"), "id", "copies", "v", "keys").select("x.bucket", "x.n", "id", "copies", "v", "keys")
    compare, compare_many = _compare(min_cosine)
    found = stored(compared(in_cells(rows, largest), compare, "a long, links long, b long", largest, compare_many), "found")
    links = found.groupBy("a").agg(F.sum("links").alias("links"))
    # components by number, then named by the least vec_id
    classes = components(found.select("a", "b"))
    per = (
        one.select("label", "v", "id", "copies", "no").join(links.withColumnRenamed("a", "no"), "no", "left").join(classes.withColumnRenamed("node", "no"), "no", "left")
        .select("label", "v", "id", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("root", "no").alias("root"))
    )
    per = stored(per, "linked")
    least = per.groupBy("root").agg(F.min("id").alias("name"))
    each = units.join(per.join(least, "root").select("label", "v", "n_links", "name"), ["label", "v"]).groupBy("id").agg(F.max("n_links").alias("n_links"), F.min("name").alias("root"))
    dropped(keys)
    dropped(sizes)
    dropped(found)
    ids = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"))
    out = ids.join(each.withColumnRenamed("id", "vec_id"), "vec_id", "left")
    return out.select(
        "vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("root", "vec_id").alias("component_id"),
        F.coalesce(F.coalesce("root", "vec_id") == F.col("vec_id"), F.lit(True)).alias("kept"),
    )
