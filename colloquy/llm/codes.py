"""Compression of vectors into codes: an index into a small codebook for each of sixteen parts.

Components become whole numbers, so codebooks and errors are exact and the same wherever a task runs. The nearest entry of a codebook is
found in two steps: a float32 matrix product screens all entries, with an interval around each value that holds the true one for certain;
the entries whose interval overlaps the best are computed again in int64, and ties go to the lower index. A round sends each task's sums per
entry through a shuffle, never vectors; only codebooks (64 entries) pass the driver.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small, stored
from .vectors import finite, whole

FACTOR, PARTS, ENTRIES, ROUNDS = 256, 16, 64, 2
#: Points that are screened at once.
STEP = 8192
#: Totals per label that are joined by broadcast at most: those of labels with over a thousandth of all rows.
HOT_LABELS = 1000


def bounds(length: int, parts: int) -> list[tuple[int, int]]:
    """Where the parts of a vector begin and end; as equal as can be where parts don't divide the length."""
    cuts = [p * length // parts for p in range(parts + 1)]
    return list(zip(cuts, cuts[1:], strict=False))


def largest_component(length: int) -> int:
    """Numbers below this keep every squared distance of whole vectors within 64 bits."""
    return int((2**62 / max(length, 1)) ** 0.5) // 2


def nearest(points: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nearest row of book to each row of points, the lower on ties, and the squared distance. Both are int64 matrices.

    A squared distance is |p|^2 + |c|^2 - 2 p.c; |p|^2 is the same for all entries. In float32 a dot product of w terms, in any order
    of its sums, with both factors rounded first, is off by at most g |p||c|, where g = k u / (1 - k u), k = w + 2, u = 2^-24. Other steps are
    taken in float64, whose rounding the last term covers.
    """
    if not book.shape[1]:
        return np.zeros(len(points), np.int64), np.zeros(len(points), np.int64)
    low, high = book.min(0), book.max(0)
    centre = low + (high - low) // 2  # distances don't depend on it, rounding does
    c = book - centre
    norms = (c.astype(np.float64) ** 2).sum(1)
    lengths = np.sqrt(norms) * (1 + 2**-40)
    k = (book.shape[1] + 2) * 2.0**-24
    g = 2 * k / (1 - k) * (1 + 2**-20) + 2.0**-48
    narrow = c.astype(np.float32).T.copy()
    index, distance = np.empty(len(points), np.int64), np.empty(len(points), np.int64)
    for s in range(0, len(points), STEP):
        p = points[s : s + STEP] - centre
        own = np.sqrt((p.astype(np.float64) ** 2).sum(1)) * (1 + 2**-40)
        value = norms - 2.0 * (p.astype(np.float32) @ narrow)
        margin = g * own[:, None] * lengths + 2.0**-48 * norms
        open_ = value - margin <= (value + margin).min(1)[:, None]
        best = open_.argmax(1)
        several = np.flatnonzero(open_.sum(1) > 1)
        if len(several):
            row, entry = np.nonzero(open_[several])
            exact = ((p[several[row]] - c[entry]) ** 2).sum(1)
            starts = np.searchsorted(row, np.arange(len(several)))
            least = np.minimum.reduceat(exact, starts)
            hit = np.flatnonzero(exact == least[row])
            best[several] = entry[hit[np.searchsorted(row[hit], np.arange(len(several)))]]
        index[s : s + STEP] = best
        distance[s : s + STEP] = ((p - c[best]) ** 2).sum(1)
    return index, distance


def _with_totals(rows: DataFrame, value: str, total: str) -> DataFrame:
    """rows with the sum of value over rows of the same label, nulls together. Labels with many rows are joined by broadcast, so none of them fills a task."""
    rows = rows.withColumns({"_none": F.col("label").isNull(), "_label": F.coalesce(F.col("label").cast("string"), F.lit(""))})
    key = ["_none", "_label"]
    totals = stored(rows.groupBy(key).agg(F.sum(value).alias(total), F.count("*").alias("_n")), "totals")
    if totals.count() <= HOT_LABELS:
        out = rows.join(F.broadcast(totals.drop("_n")), key)
    else:
        least = totals.agg(F.sum("_n")).head()[0] // HOT_LABELS
        hot = F.broadcast(totals.where(F.col("_n") > least).drop("_n"))
        rest = rows.join(hot, key, "left_anti").join(small(totals.where(F.col("_n") <= least).drop("_n")), key)
        out = rows.join(hot, key).unionByName(rest)
    return out.drop(*key)


def codebooks(rows: DataFrame, length: int, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> list[np.ndarray]:
    """The codebook of each part, an int64 matrix with a row per entry, from rows (vec_id, v) of finite()."""
    cuts, most = bounds(length, parts), largest_component(length)
    scaled = F.transform("v", lambda x: F.floor(x * FACTOR))
    first = [r[0] for r in rows.where("vec_id IS NOT NULL").select("vec_id", scaled.alias("x")).orderBy("vec_id", "x").limit(entries).select("x").collect()]
    if len(first) < entries:
        more = rows.where("vec_id IS NULL").select(scaled.alias("x")).orderBy("x").limit(entries - len(first)).collect()
        first += [r[0] for r in more]
    start = np.array(first, np.int64).reshape(-1, length)
    books = [start[:, a:b] for a, b in cuts]
    for _ in range(rounds):

        def summed(batches, books=books):
            counts = np.zeros((parts, len(start)), np.int64)
            sums = np.zeros((len(start), length), np.int64)
            for batch in batches:
                x = whole(batch.column(0), FACTOR, length, most)
                for p, (a, b) in enumerate(cuts):
                    index, _ = nearest(x[:, a:b], books[p])
                    counts[p] += np.bincount(index, minlength=len(start))
                    np.add.at(sums[:, a:b], index, x[:, a:b])
            p, e = np.nonzero(counts)
            if len(p):
                own = [sums[j, cuts[i][0] : cuts[i][1]] for i, j in zip(p, e, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(e, pa.int32()), pa.array(counts[p, e]), pa.array([o.tolist() for o in own], pa.list_(pa.int64()))], names=["part", "entry", "n", "s"])

        partial = rows.select("v").mapInArrow(summed, "part int, entry int, n long, s array<long>")
        each = partial.select("part", "entry", "n", F.posexplode_outer("s").alias("at", "s")).groupBy("part", "entry", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
        books = [b.copy() for b in books]
        for r in each.where("at IS NOT NULL").collect():  # parts x entries x their width: as many numbers as the codebooks have
            books[r.part][r.entry, r.at] = r.s // r.n
    return books


def compress(embeddings: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> DataFrame:
    """(vec_id, code, error, label_error, codebooks_sha256) for each row of embeddings (vec_id, embedding, label) with a whole vector.

    Rows whose vector is null, empty or holds a null or non-finite component are left out, as are those of another length than the commonest.
    Rows with one vec_id are coded each; ties for the first entries go to the lesser vector, rows without vec_id come last. Under `entries` rows give as many entries.
    Null labels count as one label. Parts of a length that `parts` doesn't divide differ by one; those without components have
    index 0. Components so large that a squared distance exceeds 64 bits fail. An empty table gives no rows; other columns are ignored.
    """
    rows, length = finite(embeddings, "label")
    cuts, most = bounds(length, parts), largest_component(length)
    books = codebooks(rows, length, parts, entries, rounds) if length else []
    digest = hashlib.sha256(",".join(str(x) for b in books for x in b.reshape(-1).tolist()).encode()).hexdigest()

    def coded(batches):
        for batch in batches:
            x = whole(batch.column(2), FACTOR, length, most)
            found = [nearest(x[:, a:b], books[p]) for p, (a, b) in enumerate(cuts)]
            codes = np.stack([i for i, _ in found], 1).astype(np.uint8 if entries <= 256 else ">u2")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([c.tobytes().hex() for c in codes], pa.string()), pa.array(sum(d for _, d in found))], names=["vec_id", "label", "code", "error"]
            )

    label = embeddings.schema["label"].dataType.simpleString()
    out = stored(rows.select("vec_id", "label", "v").mapInArrow(coded, f"vec_id long, label {label}, code string, error long"), "coded")
    return _with_totals(out, "error", "label_error").select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


#: The same in SQL, for tables of a size where every entry of every codebook can be tried.
_ROUND = """
d{n} AS (SELECT c.row_id, c.part, b.entry, sum((c.x - b.x) * (c.x - b.x)) AS d FROM comps c JOIN book{n} b USING (part, k) GROUP BY ALL),
near{n} AS (SELECT row_id, part, arg_min(entry, (d, entry)) AS entry, min(d) AS d FROM d{n} GROUP BY ALL),
"""
_UPDATE = """
sums{m} AS (SELECT c.part, a.entry, c.k, sum(c.x)::BIGINT AS s, count(*) AS n FROM comps c JOIN near{n} a USING (row_id, part) GROUP BY ALL),
book{m} AS (SELECT b.part, b.entry, b.k, CASE WHEN s.n IS NULL THEN b.x ELSE (s.s - (s.s % s.n + s.n) % s.n) // s.n END AS x FROM book{n} b LEFT JOIN sums{m} s USING (part, entry, k)),
"""
SQL = (
    f"""
WITH kept AS (
  SELECT vec_id, label, embedding, row_number() OVER (ORDER BY vec_id NULLS LAST, [floor({FACTOR} * x::DOUBLE) FOR x IN embedding]) AS row_id, len(embedding) // {PARTS} AS w FROM embeddings
  WHERE len(embedding) > 0 AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
flat AS (SELECT row_id, w, unnest(range(len(embedding))) AS i, unnest(embedding) AS x FROM kept),
comps AS (SELECT row_id, i // w AS part, i % w AS k, floor({FACTOR} * x::DOUBLE)::BIGINT AS x FROM flat),
book0 AS (SELECT part, row_id - 1 AS entry, k, x FROM comps WHERE row_id <= {ENTRIES}),
"""
    + "".join(_ROUND.format(n=n) + _UPDATE.format(n=n, m=n + 1) for n in range(ROUNDS))
    + _ROUND.format(n=ROUNDS)
    + f"""
digest AS (SELECT sha256(string_agg(x, ',' ORDER BY part, entry, k)) AS codebooks_sha256 FROM book{ROUNDS}),
rows AS (SELECT row_id, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM near{ROUNDS} GROUP BY ALL)
SELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM rows JOIN kept USING (row_id), digest
"""
)
