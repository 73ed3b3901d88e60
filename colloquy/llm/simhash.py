"""SimHash near-duplicates found by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into segments of 22, 21 and 21 bits (padded with zeros to 23). The binary
Golay code of length 23 is perfect: every word lies within three errors of exactly one codeword. Decoding a
segment and its 23 one-bit neighbours gives one codeword index or up to six; a segment that differs from it in one bit has
its own index among these. Three errors fall on three segments in one of three ways, and each has its keys:

* two segments without an error: both segments as they are (42 or 43 bits);
* one segment without and one with a single error: the first as it is and an index of the second (33 or 34 bits);
* one error in each: an index of each (36 bits), one side giving its own index of the first segment and the neighbouring ones of
  the others, the other side the reverse.

Candidates that share a key are compared in full, so nothing is missed and nothing else is linked.
"""

from __future__ import annotations

from itertools import combinations, permutations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .common import compared, components, in_cells, keyed, small, stored

SHINGLE_WORDS, SEED, MAX_BITS = 3, 42, 3
#: Fingerprints of one key that are compared in one step; larger buckets are split into pairs of chunks.
LARGEST_BUCKET = 8192
#: Segments as (first bit, width); generator polynomial of the Golay code, x^11 + x^9 + x^7 + x^6 + x^5 + x + 1.
SEGMENTS, GENERATOR = ((0, 22), (22, 21), (43, 21)), 0b101011100011


def fingerprint(text: str | None) -> int:
    """The 64-bit SimHash of a whole text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    if len(words) <= SHINGLE_WORDS:
        hashes = np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    else:
        joined = b" ".join(words)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        digest = xxhash.xxh64_intdigest
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts.tolist(), ends[SHINGLE_WORDS - 1 :].tolist(), strict=False)], np.uint64)
    ones = np.zeros(64, np.int64)
    octets = hashes.view(np.uint8).reshape(-1, 8)
    for a in range(0, len(octets), 65536):
        ones += np.unpackbits(octets[a : a + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


def _syndromes() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Remainders of the low 12 and the high 11 bits, and the error pattern of each remainder."""
    power = []
    r = 1
    for _ in range(23):
        power.append(r)
        r <<= 1
        if r >> 11:
            r ^= GENERATOR
    of = lambda bits: np.array([np.bitwise_xor.reduce([power[b] for b in bits if v >> (b - bits[0]) & 1] or [0]) for v in range(1 << len(bits))], np.int32)
    errors = np.zeros(2048, np.int32)
    for w in range(4):
        for bits in combinations(range(23), w):
            errors[np.bitwise_xor.reduce([power[b] for b in bits] or [0])] = sum(1 << b for b in bits)
    return of(range(12)), of(range(12, 23)), errors


_LOW, _HIGH, _ERRORS = _syndromes()


def codeword_index(words: np.ndarray) -> np.ndarray:
    """The 12-bit index of the codeword nearest to each 23-bit word."""
    return (words ^ _ERRORS[_LOW[words & 4095] ^ _HIGH[words >> 12]]) >> 11


def segment_indices(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(own index, the up to six indices of the word and its one-bit neighbours, filled up with -1), a row per word."""
    flips = np.concatenate(([0], 1 << np.arange(23))).astype(np.int32)
    near = codeword_index(words[:, None] ^ flips[None, :])
    own = near[:, 0].copy()
    near = np.sort(near, axis=1)
    near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
    return own.astype(np.int64), -np.sort(-near, axis=1)[:, :6].astype(np.int64)


def keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row number, key) for every key of every fingerprint; the highest bits tell which kind of key it is."""
    prints = prints.view(np.uint64)
    words = [((prints >> np.uint64(a)) & np.uint64((1 << w) - 1)).astype(np.int64) for a, w in SEGMENTS]
    (own, near) = zip(*(segment_indices(w.astype(np.int32)) for w in words), strict=True)
    rows, out = [], []

    def put(kind: int, value: np.ndarray, valid: np.ndarray) -> None:
        at = np.nonzero(valid)
        rows.append(at[0])
        out.append(value[at] | kind << 58)

    every = np.ones(len(prints), bool)
    for n, (i, j) in enumerate(combinations(range(3), 2)):
        put(n, words[i] << 22 | words[j], every)
    for n, (i, j) in enumerate(permutations(range(3), 2)):
        put(3 + n, words[i][:, None] << 12 | near[j], near[j] >= 0)
    put(9, own[0][:, None, None] << 24 | near[1][:, :, None] << 12 | near[2][:, None, :], (near[1] >= 0)[:, :, None] & (near[2] >= 0)[:, None, :])
    put(9, near[0] << 24 | (own[1] << 12 | own[2])[:, None], near[0] >= 0)
    return np.concatenate(rows), np.concatenate(out)


def _links(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect each cluster of fingerprints within three bits to one member; pairs aren't listed."""
    left = np.arange(len(prints))
    a, b = [], []
    while len(left) > 1:
        seed, left = left[0], left[1:]
        front = [seed]
        while front and len(left):
            near = np.bitwise_count(prints[left] ^ prints[front.pop()]) <= MAX_BITS
            if near.any():
                found = left[near]
                left = left[~near]
                a.append(found)
                b.append(np.full(len(found), seed))
                front.extend(found.tolist())
    return (np.concatenate(a), np.concatenate(b)) if a else (np.zeros(0, int), np.zeros(0, int))


def _edges(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])


def _compare(left: pa.RecordBatch, right: pa.RecordBatch | None) -> pa.RecordBatch:
    prints = np.concatenate([x.column("id").to_numpy(zero_copy_only=False) for x in (left, right) if x is not None]).view(np.uint64)
    a, b = _links(prints)
    return _edges(prints[a], prints[b])


def _compare_many(batch: pa.RecordBatch, bounds: np.ndarray, which: np.ndarray, few: int = 16) -> pa.RecordBatch:
    """Groups of up to `few` fingerprints by shifting the whole batch against itself, others one by one."""
    prints = batch.column("id").to_numpy(zero_copy_only=False).view(np.uint64)
    sizes = np.diff(bounds)
    group = np.repeat(np.arange(len(sizes)), sizes)
    a, b = [], []
    for shift in range(1, int(min(few, sizes[which].max(initial=1)))):
        i = np.flatnonzero((group[shift:] == group[:-shift]) & (sizes[group[shift:]] <= few))
        i = i[np.bitwise_count(prints[i] ^ prints[i + shift]) <= MAX_BITS]
        a.append(prints[i])
        b.append(prints[i + shift])
    for g in which[sizes[which] > few]:
        own = prints[bounds[g] : bounds[g + 1]]
        i, j = _links(own)
        a.append(own[i])
        b.append(own[j])
    none = np.zeros(0, np.uint64)
    return _edges(np.concatenate([none, *a]), np.concatenate([none, *b]))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp) for every row of docs; fp is the fingerprint's bits as a signed long."""

    def run(batches):
        for batch in batches:
            values = np.array([fingerprint(x) for x in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values.view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, fp long")


def fingerprint_classes(distinct: DataFrame, largest: int = LARGEST_BUCKET) -> DataFrame:
    """(node, root) for the fingerprints (column fp, distinct) linked to another, root the same within a class.

    Keys are counted before they are dealt out, so a key of any number of fingerprints is compared in blocks.
    """

    def run(batches):
        for batch in batches:
            fp = batch.column(0).to_numpy(zero_copy_only=False)
            for a in range(0, len(fp), 4096):
                part = fp[a : a + 4096]
                rows, key = keys(part)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(part[rows])], names=["bucket", "id"])

    rows = distinct.select("fp").mapInArrow(run, "bucket long, id long")
    crowded = stored(rows.groupBy("bucket").agg(F.count("*").alias("n")).where(F.col("n") > largest), "crowded")
    if crowded.head(1):
        counted = rows.join(small(crowded), "bucket", "left").withColumn("n", F.coalesce("n", F.lit(1)))
    else:
        counted = rows.withColumn("n", F.lit(1))
    return components(compared(in_cells(counted, largest), _compare, "a long, b long", largest, _compare_many))


def _classed(prints: DataFrame, first: Column, largest: int) -> DataFrame:
    """(fp, first): the least value of a column of prints (fp, ...) in the class of each fingerprint, nulls last."""
    one = stored(prints.groupBy("fp").agg(F.min(first).alias("first")), "distinct")
    classes = stored(fingerprint_classes(one, largest).withColumnRenamed("node", "fp"), "classes")
    rooted = one.join(classes, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = rooted.groupBy("root").agg(F.min("first").alias("first"))
    return rooted.select("fp", "root").join(lowest, "root").select("fp", "first")


def near_duplicates(docs: DataFrame, largest: int = LARGEST_BUCKET) -> DataFrame:
    """(doc_id, fingerprint, component_id) for every row of docs, which has doc_id and text.

    A null or wordless text has fingerprint zero and links like any other; a null doc_id takes part but can't
    be a component's name (a class of none but nulls gets null); repeated rows get a row each; an empty table gives no rows; other columns are
    ignored. Equal fingerprints are joined once, so copies cost no pairs.
    """
    prints = stored(fingerprints(docs), "fingerprints")
    named = _classed(prints, F.col("doc_id"), largest)
    return prints.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first").alias("component_id"))


@F.pandas_udf(LongType())
def _fingerprint(texts):
    return texts.map(lambda t: int(np.uint64(fingerprint(t)).astype(np.int64)))


def keep_first(docs: DataFrame, largest: int = LARGEST_BUCKET) -> DataFrame:
    """One row of docs for each group of near copies, columns unchanged: that with the smallest doc_id.

    Of rows that share the smallest doc_id, or all of which have none, one stays; a row without doc_id only stays where its group has
    no other. Null and wordless texts are one group. An empty table gives no rows. Columns of docs may have any names.
    """
    table, row, (fp,) = keyed(docs, fp=_fingerprint(F.col("text").cast("string")))
    id = F.col("doc_id").cast("long")
    prints = table.select(F.col(fp).alias("fp"), F.struct(id.isNull().alias("none"), id.alias("id"), F.col(row).alias("row")).alias("at"))
    kept = _classed(prints, F.col("at"), largest).select(F.col("first.row").alias(row)).distinct()
    return table.join(small(kept), row, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])
