"""Exact repeated-substring removal with a sparse suffix array built by a common-prefix-aware distributed merge sort.

Every 200-byte string has an anchor: the start of its least hashed 32-byte substring, which depends on the string's
content alone, so equal strings have equal anchors. Neighbouring strings share anchors; a block is a run of
starts with one anchor. Blocks whose anchor substring occurs once in the corpus can't repeat and go no further.
Equal blocks repeat as a whole and are represented once. Where blocks of one anchor differ, the suffixes that start at
the anchors are sorted: each task sorts its own and front-codes them as runs (common prefix length and rest), the
runs are exchanged in parts of bounded size, and a loser tree that carries common prefix lengths merges them without comparing a known prefix
again. The common prefixes of neighbours and the bytes before the anchors tell which starts repeat.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_group, dropped, hash_tables, small, stir, stored

LENGTH, CORE = 200, 32
#: Bytes of suffixes merged by one task, about.
PART_BYTES = 4 << 20
#: Starts of CORE-byte substrings in a LENGTH-byte string.
SPAN = LENGTH - CORE + 1
#: Bytes of text hashed at once (long texts are cut with an overlap), bytes of a run, suffixes of one anchor in a task.
BATCH_BYTES, RUN_BYTES, LARGEST_GROUP = 1 << 18, 8_000_000, 4096
_POSITION = np.uint64((1 << 24) - 1)

_OCTETS, _MIX = hash_tables(7)


def blocks(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, ...]:
    """(text number, first start, starts, anchor minus first start, anchor hash, block hash) of every block."""
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    none = tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.int64, np.int64, np.uint64, np.uint64))
    if len(data) < length:
        return none
    span = length - CORE + 1
    h = _OCTETS[data]
    step = 1
    while step < CORE:
        h = h[:-step] * _MIX[step.bit_length() + 1] + h[step:]
        step *= 2
    h = stir(h, _MIX)
    low = (h & ~_POSITION) | np.arange(len(h), dtype=np.uint64)
    wide = 1
    while wide * 2 <= span:
        low = np.minimum(low[:-wide], low[wide:])
        wide *= 2
    if span > wide:
        low = np.minimum(low[: len(low) - (span - wide)], low[span - wide :])
    anchor = (low & _POSITION).astype(np.int64)
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(texts)), sizes)[: len(anchor)]
    valid = np.arange(len(anchor)) + length <= ends[owner]
    fresh = np.ones(len(anchor), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (owner[1:] != owner[:-1])
    lo = np.flatnonzero(fresh & valid)
    if not len(lo):
        return none
    # a block ends before the next fresh or invalid start
    stop = np.flatnonzero(fresh | ~valid)
    stop = np.append(stop, len(anchor))
    hi = stop[np.searchsorted(stop, lo, "right")] - 1
    a = anchor[lo]

    def whole(p):
        out = np.full(len(p), length, np.uint64)
        for off in [*range(0, length - CORE, CORE), length - CORE]:
            out = (out ^ h[p + off]) * _MIX[8]
            out ^= out >> np.uint64(33)
        return out

    own = stir(whole(lo) * _MIX[9] + whole(hi) * _MIX[10] + ((hi - lo + 1) << 20 | (a - lo)).astype(np.uint64) * _MIX[11], _MIX)
    n = owner[lo]
    base = (ends - sizes)[n]
    return n, lo - base, hi - lo + 1, a - lo, h[a], own


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))


def _name(text: str) -> Column:
    """A text's name: 128 bits of its SHA-256, so unlike texts have unlike names."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def _named(docs: DataFrame) -> DataFrame:
    """text with its name and the number of bytes."""
    return _texts(docs).select(_name("text").alias("tid"), F.octet_length("text").alias("n_bytes"), F.col("text").cast("binary").alias("raw"), "doc_id")


def block_rows(docs: DataFrame) -> DataFrame:
    """(akey, bhash, tid, place) of every block; place packs first start, starts and anchor offset."""

    def run(batches):
        for batch in batches:
            tids, sizes, raws = batch.column(0), batch.column(1).to_numpy(zero_copy_only=False), batch.column(2)
            group, held, members = [], 0, []
            for n in range(batch.num_rows):
                if sizes[n] < LENGTH:
                    continue
                raw = raws[n].as_py()
                for at in range(0, max(1, len(raw) - LENGTH + 1), BATCH_BYTES):
                    part = raw[at : at + BATCH_BYTES + LENGTH - 1]
                    group.append(part)
                    members.append((n, at))
                    held += len(part)
                    if held >= BATCH_BYTES:
                        yield _block_batch(group, members, tids)
                        group, held, members = [], 0, []
            if group:
                yield _block_batch(group, members, tids)

    return _named(docs).mapInArrow(run, "akey long, bhash long, tid binary, place long")


def _block_batch(group, members, tids) -> pa.RecordBatch:
    n, lo, count, off, akey, own = blocks(group)
    row, at = np.array(members, np.int64).T
    place = (lo + at[n]) << 16 | count << 8 | off
    return pa.RecordBatch.from_arrays(
        [pa.array(akey.view(np.int64)), pa.array(own.view(np.int64)), tids.take(pa.array(row[n])), pa.array(place)],
        names=["akey", "bhash", "tid", "place"],
    )


# -- runs and their merge -------------------------------------------------------------------------


def common_prefix(a: bytes, b: bytes, known: int = 0) -> int:
    """Length of the common prefix, given that the first `known` bytes are equal."""
    most = min(len(a), len(b))
    while known + 16 <= most and a[known : known + 16] == b[known : known + 16]:
        known += 16
    while known < most and a[known] == b[known]:
        known += 1
    return known


def write_run(entries: list[tuple[bytes, bytes]]) -> bytes:
    """Front-code (suffix, payload) entries in sorted order: prefix length shared with the entry before, rest, payload."""
    out, before = [], b""
    for suffix, payload in sorted(entries):
        shared = common_prefix(before, suffix)
        out.append(struct.pack("<HHH", shared, len(suffix) - shared, len(payload)) + suffix[shared:] + payload)
        before = suffix
    return b"".join(out)


def read_run(run: bytes) -> Iterator[tuple[int, bytes, bytes]]:
    """(prefix length shared with the entry before, suffix, payload) in order."""
    at, before = 0, b""
    while at < len(run):
        shared, rest, size = struct.unpack_from("<HHH", run, at)
        at += 6
        before = before[:shared] + run[at : at + rest]
        at += rest
        yield shared, before, run[at : at + size]
        at += size


def merge_runs(runs: list[bytes]) -> Iterator[tuple[int, bytes, bytes]]:
    """Merge front-coded runs with a loser tree: (prefix shared with the suffix before, suffix, payload), sorted.

    Each loser keeps its common prefix with the last winner. A challenger that shares more of it is smaller
    without a look; only equal lengths are compared, from that length on.
    """
    sources = [read_run(r) for r in runs]
    k = 1
    while k < len(sources):
        k *= 2
    heads: list = [next(s, None) for s in sources] + [None] * (k - len(sources))
    shared = [0] * k
    loser = [-1] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser) of two leaves whose lengths are counted against the same last winner."""
        x, y = heads[a], heads[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if shared[a] != shared[b]:
            return (a, b) if shared[a] > shared[b] else (b, a)
        p, q = x[1], y[1]
        n = common_prefix(p, q, shared[a])
        if n == len(p) or (n < len(q) and p[n] < q[n]):
            shared[b] = n
            return a, b
        shared[a] = n
        return b, a

    def build(node: int) -> int:
        if node >= k:
            return node - k
        won, loser[node] = play(build(2 * node), build(2 * node + 1))
        return won

    winner = build(1) if k > 1 else 0
    while heads[winner] is not None:
        _, suffix, payload = heads[winner]
        yield shared[winner], suffix, payload
        heads[winner] = head = next(sources[winner], None)
        shared[winner] = head[0] if head else 0
        node = (winner + k) // 2
        while node:
            winner, loser[node] = play(winner, loser[node])
            node //= 2


def repeated_starts(group: list[tuple[int, bytes, bytes, int, int]], length: int = LENGTH) -> list[int]:
    """For sorted suffixes of one anchor, each (shared, suffix, before, first, starts): a bit mask of repeated starts.

    `shared` is the prefix length common with the suffix before; `before` the bytes from the block's first start to the
    anchor. A start that lies L bytes before the anchor repeats if another entry has the same L bytes before its
    anchor and the same length - L bytes from it on.
    """
    masks = [0] * len(group)
    if len(group) == 2:
        (_, _, b0, _, c0), (shared, _, b1, _, c1) = group
        back = common_prefix(b0[::-1], b1[::-1])
        for L in range(max(0, length - shared), back + 1):
            k0, k1 = len(b0) - L, len(b1) - L
            if k0 < c0 and k1 < c1:
                masks[0] |= 1 << k0
                masks[1] |= 1 << k1
        return masks
    for L in range(max(len(e[2]) for e in group) + 1):
        seen: dict = {}
        segment = 0
        for j, (shared, _, before, _, count) in enumerate(group):
            if j and shared < length - L:
                segment += 1
            k = len(before) - L
            if 0 <= k < count:
                key = (segment, before[k:])
                if key in seen:
                    masks[j] |= 1 << k
                    i = seen[key]
                    masks[i] |= 1 << (len(group[i][2]) - L)
                else:
                    seen[key] = j
    return masks


# -- the job --------------------------------------------------------------------------------------


def _suffix_runs(joined: DataFrame, parts: int) -> DataFrame:
    """(part, run): sorted, front-coded runs of the anchor suffixes of each text's listed blocks; (akey, bhash, whole) of those that are hot."""

    def run(batches):
        held, size, hot = {}, 0, []
        for batch in batches:
            for raw, listed in zip(batch.column(0), batch.column(1).to_pylist(), strict=True):
                raw = raw.as_py()
                for x in listed:
                    akey, bhash, place = x["akey"], x["bhash"], x["place"]
                    lo, count, off = place >> 16, place >> 8 & 255, place & 255
                    size += off + count + LENGTH
                    if x["hot"]:
                        hot.append((akey, bhash, raw[lo : lo + count - 1 + LENGTH]))
                        continue
                    suffix = raw[lo + off : lo + count - 1 + LENGTH]
                    held.setdefault(akey % parts, []).append((suffix, struct.pack("<qqB", akey, bhash, count) + raw[lo : lo + off]))
                if size > RUN_BYTES:
                    yield _run_batch(held, hot)
                    held, size, hot = {}, 0, []
        if held or hot:
            yield _run_batch(held, hot)

    return joined.select("raw", "listed").mapInArrow(run, "part long, run binary, akey long, bhash long, whole binary")


def _run_batch(held: dict, hot: list) -> pa.RecordBatch:
    none = [None] * len(hot)
    akey, bhash, whole = ([None] * len(held) + [x[n] for x in hot] for n in range(3))
    cols = [([*held, *none], pa.int64()), ([*map(write_run, held.values()), *none], pa.binary()), (akey, pa.int64()), (bhash, pa.int64()), (whole, pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in cols], names=["part", "run", "akey", "bhash", "whole"])


def _merged(runs: DataFrame) -> DataFrame:
    """(akey, bhash, mask): repeated starts of each block. A part's runs hold about PART_BYTES, as no anchor in them has over LARGEST_GROUP blocks."""

    def run(batches):
        for batch, bounds in by_group(batches, "part"):
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                rows: list = []
                group: list = []
                names: set = set()
                for shared, suffix, payload in merge_runs(batch.column("run").slice(a, b - a).to_pylist()):
                    akey, bhash, count = struct.unpack_from("<qqB", payload)
                    if shared < CORE:
                        _close(group, rows)
                        group, names = [], set()
                    if (akey, bhash) in names:  # from another row with the same text
                        continue
                    names.add((akey, bhash))
                    group.append((shared, suffix, payload[17:], (akey, bhash), count))
                    if len(rows) > 20_000:
                        yield _mask_batch(rows)
                        rows = []
                _close(group, rows)
                if rows:
                    yield _mask_batch(rows)

    return runs.repartition("part").sortWithinPartitions("part").mapInArrow(run, "akey long, bhash long, mask binary")


def _close(group: list, rows: list) -> None:
    if len(group) > 1:
        # an entry kept out of a group as a copy leaves the common prefix of its neighbours unchanged
        rows += [(*e[3], m.to_bytes(24, "little")) for e, m in zip(group, repeated_starts(group), strict=True) if m]


def _mask_batch(rows: list) -> pa.RecordBatch:
    akey, bhash, mask = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(akey, pa.int64()), pa.array(bhash, pa.int64()), pa.array(mask, pa.binary())], names=["akey", "bhash", "mask"])


def _hot_masks(hot: DataFrame) -> DataFrame:
    """(akey, bhash, mask) for blocks (akey, bhash, whole) of very large groups: their strings are counted one by one, combined before the shuffle."""
    strings = hot.dropDuplicates(["akey", "bhash"]).select("akey", "bhash", "whole", F.explode(F.sequence(F.lit(0), F.octet_length("whole") - LENGTH)).alias("k"))
    each = strings.select("akey", "bhash", "k", F.md5(F.substring("whole", F.col("k") + 1, F.lit(LENGTH))).alias("w"))
    twice = each.groupBy("w").agg(F.count("*").alias("n")).where("n > 1").select("w")
    starts = each.join(twice, "w").groupBy("akey", "bhash").agg(F.array_sort(F.collect_set("k")).alias("starts"))

    def run(batches):
        for batch in batches:
            masks = [sum(1 << k for k in s).to_bytes(24, "little") for s in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(masks, pa.binary())], names=["akey", "bhash", "mask"])

    return starts.mapInArrow(run, "akey long, bhash long, mask binary")


def _spans(marks: list[dict]) -> list[tuple[int, int]]:
    """Maximal covered byte ranges from (place, mask) rows; a null mask means every start."""
    starts = []
    for m in marks:
        lo, count = m["place"] >> 16, m["place"] >> 8 & 255
        if m["mask"] is None:
            starts.append((lo, lo + count - 1 + LENGTH))
        else:
            bits = int.from_bytes(m["mask"], "little")
            starts += [(lo + k, lo + k + LENGTH) for k in range(count) if bits >> k & 1]
    out: list[list[int]] = []
    for a, b in sorted(starts):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def remove_repeats(docs: DataFrame, largest: int = LARGEST_GROUP) -> DataFrame:
    """One row per row of docs (doc_id, text): doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty, texts under 200 bytes lose nothing, a null doc_id is carried, repeated rows are
    copies of each other (each loses all its bytes if it has 200 or more), texts of any length are taken whole, an empty table gives no rows,
    other columns are ignored.
    """
    info = stored(_texts(docs).select("doc_id", _name("text").alias("tid"), F.octet_length("text").alias("n_bytes"), F.sha2("text", 256).alias("sha")), "texts")
    copied = stored(info.groupBy("tid").agg(F.count("*").alias("copies")).where("copies > 1").select("tid"), "copied")
    rows = block_rows(docs)
    keys = rows.groupBy("akey").agg(F.count("*").alias("n"), F.min("bhash").alias("b1"), F.max("bhash").alias("b2")).where("n > 1")
    keys = stored(keys.select("akey", (F.col("b1") != F.col("b2")).alias("mixed")), "anchors")
    found = stored(rows.join(keys, "akey"), "blocks")
    dropped(keys)
    distinct = found.groupBy("akey", "bhash").agg(F.count("*").alias("n"), F.min(F.struct("tid", "place")).alias("at"), F.max("mixed").alias("mixed"))
    distinct = stored(distinct, "distinct")
    # anchors with very many unlike blocks don't go to the merge; there are few of them, each with over `largest` blocks
    mixed = distinct.where("mixed").select("akey", "bhash", "at")
    crowded = stored(mixed.groupBy("akey").agg(F.count("*").alias("n")).where(F.col("n") > largest).select("akey", F.lit(True).alias("hot")), "crowded")
    tagged = mixed.join(small(crowded), "akey", "left").withColumn("hot", F.col("hot").isNotNull())
    # of equal texts one row stands for all, the first by doc_id
    first = info.groupBy("tid").agg(F.min("doc_id").alias("doc_id"))
    listed = tagged.select("at.tid", F.struct("akey", "bhash", "at.place", "hot").alias("b")).groupBy("tid").agg(F.collect_list("b").alias("listed")).join(first, "tid")
    texts = _named(docs).alias("t").join(listed.alias("l"), (F.col("t.tid") == F.col("l.tid")) & F.col("t.doc_id").eqNullSafe(F.col("l.doc_id"))).select("raw", "listed")
    parts = max(1, -(-mixed.count() * 2 * LENGTH // PART_BYTES))
    runs = stored(_suffix_runs(texts, parts), "runs")
    masks = _merged(runs.where("run is not null"))
    if crowded.head(1):
        masks = masks.unionByName(_hot_masks(runs.where("whole is not null").select("akey", "bhash", "whole")))
    masks = stored(masks, "masks")
    dropped(runs)
    every = distinct.where("n > 1").select("akey", "bhash", F.lit(None).cast("binary").alias("mask"))
    partly = masks.join(distinct.where("n > 1").select("akey", "bhash"), ["akey", "bhash"], "left_anti")
    # copies of a text have the same blocks: one of each is left here, then those of copied texts go, which lose all their bytes
    marks = found.join(every.unionByName(partly), ["akey", "bhash"]).groupBy("tid", "place").agg(F.first("mask").alias("mask"))
    spans = marks.join(small(copied), "tid", "left_anti").groupBy("tid").agg(F.collect_list(F.struct("place", "mask")).alias("marks"))

    def cut(batches):
        for batch in batches:
            out = []
            for tid, n, raw, marks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
                raw, ranges = raw.as_py(), _spans(marks)
                edges = [0, *[e for r in ranges for e in r], n]
                kept = b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((tid, n, n - len(kept), len(ranges), hashlib.sha256(kept).hexdigest()))
            if out:
                kinds = [pa.binary(), pa.int32(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["tid", "n_bytes", "n_removed", "n_spans", "kept"])

    changed = _named(docs).join(spans, "tid").select("tid", "n_bytes", "raw", "marks").mapInArrow(cut, "tid binary, n_bytes int, n_removed long, n_spans long, kept string")
    changed = stored(changed.drop("n_bytes"), "changed")
    dropped(found)
    out = info.join(small(copied.withColumn("copied", F.lit(True))), "tid", "left").join(changed, "tid", "left")
    gone = F.col("copied").isNotNull() & (F.col("n_bytes") >= LENGTH)
    return out.select(
        "doc_id", F.col("n_bytes").cast("long").alias("n_bytes"),
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(gone, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(gone, F.lit(hashlib.sha256(b"").hexdigest())).otherwise(F.coalesce("kept", "sha")).alias("kept_sha256"),
    )
