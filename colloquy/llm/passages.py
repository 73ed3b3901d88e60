"""Fuzzy repeated passages by collinear chaining.

A text's words are hashed. Of its five-word windows those are seeds whose hash is in the lowest quarter of all, and of every eight neighbours at least
that with the least hash, so equal passages have equal seeds. Seeds are joined by hash, in two ways:

* a seed that occurs RARE times or fewer is joined with all its occurrences;
* a commoner seed is joined together with those that follow it: runs of 2, 4, 8 and 16 common seeds are keys of their own, and the shortest run that
  is rare is joined with all its occurrences. The longest run that is common is joined with the first document that has it.

Equal texts are represented by the first of them. So any two documents that share a rare seed or a rare run of common ones are compared, and the matches stay linear in the seeds however common a passage is.
A document's matches with another are merged along diagonals, and the diagonals are chained in order with gap costs
through a Fenwick tree. Neighbouring seeds also carry a hash of the words from one to the next, which tells where both texts are equal; the rest of a
chain is cut into short pieces, whose words are fetched from both texts and aligned; runs
of pieces that are long and alike enough are the passages. First the widest chains are aligned, then those within their spans that the
passages found don't cover.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from .common import SPACES, by_group, dropped, fresh, hash_tables, keyed, small, stir, stored

SEED_WORDS, WINDOW, SAMPLE, MIN_WORDS, MIN_SIMILARITY = 5, 8, 4, 50, 0.8
#: A seed that comes again within so many words is told from its last occurrence by a count.
PERIOD = 64
#: Occurrences of a key that are all joined with each other, at most; words between the common seeds of a run, and seeds of a run.
RARE, RUN_GAP, RUNS = 16, 16, (1, 2, 4, 8, 16)
#: Words between neighbouring seeds of one diagonal, words added to a chain's ends, words of a piece.
DIAGONAL_GAP, EXTEND, PIECE = 32, 32, 64
#: A chain has two matches at least and covers so many words from its first to its last seed.
MIN_SPAN = 20
#: What a word of distance between chained diagonals costs, in seeds; a chain breaks where the way costs more than its seeds bring.
GAP_COST = 1 / 64
#: A match in an extension adds one and a difference takes this away; it ends when it has lost this much.
MISMATCH, DROP = 2, 8
BATCH_BYTES = 1 << 19
#: Numbers or names of documents that are broadcast, at most.
BROADCAST_IDS = 300_000

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_OCTETS, _MIX = hash_tables(11)
_INVERSE = np.uint64(pow(int(_MIX[3]), -1, 1 << 64))


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every lower-cased word of all texts, number of words of each text)."""
    data = np.frombuffer(b" ".join(texts), np.uint8)
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    blank = _SPACE[data]
    edge = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    sizes = ends - starts
    flat = data[~blank]
    firsts = np.cumsum(sizes) - sizes
    place = np.arange(len(flat)) - np.repeat(firsts, sizes)
    power = np.cumprod(np.full(int(sizes.max()), _MIX[2]))
    h = stir(np.add.reduceat(_OCTETS[_LOWER[flat]] * power[place], firsts) + sizes.astype(np.uint64), _MIX)
    bounds = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return h, np.diff(np.searchsorted(starts, bounds))


def seeds(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """(text number, first word, hash, words to the next seed or 0, hash of those words) of every seed. A text with fewer words than a seed has none."""
    words, counts = word_hashes(texts)
    n = len(words) - SEED_WORDS + 1
    if n < 1:
        return tuple(np.zeros(0, k) for k in (np.int64, np.int64, np.uint64, np.int64, np.int32))
    h = np.zeros(n, np.uint64)
    for k in range(SEED_WORDS):
        h = h * _MIX[3] + words[k : k + n]
    h = stir(h, _MIX)
    owner = np.repeat(np.arange(len(texts)), counts)
    valid = owner[:n] == owner[SEED_WORDS - 1 :]
    h[~valid] = np.uint64(2**64 - 1)
    chosen = h < np.uint64(2**64 // SAMPLE)
    if n >= WINDOW:
        views = np.lib.stride_tricks.sliding_window_view(h, WINDOW)
        chosen[np.arange(len(views)) + views.argmin(1)] = True
    # the windows that reach over the ends of a text: its first and last windows choose among what they have
    ends = np.cumsum(counts)
    for a, b in zip((ends - counts).tolist(), (ends - SEED_WORDS + 1).tolist(), strict=True):
        if a < b:
            for lo, hi in ((a, min(b, a + WINDOW)), (max(a, b - WINDOW), b)):
                chosen[lo + int(h[lo:hi].argmin())] = True
    at = np.flatnonzero(chosen & valid)
    own = owner[at]
    gap = np.zeros(len(at), np.int64)
    gap[:-1] = np.where(own[1:] == own[:-1], at[1:] - at[:-1], 0)
    # hashes of the words between from sums of all before; the factor moves each to the same place
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(words * np.cumprod(np.full(len(words), _MIX[3])))))
    back = np.cumprod(np.full(len(words), _INVERSE))
    run = stir((total[at + gap] - total[at]) * back[at], _MIX)
    return own, at - (ends - counts)[own], _counted(own, at, h[at]), np.minimum(gap, 127), (run >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _counted(owner: np.ndarray, at: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Hashes of seeds, mixed with the number of a seed within a series of equal ones that follow each other within PERIOD words.

    So words or lines said over and over are matched from the beginning of the series, place by place, and not each with each.
    """
    order = np.lexsort((at, h, owner))
    again = np.zeros(len(h), bool)
    again[1:] = (h[order][1:] == h[order][:-1]) & (owner[order][1:] == owner[order][:-1]) & (at[order][1:] - at[order][:-1] <= PERIOD)
    place = np.arange(len(h))
    number = np.zeros(len(h), np.uint64)
    number[order] = (place - np.maximum.accumulate(np.where(again, 0, place))).astype(np.uint64)
    return np.where(number > 0, stir(h + number * _MIX[6], _MIX), h)


def _documents(docs: DataFrame) -> tuple[DataFrame, DataFrame, str, DataFrame | None]:
    """(rows (doc, text), the table, the column of it that tells rows apart, and names (that column, doc, doc_id) or None).

    doc is a number in the order of doc_id. Where doc_id is null or repeated, the table is written with row numbers, and doc
    follows doc_id (nulls last) and then the row; else doc is doc_id.
    """
    id = F.col("doc_id").cast("long")
    text = F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    if not docs.groupBy(id.alias("d")).count().where("count > 1 or d is null").head(1):
        return docs.select(id.alias("doc"), text), docs, "doc_id", None
    table, row, _ = keyed(docs)
    order = [id.asc_nulls_last(), F.col(row).asc()]
    ids = table.select(row, "doc_id").repartitionByRange(*order).sortWithinPartitions(*order)
    # numbers of partitions in order and of rows in sorted partitions: they rise in the order of the sort
    names = stored(ids.select(row, F.monotonically_increasing_id().alias("doc"), id.alias("doc_id")), "names")
    return table.select(row, text).join(names.select(row, "doc"), row).select("doc", "text"), table, row, names


def seed_rows(rows: DataFrame) -> DataFrame:
    """(h, doc, pos, gap, run) of every seed."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
            group, held, first = [], 0, 0
            for n in range(batch.num_rows):
                raw = texts[n].as_py()
                group.append(raw)
                held += len(raw)
                if held >= BATCH_BYTES or n + 1 == batch.num_rows:
                    owner, pos, h, gap, between = seeds(group)
                    cols = [h.view(np.int64), ids[first + owner], pos.astype(np.int32), gap.astype(np.int8), between]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["h", "doc", "pos", "gap", "run"])
                    group, held, first = [], 0, n + 1

    return rows.select("doc", F.col("text").cast("binary")).mapInArrow(run, "h long, doc long, pos int, gap byte, run int")


# -- matches --------------------------------------------------------------------------------------


def common_runs(common: DataFrame) -> DataFrame:
    """(doc, pos, size, key, last): runs of neighbouring common seeds (h, doc, pos) of each document, as long as RUNS says; last is the last seed's place."""

    def run(batches):
        for batch, _ in by_group(batches, "doc"):
            doc, pos, key = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("doc", "pos", "h"))
            key, pos = key.view(np.uint64), pos.astype(np.int32)
            size, valid = 1, np.ones(len(doc), bool)
            near = (doc[1:] == doc[:-1]) & (pos[1:] - pos[:-1] <= RUN_GAP)
            broken = np.concatenate(([0], np.cumsum(~near)))
            while True:
                at = np.flatnonzero(valid)
                cols = [doc[at], pos[at], np.full(len(at), size, np.int32), key[at].view(np.int64), pos[at + size - 1]]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc", "pos", "size", "key", "last"])
                if size >= RUNS[-1]:
                    break
                later = np.minimum(np.arange(len(doc)) + size, len(doc) - 1)
                key, size = stir(key * _MIX[4] + key[later] * _MIX[5] + np.uint64(size), _MIX), 2 * size
                end = np.arange(len(doc)) + size - 1
                valid = (end < len(doc)) & (broken[np.minimum(end, len(doc) - 1)] == broken)

    return common.select("doc", "pos", "h").repartition("doc").sortWithinPartitions("doc", "pos").mapInArrow(run, "doc long, pos int, size int, key long, last int")


def matches(found: DataFrame) -> DataFrame:
    """(a, b, pa, pb, n): word pa of document a and word pb of document b < a begin n equal words, SEED_WORDS at least. found: seed_rows()."""
    counts = stored(found.groupBy("h").agg(F.count("*").alias("n")).where("n > 1"), "counts")
    shared = stored(found.join(counts, "h"), "shared")
    dropped(counts)
    runs = stored(common_runs(shared.where(F.col("n") > RARE)), "runs")
    sizes = stored(runs.groupBy("key").agg(F.count("*").alias("n"), F.min(F.struct("doc", "pos", "last")).alias("first")).where("n > 1"), "sizes")
    n = F.coalesce("n", F.lit(1))
    told = runs.join(sizes, "key", "left").groupBy("doc", "pos").agg(
        F.min(F.when(n <= RARE, F.struct("size", n.alias("n"), "key", "last"))).alias("rare"), F.max(F.when(n > RARE, F.struct("size", "first", "last"))).alias("common")
    )
    told = stored(told, "told")
    none = F.lit(0)
    keys = shared.where(F.col("n") <= RARE).select(F.col("h").alias("key"), "doc", "pos", F.col("pos").alias("last"), "gap", "run").unionByName(
        told.where("rare.n > 1").select("rare.key", "doc", "pos", "rare.last", none.cast("byte").alias("gap"), none.alias("run"))
    )

    def run(batches):
        for batch, _ in by_group(batches, "key"):
            key, doc, pos, last, gap, between = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("key", "doc", "pos", "last", "gap", "run"))
            for shift in range(1, RARE):
                i = np.flatnonzero((key[shift:] == key[:-shift]) & (doc[shift:] != doc[:-shift]))
                if not len(i):
                    continue
                j = i + shift
                length = np.where((gap[i] > 0) & (gap[i] == gap[j]) & (between[i] == between[j]), gap[i].astype(np.int32) + SEED_WORDS, SEED_WORDS)
                yield _matched(doc[j], doc[i], pos[j], pos[i], length)
                i = i[last[i] != pos[i]]
                if len(i):
                    yield _matched(doc[i + shift], doc[i], last[i + shift], last[i], np.full(len(i), SEED_WORDS))

    pairs = keys.repartition("key").sortWithinPartitions("key", "doc", "pos").mapInArrow(run, "a long, b long, pa int, pb int, n int")
    f = F.col("common.first")
    first = told.where("common is not null and common.first.doc < doc").select(
        F.col("doc").alias("a"), f["doc"].alias("b"), F.explode(F.array(F.struct(F.col("pos").alias("pa"), f["pos"].alias("pb")), F.struct(F.col("common.last").alias("pa"), f["last"].alias("pb")))).alias("x")
    )
    return pairs.unionByName(first.select("a", "b", "x.pa", "x.pb", F.lit(SEED_WORDS).alias("n")))


def _matched(a, b, pa_, pb, n) -> pa.RecordBatch:
    cols = [(a, np.int64), (b, np.int64), (pa_, np.int32), (pb, np.int32), (n, np.int32)]
    return pa.RecordBatch.from_arrays([pa.array(x.astype(k)) for x, k in cols], names=["a", "b", "pa", "pb", "n"])


# -- chaining -------------------------------------------------------------------------------------


class Fenwick:
    """Greatest (value, item) among the first n places."""

    def __init__(self, n: int):
        self.best = [(float("-inf"), -1)] * (n + 1)

    def put(self, at: int, entry: tuple[float, int]) -> None:
        at += 1
        while at < len(self.best):
            if entry > self.best[at]:
                self.best[at] = entry
            at += at & -at

    def top(self, n: int) -> tuple[float, int]:
        out = (float("-inf"), -1)
        while n:
            if self.best[n] > out:
                out = self.best[n]
            n -= n & -n
        return out


def chains(diagonals: list[tuple[int, int, int, int]]) -> list[list[tuple[int, int, int, int]]]:
    """Chains of (first pa, last pa, first pb, seeds), best first, each diagonal in one at most.

    A diagonal follows another if it starts behind its end in both texts; the way between costs GAP_COST a word.
    """
    if len(diagonals) == 1:
        return [diagonals]
    ends = sorted({x[2] + x[1] - x[0] for x in diagonals})
    rank = {e: n for n, e in enumerate(ends)}
    tree = Fenwick(len(ends))
    score, before = [0.0] * len(diagonals), [-1] * len(diagonals)
    events = sorted([(x[0], 0, n) for n, x in enumerate(diagonals)] + [(x[1], 1, n) for n, x in enumerate(diagonals)])
    for _, closes, n in events:
        a0, a1, b0, weight = diagonals[n]
        b1 = b0 + a1 - a0
        if closes:
            tree.put(rank[b1], (score[n] + GAP_COST * (a1 + b1), n))
        else:
            value, i = tree.top(int(np.searchsorted(ends, b0)))
            gain = value - GAP_COST * (a0 + b0)
            score[n], before[n] = (weight + gain, i) if gain > 0 else (weight, -1)
    out, used = [], set()
    for n in sorted(range(len(diagonals)), key=lambda n: -score[n]):
        chain = []
        while n >= 0 and n not in used:
            used.add(n)
            chain.append(diagonals[n])
            n = before[n]
        if chain:
            out.append(chain[::-1])
    return out


def _diagonals(b: np.ndarray, p: np.ndarray, q: np.ndarray, gap: int = DIAGONAL_GAP) -> tuple[np.ndarray, ...]:
    """(b, first pa, last pa, first pb, seeds) of runs on one diagonal with gaps of `gap` words at most."""
    order = np.lexsort((p, p - q, b))
    b, p, q = b[order], p[order], q[order]
    fresh = np.ones(len(b), bool)
    fresh[1:] = (b[1:] != b[:-1]) | (p[1:] - q[1:] != p[:-1] - q[:-1]) | (p[1:] - p[:-1] > gap)
    lo = np.flatnonzero(fresh)
    hi = np.append(lo[1:], len(b)) - 1
    return b[lo], p[lo], p[hi], q[lo], hi - lo + 1


def exact_stretches(b: np.ndarray, p: np.ndarray, q: np.ndarray, n: np.ndarray) -> dict[tuple[int, int], list[tuple[int, int]]]:
    """For each document and diagonal (b, pa - pb) the stretches [lo, hi) of words that are equal, from matches of n equal words."""
    order = np.lexsort((p, p - q, b))
    b, d, lo, hi = b[order], (p - q)[order], p[order], (p + n)[order]
    out: dict[tuple[int, int], list[tuple[int, int]]] = {}
    for x, y, s, e in zip(b.tolist(), d.tolist(), lo.tolist(), hi.tolist(), strict=True):
        held = out.setdefault((x, y), [])
        if held and s <= held[-1][1]:
            held[-1] = (held[-1][0], max(held[-1][1], e))
        else:
            held.append((s, e))
    return out


def widest(found: list[tuple[int, list]]) -> list[bool]:
    """For each chain (b, diagonals) whether its words in a aren't all within those of a wider one."""
    spans = [(c[0][0], c[-1][1], sum(d[3] for d in c), b) for b, c in found]
    out, kept = [False] * len(found), []
    for n in sorted(range(len(found)), key=lambda n: (spans[n][0] - spans[n][1], -spans[n][2], spans[n][3])):
        lo, hi = spans[n][:2]
        if not any(s <= lo and hi <= e for s, e in kept):
            kept.append((lo, hi))
            out[n] = True
    return out


def _pieces(chain: list[tuple[int, int, int, int]], b: int, exact: dict) -> list[tuple[str, int, int, int, int]]:
    """(kind, a's first word, words, b's first word, words): e before, s equal, d along a diagonal, g between two, f after."""
    out = []
    x, y = chain[0][0], chain[0][2]
    n = min(EXTEND, x, y)
    if n:
        out.append(("e", x - n, n, y - n, n))
    for a0, a1, b0, _ in chain:
        if a0 < x or b0 < y:  # a seed's words reach over the next diagonal's start
            cut = max(x - a0, y - b0)
            a0, b0 = a0 + cut, b0 + cut
        if a0 > x or b0 > y:
            out.append(("g", x, a0 - x, y, b0 - y))
        end, shift = max(a1 + SEED_WORDS, a0), b0 - a0
        for s, e in [*exact.get((b, -shift), ()), (end, end)]:
            s, e = min(max(s, a0), end), min(e, end)
            while a0 < s:
                n = min(s - a0, PIECE - (a0 + shift) % PIECE)
                out.append(("d", a0, n, a0 + shift, n))
                a0 += n
            if e > a0:
                out.append(("s", a0, e - a0, a0 + shift, e - a0))
                a0 = e
        x, y = a0, a0 + shift
    out.append(("f", x, EXTEND, y, EXTEND))
    return out


_PIECE_TYPE = "array<struct<ord:int,kind:string,a0:int,an:int,b:long,b0:int,bn:int>>"


def chained(links: DataFrame) -> DataFrame:
    """(doc, chain, wide, lo, hi, pieces): the chains of each document that has some, their words [lo, hi) and their pieces; links: matches().

    wide: not within a wider chain. A document's matches are at most RARE times its seeds.
    """

    def run(batches):
        for batch, bounds in by_group(batches, "a"):
            a, b, p, q, length = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("a", "b", "pa", "pb", "n"))
            out = []
            for s, e in zip(bounds[:-1], bounds[1:], strict=True):
                if e - s < 2:
                    continue
                x, y, z, n = b[s:e], p[s:e].astype(np.int64), q[s:e].astype(np.int64), length[s:e].astype(np.int64)
                order = np.lexsort((-n, z, y, x))
                x, y, z, n = x[order], y[order], z[order], n[order]
                first = np.ones(len(x), bool)
                first[1:] = (x[1:] != x[:-1]) | (y[1:] != y[:-1]) | (z[1:] != z[:-1])
                x, y, z, n = x[first], y[first], z[first], n[first]
                # documents with a span of matches that is long enough
                cuts = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
                ends = np.append(cuts[1:], len(x))
                wide = np.maximum.reduceat(y, cuts) - np.minimum.reduceat(y, cuts) + SEED_WORDS >= MIN_SPAN
                keep = np.repeat(wide, ends - cuts)
                x, y, z, n = x[keep], y[keep], z[keep], n[keep]
                if not len(x):
                    continue
                other, a0, a1, b0, weight = _diagonals(x, y, z)
                cuts = [*np.flatnonzero(np.concatenate(([True], other[1:] != other[:-1]))).tolist(), len(other)]
                found = []
                for i, j in zip(cuts[:-1], cuts[1:], strict=True):
                    rows = list(zip(a0[i:j].tolist(), a1[i:j].tolist(), b0[i:j].tolist(), weight[i:j].tolist(), strict=True))
                    found += [(int(other[i]), c) for c in chains(rows) if c[-1][1] + SEED_WORDS - c[0][0] >= MIN_SPAN]
                if not found:
                    continue
                exact = exact_stretches(x, y, z, n)
                for k, ((o, c), is_wide) in enumerate(zip(found, widest(found), strict=True)):
                    pieces = [
                        # nothing alike in between two far diagonals: the alignment counts differences only
                        {"ord": m, "kind": kind, "a0": x0, "an": xn, "b": o, "b0": y0, "bn": 0 if kind != "s" and max(xn, yn) > PIECE else yn}
                        for m, (kind, x0, xn, y0, yn) in enumerate(_pieces(c, o, exact))
                    ]
                    out.append((int(a[s]), k, is_wide, c[0][0], c[-1][1] + SEED_WORDS, pieces))
                if len(out) > 2000:
                    yield _chains(out)
                    out = []
            if out:
                yield _chains(out)

    return links.repartition("a").sortWithinPartitions("a").mapInArrow(run, f"doc long, chain int, wide boolean, lo int, hi int, pieces {_PIECE_TYPE}")


def _chains(rows: list[tuple]) -> pa.RecordBatch:
    piece = pa.list_(pa.struct([("ord", pa.int32()), ("kind", pa.string()), ("a0", pa.int32()), ("an", pa.int32()), ("b", pa.int64()), ("b0", pa.int32()), ("bn", pa.int32())]))
    kinds = [pa.int64(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), piece]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc", "chain", "wide", "lo", "hi", "pieces"])


# -- alignment ------------------------------------------------------------------------------------


def common_words(x: np.ndarray, y: np.ndarray) -> tuple[list[int], int]:
    """Lengths of the longest common subsequences of x and y: of their beginnings of 1, 2 … words, and of both whole; a bit per word of x."""
    where: dict[int, int] = {}
    for n, w in enumerate(x.tolist()):
        where[w] = where.get(w, 0) | 1 << n
    full = (1 << len(x)) - 1
    row, out = full, []
    for n, w in enumerate(y.tolist(), 1):
        u = row & where.get(w, 0)
        row = ((row + u) | (row - u)) & full
        head = row & ((1 << n) - 1) if n < len(x) else row
        out.append(min(n, len(x)) - head.bit_count())
    return out, len(x) - row.bit_count()


def extension(x: np.ndarray, y: np.ndarray) -> tuple[int, int]:
    """(words taken, of them equal) of the beginnings of x and y, walking outwards; words may be left out on either side."""
    n = min(len(x), len(y))
    if not n:
        return 0, 0
    same = np.array(common_words(x[:n], y[:n])[0])
    total = (1 + MISMATCH) * same - MISMATCH * np.arange(1, n + 1)
    top = np.maximum.accumulate(np.maximum(total, 0))
    stop = np.flatnonzero(top - total >= DROP)
    total = total[: stop[0]] if len(stop) else total
    if not len(total) or total.max() <= 0:
        return 0, 0
    n = int(total.argmax()) + 1
    return n, int(same[n - 1])


def align(kind: str, x: np.ndarray, y: np.ndarray) -> tuple[int, int, int]:
    """(equal words, aligned columns, words of x taken) of a piece."""
    n = min(len(x), len(y))
    if kind == "e":
        taken, same = extension(x[::-1], y[::-1])
        return same, taken, taken
    if kind == "f":
        taken, same = extension(x, y)
        return same, taken, taken
    same = int((x[:n] == y[:n]).sum())
    if same < n:  # words left out on one side and then on the other leave the diagonal and come back
        same = max(same, common_words(x, y)[1])
    return same, max(len(x), len(y)), len(x)


def best_runs(scores: list[float], lengths: list[int], least: int) -> list[tuple[int, int]]:
    """Disjoint runs of pieces whose scores add up to zero or more, of `least` words or more, the longest first.

    A run's first and last piece have a score above zero, so what is unlike at its ends isn't taken along.
    """
    out, todo = [], [(0, len(scores))]
    while todo:
        a, b = todo.pop()
        while a < b and scores[a] <= 0:
            a += 1
        while a < b and scores[b - 1] <= 0:
            b -= 1
        if sum(lengths[a:b]) < least:
            continue
        total, words = np.concatenate(([0.0], np.cumsum(scores[a:b]))), np.concatenate(([0], np.cumsum(lengths[a:b])))
        low = np.minimum.accumulate(total)
        # for each end the first beginning whose sum before it isn't greater
        start = len(low) - np.searchsorted(low[::-1], total + 1e-9, "right")
        span = words - words[np.minimum(start, np.arange(len(words)))]
        end = int(span.argmax())
        i, j = a + int(start[end]), a + end
        while i < j and scores[i] <= 0:
            i += 1
        while i < j and scores[j - 1] <= 0:
            j -= 1
        if i >= j:
            continue
        if sum(lengths[i:j]) >= least:
            out.append((i, j))
            todo += [(a, i), (j, b)]
    return out


def _excerpts(texts: DataFrame, needs: DataFrame) -> DataFrame:
    """Words of pieces (blk null) and of blocks that others ask for, cut from each text in one pass."""
    schema = "doc long, blk int, words binary, chain int, ord int, kind string, a0 int, an int, b long, b0 int, bn int"

    def run(batches):
        for batch in batches:
            for n in range(batch.num_rows):
                words = (word_hashes([batch.column(1)[n].as_py()])[0] >> np.uint64(32)).astype("<u4")
                doc = batch.column(0)[n].as_py()
                pieces, blocks = batch.column(2)[n].as_py() or [], batch.column(3)[n].as_py() or []
                for s in range(0, len(pieces), 20_000):
                    part = pieces[s : s + 20_000]
                    cols = {k: [x[k] for x in part] for k in ("chain", "ord", "kind", "a0", "an", "b", "b0", "bn")}
                    cut = [words[x["a0"] : x["a0"] + x["an"]].tobytes() for x in part]
                    yield _excerpt([doc] * len(part), [None] * len(part), cut, cols)
                for s in range(0, len(blocks), 20_000):
                    part = blocks[s : s + 20_000]
                    yield _excerpt([doc] * len(part), part, [words[PIECE * k : PIECE * (k + 2)].tobytes() for k in part], {})

    # only texts that are asked for are shuffled, if their numbers fit for a broadcast
    asked = texts.join(small(needs.select("doc"), BROADCAST_IDS), "doc", "left_semi")
    joined = asked.join(needs, "doc").select("doc", F.col("text").cast("binary"), "pieces", "blocks")
    return joined.mapInArrow(run, schema)


def _excerpt(doc, blk, words, cols) -> pa.RecordBatch:
    kinds = {"chain": pa.int32(), "ord": pa.int32(), "kind": pa.string(), "a0": pa.int32(), "an": pa.int32(), "b": pa.int64(), "b0": pa.int32(), "bn": pa.int32()}
    more = [pa.array(cols[k], t) if cols else pa.nulls(len(doc), t) for k, t in kinds.items()]
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(blk, pa.int32()), pa.array(words, pa.binary()), *more], names=["doc", "blk", "words", *kinds])


def _aligned(pieces: DataFrame, blocks: DataFrame) -> DataFrame:
    """Each piece with its alignment: equal words, aligned columns and words taken."""

    def run(batches):
        for batch in batches:
            kind, x, y = batch.column("kind").to_pylist(), batch.column("words"), batch.column("block")
            b0, bn = batch.column("b0").to_pylist(), batch.column("bn").to_pylist()
            got = np.zeros((batch.num_rows, 3), np.int32)
            for n in range(batch.num_rows):
                block = y[n].as_py() or b""
                own = x[n].as_py()
                other = block[4 * (b0[n] % PIECE) : 4 * (b0[n] % PIECE + bn[n])]
                if own == other and kind[n] != "g":
                    got[n] = len(own) // 4
                else:
                    got[n] = align(kind[n], np.frombuffer(own, "<u4"), np.frombuffer(other, "<u4"))
            keep = [batch.column(c) for c in ("doc", "chain", "ord", "kind", "a0", "an", "b", "b0")]
            yield pa.RecordBatch.from_arrays([*keep, *(pa.array(got[:, k]) for k in range(3))], names=["doc", "chain", "ord", "kind", "a0", "an", "b", "b0", "same", "cols", "taken"])

    where = pieces.withColumn("blk", F.floor(F.col("b0") / PIECE).cast("int")).join(
        blocks.select(F.col("doc").alias("b"), "blk", F.col("words").alias("block")), ["b", "blk"], "left"
    )
    columns = where.select("doc", "chain", "ord", "kind", "a0", "an", "b", "b0", "bn", "words", "block")
    return columns.mapInArrow(run, "doc long, chain int, ord int, kind string, a0 int, an int, b long, b0 int, same int, cols int, taken int")


def _selected(aligned: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """(doc, start, n_words, of_doc, of_start, similarity) of the runs of pieces that are long and alike enough."""

    def run(batches):
        for batch, bounds in by_group(batches, "doc"):
            cols = {c: batch.column(c).to_pylist() for c in batch.schema.names}
            out = []
            for s, e in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                order = sorted(range(s, e), key=lambda n: (cols["chain"][n], cols["ord"][n]))
                at = 0
                while at < len(order):
                    end = at
                    while end < len(order) and cols["chain"][order[end]] == cols["chain"][order[at]]:
                        end += 1
                    rows = order[at:end]
                    at = end
                    scores = [cols["same"][n] - min_similarity * cols["cols"][n] for n in rows]
                    for x, y in best_runs(scores, [cols["taken"][n] for n in rows], min_words):
                        part = rows[x:y]
                        first = part[0]
                        # an extension to the left takes the last of its words
                        skip = cols["an"][first] - cols["taken"][first] if cols["kind"][first] == "e" else 0
                        n_words = sum(cols["taken"][n] for n in part)
                        similarity = sum(cols["same"][n] for n in part) / max(1, sum(cols["cols"][n] for n in part))
                        out.append((cols["doc"][first], cols["a0"][first] + skip, n_words, cols["b"][first], cols["b0"][first] + skip, similarity))
            if out:
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.float64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names=["doc", "start", "n_words", "of_doc", "of_start", "similarity"])

    dealt = aligned.repartition("doc").sortWithinPartitions("doc")
    return dealt.mapInArrow(run, "doc long, start long, n_words long, of_doc long, of_start long, similarity double")


def _passages(rows: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """(doc, start, n_words, of_doc, of_start, similarity) for rows (doc, text), doc being unique."""
    texts = stored(rows.select("doc", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(7), "text").alias("t2")), "texts")
    groups = stored(texts.groupBy("t1", "t2").agg(F.min("doc").alias("of_doc"), F.count("*").alias("n")).where("n > 1"), "groups")
    copies = stored(texts.join(small(groups, BROADCAST_IDS), ["t1", "t2"]).where("doc <> of_doc").select("doc", "of_doc"), "copies")
    dropped(texts)
    held = small(copies, BROADCAST_IDS)
    zero = F.lit(0).cast("long")
    whole = rows.join(held, "doc").select("doc", zero.alias("start"), F.regexp_count("text", F.lit(f"[^{SPACES}]+")).cast("long").alias("n_words"), "of_doc", zero.alias("of_start"), F.lit(1.0).alias("similarity"))
    return _unlike(rows.join(held, "doc", "left_anti"), min_words, min_similarity).unionByName(whole.where(F.col("n_words") >= min_words))


def _unlike(rows: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """_passages() of texts that are all different."""
    found = stored(chained(matches(seed_rows(rows))), "chains")
    first = stored(_accepted(rows, found.where("wide"), min_words, min_similarity), "passages")
    spans = first.groupBy("doc").agg(F.collect_list(F.struct("start", "n_words")).alias("spans"))
    within = F.exists("spans", lambda s: (s["start"] <= F.col("lo")) & (s["start"] + s["n_words"] >= F.col("hi")))
    left = stored(found.where("not wide").join(spans, "doc", "left").where(~F.coalesce(within, F.lit(False))).drop("spans"), "left")
    dropped(found)
    return first.unionByName(_accepted(rows, left, min_words, min_similarity)) if left.head(1) else first


def _accepted(rows: DataFrame, found: DataFrame, min_words: int, min_similarity: float) -> DataFrame:
    """The passages of chains: their pieces that aren't known to be equal are aligned with words of both texts."""
    pieces = found.select("doc", "chain", F.explode("pieces").alias("p")).select("doc", "chain", "p.*")
    unsure, equal = pieces.where("kind <> 's'"), pieces.where("kind = 's'")
    asked = unsure.where("bn > 0").select(F.col("b").alias("doc"), F.floor(F.col("b0") / PIECE).cast("int").alias("blk")).distinct()
    blocks = asked.groupBy("doc").agg(F.collect_list("blk").alias("blocks"))
    own = unsure.groupBy("doc").agg(F.collect_list(F.struct("chain", "ord", "kind", "a0", "an", "b", "b0", "bn")).alias("pieces"))
    needs = stored(own.join(blocks, "doc", "full_outer").select("doc", "pieces", "blocks"), "needs")
    cut = stored(_excerpts(rows, needs), "excerpts")
    dropped(needs)
    known = equal.select("doc", "chain", "ord", F.lit("d").alias("kind"), "a0", "an", "b", "b0", *[F.col("an").alias(c) for c in ("same", "cols", "taken")])
    return _selected(_aligned(cut.where("blk is null"), cut.where("blk is not null")).unionByName(known), min_words, min_similarity)


def repeated_passages(docs: DataFrame, min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """(doc_id, start, n_words, of_doc_id, of_start, similarity): passages of documents that repeat, nearly or exactly, one that comes before.

    docs has doc_id and text. Documents come in the order of doc_id; rows that share one, or have none (these come last), in an order of their own, and each is a
    document. Starts count words from 0; similarity is equal words over aligned columns, upper and lower
    case A-Z being equal. Passages of a document may overlap where it repeats several others; one that lies within a passage found before
    need not be listed again, and up to WINDOW words at its ends may then be missing. A series of words said over and over, within PERIOD words, is compared from its
    beginning, so what a longer series has beyond a shorter one isn't a repeat. Repeats within one document aren't looked for. Null, empty and short texts have none; texts of any length are taken whole;
    an empty table gives no rows; other columns are ignored.
    """
    rows, _, _, names = _documents(docs)
    found = _passages(rows, min_words, min_similarity)
    if names is None:
        return found.withColumnsRenamed({"doc": "doc_id", "of_doc": "of_doc_id"})
    found = found.join(names.select("doc", "doc_id"), "doc").join(names.select(F.col("doc").alias("of_doc"), F.col("doc_id").alias("of_doc_id")), "of_doc")
    return found.select("doc_id", "start", "n_words", "of_doc_id", "of_start", "similarity")


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")


def cut_words(raw: bytes, spans: list[tuple[int, int]]) -> bytes:
    """raw without the words of the spans (first word, words) and the white space behind each."""
    starts = [m.start() for m in _WORD.finditer(raw)] + [len(raw)]
    out, at = [], 0
    for a, n in sorted(spans):
        lo, hi = starts[min(a, len(starts) - 1)], starts[min(a + n, len(starts) - 1)]
        if hi > at:
            out.append(raw[at : max(at, lo)])
            at = hi
    return b"".join([*out, raw[at:]])


@F.pandas_udf(StringType())
def _without(texts, spans):
    cut = lambda t, s: t if s is None or t is None else cut_words(t.encode("utf-8", "surrogatepass"), [(x["a"], x["n"]) for x in s]).decode("utf-8", "surrogatepass")
    return texts.combine(spans, cut)


def without_repeats(docs: DataFrame, min_words: int = MIN_WORDS, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """docs with every passage that repeats a document before it cut from its text; n_chars, if there, follows.

    All rows and columns stay, under their names whatever these are; a text that is all repeated becomes empty. Texts without such passages are unchanged, null texts
    stay null. Each row is cut by its own passages, also where rows share a doc_id or have none. An empty table gives no rows.
    """
    rows, table, key, names = _documents(docs)
    at, spans = fresh(table.columns, "_doc"), fresh(table.columns, "_spans")
    listed = _passages(rows, min_words, min_similarity).groupBy("doc").agg(F.collect_list(F.struct(F.col("start").alias("a"), F.col("n_words").alias("n"))).alias(spans))
    if names is None:
        listed = listed.withColumn(at, F.col("doc").cast(table.schema[key].dataType))
    else:
        listed = listed.join(names, "doc").withColumnRenamed(key, at)
    listed = stored(listed.select(at, spans), "spans")
    joined = table.join(small(listed), table[f"`{key}`"] == listed[at], "left").drop(at)
    text = F.when(F.col(spans).isNull(), F.col("text")).otherwise(_without(F.col("text").cast("string"), F.col(spans)))
    new = fresh(joined.columns, "_new")
    changed = joined.withColumn(new, text)

    def column(c: str) -> Column:
        if c == "text":
            return F.col(new).alias("text")
        if c == "n_chars":
            return F.when(F.col(spans).isNull(), F.col("n_chars")).otherwise(F.length(new)).cast(docs.schema["n_chars"].dataType).alias("n_chars")
        return F.col(f"`{c}`")

    return changed.select(*map(column, docs.columns))
