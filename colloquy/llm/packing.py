"""Bounded-space online packing of token sequences.

Each partition keeps a fixed number of open windows. A document's whole windows go out at once; its rest goes to the
open window it fits best. When it fits none, the fullest window is topped up with the head of the rest and emitted, so the space
held never grows. At the end a partition's open windows are poured together, and what is left of each partition is merged in
rounds of a fixed fan-in until one window remains, which is cut at powers of two. Only that can be short.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_group, stored
from .encoding import encoder, slices

WINDOW, OPEN_WINDOWS, END_ID = 2048, 16, 1
#: Leftover windows merged by one task in a round.
FAN_IN = 64

PIECES = "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, open boolean"
#: A piece: doc_id, start, identifiers as bytes, tokens of its document.
Piece = tuple


class Packer:
    """The open windows of one partition; full windows are handed to emit(pieces)."""

    def __init__(self, emit, window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.open: list[list] = []  # [tokens held, pieces]

    def _put(self, slot: list, doc_id, start: int, ids: bytes, total: int) -> None:
        slot[1].append((doc_id, start, ids, total))
        slot[0] += len(ids) // 4
        if slot[0] == self.window:
            self.open.remove(slot)
            self.emit(slot[1])

    def add(self, doc_id, ids: bytes, start: int = 0, total: int | None = None) -> None:
        total = len(ids) // 4 if total is None else total
        step = 4 * self.window
        whole = len(ids) // step * step
        for a in range(0, whole, step):
            self.emit([(doc_id, start + a // 4, ids[a : a + step], total)])
        rest, start = ids[whole:], start + whole // 4
        if not rest:
            return
        n = len(rest) // 4
        fits = [s for s in self.open if s[0] + n <= self.window]
        if fits:
            self._put(max(fits, key=lambda s: s[0]), doc_id, start, rest, total)
        else:
            if len(self.open) >= self.most:
                fullest = max(self.open, key=lambda s: s[0])
                room = self.window - fullest[0]
                self._put(fullest, doc_id, start, rest[: 4 * room], total)
                rest, start = rest[4 * room :], start + room
            fresh = [0, []]
            self.open.append(fresh)
            self._put(fresh, doc_id, start, rest, total)

    def pour(self) -> list[Piece]:
        """Close: pour the open windows together, fullest first, and return the pieces of the one left over."""
        pieces = [p for s in sorted(self.open, key=lambda s: -s[0]) for p in s[1]]
        self.open = []
        return pour(pieces, self.window, self.emit)


def pour(pieces: list[Piece], window: int, emit) -> list[Piece]:
    """Fill windows with pieces in order, cutting where a window is full; return the last, partial one."""
    now, held = [], 0
    for doc_id, start, ids, total in pieces:
        while ids:
            room = window - held
            part = ids[: 4 * room]
            now.append((doc_id, start, part, total))
            held += len(part) // 4
            start += len(part) // 4
            ids = ids[4 * room :]
            if held == window:
                emit(now)
                now, held = [], 0
    return now


class _Rows:
    """Gathers emitted windows as rows, numbering the sequences from a first number."""

    def __init__(self, first: int):
        self.next, self.rows, self.held = first, [], 0

    def __call__(self, pieces: list[Piece], is_open: bool = False) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.rows.append((doc_id, start, n, ids, total, self.next, offset, is_open))
            offset += n
            self.held += len(ids)
        self.next += 1

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
        columns = zip(*self.rows, strict=True) if self.rows else [[]] * 8
        names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "open"]
        out = pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)
        self.rows, self.held = [], 0
        return out


def pack(docs: DataFrame, path: str, window: int = WINDOW, open_windows: int = OPEN_WINDOWS, end_id: int = END_ID, fan_in: int = FAN_IN) -> DataFrame:
    """Pieces (doc_id, start, length, ids, doc_tokens, sequence_id, offset) of all documents (doc_id, text).

    Texts are encoded with a tokenizers file that keeps case and white space, and end_id is appended. Null texts count as empty
    (their only token is end_id); a null doc_id is carried; repeated rows are packed each; other columns are
    ignored. All sequences hold `window` tokens but for at most a few whose lengths are powers of two.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))

    def run(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        out = _Rows(part << 36)
        packer, tokens = Packer(out, window, open_windows), encoder(path, False)
        end = end_id.to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for cut in slices(texts, 1_000_000):
                for doc_id, found in zip(ids[cut], tokens.encode(texts[cut]), strict=True):
                    packer.add(doc_id, found + end)
                yield out.batch()
        left = packer.pour()
        if left:
            out(left, True)
        yield out.batch()

    done = stored(rows.mapInArrow(run, PIECES), "packed")
    result = done.where("not open")
    left = done.where("open").withColumn("slot", F.shiftright("sequence_id", 36))
    level = 1
    while left.select("slot").distinct().count() > 1:
        first = level << 56

        def merge(batches, first=first):
            for batch, bounds in by_group(batches, "group"):
                for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                    block = batch.slice(a, b - a)
                    group = block.column("group")[0].as_py()
                    out = _Rows(first + group * 4096)
                    rest = pour(list(zip(*(block.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)), window, out)
                    if rest:
                        out(rest, True)
                    yield out.batch()

        grouped = left.withColumn("group", F.floor(F.col("slot") / fan_in)).repartition("group").sortWithinPartitions("group", "slot", "offset")
        merged = stored(grouped.select("group", "doc_id", "start", "ids", "doc_tokens").mapInArrow(merge, PIECES), "merged")
        result = result.unionByName(merged.where("not open"))
        left = merged.where("open").withColumn("slot", F.floor((F.col("sequence_id") - first) / 4096))
        level += 1
    first = level << 56

    def finish(batches):
        pieces = [p for batch in batches for p in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")), strict=True)]
        out = _Rows(first)
        size = sum(len(p[2]) // 4 for p in pieces)
        while pieces:
            power = 1 << size.bit_length() - 1
            held: list = []
            after = pour(pieces, power, lambda x, held=held: held.append(x))
            # all but the first full part go on to the next power of two
            out(held[0])
            pieces = [p for x in held[1:] for p in x] + after
            size -= power
        yield out.batch()

    last = left.select("doc_id", "start", "ids", "doc_tokens", "offset").repartition(1).sortWithinPartitions("offset")
    result = result.unionByName(last.select("doc_id", "start", "ids", "doc_tokens").mapInArrow(finish, PIECES))
    return result.drop("open")
