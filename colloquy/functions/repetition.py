"""Texts that repeat themselves without end, found by comparing each batch of texts with itself shifted by every period.

Texts are taken from a batch in pieces, each one array of code points. For each period the places where a character equals the one a period further make up runs; only runs
long enough for six turns are kept, so the work is linear in the text and nothing is matched backwards.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Equal characters and tabs in a row, characters and turns of a pattern, the span that free text may repeat, and the fields of free text.
SAME_CHARACTERS, SAME_TABS, PERIODS, TURNS, FREE_SPAN, FREE_TEXT = 15, 12, range(2, 26), 6, 64, ("label", "short_description", "rationale")
#: Fixed value: a list of quoted aliases, which may repeat.
ALIASES = re.compile(r"""(?:["']E\d{3,4}["']\s*,\s*){2,}""")
#: Bytes of texts that are compared at once.
PIECE_BYTES = 1_000_000
RESULT = "kind string, pattern_length int, repetitions int, span int"


class _Batch:
    """Texts side by side, a line feed after each: no pattern goes across one."""

    def __init__(self, texts: list[str]):
        self.texts = texts
        self.codes = np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.cumsum([len(t) + 1 for t in texts])

    def runs(self, period: int, least: int) -> tuple[np.ndarray, np.ndarray]:
        """Beginnings and lengths of the runs, `least` long or longer, of places that equal the place a period further."""
        same = (self.codes[:-period] == self.codes[period:]) & (self.codes[:-period] != 10)
        edges = np.flatnonzero(np.diff(same, prepend=False, append=False))
        starts, stops = edges[::2], edges[1::2]
        long = stops - starts >= least
        return starts[long], (stops - starts)[long]

    def of(self, places: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, places, "right")


def _character_runs(batch: _Batch) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(text, length) of all runs of one character that isn't white space, and of all runs of tabs, in order."""
    starts, lengths = batch.runs(1, min(SAME_CHARACTERS, SAME_TABS) - 1)
    same, tabs = [], []
    for text, start, length in zip(batch.of(starts).tolist(), starts.tolist(), (lengths + 1).tolist(), strict=True):
        character = chr(batch.codes[start])
        if character == "\t":
            tabs += [(text, length)] if length >= SAME_TABS else []
        elif not character.isspace() and length >= SAME_CHARACTERS:
            same.append((text, length))
    return same, tabs


def _patterns(batch: _Batch):
    """(text, period, turns) of the patterns met from left to right in each text: at a place the longest period counts, the next search begins
    behind its last whole turn. Patterns of nothing but white space are passed over like the others, but not told."""
    found: dict[int, list[tuple[int, int, int]]] = {}
    for period in PERIODS:
        starts, lengths = batch.runs(period, (TURNS - 1) * period)
        for text, start, length in zip(batch.of(starts).tolist(), starts.tolist(), lengths.tolist(), strict=True):
            found.setdefault(text, []).append((start, start + length, period))
    for text in sorted(found):
        waiting = sorted(found[text], reverse=True)
        open_: list[tuple[int, int, int]] = []
        at = 0
        while True:
            open_ = [r for r in open_ if r[1] - (TURNS - 1) * r[2] >= at]
            if not open_:
                if not waiting:
                    break
                at = max(at, waiting[-1][0])
            while waiting and waiting[-1][0] <= at:
                open_.append(waiting.pop())
            open_ = [r for r in open_ if r[1] - (TURNS - 1) * r[2] >= at]
            if not open_:
                continue
            _, stop, period = max(open_, key=lambda r: r[2])
            turns = (stop - at) // period + 1
            if not all(chr(c).isspace() for c in batch.codes[at : at + period]):
                yield text, period, turns
            at += turns * period


def scan(texts: list[str | None]) -> list[tuple | None]:
    """(kind, pattern_length, repetitions, span) of each text, or None: a run of one character, else a run of tabs, else a pattern, the first of its kind."""
    given = [t or "" for t in texts]
    out: list[tuple | None] = [None] * len(given)
    for text, period, turns in _patterns(_Batch([ALIASES.sub("", t) if "E" in t else t for t in given])):
        out[text] = out[text] or ("PATTERN_LOOP", period, turns, period * turns)
    same, tabs = _character_runs(_Batch(given))
    for kind, runs in (("TAB_RUN", tabs), ("CHAR_RUN", same)):  # the kind that counts most comes last
        for text, length in reversed(runs):
            out[text] = (kind, 1, length, length)
    return out


def longest(texts: list[str]) -> list[tuple | None]:
    """The same by the widest span of each text; the first run of tabs goes before all others."""
    batch = _Batch(texts)
    out: list[tuple | None] = [None] * len(texts)
    same, tabs = _character_runs(batch)
    spans = [(t, ("CHAR_RUN", 1, n, n)) for t, n in same] + [(t, ("PATTERN_LOOP", p, n, p * n)) for t, p, n in _patterns(batch)]
    for text, told in spans:
        if out[text] is None or told[3] > out[text][3]:
            out[text] = told
    for text, length in reversed(tabs):
        out[text] = ("TAB_RUN", 1, length, length)
    return out


def _parted(answer: str) -> tuple[str, list[str]] | None:
    """An answer that is a JSON object, told again without its free texts, and those in order; None for anything else."""
    lines = answer.strip().split("\n") if answer.strip().startswith("```") else None
    if lines:
        answer = "\n".join(lines[1:-1] if lines[-1].startswith("```") and len(lines) > 1 else lines[1:])
    try:
        value = json.loads(answer.strip())
    except (ValueError, RecursionError):
        return None
    if not isinstance(value, dict):
        return None
    free: list[str] = []
    todo = [value]
    while todo:  # depth first, in the order of the text
        node = todo.pop()
        if isinstance(node, tuple):
            free.append(node[0])
            continue
        inner = []
        for name, x in node.items() if isinstance(node, dict) else enumerate(node):
            if isinstance(x, (dict, list)):
                inner.append(x)
            elif name in FREE_TEXT and isinstance(x, str):
                node[name] = ""
                inner.append((x,))
        todo += reversed(inner)
    return json.dumps(value, ensure_ascii=False), free


def scan_answers(answers: list[str | None]) -> list[tuple | None]:
    """(kind, pattern_length, repetitions, span) of model answers that are degenerate, else None.

    Of a JSON object, all but its free texts is told by scan(), and a free text only where it has a run of tabs or repeats over 64 characters
    or more. Any other answer is told by scan().
    """
    given = [a or "" for a in answers]
    parts = [_parted(a) for a in given]
    out = scan([p[0] if p else a for p, a in zip(parts, given, strict=True)])
    owner = [n for n, p in enumerate(parts) if p for _ in p[1]]
    texts = [t for p in parts if p for t in p[1]]
    for n, told in zip(owner, longest(texts) if texts else [], strict=True):
        if out[n] is None and told and (told[0] == "TAB_RUN" or told[3] >= FREE_SPAN):
            out[n] = told
    return out


def _pieces(texts: pa.Array) -> Iterator[list[str | None]]:
    """A batch's texts in pieces of PIECE_BYTES at most, a longer text by itself."""
    begin = held = 0
    for n, size in enumerate(pc.fill_null(pc.binary_length(texts), 0).to_pylist()):
        if n > begin and held + size > PIECE_BYTES:
            yield texts.slice(begin, n - begin).to_pylist()
            begin, held = n, 0
        held += size
    yield texts.slice(begin).to_pylist()


def told(find: Callable[[list[str | None]], list[tuple | None]], texts: pa.Array) -> pa.StructArray:
    """What scan() or scan_answers() finds in a batch, a piece at a time: what it holds grows with a piece, not with the batch."""
    rows = [f or (None,) * 4 for piece in _pieces(texts) for f in find(piece)]
    return pa.StructArray.from_arrays([pa.array([r[n] for r in rows], t) for n, t in enumerate((pa.string(), *[pa.int32()] * 3))], names=["kind", "pattern_length", "repetitions", "span"])


def repetition(text: Column) -> Column:
    """{kind, pattern_length, repetitions, span} of a text that repeats itself; the kind of any other, null and empty ones too, is null.

    CHAR_RUN: 15 equal characters in a row that aren't white space. TAB_RUN: 12 tabs. PATTERN_LOOP: 2 to 25 characters within a line, not all of them white space, six times in a row,
    where lists of quoted aliases are left out. Of several, a character goes before tabs and those before a pattern.
    """

    @F.arrow_udf(RESULT)
    def found(texts: pa.Array) -> pa.Array:
        return told(scan, texts)

    return found(text)


def answer_repetition(answer: Column) -> Column:
    """The same of a model's answer: its structure by repetition(), its free texts by the widest span, 64 characters or more. An answer that isn't a JSON object is told as text."""

    @F.arrow_udf(RESULT)
    def found(answers: pa.Array) -> pa.Array:
        return told(scan_answers, answers)

    return found(answer)


def degenerate(text: Column) -> Column:
    """Whether a text repeats itself, by repetition()."""
    return repetition(text)["kind"].isNotNull()
