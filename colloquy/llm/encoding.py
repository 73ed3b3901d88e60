"""Whole-text encoding with the tokenizers library, with a bounded memory of pieces already encoded.

A byte-pair tokenizer cuts a text into pieces by a pattern and merges within each piece alone. For a text in
Latin-1 characters the normaliser and the pattern are simple enough to state here, so its pieces are cut at once and the library's
model merges each distinct piece once; any other text, and any that holds the string of an added token, goes to the library whole. Results
are those of the library for the whole text, which the tests compare.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Pieces remembered per worker process; when full, those met since the last time are kept.
MEMORY = 600_000

#: Letters, numbers and white space of Latin-1, as the patterns of the vocabularies class them.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\\t-\\r \x85\xa0"
_ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: The pieces of the vocabulary that drops white space and of the one that keeps it.
_DROPS = re.compile(f"{_ENDINGS}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_KEEPS = re.compile(f"{_ENDINGS}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[^\\x00-\xff]")


def byte_letters() -> dict[int, str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else the next from U+0100."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(rest)}


_open: dict[tuple[str, bool], TextEncoder] = {}


def latin_pieces(text: str | None, lowers: bool) -> list[str] | None:
    """The pieces of a text of Latin-1 characters, or None for any other; a null text has none."""
    if not text:
        return []
    if not text.isascii() and _BEYOND.search(text):
        return None
    return (_DROPS if lowers else _KEEPS).findall(text.lower() if lowers else text)


class TextEncoder:
    """Encodes texts to identifiers as little-endian unsigned 32-bit integers in bytes.

    lowers: the vocabulary lowers case and drops white space; otherwise it keeps both.
    """

    def __init__(self, path: str, lowers: bool, memory: int = MEMORY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.lowers = lowers
        self.special = re.compile("|".join(re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()) or "(?!)").search
        self.letters = byte_letters()
        self.memory, self.known = memory, _Known(self._encode_piece, {})

    def library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def pieces(self, text: str | None) -> list[str] | None:
        """The pieces of a text, or None where the library has to cut it: beyond Latin-1, or around the strings of its added tokens."""
        return None if text and self.special(text) else latin_pieces(text, self.lowers)

    def _encode_piece(self, piece: str) -> bytes:
        mapped = piece if piece.isascii() and piece.isalnum() else "".join(map(self.letters.__getitem__, piece.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.merge(mapped)])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The identifiers of each text; a null text has none."""
        out = []
        for text in texts:
            if len(self.known) > self.memory // 2:
                self.known = _Known(self._encode_piece, self.known)
            cut = self.pieces(text)
            out.append(b"".join(map(self.known.__getitem__, cut)) if cut is not None else self.library([text])[0])
        return out


class _Known(dict):
    """Identifiers by piece; a new piece is taken from the memory before this one or else encoded."""

    def __init__(self, encode, before: dict):
        super().__init__()
        self.encode, self.before = encode, dict(before)

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self.before.get(piece) or self.encode(piece)
        return found


def encoder(path: str, lowers: bool) -> TextEncoder:
    """This process's encoder for a vocabulary file."""
    if (path, lowers) not in _open:
        _open[path, lowers] = TextEncoder(path, lowers)
    return _open[path, lowers]


def slices(texts: list, most: int = 4_000_000) -> list[slice]:
    """Cut a list of texts so that each part has about `most` characters at most, a longer text alone."""
    out, start, size = [], 0, 0
    for n, t in enumerate(texts):
        if size and size + len(t or "") > most:
            out.append(slice(start, n))
            start, size = n, 0
        size += len(t or "")
    return [*out, slice(start, len(texts))] if start < len(texts) else out
