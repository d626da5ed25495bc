"""Token ids of whole texts by a vocabulary file of the ``tokenizers`` library, at word-cache speed.

The vocabulary splits a text into pieces (letters, single digits, runs of other signs) that are encoded on their own,
so equal pieces have equal ids and a cache of pieces gives what the library gives. Texts with characters for which that
is not plain to see (anything beyond Latin Extended-A, control characters, special tokens) go to the library whole.
"""

from __future__ import annotations

import re
import unicodedata
from functools import cache

import numpy as np

#: Pieces kept by one Python worker; the cache is emptied beyond that.
CACHE_PIECES = 450_000
#: Longer texts are split at white space, so that the list of pieces stays small.
SEGMENT = 1 << 20

_PLAIN = [chr(c) for c in range(0x21, 0x180) if not 0x7F <= c <= 0xA0 and c != 0x130]


def _signs(kind: str) -> str:
    return "".join(re.escape(c) for c in _PLAIN if unicodedata.category(c)[0] == kind)


_LETTERS, _DIGITS = _signs("L"), _signs("N")
_OTHER_TEXT = re.compile(rf"[^{''.join(map(re.escape, _PLAIN))} \t\n\r]|<\|")
_PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_DIGITS}]|[^\s{_LETTERS}{_DIGITS}]+")
_BREAK = re.compile(r"\s")


class Encoder:
    """Ids of a text as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole, self.known = Tokenizer.from_file(path), {}

    def __call__(self, text: str) -> bytes:
        if _OTHER_TEXT.search(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return b"".join(self._plain(part) for part in segments(text))

    def _plain(self, text: str) -> bytes:
        pieces = _PIECE.findall(text.lower())
        if len(self.known) > CACHE_PIECES:
            self.known.clear()
        try:
            return b"".join([self.known[p] for p in pieces])
        except KeyError:
            self._learn(list(set(pieces).difference(self.known)))
            return b"".join([self.known[p] for p in pieces])

    def _learn(self, pieces: list[str]) -> None:
        found = self.whole.encode(" ".join(pieces), add_special_tokens=False)
        ids, ends = np.array(found.ids, dtype="<u4").tobytes(), (4 * np.cumsum(np.bincount(found.word_ids, minlength=len(pieces)))).tolist()
        start = 0
        for piece, end in zip(pieces, ends, strict=True):
            self.known[piece] = ids[start:end]
            start = end


@cache
def encoder(path: str) -> Encoder:
    """One for each worker and vocabulary file."""
    return Encoder(path)


def segments(text: str):
    """The text in parts of about SEGMENT characters, cut only at white space."""
    at = 0
    while len(text) - at > SEGMENT and (cut := _BREAK.search(text, at + SEGMENT)):
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]
