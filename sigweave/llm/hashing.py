"""Hashes of all words, word shingles and character n-grams of many texts at once, in numpy.

A prefix sum of code-point values times powers of an odd base gives the hash of any stretch of text
from two entries, in wrapping 64-bit arithmetic.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

#: Characters in one step, about; only a longer word makes a step longer.
STEP = 1 << 20
_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit over all bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Tables:
    """Powers of the base and its inverse, as long as asked for so far."""

    up = _powers(_BASE, STEP)
    down = _powers(_INVERSE, STEP)

    @classmethod
    def to(cls, n: int) -> None:
        if n >= len(cls.up):
            cls.up, cls.down = _powers(_BASE, 2 * n), _powers(_INVERSE, 2 * n)


class Chunk:
    """Some texts, each a whole number of words, with white space as one code point and around every text."""

    def __init__(self, docs: list[int], texts: list[str]):
        joined = " " + " ".join(texts) + " "
        code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        _Tables.to(len(code))
        space = (code == 32) | ((code >= 9) & (code <= 13))
        code[space] = 32
        self.space, self.code = space, code
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        self.start, self.end = edge[::2], edge[1::2]
        begins = np.cumsum([1] + [len(t) + 1 for t in texts])
        ids = np.asarray(docs, np.int64)
        self.word_doc = ids[np.searchsorted(begins, self.start, side="right") - 1] if len(texts) else np.empty(0, np.int64)
        self.prefix = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(mix(code + np.uint64(1)) * _Tables.up[: len(code)], out=self.prefix[1:])

    def _hash(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.prefix[b] - self.prefix[a]) * _Tables.down[a])

    def words(self) -> np.ndarray:
        return self._hash(self.start, self.end)

    def grams(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """``(word, hash)`` of the runs of ``n`` characters inside words, a space on either side counting as one."""
        size = self.end - self.start + 2
        each = np.maximum(size - n + 1, 0)
        word = np.repeat(np.arange(len(each)), each)
        first = np.repeat(self.start - 1 - (np.cumsum(each) - each), each) + np.arange(len(word))
        return word, self._hash(first, first + n)


def _parts(text: str) -> Iterator[str]:
    """The text in parts of whole words, of about ``STEP`` characters."""
    at = 0
    while len(text) - at > STEP:
        stop = max(text.rfind(c, at + 1, at + STEP) for c in " \t\n\r\v\f")
        if stop < 0:
            found = [x for c in " \t\n\r\v\f" if (x := text.find(c, at + STEP)) >= 0]
            if not found:
                break
            stop = min(found)
        yield text[at:stop]
        at = stop
    yield text[at:]


def chunks(texts: list[str], lower: str = "ascii") -> Iterator[Chunk]:
    """All texts in order; ``lower``: "ascii" folds A-Z only, "all" every letter, "no" none."""
    docs: list[int] = []
    parts: list[str] = []
    size = 0
    for i, text in enumerate(texts):
        for part in _parts(text or ""):
            docs.append(i)
            parts.append(part.lower() if lower == "all" else part)
            size += len(part)
            if size >= STEP:
                yield _folded(docs, parts, lower)
                docs, parts, size = [], [], 0
    if docs:
        yield _folded(docs, parts, lower)


_ASCII = {c: c + 32 for c in range(65, 91)}


def _folded(docs: list[int], parts: list[str], lower: str) -> Chunk:
    if lower == "ascii":
        joined = "\0".join(parts)
        folded = joined.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")  # bytes fold A-Z only
        parts = folded.split("\0") if joined.count("\0") == len(parts) - 1 else [p.translate(_ASCII) for p in parts]
    return Chunk(docs, parts)


def word_hashes(texts: list[str], lower: str = "ascii") -> list[np.ndarray]:
    """For each text the hashes of its words in order."""
    doc, hashes = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for chunk in chunks(texts, lower):
        doc.append(chunk.word_doc)
        hashes.append(chunk.words())
    ends = np.cumsum(np.bincount(np.concatenate(doc), minlength=len(texts)))
    return np.split(np.concatenate(hashes), ends[:-1]) if len(texts) else []


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """The hashes of all runs of ``size`` words; of all words together if there are fewer; none for none."""
    n = min(size, len(words))
    if not n:
        return words
    factor = _powers(_INVERSE, size)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out += words[i : len(words) - n + 1 + i] * factor[i + 1]
    return mix(out)
