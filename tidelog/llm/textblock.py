"""Words of a block of texts as numpy arrays: one pass over the bytes, without a loop over words."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

from tidelog.llm.common import mix64

BASE = 0x9E3779B97F4A7C13
INVERSE = pow(BASE, -1, 1 << 64)

#: Words are what stands between blanks (space and bytes 9 to 13), unchanged.
BLANKS = np.array([c == 32 or 9 <= c <= 13 for c in range(256)])
PLAIN = np.arange(256, dtype=np.uint8)
#: Words are runs of letters, digits and bytes of characters beyond ASCII; A-Z read as a-z.
NO_WORD = np.array([not (48 <= c <= 57 or 65 <= c <= 90 or 97 <= c <= 122 or c >= 128) for c in range(256)])
LOWER = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], dtype=np.uint8)

_SYMBOLS = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
_powers: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """base ** 0, 1, ... mod 2**64, n of them at least."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        factors = np.full(max(n, 1 << 16), base, np.uint64)
        factors[0] = 1
        have = _powers[base] = np.cumprod(factors, dtype=np.uint64)
    return have


def spans(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of values[start:end] for each pair, from prefix sums of a polynomial."""
    n = len(values)
    prefix = np.zeros(n + 1, np.uint64)
    np.cumsum(values * powers(BASE, n)[:n], out=prefix[1:])
    return mix64((prefix[ends] - prefix[starts]) * powers(INVERSE, n + 1)[starts] + (ends - starts).astype(np.uint64))


class Block:
    """Texts one after another; `word` holds a hash of each word, `first` each text's first word (and the number of words)."""

    def __init__(self, texts: Iterable[bytes], blank: np.ndarray = BLANKS, fold: np.ndarray = PLAIN):
        texts = list(texts)
        self.raw = b" ".join([b"", *texts, b""])
        raw = np.frombuffer(self.raw, np.uint8)
        gap = blank[raw]
        edge = np.flatnonzero(gap[1:] != gap[:-1]) + 1
        self.start, self.end = edge[0::2], edge[1::2]
        self.word = spans(_SYMBOLS[fold[raw]], self.start, self.end) if len(self.start) else np.zeros(0, np.uint64)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        self.first = np.searchsorted(self.start, np.concatenate([[0], np.cumsum(sizes + 1)]))

    def __len__(self) -> int:
        return len(self.first) - 1

    def windows(self, size: int) -> np.ndarray:
        """Hashes of `size` consecutive words from every word on, also across texts (see `inside`)."""
        n = len(self.word)
        if n < size:
            return np.zeros(0, np.uint64)
        at = np.arange(n - size + 1)
        return spans(self.word, at, at + size)

    def inside(self, size: int) -> np.ndarray:
        """Whether the window from each word on lies in one text."""
        n = len(self.word) - size + 1
        if n <= 0:
            return np.zeros(0, bool)
        last = np.repeat(self.first[1:], np.diff(self.first))[:n]
        return np.arange(n) + size <= last


def sliding_argmin(values: np.ndarray, size: int) -> np.ndarray:
    """Place of the smallest of every `size` consecutive values, the first of equals."""
    at = np.arange(len(values))
    if len(values) < size:
        return at[:0]

    def smaller(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.where(values[b] < values[a], b, a)

    k = 1
    while 2 * k <= size:
        at = smaller(at[:-k], at[k:])
        k *= 2
    rest = size - k
    return smaller(at[: len(at) - rest], at[rest:]) if rest else at
