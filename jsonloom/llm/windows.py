"""Words, and hashes of windows of words, of many texts at once in numpy."""

from __future__ import annotations

import numpy as np

from .common import mix

BASE = 0x9E3779B97F4A7C15
TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_blank = np.zeros(256, bool)
_blank[[0x20, *range(9, 14)]] = True


def weights(n: int) -> np.ndarray:
    """Odd numbers without order, one for each place: a sum with powers of one base would let some long words meet."""
    return mix(np.arange(1, n + 1, dtype=np.uint64) * np.uint64(BASE)) | np.uint64(1)


#: A number without order for each byte.
BYTES = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


class Words:
    """The words ``[^\\x20\\x09-\\x0D]+`` of a list of texts, end to end.

    start, end: byte offsets of the words in ``data``; of: the text of each;
    first: the number of the first word of each text (one more at the end).
    """

    def __init__(self, texts: list[str | None]) -> None:
        raw = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts]
        self.data = np.frombuffer(b" ".join([*raw, b""]), np.uint8)
        solid = ~_blank[self.data]
        edge = np.diff(solid.astype(np.int8), prepend=0)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        ends = np.cumsum([len(r) + 1 for r in raw]) if raw else np.zeros(0, np.int64)
        self.first = np.append(0, np.searchsorted(self.start, ends)).astype(np.int64)
        self.of = np.repeat(np.arange(len(raw)), np.diff(self.first))

    def hashes(self) -> np.ndarray:
        """A 64-bit hash of each word."""
        if not len(self.start):
            return np.zeros(0, np.uint64)
        lens = self.end - self.start
        place = np.arange(len(self.data)) - np.repeat(np.append(0, self.start), np.diff(np.append(np.append(0, self.start), len(self.data))))
        longest = int(lens.max())
        values = BYTES[self.data] * weights(longest)[np.minimum(place, longest - 1)]
        values[_blank[self.data]] = 0
        sums = np.add.reduceat(values, self.start)
        return mix(sums + lens.astype(np.uint64) * np.uint64(BASE))

    def inside(self, n: int) -> np.ndarray:
        """Whether n words of the same text start at each word."""
        ends = np.repeat(self.first[1:], np.diff(self.first))
        return np.arange(len(self.of)) + n <= ends


def window_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of the n words from each word on; wrong where fewer follow."""
    out, have = None, 0
    step, size, base = words, 1, BASE
    while n:
        if n & 1:
            if out is None:
                out, have = step, size
            else:  # what is there comes first, then `size` more words
                out, have = out * np.uint64(base) + shifted(step, have), have + size
        n >>= 1
        if n:
            step, size, base = step * np.uint64(base) + shifted(step, size), size * 2, base * base % (1 << 64)
    return mix(out)


def second_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Another hash of the same windows: with the first, 128 bits."""
    return window_hashes(mix(words ^ np.uint64(0x5851F42D4C957F2D)), n)


def shifted(x: np.ndarray, by: int) -> np.ndarray:
    """x[i + by] at i, 0 beyond the end."""
    out = np.zeros_like(x)
    if by < len(x):
        out[: len(x) - by] = x[by:]
    return out


def sliding(x: np.ndarray, n: int, best: np.ufunc, beyond: np.uint64) -> np.ndarray:
    """The best of x[i], ..., x[i + n - 1] at i, where what lies beyond the end counts as ``beyond``."""
    out, size = x, 1
    while size < n:
        by = min(size, n - size)
        out = best(out, np.concatenate([out[by:], np.full(min(by, len(out)), beyond, x.dtype)]))
        size += by
    return out
