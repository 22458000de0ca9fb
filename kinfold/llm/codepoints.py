"""Texts of a whole Arrow batch as arrays of code points, changed by table look-ups.

One text at a time, Python and the JVM's `translate` spend some 100 ns a character on a large map. Here the
texts of a batch lie end to end in one array, so a map is one take per piece of text, whatever its size.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Code points from here on are not assigned, or private, but for the block of invisible ones: nothing maps them.
ASSIGNED = (*range(0x30000), *range(0xE0000, 0xE0200))
_TOP = 0x110000
_PIECE = 1 << 20


@dataclass
class CodeTable:
    """Code point to none, one or several code points. Identity where nothing is said."""

    delta: np.ndarray  # first code point of the replacement less the code point itself
    size: np.ndarray  # how many the replacement has
    start: np.ndarray  # where it starts in `flat`, for those of several
    flat: np.ndarray

    @classmethod
    def of(cls, replaced: dict[int, str]) -> CodeTable:
        delta, size, start = np.zeros(_TOP, np.int32), np.ones(_TOP, np.uint8), np.zeros(_TOP, np.int32)
        flat: list[int] = []
        for cp, text in replaced.items():
            size[cp] = len(text)
            if text:
                delta[cp] = ord(text[0]) - cp
            if len(text) > 1:
                start[cp] = len(flat)
                flat += map(ord, text)
        return cls(delta, size, start, np.array(flat, np.uint32))

    def __getstate__(self):
        """Only what is mapped travels to the workers."""
        at = np.flatnonzero((self.delta != 0) | (self.size != 1)).astype(np.int32)
        return at, self.delta[at], self.size[at], self.start[at], self.flat

    def __setstate__(self, state):
        at, delta, size, start, self.flat = state
        self.delta, self.size, self.start = np.zeros(_TOP, np.int32), np.ones(_TOP, np.uint8), np.zeros(_TOP, np.int32)
        self.delta[at], self.size[at], self.start[at] = delta, size, start

    def apply(self, cps: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The texts mapped, and where each begins and ends then."""
        n = self.size[cps]
        one = (cps.astype(np.int32) + self.delta[cps]).astype(np.uint32)
        if n.min(initial=1) == 1 == n.max(initial=1):
            return one, ends
        at = np.concatenate(([0], np.cumsum(n, dtype=np.int64)))
        if n.max() <= 1:
            return one[n == 1], at[ends]
        out = np.repeat(one, n)
        for i in np.flatnonzero(n > 1):
            s = self.start[cps[i]]
            out[at[i] : at[i + 1]] = self.flat[s : s + n[i]]
        return out, at[ends]


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Texts end to end, and where each begins and ends."""
    joined = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(joined, np.uint32), np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))


def strings(cps: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The texts as an Arrow array."""
    data = np.ascontiguousarray(cps, np.uint32).tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "replace")
    width = 1 + (cps >= 0x80).astype(np.int8) + (cps >= 0x800) + (cps >= 0x10000)
    at = np.concatenate(([0], np.cumsum(width, dtype=np.int64)))[ends]
    return pa.LargeStringArray.from_buffers(len(ends) - 1, pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data)).cast(pa.string())


def pieces(column: pa.Array, size: int = _PIECE) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, code points, begins and ends) of runs of rows of about `size` bytes; NULL is an empty text, a longer text a piece of its own."""
    column = column.cast(pa.large_string())
    if not len(column):
        return
    offset, data = column.buffers()[1], column.buffers()[2]
    at = np.frombuffer(offset, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + size, "right")) - 1)
        hi = min(hi, len(column))
        part = raw[at[lo] : at[hi]]
        try:
            text = part.tobytes().decode("utf-8")
            lead = np.concatenate(([0], np.cumsum((part & 0xC0) != 0x80, dtype=np.int64)))
            yield lo, hi, np.frombuffer(text.encode("utf-32-le"), np.uint32), lead[at[lo : hi + 1] - at[lo]]
        except UnicodeDecodeError:
            yield lo, hi, *code_points([bytes(raw[a:b]).decode("utf-8", "replace") for a, b in zip(at[lo:hi], at[lo + 1 : hi + 1], strict=True)])
        lo = hi


def picked(cps: np.ndarray, ends: np.ndarray, texts: np.ndarray) -> list[str]:
    """Some of the texts as strings."""
    return [cps[ends[i] : ends[i + 1]].tobytes().decode("utf-32-le", "surrogatepass") for i in texts]


def replaced(cps: np.ndarray, ends: np.ndarray, at: np.ndarray, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The texts with those numbered `at` (ascending) replaced."""
    if not len(at):
        return cps, ends
    out, last, size = [], 0, np.diff(ends)
    for i, t in zip(at, texts, strict=True):
        new = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32)
        out += [cps[last : ends[i]], new]
        last, size[i] = ends[i + 1], len(new)
    return np.concatenate([*out, cps[last:]]), np.concatenate(([0], np.cumsum(size)))


_ROOT = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = []


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse, modulo 2^64."""
    if not _POWERS or len(_POWERS[0]) < n:
        size = max(n, _PIECE)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.cumprod(np.full(size - 1, r, np.uint64)))) for r in (_ROOT, _BACK)]
    return _POWERS[0], _POWERS[1]


def _stirred(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _prefix(cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    up, down = _powers(len(cps) + 1)
    spread = (cps.astype(np.uint64) + np.uint64(1)) * np.uint64(0x94D049BB133111EB)
    return np.concatenate((np.zeros(1, np.uint64), np.cumsum((spread ^ (spread >> np.uint64(32))) * up[: len(cps)]))), down


def text_codes(cps: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit code of each text, equal for equal texts."""
    total, down = _prefix(cps)
    return _stirred((total[ends[1:]] - total[ends[:-1]]) * down[ends[:-1]] + np.diff(ends).astype(np.uint64))


def gram_codes(cps: np.ndarray, q: int) -> np.ndarray:
    """A 64-bit code of the q characters at each position, equal for equal ones; grams may run across texts."""
    if len(cps) < q:
        return np.zeros(0, np.uint64)
    total, down = _prefix(cps)
    return _stirred((total[q:] - total[:-q]) * down[: len(cps) - q + 1])
