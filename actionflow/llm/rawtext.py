"""Vectorised work on the UTF-8 bytes of a text column.

Arrow hands a string column over as one buffer of bytes and one of offsets. The
functions here find words, lines and word windows in that buffer for many
documents at once, without making a Python string for each.

A span is hashed eight bytes at a time: each eight, with its place in the span, goes
through a bijection that spreads every bit, and the sum of those and of the length
through another. All words (or lines) of a slice take a handful of array operations.
Equal spans always get equal hashes, in every process. Where a count rests on spans
being equal, ``classes`` compares the bytes of those with equal hashes.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
U = np.uint64

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


MASK = np.array([(1 << (8 * k)) - 1 for k in range(9)], np.uint64)  # keeps the first k of eight bytes
LENGTH = U(0xD1342543DE82EF95)
MOST_EIGHTS = 1 << 18  # of long spans that are worked on at once


@dataclass
class Slice:
    """Some consecutive documents of a column: their bytes and where each starts."""

    data: np.ndarray
    at: np.ndarray  # of each document, and the end

    def __post_init__(self) -> None:
        self.n = len(self.at) - 1
        self.held: dict[bool, np.ndarray] = {}

    def per_doc(self, flags: np.ndarray) -> np.ndarray:
        """How many bytes of each document are flagged."""
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return total[self.at[1:]] - total[self.at[:-1]]

    def byte_counts(self) -> np.ndarray:
        """How often each document has each of the 256 bytes."""
        out = np.zeros((self.n, 256), np.int64)
        for i, (a, b) in enumerate(zip(self.at[:-1].tolist(), self.at[1:].tolist(), strict=True)):
            out[i] = np.bincount(self.data[a:b], minlength=256)
        return out

    def doc_of(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position, "right") - 1

    def words(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every run without ASCII white space, inside its document."""
        inside = ~SPACE[self.data]
        before = np.zeros(len(inside), bool)
        before[1:] = inside[:-1]
        edge = self.at[:-1][self.at[:-1] < len(inside)]
        before[edge] = False
        start = np.flatnonzero(inside & ~before)
        after = np.zeros(len(inside), bool)
        after[:-1] = inside[1:]
        last = self.at[1:] - 1
        after[last[last >= 0]] = False
        return start, np.flatnonzero(inside & ~after) + 1

    def lines(self) -> tuple[np.ndarray, np.ndarray]:
        """Start and end of every line; documents of no bytes have none."""
        full = np.flatnonzero(self.at[1:] > self.at[:-1])
        breaks = np.flatnonzero(self.data == 10)
        return np.sort(np.concatenate([self.at[:-1][full], breaks + 1])), np.sort(np.concatenate([self.at[1:][full], breaks]))

    def eights(self, lower: bool = False) -> np.ndarray:
        """The eight bytes from each position on as a number, zeros behind the end."""
        if lower not in self.held:
            data = np.zeros(len(self.data) + 16, np.uint8)
            data[: len(self.data)] = LOWER[self.data] if lower else self.data
            self.held[lower] = np.ndarray((len(self.data) + 8,), "<u8", data, strides=(1,))
        return self.held[lower]

    def hashes(self, start: np.ndarray, end: np.ndarray, lower: bool = False) -> np.ndarray:
        """A hash of each span; with ``lower``, A-Z count as a-z."""
        eights, size = self.eights(lower), end - start
        total = mix(eights[start] & MASK[np.minimum(size, 8)])
        for own, at, first in _later_eights(size):
            x = mix((eights[start[own] + 8 * at] & MASK[np.minimum(size[own] - 8 * at, 8)]) ^ mix(at.astype(np.uint64)))
            total[own[first]] += np.add.reduceat(x, first)
        return mix(total + size.astype(np.uint64) * LENGTH)

    def same(self, a: np.ndarray, b: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """If spans number a and b (arrays) have the same bytes."""
        eights, size, x, y = self.eights(), (end - start)[a], start[a], start[b]
        mask = MASK[np.minimum(size, 8)]
        out = (size == (end - start)[b]) & ((eights[x] & mask) == (eights[y] & mask))
        maybe = np.flatnonzero(out)
        size, x, y = size[maybe], x[maybe], y[maybe]
        for own, at, _ in _later_eights(size):
            mask = MASK[np.minimum(size[own] - 8 * at, 8)]
            out[maybe[own[(eights[x[own] + 8 * at] & mask) != (eights[y[own] + 8 * at] & mask)]]] = False
        return out


def _later_eights(size: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """The eights of spans of ``size`` bytes without each one's first, a bounded number at a time.

    The span of each, its number in the span, and where a new span starts among them.
    """
    long = np.flatnonzero(size > 8)
    ends = np.cumsum((size[long] - 1) >> 3)
    for low in range(0, int(ends[-1]) if len(ends) else 0, MOST_EIGHTS):
        flat = np.arange(low, min(low + MOST_EIGHTS, int(ends[-1])))
        k = np.searchsorted(ends, flat, "right")
        before = np.where(k > 0, ends[k - 1], 0)
        first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        yield long[k], flat - before + 1, first


def classes(key: np.ndarray, same: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """A number for each item, equal where ``same`` says that two are, and only there.

    Equal items have equal keys. Items with equal keys are compared with their
    neighbours in sorted order; only where those differ one by one.
    """
    order = np.argsort(key)
    new = np.ones(len(key), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    again = np.flatnonzero(~new)
    wrong = again[~same(order[again - 1], order[again])] if len(again) else again
    fresh = len(key)
    for run in np.unique(number[order[wrong]]):
        known: list[int] = []
        for i in np.flatnonzero(number == run):
            one = np.array([i])
            met = next((k for k in known if same(np.array([k]), one)[0]), None)
            if met is None:
                known.append(int(i))
                number[i], fresh = fresh, fresh + 1
            else:
                number[i] = number[met]
    return np.unique(number, return_inverse=True)[1] if len(wrong) else number


def slices(column: pa.Array | pa.ChunkedArray, most: int = SLICE_BYTES) -> Iterator[Slice]:
    """The column in slices of about ``most`` bytes; a longer document is a slice of its own. Null counts as empty."""
    for chunk in column.chunks if isinstance(column, pa.ChunkedArray) else [column]:
        chunk = chunk.cast(pa.large_string())
        if chunk.null_count:
            chunk = chunk.fill_null("")
        if not len(chunk):
            continue
        _, offsets, data = chunk.buffers()
        at = np.frombuffer(offsets, np.int64)[chunk.offset : chunk.offset + len(chunk) + 1]
        raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
        i = 0
        while i < len(chunk):
            j = max(i + 1, int(np.searchsorted(at, at[i] + most, "right")) - 1)
            yield Slice(raw[at[i] : at[j]], at[i : j + 1] - at[i])
            i = j


def windows(word: np.ndarray, doc: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first word of each run of ``size`` words of one document."""
    if len(word) < size:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    n = len(word) - size + 1
    total = word[:n].copy()
    for k in range(1, size):
        total *= U(0xD6E8FEB86659FD93)
        total += word[k : k + n]
    first = np.flatnonzero(doc[:n] == doc[size - 1 :])
    return mix(total[first]), first
