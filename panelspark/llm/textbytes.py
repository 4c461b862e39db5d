"""Whole texts as UTF-8 bytes inside a task: words, their hashes, slices of bounded size.

Operators hand Arrow batches to :func:`slices`, which cuts them between documents so
that a task's arrays stay small whatever a batch holds; only a single document larger
than the slice makes a larger one.  Nothing here knows of Spark's driver or of tables.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

SLICE_BYTES = 1 << 21

_SPACE = [0x20, *range(0x09, 0x0E)]
#: Words of [^\x20\x09-\x0D]+ (any byte but white space).
PLAIN = np.ones(256, bool)
PLAIN[_SPACE] = False
#: Words of [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z: digits, a-z, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x61:0x7B] = ALNUM[0x41:0x5B] = ALNUM[0x80:] = True

_rng = np.random.default_rng(20240229)
_BYTE = _rng.integers(1, 2**64 - 1, 256, dtype=np.uint64)
_FOLDED = _BYTE.copy()
_FOLDED[0x41:0x5B] = _BYTE[0x61:0x7B]
_P = 0x9E3779B97F4A7C15
_P_INVERSE = pow(_P, -1, 2**64)
_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the hash's base and of its inverse, modulo 2^64."""
    if len(_powers[0]) < n:
        for i, base in enumerate((_P, _P_INVERSE)):
            steps = np.full(max(n, SLICE_BYTES + 1), base, np.uint64)
            steps[0] = 1
            _powers[i] = np.multiply.accumulate(steps)
    return _powers[0][:n], _powers[1][:n]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread a 64-bit value over all its bits."""
    x = x ^ (x >> np.uint64(31))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(32)
    return x


class Slice:
    """Whole texts of a run of rows: bytes one after another, and where each begins."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, first: int):
        self.data, self.offsets, self.first = data, offsets, first

    def __len__(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()

    def words(self, kind: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start and end of every word, and the number of the first word of each text (one more entry than texts)."""
        inside = kind[self.data]
        n = len(inside)
        begins, ends = inside.copy(), inside.copy()
        begins[1:] &= ~inside[:-1]
        ends[:-1] &= ~inside[1:]
        cuts = self.offsets[:-1]
        cuts = cuts[cuts < n]
        begins[cuts] = inside[cuts]
        last = self.offsets[1:] - 1
        last = last[last >= 0]
        ends[last] = inside[last]
        starts = np.flatnonzero(begins)
        return starts, np.flatnonzero(ends) + 1, np.searchsorted(starts, self.offsets)

    def prefix(self, fold: bool) -> np.ndarray:
        """Running sums from which :func:`span_hash` takes the hash of any span."""
        values = (_FOLDED if fold else _BYTE)[self.data]
        out = np.zeros(len(values) + 1, np.uint64)
        np.cumsum(values * powers(len(values) + 1)[0][:-1], out=out[1:])
        return out


def span_hash(prefix: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans; equal bytes hash alike wherever they stand."""
    return mix((prefix[ends] - prefix[starts]) * powers(len(prefix))[1][starts])


def gram_hash(words: np.ndarray, n: int, order: int = 0) -> np.ndarray:
    """Hash of the n words from each place on; the last n - 1 places have none.

    Spans of several texts are hashed too, callers drop them.
    """
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(m, 0x51ED270B0929 + n + order, np.uint64)
    for k in range(n):
        out = (out ^ words[k:k + m]) * np.uint64(0xD6E8FEB86659FD93)
        out ^= out >> np.uint64(32)
    return mix(out)


def slices(column: pa.Array | pa.ChunkedArray, limit: int = SLICE_BYTES) -> Iterator[Slice]:
    """Runs of whole texts of at most ``limit`` bytes, a longer text by itself; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield Slice(data[offsets[at]:offsets[to]], offsets[at:to + 1] - offsets[at], at)
        at = to


def give_back() -> None:
    """Return freed memory to the system at a task's end: Python workers live on, and an executor's tasks share it."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library; others need no asking
    if trim is not None:
        trim(0)


def frames(batches: Iterable[pa.RecordBatch], text: str = "text") -> Iterator[tuple[pa.RecordBatch, Slice]]:
    """Each slice of a stream of batches with the rows it stands for."""
    for batch in batches:
        for part in slices(batch.column(batch.schema.get_field_index(text))):
            yield batch.slice(part.first, len(part)), part
    give_back()


def ranges(counts: np.ndarray) -> np.ndarray:
    """0 .. count-1 for each count, one after another."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
