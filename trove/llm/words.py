"""Words, hashes and shingles of whole texts, for use inside Arrow tasks.

Texts arrive as UTF-8 bytes. Lower-casing and splitting of bytes touch ASCII
only, so words are maximal runs without ``\\x20`` and ``\\x09-\\x0D``, and only
``A-Z`` change case.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that are hashed at once; a longer word is hashed whole.
BLOCK = 1 << 19
#: Bytes of texts that are worked on together; a longer text is alone.
TEXTS = 8 << 20
#: Cells of a grid of runs.
GRID = 1 << 18

_ODD = np.array(
    [0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93], np.uint64
)
_BASE = 0x9E3779B97F4A7C15
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mixed(values: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit numbers."""
    out = values ^ (values >> np.uint64(31))
    out = out * _ODD[2]
    out ^= out >> np.uint64(29)
    out = out * _ODD[1]
    return out ^ (out >> np.uint64(32))


_LETTERS = mixed(np.arange(1, 257, dtype=np.uint64))


def _powers(base: int, n: int) -> np.ndarray:
    steps = np.full(n, base % (1 << 64), np.uint64)
    steps[0] = 1
    return np.cumprod(steps)


_POWERS = [_powers(_BASE, 1 << 10), _powers(pow(_BASE, -1, 1 << 64), 1 << 10)]


def _hash_block(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and starts of the words of a block: polynomials in a fixed odd base."""
    n = len(data)
    if len(_POWERS[0]) < n + 1:
        size = 1 << int(n + 1).bit_length()
        _POWERS[:] = [_powers(_BASE, size), _powers(pow(_BASE, -1, 1 << 64), size)]
    gap = np.ones(n + 2, bool)
    gap[1:-1] = _SPACE[data]
    starts = np.flatnonzero(gap[:-1] & ~gap[1:])[: n + 1]
    ends = np.flatnonzero(~gap[:-1] & gap[1:])
    before = np.zeros(n + 1, np.uint64)
    np.cumsum(_LETTERS[data] * _POWERS[0][:n], out=before[1:])
    return mixed((before[ends] - before[starts]) * _POWERS[1][starts]), starts


@dataclass(frozen=True)
class Words:
    """The word hashes of many texts in one array.

    Words ``bounds[i]:bounds[i + 1]`` are those of text ``i``; ``starts`` are
    their places in ``data``, the texts joined by line breaks.
    """

    data: bytes
    offsets: np.ndarray
    hashes: np.ndarray
    starts: np.ndarray
    bounds: np.ndarray

    def of(self, i: int) -> np.ndarray:
        return self.hashes[self.bounds[i] : self.bounds[i + 1]]

    def breaks(self) -> np.ndarray:
        """The places of the line breaks in ``data``."""
        return np.flatnonzero(np.frombuffer(self.data, np.uint8) == 10)


def words_of(texts: list[bytes], lower: bool = True) -> Words:
    """The words of whole texts, hashed in blocks that end at white space."""
    data = b"\n".join(texts)
    data = data.lower() if lower else data
    hashes, starts, low = [], [], 0
    view = np.frombuffer(data, np.uint8)
    while low < len(data):
        size = BLOCK
        while True:
            high = low + size
            if high >= len(data):
                high = len(data)
                break
            cut = np.flatnonzero(_SPACE[view[max(low, high - 4096) : high]])
            if len(cut):
                high = max(low, high - 4096) + int(cut[-1]) + 1
                break
            size *= 2
        h, at = _hash_block(view[low:high])
        hashes.append(h)
        starts.append(at + low)
        low = high
    flat = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
    at = np.concatenate(starts) if starts else np.empty(0, np.int64)
    offsets = np.cumsum([0, *(len(t) + 1 for t in texts)])
    return Words(data, offsets, flat, at, np.searchsorted(at, offsets))


def blocks_of(texts: list[bytes], lower: bool = True) -> Iterator[tuple[int, int, Words]]:
    """Ranges of neighbouring texts of about ``TEXTS`` bytes, with their words."""
    for start, stop in by_bytes(texts, TEXTS):
        yield start, stop, words_of(texts[start:stop], lower)


def word_hash(word: bytes) -> int:
    """The signed hash of one word."""
    (found,) = words_of([word], lower=False).hashes.view(np.int64).tolist()
    return found


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """One hash for each run of ``size`` words, in order; none in fewer words."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    total = hashes[:n].copy()
    for i in range(1, size):
        total *= _ODD[0]
        total += hashes[i : i + n]
    return mixed(total)


def shingle_sets(words: Words, size: int = 5) -> Iterator[np.ndarray]:
    """The sorted set of shingle hashes of each text; fewer words than ``size`` make one."""
    runs = windows(words.hashes, size)
    for i in range(len(words.bounds) - 1):
        low, high = words.bounds[i], words.bounds[i + 1]
        if high - low >= size:
            yield distinct(runs[low : high - size + 1])
        elif high > low:
            yield windows(words.hashes[low:high], int(high - low)) + np.uint64(high - low)
        else:
            yield runs[:0]


def distinct(values: np.ndarray) -> np.ndarray:
    """The sorted distinct values."""
    found = np.sort(values)
    new = np.ones(len(found), bool)
    np.not_equal(found[1:], found[:-1], out=new[1:])
    return found[new]


def grids(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Runs of about equal size: their numbers, and which cells of a row each of them fills.

    Rows are as wide as the next power of two; runs without members are left out.
    """
    some = np.flatnonzero(sizes)
    wide = np.frexp(sizes[some] - 0.5)[1]
    for power in np.unique(wide).tolist():
        rows = some[wide == power]
        step = max(1, GRID >> power)
        for low in range(0, len(rows), step):
            part = rows[low : low + step]
            yield part, np.arange(1 << power) < sizes[part, None]


def distinct_runs(values: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The sorted distinct values of each run of ``values``, one run after another.

    Returns the runs' numbers in the order in which they come out, how many
    values each has left, and the values. Empty runs do not come out.
    """
    starts = np.cumsum(sizes) - sizes
    order, counts, found = [sizes[:0]], [sizes[:0]], [values[:0]]
    for rows, inside in grids(sizes):
        grid = np.full(inside.shape, ~np.uint64(0))
        grid[inside] = values[(starts[rows, None] + np.arange(inside.shape[1]))[inside]]
        grid.sort(axis=1)
        inside[:, 1:] &= grid[:, 1:] != grid[:, :-1]
        order.append(rows)
        counts.append(inside.sum(axis=1))
        found.append(grid[inside])
    return np.concatenate(order), np.concatenate(counts), np.concatenate(found)


def fingerprints(flat: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A signed 64-bit hash of each set; ``flat`` has the members of one after another."""
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = mixed(np.add.reduceat(mixed(flat + _ODD[3]), starts) + sizes[some].astype(np.uint64))
    return out.view(np.int64)


def raw_texts(batch: pa.RecordBatch, column: int) -> list[bytes | None]:
    """A text column as bytes, without decoding it."""
    return batch.column(column).cast(pa.binary()).to_pylist()


def keyed(docs: DataFrame, text_col: str, *ids: Column | str) -> DataFrame:
    """Only the key columns and the text, which is empty where it was null."""
    return docs.select(*ids, F.coalesce(F.col(text_col), F.lit("")).alias("_text"))


def give_back() -> None:
    """Return what is freed to the system: a Python worker would keep the most it ever held."""
    pa.default_memory_pool().release_unused()
    # Looked up here, as tasks cannot be sent a pointer; only glibc has it.
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def by_bytes(
    texts: list[str] | list[bytes] | list[int], limit: int, sizes: list[int] | None = None
) -> Iterator[tuple[int, int]]:
    """Ranges of neighbours whose lengths, or ``sizes``, add up to about ``limit``."""
    start = total = 0
    for i, text in enumerate(texts):
        total += len(text) if sizes is None else sizes[i]
        if total >= limit:
            yield start, i + 1
            start, total = i + 1, 0
    if start < len(texts):
        yield start, len(texts)
