"""How often hashes occur in sets of the whole corpus, as a sketch of fixed size.

Every task counts its sets into one array indexed by the low bits of a hash;
blocks of these arrays are added up in two steps. A level never falls as the
number of sets that hold a hash grows, so ordering by level and then by hash is
one total order for all sets: rare hashes first, frequent ones last.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.words import give_back, raw_texts

WIDTH = 1 << 22
BLOCK = 1 << 16
FAN_IN = 256
#: Sets of at most so many members are also counted by size.
SIZES = 64
#: The level of a hash that one set holds; other hashes may raise a level, none lowers it.
SINGLE = 8

#: Text numbers, unit numbers and sizes of some sets, and all their hashes, sorted within a set.
SetBlock = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]
#: Makes the sets of texts, many at a time.
Sets = Callable[[list[bytes]], Iterator[SetBlock]]


class Rarity:
    """Levels of all hashes, sets by size, and the mean level count of a hash."""

    def __init__(self, counts: np.ndarray, sizes: np.ndarray):
        self.levels = np.minimum(8 * np.log2(1 + counts.astype(float)), 255).astype(np.uint8)
        self.sizes = sizes
        held = counts.astype(float)
        #: How many sets hold a hash, weighted by how often it is met.
        self.mean_list = float((held**2).sum() / max(held.sum(), 1))

    def level_of(self, hashes: np.ndarray) -> np.ndarray:
        """The level of each hash."""
        return self.levels[(hashes & np.uint64(len(self.levels) - 1)).view(np.int64)]


def rarity(texts: DataFrame, sets: Sets, width: int = WIDTH) -> Rarity:
    """The sketch of all sets of ``texts``, whose last column is the text."""
    last = len(texts.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sizes = np.zeros(width, np.int32), np.zeros(BLOCK, np.int32)
        for batch in batches:
            for _, _, lengths, found in sets(raw_texts(batch, last)):
                low = found & np.uint64(width - 1)
                np.add.at(total, low.view(np.int64), 1)
                sizes[: SIZES + 1] += np.bincount(lengths[lengths <= SIZES], minlength=SIZES + 1)
            give_back()
        fan = TaskContext.get().partitionId() // FAN_IN
        parts = [*np.split(total, width // BLOCK), sizes] if width >= BLOCK else [total, sizes]
        for block, part in enumerate(parts):
            if part.any():
                yield pa.RecordBatch.from_pydict(
                    {
                        "block": [block],
                        "fan": [fan],
                        "data": [zlib.compress(part.astype(np.int64).tobytes(), 1)],
                    },
                    schema=pa.schema([("block", pa.int32()), ("fan", pa.int32()), ("data", pa.binary())]),
                )

    def total(rows: pd.DataFrame) -> pd.DataFrame:
        added = sum(np.frombuffer(zlib.decompress(x), np.int64) for x in rows["data"])
        return pd.DataFrame(
            {"block": rows["block"][:1], "fan": [0], "data": [zlib.compress(added.tobytes(), 1)]}
        )

    kind = "block int, fan int, data binary"
    some = texts.mapInArrow(count, kind).groupBy("block", "fan").applyInPandas(total, kind)
    blocks = dict(
        (row["block"], np.frombuffer(zlib.decompress(row["data"]), np.int64))
        for row in some.groupBy("block").applyInPandas(total, kind).select("block", "data").collect()
    )
    step = min(BLOCK, width)
    counts = np.zeros(width, np.int64)
    for block in range(width // step):
        if block in blocks:
            counts[block * step : (block + 1) * step] = blocks[block]
    sizes = blocks.get(width // step, np.zeros(BLOCK, np.int64))
    return Rarity(counts, sizes[: SIZES + 1])


class Members:
    """A set of 64-bit numbers as one bit each; others pass with a small chance."""

    def __init__(self, bits: int, words: np.ndarray, values: np.ndarray):
        self.mask = np.uint64(bits - 1)
        self.words = np.zeros(bits // 64, np.uint64)
        self.words[words] = values.view(np.uint64)

    def holds(self, numbers: np.ndarray) -> np.ndarray:
        slot = numbers.view(np.uint64) & self.mask
        word = self.words[(slot >> np.uint64(6)).astype(np.int64)]
        return (word >> (slot & np.uint64(63)) & np.uint64(1)).astype(bool)


def members(values: DataFrame, most_bits: int = 1 << 27) -> Members:
    """The numbers in the one column of ``values``, in at most ``most_bits`` bits."""
    (name,) = values.columns
    bits = 1 << 16
    wanted = 32 * values.count()
    while bits < min(wanted, most_bits):
        bits *= 2
    slot = F.col(name).bitwiseAND(bits - 1)
    words = values.select(
        F.shiftright(slot, 6).cast("int").alias("w"),
        F.expr(f"shiftleft(1L, CAST(`{name}` & 63 AS int))").alias("v"),
    )
    table = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    return Members(bits, table["w"].to_numpy(), table["v"].to_numpy())
