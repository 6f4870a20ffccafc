"""First-fit decreasing packing of token pieces, in randomised groups.

Documents are cut into pieces of at most one sequence. A piece of full length is
a sequence of its own. The others are dealt out at random; every task cuts its
share into groups of bounded size and packs each group by itself: pieces in
falling length, each into the first sequence with room, which a tournament tree
over the free capacities finds in logarithmic time.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.llm.tokens import decoded, shared_cache
from trove.llm.words import keyed
from trove.session import stored

LENGTH = 2048
END_ID = 1
# Pieces that are packed together; one task packs its groups one after another.
GROUP_PIECES = 32_768


def first_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The bin and the offset of each piece; lengths lie in 1..capacity.

    Node ``i`` of the tree holds the most room of any bin below it. A piece goes
    down from the root to the leftmost leaf with room. Unused bins count as
    empty ones, so a piece always fits.
    """
    n = len(lengths)
    bins, offsets = np.zeros(n, np.int64), np.zeros(n, np.int64)
    if not n:
        return bins, offsets
    width = 1 << max(0, int(n - 1).bit_length())
    room = [capacity] * (2 * width)
    for i in np.argsort(-lengths, kind="stable").tolist():
        size = int(lengths[i])
        node = 1
        while node < width:
            node *= 2
            if room[node] < size:
                node += 1
        bins[i], offsets[i] = node - width, capacity - room[node]
        room[node] -= size
        while node > 1:
            node //= 2
            a, b = room[2 * node], room[2 * node + 1]
            most = a if a >= b else b
            if room[node] == most:
                break
            room[node] = most
    return bins, offsets


def token_pieces(
    docs: DataFrame, path: str, id_col: str, text_col: str, length: int = LENGTH
) -> DataFrame:
    """``start``, ``length``, ``ids_crc32`` and ``doc_tokens`` of every piece.

    A document is its ids and then ``END_ID``, cut every ``length`` ids.
    """
    schema = docs.select(F.col(id_col)).schema
    for name in ("start", "length", "ids_crc32", "doc_tokens"):
        schema = schema.add(name, "long")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = shared_cache(path)
        end = np.array([END_ID], "<u4").tobytes()
        for batch in batches:
            for low, texts in decoded(batch.column(1)):
                at, rows = [], []
                for k, ids in enumerate(encoded(texts), low):
                    data = ids + end
                    total = len(data) // 4
                    for start in range(0, total, length):
                        piece = data[4 * start : 4 * (start + length)]
                        at.append(k)
                        rows.append((start, len(piece) // 4, zlib.crc32(piece), total))
                columns = np.array(rows, np.int64).reshape(-1, 4)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(at, pa.int64()))]
                    + [pa.array(columns[:, j]) for j in range(4)],
                    schema.names,
                )

    return keyed(docs, text_col, F.col(id_col)).mapInArrow(cut, schema)


def pack(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    group_pieces: int = GROUP_PIECES,
) -> DataFrame:
    """One row per piece: its document's id, its place there and in a sequence.

    ``sequence_id`` and ``offset`` say where the piece lies; offsets leave no
    gap, and what is free after the last piece is padding. A null or empty text
    is the end id alone. Repeated rows are packed as often as they occur, ids
    are returned as they were (null too), and other columns are not read. An
    empty table gives no rows.
    """
    pieces = stored(token_pieces(docs, path, id_col, text_col, length), "pieces")
    rest = pieces.where(F.col("length") < length)
    spark = docs.sparkSession
    # Enough groups for every core, but none smaller than packs well.
    n = rest.count()
    parts = max(1, min(-(-n // 2048), max(spark.sparkContext.defaultParallelism, n // group_pieces)))
    schema = T.StructType(pieces.schema.fields).add("sequence_id", "long").add("offset", "long")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = 0
        for table in groups_of(batches, group_pieces):
            bins, offsets = first_fit_decreasing(table["length"].to_numpy(), length)
            base = ((TaskContext.get().partitionId() << 12) + group) << 20
            group += 1
            table = table.append_column("sequence_id", pa.array(bins + base))
            yield from table.append_column("offset", pa.array(offsets)).to_batches()

    mixed_up = rest.repartition(parts).sortWithinPartitions(
        F.xxhash64(id_col, "start", "ids_crc32"), id_col, "start", "ids_crc32"
    )
    whole = pieces.where(F.col("length") == length).select(
        "*",
        (-1 - F.monotonically_increasing_id()).alias("sequence_id"),
        F.lit(0).cast("long").alias("offset"),
    )
    return mixed_up.mapInArrow(place, schema).unionByName(whole)


def groups_of(batches: Iterator[pa.RecordBatch], rows: int) -> Iterator[pa.Table]:
    """The rows of a task in tables of ``rows``; the last may be smaller."""
    held, have = [], 0
    for batch in batches:
        while have + batch.num_rows >= rows:
            take = rows - have
            yield pa.Table.from_batches([*held, batch.slice(0, take)])
            batch, held, have = batch.slice(take), [], 0
        if batch.num_rows:
            held.append(batch)
            have += batch.num_rows
    if held:
        yield pa.Table.from_batches(held)
