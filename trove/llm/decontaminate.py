"""Benchmark decontamination: short test items inside long documents.

Items are partitioned by the size of their shingle sets into classes bounded by
powers of two. In a class with upper bound ``u`` an item is indexed under its
smallest MinHash values, so many that a document holding the wanted share of
any item of the class must hold one of them: at containment ``t`` a set may miss
``u - ceil(t * u)`` shingles, so one more value suffices. Documents probe every
class with all their shingles, and candidates are verified by exact shingle
containment, which makes the search complete, not approximate.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from trove.llm.words import blocks_of, keyed, raw_texts, shingle_sets
from trove.session import stored

SHINGLE = 5
#: Share of an item's shingles, in hundredths.
CONTAINED = 80
#: Item shingles shipped to every task at once (8 bytes each); more go in slices.
SLICE_SHINGLES = 1_000_000


def missing_allowed(size: int, percent: int = CONTAINED) -> int:
    """How many of ``size`` shingles a containing document may lack."""
    return size - -(-percent * size // 100)


def size_class(size: int) -> int:
    """The power of two that bounds a size from above."""
    return 1 << max(0, int(size - 1).bit_length())


def _held(keys: np.ndarray, found: np.ndarray) -> np.ndarray:
    """Which of the sorted ``keys`` are in the sorted set ``found``."""
    if len(keys) <= len(found):
        at = np.searchsorted(found, keys)
        at[at == len(found)] = 0
        return found[at] == keys
    left, right = np.searchsorted(keys, found), np.searchsorted(keys, found, "right")
    out = np.zeros(len(keys) + 1, np.int64)
    np.add.at(out, left, 1)
    np.add.at(out, right, -1)
    return out[:-1].cumsum() > 0


class ItemIndex:
    """MinHash values of items by size class, and their shingle sets."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.sets, self.percent = sets, percent
        keys, owners = [], []
        for no, found in enumerate(sets):
            upper = size_class(len(found))
            least = found[: missing_allowed(upper, percent) + 1]
            keys.append(least)
            owners.append(np.full(len(least), no))
        keys = np.concatenate(keys) if keys else np.empty(0, np.uint64)
        owners = np.concatenate(owners) if owners else np.empty(0, np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.owners = keys[order], owners[order]

    def search(self, found: np.ndarray) -> list[tuple[int, int]]:
        """``(item number, shared shingles)`` of the items contained in a sorted set."""
        if not len(found) or not len(self.keys):
            return []
        hit = self.owners[_held(self.keys, found)]
        out = []
        for no in np.unique(hit).tolist():
            item = self.sets[no]
            shared = int(_held(item, found).sum())
            if 100 * shared >= self.percent * len(item):
                out.append((no, shared))
        return out


def document_shingles(texts: list[bytes]) -> Iterator[np.ndarray]:
    """The sorted shingle hashes of each text."""
    for _, _, words in blocks_of(texts):
        yield from shingle_sets(words, SHINGLE)


def item_sets(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``_id``, ``_n`` and ``_set`` (sorted 64-bit hashes) of rows that have words."""
    schema = df.select(F.col(id_col).alias("_id")).schema.add("_n", "long").add("_set", "binary")

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = list(document_shingles(raw_texts(batch, 1)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(x) for x in sets], pa.int64()),
                    pa.array([x.tobytes() for x in sets], pa.binary()),
                ],
                schema.names,
            )

    made = keyed(df, text_col, F.col(id_col).alias("_id")).mapInArrow(make, schema)
    return made.where(F.col("_n") > 0)


def contained_items(
    docs: DataFrame,
    items: DataFrame,
    id_col: str = "doc_id",
    item_col: str = "item_id",
    text_col: str = "text",
    item_text_col: str = "text",
    percent: int = CONTAINED,
    slice_shingles: int = SLICE_SHINGLES,
) -> DataFrame:
    """Pairs of a document and an item of whose shingles it holds ``percent`` or more.

    ``shared`` and ``n_shingles`` (of the item) are counts of distinct runs of
    five words, after lower-casing A-Z; a text of fewer words is one shingle,
    which only an equally short text shares. Null and empty texts, and items
    without words, pair with nothing. Repeated rows of either side pair once per
    row, ids stay as they are (null too), other columns are not read, and an
    empty side gives no rows. Items are shipped in slices of bounded size; each
    slice reads the documents once.
    """
    found = []
    for shipped in indexes(docs, items, item_col, item_text_col, percent, slice_shingles):
        found.append(_search_slice(docs, shipped, id_col, item_col, text_col))
    return reduce(DataFrame.unionByName, found)


def indexes(docs, items, item_col, item_text_col, percent, slice_shingles) -> list[Broadcast]:
    """Item ids and their index, shipped in slices of about ``slice_shingles``."""
    sets = stored(item_sets(items, item_col, item_text_col), "items")
    total = sets.agg(F.coalesce(F.sum("_n"), F.lit(0))).first()[0]
    slices = max(1, -(-total // slice_shingles))
    out = []
    for k in range(slices):
        table = sets.where(F.expr(f"pmod(xxhash64(_set), {slices}) = {k}")).toArrow()
        ids = pa.concat_arrays(table.column("_id").chunks or [pa.array([], table.schema.field("_id").type)])
        held = [np.frombuffer(x, np.uint64) for x in table.column("_set").to_pylist()]
        out.append(docs.sparkSession.sparkContext.broadcast((ids, ItemIndex(held, percent))))
    return out


def _search_slice(
    docs: DataFrame, shipped: Broadcast, id_col: str, item_col: str, text_col: str
) -> DataFrame:
    item_type = from_arrow_type(shipped.value[0].type)
    schema = docs.select(F.col(id_col)).schema.add(item_col, item_type)
    schema = schema.add("shared", "long").add("n_shingles", "long")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        item_ids, index = shipped.value
        for batch in batches:
            rows = []
            for i, found in enumerate(document_shingles(raw_texts(batch, 1))):
                rows += [(i, no, shared) for no, shared in index.search(found)]
            at, no, shared = np.array(rows, np.int64).reshape(-1, 3).T
            sizes = np.array([len(index.sets[k]) for k in no], np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(at)),
                    item_ids.take(pa.array(no)),
                    pa.array(shared),
                    pa.array(sizes),
                ],
                schema.names,
            )

    return keyed(docs, text_col, F.col(id_col)).mapInArrow(search, schema)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    percent: int = CONTAINED,
    slice_shingles: int = SLICE_SHINGLES,
) -> DataFrame:
    """``docs`` without the rows whose text contains an item; all columns stay.

    Rows are tested one by one where they lie, so nothing is shuffled, and a
    null or repeated id takes no other row with it. Rows without text stay.
    """
    at = docs.columns.index(text_col)
    for shipped in indexes(docs, items, item_col, item_text_col, percent, slice_shingles):

        def clean(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value[1]
            for batch in batches:
                texts = [t or b"" for t in raw_texts(batch, at)]
                sets = document_shingles(texts)
                yield batch.filter(pa.array([not index.search(x) for x in sets], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
