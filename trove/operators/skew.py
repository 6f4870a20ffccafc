"""Look-ups whose key may be hot in the rows that are looked up."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.session import SMALL_ROWS, stored

# At most this many keys can each hold one part in HOT_KEYS of a total.
HOT_KEYS = 10_000


def lookup(
    rows: DataFrame, table: DataFrame, key: str, size: Column, total: Column, parts: int = HOT_KEYS
) -> DataFrame:
    """Left join to a table with one row per key.

    ``size`` is a key's share of ``total``. Keys of at least one part in
    ``parts`` are broadcast, and there can be no more than ``parts`` of those;
    the rows of all other keys join through a shuffle that holds no hot key.
    """
    hot = size * parts >= total
    extra = [c for c in table.columns if c != key]
    often = table.where(hot).withColumn("_often", F.lit(True))
    seldom = table.where(~hot)
    marked = rows.join(F.broadcast(often), key, "left")
    common = marked.where(F.col("_often")).select(*rows.columns, *extra)
    others = marked.where(F.col("_often").isNull()).select(*rows.columns)
    return common.unionByName(
        others.join(seldom, key, "left").select(*rows.columns, *extra)
    )


def attach(
    rows: DataFrame,
    sizes: DataFrame,
    key: str,
    size_col: str,
    small_rows: int = SMALL_ROWS,
    parts: int = HOT_KEYS,
) -> DataFrame:
    """Left join to per-key sizes of the rows themselves.

    The sizes are stored once. Few of them are broadcast whole; otherwise only
    the hot keys are.
    """
    sizes = stored(sizes, "sizes")
    if sizes.limit(small_rows + 1).count() <= small_rows:
        return rows.join(F.broadcast(sizes), key, "left")
    total = sizes.agg(F.sum(size_col)).first()[0]
    return lookup(rows, sizes, key, F.col(size_col), F.lit(total), parts)
