"""Shards along a Hilbert curve through several metadata dimensions.

Each dimension is cut at its quantiles, the cell of a row gets its place on a
Hilbert curve, rows are sorted by that place, and runs of equal row counts
become shards: rows that are close in all dimensions share a file, so ranges of
any of them prune files.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.operators.skew import attach
from trove.session import stored

SHARDS = 40
#: Bits of each dimension; all dimensions together have at most MAX_BITS.
BITS = 4
MAX_BITS = 16


def hilbert_index(cells: np.ndarray, bits: int) -> np.ndarray:
    """The place on the curve of each row of ``cells``, whose values have ``bits`` bits.

    Skilling's transform: undo the excess work of each bit from the top, then
    Gray-encode, and interleave the bits of the dimensions.
    """
    x = np.array(cells, np.int64).T.copy()
    dims = len(x)
    for shift in range(bits - 1, 0, -1):
        bit, low = 1 << shift, (1 << shift) - 1
        for i in range(dims):
            on = (x[i] & bit) > 0
            swap = np.where(on, 0, (x[0] ^ x[i]) & low)
            x[0] ^= np.where(on, low, swap)
            x[i] ^= swap
    for i in range(1, dims):
        x[i] ^= x[i - 1]
    flip = np.zeros_like(x[0])
    for shift in range(bits - 1, 0, -1):
        flip ^= np.where(x[dims - 1] & (1 << shift), (1 << shift) - 1, 0)
    x ^= flip
    out = np.zeros_like(x[0])
    for shift in range(bits - 1, -1, -1):
        for i in range(dims):
            out = out << 1 | (x[i] >> shift & 1)
    return out


def string_cells(rows: DataFrame, name: str, side: int) -> DataFrame:
    """``rows`` with ``_level``: the quantile cell of a string among all rows.

    A value's cell is the share of rows with a smaller value, by whole strings.
    Rows are counted per value inside tasks first; the values are ranked by
    ranges, and few of them, or those with many rows, are broadcast back.
    """
    counts = rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.count(F.lit(1)).alias("_n"))
    dealt = counts.repartitionByRange(name).withColumn("_task", F.spark_partition_id())
    dealt = stored(dealt, "values")
    here = Window.partitionBy("_task").orderBy(name).rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_task").agg(F.sum("_n").alias("_sum"))
    earlier = Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    # One row per task.
    begun = F.broadcast(sums.select("_task", F.sum("_sum").over(earlier).alias("_begun")))
    total = max(1, sums.agg(F.sum("_sum")).first()[0] or 0)
    before = F.coalesce(F.sum("_n").over(here), F.lit(0))
    ranked = dealt.withColumn("_own", before).join(begun, "_task")
    level = F.floor((F.col("_own") + F.coalesce("_begun", F.lit(0))) * side / total)
    found = attach(rows, ranked.select(name, "_n", level.alias("_level")), name, "_n")
    return found.drop("_n")


def curve(spark, dims: int, bits: int) -> DataFrame:
    """``_cell`` and ``_place`` of every cell: 2 to the power of dims times bits rows."""
    side = 1 << bits
    codes = np.arange(side**dims)
    cells = np.stack([codes // side**i % side for i in range(dims)], axis=1)
    table = pa.table({"_cell": codes, "_place": hilbert_index(cells, bits)})
    return spark.createDataFrame(table)


def placed(docs: DataFrame, dims: list[str], bits: int = BITS) -> DataFrame:
    """``docs`` with ``_place`` on the curve. Nulls lie in the lowest part of a dimension."""
    if len(dims) * bits > MAX_BITS:
        raise ValueError(f"{len(dims)} dimensions of {bits} bits exceed {MAX_BITS}")
    side = 1 << bits
    shares = [i / side for i in range(1, side)]
    numeric = [d for d in dims if isinstance(docs.schema[d].dataType, T.NumericType)]
    found = [F.percentile_approx(F.col(d).cast("double"), shares, 10_000).alias(d) for d in numeric]
    cuts = docs.agg(*found).first().asDict() if numeric else {}
    kept, cell = docs.columns, F.lit(0).cast("long")
    for i, d in enumerate(dims):
        if d in numeric:
            level = F.lit(0)
            for cut in sorted(set(cuts[d] or [])):
                level = level + (F.col(d).cast("double") > F.lit(cut)).cast("int")
        else:
            docs = string_cells(docs, d, side).withColumnRenamed("_level", f"_level{i}")
            level = F.col(f"_level{i}")
        cell = cell + F.coalesce(level, F.lit(0)).cast("long") * side**i
    docs = docs.select(*kept, cell.alias("_cell"))
    spots = curve(docs.sparkSession, len(dims), bits)
    return docs.join(F.broadcast(spots), "_cell").drop("_cell")


def shard(
    docs: DataFrame,
    dims: list[str],
    id_col: str = "doc_id",
    text_col: str = "text",
    shards: int = SHARDS,
    bits: int = BITS,
) -> DataFrame:
    """``size``, ``text_crc32``, ``place``, ``shard`` and ``slot`` of every row.

    Rows are ordered by their place on the curve, then by id, so that a value
    with a third of all rows is still cut evenly. The numbers of rows of two
    shards differ by one at most, and slots leave no gap. A null text counts as
    an empty one; a row with a null dimension lies in its lowest part; repeated
    rows each get their own slot; ids stay as they are (null too) and an empty
    table gives no rows. Only ids and numbers are shuffled, never texts.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    names = {d: f"_d{i}" for i, d in enumerate(dims)}
    rows = docs.select(
        F.col(id_col).alias("_id"),
        (F.octet_length(text) + 16).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        *(
            F.col(f"`{d}`").alias(name)
            if isinstance(docs.schema[d].dataType, T.NumericType)
            else F.col(f"`{d}`").cast("string").alias(name)
            for d, name in names.items()
        ),
    )
    ordered = placed(rows, list(names.values()), bits).drop(*names.values())
    # The last key tells equal rows apart, so that many of them still spread.
    keys = ["_place", "_id", "text_crc32", "_row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_rows = (
        ordered.withColumn("_row", F.monotonically_increasing_id())
        .repartitionByRange(parts, *keys)
        .sortWithinPartitions(*keys)
        .withColumn("_at", F.monotonically_increasing_id())
        .drop("_row")
    )
    kept = stored(sorted_rows, "curve")
    part = F.shiftright("_at", 33)
    # One row per partition reaches the driver.
    counts = sorted(map(tuple, kept.groupBy(part.alias("p")).count().collect()))
    begins, total = [], 0
    for p, n in counts:
        begins.append((p, total))
        total += n
    spark = docs.sparkSession
    starts = spark.createDataFrame(begins, "_part long, _begin long")
    rank = F.col("_begin") + F.col("_at").bitwiseAND((1 << 33) - 1)
    number = F.expr(f"(_rank * {shards}) div {max(total, 1)}")
    ranked = kept.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return ranked.withColumn("_rank", rank).withColumn("shard", number.cast("int")).select(
        F.col("_id").alias(id_col),
        "size",
        "text_crc32",
        F.col("_place").alias("place"),
        "shard",
        F.expr(f"_rank - (CAST(shard AS long) * {total} + {shards - 1}) div {shards}").alias("slot"),
    )


def write_shards(docs: DataFrame, sharded: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Write ``docs`` as one folder per shard; ids must be unique here."""
    docs.join(sharded.select(id_col, "shard", "slot"), id_col).repartition(
        "shard"
    ).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
