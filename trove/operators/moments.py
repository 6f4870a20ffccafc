"""Per-group sums of vectors and of their outer products.

Each task adds up its own rows with matrix products and emits one small row
per group; Spark adds those. Nothing here grows with the rows of a group.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def as_matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """A list column of equal lengths, without nulls, as a float64 matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, 0))
    lengths = pc.list_value_length(column)
    bounds = pc.min_max(lengths)
    if column.null_count or column.flatten().null_count or bounds["min"] != bounds["max"]:
        raise ValueError("vectors must have one length and no nulls")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1)


def sum_rows(partials: DataFrame, keys: list[str], values: str) -> DataFrame:
    """Add equal-length arrays position by position within each key."""
    total = Summarizer.sum(F.col("_vector")).alias("_total")
    return (
        partials.withColumn("_vector", array_to_vector(F.col(values)))
        .groupBy(*keys)
        .agg(total)
        .select(*keys, vector_to_array("_total").alias(values))
    )


def group_moments(df: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """``(group, at, values)``: row -1 is ``[n, sums...]``, row ``i`` holds the
    sums of position ``i`` times every position. One short row per position
    spreads wide vectors over many reducers."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict = {}
        kind = None
        for batch in batches:
            kind = batch.column(0).type
            rows = as_matrix(batch.column(1))
            names = batch.column(0).dictionary_encode(null_encoding="encode")
            groups = names.indices.to_numpy()
            for code, g in enumerate(names.dictionary.to_pylist()):
                part = rows[groups == code]
                new = [float(len(part)), part.sum(0), part.T @ part]
                old = held.get(g)
                held[g] = new if old is None else [a + b for a, b in zip(old, new)]
        for g, (n, sums, outer) in held.items():
            at = [-1, *range(len(sums))]
            values = [np.r_[n, sums].tolist(), *outer.tolist()]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g] * len(at), kind),
                    pa.array(at, pa.int32()),
                    pa.array(values, pa.list_(pa.float64())),
                ],
                names=["_group", "_at", "_values"],
            )

    source = df.select(F.col(group_col).alias("_group"), F.col(vector_col).cast("array<double>"))
    schema = source.select("_group").schema.add("_at", T.IntegerType())
    schema = schema.add("_values", T.ArrayType(T.DoubleType()))
    return sum_rows(source.mapInArrow(run, schema), ["_group", "_at"], "_values")


def group_covariance(df: DataFrame, group_col: str, vector_col: str) -> DataFrame:
    """``(group, i, j, covariance)`` of each group, divided by its row count."""
    moments = group_moments(df, group_col, vector_col)
    sums = moments.where(F.col("_at") == -1).select(
        "_group",
        F.col("_values")[0].alias("_n"),
        F.slice("_values", 2, F.size("_values") - 1).alias("_sums"),
    )
    outer = moments.where(F.col("_at") >= 0)
    same = outer["_group"].eqNullSafe(sums["_group"])
    rows = outer.join(sums, same).drop(sums["_group"]).select(
        "_group",
        F.col("_at").alias("i"),
        "_n",
        F.element_at("_sums", F.col("_at") + 1).alias("_mine"),
        F.posexplode(F.arrays_zip("_values", "_sums")).alias("j", "_pair"),
    )
    product = F.col("_pair._values") / F.col("_n")
    means = (F.col("_mine") / F.col("_n")) * (F.col("_pair._sums") / F.col("_n"))
    return rows.select(
        F.col("_group").alias(group_col), "i", "j", (product - means).alias("covariance")
    )
