"""Dimension reduction, for a whole table or within each cluster.

Both are principal components of unit-length vectors: linear and repeatable,
where a neighbour-graph layout is neither.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import PCA, Normalizer
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.functions import vectors as vec
from trove.operators.moments import group_moments


def reduce_global(
    df: DataFrame, dim: int, vector_col: str = "embedding", out_col: str = "reduced"
) -> DataFrame:
    """Project unit vectors on the ``dim`` main axes of the whole table.

    A row without a vector keeps a null and has no part in the axes.
    """
    kept = df.columns
    given = F.col(vector_col).isNotNull()
    typed = df.where(given).withColumn("_raw", array_to_vector(F.col(vector_col).cast("array<double>")))
    unit = Normalizer(p=2.0, inputCol="_raw", outputCol="_unit").transform(typed)
    model = PCA(k=dim, inputCol="_unit", outputCol="_axes").fit(unit.select("_unit"))
    reduced = model.transform(unit).select(*kept, vector_to_array("_axes").alias(out_col))
    return reduced.unionByName(df.where(~given).withColumn(out_col, F.lit(None).cast("array<double>")))


def local_axes(df: DataFrame, group_col: str, vector_col: str, dim: int) -> dict[str, np.ndarray]:
    """The ``dim`` main axes of each group.

    Covariances are summed by Spark; a task solves one ``d x d`` matrix per
    group. The axes returned are ``groups * dim * d`` numbers.
    """

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values("_at")["_values"].tolist()
        n, sums = rows[0][0], np.asarray(rows[0][1:])
        mean = sums / n
        _, axes = np.linalg.eigh(np.asarray(rows[1:]) / n - np.outer(mean, mean))
        main = axes[:, ::-1][:, :dim].T
        # Fix the sign of each axis by its largest entry.
        pick = np.abs(main).argmax(1)
        main = main * np.where(main[np.arange(len(main)), pick] < 0, -1.0, 1.0)[:, None]
        return pd.DataFrame({"_group": [pdf["_group"].iloc[0]], "axes": [main.ravel().tolist()]})

    moments = group_moments(df, group_col, vector_col)
    solved = moments.groupBy("_group").applyInPandas(solve, "_group string, axes array<double>")
    return {
        r["_group"]: np.asarray(r["axes"]).reshape(dim, -1) for r in solved.toLocalIterator()
    }


def reduce_local(
    df: DataFrame,
    group_col: str,
    dim: int,
    vector_col: str = "embedding",
    out_col: str = "reduced",
) -> DataFrame:
    """Project each group's unit vectors on that group's own main axes.

    Groups may be of any type; rows without one are a group too. A row without a
    vector keeps a null and has no part in the axes.
    """
    group = F.coalesce(F.concat(F.lit("="), F.col(group_col).cast("string")), F.lit(""))
    given = df.where(F.col(vector_col).isNotNull())
    unit = given.select(group.alias("_group"), vec.unit(F.col(vector_col)).alias("_unit"))
    axes = local_axes(unit, "_group", "_unit", dim)
    sent = df.sparkSession.sparkContext.broadcast(axes)

    @F.pandas_udf("array<double>")
    def project(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for groups, vectors in batches:
            out = np.full(len(groups), None, object)
            there = vectors.notna().to_numpy()
            for g in groups[there].unique():
                at = np.flatnonzero((groups == g).to_numpy() & there)
                rows = np.vstack(vectors.to_numpy()[at]).astype(np.float64)
                lengths = np.linalg.norm(rows, axis=1, keepdims=True)
                rows = np.divide(rows, lengths, out=np.zeros_like(rows), where=lengths > 0)
                for i, row in zip(at, rows @ sent.value[g].T):
                    out[i] = row
            yield pd.Series(out, dtype=object)

    return df.withColumn(out_col, project(group, F.col(vector_col)))
