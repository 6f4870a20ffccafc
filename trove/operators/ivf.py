"""Inverted-file index: rows grouped in cells around centroids."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.ml.clustering import KMeans
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.operators import dense
from trove.operators.moments import as_matrix
from trove.session import stored, work_path

# Index and probe sizes.
NLIST = 1024
NPROBE = 10


@dataclass(frozen=True)
class CellIndex:
    """``rows`` carry ``cell``; ``centroids`` is ``(cell, centroid)``."""

    rows: DataFrame
    centroids: DataFrame


def build_from_labels(
    df: DataFrame, label_col: str, vector_col: str = "embedding"
) -> CellIndex:
    """Use a given column as the cell; a centroid is the mean per position."""
    rows = df.withColumn("cell", F.col(label_col).cast("long"))
    return CellIndex(rows, mean_vectors(rows, "cell", vector_col))


def mean_vectors(df: DataFrame, key: str, vector_col: str) -> DataFrame:
    """``(key, centroid)``; whole vectors are averaged, inside tasks first."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    return (
        df.where(F.col(vector_col).isNotNull())
        .groupBy(key)
        .agg(Summarizer.mean(vector).alias("_mean"))
        .select(key, vector_to_array("_mean").alias("centroid"))
    )


def build(
    df: DataFrame,
    nlist: int = NLIST,
    vector_col: str = "embedding",
    seed: int = 7,
    iterations: int = 10,
) -> CellIndex:
    """Place ``nlist`` centroids by k-means over all rows, and give each its cell.

    A row without a vector has no cell, so no search meets it.
    """
    given = F.col(vector_col).isNotNull()
    n = df.where(given).count()
    vectors = df.where(given).withColumn("_features", array_to_vector(F.col(vector_col).cast("array<double>")))
    model = KMeans(
        k=min(nlist, max(2, n)), seed=seed, maxIter=iterations, featuresCol="_features",
        predictionCol="cell",
    ).fit(vectors.select("_features"))
    rows = model.transform(vectors).drop("_features").withColumn("cell", F.col("cell").cast("long"))
    rows = rows.unionByName(df.where(~given).withColumn("cell", F.lit(None).cast("long")))
    spark: SparkSession = df.sparkSession
    centres = spark.createDataFrame(
        [(i, [float(x) for x in c]) for i, c in enumerate(model.clusterCenters())],
        "cell bigint, centroid array<double>",
    )
    return CellIndex(rows, centres)


def assign(
    df: DataFrame, centroids: DataFrame, vector_col: str = "embedding", metric: str = "l2"
) -> DataFrame:
    """Add ``cell``, that of the nearest centroid; ties go to the lowest cell.

    Centroids, of which there are as many as cells, are shipped to the rows. A
    row without a vector has no cell.
    """
    rows = centroids.orderBy("cell").collect()
    cells = np.array([r["cell"] for r in rows], np.int64)
    sent = df.sparkSession.sparkContext.broadcast(np.array([r["centroid"] for r in rows], float))
    at = df.columns.index(vector_col)
    schema = T.StructType([*df.schema.fields, T.StructField("cell", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(at)
            given = np.asarray(column.is_valid())
            found = np.zeros(len(given), np.int64)
            if given.any():
                gains = dense.gains(as_matrix(column.filter(pa.array(given))), sent.value, metric)
                found[given] = cells[gains.argmax(1)]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, mask=~given)], names=schema.names
            )

    return df.mapInArrow(run, schema)


def write_rows(rows: DataFrame, path: str, id_col: str = "id") -> None:
    """Store rows in one folder per cell.

    Rows are ranged by cell and key hash: a task writes few folders, and a
    crowded cell is spread over several tasks.
    """
    rows.withColumn("_place", F.xxhash64(id_col)).repartitionByRange("cell", "_place").drop(
        "_place"
    ).write.partitionBy("cell").parquet(path)


def write(index: CellIndex, id_col: str = "id", path: str | None = None) -> CellIndex:
    """Store the rows by cell, and the centroids beside them."""
    spark = index.rows.sparkSession
    path = path or work_path(spark, "cells")
    write_rows(index.rows, f"{path}/rows", id_col)
    index.centroids.write.parquet(f"{path}/centroids")
    return read(spark, path, index)


def read(spark: SparkSession, path: str, like: CellIndex | None = None) -> CellIndex:
    rows = spark.read.parquet(f"{path}/rows")
    if like is not None:
        rows = rows.select(
            *[F.col(f.name).cast(f.dataType).alias(f.name) for f in like.rows.schema.fields]
        )
    return CellIndex(rows, spark.read.parquet(f"{path}/centroids"))


def probes(
    queries: DataFrame,
    centroids: DataFrame,
    nprobe: int,
    metric: str,
    query_col: str,
    vector_col: str,
) -> DataFrame:
    """Queries repeated once per cell they should visit."""
    nearest = dense.knn_join(
        queries, centroids, nprobe, metric, query_col, "cell", vector_col, "centroid"
    )
    return stored(queries.join(nearest.select(query_col, "cell"), query_col), "visits")


def search(
    queries: DataFrame,
    index: CellIndex,
    k: int = dense.TOP_K,
    nprobe: int = NPROBE,
    metric: str = "l2",
    query_col: str = "query_id",
    id_col: str = "id",
    query_vector: str = "embedding",
    vector_col: str = "embedding",
) -> DataFrame:
    """Best ``k`` among the rows of the ``nprobe`` nearest cells per query.

    Stored by cell, only the probed folders are read.
    """
    visits = probes(queries, index.centroids, nprobe, metric, query_col, query_vector)
    return dense.knn_join(
        visits, index.rows, k, metric, query_col, id_col, query_vector, vector_col, cell="cell"
    )


def auto_search(
    queries: DataFrame,
    corpus: DataFrame,
    index: CellIndex | None = None,
    k: int = dense.TOP_K,
    metric: str = "cosine",
    nprobe: int = NPROBE,
    **columns: str,
) -> DataFrame:
    """Probe the cells of ``index`` where one is given, else scan exactly.

    Which of the two runs is the caller's choice and does not depend on sizes.
    """
    if index is not None:
        return search(queries, index, k, nprobe, metric, **columns)
    return dense.knn_join(queries, corpus, k, metric, **columns)


def cell_sizes(index: CellIndex) -> DataFrame:
    return index.rows.groupBy("cell").agg(F.count(F.lit(1)).alias("n_rows"))

