"""Embed and insert, in one batch or as a file stream."""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from trove.operators.prep import fill_missing, prepare_rows
from trove.session import qualified, subfolders

# Fixed value: rows handed to an embedding function at once.
CHUNK_ROWS = 1000


def embed_batch(df: DataFrame, text_col: str, keep_text: bool = True, embedder=None) -> DataFrame:
    """Fill missing values and embed; a chunk is one Arrow batch of a task."""
    return prepare_rows(
        fill_missing(df), text_col, exclude=[], keep_text=keep_text, embedder=embedder
    )


def ingest_batch(df: DataFrame, path: str, text_col: str, **options) -> None:
    """Embed and append to a parquet folder; parallelism is the partitions.

    A call writes a folder of its own below ``path``, as a micro-batch of a
    stream does, so both may add to one table.
    """
    conf = df.sparkSession.conf
    before = conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(CHUNK_ROWS))
    try:
        name = f"batch_id={uuid.uuid4().hex[:12]}"
        embed_batch(df, text_col, **options).write.parquet(f"{path}/{name}")
    finally:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def ingest_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    path: str,
    text_col: str,
    pattern: str | None = None,
    files_per_batch: int = 1000,
    checkpoint: str | None = None,
    **options,
) -> None:
    """Take the new files of a folder through ``embed_batch`` and stop.

    What has been read is remembered in ``checkpoint``, by default a hidden
    folder of the target for each source folder, however that is spelt: a later
    call adds what is new, from the same folder or another, and repeats nothing. Each micro-batch
    overwrites the folder named after its checkpoint and number: one that is
    repeated after a failure leaves the table as it was, and streams with
    different checkpoints never meet. A table that ``pattern`` names in the folder
    may be one file or a folder of part files.
    """
    source = hashlib.md5(qualified(spark, folder).encode()).hexdigest()[:12]
    checkpoint = checkpoint or f"{path}/_stream/{source}"
    name = hashlib.md5(checkpoint.encode()).hexdigest()[:12]
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    if pattern in subfolders(spark, folder):
        folder = f"{folder}/{pattern}"
    elif pattern:
        reader = reader.option("pathGlobFilter", pattern)

    def write(batch: DataFrame, batch_id: int) -> None:
        embed_batch(batch, text_col, **options).write.mode("overwrite").parquet(
            f"{path}/batch_id={name}-{batch_id}"
        )

    query = (
        reader.parquet(folder)
        .writeStream.foreachBatch(write)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """All ingested rows, whichever way they came."""
    return spark.read.option("recursiveFileLookup", True).parquet(path)
