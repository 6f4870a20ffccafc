"""Session set-up, the shared work folder, and size-checked helpers."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest row count that may be shipped whole to every executor.
SMALL_ROWS = 100_000

PARTITION_BYTES = 128 << 20
MAX_SCAN_BYTES = 1 << 30
MAX_PARTITIONS = 50_000
_SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_local_dirs: dict[str, str] = {}


def build_session(app: str = "trove", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; ``conf`` keys use ``__`` for dots."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.forceOptimizeSkewedJoin", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def sized(input_bytes: int, cores: int) -> dict[str, str]:
    """Settings for an input of this size, to pass to ``build_session``.

    Shuffle partitions hold about 128 MB, are never fewer than three per core,
    and grow beyond 128 MB rather than exceed ``MAX_PARTITIONS``: the number of
    shuffle blocks is their square. Adaptive execution merges small ones.
    """
    wanted = max(3 * cores, -(-input_bytes // PARTITION_BYTES))
    partitions = min(wanted, max(3 * cores, MAX_PARTITIONS))
    scan = max(PARTITION_BYTES, min(MAX_SCAN_BYTES, input_bytes // max(1, partitions)))
    return {
        "spark__sql__shuffle__partitions": str(partitions),
        "spark__sql__files__maxPartitionBytes": str(scan),
    }


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach, as named in ``spark.checkpoint.dir``.

    Only a local master may fall back on a folder of this machine.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    app = context.applicationId
    if app not in _local_dirs:
        _local_dirs[app] = tempfile.mkdtemp(prefix="trove-")
    return _local_dirs[app]


def work_path(spark: SparkSession, label: str) -> str:
    """A fresh path in the shared folder."""
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def _folder(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def qualified(spark: SparkSession, path: str) -> str:
    """One spelling of a path, with its file system and without a last slash."""
    files, where = _folder(spark, path)
    return files.makeQualified(where).toString().rstrip("/")


def path_exists(spark: SparkSession, path: str) -> bool:
    files, where = _folder(spark, path)
    return files.exists(where)


def subfolders(spark: SparkSession, path: str) -> list[str]:
    """Names of the folders directly below ``path``, which need not exist."""
    files, where = _folder(spark, path)
    if not files.exists(where):
        return []
    return sorted(f.getPath().getName() for f in files.listStatus(where) if f.isDirectory())


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    files, where = _folder(spark, path)
    files.delete(where, True)


def stored(df: DataFrame, label: str = "stored", path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder, or to ``path`` there, and read it back.

    This cuts the lineage with a columnar copy: later passes read only the
    columns they use, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = path or work_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Shelf:
    """Stored tables of a loop, which are taken away when nothing reads them any more.

    Shuffle files of a write go when it ends; Spark otherwise keeps them until
    the driver collects garbage.
    """

    def __init__(self, spark: SparkSession):
        self._spark = spark
        self._paths: dict[str, list[str]] = {}

    def put(self, df: DataFrame, label: str) -> DataFrame:
        """``df`` as ``stored`` gives it."""
        path = work_path(self._spark, label)
        before = self._spark.conf.get(_SHUFFLE_CLEANUP, None)
        self._spark.conf.set(_SHUFFLE_CLEANUP, "true")
        try:
            table = stored(df, path=path)
        finally:
            if before is None:
                self._spark.conf.unset(_SHUFFLE_CLEANUP)
            else:
                self._spark.conf.set(_SHUFFLE_CLEANUP, before)
        self._paths.setdefault(label, []).append(path)
        return table

    def keep_last(self, label: str, n: int = 1) -> None:
        """Take away all but the last ``n`` tables of this label."""
        paths = self._paths.get(label, [])
        while len(paths) > n:
            remove(self._spark, paths.pop(0))


def spread(df: DataFrame) -> DataFrame:
    """Deal rows out evenly, only when a scan yields fewer tasks than cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= cores:
        return df
    return df.repartition(cores)


def small_side(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Hint a broadcast only after counting at most ``max_rows + 1`` rows.

    A larger side keeps no hint and joins through a shuffle.
    """
    if df.limit(max_rows + 1).count() > max_rows:
        return df
    return F.broadcast(df)
