"""Best-k per query."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.session import stored


def top_k(hits: DataFrame, k: int, query_col: str, order: list[Column | str]) -> DataFrame:
    """Keep ``rank <= k`` per query.

    Spark limits each group inside every task before the shuffle, so at most
    ``k`` rows per query and task travel.
    """
    window = Window.partitionBy(query_col).orderBy(*order)
    return hits.withColumn("rank", F.row_number().over(window)).where(F.col("rank") <= k)


def places(df: DataFrame, group: str, order: list[Column], name: str = "place") -> DataFrame:
    """Add each row's place, from 0, within its group in ``order``.

    Rows are dealt out by ranges of group and order and sorted there, so a group
    of any size spreads over tasks. Tasks count along their own rows; a group
    that began in earlier tasks adds the rows there, of which there is at most
    one number per task. Rows that are equal in ``order`` follow in any order.
    """
    keyed = df.withColumn("_group", F.xxhash64(F.struct(group)))
    keys = ["_group", *order]
    dealt = keyed.repartitionByRange(*keys).sortWithinPartitions(*keys)
    dealt = dealt.withColumn("_part", F.spark_partition_id())
    at, schema = dealt.columns.index("_group"), T.StructType(list(dealt.schema.fields)).add("_local", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, have = None, 0
        for batch in batches:
            groups = batch.column(at).to_numpy()
            if not len(groups):
                continue
            new = np.flatnonzero(np.append(True, groups[1:] != groups[:-1]))
            base = np.zeros(len(groups), np.int64)
            base[new] = np.diff(np.append(new, len(groups)))
            starts = np.repeat(new, base[new])
            local = np.arange(len(groups)) - starts
            if groups[0] == last:
                local[: base[0]] += have
            last, have = groups[-1], int(local[-1]) + 1
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(local)], schema.names)

    kept = stored(dealt.mapInArrow(count, schema), "places")
    sizes = kept.groupBy("_group", "_part").agg(F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy("_group").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    begun = sizes.select("_group", "_part", F.sum("_n").over(earlier).alias("_before"))
    begun = begun.where("_before IS NOT NULL")
    found = kept.join(F.broadcast(begun), ["_group", "_part"], "left")
    return found.withColumn(name, F.col("_local") + F.coalesce("_before", F.lit(0))).select(
        *df.columns, name
    )
