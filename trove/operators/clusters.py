"""Global-then-local soft clustering, and work on cluster members.

Memberships are kept long, one row per (id, cluster), because a row may belong
to several clusters.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trove.functions import text as txt
from trove.functions.models import ColumnTextModel
from trove.operators import mixture
from trove.operators.bm25 import mean_weights
from trove.operators.ranking import places
from trove.operators.reduce import reduce_global, reduce_local
from trove.operators.skew import attach
from trove.session import small_side, stored

# Fixed value: reduced dimension used for clustering.
REDUCED_DIM = 10

# Texts joined in one group at most; larger clusters are joined in blocks.
BLOCK_ROWS = 256


def split_small(
    df: DataFrame, group_col: str, dim: int = REDUCED_DIM
) -> tuple[DataFrame, DataFrame]:
    """Rows of groups that hold at most ``dim + 1`` rows, and the other rows."""
    sizes = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("_n"))
    sized = attach(df, sizes, group_col, "_n")
    return (
        sized.where(F.col("_n") <= dim + 1).drop("_n"),
        sized.where(F.col("_n") > dim + 1).drop("_n"),
    )


def cluster_offsets(counts: DataFrame, group_col: str, count_col: str) -> DataFrame:
    """Running total of the local cluster counts of all earlier groups."""
    order = Window.orderBy(group_col).rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        group_col, count_col, F.coalesce(F.sum(count_col).over(order), F.lit(0)).alias("offset")
    )


def cluster(
    df: DataFrame,
    id_col: str = "id",
    vector_col: str = "embedding",
    dim: int = REDUCED_DIM,
    threshold: float = mixture.THRESHOLD,
    max_clusters: int = mixture.MAX_CLUSTERS,
    k: int | None = None,
    keep_unassigned: bool = False,
    rounds: int = mixture.ROUNDS,
) -> DataFrame:
    """``(id, cluster)``: cluster globally, then again inside each cluster.

    ``dim + 1`` rows or fewer all fall in cluster 0. ``k`` fixes the global
    number of components instead of choosing it by the criterion. Rows without
    a vector are in no cluster.
    """
    spark = df.sparkSession
    base = df.select(id_col, vector_col).where(F.col(vector_col).isNotNull())
    if base.limit(dim + 2).count() <= dim + 1:
        return base.select(id_col, F.lit(0).alias("cluster"))

    def assigned(points, group_col, fixed=None):
        best = mixture.best_by_bic(
            mixture.fit_groups(
                points, group_col, id_col, max_clusters=max_clusters, k=fixed, rounds=rounds
            )
        )
        rows = mixture.soft_assign(
            points, best, group_col, threshold=threshold, keep_unassigned=keep_unassigned
        )
        # explode_outer: an inner explode would add a filter that scores twice.
        placed = rows.withColumn("_component", F.explode_outer("members.component"))
        return best, placed.where(F.col("_component").isNotNull())

    points = stored(
        reduce_global(base, dim, vector_col).withColumn("_all", F.lit(0).cast("long")), "points"
    )
    _, wide = assigned(points, "_all", k)
    # Ranged by group and key: a task holds few groups, a crowded group many tasks.
    members = stored(
        wide.select(id_col, vector_col, F.col("_component").cast("long").alias("_group"))
        .repartitionByRange("_group", F.xxhash64(id_col)),
        "members",
    )
    sizes = {r["_group"]: r["count"] for r in members.groupBy("_group").count().collect()}
    large = sorted(g for g, n in sizes.items() if n > dim + 1)
    small = sorted(g for g, n in sizes.items() if n <= dim + 1)
    counts = {g: 1 for g in small}
    parts = []
    if small:
        parts.append(
            members.where(F.col("_group").isin(small)).select(
                id_col, "_group", F.lit(0).alias("_local")
            )
        )
    if large:
        rows = members.where(F.col("_group").isin(large))
        local = stored(
            reduce_local(rows, "_group", dim, vector_col).select(id_col, "_group", "reduced"),
            "local",
        )
        best, inner = assigned(local, "_group")
        counts.update({g: m.k for g, m in best.items()})
        parts.append(inner.select(id_col, "_group", F.col("_component").alias("_local")))
    table = spark.createDataFrame(sorted(counts.items()), "_group bigint, _n int")
    # One row per global component, fewer than max_clusters.
    offsets = F.broadcast(cluster_offsets(table.coalesce(1), "_group", "_n").drop("_n"))
    return (
        reduce(DataFrame.unionByName, parts)
        .join(offsets, "_group")
        .select(id_col, (F.col("_local") + F.col("offset")).cast("int").alias("cluster"))
    )


def membership_arrays(members: DataFrame, id_col: str) -> DataFrame:
    """One sorted array of cluster ids per row id."""
    return members.groupBy(id_col).agg(F.array_sort(F.collect_set("cluster")).alias("cluster"))


def explode_membership(df: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    """One row per text and cluster; rows without a cluster vanish."""
    out = df.withColumn(cluster_col, F.explode_outer(cluster_col))
    return out.where(F.col(cluster_col).isNotNull())


def distinct_clusters(members: DataFrame, cluster_col: str = "cluster") -> DataFrame:
    return members.select(cluster_col).distinct()


def joined_texts(
    members: DataFrame,
    id_col: str,
    text_col: str = "text",
    cluster_col: str = "cluster",
    delimiter: str = txt.DELIMITER,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(cluster, block, joined)``: a cluster's texts in key order.

    A block holds ``block_rows`` texts by their place within the cluster, the
    last one fewer, so no group outgrows a task; the blocks in order are the
    whole text. Keys may be of any type that can be ordered.
    """
    quoted = delimiter.replace("\\", "\\\\").replace("'", "\\'").replace("\n", "\\n")
    texts = members.select(cluster_col, id_col, F.col(text_col).alias("_text"))
    placed = places(texts, cluster_col, [F.col(id_col)])
    return placed.groupBy(cluster_col, F.expr(f"place div {block_rows}").alias("block")).agg(
        F.expr(f"listagg(_text, '{quoted}') within group (order by place)").alias("joined")
    )


def extractive_summaries(
    members: DataFrame,
    texts: DataFrame,
    id_col: str,
    text_col: str = "text",
    cluster_col: str = "cluster",
) -> DataFrame:
    """``(cluster, id, summary)``: the member whose terms weigh most on average.

    Ties go to the lowest key; a text without terms scores 0. Only keys and
    scores are compared per cluster; the winners, one per cluster, are stored
    and sent to the texts, which do not move.
    """
    means = mean_weights(texts, id_col, text_col, "_mean")
    scored = members.select(id_col, cluster_col).join(means, id_col, "left")
    loss = (-F.coalesce(F.col("_mean"), F.lit(0.0))).alias("loss")
    best = scored.groupBy(cluster_col).agg(F.min(F.struct(loss, id_col)).alias("_best"))
    chosen = stored(best.select(cluster_col, F.col(f"_best.{id_col}").alias(id_col)), "chosen")
    shown = texts.select(id_col, F.col(text_col).alias("summary"))
    return shown.join(small_side(chosen), id_col).select(
        cluster_col, id_col, "summary"
    )


def model_summaries(
    members: DataFrame,
    texts: DataFrame,
    model: ColumnTextModel,
    id_col: str,
    text_col: str = "text",
    cluster_col: str = "cluster",
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(cluster, summary)`` through a text model.

    A cluster that fits in one block is summarised in one call; a larger one
    is summarised block by block and its summaries again, until one is left.
    """
    rows = members.select(id_col, cluster_col).join(texts.select(id_col, text_col), id_col)
    while True:
        blocks = joined_texts(rows, id_col, text_col, cluster_col, block_rows=block_rows)
        asked = blocks.withColumn("_prompt", txt.summary_prompt("joined"))
        done = stored(
            model.generate(asked, "_prompt", "summary").select(cluster_col, "block", "summary"),
            "summaries",
        )
        most = done.groupBy(cluster_col).count().agg(F.max("count")).first()[0]
        if most is None or most == 1:
            return done.select(cluster_col, "summary")
        rows = done.select(
            cluster_col, F.col("block").alias(id_col), F.col("summary").alias(text_col)
        )


def equal_vectors(df: DataFrame, id_col: str = "id", vector_col: str = "embedding") -> DataFrame:
    """``(id, first_id, copies)``: each row with the lowest key of its equals.

    One row per input row, so a value that a third of all rows share costs no
    more than any other: it is counted inside tasks before the shuffle, and
    looked up through a small side when few values repeat.
    """
    classes = (
        df.groupBy(F.col(vector_col).alias("_value"))
        .agg(F.min(id_col).alias("first_id"), F.count(F.lit(1)).alias("copies"))
        .where(F.col("copies") > 1)
    )
    rows = df.select(id_col, F.col(vector_col).alias("_value"))
    # Vectors are wide: few are broadcast.
    found = attach(rows, classes, "_value", "copies", small_rows=1000, parts=1000)
    return found.select(
        id_col,
        F.coalesce("first_id", id_col).alias("first_id"),
        F.coalesce("copies", F.lit(1).cast("long")).alias("copies"),
    )
