"""Summary tree: embed, cluster, summarise, and again on the summaries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.functions.models import HashEmbedder
from trove.operators import clusters
from trove.session import stored

# Fixed value.
LEVELS = 3

Assign = Callable[[int, DataFrame], DataFrame]


@dataclass(frozen=True)
class Tree:
    """``members (level, id, cluster)`` and ``summaries (level, cluster,
    summaries)``. From level 2 on, an id is a cluster of the level below."""

    members: DataFrame
    summaries: DataFrame
    levels: int


def embed_and_cluster(texts: DataFrame, id_col: str, text_col: str, embedder=None, **options) -> DataFrame:
    """``(id, text, embedding, cluster)`` with an array of cluster ids."""
    embedder = embedder or HashEmbedder()
    rows = stored(embedder.embed(texts.select(id_col, text_col), text_col), "embedded")
    members = clusters.membership_arrays(clusters.cluster(rows, id_col, **options), id_col)
    return rows.join(members, id_col, "left")


def mixture_assign(embedder=None, id_col: str = "id", text_col: str = "text", **options) -> Assign:
    """Assign by embedding and soft clustering."""
    embedder = embedder or HashEmbedder()

    def assign(level: int, items: DataFrame) -> DataFrame:
        rows = stored(
            embedder.embed(items.select(id_col, text_col), text_col).drop(text_col), "embedded"
        )
        return clusters.cluster(rows, id_col, **options)

    return assign


def one_level(
    items: DataFrame, level: int, assign: Assign, id_col: str, text_col: str, model=None
) -> tuple[DataFrame, DataFrame]:
    """Members and one summary per cluster of one level, both stored."""
    members = stored(assign(level, items).select(id_col, "cluster"), "level-members")
    if model is None:
        found = clusters.extractive_summaries(members, items, id_col, text_col)
    else:
        found = clusters.model_summaries(members, items, model, id_col, text_col)
    summaries = stored(found.select("cluster", F.col("summary").alias("summaries")), "level")
    return members, summaries


def build(
    texts: DataFrame,
    id_col: str = "id",
    text_col: str = "text",
    assign: Assign | None = None,
    model=None,
    n_levels: int = LEVELS,
) -> Tree:
    """Build levels until ``n_levels`` or until one cluster is left.

    The driver only counts clusters; every level is stored, so a level does
    not recompute those below. Without ``model`` summaries are extractive.
    """
    assign = assign or mixture_assign(id_col=id_col, text_col=text_col)
    items = texts.select(id_col, text_col)
    members, summaries = [], []
    level = 1
    while True:
        m, s = one_level(items, level, assign, id_col, text_col, model)
        members.append(m.withColumn("level", F.lit(level)))
        summaries.append(s.withColumn("level", F.lit(level)))
        if level >= n_levels or s.limit(2).count() < 2:
            break
        level += 1
        items = s.select(F.col("cluster").cast("long").alias(id_col), F.col("summaries").alias(text_col))
    return Tree(
        reduce(DataFrame.unionByName, members).select("level", id_col, "cluster"),
        reduce(DataFrame.unionByName, summaries).select("level", "cluster", "summaries"),
        level,
    )


def flatten(tree: Tree, texts: DataFrame, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """``(level, node, text)``: originals at level 0, then every summary."""
    originals = texts.select(
        F.lit(0).alias("level"), F.col(id_col).cast("long").alias("node"), F.col(text_col).alias("text")
    )
    summaries = tree.summaries.select(
        "level", F.col("cluster").cast("long").alias("node"), F.col("summaries").alias("text")
    )
    return originals.unionByName(summaries)


def export(nodes: DataFrame, path: str) -> None:
    """Write nodes with one folder per level."""
    nodes.write.mode("overwrite").partitionBy("level").parquet(path)


def export_text(nodes: DataFrame, path: str) -> None:
    """Write the texts of the nodes as text files, one folder per level."""
    nodes.select("level", F.col("text").alias("value")).write.mode("overwrite").partitionBy(
        "level"
    ).text(path)
