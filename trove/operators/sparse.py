"""Sparse vectors: which weights an index keeps, and inner-product top-k search.

A stored index is kept by ``blockmax``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from trove.functions.vectors import SCORE_DIGITS
from trove.operators.bm25 import WEIGHT_DIGITS
from trove.operators.ranking import top_k
from trove.session import SMALL_ROWS

# Fixed value.
DROP_RATIO = 0.2


def weight_quantile(postings: DataFrame, ratio: float) -> DataFrame:
    """One row: the exact quantile of all weights.

    Weights carry six digits, so counting equal weights first leaves at most a
    million rows for the quantile, however many postings there are.
    """
    counts = postings.groupBy(F.round("weight", WEIGHT_DIGITS).alias("weight")).agg(
        F.count(F.lit(1)).alias("n")
    )
    return counts.agg(F.expr(f"percentile(weight, {float(ratio)}, n)").alias("cut"))


def build_index(postings: DataFrame, drop_ratio: float = DROP_RATIO) -> DataFrame:
    """Postings without the lightest share of weights."""
    if drop_ratio <= 0:
        return postings
    cut = weight_quantile(postings, drop_ratio).scalar()
    return postings.where(F.col("weight") >= cut)


def drop_light_terms(queries: DataFrame, query_col: str, ratio: float) -> DataFrame:
    """Drop the lightest ``floor(ratio * terms)`` terms of each query."""
    if ratio <= 0:
        return queries
    by_query = Window.partitionBy(query_col)
    order = F.row_number().over(by_query.orderBy("weight", "term"))
    size = F.count(F.lit(1)).over(by_query)
    return (
        queries.withColumn("_order", order)
        .withColumn("_dropped", F.floor(size * ratio))
        .where(F.col("_order") > F.col("_dropped"))
        .drop("_order", "_dropped")
    )


def search(
    queries: DataFrame,
    postings: DataFrame,
    k: int,
    query_col: str,
    id_col: str,
    drop_ratio: float = 0.0,
    max_broadcast_rows: int = SMALL_ROWS,
    few: bool | None = None,
) -> DataFrame:
    """``(query, rank, id, score)`` by inner product.

    ``few`` tells whether the query side may be broadcast, where the caller has
    counted it already.

    A small query side goes to the postings, so a term that most documents
    share costs a scan and no shuffle of its postings; a large one joins on the
    term with adaptive splitting of hot terms. Scores are summed inside each
    task before the shuffle by query and document.
    """
    wanted = drop_light_terms(queries, query_col, drop_ratio).select(
        query_col, "term", F.col("weight").alias("_query_weight")
    )
    # The size is checked before light terms go: dropping only shrinks it, and
    # counting the dropped ones would take every weight twice.
    if few is None:
        few = queries.limit(max_broadcast_rows + 1).count() <= max_broadcast_rows
    if few:
        wanted = F.broadcast(wanted)
    scores = (
        postings.join(wanted, "term")
        .groupBy(query_col, id_col)
        .agg(F.round(F.sum(F.col("weight") * F.col("_query_weight")), SCORE_DIGITS).alias("score"))
    )
    return top_k(scores, k, query_col, [F.desc("score"), id_col]).select(
        query_col, "rank", id_col, "score"
    )
