"""Column expressions on array vectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

METRICS = ("cosine", "l2", "ip")
SCORE_DIGITS = 6


def check_metric(metric: str) -> str:
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}, not {metric!r}")
    return metric


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def squared_distance(a: Column, b: Column) -> Column:
    def term(x, y):
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _total(F.zip_with(a, b, term))


def norm(a: Column) -> Column:
    return F.sqrt(
        F.aggregate(a, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))
    )


def unit(a: Column) -> Column:
    """The vector divided by its length; a zero vector stays zero.

    The one-element array binds the length once per row, not once per element.
    """

    def divided(length: Column) -> Column:
        return F.transform(
            a, lambda x: F.when(length > 0, x / length).otherwise(x.cast("double"))
        )

    return F.transform(F.array(norm(a)), divided)[0]


def fixed_vector(values: list[float]) -> Column:
    return F.array(*[F.lit(float(v)) for v in values])


def similarity(vector: Column, query: list[float], metric: str, digits: int = SCORE_DIGITS) -> Column:
    """Score of ``vector`` against one query vector.

    Scores are rounded so that ranking does not depend on the order in which
    floating point sums are taken. A zero vector has cosine 0; a missing one
    has no score.
    """
    check_metric(metric)
    fixed = fixed_vector(query)
    if metric == "l2":
        return F.round(squared_distance(vector, fixed), digits)
    if metric == "ip":
        return F.round(dot(vector, fixed), digits)
    query_norm = sum(float(v) ** 2 for v in query) ** 0.5
    lengths = norm(vector) * F.lit(query_norm)
    cosine = F.when(lengths > 0, dot(vector, fixed) / lengths).when(lengths == 0, F.lit(0.0))
    return F.round(cosine, digits)


def best_first(score: str, metric: str) -> Column:
    """Sort order that puts the best score first."""
    column = F.col(score)
    return column.asc_nulls_last() if metric == "l2" else column.desc_nulls_last()
