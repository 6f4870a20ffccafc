"""Row preparation: nulls, projection, filters and casts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.functions.models import HashEmbedder
from trove.sources.collections import cast_to

# Fixed value.
MISSING_TEXT = "missing-data"


def fill_missing(df: DataFrame) -> DataFrame:
    """Nulls become 0, 0.0, ``missing-data`` or false by column type."""
    fill: dict[str, object] = {}
    for field in df.schema.fields:
        kind = field.dataType
        if isinstance(kind, T.IntegralType):
            fill[field.name] = 0
        elif isinstance(kind, (T.FractionalType, T.DecimalType)):
            fill[field.name] = 0.0
        elif isinstance(kind, T.StringType):
            fill[field.name] = MISSING_TEXT
        elif isinstance(kind, T.BooleanType):
            fill[field.name] = False
    return df.na.fill(fill)


def prepare_rows(
    df: DataFrame,
    text_col: str = "desc",
    exclude: list[str] | None = None,
    keep_text: bool = False,
    embedder=None,
    sparse: DataFrame | None = None,
    id_col: str = "id",
) -> DataFrame:
    """The shape to insert: vector in place of the text, excluded columns gone.

    ``sparse (id, sparse)`` adds a sparse vector, joined on the key before the
    excluded columns go. Without ``exclude`` only ``id_col`` is dropped.
    """
    excluded = [id_col] if exclude is None else exclude
    if sparse is not None:
        df = df.join(sparse, id_col, "left")
    out = (embedder or HashEmbedder()).embed(df, text_col)
    if not keep_text:
        out = out.drop(text_col)
    return out.drop(*excluded)


def text_rows(df: DataFrame, text_col: str) -> DataFrame:
    """Rows that do have a text."""
    return df.where(F.col(text_col).isNotNull())


def filter_category(df: DataFrame, column: str, value: str) -> DataFrame:
    return df.where(F.col(column) == value)


def filter_expression(df: DataFrame, text: str | None) -> DataFrame:
    """Filter by expression text such as ``price > 3 and kind in ('a', 'b')``."""
    return df if text is None else df.where(F.expr(text))


def filter_products(
    df: DataFrame,
    store: str | None = None,
    min_price: float | None = None,
    max_price: float | None = None,
    store_col: str = "store_name",
    price_col: str = "price",
) -> DataFrame:
    """All given conditions together; none given means no rows."""
    parts: list[Column] = []
    if store is not None:
        parts.append(F.col(store_col) == store)
    if min_price is not None:
        parts.append(F.col(price_col) >= min_price)
    if max_price is not None:
        parts.append(F.col(price_col) <= max_price)
    if not parts:
        return df.limit(0)
    return df.where(reduce(lambda a, b: a & b, parts))


def cast_to_schema(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Cast the columns a schema names; values that do not fit become null."""
    declared = {f.name: f for f in schema.fields}
    return df.select(
        *[cast_to(df, declared[c]).alias(c) if c in declared else F.col(c) for c in df.columns]
    )


def first_rows(df: DataFrame, key: str, n: int = 5) -> DataFrame:
    """The ``n`` rows of lowest key."""
    return df.orderBy(key).limit(n)
