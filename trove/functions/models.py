"""Places where a caller supplies a model, each with a repeatable default.

An ``Embedder`` turns a text column into a vector column; a ``TextModel`` turns
a prompt column into a text column. The defaults run inside the JVM.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trove.functions import text as txt
from trove.functions import vectors as vec


class HashEmbedder:
    """Signed hashed bag of words of unit length, without Python in the path.

    The first hex digits of a term's md5 are its code; the code modulo ``dim``
    is its bucket and the upper half of all codes counts negative. Each row is
    embedded on its own, so nothing shuffles: a count vectoriser whose
    vocabulary is the fixed list of codes counts them in one pass.
    """

    def __init__(self, dim: int = 64):
        self.dim = dim
        self.digits = next(n for n in range(1, 9) if 16**n >= 2 * dim)

    def _fold(self, counts: Column) -> Column:
        """Sum the code counts of each bucket with their signs."""
        half = 16**self.digits // 2
        pieces = [
            (sign, F.slice(counts, 1 + start + first, min(self.dim, half - first)))
            for sign, start in ((1, 0), (-1, half))
            for first in range(0, half, self.dim)
        ]

        def plus(a: Column, b: Column) -> Column:
            return a + F.coalesce(b, F.lit(0.0))

        def minus(a: Column, b: Column) -> Column:
            return a - F.coalesce(b, F.lit(0.0))

        folded = pieces[0][1]
        for sign, piece in pieces[1:]:
            folded = F.zip_with(folded, piece, plus if sign > 0 else minus)
        return folded

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        width = self.digits
        counter = CountVectorizerModel.from_vocabulary(
            [f"{i:0{width}x}" for i in range(16**width)], inputCol="_codes", outputCol="_counts"
        )
        kept = df.columns
        coded = df.withColumn(
            "_codes",
            F.transform(
                txt.tokens(F.coalesce(F.col(text_col), F.lit(""))),
                lambda term: F.substring(F.md5(term), 1, width),
            ),
        )
        counted = counter.transform(coded).select(
            *kept, vector_to_array("_counts").alias("_counts")
        )
        signed = counted.select(*kept, self._fold(F.col("_counts")).alias("_signed"))
        return signed.select(
            *kept, vec.unit(F.col("_signed")).cast("array<float>").alias(out_col)
        )


class FunctionEmbedder:
    """Wraps ``fn(list of texts) -> (n, dim) array`` as a vectorised UDF."""

    def __init__(self, fn: Callable[[list[str]], np.ndarray], dim: int):
        self.fn, self.dim = fn, dim

    def embed(self, df: DataFrame, text_col: str, out_col: str = "embedding") -> DataFrame:
        fn = self.fn

        @F.pandas_udf("array<float>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                rows = np.asarray(fn(batch.fillna("").tolist()), dtype=np.float32)
                yield pd.Series(list(rows))

        return df.withColumn(out_col, run(F.col(text_col)))


def encoder_token_count(encode: Callable[[str], list]) -> Callable[[Column], Column]:
    """A token count by a caller's encoder, such as a byte-pair one."""

    @F.pandas_udf("int")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in batches:
            yield batch.map(lambda t: len(encode(t or "")))

    return run


class ColumnTextModel:
    """A text model given as a function from a prompt column to a column."""

    def __init__(self, fn: Callable[[Column], Column] = lambda prompt: prompt):
        self.fn = fn

    def generate(self, df: DataFrame, prompt_col: str, out_col: str) -> DataFrame:
        return df.withColumn(out_col, F.trim(self.fn(F.col(prompt_col))))


class FunctionTextModel:
    """Wraps ``fn(list of prompts) -> list of texts`` as a vectorised UDF."""

    def __init__(self, fn: Callable[[list[str]], list[str]]):
        self.fn = fn

    def generate(self, df: DataFrame, prompt_col: str, out_col: str) -> DataFrame:
        fn = self.fn

        @F.pandas_udf("string")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for batch in batches:
                yield pd.Series([str(t).strip() for t in fn(batch.tolist())])

        return df.withColumn(out_col, run(F.col(prompt_col)))
