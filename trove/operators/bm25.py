"""BM25: corpus statistics and sparse encodings of documents and queries.

A sparse vector stays in long form ``(id, term, weight)``; terms are kept as
text, so different terms never collide.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.functions import text as txt
from trove.operators.prep import text_rows
from trove.operators.skew import lookup
from trove.session import SMALL_ROWS, stored

# Fixed values.
K1 = 1.2
B = 0.75

WEIGHT_DIGITS = 6


@dataclass(frozen=True)
class BM25Model:
    """Number of texts, their mean length, and ``terms (term, df)``."""

    n_docs: int
    avg_len: float
    terms: DataFrame


def word_counts(df: DataFrame, id_col: str, text_col: str, fields: list[str] | None = None) -> DataFrame:
    """``(id, fields, doc_len, words)``, where ``words`` has the ``term`` and ``tf``
    of each distinct term of the text.

    A text's words are sorted and counted in runs where the row lies, so no
    text is shuffled.
    """
    kept = [id_col, *(fields or [])]
    rows = text_rows(df, text_col).select(*kept, F.sort_array(txt.tokens(text_col)).alias("_words"))
    starts = rows.select(
        *kept,
        "_words",
        F.expr(
            "filter(transform(_words, (w, i) -> IF(i > 0 AND w = _words[i - 1], -1, i)), i -> i >= 0)"
        ).alias("_at"),
    )
    return starts.select(
        *kept,
        F.size("_words").alias("doc_len"),
        F.expr(
            "transform(_at, (i, k) -> named_struct('term', _words[i], "
            "'tf', CAST(coalesce(get(_at, k + 1), size(_words)) - i AS bigint)))"
        ).alias("words"),
    )


def term_counts(
    df: DataFrame, id_col: str, text_col: str, terms: DataFrame | None = None
) -> DataFrame:
    """``(id, term, tf, doc_len)`` for each distinct term of each text.

    Keys are expected to be unique; rows that share one are counted apart. With
    ``terms`` the rest of the vocabulary is dropped.
    """
    words = as_terms(word_counts(df, id_col, text_col), id_col)
    if terms is not None:
        words = words.join(terms.select("term"), "term", "left_semi")
    return words.select(id_col, "term", "doc_len", "tf")


def as_terms(counts: DataFrame, *kept: str) -> DataFrame:
    """One row for each word of ``word_counts``."""
    # inline_outer: an inner one would add a filter that counts each text again.
    return counts.select(*kept, "doc_len", F.inline_outer("words")).where(F.col("term").isNotNull())


def asked_counts(
    df: DataFrame, id_col: str, text_col: str, terms: DataFrame, where: str | None = None
) -> tuple[BM25Model, DataFrame]:
    """The model of all texts for a few terms, and the counts of these terms in
    the texts that pass the filter.

    Each text is split once: its asked words are stored beside a row without a
    word that stands for the text itself.
    """
    held = F.lit(True) if where is None else F.coalesce(F.expr(where), F.lit(False))
    texts = word_counts(df.withColumn("_held", held), id_col, text_col, ["_held"])
    itself = F.array(F.struct(F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")))
    found = as_terms(texts.withColumn("words", F.concat(itself, "words")), id_col, "_held")
    wanted = terms.select("term").unionByName(df.sparkSession.createDataFrame([("",)], "term string"))
    found = stored(found.join(F.broadcast(wanted), "term", "left_semi"), "asked-counts")
    n_docs, avg_len = found.where("term = ''").agg(F.count(F.lit(1)), F.avg("doc_len")).first()
    counts = found.where("term <> ''")
    model = BM25Model(n_docs, avg_len or 0.0, counts.groupBy("term").agg(F.count_if(F.col("tf") > 0).alias("df")))
    return model, counts.where("_held").select(id_col, "term", "doc_len", "tf")


def corpus_numbers(df: DataFrame, text_col: str) -> tuple[int, float]:
    """How many texts there are, and their mean length in words."""
    length = F.avg(txt.token_count(text_col))
    n_docs, avg_len = text_rows(df, text_col).agg(F.count(F.lit(1)), length).first()
    return n_docs, avg_len or 0.0


def fit(
    df: DataFrame,
    id_col: str,
    text_col: str,
    terms: DataFrame | None = None,
    counts: DataFrame | None = None,
) -> BM25Model:
    """Count texts, mean length and, per term, the texts that hold it.

    The two corpus numbers are computed here; the frequencies stay a DataFrame.

    ``terms`` limits the document frequencies to a known vocabulary, such as
    the terms of the queries at hand; the other statistics stay whole.
    ``counts`` passes term counts that are already stored.
    """
    n_docs, avg_len = corpus_numbers(df, text_col)
    if counts is None:
        counts = term_counts(df, id_col, text_col, terms)
    # Counting on tf keeps these counts the same plan as the encoder's, so Spark
    # splits and shuffles the texts once for both.
    holding = F.count_if(F.col("tf") > 0).alias("df")
    return BM25Model(n_docs, avg_len, counts.groupBy("term").agg(holding))


def weight(tf: Column, doc_len: Column, avg_len: float, k1: float = K1, b: float = B) -> Column:
    """A saturated, length-normalised term count."""
    return F.round(tf / (tf + k1 * (1 - b + b * (doc_len / F.lit(avg_len)))), WEIGHT_DIGITS)


def mean_weights(df: DataFrame, id_col: str, text_col: str, out_col: str = "mean") -> DataFrame:
    """``(id, mean)``: the mean weight of each text's terms; none without terms.

    A text's terms are weighed where they lie, so nothing is shuffled.
    """
    _, avg_len = corpus_numbers(df, text_col)
    total = F.aggregate(
        "words", F.lit(0.0), lambda sum_, w: sum_ + weight(w["tf"], F.col("doc_len"), avg_len)
    )
    counts = word_counts(df, id_col, text_col)
    return counts.select(id_col, F.round(F.try_divide(total, F.size("words")), WEIGHT_DIGITS).alias(out_col))


def encode_documents(
    df: DataFrame,
    model: BM25Model,
    id_col: str,
    text_col: str,
    terms: DataFrame | None = None,
    k1: float = K1,
    b: float = B,
) -> DataFrame:
    """``(id, term, weight)`` with saturated, length-normalised term counts."""
    return encode_counts(term_counts(df, id_col, text_col, terms), model, id_col, k1, b)


def encode_counts(
    counts: DataFrame, model: BM25Model, id_col: str, k1: float = K1, b: float = B
) -> DataFrame:
    """The document encoding of term counts already at hand."""
    weighed = weight(F.col("tf"), F.col("doc_len"), model.avg_len, k1, b)
    return counts.select(id_col, "term", weighed.alias("weight"))


def encode_queries(
    df: DataFrame,
    model: BM25Model,
    id_col: str,
    text_col: str,
    mode: str = "idf",
    k1: float = K1,
    b: float = B,
    counts: DataFrame | None = None,
    few: bool | None = None,
) -> DataFrame:
    """``(id, term, weight)`` for queries.

    ``counts`` passes term counts of the queries that are already stored, and
    ``few`` whether they are few; without it that is checked.

    ``idf``: inverse document frequencies that sum to one per query; a term the
    corpus lacks counts as held by one text. ``tf``: the document encoding.
    """
    if mode not in ("idf", "tf"):
        raise ValueError("mode must be 'idf' or 'tf'")
    if counts is None:
        counts = term_counts(df, id_col, text_col)
    if mode == "tf":
        return encode_counts(counts, model, id_col, k1, b)
    counts = counts.select(id_col, "term")
    if few is None:
        few = df.limit(SMALL_ROWS + 1).count() <= SMALL_ROWS
    idf = F.log(F.lit(model.n_docs + 1) / (F.coalesce(F.col("df"), F.lit(1)) + 0.5))
    if few:
        matched = counts.join(model.terms, "term", "left")
    else:
        # Many queries share their common terms; all frequencies together are
        # at most the number of words.
        words = F.lit(model.n_docs * model.avg_len)
        matched = lookup(counts, model.terms, "term", F.col("df"), words)
    weighed = matched.select(id_col, "term", idf.alias("_idf"))
    whole = F.sum("_idf").over(Window.partitionBy(id_col))
    return weighed.select(
        id_col, "term", F.round(F.col("_idf") / whole, WEIGHT_DIGITS).alias("weight")
    )


def as_maps(vectors: DataFrame, id_col: str, out_col: str = "sparse") -> DataFrame:
    """One map per key, for a sink that wants a sparse column.

    A map holds the terms of one text, so its size is bounded by that text.
    """
    pairs = F.array_sort(F.collect_list(F.struct("term", "weight")))
    return vectors.groupBy(id_col).agg(F.map_from_entries(pairs).alias(out_col))


def from_maps(df: DataFrame, id_col: str, sparse_col: str = "sparse") -> DataFrame:
    return df.select(id_col, F.explode(sparse_col).alias("term", "weight"))
