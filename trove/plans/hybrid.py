"""Text search over documents: sparse, dense and fused."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trove.functions.models import HashEmbedder
from trove.operators import bm25, dense, fusion, sparse
from trove.operators.prep import filter_expression
from trove.plans import segments
from trove.session import work_path
from trove.sources import collections


def sparse_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    query_col: str,
    id_col: str,
    query_text: str = "text",
    text_col: str = "text",
    mode: str = "idf",
    drop_ratio: float = 0.0,
    where: str | None = None,
) -> DataFrame:
    """BM25 search straight from texts.

    Only terms that a query holds are counted in the corpus, so the shuffle
    carries the postings that can match and not the whole vocabulary. The
    filter limits the candidates; corpus statistics stay those of all documents.
    """
    counts, few = segments.asked_terms(queries, query_col, query_text)
    asked = counts.select("term").distinct()
    if few:
        model, held = bm25.asked_counts(docs, id_col, text_col, asked, where)
    else:
        model = bm25.fit(docs, id_col, text_col, asked)
        held = bm25.term_counts(filter_expression(docs, where), id_col, text_col, asked)
    wanted = bm25.encode_queries(
        queries, model, query_col, query_text, mode, counts=counts, few=few
    )
    postings = bm25.encode_counts(held, model, id_col)
    return sparse.search(wanted, postings, k, query_col, id_col, drop_ratio, few=few)


def dense_search(
    queries: DataFrame,
    docs: DataFrame,
    k: int,
    query_col: str,
    id_col: str,
    query_text: str = "text",
    text_col: str = "text",
    metric: str = "cosine",
    where: str | None = None,
    embedder=None,
    vector_col: str | None = None,
) -> DataFrame:
    """Vector search from texts; ``vector_col`` names stored document vectors."""
    embedder = embedder or HashEmbedder()
    asked = embedder.embed(queries.select(query_col, query_text), query_text, "_vector")
    corpus = filter_expression(docs, where)
    if vector_col is None:
        corpus = embedder.embed(corpus.select(id_col, text_col), text_col, "_vector")
        vector_col = "_vector"
    return dense.knn_join(
        asked, corpus, k, metric, query_col, id_col, "_vector", vector_col
    )


def hybrid_search(
    queries: DataFrame,
    docs: DataFrame,
    query_col: str,
    id_col: str,
    query_text: str = "text",
    text_col: str = "text",
    where: str | None = None,
    limit: int = 1,
    leg_limit: int | None = None,
    mode: str = "idf",
    drop_ratio: float = sparse.DROP_RATIO,
    metric: str = "cosine",
    embedder=None,
    vector_col: str | None = None,
) -> DataFrame:
    """Dense and sparse legs over the filtered documents, fused by rank."""
    each = limit if leg_limit is None else leg_limit
    legs = [
        dense_search(
            queries, docs, each, query_col, id_col, query_text, text_col, metric, where,
            embedder, vector_col,
        ),
        sparse_search(
            queries, docs, each, query_col, id_col, query_text, text_col, mode, drop_ratio, where
        ),
    ]
    return fusion.fuse(legs, limit, query_col, id_col)


def search_collection(
    queries: DataFrame,
    name: str,
    query_col: str,
    query_text: str = "text",
    text_col: str = "text",
    output_fields: list[str] | None = None,
    **options,
) -> DataFrame:
    """Hybrid search of a collection by name, over all rows inserted so far.

    Distances follow the metric that the collection records. A collection with
    an index (``segments.create``) is searched through it. Of another one the
    stored vectors are used as they are and terms are counted from its texts, so
    rows that are appended later need no other step.
    """
    spark = queries.sparkSession
    if segments.is_indexed(spark, name):
        return segments.search(
            queries, name, query_col, query_text, output_fields=output_fields, **options
        )
    rows = spark.table(name)
    metric = collections.settings(spark, name).get("metric", collections.DENSE_METRIC)
    hits = hybrid_search(
        queries, rows, query_col, "id", query_text, text_col,
        metric=metric, vector_col="embedding", **options,
    )
    return dense.with_fields(hits, rows, output_fields, "id") if output_fields else hits


@dataclass(frozen=True)
class TextIndex:
    """Stored documents with their vectors, and the segments of their terms."""

    docs: DataFrame
    root: str
    id_col: str


def build_index(
    docs: DataFrame,
    id_col: str,
    text_col: str = "text",
    path: str | None = None,
    embedder=None,
    drop_ratio: float = sparse.DROP_RATIO,
) -> TextIndex:
    """Embed, count and store documents once, for any number of searches.

    Columns other than the text can be filtered on.
    """
    spark = docs.sparkSession
    path = path or work_path(spark, "index")
    (embedder or HashEmbedder()).embed(docs, text_col).write.parquet(f"{path}/docs")
    fields = [c for c in docs.columns if c not in (id_col, text_col)]
    segments.build(docs, f"{path}/terms", id_col, text_col, fields, drop_ratio)
    spark.createDataFrame([(id_col,)], "id_col string").write.parquet(f"{path}/about")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> TextIndex:
    about = spark.read.parquet(f"{path}/about").first()
    return TextIndex(spark.read.parquet(f"{path}/docs"), f"{path}/terms", about["id_col"])


def search_index_text(
    queries: DataFrame,
    index: TextIndex,
    k: int,
    query_col: str,
    query_text: str = "text",
    mode: str = "idf",
    drop_ratio: float = 0.0,
    where: str | None = None,
) -> DataFrame:
    """BM25 search of a stored index; no text is read."""
    return segments.search_text(
        queries, index.root, k, query_col, index.id_col, query_text, mode, drop_ratio, where
    )


def search_index(
    queries: DataFrame,
    index: TextIndex,
    query_col: str,
    query_text: str = "text",
    where: str | None = None,
    limit: int = 1,
    leg_limit: int | None = None,
    mode: str = "idf",
    drop_ratio: float = sparse.DROP_RATIO,
    metric: str = "cosine",
    embedder=None,
    output_fields: list[str] | None = None,
) -> DataFrame:
    """Hybrid search of a stored index; texts are not read again unless they are
    among ``output_fields``."""
    each = limit if leg_limit is None else leg_limit
    docs = filter_expression(index.docs, where)
    asked = (embedder or HashEmbedder()).embed(
        queries.select(query_col, query_text), query_text, "_vector"
    )
    legs = [
        dense.knn_join(
            asked, docs, each, metric, query_col, index.id_col, "_vector", "embedding"
        ),
        search_index_text(queries, index, each, query_col, query_text, mode, drop_ratio, where),
    ]
    hits = fusion.fuse(legs, limit, query_col, index.id_col)
    if not output_fields:
        return hits
    return dense.with_fields(hits, index.docs, output_fields, index.id_col)
