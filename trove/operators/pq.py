"""Product-quantised cells: short codes are scanned, the best are scored exactly.

A row's difference from its cell's centroid is cut in ``parts`` sub-vectors, and
each is replaced by the number of the nearest of ``CODES`` centres of its code
book. A query adds up looked-up distances, one per part, over the codes of the
cells it probes; the best few times ``k`` are then scored on whole vectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trove.functions import vectors as vec
from trove.operators import dense, ivf
from trove.operators.moments import as_matrix
from trove.operators.ranking import top_k
from trove.session import small_side, stored, work_path

CODES = 256
PARTS = 16
#: Candidates for each wanted row that are scored exactly.
RERANK = 10
#: Code books are fitted on about this many rows, chosen by the hash of their
#: key; every row is coded.
FIT_ROWS = 256 * CODES
FIT_TASKS = 64
ROUNDS = 12


@dataclass(frozen=True)
class CodedIndex:
    """``rows`` with vectors and ``codes (id, cell, code)``, both by cell."""

    rows: DataFrame
    codes: DataFrame
    centroids: DataFrame
    books: DataFrame
    metric: str


def estimated_cost(kind: str, n: int, dim: int, nlist: int, nprobe: int, k: int = dense.TOP_K, parts: int = PARTS) -> float:
    """Multiplications and look-ups of one query; what an index choice compares."""
    share = n * min(1.0, nprobe / nlist)
    if kind == "exact":
        return float(n * dim)
    if kind == "cells":
        return float(nlist * dim + share * dim)
    return float(nlist * dim + min(nprobe, nlist) * CODES * dim + share * parts + RERANK * k * dim)


def choose(n: int, dim: int, nlist: int, nprobe: int) -> str:
    """The kind of least estimated cost: ``exact``, ``cells`` or ``pq``."""
    return min(("exact", "cells", "pq"), key=lambda kind: estimated_cost(kind, n, dim, nlist, nprobe))


def _ready(rows: np.ndarray, metric: str) -> np.ndarray:
    """By cosine, unit vectors are compared; a zero vector stays as it is."""
    if metric != "cosine":
        return rows
    length = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, length, out=np.zeros_like(rows), where=length > 0)


def _centres(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    rows = centroids.orderBy("cell").collect()
    return np.array([r["cell"] for r in rows], np.int64), np.array([r["centroid"] for r in rows], float)


def _residuals(rows: np.ndarray, cells: np.ndarray, known: np.ndarray, centres: np.ndarray, parts: int):
    gap = rows - centres[np.searchsorted(known, cells)]
    return gap.reshape(len(rows), parts, -1).transpose(1, 0, 2)


def _nearest(gaps: np.ndarray, books: np.ndarray) -> np.ndarray:
    """By part and row, the code of the nearest centre."""
    far = (books**2).sum(2)[:, None, :] - 2.0 * gaps @ books.transpose(0, 2, 1)
    return far.argmin(2)


def fit_books(
    rows: DataFrame, centroids: DataFrame, parts: int, metric: str, id_col: str, vector_col: str
) -> np.ndarray:
    """``(parts, CODES, dim / parts)`` centres by Lloyd rounds over a bounded sample.

    Tasks add up their rows; the driver sees the centres, whose number is fixed.
    """
    spark = rows.sparkSession
    known, centres = _centres(centroids)
    if centres.shape[1] % parts:
        raise ValueError(f"{parts} parts do not divide {centres.shape[1]} dimensions")
    rows = rows.where(F.col(vector_col).isNotNull())
    n = rows.count()
    share = F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) / (1 << 20)
    sample = stored(
        rows.where(share * n < FIT_ROWS).select("cell", F.col(vector_col).alias("_v")).coalesce(FIT_TASKS), "fit-rows"
    )
    first = sample.limit(CODES).toArrow()
    if not first.num_rows:
        return np.zeros((parts, CODES, centres.shape[1] // parts))
    seeds = _residuals(_ready(as_matrix(first["_v"]), metric), first["cell"].to_numpy(), known, centres, parts)
    books = seeds[:, np.arange(CODES) % seeds.shape[1]].copy()
    # Seeds that repeat are moved apart a little, so that they can part.
    books += np.random.default_rng(7).normal(scale=1e-6, size=books.shape)
    schema = "part int, code int, n long, total array<double>"
    for _ in range(ROUNDS):
        sent = spark.sparkContext.broadcast(books)

        def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now = sent.value
            total, count = np.zeros_like(now), np.zeros(now.shape[:2], np.int64)
            for batch in batches:
                if not batch.num_rows:
                    continue
                vectors = _ready(as_matrix(batch.column("_v")), metric)
                gaps = _residuals(vectors, batch.column("cell").to_numpy(), known, centres, parts)
                codes = _nearest(gaps, now)
                for p in range(parts):
                    np.add.at(total[p], codes[p], gaps[p])
                    count[p] += np.bincount(codes[p], minlength=CODES)
            at_part, at_code = np.nonzero(count)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(at_part, pa.int32()),
                    pa.array(at_code, pa.int32()),
                    pa.array(count[at_part, at_code]),
                    pa.array(list(total[at_part, at_code]), pa.list_(pa.float64())),
                ],
                ["part", "code", "n", "total"],
            )

        # At most FIT_TASKS rows for each centre.
        added = sample.mapInArrow(add, schema).toArrow()
        total, count = np.zeros_like(books), np.zeros(books.shape[:2])
        where = added["part"].to_numpy(), added["code"].to_numpy()
        np.add.at(count, where, added["n"].to_numpy())
        np.add.at(total, where, as_matrix(added["total"]))
        held = count > 0
        after = books.copy()
        after[held] = total[held] / count[held][:, None]
        if np.allclose(after, books, atol=1e-9):
            break
        books = after
    return books


def encode(
    rows: DataFrame, centroids: DataFrame, books: np.ndarray, metric: str, id_col: str, vector_col: str
) -> DataFrame:
    """``(id, cell, code)`` of every row with a vector, one byte per part."""
    known, centres = _centres(centroids)
    sent = rows.sparkSession.sparkContext.broadcast((books, known, centres))
    schema = T.StructType([rows.schema[id_col], T.StructField("cell", T.LongType()), T.StructField("code", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        books, known, centres = sent.value
        for batch in batches:
            codes = []
            if batch.num_rows:
                vectors, cells = _ready(as_matrix(batch.column(2)), metric), batch.column(1).to_numpy()
                gaps = _residuals(vectors, cells, known, centres, len(books))
                codes = [c.tobytes() for c in _nearest(gaps, books).T.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(codes, pa.binary())], names=schema.names
            )

    given = rows.where(F.col(vector_col).isNotNull()).select(id_col, F.col("cell").cast("long"), vector_col)
    return given.mapInArrow(run, schema)


def books_table(spark: SparkSession, books: np.ndarray) -> DataFrame:
    rows = [(p, c, books[p, c].tolist()) for p in range(len(books)) for c in range(CODES)]
    return spark.createDataFrame(rows, "part int, code int, centre array<double>")


def read_books(table: DataFrame) -> np.ndarray:
    rows = table.orderBy("part", "code").collect()
    return np.array([r["centre"] for r in rows]).reshape(-1, CODES, len(rows[0]["centre"]))


def build(
    df: DataFrame,
    nlist: int = ivf.NLIST,
    parts: int = PARTS,
    metric: str = "l2",
    id_col: str = "id",
    vector_col: str = "embedding",
    path: str | None = None,
) -> CodedIndex:
    """Place cells, fit code books, and store rows and codes by cell."""
    spark = df.sparkSession
    path = path or work_path(spark, "coded")
    cells = ivf.write(ivf.build(df, nlist, vector_col), id_col, f"{path}/cells")
    books = fit_books(cells.rows, cells.centroids, parts, metric, id_col, vector_col)
    books_table(spark, books).write.parquet(f"{path}/books")
    codes = encode(cells.rows, cells.centroids, books, metric, id_col, vector_col)
    ivf.write_rows(codes, f"{path}/codes", id_col)
    return CodedIndex(
        cells.rows, spark.read.parquet(f"{path}/codes"), cells.centroids, spark.read.parquet(f"{path}/books"), metric
    )


def search(
    queries: DataFrame,
    index: CodedIndex,
    k: int = dense.TOP_K,
    nprobe: int = ivf.NPROBE,
    rerank: int = RERANK,
    query_col: str = "query_id",
    id_col: str = "id",
    query_vector: str = "embedding",
    vector_col: str = "embedding",
    max_shipped: int = dense.MAX_SHIPPED_NUMBERS,
) -> DataFrame:
    """``(query, rank, id, score)``: the best ``k`` of ``rerank * k`` candidates.

    Scores are exact, of whole vectors. Code books, centroids and the queries
    are shipped; more queries than ``max_shipped`` numbers go in several passes.
    Only folders of probed cells are read, codes first and then vectors. Where
    every row is a candidate, codes would rule out none: then the vectors of the
    probed cells are scored where they lie, and no candidate travels.
    """
    known, centres = _centres(index.centroids)
    books = read_books(index.books)
    asked = queries.where(F.col(query_vector).isNotNull()).select(
        F.col(query_col).alias("_query"), F.col(query_vector).alias("_vector")
    )
    asked = stored(asked, "asked")
    if rerank * k >= index.codes.count():
        return _all_rows(asked, index, known, centres, k, nprobe, id_col, vector_col, max_shipped).select(
            F.col("_query").alias(query_col), "rank", id_col, "score"
        )
    n = asked.count()
    passes = max(-(-n * centres.shape[1] // max_shipped), -(-n * rerank * k // dense.MAX_HELD_ROWS))
    turn = F.pmod(F.xxhash64("_query"), F.lit(max(1, passes)))
    found = [
        _pass(asked.where(turn == i), index, known, centres, books, k, nprobe, rerank, id_col, vector_col)
        for i in range(max(1, passes))
    ]
    order = [vec.best_first("score", index.metric), id_col]
    return top_k(reduce(DataFrame.unionByName, found), k, "_query", order).select(
        F.col("_query").alias(query_col), "rank", id_col, "score"
    )


def _all_rows(asked, index, known, centres, k, nprobe, id_col, vector_col, max_shipped) -> DataFrame:
    """The best ``k`` of all rows in the probed cells, by whole vectors."""
    sent = asked.sparkSession.sparkContext.broadcast((known, centres))
    metric = index.metric
    schema = T.StructType([*asked.schema.fields, T.StructField("cell", T.LongType())])

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, centres = sent.value
        for batch in batches:
            if not batch.num_rows:
                continue
            cells = known[_closest(_ready(as_matrix(batch.column(1)), metric), centres, nprobe)]
            rows = np.repeat(np.arange(len(cells)), cells.shape[1])
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array(cells.ravel())], names=schema.names)

    visits = stored(asked.mapInArrow(visit, schema), "visits")
    return dense.knn_join(
        visits, index.rows, k, metric, "_query", id_col, "_vector", vector_col, cell="cell", max_shipped=max_shipped
    )


def _closest(vectors: np.ndarray, centres: np.ndarray, nprobe: int) -> np.ndarray:
    """Places of the ``nprobe`` nearest centres of each vector."""
    return np.argsort(-dense.gains(vectors, centres, "l2"), axis=1, kind="stable")[:, :nprobe]


def _pass(asked, index, known, centres, books, k, nprobe, rerank, id_col, vector_col) -> DataFrame:
    near = asked.toArrow()
    spark, metric, parts = asked.sparkSession, index.metric, len(books)
    schema = T.StructType(
        [asked.schema["_query"], index.codes.schema[id_col], T.StructField("score", T.DoubleType())]
    )
    if not near.num_rows:
        return spark.createDataFrame([], schema)
    names, whole = dense._ids(near["_query"]), as_matrix(near["_vector"])
    vectors = _ready(whole, metric)
    closest = _closest(vectors, centres, nprobe)
    by_cell = {int(known[c]): np.flatnonzero((closest == c).any(1)) for c in np.unique(closest)}
    sent = spark.sparkContext.broadcast((names, vectors, whole, by_cell, known, centres, books))
    out = to_arrow_schema(schema)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, vectors, _, by_cell, known, centres, books = sent.value
        best = dense._Best(len(names), rerank * k)
        for batch in batches:
            ids, cells = dense._ids(batch.column(0)), batch.column(1).to_numpy()
            codes = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, parts)
            for cell in np.unique(cells):
                slots = by_cell.get(int(cell))
                if slots is None:
                    continue
                at = np.flatnonzero(cells == cell)
                centre = centres[np.searchsorted(known, cell)]
                # A few million look-ups at a time keep a task's memory flat.
                step = max(1, 4_000_000 // max(len(at), parts * CODES))
                for i in range(0, len(slots), step):
                    some = slots[i : i + step]
                    table, base = _tables(vectors[some], centre, books, metric)
                    gains = base[:, None] + sum(table[p][:, codes[at, p]] for p in range(parts))
                    best.add(some, gains, ids[at])
        yield dense._hits(best, names, "ip", out)

    codes = index.codes.where(F.col("cell").isin(sorted(by_cell))).select(id_col, F.col("cell").cast("long"), "code")
    candidates = codes.mapInArrow(scan, schema)
    kept = top_k(candidates, rerank * k, "_query", [F.desc("score"), id_col]).select("_query", id_col)
    rows = index.rows.where(F.col("cell").isin(sorted(by_cell))).select(id_col, vector_col)
    # At most rerank * k rows for each query of a pass.
    pairs = rows.join(small_side(stored(kept, "candidates")), id_col).select("_query", id_col, vector_col)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, _, whole, *_ = sent.value
        place = {name: i for i, name in enumerate(names.tolist())}
        for batch in batches:
            given = batch.column(2)
            exact = np.empty(0)
            if batch.num_rows:
                mine = whole[[place[q] for q in batch.column(0).to_pylist()]]
                exact = dense.pair_scores(mine, as_matrix(given), metric)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(exact)], schema=out)

    return pairs.mapInArrow(score, schema)


def _tables(queries: np.ndarray, centre: np.ndarray, books: np.ndarray, metric: str):
    """By part, query and code what a code adds to a query's gain, and the start."""
    if metric == "ip":
        cut = queries.reshape(len(queries), len(books), -1).transpose(1, 0, 2)
        return cut @ books.transpose(0, 2, 1), queries @ centre
    cut = (queries - centre).reshape(len(queries), len(books), -1).transpose(1, 0, 2)
    table = 2.0 * cut @ books.transpose(0, 2, 1) - (books**2).sum(2)[:, None, :]
    return table, -((queries - centre) ** 2).sum(1)
