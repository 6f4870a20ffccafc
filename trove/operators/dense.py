"""Exact top-k over dense vectors: one query, or many at once."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trove.functions import vectors as vec
from trove.functions.vectors import SCORE_DIGITS
from trove.operators.moments import as_matrix
from trove.operators.prep import filter_expression
from trove.operators.ranking import top_k
from trove.session import small_side, stored

# Default result sizes.
SEARCH_LIMIT = 100
TOP_K = 10

# Query vectors shipped to every task hold at most this many numbers (32 MB).
MAX_SHIPPED_NUMBERS = 4_000_000
# A block of queries wants at most this many best rows.
MAX_HELD_ROWS = 2_000_000
# Rows that travel together, numbers in them, and scores at a time.
BLOCK_ROWS = 4096
BLOCK_NUMBERS = 1_000_000
SCORES = 2_000_000


def search(
    corpus: DataFrame,
    query: list[float],
    k: int = SEARCH_LIMIT,
    metric: str = "cosine",
    where: str | None = None,
    output_fields: list[str] | None = None,
    id_col: str = "id",
    vector_col: str = "embedding",
) -> DataFrame:
    """Best ``k`` rows for one query vector.

    The filter runs before scoring and reaches the scan; only the key, the
    vector and the requested fields are read. Each task keeps its own best
    ``k`` and only those meet. Rows without a vector, or with a value in it that
    is no number, are no hits here and in ``knn_join``.
    """
    fields = [c for c in (output_fields or []) if c != id_col]
    scored = filter_expression(corpus, where).select(
        id_col,
        *fields,
        F.nanvl(vec.similarity(F.col(vector_col), query, metric), F.lit(None).cast("double")).alias("score"),
    )
    best = scored.orderBy(vec.best_first("score", metric), id_col).limit(k)
    # After the limit, so that the score is not computed again for a filter.
    best = best.where(F.col("score").isNotNull())
    return top_k(
        best.withColumn("_all", F.lit(0)), k, "_all", [vec.best_first("score", metric), id_col]
    ).select("rank", id_col, "score", *fields)


def restrict(corpus: DataFrame, ids: DataFrame, id_col: str = "id") -> DataFrame:
    """Keep the rows whose key another step selected; no keys, no rows."""
    return corpus.join(ids.select(id_col), id_col, "left_semi")


def _present(rows, column: str):
    """Drop rows without a vector; done here, not as a filter below the task,
    so that an embedding computed on the way is computed once."""
    return rows.filter(pc.is_valid(rows.column(column)))


def _asked_form(vectors: np.ndarray, metric: str) -> np.ndarray:
    """Queries such that a product with ``_row_form`` gives their gains."""
    if metric == "l2":
        return np.column_stack([2.0 * vectors, -(vectors**2).sum(1), -np.ones(len(vectors))])
    return _unit(vectors) if metric == "cosine" else vectors


def _row_form(vectors: np.ndarray, metric: str) -> np.ndarray:
    if metric == "l2":
        return np.column_stack([vectors, np.ones(len(vectors)), (vectors**2).sum(1)])
    return _unit(vectors) if metric == "cosine" else vectors


def _unit(vectors: np.ndarray) -> np.ndarray:
    """Vectors of length 1; one of length 0 stays, one with a value that is no number is none."""
    lengths = np.linalg.norm(vectors, axis=1)
    with np.errstate(invalid="ignore"):
        return vectors / np.where(lengths == 0, 1.0, lengths)[:, None]


def gains(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """Rounded scores where larger is better (distances are negated)."""
    if metric == "l2":
        found = (2.0 * queries) @ rows.T
        found -= (queries**2).sum(1)[:, None]
        found -= (rows**2).sum(1)[None, :]
        return np.round(np.minimum(found, 0.0), SCORE_DIGITS)
    products = queries @ rows.T
    if metric == "cosine":
        lengths = np.linalg.norm(queries, axis=1)[:, None] * np.linalg.norm(rows, axis=1)[None, :]
        products = np.divide(products, lengths, out=np.where(lengths == 0, 0.0, np.nan), where=lengths > 0)
    return np.round(products, SCORE_DIGITS)


def pair_scores(left: np.ndarray, right: np.ndarray, metric: str) -> np.ndarray:
    """The score of each row of ``left`` with the same row of ``right``."""
    if metric == "l2":
        return np.round(((left - right) ** 2).sum(1), SCORE_DIGITS) + 0.0
    products = (left * right).sum(1)
    if metric == "cosine":
        lengths = np.linalg.norm(left, axis=1) * np.linalg.norm(right, axis=1)
        products = np.divide(products, lengths, out=np.where(lengths == 0, 0.0, np.nan), where=lengths > 0)
    return np.round(products, SCORE_DIGITS) + 0.0


class _Best:
    """Running best ``k`` per query; equal scores rank by lower id.

    ``digits`` rounds what is held, and only that: scores come unrounded. Up to
    twice ``k`` rows are held unsorted, so a query is sorted again only after
    about ``k`` better rows.
    """

    def __init__(self, n_queries: int, k: int, digits: int | None = None, most: float = np.inf):
        self.k, self.digits, self.most = k, digits, most
        # Rounding moves a score by less than this.
        self.slack = 0.0 if digits is None else 10.0**-digits
        self.floor = np.full(n_queries, -np.inf)
        self._room = k + max(k, 32)
        # As wide as the longest list so far.
        self._held = np.zeros(n_queries, np.int64)
        self._gains = np.full((n_queries, 0), -np.inf)
        self._ids: np.ndarray | None = None

    @property
    def gains(self) -> np.ndarray:
        """The best of each query in order, then minus infinity."""
        self._settle()
        return self._gains[:, : self.k]

    @property
    def ids(self) -> np.ndarray | None:
        self._settle()
        return None if self._ids is None else self._ids[:, : self.k]

    def add(self, slots: np.ndarray, gains: np.ndarray, ids: np.ndarray) -> None:
        """Merge a score block: one row per slot, one column per id."""
        if not gains.size:
            return
        if np.isnan(gains.sum()):
            # A vector with a value that is no number scores nothing.
            gains = np.where(np.isnan(gains), -np.inf, gains)
        floor = self.floor[slots]
        fresh = np.flatnonzero(floor == -np.inf)
        if len(fresh) and gains.shape[1] > self.k:
            kth = gains.shape[1] - self.k
            floor[fresh] = np.partition(gains[fresh], kth, axis=1)[:, kth]
            np.maximum.at(self.floor, slots[fresh], self._rounded(floor[fresh]))
        at, col = np.nonzero(gains >= (floor - self.slack)[:, None])
        new = self._rounded(gains[at, col])
        real = new > -np.inf
        if not real.all():
            at, col, new = at[real], col[real], new[real]
        if not len(new):
            return
        if self._ids is None:
            self._ids = np.zeros(self._gains.shape, ids.dtype)
        mine, ids = slots[at], ids[col]
        if (mine[1:] < mine[:-1]).any():
            order = np.argsort(mine, kind="stable")
            mine, new, ids = mine[order], new[order], ids[order]
        starts = np.flatnonzero(np.append(True, mine[1:] != mine[:-1]))
        touched, sizes = mine[starts], np.diff(np.append(starts, len(mine)))
        place = np.arange(len(mine)) - np.repeat(starts, sizes) + self._held[mine]
        over = self._held[touched] + sizes > self._room
        if over.any():
            full = np.repeat(over, sizes)
            self._merge(touched[over], np.repeat(np.arange(over.sum()), sizes[over]), place[full], new[full], ids[full])
            mine, place, new, ids = mine[~full], place[~full], new[~full], ids[~full]
            touched, sizes = touched[~over], sizes[~over]
        if len(new):
            self._widen(int(place.max()) + 1)
            self._gains[mine, place], self._ids[mine, place] = new, ids
            self._held[touched] += sizes

    def _rounded(self, gains: np.ndarray) -> np.ndarray:
        return gains if self.digits is None else np.round(np.minimum(gains, self.most), self.digits)

    def _settle(self) -> None:
        """Sort what is held, some queries at a time."""
        if self._ids is None:
            return
        step = max(1, SCORES // self._gains.shape[1])
        none = np.zeros(0, np.int64)
        for i in range(0, len(self._held), step):
            self._merge(np.arange(i, min(i + step, len(self._held))), none, none, np.zeros(0), self._ids[:0, 0])

    def _merge(self, slots, row, place, gains, ids) -> None:
        """Keep the best of what ``slots`` hold and of new rows, which lie at ``place``."""
        width = max(int(place.max(initial=-1)) + 1, int(self._held[slots].max(initial=0)))
        if not width:
            return
        self._widen(min(width, self.k))
        have = min(width, self._gains.shape[1])
        all_gains = np.full((len(slots), width), -np.inf)
        all_ids = np.zeros((len(slots), width), self._ids.dtype)
        all_gains[:, :have], all_ids[:, :have] = self._gains[slots, :have], self._ids[slots, :have]
        all_gains[row, place], all_ids[row, place] = gains, ids
        tie = all_ids
        if tie.dtype == object:
            real = all_gains > -np.inf
            tie = np.zeros(all_ids.shape, np.int64)
            tie[real] = np.unique(all_ids[real], return_inverse=True)[1]
        order = np.lexsort((tie, -all_gains), axis=-1)[:, : self.k]
        best = np.take_along_axis(all_gains, order, axis=1)
        self._gains[slots] = -np.inf
        self._gains[slots, : best.shape[1]] = best
        self._ids[slots, : best.shape[1]] = np.take_along_axis(all_ids, order, axis=1)
        self._held[slots] = (best > -np.inf).sum(1)
        if best.shape[1] == self.k:
            self.floor[slots] = np.maximum(self.floor[slots], best[:, self.k - 1])

    def _widen(self, wanted: int) -> None:
        more = min(self._room, max(wanted, 2 * self._gains.shape[1])) - self._gains.shape[1]
        if wanted > self._gains.shape[1]:
            self._gains = np.pad(self._gains, ((0, 0), (0, more)), constant_values=-np.inf)
            self._ids = np.concatenate([self._ids, np.zeros((len(self._ids), more), self._ids.dtype)], axis=1)


def _best_rows(best: _Best, query_ids: np.ndarray, metric: str) -> tuple[np.ndarray, ...]:
    """Query, place, id and score of all that is held, by query and place."""
    gains, held = best.gains, best.ids
    slot, place = np.nonzero(gains > -np.inf)
    score = gains[slot, place]
    # Adding zero turns the negative zero of a negated distance into zero.
    score = (-score if metric == "l2" else score) + 0.0
    ids = np.zeros(0, np.int64) if held is None else held[slot, place]
    return query_ids[slot], place, ids, score


def _hits(best: _Best, query_ids: np.ndarray, metric: str, schema: pa.Schema) -> pa.RecordBatch:
    names, _, ids, score = _best_rows(best, query_ids, metric)
    return pa.RecordBatch.from_arrays(
        [_column(c, f.type) for c, f in zip((names, ids, score), schema)], schema=schema
    )


def _most(metric: str) -> float:
    """No negated distance is above zero."""
    return 0.0 if metric == "l2" else np.inf


def _column(values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.array(values.tolist(), kind) if values.dtype == object else pa.array(values).cast(kind)


def _ids(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if pa.types.is_integer(column.type):
        return column.to_numpy()
    return np.asarray(column.to_pylist(), dtype=object)


def knn_join(
    queries: DataFrame,
    corpus: DataFrame,
    k: int = TOP_K,
    metric: str = "cosine",
    query_col: str = "query_id",
    id_col: str = "id",
    query_vector: str = "embedding",
    vector_col: str = "embedding",
    cell: str | None = None,
    exclude_self: bool = False,
    max_shipped: int = MAX_SHIPPED_NUMBERS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """``(query, rank, id, score)``: the exact best ``k`` rows for every query.

    With ``cell`` both sides carry that column and a query meets only the rows
    of its cells (a query may appear once per cell it probes).

    Queries within ``max_shipped`` numbers go to every task as a matrix and the
    corpus is scanned once, without a shuffle. More are dealt out in blocks of
    that size, one to a task, and all rows pass by each block, ``block_rows`` of
    a cell at a time. In both cases a task scores a matrix product and emits at
    most ``k`` rows per query. With ``exclude_self`` no row meets its own key.
    """
    vec.check_metric(metric)
    cells = [] if cell is None else [cell]
    left = queries.select(
        F.col(query_col).alias("_query"),
        F.col(query_vector).alias("_query_vector"),
        *[F.col(c).cast("long").alias("_cell") for c in cells],
    )
    right = corpus.select(
        F.col(id_col).alias("_id"),
        F.col(vector_col).alias("_vector"),
        *[F.col(c).cast("long").alias("_cell") for c in cells],
    )
    if not cells:
        left = left.withColumn("_cell", F.lit(0).cast("long"))
        right = right.withColumn("_cell", F.lit(0).cast("long"))
    schema = T.StructType(
        [
            T.StructField("_query", left.schema["_query"].dataType),
            T.StructField("_id", right.schema["_id"].dataType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    head = left.where(F.col("_query_vector").isNotNull()).first()
    if head is None:
        hits = queries.sparkSession.createDataFrame([], schema)
    else:
        limit = max(1, min(max_shipped // max(1, len(head["_query_vector"])), MAX_HELD_ROWS // k))
        near = left.limit(limit + 1).toArrow()
        if near.num_rows > limit:
            found = _blocks(left, right, k, metric, schema, limit, exclude_self, block_rows, bool(cells))
            return found.select(F.col("_query").alias(query_col), "rank", F.col("_id").alias(id_col), "score")
        hits = _scan(_present(near, "_query_vector"), right, k, metric, schema, exclude_self)
    order = [vec.best_first("score", metric), "_id"]
    return top_k(hits, k, "_query", order).select(
        F.col("_query").alias(query_col), "rank", F.col("_id").alias(id_col), "score"
    )


def _asked(names: np.ndarray, vectors: np.ndarray, at: np.ndarray, cells: np.ndarray, metric: str):
    """Queries as tasks hold them: vector forms, the slot of each, keys of the slots,
    and by cell the vectors that visit it, in the order of their slots.

    ``at`` and ``cells`` say which vector visits which cell."""
    names, slots = np.unique(names, return_inverse=True)
    order = np.argsort(slots[at], kind="stable")
    at, cells = at[order], cells[order]
    order = np.argsort(cells, kind="stable")
    found, starts = np.unique(cells[order], return_index=True)
    by_cell = dict(zip(found.tolist(), np.split(at[order], starts[1:])))
    return _asked_form(vectors, metric), slots, names, by_cell


def _meet(best: _Best, asked, rows: np.ndarray, ids: np.ndarray, cell: int, exclude_self: bool) -> None:
    """Score rows of one cell, in their form, against the queries that visit it."""
    vectors, slots, names, by_cell = asked
    mine = by_cell.get(cell, slots[:0])
    if exclude_self:
        place = np.minimum(np.searchsorted(names, ids), len(names) - 1)
        own = np.where(names[place] == ids, place, -1)
    # A few million scores at a time keep a task's memory flat.
    step = max(1, SCORES // max(1, len(ids)))
    for i in range(0, len(mine), step):
        part = mine[i : i + step]
        some = slots[part]
        found = vectors[part] @ rows.T
        if exclude_self:
            low, high = np.searchsorted(some, own, "left"), np.searchsorted(some, own, "right")
            for j in np.flatnonzero(low < high):
                found[low[j] : high[j], j] = -np.inf
        best.add(some, found, ids)


def _blocks(
    left: DataFrame,
    right: DataFrame,
    k: int,
    metric: str,
    schema: T.StructType,
    limit: int,
    exclude_self: bool,
    block_rows: int,
    celled: bool,
) -> DataFrame:
    """One block of queries to a task, past which all rows go: no hit travels.

    Blocks go by key hash and are a little smaller than they may be, since hashes
    do not deal evenly. Rows travel in bundles of one cell, once for each block.
    """
    spark, most = left.sparkSession, _most(metric)
    left = left.where(F.col("_query_vector").isNotNull())
    # A query's vector is held once, whatever the number of cells it visits.
    left = (
        left.groupBy("_query", "_query_vector").agg(F.collect_list("_cell").alias("_cells"))
        if celled
        else left.select("_query", "_query_vector", F.array("_cell").alias("_cells"))
    )
    left = stored(left, "asked")
    blocks = max(-(-left.count() * 10 // (9 * limit)), 2 * spark.sparkContext.defaultParallelism)
    kinds = {name: df.schema[name].dataType for df, name in ((left, "_query"), (left, "_query_vector"), (right, "_id"), (right, "_vector"))}
    bundle = T.StructType(
        [
            T.StructField("_block", T.IntegerType()),
            T.StructField("_cell", T.LongType()),
            T.StructField("_names", T.ArrayType(kinds["_query"])),
            T.StructField("_cells", T.ArrayType(T.ArrayType(T.LongType()))),
            T.StructField("_ids", T.ArrayType(kinds["_id"])),
            T.StructField("_numbers", T.BinaryType()),
        ]
    )
    arrow = to_arrow_schema(bundle)
    widths = [np.float32 if kinds[c].elementType == T.FloatType() else np.float64 for c in ("_query_vector", "_vector")]

    def bundled(block, cell, names, cells, ids, vectors: np.ndarray) -> pa.RecordBatch:
        one = [[block], [cell], [names], [cells], [ids], [vectors.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(one, arrow)], schema=arrow)

    def pack_queries(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = as_matrix(batch.column("_query_vector")).astype(widths[0])
            block = batch.column("_block").to_numpy()
            for b in np.unique(block):
                at = np.flatnonzero(block == b)
                some = batch.take(pa.array(at))
                yield bundled(b, None, some.column("_query"), some.column("_cells"), None, vectors[at])

    def pack_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: dict[int, list[pa.RecordBatch]] = {}

        def out(cell: int) -> pa.RecordBatch:
            table = pa.Table.from_batches(waiting.pop(cell)).combine_chunks()
            vectors = as_matrix(table["_vector"]).astype(widths[1])
            return bundled(None, cell, None, None, table["_id"].combine_chunks(), vectors)

        for batch in batches:
            batch = _present(batch, "_vector")
            batch = batch.filter(pc.is_valid(batch.column("_cell")))
            if not batch.num_rows:
                continue
            cells = batch.column("_cell").to_numpy()
            dim = max(1, len(batch.column("_vector")[0]))
            most = max(1, min(block_rows, BLOCK_NUMBERS // dim))
            for cell in np.unique(cells):
                some = batch.take(pa.array(np.flatnonzero(cells == cell)))
                for i in range(0, some.num_rows, most):
                    held = waiting.setdefault(int(cell), [])
                    held.append(some.slice(i, most))
                    if sum(b.num_rows for b in held) >= most:
                        yield out(int(cell))
        for cell in list(waiting):
            yield out(cell)

    ranked = T.StructType([schema["_query"], T.StructField("rank", T.IntegerType()), schema["_id"], schema["score"]])
    ranked_arrow = to_arrow_schema(ranked)

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, cells, numbers = [], [], []
        asked = best = None
        for batch in batches:
            for i in range(batch.num_rows):
                row = {name: batch.column(name)[i] for name in ("_cell", "_names", "_cells", "_ids", "_numbers")}
                flat = row["_numbers"].as_buffer()
                if row["_ids"].values is None:
                    names.append(_ids(row["_names"].values))
                    cells.append(row["_cells"].values)
                    numbers.append(np.frombuffer(flat, widths[0]).reshape(len(names[-1]), -1))
                    continue
                if asked is None:
                    if not names:
                        return
                    asked = gather(names, cells, numbers)
                    names, cells, numbers = None, None, None
                    best = _Best(len(asked[2]), k, SCORE_DIGITS, most)
                ids = _ids(row["_ids"].values)
                rows = np.frombuffer(flat, widths[1]).reshape(len(ids), -1).astype(float)
                _meet(best, asked, _row_form(rows, metric), ids, row["_cell"].as_py(), exclude_self)
        if best is None:
            return
        found, place, ids, score = _best_rows(best, asked[2], metric)
        columns = (found, place + 1, ids, score)
        for i in range(0, len(score), SCORES // 4):
            yield pa.RecordBatch.from_arrays(
                [_column(c[i : i + SCORES // 4], f.type) for c, f in zip(columns, ranked_arrow)], schema=ranked_arrow
            )

    def gather(names, cells, numbers):
        visits = pa.chunked_array(cells)
        at = np.repeat(np.arange(len(visits)), np.asarray(pc.list_value_length(visits)))
        flat = np.concatenate([np.asarray(c.flatten()) for c in visits.chunks])
        return _asked(np.concatenate(names), np.concatenate(numbers).astype(float), at, flat, metric)

    block = F.pmod(F.xxhash64("_query"), F.lit(blocks)).cast("int").alias("_block")
    queries = left.select("*", block).mapInArrow(pack_queries, bundle)
    copies = F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("_block")
    rows = right.mapInArrow(pack_rows, bundle).select(copies, *bundle.names[1:])
    # Queries, which have no cell of their own, come first.
    met = queries.unionByName(rows).repartitionById(blocks, F.col("_block")).sortWithinPartitions(F.asc_nulls_first("_cell"))
    return met.mapInArrow(scan, ranked)


def _scan(
    near: pa.Table, right: DataFrame, k: int, metric: str, schema: T.StructType, exclude_self: bool = False
) -> DataFrame:
    """Score every row against a shipped, size-checked set of queries."""
    out, most = to_arrow_schema(schema), _most(metric)
    if not near.num_rows:
        return right.sparkSession.createDataFrame([], schema)
    vectors, cell_of = as_matrix(near["_query_vector"]), near["_cell"]
    given = np.flatnonzero(np.asarray(pc.is_valid(cell_of)))
    asked = _asked(_ids(near["_query"]), vectors, given, cell_of.drop_null().to_numpy(), metric)
    by_cell = asked[3]
    sent = right.sparkSession.sparkContext.broadcast(asked)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = sent.value
        best = _Best(len(asked[2]), k, SCORE_DIGITS, most)
        for batch in batches:
            batch = _present(batch, "_vector")
            batch = batch.filter(pc.is_valid(batch.column("_cell")))
            if not batch.num_rows:
                continue
            rows, ids = _row_form(as_matrix(batch.column("_vector")), metric), _ids(batch.column("_id"))
            cells = batch.column("_cell").to_numpy()
            for c in np.unique(cells):
                at = np.flatnonzero(cells == c)
                _meet(best, asked, rows[at], ids[at], int(c), exclude_self)
        yield _hits(best, asked[2], metric, out)

    if len(by_cell) > 1 or 0 not in by_cell:
        right = right.where(F.col("_cell").isin(sorted(by_cell)))
    return right.mapInArrow(run, schema)


def knn_graph(
    df: DataFrame,
    k: int | None = None,
    metric: str = "cosine",
    id_col: str = "id",
    vector_col: str = "embedding",
    cell: str | None = None,
    of: str | None = None,
) -> DataFrame:
    """Each row's ``k`` nearest other rows; ``k`` defaults to ``sqrt(n - 1)``.

    ``of`` is an expression for the rows whose neighbours are wanted, all by
    default; they are sought among all rows. Give ``cell`` (the cells of an
    index) when the table is too large for all pairs of rows.
    """
    if k is None:
        k = max(1, int((df.count() - 1) ** 0.5))
    queries = filter_expression(df, of).withColumnRenamed(id_col, "query_id")
    return knn_join(
        queries, df, k, metric, id_col=id_col, query_vector=vector_col, vector_col=vector_col,
        cell=cell, exclude_self=True,
    )


def with_fields(hits: DataFrame, corpus: DataFrame, fields: list[str], id_col: str = "id") -> DataFrame:
    """Add corpus columns to hits. The few hits are stored, counted and sent to
    the scan, so the corpus does not move."""
    hits = stored(hits, "hits")
    return corpus.select(id_col, *fields).join(small_side(hits), id_col)
