"""BM25 postings kept by document ranges, and top-k search that skips blocks.

All postings of a document lie in one range, and a range is one file with one
row group, so one task scores its documents whole and only its best ``k`` rows
per query are exchanged. Counts are stored instead of weights: a list keeps, for
every ``BLOCK`` postings, the largest count and the shortest text, which bound
the weight for any mean length, so an index stays right while its corpus grows.

Rows of a range: for each term ``_term`` the arrays ``_ids, _tfs, _lens`` and the
bounds ``_tops, _lows``; for each document a row with an empty term, its id and
its ``fields``, which a filter is applied to before anything is scored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trove.functions.vectors import SCORE_DIGITS
from trove.operators.bm25 import B, K1, WEIGHT_DIGITS
from trove.operators.ranking import top_k
from trove.session import SMALL_ROWS, stored

BLOCK = 128
#: Postings of one range, and so of one task and one file.
RANGE_POSTINGS = 4_000_000
#: A small corpus is still cut in a range for each core, down to this size.
LEAST_POSTINGS = 50_000
#: Postings that leave a task's Python together.
BATCH_POSTINGS = 500_000
#: Beyond any range, so that a file is a single row group.
ROW_GROUP_BYTES = 1 << 30

INNER = ["_term", "_ids", "_tfs", "_lens", "_tops", "_lows"]


@dataclass(frozen=True)
class Scoring:
    """What a weight depends on besides the posting: the mean length, the
    lightest weight that counts, and the two constants."""

    avg_len: float
    cut: float = 0.0
    k1: float = K1
    b: float = B

    def weights(self, tfs: np.ndarray, lens: np.ndarray) -> np.ndarray:
        raw = tfs / (tfs + self.k1 * (1 - self.b + self.b * (lens / self.avg_len)))
        return np.floor(raw * 10**WEIGHT_DIGITS + 0.5) / 10**WEIGHT_DIGITS


def write_postings(
    counts: DataFrame,
    path: str,
    id_col: str,
    fields: list[str],
    n_postings: int,
    range_postings: int = RANGE_POSTINGS,
) -> None:
    """Write ``counts (id, fields, doc_len, words)`` as ranges of postings.

    A range is a hash of the key, so ranges are even and any key finds its own.
    One shuffle deals the counts out; a task sorts the numbers of a range's postings
    by term and id, and cuts them into lists.
    """
    cores = counts.sparkSession.sparkContext.defaultParallelism
    ranges = max(1, -(-n_postings // range_postings), min(cores, n_postings // LEAST_POSTINGS))
    span = F.pmod(F.xxhash64(F.col(id_col)), F.lit(ranges)).cast("int").alias("_range")
    rows = counts.where("words IS NOT NULL").select(span, F.col(id_col).alias("_id"), "doc_len", "words", *fields)
    types = {f.name: f.dataType for f in rows.schema.fields}
    schema = T.StructType().add("_range", types["_range"]).add("_term", T.StringType()).add("_ids", T.ArrayType(types["_id"]))
    for name in ("_tfs", "_lens", "_tops", "_lows"):
        schema = schema.add(name, T.ArrayType(T.IntegerType()))
    for name in fields:
        schema = schema.add(name, types[name])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [batch for batch in batches if batch.num_rows]
        if held:
            yield from _lists_of(pa.Table.from_batches(held), to_arrow_schema(schema))

    # One task for each range: by number, so that no two ranges fall together.
    out = rows.repartitionById(ranges, "_range").mapInArrow(gather, schema)
    # Terms are in order within a file, so pages without a wanted term are skipped.
    out.sortWithinPartitions("_range", "_term").write.option(
        "parquet.block.size", ROW_GROUP_BYTES
    ).partitionBy("_range").parquet(path)


def _lists_of(rows: pa.Table, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The documents and the lists, by term, of a range's ``rows (_range, _id, doc_len, words, fields)``."""
    span, ids = rows.column("_range")[0].as_py(), rows.column("_id").combine_chunks()
    fields = [rows.column(f.name).combine_chunks() for f in list(schema)[len(INNER) + 1 :]]
    doc_lens = rows.column("doc_len").to_numpy().astype(np.int32)
    words = rows.column("words")
    sizes = np.concatenate([np.diff(chunk.offsets.to_numpy()) for chunk in words.chunks])
    flat = [chunk.flatten() for chunk in words.chunks]
    doc = np.repeat(np.arange(len(ids)), sizes)
    tfs = np.concatenate([pc.struct_field(x, "tf").to_numpy() for x in flat]).astype(np.int32)
    names = pa.chunked_array([pc.struct_field(x, "term") for x in flat]).combine_chunks().dictionary_encode()
    del rows, words, flat
    # Numbers of ids and terms in their order; equal ids, and null ones, share one.
    by_id = pc.sort_indices(ids, null_placement="at_start").to_numpy()
    coded = ids.dictionary_encode(null_encoding="encode").indices.to_numpy()[by_id]
    id_no = np.empty(len(ids), np.int64)
    id_no[by_id] = np.cumsum(np.append(False, coded[1:] != coded[:-1]))
    by_term = pc.sort_indices(names.dictionary).to_numpy()
    term_no = np.empty(len(by_term), np.int64)
    term_no[by_term] = np.arange(len(by_term))

    def batch_of(terms: pa.Array, doc, tfs, starts, more: list[pa.Array]) -> pa.RecordBatch:
        """Rows that begin at ``starts`` of the postings, which are in order."""
        lens, stops = doc_lens[doc], np.append(starts[1:], len(doc))
        blocks = -(-(stops - starts) // BLOCK)
        ends = np.cumsum(blocks)
        at = np.repeat(starts - (ends - blocks) * BLOCK, blocks) + np.arange(ends[-1]) * BLOCK
        lists = [
            (starts, ids.take(pa.array(doc))),
            (starts, pa.array(tfs)),
            (starts, pa.array(lens)),
            (ends - blocks, pa.array(np.maximum.reduceat(tfs, at))),
            (ends - blocks, pa.array(np.minimum.reduceat(lens, at))),
        ]
        arrays = [pa.array(np.full(len(starts), span, np.int32)), terms] + [
            pa.ListArray.from_arrays(pa.array(np.append(begin, len(x)), pa.int32()), x) for begin, x in lists
        ]
        return pa.RecordBatch.from_arrays(arrays + more, schema=schema)

    order = np.lexsort((doc_lens, id_no))
    starts = np.flatnonzero(np.append(True, id_no[order][1:] != id_no[order][:-1]))
    first = pa.array(np.minimum.reduceat(order, starts))
    kept = [x.take(first) for x in fields]
    yield batch_of(pa.array([""] * len(starts)), order, np.zeros(len(order), np.int32), starts, kept)
    if not len(doc):
        return
    key = term_no[names.indices.to_numpy()] * len(ids) + id_no[doc]
    unique = id_no.max() + 1 == len(ids)
    order = np.argsort(key) if unique else np.lexsort((doc_lens[doc], tfs, key))
    doc, tfs, term = doc[order], tfs[order], key[order] // len(ids)
    starts = np.flatnonzero(np.append(True, term[1:] != term[:-1]))
    terms = names.dictionary.take(pa.array(by_term))
    # Every term of the dictionary occurs, so row i is about term i.
    cuts = np.unique(np.searchsorted(starts, np.arange(0, len(doc), BATCH_POSTINGS)))
    for low, high in zip(cuts, np.append(cuts[1:], len(starts))):
        begin, end = starts[low], starts[high] if high < len(starts) else len(doc)
        none = [pa.nulls(high - low, x.type) for x in fields]
        yield batch_of(terms[low:high], doc[begin:end], tfs[begin:end], starts[low:high] - begin, none)


class _Top:
    """The best ``k`` of a query so far; equal scores rank by lower id."""

    def __init__(self, k: int):
        self.k, self.floor = k, -np.inf
        self.scores, self.ids = np.empty(0), None

    def add(self, scores: np.ndarray, ids: np.ndarray) -> None:
        if self.ids is not None:
            scores, ids = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids])
        if len(scores) > self.k:
            by_id = np.argsort(ids, kind="stable")
            order = by_id[np.argsort(-scores[by_id], kind="stable")][: self.k]
            scores, ids = scores[order], ids[order]
        self.scores, self.ids = scores, ids
        if len(scores) == self.k:
            self.floor = scores.min()


class _List:
    """The postings of one term in one range."""

    def __init__(self, ids, tfs, lens, tops, lows, scoring: Scoring):
        self.ids, self.tfs, self.lens, self.scoring = ids, tfs, lens, scoring
        # Rounding may lift a weight by half a digit over its bound.
        self.block_bounds = scoring.weights(tops, lows) + 10.0**-WEIGHT_DIGITS
        self.bound = float(self.block_bounds.max())

    def beginning(self, least: float) -> np.ndarray:
        """The ids in blocks whose weights may reach ``least``."""
        if least <= 0:
            return self.ids
        able = np.flatnonzero(self.block_bounds >= least)
        if len(able) == len(self.block_bounds):
            return self.ids
        return np.concatenate([self.ids[:0], *(self.ids[i * BLOCK : (i + 1) * BLOCK] for i in able)])


def score_range(lists: list[tuple[float, _List]], top: _Top, keep) -> tuple[int, int]:
    """Add a range's documents that can reach the top ``k`` of a query.

    Terms are taken by what they can add at most. Those at the end that cannot
    reach the floor together are essential to no hit: their documents are not
    candidates by themselves. A candidate goes as soon as its sum and all that
    may follow stay below the floor. Gives the postings held and those weighed.
    """
    order = sorted(range(len(lists)), key=lambda i: -lists[i][0] * lists[i][1].bound)
    lists = [lists[i] for i in order]
    bounds = np.array([max(0.0, w) * x.bound for w, x in lists])
    rest = np.append(np.cumsum(bounds[::-1])[::-1], 0.0)
    floor = top.floor - 10.0**-SCORE_DIGITS
    held = sum(len(x.ids) for _, x in lists)
    if rest[0] < floor:
        return held, 0
    found = [
        x.beginning((floor - rest[0] + bounds[i]) / w if w > 0 else -1.0)
        for i, (w, x) in enumerate(lists)
        if rest[i] >= floor
    ]
    ids = keep(np.unique(np.concatenate(found)))
    sums, matched, weighed = np.zeros(len(ids)), np.zeros(len(ids), bool), 0
    for i, (w, x) in enumerate(lists):
        at = np.minimum(np.searchsorted(x.ids, ids), len(x.ids) - 1)
        hit = np.flatnonzero(x.ids[at] == ids)
        weights = x.scoring.weights(x.tfs[at[hit]], x.lens[at[hit]])
        weighed += len(hit)
        heavy = weights >= x.scoring.cut
        sums[hit[heavy]] += w * weights[heavy]
        matched[hit[heavy]] = True
        able = sums + rest[i + 1] >= floor
        if not able.all():
            ids, sums, matched = ids[able], sums[able], matched[able]
    if matched.any():
        scores = np.floor(sums[matched] * 10**SCORE_DIGITS + 0.5) / 10**SCORE_DIGITS
        top.add(scores, ids[matched])
    return held, weighed


def _array(column: pa.Array, row: int) -> np.ndarray:
    values = column.slice(row, 1).flatten()
    if pa.types.is_integer(values.type):
        return values.to_numpy()
    return np.array(values.to_pylist(), dtype=object)


def search(
    wanted: DataFrame,
    postings: DataFrame,
    scoring: Scoring,
    k: int,
    query_col: str,
    id_col: str,
    where: str | None = None,
    segment_col: str | None = None,
    dead: DataFrame | None = None,
    max_asked: int = SMALL_ROWS,
) -> DataFrame:
    """``(query, rank, id, score)`` by inner product over stored postings.

    ``wanted`` is ``(query, term, weight)``. ``where`` is a filter on the fields
    kept beside the postings; it limits the candidates before any is scored.
    ``dead`` is ``(segment, id)`` of keys to leave out, bounded by its maker.
    The queries go to every task; more than ``max_asked`` terms go in several
    passes over the index, each with whole queries.
    """
    wanted = stored(wanted.select(query_col, "term", "weight"), "wanted")
    passes = -(-wanted.count() // max_asked)
    if passes <= 1:
        hits = _scan(wanted, postings, scoring, k, query_col, id_col, where, segment_col, dead)
    else:
        turn = F.pmod(F.xxhash64(query_col), F.lit(passes))
        parts = [
            _scan(wanted.where(turn == i), postings, scoring, k, query_col, id_col, where, segment_col, dead)
            for i in range(passes)
        ]
        hits = reduce(DataFrame.unionByName, parts)
    return top_k(hits, k, query_col, [F.desc("score"), id_col]).select(query_col, "rank", id_col, "score")


def _scan(wanted, postings, scoring, k, query_col, id_col, where, segment_col, dead) -> DataFrame:
    asked = wanted.toArrow()
    names, slots = np.unique(np.array(asked[query_col].to_pylist(), dtype=object), return_inverse=True)
    by_term: dict[str, list] = {}
    for term, slot, weight in zip(asked["term"].to_pylist(), slots.tolist(), asked["weight"].to_pylist()):
        by_term.setdefault(term, []).append((slot, weight))
    gone: dict = {}
    if dead is not None:
        for segment, key in map(tuple, dead.collect()):
            gone.setdefault(segment, set()).add(key)
    spark = postings.sparkSession
    sent = spark.sparkContext.broadcast((names.tolist(), by_term, gone))
    out = T.StructType(
        [
            T.StructField(query_col, wanted.schema[query_col].dataType),
            T.StructField(id_col, postings.schema["_ids"].dataType.elementType),
            T.StructField("score", T.DoubleType()),
        ]
    )
    # Terms are letters and digits only, so they need no quoting.
    listed = ", ".join(f"'{t}'" for t in sorted(by_term)) or "NULL"
    chosen = f"_term IN ({listed})"
    if where is not None:
        chosen = f"({chosen}) OR (_term = '' AND ({where}))"
    segment = F.lit("") if segment_col is None else F.col(segment_col)
    rows = postings.where(chosen).select(segment.alias("_segment"), "_range", *INNER)
    schema, filtered = to_arrow_schema(out), where is not None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, by_term, gone = sent.value
        tops: dict[int, _Top] = {}
        lists: dict[str, _List] = {}
        allowed: list = []
        now = None

        def finish() -> None:
            at: dict[int, list] = {}
            for term in sorted(lists):
                for slot, weight in by_term[term]:
                    at.setdefault(slot, []).append((weight, lists[term]))
            ok = np.unique(np.concatenate(allowed)) if allowed else None
            out_ids = gone.get(now[0])

            def keep(ids: np.ndarray) -> np.ndarray:
                if filtered:
                    ids = ids[np.isin(ids, ok)] if ok is not None else ids[:0]
                if out_ids:
                    ids = ids[[i not in out_ids for i in ids.tolist()]]
                return ids

            for slot, found in at.items():
                score_range(found, tops.setdefault(slot, _Top(k)), keep)

        for batch in batches:
            columns = {c: batch.column(c) for c in ("_ids", "_tfs", "_lens", "_tops", "_lows")}
            keys = zip(*(batch.column(c).to_pylist() for c in ("_segment", "_range", "_term")))
            for i, (seg, span, term) in enumerate(keys):
                if (seg, span) != now:
                    if now is not None:
                        finish()
                    now, lists, allowed = (seg, span), {}, []
                values = {c: _array(x, i) for c, x in columns.items() if term or c == "_ids"}
                if term:
                    lists[term] = _List(*values.values(), scoring)
                else:
                    allowed.append(values["_ids"])
        if now is not None:
            finish()
        rows = [(names[s], i, x) for s, top in tops.items() if top.ids is not None
                for i, x in zip(top.ids.tolist(), top.scores.tolist())]
        columns = list(zip(*rows)) if rows else [[], [], []]
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)

    return rows.mapInArrow(run, out)

