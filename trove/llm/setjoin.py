"""Exact Jaccard joins of sets of hashes: prefixes, candidates, verification.

A set is known by its fingerprint ``fp``. In the order of ``rarity`` two sets
that link share a hash among their first few, so each set is posted under those
with its size ``n`` and the hash's place ``pos``. Pairs from a posting list go
through the length and positional filters and are verified on whole sets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.llm.rarity import SINGLE, Rarity, Sets, members
from trove.llm.words import fingerprints, give_back, grids, raw_texts
from trove.session import stored

#: Two sets link when 100 * shared >= PERCENT * union.
PERCENT = 80
#: Pairs of whole sets that a task holds at once.
PAIRS_AT_ONCE = 64
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def overlap_needed(a: int, b: int, percent: int = PERCENT) -> int:
    """The least number of shared members with which sets of these sizes link."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int | np.ndarray, percent: int = PERCENT) -> int | np.ndarray:
    """How many first hashes must hold one that a linked set has among its own."""
    return n - -(-percent * n // 100) + 1


def fits(a: str, b: str, percent: int = PERCENT) -> Column:
    """Length and positional filters of postings ``a`` and ``b`` of one hash."""
    left = f"{a}.n - {a}.pos"
    right = f"{b}.n - {b}.pos"
    return F.expr(
        f"{100} * least({a}.n, {b}.n) >= {percent} * greatest({a}.n, {b}.n) AND "
        f"{100 + percent} * least({left}, {right}) >= {percent} * ({a}.n + {b}.n)"
    )


def units(
    texts: DataFrame,
    sets: Sets,
    rare: Rarity,
    percent: int = PERCENT,
    subsets: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray] | None] | None = None,
) -> DataFrame:
    """One row per set: the key columns of ``texts``, ``unit``, ``n``, ``fp``, ``posted``.

    ``posted`` has the prefix in order, once per distinct set of a task, without
    its first ``skip`` hashes, which no other set of the corpus holds. Where
    ``subsets`` answers for a set, ``subset`` has the signatures it gives and
    ``lower`` whether the set is the smaller kind there; ``posted`` may then
    still be needed for larger partners. ``bits`` and ``more`` are the
    set's ``parities``.
    Empty sets have no ``fp``.
    """
    shipped = texts.sparkSession.sparkContext.broadcast(rare)
    ids = texts.columns[:-1]
    schema = texts.select(*(f"`{c}`" for c in ids)).schema
    made = (
        "unit int, n int, fp long, bits long, more long, skip int, "
        "posted array<long>, subset array<long>, lower array<boolean>"
    )
    for field in T.StructType.fromDDL(made):
        schema = schema.add(field)

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            for owners, unit, sizes, flat in sets(raw_texts(batch, len(ids))):
                prints = fingerprints(flat, sizes)
                fresh = np.zeros(len(sizes), bool)
                some, names = np.flatnonzero(sizes), prints.tolist()
                for k in some.tolist():
                    if names[k] not in done:
                        if len(done) > 1_000_000:
                            done.clear()
                        done.add(names[k])
                        fresh[k] = True
                skip, ends, posted = prefixes(flat, sizes, fresh, shipped.value.level_of(flat), percent)
                starts = np.cumsum(sizes) - sizes
                signs, small = [flat[:0]] * len(sizes), [flat[:0]] * len(sizes)
                for k in np.flatnonzero(fresh).tolist() if subsets else ():
                    found = flat[starts[k] : starts[k] + sizes[k]]
                    signs[k], small[k] = subsets(found) or (flat[:0], flat[:0])
                bits = [parities(flat, sizes, k) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays(
                    [
                        *(c.take(pa.array(owners, pa.int64())) for c in batch.columns[: len(ids)]),
                        pa.array(unit, pa.int32()),
                        pa.array(sizes, pa.int32()),
                        pa.array(prints, pa.int64(), mask=sizes == 0),
                        *map(pa.array, bits),
                        pa.array(skip, pa.int32()),
                        pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(posted.view(np.int64))),
                        _lists(signs, np.int64),
                        _lists(small, bool),
                    ],
                    schema.names,
                )
            give_back()

    return texts.mapInArrow(make, schema)


def prefixes(
    flat: np.ndarray, sizes: np.ndarray, wanted: np.ndarray, levels: np.ndarray, percent: int = PERCENT
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The first hashes by rarity of the ``wanted`` sets, less those that no other set holds.

    Returns how many of each set are left out, where the list of each set ends
    (from 0) and the lists. What is left out comes first in a prefix and would
    be alone in its posting list.
    """
    starts = np.cumsum(sizes) - sizes
    skip, lengths = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
    order, places = [sizes[:0]], [sizes[:0]]
    chosen = np.where(wanted, sizes, 0)
    for rows, inside in grids(chosen):
        n = sizes[rows]
        # Cells beyond a set come last, whatever the level of its members.
        grid = np.full(inside.shape, 255, np.uint8)
        at = starts[rows, None] + np.arange(inside.shape[1])
        grid[inside] = levels[at[inside]]
        first = prefix_length(n, percent)
        skip[rows] = np.minimum((grid <= SINGLE).sum(axis=1), first)
        kept = np.argsort(grid, axis=1, kind="stable")[:, : first.max()]
        column = np.arange(kept.shape[1])
        taken = (column >= skip[rows, None]) & (column < first[:, None])
        lengths[rows] = taken.sum(axis=1)
        order.append(rows)
        places.append((starts[rows, None] + kept)[taken])
    # The lists, made by size, in the order of the sets.
    order, places = np.concatenate(order), np.concatenate(places)
    ends = np.concatenate([[0], np.cumsum(lengths)])
    out = np.empty(len(places), np.int64)
    own = np.cumsum(lengths[order]) - lengths[order]
    out[np.repeat(ends[order] - own, lengths[order]) + np.arange(len(places))] = places
    return skip, ends, flat[out]


def _lists(rows: list[np.ndarray], kind) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    flat = np.concatenate(rows) if rows else np.empty(0, np.uint64)
    values = flat.astype(bool) if kind is bool else flat.astype(np.uint64, copy=False).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def parities(flat: np.ndarray, sizes: np.ndarray, half: int) -> np.ndarray:
    """Half of 128 bits per set, each telling whether an odd number of members fall on it.

    ``flat`` has the members of all sets, one after another; a member falls on
    one bit of one half. Two sets differ in at least as many members as their
    parities differ in bits.
    """
    out = np.zeros(len(sizes), np.uint64)
    some = np.flatnonzero(sizes)
    if len(some):
        one = np.uint64(1) << (flat >> np.uint64(58))
        one *= ((flat >> np.uint64(57)) & np.uint64(1)) == np.uint64(half)
        starts = (np.cumsum(sizes) - sizes)[some]
        out[some] = np.bitwise_xor.reduceat(one, starts)
    return out.view(np.int64)


def close_lists(found: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Postings of small sets that may link with another one in their list.

    Lists lie in tasks, sorted by size. A task compares neighbours within the
    length filter, as far as it reaches and no further, by the positional filter
    and by their parities; it emits members that pass with some other set, never
    pairs. What it holds is the members of one list within one length window.
    """
    rows = found.where("fp IS NOT NULL").select(
        "fp", "n", "bits", "more", "skip", F.posexplode("posted").alias("pos", "token")
    )
    packed = rows.select(
        F.shiftright("token", 32).cast("int").alias("token"),
        (F.shiftleft(F.col("n").cast("long"), 32) + F.col("skip") + F.col("pos")).alias("npos"),
        "fp",
        "bits",
        "more",
    )
    lists = packed.repartition("token").sortWithinPartitions("token", "npos")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.empty(0, np.int64)] * 5
        close = np.empty(0, bool)
        for batch in batches:
            new = [c.to_numpy().astype(np.int64) for c in batch.columns]
            seen = len(close)
            held = [np.concatenate(x) for x in zip(held, new, strict=True)]
            close = np.concatenate([close, np.zeros(batch.num_rows, bool)])
            token, npos, fp, bits, more = held
            n = npos >> 32
            own = n - (npos & 0xFFFFFFFF)
            i = np.arange(len(token))
            step = 0
            while len(i):
                step += 1
                i = i[i + step < len(token)]
                j = i + step
                near = (token[i] == token[j]) & (100 * n[i] >= percent * n[j])
                i, j = i[near], j[near]
                fresh = j >= seen
                a, b = i[fresh], j[fresh]
                most = n[a] + n[b]
                least = -(-percent * most // (100 + percent))
                yes = np.minimum(own[a], own[b]) >= least
                a, b, most, least = a[yes], b[yes], most[yes], least[yes]
                differ = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).astype(np.int64)
                differ += np.bitwise_count((more[a] ^ more[b]).view(np.uint64))
                yes = (differ <= most - 2 * least) & (fp[a] != fp[b])
                close[a[yes]] = True
                close[b[yes]] = True
            # What later rows may still meet stays.
            stays = (token == token[-1]) & (100 * n >= percent * n[-1]) if len(token) else close
            yield pa.RecordBatch.from_arrays([pa.array(x[close & ~stays]) for x in held], names)
            held, close = [x[stays] for x in held], close[stays]
        yield pa.RecordBatch.from_arrays([pa.array(x[close]) for x in held], names)

    names = ["token", "npos", "fp", "bits", "more"]
    made = lists.mapInArrow(scan, "token long, npos long, fp long, bits long, more long")
    me = F.struct(
        F.expr("CAST(npos & 4294967295 AS int)").alias("pos"),
        F.shiftright("npos", 32).cast("int").alias("n"),
        "fp",
        "bits",
        "more",
    )
    return made.select("token", me.alias("me"))


def alike(a: str, b: str, percent: int = PERCENT) -> Column:
    """Length, positional and parity filters of postings ``a`` and ``b`` of one hash."""
    both = f"{a}.n + {b}.n"
    # Twice the overlap that is needed, rounded up, leaves the most to differ in.
    least = f"(({percent} * ({both}) + {99 + percent}) div {100 + percent})"
    return fits(a, b, percent) & F.expr(
        f"bit_count({a}.bits ^ {b}.bits) + bit_count({a}.more ^ {b}.more) <= {both} - 2 * {least}"
    )


def postings(found: DataFrame) -> DataFrame:
    """``token``, ``fp``, ``n`` and ``pos`` of every posted hash."""
    rows = found.select("fp", "n", "skip", F.posexplode("posted").alias("pos", "token"))
    return rows.withColumn("pos", F.col("skip") + F.col("pos")).drop("skip")


def shared_lists(posted: DataFrame) -> DataFrame:
    """Postings of hashes that more than one set posts, with a leader per list.

    The leader is the member before whose hash the fewest rarer ones come: the
    set with the least that is its own.
    """
    per = W.partitionBy("token")
    me = F.struct("pos", "n", "fp")
    marked = posted.select(
        "token",
        me.alias("me"),
        F.min(me).over(per).alias("lead"),
        (F.min("fp").over(per) != F.max("fp").over(per)).alias("_more"),
    )
    return marked.where("_more").drop("_more")


def pair_of(a: Column, b: Column) -> list[Column]:
    """An unordered pair as columns ``a`` and ``b``, the smaller first."""
    return [F.least(a, b).alias("a"), F.greatest(a, b).alias("b")]


def linked(
    pairs: DataFrame, found: DataFrame, texts: DataFrame, sets: Sets, percent: int = PERCENT
) -> DataFrame:
    """The pairs (``a``, ``b``) of fingerprints whose whole sets link.

    Only documents that hold a set of some pair are read again; their sets are
    joined to the pairs and compared. ``texts`` has the numeric column ``_key``.
    """
    pairs = stored(pairs.distinct(), "pairs")
    if pairs.isEmpty():
        return pairs
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("fp")).distinct()
    holders = found.where("fp IS NOT NULL").groupBy("fp").agg(F.min("_key").alias("_key"))
    wanted = stored(nodes.join(holders, "fp"), "nodes")
    spark = texts.sparkSession
    keys = spark.sparkContext.broadcast(members(wanted.select("_key").distinct()))
    prints = spark.sparkContext.broadcast(members(wanted.select("fp")))
    bodies = texts.select("_key", texts.columns[-1])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[int] = set()
        for batch in batches:
            held = keys.value.holds(batch.column(0).to_numpy())
            batch = batch.filter(pa.array(held))
            out, data = [], []
            for _, _, sizes, flat in sets(raw_texts(batch, 1)):
                names, starts = fingerprints(flat, sizes), np.cumsum(sizes) - sizes
                for k in np.flatnonzero((sizes > 0) & prints.value.holds(names)).tolist():
                    fp = int(names[k])
                    if fp not in done:
                        if len(done) > 1_000_000:
                            done.clear()
                        done.add(fp)
                        out.append(fp)
                        data.append(flat[starts[k] : starts[k] + sizes[k]].tobytes())
            yield pa.RecordBatch.from_arrays(
                [pa.array(out, pa.int64()), pa.array(data, pa.binary())], ["fp", "members"]
            )
            give_back()

    made = bodies.mapInArrow(again, "fp long, members binary")
    kept = stored(made.join(nodes, "fp", "left_semi").dropDuplicates(["fp"]), "sets")
    both = pairs.join(kept.toDF("a", "_a"), "a").join(kept.toDF("b", "_b"), "b")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yes = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                a, b = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                yes.append(shared(a, b) >= overlap_needed(len(a), len(b), percent))
            yield batch.filter(pa.array(yes, pa.bool_())).select([0, 1])

    checked = both.select("a", "b", "_a", "_b").mapInArrow(check, "a long, b long")
    # Two whole sets a row: few rows at a time keep a task's memory flat.
    before = spark.conf.get(_BATCH_ROWS)
    spark.conf.set(_BATCH_ROWS, str(PAIRS_AT_ONCE))
    try:
        return stored(checked, "links")
    finally:
        spark.conf.set(_BATCH_ROWS, before)


def shared(a: np.ndarray, b: np.ndarray) -> int:
    """How many members two sorted sets share."""
    if len(a) > len(b):
        a, b = b, a
    if not len(a):
        return 0
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int((b[at] == a).sum())
