"""How far the word use of sources differs, audited over a quadtree.

Per language there is a matrix of term counts with a row for each source and a
column for each kept term, common terms first. It is cut in tiles of ``ROWS``
sources and ``COLUMNS`` terms, and each two tiles of one column range are one
Spark group. There a quadtree marks which quadrants hold a count. Two groups of
sources walk their trees together: where both quadrants are empty every cell
has the same price, which is paid once for the whole width; other quadrants are
halved, down to leaves that are compared cell by cell.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.operators.ranking import places
from trove.operators.skew import attach
from trove.session import small_side, stored

MIN_DOCS = 10
TOP_TERMS = 10
SCALE = 1_000_000_000
#: A tile's sides; both are powers of two.
ROWS, COLUMNS = 64, 1 << 13
#: The side of a leaf.
LEAF = 8
#: Quadrant pairs that are worked on together.
FRONT = 1 << 11

#: Counters of a task are handed on beyond this many entries.
HELD = 400_000
#: Bytes of a text that are split at once.
BLOCK = 1 << 20

# Letters and bytes of non-ASCII characters stay, A-Z lower-cased; all else parts terms.
_TERMS = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256)
)


def terms_of(text: bytes) -> Counter:
    """How often each term stands in a UTF-8 text."""
    found: Counter = Counter()
    low = 0
    while low < len(text):
        high = low + BLOCK
        # A block ends behind a term, however long that is.
        while high < len(text) and _TERMS[text[high]] != 32:
            high += 1
        found.update(text[low:high].translate(_TERMS).split())
        low = high
    return found


def count_terms(docs: DataFrame) -> DataFrame:
    """``lang, source, term, n, docs``: occurrences and documents of each group's terms."""
    wanted = docs.select(
        *(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text"))
    )
    schema = "lang string, source string, term string, n long, docs long"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[tuple, tuple[Counter, Counter]] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for (lang, source), (n, seen) in totals.items():
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(n), pa.string()),
                        pa.array([source] * len(n), pa.string()),
                        pa.array(list(n), pa.binary()).cast(pa.string()),
                        pa.array(list(n.values()), pa.int64()),
                        pa.array([seen[t] for t in n], pa.int64()),
                    ],
                    ["lang", "source", "term", "n", "docs"],
                )
            totals.clear()

        held = 0
        for batch in batches:
            keys = zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
            for key, text in zip(keys, batch.column(2).cast(pa.binary())):
                found = terms_of(text.as_py())
                n, seen = totals.setdefault(key, (Counter(), Counter()))
                held -= len(n)
                n.update(found)
                seen.update(found.keys())
                held += len(n)
                if held >= HELD:
                    yield from rows()
                    held = 0
        yield from rows()

    parts = wanted.mapInArrow(count, schema)
    return parts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def scaled(count: Column, whole: Column) -> Column:
    """``1 + floor(SCALE * count / whole)`` for ``count <= whole``, by long division.

    Three digits at a time, no product exceeds a thousand times ``whole``.
    """
    rest = count
    digits = F.lit(0).cast("long")
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + F.call_function("div", rest, whole)
        rest = rest % whole
    return digits + 1


def difference(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


class Tree:
    """A quadtree of a tile: which quadrants hold a count, from leaves to the root.

    ``levels[0]`` tells which leaves do; each next level halves both sides, or
    the columns alone when one row of quadrants is left. ``prices`` are the
    scaled counts of the leaves that hold one; ``empty`` that of a zero by row.
    """

    def __init__(self, rows: np.ndarray, cols: np.ndarray, counts: np.ndarray, whole: np.ndarray):
        self.leaf = np.full((len(whole) // LEAF, COLUMNS // LEAF), -1, np.int64)
        at = rows // LEAF * (COLUMNS // LEAF) + cols // LEAF
        kept, where = np.unique(at, return_inverse=True)
        self.leaf.ravel()[kept] = np.arange(len(kept))
        cells = np.zeros((len(kept) + 1, LEAF, LEAF), np.int64)
        cells[where, rows % LEAF, cols % LEAF] = counts
        bands = np.append(kept // (COLUMNS // LEAF), 0)
        self.prices = scaled_cells(cells, whole.reshape(-1, LEAF)[bands][:, :, None])
        self.empty = scaled_cells(np.zeros_like(whole), whole).reshape(-1, LEAF)
        level = self.leaf >= 0
        self.levels = [level]
        while level.size > 1:
            for axis in (0, 1):
                if level.shape[axis] > 1:
                    level = np.logical_or.reduceat(level, np.arange(0, level.shape[axis], 2), axis)
            self.levels.append(level)

    def cells(self, band: np.ndarray, column: np.ndarray) -> np.ndarray:
        """The scaled counts of these leaves, empty ones included."""
        at = self.leaf[band, column]
        return np.where(at[:, None, None] >= 0, self.prices[at], self.empty[band][:, :, None])


def scaled_cells(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """``scaled`` of ``counts + 2`` in numpy."""
    rest = counts + 2
    digits = np.zeros(np.broadcast_shapes(rest.shape, whole.shape), np.int64)
    for _ in range(3):
        rest = rest * 1000
        digits = digits * 1000 + rest // whole
        rest = rest % whole
    return digits + 1


def gaps(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // (p + q)


def leaf_pairs(a: Tree, b: Tree) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Leaf rows of both trees and leaf columns where not both leaves are empty.

    The trees are walked together from their roots; a pair of empty quadrants is
    left at once, however wide it is. A tree with itself gives each pair once.
    """
    start = np.zeros(1, np.int64)
    todo = [(len(a.levels) - 1, start, start, start)]
    while todo:
        depth, ra, rb, c = todo.pop()
        live = a.levels[depth][ra, c] | b.levels[depth][rb, c]
        if a is b:
            live &= ra <= rb
        ra, rb, c = ra[live], rb[live], c[live]
        if depth == 0:
            yield ra, rb, c
            continue
        finer, here = a.levels[depth - 1].shape, a.levels[depth].shape
        for i in range(0, len(c), FRONT):
            parts = [x[i : i + FRONT] for x in (ra, rb, c)]
            for side, axis in enumerate((0, 0, 1)):
                if finer[axis] > here[axis]:
                    halves = [2 * parts[side], 2 * parts[side] + 1]
                    parts = [np.concatenate([x, x]) for x in parts]
                    parts[side] = np.concatenate(halves)
            todo.append((depth - 1, *parts))


def compare_tiles(a: Tree, b: Tree, width: int) -> np.ndarray:
    """Summed differences of all rows of ``a`` and of ``b`` beyond those of zeros.

    What ``width`` columns of zeros would cost is left out, so that empty
    quadrants add nothing. With ``a is b``, each pair stands at ``[low, high]``.
    """
    total = np.zeros((a.empty.size, b.empty.size), np.int64)
    side = np.arange(LEAF)
    for ra, rb, c in leaf_pairs(a, b):
        for i in range(0, len(c), FRONT):
            x, y, z = (v[i : i + FRONT] for v in (ra, rb, c))
            used = z[:, None] * LEAF + side < width
            found = gaps(a.cells(x, z)[:, :, None, :], b.cells(y, z)[:, None, :, :])
            found = (found * used[:, None, None, :]).sum(3)
            zeros = gaps(a.empty[x][:, :, None], b.empty[y][:, None, :])
            found -= zeros * used.sum(1)[:, None, None]
            at = (x[:, None] * LEAF + side)[:, :, None], (y[:, None] * LEAF + side)[:, None, :]
            np.add.at(total, at, found)
    return total


def _compare(key: tuple, table: pa.Table) -> pa.Table:
    """One tile pair: rows without a column are the sources' denominators."""
    strip, low, high = (key[i].as_py() for i in (1, 2, 3))
    row, col, n = (table.column(c).to_numpy() for c in ("row", "col", "n"))
    head = col < 0
    trees, real = {}, {}
    for block in {low, high}:
        here = row // ROWS == block
        whole = np.ones(ROWS, np.int64)
        whole[row[here & head] % ROWS] = n[here & head]
        real[block] = np.zeros(ROWS, bool)
        real[block][row[here & head] % ROWS] = True
        at = here & ~head
        trees[block] = Tree(row[at] % ROWS, col[at] % COLUMNS, n[at], whole)
    width = int(col.max()) - strip * COLUMNS + 1
    found = compare_tiles(trees[low], trees[high], width)
    wanted = (found != 0) & real[low][:, None] & real[high][None, :]
    if low == high:
        wanted = np.triu(wanted, 1)
    a, b = np.nonzero(wanted)
    out = [[key[0].as_py()] * len(a), a + low * ROWS, b + high * ROWS, found[a, b]]
    types = [pa.string(), pa.int64(), pa.int64(), pa.int64()]
    return pa.table([pa.array(v, t) for v, t in zip(out, types)], ["lang", "a", "b", "value"])


def _matrix(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The non-zero cells, and the sources with their row and denominators."""
    counts = stored(count_terms(docs), "term-counts")
    terms = counts.groupBy("lang", "term").agg(F.sum("n").alias("total"), F.sum("docs").alias("docs"))
    terms = terms.where(F.col("docs") >= MIN_DOCS).select("lang", "term", "total")
    columns = places(terms, "lang", [F.desc("total"), F.col("term")], "col")
    cells = stored(counts.drop("docs").join(columns, ["lang", "term"]), "cells")
    named = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")))
    sums = cells.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    kept = cells.groupBy("lang").agg((F.max("col") + 1).alias("kept"), F.sum("n").alias("lang_n"))
    sources = named.distinct().join(sums, ["lang", "source"], "left")
    sources = sources.join(small_side(kept), "lang", "left").na.fill(0)
    whole = F.greatest(F.col("n") + 2 * F.col("kept"), F.lit(1))
    lang_whole = F.greatest(F.col("lang_n") + 2 * F.col("kept"), F.lit(1))
    wide = sources.select(
        "lang", "source", "kept", whole.alias("whole"), lang_whole.alias("lang_whole")
    )
    return cells, stored(places(wide, "lang", [F.col("source")], "row"), "sources")


def _with_source(cells: DataFrame, sources: DataFrame) -> DataFrame:
    """Cells with the row and denominators of their source, which may hold most cells."""
    key = F.concat(F.char_length("lang"), F.lit(":"), "lang", "source")
    side = sources.select(key.alias("_group"), "row", "whole", "lang_whole")
    return attach(cells.withColumn("_group", key), side, "_group", "whole").drop("_group")


def divergence(docs: DataFrame) -> DataFrame:
    """``lang, source, part, item, value, rank``: how each source differs.

    ``docs`` has ``lang, source, text``; other columns are ignored, whatever
    their names. Nulls count as empty strings, so documents without a language
    or a source form groups of their own; repeated rows are counted repeatedly.
    Each language keeps the terms of at least ``MIN_DOCS`` of its documents; a
    language without such a term gives pairs of value 0. Ties are ranked by
    item. A text of any length is split in blocks. An empty table gives no rows.

    Part ``pair`` has each other source of the language, part ``term`` the first
    ``TOP_TERMS`` terms that the source uses more than its language does.
    """
    cells, sources = _matrix(docs)
    known = stored(_with_source(cells, sources), "known-cells")
    return _pairs(known, sources).unionByName(_terms(known))


def _pairs(cells: DataFrame, sources: DataFrame) -> DataFrame:
    block = F.floor(F.col("row") / ROWS)
    blocks = sources.groupBy("lang").agg((F.max(block) + 1).alias("blocks"), F.max("kept").alias("kept"))
    blocks = small_side(blocks)
    strip = F.floor(F.col("col") / COLUMNS)
    counts = cells.select("lang", "row", "col", "n", strip.alias("strip"))
    heads = sources.join(blocks.select("lang", F.col("kept").alias("width")), "lang").where("width > 0")
    last = F.floor((F.col("width") - 1) / COLUMNS)
    heads = heads.select(
        "lang", "row", F.lit(-1).cast("long").alias("col"), F.col("whole").alias("n"),
        F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("strip"),
    )
    # A row takes part with every block of rows of its language.
    every = F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))
    dealt = counts.unionByName(heads).join(blocks.select("lang", "blocks"), "lang")
    dealt = dealt.select("lang", "row", "col", "n", "strip", every.alias("other"))
    own = F.floor(F.col("row") / ROWS)
    tiles = dealt.select(
        "lang", "strip", F.least(own, "other").alias("low"), F.greatest(own, "other").alias("high"),
        "row", "col", "n",
    )
    part = tiles.groupBy("lang", "strip", "low", "high").applyInArrow(
        _compare, "lang string, a long, b long, value long"
    )
    beyond = part.groupBy("lang", "a", "b").agg(F.sum("value").alias("beyond"))

    held = sources.groupBy("lang", block.alias("block")).agg(
        F.collect_list(F.struct("row", "source", "whole", "kept")).alias("rows")
    )
    left = held.select("lang", F.col("block").alias("low"), F.col("rows").alias("x"))
    right = held.select("lang", F.col("block").alias("high"), F.col("rows").alias("y"))
    both = left.join(right, "lang").where("low <= high")
    both = both.select("lang", F.explode("x").alias("x"), "y").select("lang", "x", F.explode("y").alias("y"))
    both = both.where("x.row < y.row")
    zero = F.lit(2).cast("long")
    price = difference(scaled(zero, F.col("x.whole")), scaled(zero, F.col("y.whole")))
    base = both.select(
        "lang", F.col("x.row").alias("a"), F.col("y.row").alias("b"), F.col("x.source").alias("one"),
        F.col("y.source").alias("two"),
        F.when(F.col("x.kept") > 0, F.col("x.kept") * price).otherwise(0).alias("zeros"),
    )
    summed = base.join(beyond, ["lang", "a", "b"], "left").select(
        "lang", "one", "two", (F.col("zeros") + F.coalesce("beyond", F.lit(0))).alias("value")
    )
    ends = F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")),
                   F.struct(F.col("two").alias("source"), F.col("one").alias("item")))
    rows = summed.select("lang", F.explode(ends).alias("e"), "value").select("lang", "e.source", "e.item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return rows.withColumn("rank", F.row_number().over(order)).select(
        "lang", "source", F.lit("pair").alias("part"), "item", "value", "rank"
    )


def _terms(cells: DataFrame) -> DataFrame:
    p = scaled(F.col("n") + 2, F.col("whole"))
    q = scaled(F.col("total") + 2, F.col("lang_whole"))
    more = cells.select("lang", "source", F.col("term").alias("item"), p.alias("p"), q.alias("q")).where("p > q")
    rows = more.select("lang", "source", "item", difference(F.col("p"), F.col("q")).alias("value"))
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    best = rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= TOP_TERMS)
    return best.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
