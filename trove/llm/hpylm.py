"""A hierarchical Pitman-Yor bigram model, counted and scored on the cluster.

Every word, and the start of a text, is a context with a restaurant of its own
whose dishes are all words and the end of a text; every pair of context and dish
that occurs is one row. All restaurants send their tables as customers to one
parent over all words ever counted and one for words never seen, so no word and
no pair is cut off and the probabilities after any context add up to 1.

Seating is sampled by Gibbs sweeps: in a sweep all customers of a dish get up
together and sit down one after another, by the Chinese-restaurant rule, while
the totals and the parent stay as the sweep before left them. Late customers of
a frequent dish come in small parties that share one decision step each. A pair
that was met once always has one table, so sweeps touch the other pairs only.
Seats and the parent's probabilities are averaged over the sweeps after a burn-in.

The most frequent words are the head: what follows a head word among head words
is shipped to every task as a matrix, all other pairs are dealt out and looked up
in blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from trove.llm.words import Words, by_bytes, give_back, keyed, mixed, raw_texts, word_hash, words_of
from trove.session import Shelf

#: Words whose pairs among each other are shipped to every task.
HEAD_WORDS = 1024
#: Most frequent words whose numbers are shipped to every task, 48 bytes each;
#: words beyond them are looked up by a shuffle.
SHIPPED_WORDS = 1 << 19
BURN_IN, SAMPLES = 3, 4
STRENGTH = 1.0
PARTY = 256
#: Texts, and bytes of them, that are worked on together; a longer text is alone.
ROWS, BYTES = 1 << 10, 4 << 20
_FLUSH = 1 << 21

# The end is hashed like a word that is no valid UTF-8, which no text holds.
END_HASH = word_hash(b"\xff")


def discount(ones: int, twos: int) -> float:
    """The discount from how many counts are one and two."""
    return min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5


def reseat(
    customers: np.ndarray,
    others: np.ndarray | float,
    parent: np.ndarray | float,
    off: float,
    rng: np.random.Generator,
) -> np.ndarray:
    """Tables of each dish after its customers have sat down anew.

    ``others`` are the tables of other dishes in the restaurant and ``parent``
    is the dish's probability in the parent. The first customer opens a table.
    """
    customers = np.asarray(customers, np.int64)
    tables = np.minimum(customers, 1)
    at = np.flatnonzero(customers > 1)
    # The most customers first, so that those not yet done stand in front.
    at = at[np.argsort(-customers[at], kind="stable")]
    others, parent = (np.broadcast_to(np.asarray(x, float), customers.shape)[at] for x in (others, parent))
    c, t, sat, left = customers[at], np.ones(len(at)), 1, len(at)
    least, fixed = c[::-1], STRENGTH + off * others
    while left:
        # All that are left have the same number of customers sitting.
        some = t[:left]
        less = off * some
        new = (fixed[:left] + less) * parent[:left]
        seats = new + (sat - less)
        if sat < 2 * PARTY:
            some += rng.random(left) * seats < new
            sat += 1
        else:
            some += rng.binomial(np.minimum(sat // PARTY, c[:left] - sat), new / seats)
            sat += sat // PARTY
        left = len(c) - int(np.searchsorted(least, sat, "right"))
    tables[at] = t.astype(np.int64)
    return tables


@dataclass(frozen=True)
class Model:
    """What is needed to score; what every task gets is fixed in size, whatever the corpus.

    ``words`` are sorted hashes with ``base`` log10 probabilities, their ``dish``
    (head number, or the class of all others), ``tail``, the parent's log10
    probability within the class (0 for head words and the end), and, as
    contexts, their ``count`` and ``spare``, the share that goes to the parent.
    ``after`` is log10 of each dish after each head context; its last row is the
    parent. The table beside the model has the words beyond, ``base_unseen`` and
    ``tail_unseen`` are for words never counted. ``pairs`` has every pair ``u``,
    ``w`` with ``net``, its customers less its discounts, ``blocks`` the same dealt
    out to ``parts`` as ``pair_blocks`` does; tasks do not get them.
    """

    head: int
    tokens: int
    distinct: int
    words: np.ndarray
    base: np.ndarray
    tail: np.ndarray
    dish: np.ndarray
    count: np.ndarray
    spare: np.ndarray
    after: np.ndarray
    base_unseen: float
    tail_unseen: float
    once: float
    parts: int
    pairs: DataFrame | None
    blocks: DataFrame | None


class Places:
    """Finds words among sorted hashes, from where their first 20 bits begin."""

    def __init__(self, words: np.ndarray):
        self.n = len(words)
        self.words = np.append(words, np.iinfo(np.int64).max)
        self.first = np.searchsorted(self._top(words), np.arange(1 << 20)).astype(np.int32)

    @staticmethod
    def _top(hashes: np.ndarray) -> np.ndarray:
        return ((hashes.view(np.uint64) ^ np.uint64(1 << 63)) >> np.uint64(44)).astype(np.int64)

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The places of ``hashes``, and which are there; 0 for the others."""
        at = self.first[self._top(hashes)]
        behind = np.flatnonzero(self.words[at] < hashes)
        while len(behind):
            at[behind] += 1
            behind = behind[self.words[at[behind]] < hashes[behind]]
        known = (self.words[at] == hashes) & (at < self.n)
        at[~known] = 0
        return at, known


def some_texts(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, int, Words]]:
    """Ranges of neighbouring texts, with their words; few texts are copied at a time."""
    for low in range(0, batch.num_rows, ROWS):
        texts = raw_texts(batch.slice(low, ROWS), column)
        for start, stop in by_bytes(texts, BYTES):
            yield low + start, low + stop, words_of(texts[start:stop])
        give_back()


def grouped(*keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct rows of ``keys`` and how often each occurs."""
    order = np.lexsort(keys[::-1])
    keys = [k[order] for k in keys]
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    first = np.flatnonzero(new)
    return [k[first] for k in keys], np.diff(np.append(first, len(order)))


def _struct(**kinds: str) -> T.StructType:
    found = {"int": T.IntegerType, "long": T.LongType, "double": T.DoubleType, "boolean": T.BooleanType, "binary": T.BinaryType}
    return T.StructType([T.StructField(name, found[kind]()) for name, kind in kinds.items()])


WORDS = _struct(b="int", h="binary", c="binary")


def word_counts(texts: DataFrame, parts: int) -> DataFrame:
    """``h`` and ``c`` of every word and of the end."""
    last = len(texts.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, have = [], 0

        def counted() -> pa.RecordBatch:
            (h,), times = runs(np.sort(np.concatenate(held)))
            held.clear()
            give_back()
            return batch_of(WORDS, **dict(zip(("b", "h", "c"), dealt(part_of(h, parts), h, times), strict=True)))

        for batch in batches:
            for start, stop, words in some_texts(batch, last):
                held += [words.hashes.view(np.int64), np.full(stop - start, END_HASH, np.int64)]
                have += len(held[-1]) + len(held[-2])
                if have > _FLUSH:
                    yield counted()
                    have = 0
        if held:
            yield counted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [(ints(h), ints(c)) for batch in batches for _, h, c in zip(*batch.columns, strict=True)]
        if held:
            (h,), c = summed(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(c)], ["h", "c"])
            held.clear()
            give_back()

    return texts.mapInArrow(count, WORDS).repartitionById(parts, "b").mapInArrow(merge, "h long, c long")


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    """The part that each key is dealt to."""
    part = (mixed(keys.view(np.uint64)) >> np.uint64(33)) % np.uint64(parts)
    return part.astype(np.uint16 if parts < 1 << 16 else np.int64)


def far_part(u: np.ndarray, w: np.ndarray, parts: int) -> np.ndarray:
    return part_of(mixed(u.view(np.uint64)) + w.view(np.uint64), parts)


def dealt(part: np.ndarray, *columns: np.ndarray) -> list[pa.Array]:
    """The parts that have rows, and each column's values of a part as bytes."""
    order = np.argsort(part, kind="stable")
    part = part[order]
    first = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.empty(0, np.int64)
    ends = np.append(first, len(part))[1:]
    out = [pa.array(part[first].astype(np.int32))]
    for column in columns:
        column = column[order]
        out.append(pa.array([column[i:j].tobytes() for i, j in zip(first, ends, strict=True)], pa.binary()))
    return out


def batch_of(schema: T.StructType, **columns) -> pa.RecordBatch:
    """A batch with these columns; the others are null."""
    kinds = to_arrow_schema(schema)
    rows = len(next(iter(columns.values())))
    arrays = [columns[x.name] if x.name in columns else pa.nulls(rows, x.type) for x in kinds]
    arrays = [c if c.type == x.type else c.cast(x.type) for c, x in zip(arrays, kinds, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, kinds.names)


def ints(blob: pa.Scalar, kind: str = "<i8") -> np.ndarray:
    return np.frombuffer(blob.as_buffer(), kind)


DEALT = _struct(b="int", k="binary", us="binary", ws="binary", n="binary")
PAIRS = _struct(b="int", k="binary", n="binary", us="binary", ws="binary", one="long", two="long", u="long", w="long", c="long")


def pair_blocks(texts: DataFrame, shipped: Broadcast, parts: int) -> DataFrame:
    """Every pair of neighbours, starts and ends included, with its count, in ``parts`` parts.

    Pairs of two ``shipped`` words are blocks: a row has sorted keys ``k``, the words'
    places in 32 bits each, their counts ``n`` and how many are one and two. Of
    the others, those met once are blocks ``us`` and ``ws``, the rest rows ``u``,
    ``w``, ``c``.
    """
    last = len(texts.columns) - 1

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shipped.value)
        end = np.array([END_HASH])
        end_at = np.where(places.find(end)[1], places.find(end)[0], -1)[0]
        held, have = [], 0

        def counted() -> Iterator[pa.RecordBatch]:
            keys, u, w = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            keys.sort()
            (keys,), n = runs(keys)
            b, k, n = dealt(part_of(keys, parts), keys, n.astype(np.uint32))
            yield batch_of(DEALT, b=b, k=k, n=n)
            del keys, b, k, n
            (u, w), n = grouped(u, w)
            b, u, w, n = dealt(far_part(u, w, parts), u, w, n.astype(np.uint32))
            yield batch_of(DEALT, b=b, us=u, ws=w, n=n)
            del b, u, w, n
            give_back()

        for batch in batches:
            for _, _, words in some_texts(batch, last):
                dishes, starts = with_ends(words.hashes.view(np.int64), words.bounds, END_HASH)
                at, known = places.find(dishes)
                at[~known] = -1
                before = contexts_of(at, starts, end_at)
                near = (at >= 0) & (before >= 0)
                far = ~near
                held.append((before[near].astype(np.int64) << 32 | at[near], contexts_of(dishes, starts, END_HASH)[far], dishes[far]))
                have += len(dishes)
                if have > _FLUSH:
                    yield from counted()
                    have = 0
        if held:
            yield from counted()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        near, far = [], []
        for batch in batches:
            for _, k, u, w, n in zip(*batch.columns, strict=True):
                if k.is_valid:
                    near.append((ints(k), ints(n, "<u4")))
                else:
                    far.append((ints(u), ints(w), ints(n, "<u4")))
        if near:
            (keys,), n = summed(*(np.concatenate(x) for x in zip(*near, strict=True)))
            part = part_of(keys, parts)
            b, k, c = dealt(part, keys, n)
            one, two = (np.bincount(part, n == x, parts)[b.to_numpy()].astype(np.int64) for x in (1, 2))
            yield batch_of(PAIRS, b=b, k=k, n=c, one=pa.array(one), two=pa.array(two))
            near.clear()
            del keys, n, part, b, k, c
            give_back()
        if far:
            u, w, c = (np.concatenate(x) for x in zip(*far, strict=True))
            order = np.lexsort((w, u))
            u, w, c = u[order], w[order], c[order]
            first = np.flatnonzero(np.append(True, (u[1:] != u[:-1]) | (w[1:] != w[:-1])))
            c = np.add.reduceat(c, first, dtype=np.int64)
            u, w, part = u[first], w[first], far_part(u[first], w[first], parts)
            once = c == 1
            b, us, ws = dealt(part[once], u[once], w[once])
            one = np.bincount(part[once], minlength=parts)[b.to_numpy()]
            yield batch_of(PAIRS, b=b, us=us, ws=ws, one=pa.array(one))
            made = {"b": part, "u": u, "w": w, "c": c}
            yield batch_of(PAIRS, **{x: pa.array(v[~once]) for x, v in made.items()})
            far.clear()
            del u, w, c, order, first, part, once, b, us, ws, made
            give_back()

    made = texts.mapInArrow(count, DEALT)
    return made.repartitionById(parts, "b").mapInArrow(merge, PAIRS)


def runs(keys: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The distinct values of sorted ``keys`` and how often each occurs."""
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1])) if len(keys) else np.empty(0, np.int64)
    return [keys[first]], np.diff(np.append(first, len(keys)))


def summed(keys: np.ndarray, values: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """The sorted distinct ``keys``, of which there are some, and the sum of their values."""
    order = np.argsort(keys)
    keys, values = keys[order], values[order]
    first = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return [keys[first]], np.add.reduceat(values, first, dtype=np.int64)


def looked_up(u: np.ndarray, w: np.ndarray, of: np.ndarray, to: np.ndarray, net: np.ndarray) -> np.ndarray:
    """``net`` of the pairs ``of``, ``to`` for each ``u``, ``w``, or 0; no pair is there twice."""
    order = np.lexsort((np.arange(len(of) + len(u)), np.concatenate([to, w]), np.concatenate([of, u])))
    us, ws = np.concatenate([of, u])[order], np.concatenate([to, w])[order]
    values = np.concatenate([net, np.zeros(len(u))])[order]
    new = np.append(True, (us[1:] != us[:-1]) | (ws[1:] != ws[:-1])) if len(us) else np.empty(0, bool)
    out = np.empty(len(us))
    # The pair itself, if there, is the first of its run.
    out[order] = values[np.flatnonzero(new)][np.cumsum(new) - 1] if len(us) else 0
    return out[len(of) :]


#: Words whose sums are added up by one task.
SLICE = 1 << 15


def added(table: DataFrame, shipped: Broadcast) -> tuple[np.ndarray, np.ndarray]:
    """For each ``shipped`` word, the sums over pairs with it as context and as dish.

    ``table`` has key blocks and their values, then ``u``, ``w`` and value of other pairs.
    """
    size = len(shipped.value)

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places = Places(shipped.value)
        sides = np.zeros((2, size))
        for batch in batches:
            k, x, u, w, y = batch.columns
            for keys, values in zip(k, x, strict=True):
                if keys.is_valid:
                    keys, values = ints(keys), ints(values)
                    sides[0] += np.bincount(keys >> 32, values, size)
                    sides[1] += np.bincount(keys & 0xFFFFFFFF, values, size)
            some = k.is_null()
            values = y.filter(some).to_numpy()
            for side, column in zip(sides, (u, w), strict=True):
                at, known = places.find(column.filter(some).to_numpy())
                np.add.at(side, at[known], values[known])
        give_back()
        sums = sides.astype(np.int64)
        for low in range(0, size, SLICE):
            a, b = (x[low : low + SLICE] for x in sums)
            if a.any() or b.any():
                yield pa.RecordBatch.from_pydict({"s": pa.array([low // SLICE], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {}
        for batch in batches:
            for s, *blobs in zip(*batch.columns, strict=True):
                found = np.array([ints(x) for x in blobs])
                s = s.as_py()
                sums[s] = sums[s] + found if s in sums else found
        for s, (a, b) in sums.items():
            yield pa.RecordBatch.from_pydict({"s": pa.array([s], pa.int32()), "a": [a.tobytes()], "b": [b.tobytes()]})

    kind = "s int, a binary, b binary"
    made = table.mapInArrow(tally, kind).repartitionById(-(-size // SLICE) or 1, "s").mapInArrow(add, kind).toArrow()
    out = np.zeros((2, size), np.int64)
    for s, *blobs in zip(*made.columns, strict=True):
        low = s.as_py() * SLICE
        for side, blob in zip(out, blobs, strict=True):
            side[low : low + SLICE] = ints(blob)
    return out[0], out[1]


def with_ends(dishes: np.ndarray, bounds: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """Dishes with an end after each text, and where each text starts in them."""
    texts = len(bounds) - 1
    out = np.full(len(dishes) + texts, end, np.int64)
    starts = bounds[:-1] + np.arange(texts)
    is_word = np.ones(len(out), bool)
    is_word[bounds[1:] + np.arange(texts)] = False
    out[is_word] = dishes
    return out, starts


def contexts_of(dishes: np.ndarray, starts: np.ndarray, end: int) -> np.ndarray:
    """What stands before each dish; a text starts in the context of an end."""
    before = np.empty_like(dishes)
    before[1:] = dishes[:-1]
    before[starts] = end
    return before


def _seed(sweep: int, numbers: np.ndarray) -> np.random.Generator:
    """Randomness that a repeated task meets again: by sweep and rows."""
    return np.random.default_rng([sweep, xxhash.xxh3_64_intdigest(numbers.tobytes())])


SEATS = _struct(b="int", k="binary", c="binary", t="binary", sum="binary", u="long", w="long", far_c="long", far_t="long", far_sum="long")


STILL = T.StructType([*_struct(h="long", c="long"), T.StructField("most", T.ArrayType(T.LongType()))])


def sample(
    pairs: DataFrame, rare: DataFrame, shipped: Broadcast, count: np.ndarray, distinct: int, shelf: Shelf
) -> tuple[float, DataFrame, np.ndarray, np.ndarray, DataFrame, float]:
    """Seats all customers of ``pair_blocks``; ``count`` are those of the shipped words.

    Returns the discount; the pairs met more than once, with ``sum``, their
    tables of all samples; ``spare`` and the parent's probability of the shipped
    words; ``rare``, the other words (``h``, ``c``), with ``spare`` and ``root``;
    and that of an unseen word. A sweep adds up tables by word and seats them in
    the parent; the shipped words' sums, of a size that is fixed, go to the
    driver and back, those of other words are joined to the pairs that have them.
    """
    one, two, far_two = pairs.agg(F.sum("one"), F.sum("two"), F.count_if(F.col("c") == 2)).first()
    off = discount(one or 0, (two or 0) + far_two)
    share, zero = 1 / (distinct + 1), F.lit(0).cast("long")
    total, unseen, sampled = distinct, [], []
    owns, roots = np.zeros(len(count)), np.zeros(len(count))
    context = pairs.sparkSession.sparkContext

    def begin(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """One table for each pair met more than once."""
        for batch in batches:
            for b, k, n, u, w, c in zip(*batch.columns, strict=True):
                keys, n = ints(k), ints(n)
                keys, n = keys[n > 1], n[n > 1]
                made = {"k": keys, "c": n, "t": np.ones_like(n), "sum": np.zeros_like(n)}
                made = {x: pa.array([v.tobytes()], pa.binary()) for x, v in made.items()}
                yield batch_of(SEATS, b=pa.array([b.as_py()]), **made)
            give_back()

    near = pairs.where("k IS NOT NULL").select("b", "k", "n", "u", "w", "c").mapInArrow(begin, SEATS)
    far = pairs.where("c > 1").select("b", "u", "w", F.col("c").alias("far_c"), F.lit(1).cast("long").alias("far_t"), zero.alias("far_sum"))
    state = shelf.put(near.unionByName(far, allowMissingColumns=True), "seats")
    # Every customer is in one pair as context and one as dish: what is not in these pairs was met once.
    ones = [count - x for x in added(state.select("k", "c", "u", "w", "far_c"), shipped)]

    def tally(state: DataFrame, rare: DataFrame, sweep: int) -> tuple[np.ndarray, np.ndarray, DataFrame]:
        """Tables in each context (``own``) and the parent's ``root``, added up from the burn-in on."""
        nonlocal total
        tables = added(state.select("k", "t", "u", "w", "far_t"), shipped)
        own, served = (x + y for x, y in zip(ones, tables, strict=True))
        sides = F.array(
            F.struct(F.col("u").alias("h"), F.col("far_t").alias("tu"), zero.alias("tw")),
            F.struct(F.col("w").alias("h"), zero.alias("tu"), F.col("far_t").alias("tw")),
        )
        seats = state.where("k IS NULL").select(F.inline(sides)).groupBy("h").agg(F.sum("tu").alias("tu"), F.sum("tw").alias("tw"))
        far_own, far_served = F.expr("ones_u + coalesce(tu, 0L)"), F.expr("ones_w + coalesce(tw, 0L)")
        kept = ["h", "c", "ones_u", "ones_w", "owns", "roots"]
        found = rare.join(seats, "h", "left").select(*kept, far_own.alias("own"), far_served.alias("served"))
        found = shelf.put(found.sortWithinPartitions("h"), "served")
        sizes = F.coalesce(F.sum("served"), zero), F.count_if(F.col("served") == 1), F.count_if(F.col("served") == 2)
        shipped_sizes = served.sum(), (served == 1).sum(), (served == 2).sum()
        customers, one, two = (sum(map(int, x)) for x in zip(found.agg(*sizes).first(), shipped_sizes, still_sizes, strict=True))
        below, others = discount(one, two), max(total - 1, 0)

        def sit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, c = batch.column(0).to_numpy(), batch.column(7).to_numpy()
                t = reseat(c, others, share, below, _seed(sweep + 1, h))
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(t)], [*batch.schema.names, "most"])

        schema = T.StructType([*found.schema.fields, T.StructField("most", T.LongType())])
        most = shelf.put(found.mapInArrow(sit, schema), "parent")
        # What the sweep before left is not read again.
        for label, n in (("served", 0), ("parent", 1), ("seats", 1)):
            shelf.keep_last(label, n)
        shipped_most = reseat(served, others, share, below, _seed(sweep + 1, shipped.value))
        still_most = still.where("c > 1").mapInArrow(seat_still([(sweep, others, below)]), STILL)
        still_most = still_most.agg(F.coalesce(F.sum(F.col("most")[0]), zero)).first()[0] + still_sizes[1]
        total = most.agg(F.coalesce(F.sum("most"), zero)).first()[0] + int(shipped_most.sum()) + still_most
        spare = (STRENGTH + below * total) / (STRENGTH + customers) * share
        root = (F.col("served") - below * F.col("most")) / (STRENGTH + customers) + spare
        shipped_root = (served - below * shipped_most) / (STRENGTH + customers) + spare
        add = int(sweep >= BURN_IN)
        if add:
            unseen.append(spare)
            sampled.append((sweep, others, below, customers))
            owns[:] += own
            roots[:] += shipped_root
        rare = most.select(
            *kept[:4], (F.col("owns") + F.col("own") * add).alias("owns"), (F.col("roots") + root * add).alias("roots"), "own", root.alias("root")
        )
        return own, shipped_root, rare

    def sit(state: DataFrame, own: np.ndarray, root: np.ndarray, rare: DataFrame, sweep: int) -> DataFrame:
        sums = context.broadcast((own, root))
        add = int(sweep >= BURN_IN)

        def seat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, root = sums.value
            for batch in batches:
                for b, k, *rest in zip(*batch.columns, strict=True):
                    keys, (c, t, done) = ints(k), map(ints, rest)
                    t = reseat(c, own[keys >> 32] - t, root[keys & 0xFFFFFFFF], off, _seed(sweep, keys))
                    made = {"k": keys, "c": c, "t": t, "sum": done + t * add}
                    made = {x: pa.array([v.tobytes()], pa.binary()) for x, v in made.items()}
                    yield batch_of(SEATS, b=pa.array([b.as_py()]), **made)
                give_back()

        def seat_far(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own, root = sums.value
            places = Places(shipped.value)
            for batch in batches:
                b, u, w, c, t, done, far_own, far_root = (x.to_numpy(zero_copy_only=False) for x in batch.columns)
                (i, left), (j, right) = places.find(u), places.find(w)
                # A word is either shipped or in the table of rare words.
                far_own, far_root = far_own.astype(float), far_root.astype(float)
                far_own[left], far_root[right] = own[i[left]], root[j[right]]
                t = reseat(c, far_own - t, far_root, off, _seed(sweep, u ^ w))
                made = {"u": u, "w": w, "far_c": c, "far_t": t, "far_sum": done + t * add}
                yield batch_of(SEATS, b=batch.column(0), **{x: pa.array(v) for x, v in made.items()})
            give_back()

        near = state.where("k IS NOT NULL").select("b", "k", "c", "t", "sum").mapInArrow(seat, SEATS)
        contexts = rare.select(F.col("h").alias("u"), "own")
        dishes = rare.select(F.col("h").alias("w"), "root")
        far = state.where("k IS NULL").join(contexts, "u", "left").join(dishes, "w", "left")
        far = far.select("b", "u", "w", "far_c", "far_t", "far_sum", "own", "root")
        far = far.sortWithinPartitions("u", "w").mapInArrow(seat_far, SEATS)
        made = shelf.put(near.union(far), "seats")
        sums.destroy()
        return made

    def seat_still(sweeps: list[tuple]) -> Callable:
        """A task that seats the words of ``still`` as these sweeps do."""

        def sit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                h, c = (x.to_numpy() for x in batch.columns)
                made = [reseat(c, others, share, below, _seed(sweep + 1, h)) for sweep, others, below, *_ in sweeps]
                most = pa.ListArray.from_arrays(np.arange(len(h) + 1, dtype=np.int32) * len(made), np.array(made).T.ravel())
                yield pa.RecordBatch.from_arrays([*batch.columns, most], STILL.names)

        return sit

    sides = F.array(
        F.struct(F.col("u").alias("h"), F.col("far_c").alias("tu"), zero.alias("tw")),
        F.struct(F.col("w").alias("h"), zero.alias("tu"), F.col("far_c").alias("tw")),
    )
    met = state.where("k IS NULL").select(F.inline(sides)).groupBy("h").agg(F.sum("tu").alias("tu"), F.sum("tw").alias("tw"))
    # Words in no pair that was met again send each customer to the parent, whatever the sweep.
    all_rare = rare.join(met, "h", "left").sortWithinPartitions("h")
    all_rare = shelf.put(all_rare, "rare")
    still = all_rare.where("tu IS NULL").select("h", "c")
    sizes = F.coalesce(F.sum("c"), zero), F.count_if(F.col("c") == 1), F.count_if(F.col("c") == 2)
    still_sizes = still.agg(*sizes).first()
    once = all_rare.where("tu IS NOT NULL").select("h", "c", F.expr("c - tu").alias("ones_u"), F.expr("c - tw").alias("ones_w"))
    own, root, rare = tally(state, once.withColumns({"owns": zero, "roots": F.lit(0.0)}), -1)
    for sweep in range(BURN_IN + SAMPLES):
        state = sit(state, own, root, rare, sweep)
        own, root, rare = tally(state, rare, sweep)
    spare = (STRENGTH + off * F.col("owns") / SAMPLES) / (STRENGTH + F.col("c"))
    shipped_spare = (STRENGTH + off * owns / SAMPLES) / (STRENGTH + count)
    rare = rare.select("h", "c", spare.alias("spare"), (F.col("roots") / SAMPLES).alias("root"))
    most = still.where("c > 1").mapInArrow(seat_still(sampled), STILL)
    most = most.union(still.where("c <= 1").select("h", "c", F.array_repeat("c", SAMPLES)))
    root = sum(
        ((F.col("c") - below * F.col("most")[i]) / (STRENGTH + customers) + unseen[i])
        for i, (_, _, below, customers) in enumerate(sampled)
    )
    spare = (STRENGTH + off * F.col("c")) / (STRENGTH + F.col("c"))
    rare = shelf.put(rare.union(most.select("h", "c", spare, root / SAMPLES)), "parent")
    for label, n in (("rare", 0), ("parent", 1)):
        shelf.keep_last(label, n)
    return off, state, shipped_spare, roots / SAMPLES, rare, sum(unseen) / SAMPLES


NETS = _struct(b="int", k="binary", x="binary", us="binary", ws="binary", u="long", w="long", net="double")


def net_blocks(pairs: DataFrame, state: DataFrame, off: float) -> DataFrame:
    """Blocks of keys ``k`` with ``net`` in ``x`` and, of other pairs, blocks and rows.

    Pairs met once come without ``x``, as all their nets are the same.
    """

    def once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, n in zip(*batch.columns, strict=True):
                keys = ints(k)[ints(n) == 1]
                yield batch_of(NETS, b=pa.array([b.as_py()]), k=pa.array([keys.tobytes()], pa.binary()))

    def more(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for b, k, c, tables in zip(*batch.columns, strict=True):
                net = ints(c) - off * ints(tables) / SAMPLES
                made = {"k": pa.array([k.as_py()], pa.binary()), "x": pa.array([net.tobytes()], pa.binary())}
                yield batch_of(NETS, b=pa.array([b.as_py()]), **made)

    far_net = (F.col("far_c") - off * F.col("far_sum") / SAMPLES).alias("net")
    far = state.where("k IS NULL").select("b", "u", "w", far_net)
    far = far.unionByName(pairs.where("us IS NOT NULL").select("b", "us", "ws"), allowMissingColumns=True)
    near = pairs.where("k IS NOT NULL").select("b", "k", "n").mapInArrow(once, NETS)
    near = near.union(state.where("k IS NOT NULL").select("b", "k", "c", "sum").mapInArrow(more, NETS))
    return near.unionByName(far, allowMissingColumns=True)


def fit(
    docs: DataFrame,
    text_col: str = "text",
    head_words: int = HEAD_WORDS,
    shipped_words: int = SHIPPED_WORDS,
) -> tuple[Model, DataFrame]:
    """The model of all ``docs``, and the table of words that are not shipped."""
    spark = docs.sparkSession
    shelf, texts = Shelf(spark), keyed(docs, text_col)
    # Sorted, so that seats drawn from the rows of a batch are the same in any run.
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    counts = shelf.put(word_counts(texts, parts), "words")
    tokens, distinct = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()

    # The lowest count level from which on no more words than may be shipped lie.
    level = F.floor(64 * F.log2("c")).cast("int")
    levels = sorted(map(tuple, counts.groupBy(level.alias("l")).count().collect()), reverse=True)
    least, room = 1 << 30, shipped_words
    for at, n in levels:
        if n > room:
            break
        least, room = at, room - n
    rows = counts.where((level >= least) | (F.col("h") == END_HASH)).toArrow().sort_by("h")
    h, c = (rows[x].to_numpy() for x in ("h", "c"))
    shipped = spark.sparkContext.broadcast(h)
    pairs = shelf.put(pair_blocks(texts, shipped, parts), "pairs")
    rare = counts.where((level < least) & (F.col("h") != END_HASH))
    off, state, spare, root, rare, unseen = sample(pairs, rare, shipped, c, distinct, shelf)
    shelf.keep_last("words", 0)
    norm = tokens + 0.1 * (distinct + 1)

    order = np.lexsort((h, -c))
    head = h[order[h[order] != END_HASH][:head_words]]
    size = len(head) + 2
    numbers = dict(zip(head.tolist(), range(len(head)), strict=True)) | {END_HASH: len(head)}
    dish = np.array([numbers.get(x, size - 1) for x in h.tolist()], np.int64)
    rest = rare.agg(F.coalesce(F.sum("root"), F.lit(0.0))).first()[0] + root[dish == size - 1].sum() + unseen
    blocks, dishes = net_blocks(pairs, state, off), spark.sparkContext.broadcast(dish)

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The head's own pairs."""
        dish = dishes.value
        for batch in batches:
            for keys, x in zip(*batch.columns, strict=True):
                keys = ints(keys)
                net = ints(x, "<f8") if x.is_valid else np.full(len(keys), 1.0 - off)
                i, j = dish[keys >> 32], dish[keys & 0xFFFFFFFF]
                own = (i < size - 1) & (j < size - 1)
                yield pa.RecordBatch.from_arrays([pa.array(y[own]) for y in (i, j, net)], ["i", "j", "net"])

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = shipped.value
        for batch in batches:
            for keys, x, us, ws in zip(*batch.columns, strict=True):
                u, w = (words[ints(keys) >> 32], words[ints(keys) & 0xFFFFFFFF]) if keys.is_valid else (ints(us), ints(ws))
                net = ints(x, "<f8") if x.is_valid else np.full(len(u), 1.0 - off)
                yield pa.RecordBatch.from_arrays([*map(pa.array, (u, w, net))], ["u", "w", "net"])

    near = blocks.where("k IS NOT NULL").select("k", "x")
    among = near.mapInArrow(heads, "i long, j long, net double").toArrow()
    own = np.flatnonzero(dish < size - 1)
    # The head's own pairs as a matrix; the class takes what is left of each context.
    parent, share, customers = np.full(size, unseen), np.ones(size), np.zeros(size)
    parent[size - 1] = rest
    parent[dish[own]], share[dish[own]], customers[dish[own]] = root[own], spare[own], c[own]
    net = np.zeros((size, size))
    net[among["i"].to_numpy(), among["j"].to_numpy()] = among["net"].to_numpy()
    seated = (1 - share) * (STRENGTH + customers)
    net[:, size - 1] = np.maximum(seated - net.sum(axis=1), 0)
    after = np.outer(share, parent) + net / (STRENGTH + customers)[:, None]
    model = Model(
        len(head),
        tokens,
        distinct,
        h,
        np.log10((c + 0.1) / norm),
        np.where(dish < size - 1, 0, np.log10(root / rest)),
        dish,
        c,
        spare,
        np.log10(after),
        float(np.log10(0.1 / norm)),
        float(np.log10(unseen / rest)),
        1.0 - off,
        parts,
        blocks.where("u IS NULL")
        .select("k", "x", "us", "ws")
        .mapInArrow(rows_of, "u long, w long, net double")
        .union(blocks.where("u IS NOT NULL").select("u", "w", "net")),
        blocks,
    )
    base, lp = F.log10((F.col("c") + 0.1) / norm).alias("base"), F.log10(F.col("root") / rest).alias("lp")
    return model, rare.select("h", "c", base, "spare", lp)


def sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """The sum over each text's words."""
    kind = float if values.dtype == float else np.int64
    out = np.zeros(len(bounds) - 1, kind)
    some = np.flatnonzero(np.diff(bounds))
    if len(some):
        out[some] = np.add.reduceat(values.astype(kind), bounds[:-1][some])
    return out


def score(
    docs: DataFrame,
    model: Model,
    table: DataFrame,
    *extra,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every row.

    Tokens are the words, A-Z lower-cased, and one end; a null or empty text is
    the end alone. Scores are log10 probabilities. Repeated rows are each
    scored, ids and the columns ``extra`` stay as they are (null too), other
    columns are not read, and an empty table gives no rows. A model fitted to
    nothing gives every token a probability of its own without failing.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(replace(model, pairs=None, blocks=None))
    ids = (F.col(id_col), *extra)
    found = docs.select(*ids).schema
    width = len(ids)
    names = ["n_tokens", "n_known", "base_score", "score", "_row"]
    schema = T.StructType([T.StructField(f"_id{i}", x.dataType) for i, x in enumerate(found)])
    schema = T.StructType([*schema, *_struct(n_tokens="long", n_known="long", base_score="double", score="double", _row="long")])
    # Blocks of pairs: their keys, the places of their texts from ``_row`` on, and how often.
    asks = T.StructType([*schema, *_struct(b="int", k="binary", us="binary", ws="binary", i="binary", n="binary")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Each text with what the matrix gives, and the pairs that it lacks."""
        model = shipped.value
        size, places = model.head + 2, Places(model.words)
        row = TaskContext.get().partitionId() << 33
        end, ended = (int(x[0]) for x in places.find(np.array([END_HASH])))
        end_base = model.base[end] if ended else model.base_unseen
        for batch in batches:
            for start, stop, words in some_texts(batch, width):
                found, bounds = words.hashes.view(np.int64), words.bounds
                at, known = places.find(found)
                base = np.zeros(len(found))
                base[known] = model.base[at[known]]
                rest = sums(~known, bounds)
                at[~known] = -1
                at, starts = with_ends(at, bounds, end if ended else -1)
                dishes = np.where(at < 0, size - 1, model.dish[at] if len(model.dish) else 0)
                dishes[bounds[1:] + np.arange(len(starts))] = size - 2
                before = contexts_of(dishes, starts, size - 2)
                inner = (before < size - 1) & (dishes < size - 1)
                after = np.zeros(len(dishes))
                after[inner] = model.after[before[inner], dishes[inner]]
                done = {
                    **{f"_id{i}": c.slice(start, stop - start) for i, c in enumerate(batch.columns[:width])},
                    "n_tokens": pa.array(np.diff(bounds) + 1),
                    "n_known": pa.array(np.diff(bounds) - rest + int(ended)),
                    "base_score": pa.array(sums(base, bounds) + end_base),
                    "score": pa.array(np.add.reduceat(after, starts)),
                    "_row": pa.array(np.arange(row, row + stop - start)),
                    # Dealt out like the pairs, only to spread them.
                    "b": pa.array(np.arange(row, row + stop - start) % model.parts),
                }
                yield batch_of(asks, **done)
                small = np.uint16 if stop - start <= 1 << 16 else np.uint32
                owner = np.repeat(np.arange(stop - start, dtype=small), np.diff(np.append(starts, len(dishes))))
                before = contexts_of(at, starts, end if ended else -1)
                near = ~inner & (at >= 0) & (before >= 0)
                far = ~inner & ~near
                keys, i = before[near].astype(np.int64) << 32 | at[near], owner[near]
                order = np.argsort(keys, kind="stable")
                keys, i = keys[order], i[order]
                first = np.flatnonzero(np.append(True, (keys[1:] != keys[:-1]) | (i[1:] != i[:-1]))) if len(keys) else keys
                n = np.diff(np.append(first, len(keys))).astype(np.uint32)
                keys = keys[first]
                b, k, i, n = dealt(part_of(keys, model.parts), keys, i[first], n)
                yield batch_of(asks, b=b, k=k, i=i, n=n, _row=pa.array(np.full(len(b), row)))
                dishes, _ = with_ends(found, bounds, END_HASH)
                (i, u, w), n = grouped(owner[far], contexts_of(dishes, starts, END_HASH)[far], dishes[far])
                b, u, w, i, n = dealt(far_part(u, w, model.parts), u, w, i, n.astype(np.uint32))
                yield batch_of(asks, b=b, us=u, ws=w, i=i, n=n, _row=pa.array(np.full(len(b), row)))
                row += stop - start

    kind = _struct(n="long", u="long", w="long", net="double", left="boolean", right="boolean", count="double", spare="double", root="double", l="double")
    kind = T.StructType([*schema, *kind])

    def places_of(blob: pa.Scalar, n: np.ndarray) -> np.ndarray:
        return ints(blob, f"<u{len(blob.as_buffer()) // len(n)}").astype(np.int64)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums of scores where both words are shipped; the other pairs with what is known."""
        model = shipped.value
        near, far, asked, asked_far = [], [], [], []
        for batch in batches:
            columns = dict(zip(batch.schema.names, batch.columns, strict=True))
            texts = columns["n_tokens"].is_valid()
            yield batch_of(kind, **{x: columns[x].filter(texts) for x in schema.names})
            lone = columns["net"].is_valid()
            far.append([columns[x].filter(lone).to_numpy() for x in ("u", "w", "net")])
            for k, x, u, w, i, n, row in zip(*(columns[x] for x in ("k", "x", "us", "ws", "i", "n", "_row")), strict=True):
                if i.is_valid and k.is_valid:
                    asked.append((row.as_py(), ints(k), i, ints(n, "<u4")))
                elif i.is_valid:
                    n = ints(n, "<u4")
                    asked_far.append((row.as_py() + places_of(i, n), ints(u), ints(w), n))
                elif k.is_valid:
                    near.append((ints(k), ints(x, "<f8") if x.is_valid else np.full(len(ints(k)), model.once)))
                elif u.is_valid:
                    far.append([ints(u), ints(w), np.full(len(ints(u)), model.once)])
        keys, net = (np.concatenate(x) for x in zip(*near, strict=True)) if near else (np.empty(0, np.int64), np.empty(0))
        order = np.argsort(keys)
        keys, net = np.append(keys[order], -1), np.append(net[order], 0.0)
        root = 10 ** (model.after[-1, model.dish] + model.tail)
        for row, k, i, n in asked:
            i = places_of(i, n)
            at = np.searchsorted(keys[:-1], k)
            u, w = k >> 32, k & 0xFFFFFFFF
            p = np.where(keys[at] == k, net[at], 0.0) / (STRENGTH + model.count[u]) + model.spare[u] * root[w]
            l = np.bincount(i, np.log10(p) * n)
            some = np.flatnonzero(l)
            yield batch_of(kind, _row=pa.array(row + some), l=pa.array(l[some]))
        near.clear(), asked.clear()
        give_back()
        if not asked_far:
            return
        row, u, w, n = (np.concatenate(x) for x in zip(*asked_far, strict=True))
        net = looked_up(u, w, *(np.concatenate(x) for x in zip(*far, strict=True)))
        places = Places(model.words)
        (i, left), (j, right) = places.find(u), places.find(w)
        count, spare, far_root = np.zeros(len(u)), np.ones(len(u)), np.full(len(u), np.nan)
        count[left], spare[left], far_root[right] = model.count[i[left]], model.spare[i[left]], root[j[right]]
        made = {"_row": row, "n": n, "u": u, "w": w, "net": net, "left": left, "right": right, "count": count, "spare": spare, "root": far_root}
        yield batch_of(kind, **{x: pa.array(v) for x, v in made.items()})

    shelf = Shelf(docs.sparkSession)
    asked = keyed(docs, text_col, *ids).mapInArrow(run, asks)
    dealt_out = asked.unionByName(model.blocks, allowMissingColumns=True).repartitionById(model.parts, "b")
    judged = shelf.put(dealt_out.mapInArrow(judge, kind), "judged")
    first = judged.where("n_tokens IS NOT NULL").select(*(F.col(f"_id{i}").alias(x.name) for i, x in enumerate(found)), *names)
    zero = F.lit(0)
    pairs = judged.where("n_tokens IS NULL").select("_row", *kind.names[len(schema) :])
    far = pairs.where("u IS NOT NULL").drop("l")
    # Only words that are not shipped are joined, so no key here is frequent.
    contexts = table.select(F.col("h").alias("u"), F.col("c").alias("c_"), F.col("spare").alias("s_"))
    here = far.where("NOT `left`").join(contexts, "u", "left").withColumns(
        {"count": F.coalesce("c_", F.lit(0.0)), "spare": F.coalesce("s_", F.lit(1.0))}
    )
    far = far.where("`left`").unionByName(here.drop("c_", "s_"))
    dishes = table.select(F.col("h").alias("w"), "base", "lp")
    class_lp = F.lit(float(model.after[-1, -1]))
    here = far.where("NOT `right`").join(dishes, "w", "left").withColumn(
        "root", F.pow(F.lit(10.0), class_lp + F.coalesce("lp", F.lit(model.tail_unseen)))
    )
    none = F.lit(None).cast("double")
    far = far.where("`right`").withColumns({"base": none, "lp": none}).unionByName(here)
    p = F.col("net") / (STRENGTH + F.col("count")) + F.col("spare") * F.col("root")
    far = far.select(
        "_row",
        F.when(~F.col("right") & F.col("base").isNotNull(), F.col("n")).otherwise(zero).alias("k"),
        F.when(~F.col("right"), F.col("n") * F.coalesce("base", F.lit(model.base_unseen))).otherwise(0.0).alias("b"),
        (F.col("n") * F.log10(p)).alias("l"),
    )
    near = pairs.where("l IS NOT NULL").select("_row", zero.alias("k"), F.lit(0.0).alias("b"), "l")
    met = near.union(far).groupBy("_row").agg(*(F.sum(x).alias(x) for x in "kbl"))
    return first.join(met, "_row", "left").select(
        *found.names,
        "n_tokens",
        (F.col("n_known") + F.coalesce("k", zero)).alias("n_known"),
        (F.col("base_score") + F.coalesce("b", zero)).alias("base_score"),
        (F.col("score") + F.coalesce("l", zero)).alias("score"),
    )


def perplexity(scored: DataFrame) -> DataFrame:
    """``base_perplexity`` and ``perplexity`` per token of all rows of ``scored``."""
    tokens = F.sum("n_tokens")
    return scored.agg(
        F.pow(F.lit(10.0), -F.sum("base_score") / tokens).alias("base_perplexity"),
        F.pow(F.lit(10.0), -F.sum("score") / tokens).alias("perplexity"),
    )
