"""N-gram Jaccard join: subsets for small sets, inverted lists for large ones.

A document is its set of distinct five-word shingles. Sets up to a boundary
enumerate, for each size a partner may have, all their subsets of the overlap
that such a pair needs: two sets with a subset in common link without any
further check. Larger sets scan inverted lists of their rarest shingles. The
boundary is the size at which the two ways together cost least.

Only links that can still join two components are verified: first every member
of a list with the list's leader, then the pairs that lie in a list but in
different components. Members of one component need no further pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from itertools import combinations
from math import comb

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trove.llm import setjoin
from trove.llm.components import components
from trove.llm.rarity import SIZES, Rarity, SetBlock, rarity
from trove.llm.words import blocks_of, keyed, mixed, shingle_sets
from trove.session import stored

SHINGLE = 5
#: Subsets of sets above this size are not costed; their number explodes.
MOST_SMALL = 16
#: Cost of verifying one candidate, in rows that are enumerated or posted.
VERIFY_COST = 4.0


def document_sets(texts: list[bytes]) -> Iterator[SetBlock]:
    """The one set of each document: its shingles, none without words."""
    for start, stop, words in blocks_of(texts):
        found = list(shingle_sets(words, SHINGLE))
        sizes = np.array(list(map(len, found)), np.int64)
        yield np.arange(start, stop), np.zeros(stop - start, np.int64), sizes, np.concatenate(found)


def partner_sizes(n: int, percent: int) -> range:
    """Sizes that a set of ``n`` members can link with."""
    return range(-(-percent * n // 100), 100 * n // percent + 1)


def enumeration_cost(n: int, percent: int) -> int:
    """Subsets that a set of ``n`` members enumerates."""
    sizes = partner_sizes(n, percent)
    return sum(comb(n, setjoin.overlap_needed(n, t, percent)) for t in sizes)


def boundary(rare: Rarity, percent: int = setjoin.PERCENT) -> int:
    """The largest size to enumerate, by the cost of all sets of the corpus.

    Sets at or below it enumerate; sets above it, and smaller ones that a larger
    one may link with, post their prefix and have its lists scanned.
    """
    sizes = np.arange(SIZES + 1)

    def cost(edge: int) -> float:
        few = sum(int(rare.sizes[n]) * enumeration_cost(n, percent) for n in range(1, edge + 1))
        scanned = rare.sizes[(sizes >= 1) & (100 * sizes > percent * edge)]
        prefix = sizes[(sizes >= 1) & (100 * sizes > percent * edge)] * (100 - percent) // 100 + 1
        return few + float((scanned * prefix).sum()) * (1 + VERIFY_COST * np.log2(1 + rare.mean_list))

    return min(range(MOST_SMALL + 1), key=cost)


@lru_cache(maxsize=None)
def _choices(n: int, size: int) -> np.ndarray:
    return np.array(list(combinations(range(n), size)), np.int64)


def small_subsets(edge: int, percent: int = setjoin.PERCENT):
    """A function that gives a small set's signatures, and where it is the smaller set."""

    def subsets(found: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        n = len(found)
        if not 0 < n <= edge:
            return None
        signs, lower = [], []
        spread = mixed(found)
        for t in partner_sizes(n, percent):
            if t > edge:
                continue
            need = setjoin.overlap_needed(n, t, percent)
            kind = np.uint64(min(n, t) * (MOST_SMALL + 2) + max(n, t))
            made = mixed(mixed(spread[_choices(n, need)].sum(axis=1)) + kind)
            signs.append(made)
            lower.append(np.full(len(made), n <= t))
        return np.concatenate(signs), np.concatenate(lower).astype(np.uint64)

    return subsets


def small_links(found: DataFrame) -> DataFrame:
    """Links from shared subsets: each member with one set of the smaller size.

    Sets of the smaller size that share a subset link with each other and with
    those of the larger size, but the larger ones need not link among
    themselves, so the star's centre is a smaller one.
    """
    rows = found.where("size(subset) > 0").select(
        "fp", F.explode(F.arrays_zip("subset", "lower")).alias("s")
    )
    per = W.partitionBy("sign")
    flat = rows.select("fp", F.col("s.subset").alias("sign"), F.col("s.lower").alias("lower"))
    centre = F.min(F.when(F.col("lower"), F.col("fp"))).over(per)
    stars = flat.withColumn("centre", centre).where("centre IS NOT NULL AND centre <> fp")
    return stars.select(*setjoin.pair_of(F.col("centre"), F.col("fp"))).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = setjoin.PERCENT,
) -> DataFrame:
    """``n_shingles`` and ``component_id`` of every row.

    Rows link when ``100 * shared >= percent * union`` for their shingle sets
    (after lower-casing A-Z); a component is all that links reach, named by its
    smallest id. A text with fewer than five words is one shingle; null, empty
    and blank texts have none and link with nothing. Equal sets count once and
    stand for all their rows; repeated rows each come out. A null id comes out
    with its component's smallest id, null if it has none. Other columns are not
    read, and an empty table gives no rows. Shingles are told apart by 64-bit
    hashes.
    """
    rows = components_of(docs, id_col, text_col, percent)
    return rows.select(
        F.col("_id").alias(id_col),
        F.col("n").cast("long").alias("n_shingles"),
        F.coalesce("first._id", "_id").alias("component_id"),
    )


def components_of(
    docs: DataFrame, id_col: str, text_col: str, percent: int = setjoin.PERCENT
) -> DataFrame:
    """``_id``, ``_key`` (a hash of id and text), ``n`` and ``first`` of every row.

    ``first`` is the least id, with its key, of the row's component, and null in
    rows without words.
    """
    key = F.xxhash64(id_col, text_col).alias("_key")
    texts = keyed(docs, text_col, key, F.col(id_col).alias("_id"))
    rare = rarity(texts, document_sets)
    edge = boundary(rare, percent)
    made = setjoin.units(texts, document_sets, rare, percent, small_subsets(edge, percent))
    found = stored(made, "units")
    # A set posts if it may link with one above the boundary.
    posted = setjoin.postings(found.where(f"100 * n > {percent * edge}"))
    lists = stored(setjoin.shared_lists(posted), "lists")
    stars = lists.where("me.fp <> lead.fp").where(setjoin.fits("me", "lead", percent))
    tried = stored(
        stars.select(*setjoin.pair_of(F.col("me.fp"), F.col("lead.fp"))).distinct(), "stars"
    )
    certain = setjoin.linked(tried, found, texts, document_sets, percent).union(small_links(found))
    links = stored(certain, "links")
    rest = across(lists, components(links), tried, percent)
    more = setjoin.linked(rest, found, texts, document_sets, percent)
    return named(found, components(links.union(more)))


def across(lists: DataFrame, labels: DataFrame, tried: DataFrame, percent: int) -> DataFrame:
    """Pairs in one list, not tried yet, whose sets lie in different components."""
    label = F.coalesce("label", "me.fp").alias("label")
    mine = lists.select("token", "me").distinct()
    known = mine.join(labels, F.col("me.fp") == F.col("node"), "left").select("token", "me", label)
    per = W.partitionBy("token")
    split = known.withColumn("_split", F.min("label").over(per) != F.max("label").over(per))
    open_lists = stored(split.where("_split").drop("_split"), "open")
    # A member is only compared with labels other than its own.
    left = open_lists.select("token", F.col("me").alias("x"), F.col("label").alias("lx"))
    right = open_lists.select(
        F.col("token").alias("token_"), F.col("me").alias("y"), F.col("label").alias("ly")
    )
    apart = F.expr("x.fp < y.fp AND lx <> ly") & setjoin.fits("x", "y", percent)
    met = left.join(right, F.expr("token = token_") & apart)
    pairs = met.select(F.col("x.fp").alias("a"), F.col("y.fp").alias("b")).distinct()
    return pairs.join(tried, ["a", "b"], "left_anti")


def named(found: DataFrame, labels: DataFrame) -> DataFrame:
    """Every row with the least id and key of its component."""
    rows = found.select("_id", "_key", "n", "fp")
    me = F.struct("_id", "_key")
    least = rows.where("fp IS NOT NULL").groupBy("fp").agg(F.min(me).alias("_least"))
    grouped = least.join(labels, F.col("fp") == F.col("node"), "left").select(
        "fp", "_least", F.coalesce("label", "fp").alias("label")
    )
    firsts = grouped.groupBy("label").agg(F.min("_least").alias("first"))
    names = stored(grouped.join(firsts, "label").select("fp", "first"), "names")
    return rows.join(names, "fp", "left").select("_id", "_key", "n", "first")


def keep_first(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = setjoin.PERCENT,
) -> DataFrame:
    """``docs`` with one row of each component: the one of least id (and text hash).

    Of rows that are equal in id and text one stays. Rows without words are in
    no component and stay. All columns come out as they were.
    """
    rows = stored(components_of(docs, id_col, text_col, percent), "rows")
    gone = rows.where("n > 0 AND NOT (first <=> named_struct('_id', _id, '_key', _key))")
    # Columns of documents are numbered, so that none can clash.
    body = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(F.xxhash64(id_col, text_col).alias("_key"), *body)
    left = marked.join(gone.select("_key").distinct(), "_key", "left_anti")
    again = rows.where("n > 0").groupBy("_key").count().where("count > 1").select("_key")
    again = stored(again.join(gone, "_key", "left_anti"), "again")
    if not again.isEmpty():
        once = left.join(again, "_key", "left_semi").dropDuplicates(["_key"])
        left = left.join(again, "_key", "left_anti").unionByName(once)
    return left.drop("_key").toDF(*docs.columns)
