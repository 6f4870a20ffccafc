"""Line dedup: an exact set-similarity join of the lines of a corpus.

A line is the set of its distinct words. Words are ordered by rarity, each line
is posted under its prefix, lines in one posting list pass the length and
positional filters (and one on parities of their words, which loses nothing) and
are verified, and of two lines that match the later one goes. Lines are ordered by
document id and then by their place. Lines so short that they match only equal sets
are grouped by fingerprint and not posted.

Whether a line goes is settled in two steps: against the leader and the earliest
line of each of its lists, and then, for lines that stayed, against all earlier
lines of its lists. Lines already gone are not compared again as later ones.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from trove.llm import setjoin
from trove.llm.rarity import SetBlock, rarity
from trove.llm.words import blocks_of, distinct_runs, keyed, raw_texts
from trove.session import stored

#: Lines without words are never removed and remove nothing.
LEAST_WORDS = 1


def line_sets(texts: list[bytes]) -> Iterator[SetBlock]:
    """The number and word set of each line with words."""
    for start, _, words in blocks_of(texts):
        breaks = words.breaks()
        # A line is what lies between two breaks; a text begins a line.
        cuts = np.searchsorted(words.starts, breaks)
        sizes = np.diff(np.concatenate([[0], cuts, [len(words.starts)]]))
        lines, counts, found = distinct_runs(words.hashes, np.where(sizes >= LEAST_WORDS, sizes, 0))
        owners = np.searchsorted(words.offsets, np.append(-1, breaks)[lines] + 1, "right") - 1
        # Breaks before a text: its own and one between any two texts.
        units = lines - np.searchsorted(breaks, words.offsets[owners])
        yield start + owners, units, counts, found


def removed_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = setjoin.PERCENT,
) -> DataFrame:
    """``line`` (from 0) and ``n_words`` of every line that an earlier one matches.

    Lines match when ``100 * shared >= percent * union`` of their distinct words
    after lower-casing A-Z. An earlier line counts whether it stays or not, in
    the same document too. Null and empty texts have no lines; a null id comes
    first; rows equal in id and text are one row here, and so lose the same
    lines. Lines without words never match.
    ``_key`` is a hash of id and text. Other columns are not read, and an empty
    table gives no rows.
    """
    key = F.xxhash64(id_col, text_col).alias("_key")
    texts = keyed(docs, text_col, key, F.col(id_col).alias("_id"))
    rare = rarity(texts, line_sets)
    found = stored(setjoin.units(texts, line_sets, rare, percent), "units")
    first = found.groupBy("fp").agg(F.min(F.struct("_id", "unit", "_key")).alias("at"))
    first = stored(first, "first")
    # A set that cannot match one with a word more matches equal sets only.
    posted = found.where(F.expr(f"100 * n >= {percent} * (n + 1)"))
    close = stored(setjoin.close_lists(posted, percent).distinct(), "close")
    dated = close.join(first, F.col("me.fp") == F.col("fp")).select("token", "me", "at")
    per = W.partitionBy("token")
    leaders = F.min("me").over(per).alias("lead"), F.min_by("me", "at").over(per).alias("old")
    lists = stored(dated.select("*", *leaders), "lists")

    def stars(leader: str) -> DataFrame:
        apart = lists.where(f"me.fp <> {leader}.fp").where(setjoin.alike("me", leader, percent))
        return apart.select(*setjoin.pair_of(F.col("me.fp"), F.col(f"{leader}.fp")))

    tried = stored(stars("lead").union(stars("old")).distinct(), "stars")
    gone = stored(later(setjoin.linked(tried, found, texts, line_sets, percent), first), "gone")

    # What stayed, against everything earlier in its lists.
    stayed = lists.join(gone, F.col("me.fp") == F.col("fp"), "left_anti")
    x = stayed.select("token", F.col("me").alias("x"), F.col("at").alias("x_at"))
    y = lists.select(
        F.col("token").alias("token_"), F.col("me").alias("y"), F.col("at").alias("y_at")
    )
    met = x.join(y, F.expr("token = token_ AND y_at < x_at") & setjoin.alike("x", "y", percent))
    rest = met.select(*setjoin.pair_of(F.col("x.fp"), F.col("y.fp"))).distinct()
    rest = rest.join(tried, ["a", "b"], "left_anti")
    more = later(setjoin.linked(rest, found, texts, line_sets, percent), first)
    gone = stored(gone.union(more).distinct().withColumn("_gone", F.lit(True)), "gone")

    lines = found.select("_key", "_id", "unit", "n", "fp").join(first, "fp")
    again = "NOT (at <=> named_struct('_id', _id, 'unit', unit, '_key', _key))"
    marked = lines.join(gone, "fp", "left").where(f"_gone OR {again}")
    return marked.select(
        F.col("_id").alias(id_col),
        F.col("unit").cast("long").alias("line"),
        F.col("n").cast("long").alias("n_words"),
        "_key",
    )


def later(links: DataFrame, first: DataFrame) -> DataFrame:
    """Of each linked pair the ``fp`` whose first line comes later."""
    a, b = first.toDF("a", "a_at"), first.toDF("b", "b_at")
    both = links.join(a, "a").join(b, "b")
    return both.select(F.expr("IF(a_at < b_at, b, a)").alias("fp")).distinct()


def dedup_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    percent: int = setjoin.PERCENT,
    drop_emptied: bool = True,
) -> DataFrame:
    """``docs`` without the lines of ``removed_lines``; all columns stay.

    Lines that stay keep their order and wording. With ``drop_emptied`` a row
    that lost lines and has no word left goes; rows without text stay as they
    are. Only rows that lose lines are moved, if few do.
    """
    key = F.xxhash64(id_col, text_col).alias("_key")
    lost = removed_lines(docs, id_col, text_col, percent)
    lost = lost.groupBy("_key").agg(F.sort_array(F.collect_set("line")).alias("_lost"))
    # Columns of documents are numbered, so that none can clash.
    body = [F.col(f"`{c}`").alias(f"c{i}") for i, c in enumerate(docs.columns)]
    marked = docs.select(key, *body).join(lost, "_key", "left")
    at, at_end = 1 + docs.columns.index(text_col), 1 + len(docs.columns)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keep = [], []
            gone = batch.column(batch.num_columns - 1).to_pylist()
            for text, lines in zip(raw_texts(batch, at), gone, strict=True):
                if lines and text is not None:
                    away = set(lines)
                    text = b"\n".join(
                        x for i, x in enumerate(text.split(b"\n")) if i not in away
                    )
                texts.append(text)
                keep.append(not (drop_emptied and lines and not (text or b"").strip()))
            column = pa.array(texts, pa.binary()).cast(batch.column(at).type)
            columns = [column if i == at else c for i, c in enumerate(batch.columns)]
            out = pa.RecordBatch.from_arrays(columns[1:at_end], names)
            yield out.filter(pa.array(keep, pa.bool_()))

    names = docs.columns
    return marked.mapInArrow(cut, docs.schema)
