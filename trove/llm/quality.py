"""Quality rules: boosted trees over document statistics.

Statistics are taken in one Arrow pass. The trees are fitted to labelled rows
with the logistic loss on feature histograms, under monotonic constraints (more
symbols, capitals or repetition never raise a score), and are flattened into
node arrays that score whole batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.words import blocks_of, distinct, give_back, keyed, raw_texts, windows

#: The trees are fitted to at most so many labelled rows, those of least id hash.
SAMPLE_ROWS = 20_000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, RIDGE = 60, 3, 0.2, 64, 20, 1.0
THRESHOLD = 0.5
WINDOW = 8

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_MORE = ("n_lines", "n_upper", "n_digits", "n_distinct")
#: Features and how a score may move with them: 0 either way, -1 never up.
FEATURES = {
    "log_words": 0,
    "word_length": 0,
    "symbols_per_word": -1,
    "upper_share": -1,
    "digit_share": -1,
    "dup_line_share": -1,
    "repeat_share": -1,
    "distinct_share": 0,
    "words_per_line": 0,
}

_SPACE = b" \t\n\v\f\r"
_SYMBOLS = b"#*$%&|<>"
_UPPER = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_DIGITS = b"0123456789"


def repeated_words(hashes: np.ndarray, size: int = WINDOW) -> int:
    """Words that lie in a window of ``size`` words found twice or more."""
    found = windows(hashes, size)
    if len(found) < 2:
        return 0
    _, back, times = np.unique(found, return_inverse=True, return_counts=True)
    twice = np.flatnonzero(times[back] > 1)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, twice, 1)
    np.add.at(cover, twice + size, -1)
    return int((cover[:-1].cumsum() > 0).sum())


def statistics_of(text: bytes, words: np.ndarray) -> tuple[int, ...]:
    """``COUNTS`` and ``_MORE`` of a whole text with these word hashes."""

    def held(letters: bytes) -> int:
        return len(text) - len(text.translate(None, letters))

    points = int(((np.frombuffer(text, np.uint8) & 0xC0) != 0x80).sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    return (
        len(words),
        points - held(_SPACE),
        held(_SYMBOLS),
        len(lines) - len(set(lines)),
        repeated_words(words),
        len(lines),
        held(_UPPER),
        held(_DIGITS),
        len(distinct(words)),
    )


def features_of(counts: np.ndarray) -> np.ndarray:
    """The ``FEATURES`` of rows of ``COUNTS`` and ``_MORE``."""
    words, chars, symbols, dup, repeat, lines, upper, digits, distinct = counts.T.astype(float)
    per_word, per_char, per_line = (np.maximum(x, 1) for x in (words, chars, lines))
    return np.stack(
        [
            np.log1p(words),
            chars / per_word,
            symbols / per_word,
            upper / per_char,
            digits / per_char,
            dup / per_line,
            repeat / per_word,
            distinct / per_word,
            words / per_line,
        ],
        axis=1,
    )


@dataclass(frozen=True)
class Trees:
    """Flat nodes of all trees: rows go left where the feature is at most the cut."""

    start: float
    roots: np.ndarray
    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    depth: int

    def score(self, x: np.ndarray) -> np.ndarray:
        """The probability of good quality of each row of features."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                down = x[rows, self.feature[node]] <= self.cut[node]
                node = np.where(down, self.left[node], self.right[node])
            total += self.value[node]
        return 1 / (1 + np.exp(-total))


def fit_trees(
    x: np.ndarray, y: np.ndarray, signs: tuple[int, ...], trees: int = TREES, depth: int = DEPTH
) -> Trees:
    """Boosted trees for 0/1 labels; ``signs`` are the monotonic constraints.

    Without rows of both classes the score is constant: the share of ones, or a
    half without rows.
    """
    nodes: list[list[float]] = []
    roots: list[int] = []
    share = (y.sum() + 0.5) / (len(y) + 1)
    start = float(np.log(share / (1 - share)))
    cuts = [
        np.unique(np.quantile(c, np.arange(1, BINS) / BINS)) if len(c) else np.empty(0) for c in x.T
    ]
    binned = [np.searchsorted(c, v) for c, v in zip(cuts, x.T, strict=True)]
    total = np.full(len(y), start)

    def grow(rows, slope, bend, low, high, level) -> int:
        own = float(np.clip(-slope[rows].sum() / (bend[rows].sum() + RIDGE), low, high))
        me = len(nodes)
        nodes.append([0, np.inf, me, me, own * RATE])
        best = None
        if level < depth and len(rows) >= 2 * LEAST_ROWS:
            all_g, all_h = slope[rows].sum(), bend[rows].sum()
            for f, sign in enumerate(signs):
                b = binned[f][rows]
                n = len(cuts[f]) + 1
                g, h, k = (
                    np.bincount(b, v, n).cumsum()[:-1]
                    for v in (slope[rows], bend[rows], np.ones(len(rows)))
                )
                lv = np.clip(-g / (h + RIDGE), low, high)
                rv = np.clip(-(all_g - g) / (all_h - h + RIDGE), low, high)
                gain = g**2 / (h + RIDGE) + (all_g - g) ** 2 / (all_h - h + RIDGE)
                gain -= all_g**2 / (all_h + RIDGE)
                fits = (k >= LEAST_ROWS) & (len(rows) - k >= LEAST_ROWS) & (sign * (rv - lv) >= 0)
                gain = np.where(fits, gain, -np.inf)
                if len(gain) and (j := int(gain.argmax())) >= 0 and gain[j] > 1e-6:
                    if best is None or gain[j] > best[0]:
                        best = (gain[j], f, j, lv[j], rv[j])
        if best:
            _, f, j, lv, rv = best
            mid = (lv + rv) / 2
            goes = binned[f][rows] <= j
            bounds = [(low, high), (low, high)]
            if signs[f] > 0:
                bounds = [(low, mid), (mid, high)]
            elif signs[f] < 0:
                bounds = [(mid, high), (low, mid)]
            a = grow(rows[goes], slope, bend, *bounds[0], level + 1)
            b = grow(rows[~goes], slope, bend, *bounds[1], level + 1)
            nodes[me] = [f, cuts[f][j], a, b, 0.0]
        return me

    for _ in range(trees if 0 < y.sum() < len(y) else 0):
        p = 1 / (1 + np.exp(-total))
        roots.append(grow(np.arange(len(y)), p - y, p * (1 - p), -np.inf, np.inf, 0))
        flat = _flat(start, roots[-1:], nodes, depth)
        total += np.log(np.maximum(flat.score(x), 1e-300)) - np.log(
            np.maximum(1 - flat.score(x), 1e-300)
        ) - start
    return _flat(start, roots, nodes, depth)


def _flat(start, roots, nodes, depth) -> Trees:
    table = np.array(nodes, float).reshape(-1, 5)
    f, cut, left, right, value = table.T
    as_int = [v.astype(np.int64) for v in (f, left, right)]
    return Trees(start, np.array(roots, np.int64), as_int[0], cut, as_int[1], as_int[2], value, depth)


def statistics(docs: DataFrame, text_col: str, *ids) -> DataFrame:
    """The counts of every row's whole text, beside the columns ``ids``."""
    names = (*COUNTS, *_MORE)
    schema = docs.select(*ids).schema
    for name in names:
        schema = schema.add(f"_{name}", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            last = batch.num_columns - 1
            table = _counts(raw_texts(batch, last))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:last], *(pa.array(c) for c in table.T)], schema.names
            )

    return keyed(docs, text_col, *ids).mapInArrow(count, schema)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
) -> Trees:
    """Trees fitted to ``sample_rows`` labelled documents, chosen by id hash.

    Null ids and labels are left out. At most ``sample_rows`` labels are
    broadcast, and as many rows of numbers reach the driver.
    """
    usable = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y"))
    usable = usable.where("_id IS NOT NULL AND _y IS NOT NULL").groupBy("_id").agg(F.max("_y").alias("_y"))
    chosen = usable.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    rows = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_body"))
    rows = rows.join(F.broadcast(chosen), "_id")
    counted = statistics(rows, "_body", "_id", "_y").orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    sample = counted.toPandas()
    counts = sample[[f"_{n}" for n in (*COUNTS, *_MORE)]].to_numpy(np.int64)
    return fit_trees(features_of(counts), sample["_y"].to_numpy(float), tuple(FEATURES.values()))


def verdicts(counts: np.ndarray, trees: Trees) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``base_failed``, the score, and ``kept`` of rows of counts."""
    words, repeat = counts[:, 0], counts[:, 4]
    failed = (words < 20) | (100 * repeat > 30 * words)
    score = trees.score(features_of(counts))
    return failed, score, ~failed & (score >= THRESHOLD)


def judge(docs: DataFrame, trees: Trees, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``COUNTS``, ``base_failed``, ``kept`` and ``score`` of every row.

    A null or empty text has no words and fails the base rules. Repeated rows
    are each judged, ids stay as they are (null too), other columns are not
    read, and an empty table gives no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    schema = docs.select(F.col(id_col)).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean").add("kept", "boolean").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts(raw_texts(batch, 1))
            failed, score, kept = verdicts(counts, shipped.value)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(counts[:, j]) for j in range(len(COUNTS)))]
                + [pa.array(failed), pa.array(kept), pa.array(score)],
                schema.names,
            )

    return keyed(docs, text_col, F.col(id_col)).mapInArrow(run, schema)


def keep_good(docs: DataFrame, trees: Trees, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are kept, with all their columns; nothing is shuffled."""
    shipped = docs.sparkSession.sparkContext.broadcast(trees)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = _counts([t or b"" for t in raw_texts(batch, at)])
            yield batch.filter(pa.array(verdicts(counts, shipped.value)[2]))

    return docs.mapInArrow(run, docs.schema)


def _counts(texts: list[bytes]) -> np.ndarray:
    rows = []
    for start, stop, words in blocks_of(texts, lower=False):
        rows += [statistics_of(t, words.of(i)) for i, t in enumerate(texts[start:stop])]
    give_back()
    return np.array(rows, np.int64).reshape(-1, len(COUNTS) + len(_MORE))
