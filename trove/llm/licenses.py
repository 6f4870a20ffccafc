"""Licence scan with a positional index of rare words, in DataFrame operations.

``fit`` counts in how many documents each template word occurs and posts, for
each template, its words of highest IDF: as many as weigh together more than a
match may miss, so every match holds at least one of them in place. ``scan``
looks up a file's posted words, turns each posting into the place where the
template would start, and keeps the places where the words that stand at their
relative positions weigh enough and all key phrases are complete.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Least share of a template's IDF weight that must stand in place.
LEAST_SHARE = 0.75

# Label, words, and the key phrases that must be complete. Words
# are lower-case ASCII without "k", which one non-ASCII letter lower-cases to.
BASE_TEMPLATES = (
    ("mit", "under the mit license", ("under the mit license",)),
    ("apache-2", "apache license version 2", ("apache license version 2",)),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
)
ADDED_TEMPLATES = (
    ("agpl", "gnu affero general public license", ("gnu affero general public license",)),
    ("all-rights-reserved", "all rights reserved", ("all rights reserved",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("source and binary forms",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by", "creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0", "public domain")),
    ("gpl", "gnu general public license", ("gnu general public license",)),
    ("gpl-3", "under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose", ("copy modify and or distribute",)),
    ("lgpl", "gnu lesser general public license", ("gnu lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ("permission is hereby granted", "free of charge")),
    ("mpl-2", "mozilla public license version 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    phrases: tuple[tuple[int, int], ...]
    base: bool
    weights: tuple[float, ...] = ()
    anchors: tuple[int, ...] = ()


def _template(label: str, text: str, phrases: tuple[str, ...], base: bool) -> Template:
    words = tuple(text.split())
    if "k" in text:
        raise ValueError("template words must not hold the letter k")
    spans = []
    for phrase in phrases:
        part = tuple(phrase.split())
        at = [i for i in range(len(words)) if words[i : i + len(part)] == part]
        if not at:
            raise ValueError(f"{phrase!r} is not in {text!r}")
        spans.append((at[0], at[0] + len(part)))
    return Template(label, words, tuple(spans), base)


def templates() -> list[Template]:
    """All templates without weights, base ones first."""
    return [_template(*x, True) for x in BASE_TEMPLATES] + [
        _template(*x, False) for x in ADDED_TEMPLATES
    ]


def words_of(text: Column) -> Column:
    """Words of a text: runs of digits, ASCII letters and non-ASCII characters."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return F.array_remove(F.split(lowered, _SEPARATORS), "")


def fit(docs: DataFrame, text_col: str = "text", least: float = LEAST_SHARE) -> list[Template]:
    """The templates with IDF weights over all ``docs``, and their posted words.

    Only counts of the template words, a fixed list, reach the driver.
    """
    found = templates()
    vocabulary = sorted({w for t in found for w in t.words})
    held = docs.select(
        F.array_intersect(words_of(F.col(text_col)), F.array(*map(F.lit, vocabulary))).alias("_w")
    )
    counted = held.select(F.explode(F.array_append("_w", F.lit(""))).alias("_w"))
    df = {r["_w"]: r["count"] for r in counted.groupBy("_w").count().collect()}
    total = df.get("", 0)

    out = []
    for t in found:
        weights = [math.log((total + 2) / (df.get(w, 0) + 1)) for w in t.words]
        order = sorted(range(len(weights)), key=lambda j: (-weights[j], j))
        anchors, sum_ = [], 0.0
        for j in order:
            anchors.append(j)
            sum_ += weights[j]
            if t.base or sum_ > (1 - least) * sum(weights) + 1e-9:
                break
        out.append(
            Template(t.label, t.words, t.phrases, t.base, tuple(weights), tuple(anchors))
        )
    return out


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _postings(found: list[Template]) -> str:
    """SQL of a map from a posted word to its templates and positions."""
    posted: dict[str, list[tuple[int, int]]] = {}
    for no, t in enumerate(found):
        for j in t.anchors:
            posted.setdefault(t.words[j], []).append((no, j))
    rows = (
        f"{_text(w)}, array({', '.join(f'struct({no} AS t, {j} AS j)' for no, j in at)})"
        for w, at in sorted(posted.items())
    )
    return f"map({', '.join(rows)})"


def _catalogue(found: list[Template]) -> str:
    """SQL of an array with every template's label, words, weights and phrases."""
    rows = []
    for t in found:
        places = sorted({j for a, b in t.phrases for j in range(a, b)})
        rows.append(
            "named_struct("
            f"'label', {_text(t.label)}, 'base', {str(t.base).lower()}, "
            f"'words', array({', '.join(map(_text, t.words))}), "
            f"'weights', array({', '.join(f'{w!r}D' for w in t.weights)}), "
            f"'total', {sum(t.weights)!r}D, "
            f"'must', array({', '.join(map(str, places))}))"
        )
    return f"array({', '.join(rows)})"


def scan(
    docs: DataFrame,
    found: list[Template],
    id_col: str = "doc_id",
    text_col: str = "text",
    least: float = LEAST_SHARE,
) -> DataFrame:
    """``n_words`` and ``matches`` of every row.

    A match has its label, whether its template is a base phrase, the word at
    which the template starts (below 0 if its first words are cut off), and the
    share of its IDF weight that stands in place. A null or empty text has no
    words and no matches; repeated rows are each scanned, ids stay as they are
    (null too), other columns are not read, an empty table gives no rows.
    """
    posted = ", ".join(_text(w) for w in sorted({t.words[j] for t in found for j in t.anchors}))
    words = docs.select(F.col(id_col).alias("_id"), words_of(F.col(text_col)).alias("_words"))
    hits = words.select(
        "*",
        F.expr(
            "CASE WHEN size(_words) = 0 THEN CAST(array() AS array<int>) ELSE "
            f"filter(sequence(0, size(_words) - 1), i -> get(_words, i) IN ({posted})) END"
        ).alias("_hits"),
    )
    starts = hits.select(
        "*",
        F.expr(
            "array_distinct(flatten(transform(_hits, i -> transform("
            f"element_at({_postings(found)}, get(_words, i)), p -> struct(p.t AS t, i - p.j AS s)))))"
        ).alias("_starts"),
    )
    weighed = starts.select(
        "_id",
        "_words",
        F.expr(
            "transform(_starts, x -> named_struct('s', x.s, 'm', get("
            + _catalogue(found)
            + ", x.t)))"
        ).alias("_tried"),
    )
    verified = weighed.select(
        "_id",
        F.size("_words").cast("long").alias("n_words"),
        F.expr(
            "transform(filter(_tried, x -> forall(x.m.must, j -> get(_words, x.s + j) <=> get(x.m.words, j))), "
            "x -> named_struct('label', x.m.label, 'base', x.m.base, 'start', CAST(x.s AS long), 'share', "
            "aggregate(sequence(0, size(x.m.words) - 1), 0D, (sum, j) -> sum + "
            "IF(get(_words, x.s + j) <=> get(x.m.words, j), get(x.m.weights, j), 0D)) / greatest(x.m.total, 1e-300D)))"
        ).alias("_all"),
    )
    return verified.select(
        F.col("_id").alias(id_col),
        "n_words",
        F.expr(f"filter(_all, x -> x.base OR x.share >= {least!r}D)").alias("matches"),
    )


def summary(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Counts, places and labels of each row's matches, and its best share."""
    base = F.filter("matches", lambda x: x["base"])

    def labels(of: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(of["label"])), ",")

    return scanned.select(
        id_col,
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(base["start"]).alias("first_word"),
        F.array_max(base["start"]).alias("last_word"),
        labels(base).alias("base_labels"),
        labels(F.col("matches")).alias("labels"),
        F.when(F.size(base) > 0, F.lit(1.0))
        .otherwise(F.least(F.lit(1.0), F.coalesce(F.array_max(F.col("matches")["share"]), F.lit(0.0))))
        .alias("score"),
    )
