"""Connected components by spreading the least label and jumping along labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.session import stored


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node reachable, for all nodes in ``edges``.

    ``edges`` has columns ``a`` and ``b``. Each round stores the labels in the
    shared folder; labels spread to neighbours and then follow their own label,
    so that long chains shorten quickly. Both steps combine before shuffling.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    first = both.groupBy("a").agg(F.min("b").alias("m"))
    labels = stored(first.select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = both.join(labels, both["a"] == labels["node"]).select(F.col("b").alias("node"), "label")
        least = labels.union(near).groupBy("node").agg(F.min("label").alias("label"))
        least = stored(least, "spread")
        follow = least.select(F.col("node").alias("label"), F.col("label").alias("_next"))
        jumped = least.join(follow, "label").select("node", F.col("_next").alias("label"))
        after = stored(jumped, "labels")
        same = after.join(labels, ["node", "label"], "left_anti").limit(1).count() == 0
        labels = after
        if same:
            return labels
