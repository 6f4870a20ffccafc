"""Gaussian mixtures for many groups and many component counts at once.

One Spark job per round serves every group and every candidate count: each
task adds up responsibilities for its rows, Spark adds the tasks, and only the
parameters (groups x components x dimensions) reach the driver. They return as
a broadcast, so the lineage stays one read of the points deep.
"""

from __future__ import annotations

import math
from collections.abc import Hashable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from trove.operators.moments import as_matrix, sum_rows

# Fixed values.
THRESHOLD = 0.1
MAX_CLUSTERS = 50

# Every count below the most clusters is tried, unless a grid is given.
GRID = tuple(range(1, MAX_CLUSTERS))
RIDGE = 1e-6
TOLERANCE = 1e-3
ROUNDS = 40
SEED = 224
# Rows per group that starting points are drawn from, by hash over all rows,
# and the groups that are fitted at once.
POOL_ROWS = 256
# Rows scored at once, against all components of a group.
ROWS_AT_ONCE = 1024
SLICE_GROUPS = 1000


@dataclass
class Mixture:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    log_likelihood: float = -math.inf
    bic: float = math.inf
    history: tuple[float, ...] = ()
    converged: bool = False

    @property
    def k(self) -> int:
        return len(self.weights)

    def log_densities(self, rows: np.ndarray) -> np.ndarray:
        """Log of weight times density, one column per component."""
        k, d = self.means.shape
        low = np.linalg.cholesky(self.covariances)
        whiten = np.linalg.inv(low)
        # (k * d, rows): every component's whitened gaps in one product.
        centre = np.einsum("kij,kj->ki", whiten, self.means).reshape(k * d, 1)
        gaps = whiten.reshape(k * d, d) @ rows.T - centre
        half = 0.5 * (gaps.reshape(k, d, -1) ** 2).sum(1)
        scale = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
        front = np.log(self.weights + 1e-300) - 0.5 * d * math.log(2 * math.pi) - scale
        return (front[:, None] - half).T

    def responsibilities(self, rows: np.ndarray) -> tuple[np.ndarray, float]:
        """Membership probabilities and the total log likelihood."""
        logs = self.log_densities(rows)
        top = logs.max(1, keepdims=True)
        whole = top + np.log(np.exp(logs - top).sum(1, keepdims=True))
        return np.exp(logs - whole), float(whole.sum())

    def coefficients(self, origin: np.ndarray) -> np.ndarray:
        """Log of weight times density as factors of ``_features``, by component."""
        k, d = self.means.shape
        low = np.linalg.cholesky(self.covariances)
        whiten = np.linalg.inv(low)
        precision = whiten.transpose(0, 2, 1) @ whiten
        means = self.means - origin
        line = np.einsum("kij,kj->ki", precision, means)
        scale = np.log(np.diagonal(low, axis1=1, axis2=2)).sum(1)
        front = np.log(self.weights + 1e-300) - 0.5 * d * math.log(2 * math.pi) - scale
        i, j = np.triu_indices(d)
        square = -precision[:, i, j] * np.where(i == j, 0.5, 1.0)
        return np.concatenate([(front - 0.5 * (line * means).sum(1))[:, None], line, square], axis=1)

    def updated(self, stats: np.ndarray) -> Mixture:
        k, d = self.means.shape
        counts = stats[1 : 1 + k] + 1e-12
        sums = stats[1 + k : 1 + k + k * d].reshape(k, d)
        outer = stats[1 + k + k * d :].reshape(k, d, d)
        means = sums / counts[:, None]
        spread = outer / counts[:, None, None] - np.einsum("ki,kj->kij", means, means)
        return Mixture(
            counts / counts.sum(), means, _positive(spread), self.log_likelihood, self.bic,
            self.history,
        )


def _features(rows: np.ndarray) -> np.ndarray:
    """One, the values, and their products two by two, each pair once."""
    i, j = np.triu_indices(rows.shape[1])
    return np.concatenate([np.ones((len(rows), 1)), rows, rows[:, i] * rows[:, j]], axis=1)


@dataclass
class _Fits:
    """All mixtures of one group, whose rows are scored and added up together."""

    counts: list[int]
    origin: np.ndarray
    factors: np.ndarray

    @classmethod
    def of(cls, mixtures: list[Mixture]) -> _Fits:
        # Values are taken from a mean of the group, so that little cancels.
        origin = mixtures[0].weights @ mixtures[0].means
        factors = np.concatenate([m.coefficients(origin) for m in mixtures]).T
        return cls([m.k for m in mixtures], origin, factors)

    def sums(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The log likelihood by mixture, and shares times features by component."""
        starts = np.r_[0, np.cumsum(self.counts)[:-1]]
        likely, total = np.zeros(len(starts)), np.zeros(self.factors.T.shape)
        for at in range(0, len(rows), ROWS_AT_ONCE):
            features = _features(rows[at : at + ROWS_AT_ONCE] - self.origin)
            shares = features @ self.factors
            top = np.maximum.reduceat(shares, starts, axis=1)
            shares -= np.repeat(top, self.counts, axis=1)
            np.exp(shares, out=shares)
            whole = np.add.reduceat(shares, starts, axis=1)
            likely += (top + np.log(whole)).sum(0)
            shares *= np.repeat(1.0 / whole, self.counts, axis=1)
            total += shares.T @ features
        return likely, total

    def statistics(self, likely: np.ndarray, total: np.ndarray) -> list[np.ndarray]:
        """``[log likelihood, counts, sums, outer products]`` by mixture."""
        d, out = len(self.origin), []
        i, j = np.triu_indices(d)
        for value, part in zip(likely, np.split(total, np.cumsum(self.counts)[:-1])):
            n, sums = part[:, 0], part[:, 1 : 1 + d]
            outer = np.zeros((len(n), d, d))
            outer[:, i, j] = outer[:, j, i] = part[:, 1 + d :]
            cross = sums[:, :, None] * self.origin
            outer += cross + cross.transpose(0, 2, 1) + n[:, None, None] * np.outer(self.origin, self.origin)
            whole = sums + n[:, None] * self.origin
            out.append(np.concatenate([[value], n, whole.ravel(), outer.ravel()]))
        return out


def _positive(covariances: np.ndarray) -> np.ndarray:
    """Symmetric with every eigenvalue at least the ridge."""
    values, axes = np.linalg.eigh((covariances + covariances.transpose(0, 2, 1)) / 2)
    values = np.maximum(values, 0.0) + RIDGE
    return np.einsum("kij,kj,klj->kil", axes, values, axes)


def candidate_counts(n: int, max_clusters: int = MAX_CLUSTERS, grid=GRID) -> list[int]:
    """Component counts to try: those of the grid below ``min(max, n)``."""
    return [k for k in grid if k < min(max_clusters, n)] or [1]


def parameter_count(k: int, d: int) -> int:
    return k * d * (d + 1) // 2 + k * d + k - 1


def _start(pool: np.ndarray, k: int, seed: int) -> Mixture:
    """Spread starting means over a bounded pool of rows."""
    random = np.random.RandomState(seed)
    means = pool[:1]
    for _ in range(1, k):
        gaps = ((pool[:, None] - means[None]) ** 2).sum(-1).min(1)
        share = gaps / gaps.sum() if gaps.sum() > 0 else np.full(len(pool), 1 / len(pool))
        means = np.vstack([means, pool[random.choice(len(pool), p=share)]])
    for _ in range(10):
        near = ((pool[:, None] - means[None]) ** 2).sum(-1).argmin(1)
        means = np.vstack(
            [pool[near == c].mean(0) if (near == c).any() else means[c] for c in range(k)]
        )
    near = ((pool[:, None] - means[None]) ** 2).sum(-1).argmin(1)
    rest = pool - means[near]
    spread = _positive((rest.T @ rest / len(pool))[None])[0]
    counts = np.bincount(near, minlength=k) + 1.0
    return Mixture(counts / counts.sum(), means, np.repeat(spread[None], k, 0))


def _pools(
    points: DataFrame, group_col: str, id_col: str, vector_col: str
) -> dict[Hashable, np.ndarray]:
    """A bounded pool of rows per group: those whose key has the least md5,
    which draws from all rows and does not depend on the partitioning. Rows are
    first drawn within hash ranges, so that no task sees those of all tasks."""
    rows = points.select(
        F.col(group_col).alias("_group"),
        F.md5(F.col(id_col).cast("string")).alias("_order"),
        F.col(id_col).alias("_id"),
        F.col(vector_col).alias("_vector"),
    )
    salt = F.pmod(F.xxhash64("_id"), F.lit(POOL_ROWS)).alias("_salt")
    for keys in (["_group", "_salt"], ["_group"]):
        order = Window.partitionBy(*keys).orderBy("_order", "_id")
        rows = rows.select("*", salt) if "_salt" not in rows.columns else rows
        rows = rows.withColumn("_place", F.row_number().over(order))
        rows = rows.where(F.col("_place") <= POOL_ROWS)
    drawn = rows.select("_group", "_place", "_vector").toPandas().sort_values(["_group", "_place"])
    return {g: np.vstack(p["_vector"].to_numpy()) for g, p in drawn.groupby("_group")}


def fit_groups(
    points: DataFrame,
    group_col: str,
    id_col: str,
    vector_col: str = "reduced",
    max_clusters: int = MAX_CLUSTERS,
    k: int | None = None,
    rounds: int = ROUNDS,
    tolerance: float = TOLERANCE,
    seed: int = SEED,
    grid=GRID,
) -> dict[Hashable, dict[int, Mixture]]:
    """Fitted mixtures as ``{group: {k: mixture}}``; ``k`` fixes the count.

    ``points`` should be a stored table: it is read once per round, and a pair
    of group and count drops out of the rounds once its gain is small; one that
    is still gaining after the last round is not ``converged``. Many groups are
    fitted a slice at a time. Groups may be numbers or texts; rows without a
    group or a vector have no part.
    """
    points = points.where(F.col(group_col).isNotNull() & F.col(vector_col).isNotNull())
    sizes = {g: int(n) for g, n in points.groupBy(group_col).count().toLocalIterator()}
    names = sorted(sizes)
    options = (max_clusters, k, rounds, tolerance, seed, grid)
    if len(names) <= SLICE_GROUPS:
        return _fit_slice(points, sizes, group_col, id_col, vector_col, *options)
    fitted: dict[int, dict[int, Mixture]] = {}
    for at in range(0, len(names), SLICE_GROUPS):
        some = names[at : at + SLICE_GROUPS]
        held = points.where(F.col(group_col).isin(some))
        part = {g: sizes[g] for g in some}
        fitted |= _fit_slice(held, part, group_col, id_col, vector_col, *options)
    return fitted


def _fit_slice(
    points, sizes, group_col, id_col, vector_col, max_clusters, k, rounds, tolerance, seed, grid
) -> dict[Hashable, dict[int, Mixture]]:
    pools = _pools(points, group_col, id_col, vector_col)
    spark = points.sparkSession
    live: dict[tuple[int, int], Mixture] = {}
    for g, n in sizes.items():
        for c in candidate_counts(n, max_clusters, grid) if k is None else [min(k, n)]:
            live[g, c] = _start(pools[g], c, seed)
    done: dict[tuple[int, int], Mixture] = {}
    source = points.select(F.col(group_col).alias("_group"), F.col(vector_col))
    kind = to_arrow_type(source.schema["_group"].dataType)
    schema = source.select("_group").schema.add("_k", "integer").add("_stats", T.ArrayType(T.DoubleType()))
    for turn in range(rounds):
        # Plain arrays: a broadcast is read without this package.
        sent = spark.sparkContext.broadcast(
            {key: (m.weights, m.means, m.covariances) for key, m in live.items()}
        )

        def run(batches: Iterable[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            wanted: dict[Hashable, list[tuple[int, Mixture]]] = {}
            for (g, c), parameters in sent.value.items():
                wanted.setdefault(g, []).append((c, Mixture(*parameters)))
            fits: dict[Hashable, _Fits] = {}
            added: dict[Hashable, tuple[np.ndarray, np.ndarray]] = {}
            for batch in batches:
                names, rows = batch.column(0).dictionary_encode(), as_matrix(batch.column(1))
                groups = names.indices.to_numpy()
                for code, g in enumerate(names.dictionary.to_pylist()):
                    if g not in wanted:
                        continue
                    if g not in fits:
                        fits[g] = _Fits.of([m for _, m in wanted[g]])
                    new = fits[g].sums(rows[groups == code])
                    old = added.get(g)
                    added[g] = new if old is None else (old[0] + new[0], old[1] + new[1])
            held = {
                (g, c): stats
                for g, sums in added.items()
                for (c, _), stats in zip(wanted[g], fits[g].statistics(*sums))
            }
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([g for g, _ in held], kind),
                    pa.array([c for _, c in held], pa.int32()),
                    pa.array([v.tolist() for v in held.values()], pa.list_(pa.float64())),
                ],
                names=["_group", "_k", "_stats"],
            )

        partials = source.mapInArrow(run, schema)
        summed = sum_rows(partials, ["_group", "_k"], "_stats").toArrow()
        sent.unpersist()
        for g, c, stats in zip(
            summed["_group"].to_pylist(), summed["_k"].to_pylist(), summed["_stats"]
        ):
            now, values, n = live[g, c], stats.values.to_numpy(), sizes[g]
            gain = (values[0] - now.log_likelihood) / n
            now.history = (*now.history, float(values[0]))
            now.log_likelihood = float(values[0])
            now.bic = -2 * values[0] + parameter_count(c, now.means.shape[1]) * math.log(n)
            now.converged = bool(gain < tolerance)
            if now.converged or turn == rounds - 1:
                done[g, c] = live.pop((g, c))
            else:
                live[g, c] = now.updated(values)
        if not live:
            break
    fitted: dict[int, dict[int, Mixture]] = {}
    for (g, c), mixture in done.items():
        fitted.setdefault(g, {})[c] = mixture
    return fitted


def best_by_bic(fitted: dict[int, dict[int, Mixture]]) -> dict[int, Mixture]:
    """The mixture of lowest criterion per group; the fewest components on a tie."""
    return {g: min(by_k.values(), key=lambda m: (m.bic, m.k)) for g, by_k in fitted.items()}


def bic_table(spark, fitted: dict[int, dict[int, Mixture]]) -> DataFrame:
    rows = [
        (
            g, c, m.log_likelihood, float(m.bic),
            m is min(by_k.values(), key=lambda x: (x.bic, x.k)), m.converged,
        )
        for g, by_k in sorted(fitted.items())
        for c, m in sorted(by_k.items())
    ]
    kind = "string" if fitted and isinstance(next(iter(fitted)), str) else "bigint"
    return spark.createDataFrame(
        rows, f"group_id {kind}, k int, log_likelihood double, bic double, chosen boolean, converged boolean",
    )


def soft_assign(
    points: DataFrame,
    mixtures: dict[Hashable, Mixture],
    group_col: str,
    vector_col: str = "reduced",
    threshold: float = THRESHOLD,
    keep_unassigned: bool = False,
    out_col: str = "members",
) -> DataFrame:
    """Add ``array<struct<component, probability>>`` of the components whose
    probability passes the threshold.

    With ten or more components a row may pass in none;
    ``keep_unassigned`` then gives it its likeliest component. A row without a
    vector, or of a group without a mixture, has no members.
    """
    sent = points.sparkSession.sparkContext.broadcast(
        {g: (m.weights, m.means, m.covariances) for g, m in mixtures.items()}
    )

    @F.pandas_udf("array<double>")
    def shares(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        given = {g: Mixture(*parameters) for g, parameters in sent.value.items()}
        for groups, vectors in batches:
            out: list[list[float]] = [[]] * len(groups)
            there = vectors.notna().to_numpy()
            for g in groups[there].unique():
                if g not in given:
                    continue
                at = np.flatnonzero((groups == g).to_numpy() & there)
                rows = np.vstack(vectors.to_numpy()[at]).astype(np.float64)
                for i, row in zip(at, given[g].responsibilities(rows)[0]):
                    out[i] = row.tolist()
            yield pd.Series(out, dtype=object)

    def pair(p, i):
        return F.struct(i.cast("int").alias("component"), p.alias("probability"))

    likely = F.array_max("_shares")
    passing = F.col("_shares")
    chosen = F.filter(F.transform(passing, pair), lambda s: s["probability"] > threshold)
    if keep_unassigned:
        first = F.array_position("_shares", likely).cast("int") - 1
        chosen = F.when(
            (F.size(chosen) == 0) & (F.size("_shares") > 0),
            F.array(F.struct(first.alias("component"), likely.alias("probability"))),
        ).otherwise(chosen)
    return (
        points.withColumn("_shares", shares(F.col(group_col), F.col(vector_col)))
        .withColumn(out_col, chosen)
        .drop("_shares")
    )


def _spread(df: DataFrame, keys: list[str], vector_col: str) -> DataFrame:
    """``(keys, n, mean, variance)`` of whole vectors; the variance is per row."""
    vector = array_to_vector(F.col(vector_col).cast("array<double>"))
    summary = Summarizer.metrics("count", "mean", "variance").summary(vector).alias("_s")
    n = F.col("_s.count")
    return (
        df.where(F.col(vector_col).isNotNull())
        .groupBy(*keys)
        .agg(summary)
        .select(
            *keys,
            n.alias("n"),
            vector_to_array("_s.mean").alias("mean"),
            F.transform(vector_to_array("_s.variance"), lambda v: v * (n - 1) / n).alias("variance"),
        )
    )


def group_gaussians(df: DataFrame, group_col: str, vector_col: str) -> Mixture:
    """One diagonal Gaussian per group as a mixture, weighted by group size.

    Groups become components in ascending order of their value.
    """
    rows = _spread(df, [group_col], vector_col).orderBy(group_col).collect()
    counts = np.array([float(r["n"]) for r in rows])
    spread = [np.diag(np.array(r["variance"]) + RIDGE) for r in rows]
    return Mixture(counts / counts.sum(), np.array([r["mean"] for r in rows]), np.stack(spread))


def single_gaussian_bic(df: DataFrame, vector_col: str) -> DataFrame:
    """One row: the criterion of one diagonal Gaussian, in closed form."""
    term = lambda v: F.log(2 * math.pi * F.greatest(v, F.lit(RIDGE))) + 1
    terms = F.aggregate(F.transform("variance", term), F.lit(0.0), lambda acc, x: acc + x)
    return (
        _spread(df, [], vector_col)
        .select(
            F.col("n").alias("n_rows"),
            F.size("mean").cast("long").alias("n_dims"),
            (-0.5 * F.col("n") * terms).alias("log_likelihood"),
        )
        .withColumn("bic", -2 * F.col("log_likelihood") + 2 * F.col("n_dims") * F.log("n_rows"))
    )
