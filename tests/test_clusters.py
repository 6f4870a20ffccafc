"""Reduction, mixtures, clustering and the tree: invariants and small cases."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from trove.functions.models import ColumnTextModel, FunctionTextModel
from trove.operators import clusters, dense, ivf, mixture, moments, reduce as axes
from trove.operators.ranking import places
from trove.plans import tree
from trove.session import stored


def blobs(n=240, d=16, k=3, seed=3):
    """Well separated directions, so that unit vectors stay separated."""
    rng = np.random.RandomState(seed)
    centres = np.eye(d)[:k] * 10
    which = np.arange(n) % k
    return [(i, (centres[which[i]] + rng.normal(0, 0.4, d)).tolist(), int(which[i])) for i in range(n)]


@pytest.fixture(scope="module")
def points(spark):
    df = spark.createDataFrame(blobs(), "id long, embedding array<double>, truth int")
    return stored(df.withColumn("g", F.lit(0).cast("long")))


@pytest.fixture(scope="module")
def reduced(points):
    return stored(axes.reduce_global(points, 4))


def matrix(df, column):
    return np.array([r[column] for r in df.orderBy("id").collect()])


def test_global_reduction(points, reduced):
    out = matrix(reduced, "reduced")
    assert out.shape == (240, 4)
    spread = out.var(0)
    assert all(spread[i] >= spread[i + 1] - 1e-9 for i in range(3))
    full = matrix(axes.reduce_global(points, 16), "reduced")
    unit = matrix(points, "embedding")
    unit = unit / np.linalg.norm(unit, axis=1, keepdims=True)
    assert np.allclose(full @ full.T, unit @ unit.T, atol=1e-8)


def test_local_reduction_matches_each_group(points):
    out = axes.reduce_local(points, "truth", 3)
    rows = out.orderBy("id").collect()
    for g in range(3):
        mine = [r for r in rows if r["truth"] == g]
        x = np.array([r["embedding"] for r in mine])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        values = np.linalg.eigvalsh(np.cov(x.T, bias=True))[::-1][:3]
        got = np.array([r["reduced"] for r in mine]).var(0)
        assert np.allclose(got, values, atol=1e-9)


def test_group_covariance(points):
    rows = moments.group_covariance(points, "truth", "embedding").collect()
    x = np.array([v for _, v, t in blobs() if t == 1])
    want = np.cov(x.T, bias=True)
    for r in rows:
        if r["truth"] == 1:
            assert abs(r["covariance"] - want[r["i"], r["j"]]) < 1e-9


def test_likelihood_rises_and_three_components_win(reduced):
    fitted = mixture.fit_groups(reduced, "g", "id", grid=(1, 2, 3, 5))
    for m in fitted[0].values():
        assert all(b >= a - 1e-6 * abs(a) for a, b in zip(m.history, m.history[1:]))
        assert abs(m.weights.sum() - 1) < 1e-9
    assert mixture.best_by_bic(fitted)[0].k == 3


def test_one_component_is_the_closed_form(reduced):
    m = mixture.fit_groups(reduced, "g", "id", k=1)[0][1]
    x = matrix(reduced, "reduced")
    assert np.allclose(m.means[0], x.mean(0), atol=1e-9)
    assert np.allclose(m.covariances[0], np.cov(x.T, bias=True) + 1e-6 * np.eye(4), atol=1e-9)


def test_same_fit_for_any_partitioning(reduced):
    one = mixture.fit_groups(reduced.repartition(1), "g", "id", k=3)[0][3]
    many = mixture.fit_groups(reduced.repartition(8), "g", "id", k=3)[0][3]
    assert np.allclose(one.means, many.means, atol=1e-8)
    assert abs(one.bic - many.bic) < 1e-4


def test_memberships(reduced):
    best = mixture.best_by_bic(mixture.fit_groups(reduced, "g", "id", k=3))
    rows = mixture.soft_assign(reduced, best, "g").collect()
    for r in rows:
        assert len(r["members"]) >= 1
        assert all(m["probability"] > 0.1 for m in r["members"])
    shares = mixture.soft_assign(reduced, best, "g", threshold=-1.0).collect()
    assert all(abs(sum(m["probability"] for m in r["members"]) - 1) < 1e-9 for r in shares)
    none = mixture.soft_assign(reduced, best, "g", threshold=2.0)
    assert none.where(F.size("members") > 0).count() == 0
    kept = mixture.soft_assign(reduced, best, "g", threshold=2.0, keep_unassigned=True)
    assert kept.where(F.size("members") != 1).count() == 0


def test_covariance_of_text_and_null_groups(spark):
    rows = [("a", [1.0, 2.0]), ("a", [3.0, 6.0]), (None, [5.0, 5.0]), (None, [5.0, 7.0])]
    df = spark.createDataFrame(rows, "g string, v array<double>").repartition(3)
    got = {(r["g"], r["i"], r["j"]): r["covariance"] for r in moments.group_covariance(df, "g", "v").collect()}
    assert got["a", 0, 0] == pytest.approx(1) and got["a", 0, 1] == pytest.approx(2)
    assert got[None, 1, 1] == pytest.approx(1) and got[None, 0, 0] == pytest.approx(0)


def test_many_groups_are_fitted_in_slices(spark, monkeypatch):
    monkeypatch.setattr(mixture, "SLICE_GROUPS", 2)
    rows = [(g * 10 + i, g, [float(g), float(i)]) for g in range(5) for i in range(4)]
    df = stored(spark.createDataFrame(rows, "id long, g long, reduced array<double>"))
    fitted = mixture.fit_groups(df, "g", "id", k=1)
    assert sorted(fitted) == list(range(5))
    assert all(m[1].converged and np.allclose(m[1].means[0], [g, 1.5]) for g, m in fitted.items())


def test_candidate_counts():
    assert mixture.candidate_counts(1) == [1]
    assert mixture.candidate_counts(12) == list(range(1, 12))
    assert mixture.candidate_counts(10**6)[-1] == 49
    assert mixture.candidate_counts(10**6, grid=range(1, 60)) == list(range(1, 50))


@pytest.mark.parametrize("n,trivial", [(1, True), (11, True), (12, False)])
def test_few_rows_fall_in_one_cluster(spark, n, trivial):
    rows = spark.createDataFrame(blobs(n, 12), "id long, embedding array<double>, truth int")
    out = clusters.cluster(rows, rounds=3)
    assert {r["id"] for r in out.collect()} == set(range(n))
    if trivial:
        assert {r["cluster"] for r in out.collect()} == {0}


def test_clusters_follow_the_blobs_and_copies_share(spark):
    data = blobs(150, 16)
    data += [(1000 + i, v, t) for i, v, t in data[:5]]
    df = spark.createDataFrame(data, "id long, embedding array<double>, truth int")
    out = clusters.cluster(df, k=3, rounds=12)
    members = {}
    for r in out.collect():
        members.setdefault(r["id"], []).append(r["cluster"])
    assert all(len(set(c)) == len(c) for c in members.values())
    for i in range(5):
        assert sorted(members[i]) == sorted(members[1000 + i])
    truth = {i: t for i, _, t in data}
    owners = {}
    for i, found in members.items():
        for c in found:
            owners.setdefault(c, set()).add(truth[i])
    assert len(owners) >= 3 and all(len(t) == 1 for t in owners.values())


def test_offsets(spark):
    counts = spark.createDataFrame([(0, 2), (3, 1), (1, 4)], "g int, n int")
    got = {r["g"]: r["offset"] for r in clusters.cluster_offsets(counts, "g", "n").collect()}
    assert got == {0: 0, 1: 2, 3: 6}


def test_joined_texts_are_whole(spark):
    rows = [(i, f"t{i}", "big" if i % 3 else "small") for i in range(60)]
    df = spark.createDataFrame(rows, "id long, text string, cluster string")
    out = clusters.joined_texts(df, "id", block_rows=25)
    mark = "--- --- \n --- --- "
    parts = {}
    for r in out.orderBy("cluster", "block").collect():
        parts.setdefault(r["cluster"], []).append(r["joined"])
    assert len(parts["small"]) == 1 and len(parts["big"]) == 2
    for name, texts in parts.items():
        assert mark.join(texts) == mark.join(t for _, t, c in rows if c == name)


def test_blocks_follow_places_for_any_key(spark):
    rows = [(f"k{i * 100_000:09d}", f"t{i}", "one" if i % 7 else None) for i in range(300)]
    df = spark.createDataFrame(rows, "id string, text string, cluster string").repartition(5)
    out = clusters.joined_texts(df, "id", block_rows=50).orderBy("cluster", "block").collect()
    assert [(r["cluster"], r["block"]) for r in out] == [(None, 0), *(("one", b) for b in range(6))]
    mark = "--- --- \n --- --- "
    assert mark.join(r["joined"] for r in out[1:]) == mark.join(t for _, t, c in rows if c)


def test_places_of_a_group_that_fills_many_tasks(spark):
    rows = [(i % 3 == 0, i) for i in range(1000)]
    df = spark.createDataFrame(rows, "g boolean, v int").repartition(7)
    got = places(df, "g", [F.desc("v")]).collect()
    for g in (True, False):
        mine = sorted((r["place"], r["v"]) for r in got if r["g"] == g)
        assert mine == list(enumerate(sorted((v for h, v in rows if h == g), reverse=True)))


def test_model_summaries_reach_one_per_cluster(spark):
    rows = [(i, f"w{i}", i % 2) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, text string, cluster int")

    def shorten(prompts):
        return [f" {p.count('w')} " for p in prompts]

    out = clusters.model_summaries(
        df.select("id", "cluster"), df, FunctionTextModel(shorten), "id", block_rows=8
    )
    assert sorted(r["cluster"] for r in out.collect()) == [0, 1]
    one = clusters.model_summaries(df.select("id", "cluster"), df, ColumnTextModel(F.length), "id")
    assert one.count() == 2


def test_equal_vectors_with_a_hot_value(spark):
    rows = [(i, [0.0, 1.0] if i % 3 == 0 else [float(i // 2), 2.0]) for i in range(90)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>")
    got = {r["id"]: (r["first_id"], r["copies"]) for r in clusters.equal_vectors(df).collect()}
    same = {}
    for i, v in rows:
        same.setdefault(tuple(v), []).append(i)
    assert got == {i: (min(same[tuple(v)]), len(same[tuple(v)])) for i, v in rows}


def phrases():
    words = "river stone cloud lantern garden winter signal copper meadow harbour".split()
    out = [f"{words[i % 10]} {words[(i * 3 + 1) % 10]} {words[(i * 7 + 2) % 10]} {i}" for i in range(38)]
    return [*out, out[0], out[5]]


def test_tree_levels_and_copies(spark):
    df = spark.createDataFrame(list(enumerate(phrases())), "id long, text string")
    built = tree.build(df, assign=tree.mixture_assign(rounds=4))
    sizes = {r["level"]: r["count"] for r in built.summaries.groupBy("level").count().collect()}
    assert sorted(sizes) == list(range(1, built.levels + 1)) and built.levels <= 3
    below = len(phrases())
    for n in range(1, built.levels + 1):
        assert sizes[n] <= below
        below = sizes[n]
    first = built.members.where("level = 1").collect()
    of = lambda i: sorted(r["cluster"] for r in first if r["id"] == i)
    assert of(0) == of(38) and of(5) == of(39)
    nodes = tree.flatten(built, df)
    assert nodes.count() == 40 + sum(sizes.values())


def test_tree_stops_at_one_cluster_and_exports_text(spark, tmp_path):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(6)], "id long, text string")
    built = tree.build(df)
    assert built.levels == 1 and built.summaries.count() == 1
    tree.export_text(tree.flatten(built, df), str(tmp_path / "text"))
    back = spark.read.text(str(tmp_path / "text"))
    assert back.where("level = 0").count() == 6 and back.where("level = 1").count() == 1


def test_embed_and_cluster_keeps_every_text(spark):
    df = spark.createDataFrame([(i, f"text number {i}") for i in range(8)], "id long, text string")
    out = tree.embed_and_cluster(df, "id", "text").collect()
    assert all(r["cluster"] == [0] and len(r["embedding"]) == 64 for r in out) and len(out) == 8


# ---- rows without a vector, values that are no numbers, keys of any type


def odd_vectors(spark):
    rng = np.random.RandomState(3)
    rows = [(i, rng.normal(size=4).round(3).tolist(), f"g{i % 3}") for i in range(60)]
    rows += [(100, None, "g0"), (101, None, None), (102, [0.0] * 4, "g1"), (103, [1.0] * 4, None)]
    schema = "id long, embedding array<double>, name string"
    return rows, spark.createDataFrame(rows, schema).repartition(3)


def test_reduction_with_text_groups_and_missing_vectors(spark):
    rows, df = odd_vectors(spark)
    for out in (axes.reduce_global(df, 2), axes.reduce_local(df, "name", 2)):
        got = {r["id"]: r["reduced"] for r in out.collect()}
        assert len(got) == len(rows) and {i for i, v in got.items() if v is None} == {100, 101}
        assert all(len(v) == 2 for v in got.values() if v is not None)
    by_number = df.withColumn("name", F.substring("name", 2, 1).cast("long"))
    same = {r["id"]: r["reduced"] for r in axes.reduce_local(by_number, "name", 2).collect()}
    assert all(v is None or np.allclose(v, same[i]) for i, v in got.items())


def test_mixtures_of_text_groups(spark):
    _, df = odd_vectors(spark)
    points = stored(axes.reduce_global(df, 2))
    by_text = mixture.fit_groups(points, "name", "id", k=2, rounds=5)
    assert sorted(by_text) == ["g0", "g1", "g2"]
    numbers = points.withColumn("name", F.substring("name", 2, 1).cast("long"))
    by_number = mixture.fit_groups(numbers, "name", "id", k=2, rounds=5)
    for g in range(3):
        assert by_text[f"g{g}"][2].log_likelihood == pytest.approx(by_number[g][2].log_likelihood)
    table = mixture.bic_table(spark, by_text)
    assert {r["group_id"] for r in table.collect()} == {"g0", "g1", "g2"}
    rows = mixture.soft_assign(points, mixture.best_by_bic(by_text), "name", keep_unassigned=True)
    sizes = {r["id"]: len(r["members"] or []) for r in rows.collect()}
    assert {i for i, n in sizes.items() if n == 0} == {100, 101, 103}


def test_clusters_and_cells_leave_missing_vectors_out(spark):
    rows, df = odd_vectors(spark)
    found = clusters.cluster(df.select("id", "embedding"), dim=2, k=2, rounds=3, max_clusters=3, keep_unassigned=True)
    assert {r["id"] for r in found.collect()} == {r[0] for r in rows} - {100, 101}
    index = ivf.build(df, 4)
    cells = {r["id"]: r["cell"] for r in index.rows.collect()}
    assert {i for i, c in cells.items() if c is None} == {100, 101} and len(cells) == len(rows)


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
def test_values_that_are_no_numbers_are_no_hits(spark, metric):
    rows = [(1, [1.0, 0.0]), (2, [float("nan"), 1.0]), (3, [0.5, 0.5]), (4, None)]
    df = spark.createDataFrame(rows, "id long, embedding array<double>").coalesce(1)
    assert {r["id"] for r in dense.search(df, [1.0, 0.0], 5, metric).collect()} == {1, 3}
    asked = df.where("id = 1").withColumnRenamed("id", "query_id")
    for k in (1, 2, 5):
        got = dense.knn_join(asked, df, k, metric).collect()
        assert {r["id"] for r in got} == ({1, 3} if k > 1 else {1})


def test_fits_of_a_group_add_up_together():
    """All mixtures of a group in one pass, as by whitened gaps one after another."""
    rng = np.random.default_rng(5)
    rows = rng.normal(size=(3000, 4)) + 3.0
    fits = [mixture._start(rows[:200], k, 1) for k in (1, 2, 7)]
    together = mixture._Fits.of(fits)
    for one, found in zip(fits, together.statistics(*together.sums(rows))):
        shares, total = one.responsibilities(rows)
        outer = np.einsum("nk,ni,nj->kij", shares, rows, rows)
        want = np.concatenate([[total], shares.sum(0), (shares.T @ rows).ravel(), outer.ravel()])
        np.testing.assert_allclose(found, want, rtol=1e-9, atol=1e-9)
