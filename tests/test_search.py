"""Dense, sparse and fused search against brute force."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trove.operators import bm25, dense, descent, fusion, ivf, prep, sparse
from trove.operators.moments import as_matrix
from trove.plans import hybrid
from workload import queries


def vectors(spark, rows, id_type="bigint", id_name="id"):
    return spark.createDataFrame(rows, f"{id_name} {id_type}, embedding array<float>, cell int")


def brute(queries, rows, k, metric, same_cell=False, skip_self=False):
    out = set()
    for q, a, qc in queries:
        scored = []
        for i, b, c in rows:
            if b is None or (same_cell and qc != c) or (skip_self and q == i):
                continue
            x, y = np.float32(a).astype(float), np.float32(b).astype(float)
            if metric == "l2":
                s = round(float(((x - y) ** 2).sum()), 6)
            else:
                s = float(x @ y)
                if metric == "cosine":
                    n = np.linalg.norm(x) * np.linalg.norm(y)
                    s = s / n if n > 0 else 0.0
                s = round(s, 6)
            scored.append((s if metric == "l2" else -s, i, s))
        scored.sort(key=lambda t: t[:2])
        out |= {(q, r, i, s) for r, (_, i, s) in enumerate(scored[:k], 1)}
    return out


def made(n, d, seed, cells=3, copies=0):
    rng = np.random.RandomState(seed)
    grid = rng.randint(-3, 4, size=(n, d)).astype(float)
    grid[: int(n * copies)] = grid[0]
    return [(i, grid[i].tolist(), int(i % cells)) for i in range(n)]


def found(df):
    return {(r[0], r[1], r[2], round(r[3], 6)) for r in df.collect()}


@pytest.mark.parametrize("metric", ["cosine", "l2", "ip"])
@pytest.mark.parametrize("shipped", [10**6, 1])
@pytest.mark.parametrize("cell", [None, "cell"])
def test_knn_join_is_exact(spark, metric, shipped, cell):
    rows = made(90, 4, 1, copies=0.4) + [(500, None, 0)]
    asked = made(25, 4, 2)
    got = dense.knn_join(
        vectors(spark, asked, id_name="query_id").repartition(3),
        vectors(spark, rows).repartition(5),
        7, metric, cell=cell, max_shipped=shipped, block_rows=8,
    )
    assert found(got) == brute(asked, rows, 7, metric, same_cell=cell is not None)


def test_text_keys_and_self(spark):
    rows = [(f"k{i:03d}", v, c) for i, v, c in made(40, 3, 5, copies=0.5)]
    frame = vectors(spark, rows, "string")
    got = found(dense.knn_graph(frame, 4, "l2"))
    assert got == brute(rows, rows, 4, "l2", skip_self=True)
    assert frame.count() == len({q for q, *_ in got})


def test_graph_size_defaults_to_square_root(spark):
    frame = vectors(spark, made(26, 3, 6))
    assert dense.knn_graph(frame).groupBy("query_id").count().where("count <> 5").count() == 0


@pytest.mark.parametrize("metric, kind", [("l2", "bigint"), ("cosine", "string")])
def test_descent_finds_nearly_all_neighbours(spark, metric, kind):
    rng = np.random.RandomState(4)
    key = str if kind == "string" else int
    rows = [(key(1000 + i), rng.normal(size=6).round(3).tolist(), 0) for i in range(500)]
    rows += [(key(2000 + i), rows[0][1], 0) for i in range(4)] + [(key(3000), None, 0)]
    frame = vectors(spark, rows, kind).repartition(3)
    got = found(descent.graph(frame, 5, metric, stretch=16))
    want = brute(rows[:-1], rows, 5, metric, skip_self=True)
    pairs, wanted = ({(q, i, s) for q, _, i, s in x} for x in (got, want))
    assert len(got) == len(want) and len(pairs & wanted) > 0.95 * len(wanted)
    assert not {q for q, *_ in got} & {key(3000)} and all(q != i for q, i, _ in pairs)
    assert {r for _, r, *_ in got} == set(range(1, 6))


def test_descent_of_a_few_rows(spark):
    rows = vectors(spark, made(4, 3, 7))
    assert found(descent.graph(rows, 9, "l2")) == brute(made(4, 3, 7), made(4, 3, 7), 9, "l2", skip_self=True)
    assert descent.graph(rows.where("id = 0"), 3).count() == 0
    assert descent.graph(rows.where("false"), 3).count() == 0


def test_queries_without_a_vector_hide_no_others(spark):
    rows = made(30, 3, 8)
    asked = [(900 + i, None, 0) for i in range(5)] + rows
    got = dense.knn_join(
        vectors(spark, asked, id_name="query_id").coalesce(1), vectors(spark, rows), 2, "l2",
        max_shipped=12, block_rows=7,
    )
    assert found(got) == brute(rows, rows, 2, "l2")


@pytest.mark.parametrize("cell", [None, "cell"])
def test_more_queries_than_are_shipped_copy_no_rows(spark, cell):
    rows, asked = made(90, 4, 1, copies=0.4) + [(500, None, 0)], made(25, 4, 2)
    got = dense.knn_join(
        vectors(spark, asked, id_name="query_id"), vectors(spark, rows).repartition(5), 7, "l2", cell=cell, max_shipped=40
    )
    assert "CoGroup" not in got._jdf.queryExecution().executedPlan().toString()
    assert found(got) == brute(asked, rows, 7, "l2", same_cell=cell is not None)


def test_blocks_of_queries_rank_their_own_hits(spark):
    """No hit travels: the task that holds a query meets all rows."""
    rows = made(60, 4, 3, copies=0.3)
    frame = vectors(spark, rows).repartition(3)
    got = dense.knn_join(frame.withColumnRenamed("id", "query_id"), frame, 7, "cosine", max_shipped=80)
    shown = got._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in shown and "CoGroup" not in shown
    assert found(got) == brute(rows, rows, 7, "cosine")


@pytest.mark.parametrize("shipped", [10**6, 60])
@pytest.mark.parametrize("kind", ["bigint", "string"])
def test_no_copy_of_a_row_is_its_own_neighbour(spark, shipped, kind):
    key = str if kind == "string" else int
    rows = [(key(100 + i % 40), v, c) for i, v, c in made(50, 3, 9)] + [(key(100), [0.0, 0.0, 0.0], 0)]
    frame = vectors(spark, rows, kind).repartition(3)
    got = dense.knn_join(
        frame.withColumnRenamed("id", "query_id"), frame, 6, "l2", exclude_self=True, max_shipped=shipped
    ).collect()
    want = []
    for q in {r[0] for r in rows}:
        pairs = sorted(
            (float(sum((x - y) ** 2 for x, y in zip(a, b))), i)
            for p, a, _ in rows for i, b, _ in rows if p == q and i != q
        )
        want += [(q, n, i, s) for n, (s, i) in enumerate(pairs[:6], 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_neighbours_of_some_rows_among_all(spark):
    rows = made(40, 3, 5)
    got = found(dense.knn_graph(vectors(spark, rows), 4, "l2", of="id % 20 = 0"))
    assert got == brute([r for r in rows if r[0] % 20 == 0], rows, 4, "l2", skip_self=True)


#: Searches that ask for the neighbours of every row, and by how many hits a row; the
#: last ones give one line about all rows.
WHOLE = {
    "knn_graph": 6,
    "pq_scores": 10,
    "ivf_search_label_cells": 10,
    "ivf_full_probe": 10,
    "auto_index_search": 20,
    "pq_recall": 0,
    "knn_graph_descent": 0,
    "ivf_recall": 0,
}


@pytest.mark.parametrize("name", list(WHOLE))
def test_search_asks_for_every_row(spark, tmp_path, name):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=64).tolist(), i % 5) for i in range(1, 46)]
    frame = vectors(spark, rows).withColumnsRenamed({"id": "vec_id", "cell": "label"})
    frame.write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.__dict__[name](spark, str(tmp_path))
    if WHOLE[name]:
        assert sorted(map(tuple, got.groupBy("query_id").count().collect())) == [(r[0], WHOLE[name]) for r in rows]
    else:
        assert got.first()["n_queries"] == len(rows)


def test_best_is_as_sorted():
    """Blocks in any order, with ties, repeated slots and more wanted than there is."""
    rng = np.random.default_rng(3)
    for k in (1, 3, 50):
        best, seen = dense._Best(5, k, 6, 0.0), {}
        for ids in np.split(rng.permutation(36), 6):
            slots = rng.integers(0, 5, 4)
            block = -rng.integers(0, 4, (4, 6)).astype(float) + rng.normal(scale=1e-9, size=(4, 6))
            best.add(slots, block, ids)
            for s, line in zip(slots, block):
                seen.setdefault(s, []).extend((-min(0.0, round(g, 6)), i) for g, i in zip(line, ids))
        for s, pairs in seen.items():
            held = best.gains[s] > -np.inf
            assert list(zip(-best.gains[s][held], best.ids[s][held])) == sorted(pairs)[:k]


def test_no_queries_and_no_rows(spark):
    some, none = vectors(spark, made(5, 3, 7)), vectors(spark, [])
    assert dense.knn_join(none.withColumnRenamed("id", "query_id"), some, 3).count() == 0
    assert dense.knn_join(some.withColumnRenamed("id", "query_id"), none, 3).count() == 0


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(
    st.lists(st.lists(st.integers(-2, 2), min_size=2, max_size=2), min_size=1, max_size=12),
    st.integers(1, 4),
)
def test_ties_go_to_the_lowest_key(spark, values, k):
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(values)]
    got = dense.search(vectors(spark, rows), [1.0, 0.0], k, "l2")
    want = {(r, i, s) for _, r, i, s in brute([(0, [1.0, 0.0], 0)], rows, k, "l2")}
    assert {(r["rank"], r["id"], r["score"]) for r in got.collect()} == want


def test_filtered_product_search(spark):
    """Kites of two shops on a line: filter one shop, then nearest by L2."""
    rows = [
        (i, shop, f"kite {i}", price, [float(at), 0.0])
        for i, shop, price, at in [
            (11, "harbour", 30.0, 0), (12, "harbour", 4.0, 1), (13, "hill", 30.0, 2),
            (14, "harbour", 12.5, 4), (15, "hill", 9.0, 5), (16, "harbour", 80.0, 9),
        ]
    ]
    df = spark.createDataFrame(
        rows, "id long, store_name string, product_name string, price float, embedding array<float>"
    )
    ids = prep.filter_products(df, "harbour", min_price=5).select("id")
    hits = dense.search(dense.restrict(df, ids), [3.0, 0.0], 5, "l2").collect()
    assert [(h["id"], h["score"]) for h in hits] == [(14, 1.0), (11, 9.0), (16, 36.0)]
    assert dense.search(df, [2.2, 0.0], 1, "l2").first()["id"] == 13
    assert prep.filter_products(df).count() == 0
    none = prep.filter_products(df, "market").select("id")
    assert dense.search(dense.restrict(df, none), [1.0, 1.0]).count() == 0
    assert prep.filter_products(df, max_price=0).count() == 0


def test_full_probe_is_exact_and_written_cells_agree(spark):
    rows = vectors(spark, made(120, 5, 9)).drop("cell")
    asked = rows.withColumnRenamed("id", "query_id")
    exact = found(dense.knn_join(asked, rows, 5, "l2"))
    index = ivf.build(rows, 6)
    assert found(ivf.search(asked, index, 5, 6, "l2")) == exact
    assert found(ivf.search(asked, ivf.write(index), 5, 6, "l2")) == exact
    some = found(ivf.search(asked, index, 5, 1, "l2"))
    assert {h[0] for h in some} == {h[0] for h in exact}


def test_auto_index_choice(spark):
    rows = vectors(spark, made(20, 3, 3)).drop("cell")
    index = ivf.build(rows, 2)
    asked = rows.withColumnRenamed("id", "query_id")
    exact = found(ivf.auto_search(asked, rows, k=3))
    assert found(ivf.auto_search(asked, rows, index, k=3, nprobe=2)) == exact
    assert len(found(ivf.auto_search(asked, rows, index, k=3, nprobe=1))) <= len(exact)


@pytest.mark.parametrize("bad", [[1.0, 2.0, 3.0], [1.0, None], None])
def test_uneven_vectors_are_refused(spark, bad):
    """Values of one vector never slip into the next."""
    column = pa.array([[1.0, 2.0], bad], pa.list_(pa.float64()))
    with pytest.raises(ValueError):
        as_matrix(column)
    assert as_matrix(pa.array([[1.0, 2.0], [3.0, 4.0]])).tolist() == [[1, 2], [3, 4]]


DOCS = [
    (1, "red red apple"),
    (2, "green apple and pear"),
    (3, None),
    (4, "Pear, PEAR; plum"),
    (5, ""),
    (6, "the the the the apple"),
]


def bm25_by_hand():
    texts = {i: t.lower().replace(",", "").replace(";", "").split() for i, t in DOCS if t is not None}
    n, mean = len(texts), sum(map(len, texts.values())) / len(texts)
    df = Counter(w for words in texts.values() for w in set(words))
    weights = {
        (i, w): round(c / (c + 1.2 * (1 - 0.75 + 0.75 * len(words) / mean)), 6)
        for i, words in texts.items()
        for w, c in Counter(words).items()
    }
    return n, mean, df, weights


def test_bm25_by_hand(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    n, mean, df, weights = bm25_by_hand()
    model = bm25.fit(docs, "id", "text")
    assert (model.n_docs, model.avg_len) == (n, mean)
    assert {r["term"]: r["df"] for r in model.terms.collect()} == dict(df)
    coded = bm25.encode_documents(docs, model, "id", "text")
    assert {(r["id"], r["term"]): r["weight"] for r in coded.collect()} == weights
    asked = spark.createDataFrame([(1, "apple pear kiwi")], "qid long, text string")
    idf = {w: math.log((n + 1) / (df.get(w, 1) + 0.5)) for w in ("apple", "pear", "kiwi")}
    got = {r["term"]: r["weight"] for r in bm25.encode_queries(asked, model, "qid", "text").collect()}
    assert got == {w: round(v / sum(idf.values()), 6) for w, v in idf.items()}
    maps = bm25.as_maps(coded, "id")
    assert sorted(bm25.from_maps(maps, "id").collect()) == sorted(coded.collect())
    with pytest.raises(ValueError):
        bm25.encode_queries(asked, model, "qid", "text", "other")


def test_sparse_search_small_and_large_query_side(spark):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    asked = spark.createDataFrame([(1, "apple pear"), (2, "plum"), (3, "none")], "qid long, text string")
    model = bm25.fit(docs, "id", "text")
    wanted = bm25.encode_queries(asked, model, "qid", "text")
    postings = bm25.encode_documents(docs, model, "id", "text")
    small = sparse.search(wanted, postings, 2, "qid", "id").collect()
    large = sparse.search(wanted, postings, 2, "qid", "id", max_broadcast_rows=1).collect()
    assert sorted(small) == sorted(large)
    assert {r["qid"] for r in small} == {1, 2}
    whole = hybrid.sparse_search(asked, docs, 2, "qid", "id").collect()
    assert sorted(whole) == sorted(small)


def test_light_terms_are_dropped(spark):
    wanted = spark.createDataFrame(
        [(1, t, w) for t, w in zip("abcde", (0.1, 0.1, 0.3, 0.2, 0.3))] + [(2, "a", 1.0)],
        "qid int, term string, weight double",
    )
    kept = sparse.drop_light_terms(wanted, "qid", 0.2).collect()
    assert {(r["qid"], r["term"]) for r in kept} == {(1, c) for c in "bcde"} | {(2, "a")}


def test_index_drops_below_the_quantile(spark):
    weights = [round(0.01 * i, 6) for i in range(1, 101)]
    postings = spark.createDataFrame([(i, "t", w) for i, w in enumerate(weights)], "id int, term string, weight double")
    cut = float(np.quantile(weights, 0.2))
    kept = [r["weight"] for r in sparse.build_index(postings, 0.2).collect()]
    assert sorted(kept) == [w for w in weights if w >= cut]
    assert sparse.build_index(postings, 0.0).count() == 100


def test_rank_fusion_by_hand(spark):
    a = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q int, rank int, id int")
    b = spark.createDataFrame([(1, 1, 11), (1, 2, 12)], "q int, rank int, id int")
    got = [(r["id"], r["score"]) for r in fusion.fuse([a, b], 3, "q", "id").orderBy("rank").collect()]
    assert got == [(11, round(1 / 61 + 1 / 62, 6)), (10, round(1 / 61, 6)), (12, round(1 / 62, 6))]


def test_best_hit_renames_and_gives_no_row_without_hits(spark):
    hits = spark.createDataFrame([(1, 1, 10), (1, 2, 11)], "q int, rank int, id int")
    things = spark.createDataFrame([(10, "x"), (11, "y")], "id int, name string")
    got = fusion.best_hit(hits, things, {"name": "NAME"}, "q", "id").collect()
    assert [(r["q"], r["NAME"]) for r in got] == [(1, "x")]
    assert fusion.best_hit(hits.where("false"), things, {"name": "NAME"}, "q", "id").count() == 0


def test_hybrid_filter_comes_before_ranking(spark):
    docs = spark.createDataFrame(
        [(1, "apple pie", 1), (2, "apple tart", 0), (3, "plum", 0)], "id long, text string, access int"
    )
    asked = spark.createDataFrame([(7, "apple pie")], "qid long, text string")
    got = hybrid.hybrid_search(asked, docs, "qid", "id", where="access == 0", limit=1).collect()
    assert [r["id"] for r in got] == [2]
    stored = spark.createDataFrame(
        [(1, "a", [1.0, 0.0]), (2, "b", [0.0, 1.0])], "id long, text string, v array<float>"
    )

    class Fixed:
        def embed(self, df, text_col, out_col="embedding"):
            return df.withColumn(out_col, F.array(F.lit(0.0), F.lit(1.0)).cast("array<float>"))

    hits = hybrid.dense_search(asked, stored, 1, "qid", "id", embedder=Fixed(), vector_col="v")
    assert [r["id"] for r in hits.collect()] == [2]


def test_many_queries_look_up_hot_terms(spark, monkeypatch):
    docs = spark.createDataFrame(DOCS, "id long, text string")
    asked = spark.createDataFrame([(i, f"apple pear w{i % 3}") for i in range(9)], "qid long, text string")
    model = bm25.fit(docs, "id", "text")
    plain = sorted(bm25.encode_queries(asked, model, "qid", "text").collect())
    monkeypatch.setattr(bm25, "SMALL_ROWS", 3)
    assert sorted(bm25.encode_queries(asked, model, "qid", "text").collect()) == plain


def test_lookup_is_a_left_join(spark):
    from trove.operators.skew import lookup

    rows = spark.createDataFrame([(i, "a" if i % 3 == 0 else f"k{i}") for i in range(30)], "id int, k string")
    sizes = spark.createDataFrame([("a", 10, 1.0), ("k1", 1, 2.0)], "k string, n int, v double")
    got = lookup(rows, sizes, "k", F.col("n"), F.lit(11), parts=2)
    assert sorted(got.collect()) == sorted(rows.join(sizes, "k", "left").select("id", "k", "n", "v").collect())


def test_texts_are_split_once(spark):
    """Texts without words and filtered ones count in the statistics."""
    rows = [(1, "a b a", "x"), (2, "b c", "y"), (3, "", "x"), (4, None, "x"), (5, "a d", None), (5, "a", "x")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    terms = spark.createDataFrame([("a",), ("b",), ("zz",)], "term string")
    model, counts = bm25.asked_counts(docs, "id", "text", terms, "lang = 'x'")
    want = bm25.fit(docs, "id", "text", terms)
    assert (model.n_docs, model.avg_len) == (want.n_docs, want.avg_len) == (5, 1.6)
    assert sorted(model.terms.collect()) == sorted(want.terms.collect())
    assert sorted(tuple(r) for r in counts.collect()) == [(1, "a", 3, 2), (1, "b", 3, 1), (5, "a", 1, 1)]
