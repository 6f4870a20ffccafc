"""The growing text index: postings by document ranges, segments and collections."""

import math
import random
import uuid
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.functions.models import HashEmbedder
from trove.operators import blockmax, bm25, dense, ivf, pq
from trove.plans import hybrid, segments
from trove.session import path_exists, subfolders, work_path
from trove.sources import collections

WORDS = [f"w{i}" for i in range(60)]


def made(n, seed, first=0):
    rng = random.Random(seed)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    return [
        (first + i, " ".join(rng.choices(WORDS, weights, k=rng.randint(1, 40))), f"src{i % 3}", "en")
        for i in range(n)
    ]


def brute(rows, asked, k, keep=lambda r: True, cut_ratio=0.0):
    """Best ``k`` by BM25; ``rows`` are in force, ``keep`` filters candidates."""
    texts = {r[0]: (r[1] or "").split() for r in rows if r[1] is not None}
    mean = sum(map(len, texts.values())) / max(1, len(texts))
    df = Counter(w for words in texts.values() for w in set(words))
    weight = {
        (i, w): round(c / (c + 1.2 * (0.25 + 0.75 * len(words) / mean)), 6)
        for i, words in texts.items()
        for w, c in Counter(words).items()
    }
    cut = float(np.quantile(list(weight.values()), cut_ratio)) if weight else 0.0
    allowed = {r[0] for r in rows if keep(r)}
    out = set()
    for q, text in asked:
        idf = {w: math.log((len(texts) + 1) / (df.get(w, 1) + 0.5)) for w in set(text.split())}
        share = {w: round(v / sum(idf.values()), 6) for w, v in idf.items()}
        scores = {}
        for (i, w), x in weight.items():
            if w in share and x >= cut and i in allowed:
                scores[i] = scores.get(i, 0.0) + x * share[w]
        best = sorted((-round(s, 6), i) for i, s in scores.items())[:k]
        out |= {(q, place, i, -s) for place, (s, i) in enumerate(best, 1)}
    return out


def hits(df):
    return {(r[0], r[1], r[2], round(r[3], 6)) for r in df.collect()}


def near(got, want):
    """Equal but for a last digit of a score that rounds either way."""
    assert {g[:3] for g in got} == {w[:3] for w in want}
    score = {w[:3]: w[3] for w in want}
    assert all(abs(g[3] - score[g[:3]]) < 2e-6 for g in got)


FIELDS = T.StructType([T.StructField(c, T.StringType()) for c in ("text", "source", "lang")])
SCHEMA = "id long, text string, source string, lang string"
ASKED = [(1, "w0 w5 w40"), (2, "w1 w1 w59 nothing"), (3, "w2 w3 w4 w30 w31 w32 w33")]


@pytest.fixture(scope="module")
def asked(spark):
    return spark.createDataFrame(ASKED, "qid long, text string")


def collection(spark, index="exact", **options):
    name = f"grown_{uuid.uuid4().hex}"
    segments.create(spark, name, FIELDS, index=index, **options)
    return name


@pytest.mark.parametrize("range_postings", [blockmax.RANGE_POSTINGS, 300])
@pytest.mark.parametrize("where", [None, "source = 'src1'", "false"])
def test_stored_search_is_exact(spark, asked, where, range_postings):
    rows = made(400, 1)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    counts = bm25.word_counts(docs, "id", "text", ["source"]).cache()
    path = work_path(spark, "postings")
    blockmax.write_postings(counts, path, "id", ["source"], 5000, range_postings)
    model = bm25.fit(docs, "id", "text")
    wanted = bm25.encode_queries(asked, model, "qid", "text")
    scoring = blockmax.Scoring(model.avg_len)
    postings = spark.read.parquet(path)
    keep = {None: lambda r: True, "false": lambda r: False}.get(where, lambda r: r[2] == "src1")
    for k in (1, 7, 500):
        want = brute(rows, ASKED, k, keep)
        near(hits(blockmax.search(wanted, postings, scoring, k, "qid", "id", where)), want)
    passes = blockmax.search(wanted, postings, scoring, 7, "qid", "id", where, max_asked=3)
    near(hits(passes), brute(rows, ASKED, 7, keep))


def test_each_range_is_a_task_of_its_own(spark):
    rows = [(i, f"a b{i % 3} " + "c " * (i % 200), "s") for i in range(900)] + [(7, "a a d", "s"), (None, "a", "s")]
    docs = spark.createDataFrame(rows, "id long, text string, source string")
    path = work_path(spark, "postings")
    blockmax.write_postings(bm25.word_counts(docs, "id", "text", ["source"]), path, "id", ["source"], 9000, 1000)
    postings = spark.read.parquet(path)
    writers = {f.split("/part-")[1].split("-")[0] for f in postings.inputFiles()}
    assert len(writers) == len(subfolders(spark, path)) == 9
    found = postings.select("_term", F.arrays_zip("_ids", "_tfs", "_lens").alias("_p"), "_tops", "_lows", "source")
    counted = Counter()
    for term, places, tops, lows, source in found.collect():
        held = [(-1 if p["_ids"] is None else p["_ids"], p["_tfs"], p["_lens"]) for p in places]
        assert held == sorted(held) and (source == "s") == (term == "")
        blocks = [held[i : i + blockmax.BLOCK] for i in range(0, len(held), blockmax.BLOCK)]
        assert tops == [max(p[1] for p in b) for b in blocks] and lows == [min(p[2] for p in b) for b in blocks]
        counted.update((term, *p) for p in held)
    want = Counter()
    for i, text, _ in rows:
        words = text.split()
        want.update((w, -1 if i is None else i, c, len(words)) for w, c in [("", 0), *Counter(words).items()])
    assert counted == want


def test_blocks_are_skipped():
    rng = np.random.default_rng(1)
    scoring = blockmax.Scoring(50.0)

    def postings(n, heavy):
        ids = np.sort(rng.choice(100_000, n, replace=False))
        tfs, lens = np.ones(n, np.int64), np.full(n, 60)
        tfs[heavy] = 40
        starts = np.arange(0, n, blockmax.BLOCK)
        return blockmax._List(
            ids, tfs, lens, np.maximum.reduceat(tfs, starts), np.minimum.reduceat(lens, starts), scoring
        )

    lists = [(0.6, postings(200, [5])), (0.01, postings(60_000, [])), (0.3, postings(5_000, list(range(64))))]
    top = blockmax._Top(5)
    held, first = blockmax.score_range(lists, top, lambda ids: ids)
    top_scores, top_ids = sorted(top.scores.tolist()), set(top.ids.tolist())
    again = blockmax._Top(5)
    again.add(top.scores, top.ids + 1_000_000)
    _, second = blockmax.score_range(lists, again, lambda ids: ids)
    # With a floor to beat, far fewer postings are weighed, and the best stay the best.
    assert first <= held and second < held / 10
    assert sorted(again.scores.tolist()) == sorted(2 * top_scores)[-5:]
    exact = {}
    for w, x in lists:
        for i, v in zip(x.ids.tolist(), scoring.weights(x.tfs, x.lens).tolist()):
            exact[i] = exact.get(i, 0.0) + w * v
    best = sorted(exact, key=lambda i: (-round(exact[i], 6), i))[:5]
    assert set(best) == top_ids


def test_only_the_best_rows_are_exchanged(spark, asked):
    index = hybrid.build_index(spark.createDataFrame(made(200, 2), SCHEMA), "id")
    plan = hybrid.search_index_text(asked, index, 3, "qid")._jdf.queryExecution().executedPlan().toString()
    above, below = plan.split("MapInArrow", 1)
    assert below.count("Exchange") == 0 and above.count("Exchange") == 1
    assert "WindowGroupLimit" in above.split("Exchange", 1)[1]
    assert "text" not in below and "_term" in below.split("PushedFilters", 1)[1]
    # One file, and so one task, for each range.
    (part,) = subfolders(spark, f"{index.root}/postings")
    (segment,) = subfolders(spark, f"{index.root}/postings/{part}")
    read = spark.read.parquet(f"{index.root}/postings").select("_range", F.input_file_name().alias("file"))
    ranges = read.distinct().groupBy("_range").count()
    assert {r["count"] for r in ranges.collect()} == {1} and segment.startswith("segment=")


def test_text_keys_and_ties(spark, asked):
    rows = [(f"k{i:02d}", "w0 w5") for i in range(30)] + [("z", None), ("y", "")]
    docs = spark.createDataFrame(rows, "key string, text string")
    index = hybrid.build_index(docs, "key", drop_ratio=0.0)
    got = hybrid.search_index_text(asked.where("qid = 1"), index, 4, "qid").orderBy("rank").collect()
    assert [r["key"] for r in got] == ["k00", "k01", "k02", "k03"]


def test_grown_index_equals_a_fresh_one(spark, asked):
    name = collection(spark, drop_ratio=0.1)
    root = segments.root_of(spark, name)

    def check(rows):
        for where, keep in ((None, lambda r: True), ("source <> 'src0'", lambda r: r[2] != "src0")):
            got = segments.search_text(asked, root, 6, "qid", "id", where=where)
            near(hits(got), brute(rows, ASKED, 6, keep, 0.1))

    assert segments.search_text(asked, root, 6, "qid", "id").count() == 0
    first, second = made(90, 1), made(120, 2, 1000)
    segments.insert(spark.createDataFrame(first, SCHEMA), name)
    check(first)
    segments.insert(spark.createDataFrame(second, SCHEMA), name)
    check(first + second)
    gone = {r[0] for r in first[::3] + second[::4]}
    keys = spark.createDataFrame([(i,) for i in gone] + [(10**9,)], "id long")
    state = segments.delete(spark, name, keys)
    assert state.n_dead == len(gone) and len(state.segments) == 2
    left = [r for r in first + second if r[0] not in gone]
    check(left)
    # The same keys again, with other texts: the deletion does not touch them.
    back = [(i, f"w40 w{i % 60}", "src2", "en") for i in sorted(gone)[:10]]
    segments.insert(spark.createDataFrame(back, SCHEMA), name)
    check(left + back)
    assert segments.delete(spark, name, keys.where("id = 1000000000")).version == 4
    state = segments.merge(spark, name)
    assert len(state.segments) == 1 and state.n_dead == 0
    check(left + back)
    assert {tuple(r) for r in segments.rows(spark, name).select("id", "text").collect()} == {
        r[:2] for r in left + back
    }
    segments.vacuum(spark, name)
    check(left + back)
    assert len(subfolders(spark, f"{root}/forward")) == len(subfolders(spark, f"{root}/manifest")) == 1
    assert spark.table(name).count() == len(left + back)
    spark.sql(f"DROP TABLE {name}")
    assert not path_exists(spark, root)


def test_a_writer_that_died_leaves_no_trace(spark, asked, monkeypatch):
    name = collection(spark)
    rows = made(50, 3)
    segments.insert(spark.createDataFrame(rows, SCHEMA), name)
    root = segments.root_of(spark, name)
    want = hits(segments.search_text(asked, root, 5, "qid", "id"))

    def die(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as broken:
        broken.setattr(segments, "_commit", die)
        with pytest.raises(RuntimeError):
            segments.insert(spark.createDataFrame(made(50, 4, 500), SCHEMA), name)
    assert hits(segments.search_text(asked, root, 5, "qid", "id")) == want
    assert segments.rows(spark, name).count() == 50
    segments.vacuum(spark, name)
    assert spark.table(name).count() == 50
    # Two writers of one version: the second fails.
    state = segments.read_state(spark, root)
    segments._commit(spark, root, state, state.entries, 0.0)
    with pytest.raises(Exception, match="already exists"):
        segments._commit(spark, root, state, state.entries, 0.0)


def test_many_deletions_are_cleared_by_a_merge(spark, asked, monkeypatch):
    monkeypatch.setattr(segments, "MAX_DEAD", 5)
    name, rows = collection(spark, drop_ratio=0.0), made(40, 5)
    segments.insert(spark.createDataFrame(rows, SCHEMA), name)
    state = segments.delete(spark, name, spark.createDataFrame([(i,) for i in range(10)], "id long"))
    assert state.n_dead == 0 and state.n_docs == 30
    got = segments.search_text(asked, segments.root_of(spark, name), 5, "qid", "id")
    near(hits(got), brute(rows[10:], ASKED, 5))


@pytest.mark.parametrize("index", ["cells", "pq", "auto"])
def test_search_by_name_uses_the_recorded_index(spark, asked, index):
    name = collection(spark, index, nlist=4, nprobe=4, metric="l2")
    for seed, first in ((1, 0), (2, 500)):
        segments.insert(spark.createDataFrame(made(60, seed, first), SCHEMA), name)
    segments.delete(spark, name, spark.createDataFrame([(3,), (505,)], "id long"))
    got = hybrid.search_collection(asked, name, "qid", where="source = 'src1'", limit=5, leg_limit=8)
    rows = [r for r in made(60, 1) + made(60, 2, 500) if r[0] not in (3, 505)]
    docs = spark.createDataFrame(rows, SCHEMA)
    want = hybrid.hybrid_search(
        asked, docs, "qid", "id", where="source = 'src1'", limit=5, leg_limit=8, metric="l2"
    )
    # All cells are probed, so that all kinds give the same neighbours. The text
    # legs may differ, as the index drops its lightest weights.
    assert got.count() == want.count() == 15
    assert {r["source"] for r in got.join(docs, "id").collect()} == {"src1"}
    known = collections.settings(spark, name)["index"]
    assert known == ("exact" if index == "auto" else index)
    root = segments.root_of(spark, name)
    state = segments.read_state(spark, root)
    queries = HashEmbedder().embed(asked, "text", "_vector")
    exact = dense.knn_join(
        queries, segments.rows(spark, name).where("source = 'src1'"), 8, "l2", "qid", "id", "_vector", "embedding"
    )
    if known != "exact":
        recorded = collections.settings(spark, name)
        near_ = segments._search_cells(queries, root, state, recorded, 8, "l2", "qid", "source = 'src1'")
        assert hits(near_) == hits(exact)
    assert path_exists(spark, f"{root}/vectors") == (known != "exact")
    assert path_exists(spark, f"{root}/codes") == (known == "pq")


def test_cells_of_later_segments_are_the_nearest(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(50)] + [(99, None)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = ivf.build(frame.where("embedding IS NOT NULL"), 5)
    got = {r["id"]: r["cell"] for r in ivf.assign(frame, index.centroids).collect()}
    centres = {r["cell"]: np.array(r["centroid"]) for r in index.centroids.collect()}
    for i, v in rows[:-1]:
        gaps = {c: float(((np.float32(v) - x) ** 2).sum()) for c, x in centres.items()}
        assert gaps[got[i]] <= min(gaps.values()) + 1e-9
    assert got[99] is None


@pytest.mark.parametrize("metric", ["l2", "cosine", "ip"])
@pytest.mark.parametrize("max_shipped", [10**6, 30])
def test_coded_candidates_are_scored_exactly(spark, metric, max_shipped):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=8).round(2).tolist()) for i in range(150)] + [(900, None), (901, [0.0] * 8)]
    rows += [(i, rows[0][1]) for i in range(300, 310)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>").repartition(3)
    queries = frame.where("id < 12 OR id = 900").withColumnRenamed("id", "query_id")
    index = pq.build(frame, 5, parts=4, metric=metric)
    exact = dense.knn_join(queries, frame, 6, metric)
    found = pq.search(queries, index, 6, 5, rerank=40, max_shipped=max_shipped)
    assert hits(found) == hits(exact)
    some = pq.search(queries, index, 6, 5, rerank=3)
    both = hits(some) & hits(exact)
    assert len(both) > 0.8 * exact.count()
    none = frame.where("false")
    assert pq.search(none.withColumnRenamed("id", "query_id"), index, 6, 5).count() == 0


def test_codes_lie_near_their_vectors(spark):
    rng = np.random.default_rng(6)
    rows = [(i, rng.normal(size=8).tolist()) for i in range(400)]
    frame = spark.createDataFrame(rows, "id long, embedding array<float>")
    index = pq.build(frame, 4, parts=4)
    books, (known, centres) = pq.read_books(index.books), pq._centres(index.centroids)
    given = dict(rows)
    lost = kept = 0.0
    for r in index.codes.collect():
        centre = centres[known.tolist().index(r["cell"])]
        gap = (np.array(given[r["id"]]) - centre).reshape(4, -1)
        code = np.array(bytearray(r["code"]))
        far = ((gap[:, None, :] - books) ** 2).sum(2)
        assert (far[np.arange(4), code] <= far.min(1) + 1e-6).all()
        lost, kept = lost + far.min(1).sum(), kept + (gap**2).sum()
    assert lost < 0.1 * kept


def test_index_choice_by_cost():
    assert pq.choose(500, 64, 1024, 10) == "exact"
    assert pq.choose(2_000_000, 64, 1024, 10) in ("cells", "pq")
    assert pq.choose(10**10, 768, 65_536, 32) == "pq"
    costs = [pq.estimated_cost("exact", n, 64, 16, 4) for n in (10, 1000)]
    assert costs[0] < costs[1]


def test_collections_without_an_index_stay_as_they_were(spark):
    name = f"plain_{uuid.uuid4().hex}"
    collections.create(spark, name, collections.collection_schema(FIELDS, dynamic=False), dim=64)
    assert not segments.is_indexed(spark, name)
    with pytest.raises(ValueError):
        segments.create(spark, name + "x", FIELDS, index="other")
