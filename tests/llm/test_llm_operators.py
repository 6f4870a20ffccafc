"""The training-data operators against brute-force versions on small tables."""

import collections
import itertools
import math
import os
import pickle
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F

from trove.llm import (
    components,
    decontaminate,
    hpylm,
    licenses,
    line_dedup,
    ngram_join,
    packing,
    pii,
    quality,
    rarity,
    setjoin,
    sharding,
    tokens,
    words,
)
from trove.session import shared_dir

BPE = public_tokenizers.path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _key string, token string, fp long"


def make_docs(spark, rows, parts=3):
    """Documents with extra columns whose names clash with inner ones."""
    full = [(i, t, "en", "src", len(t or ""), "x", "y", 7) for i, t in rows]
    return spark.createDataFrame(full, SCHEMA).repartition(parts)


def odd_texts():
    rng = random.Random(3)
    words = ["alpha", "Beta", "gamma", "delta", "eps", "zeta", "eta", "theta", "ünï", "x"]
    base = [rng.choice(words) + str(rng.randint(0, 60)) for _ in range(60)]
    rows = [(None, "null id " * 3), (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "ONE")]
    rows += [(6, "two words"), (6, "two words"), (7, "same id other text"), (7, "a b c d e f g")]
    for k in range(12):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(60)] = f"edit{rng.randint(0, 999)}"
        rows.append((100 + k, "\n".join(" ".join(copy[i : i + 12]) for i in range(0, 60, 12))))
    rows += [(200 + k, " ".join(rng.choices(words, k=rng.randint(1, 9)))) for k in range(60)]
    rows.append((300, "long " + " ".join(str(i % 997) for i in range(30_000))))
    return rows


@pytest.fixture(scope="module")
def odd(spark):
    rows = odd_texts()
    return rows, make_docs(spark, rows)


@pytest.fixture(scope="module")
def none(spark):
    return make_docs(spark, [], 1)


def shingle_set(text, size=5):
    words = (text or "").encode().lower().split()
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1)))


# ---- licences


def test_licences_find_every_place(spark):
    rows = [
        (1, "under the MIT license, UNDER THE mit LICENSE under the mit-license"),
        (2, "Apache License, Version 2.0 and CC BY-NC 4.0"),
        (3, "under the mit"),
        (4, None),
        (5, ""),
        (6, "Redistribution and use in source and binary forms, with or without changes are permitted"),
        (7, "words " * 20_000 + "cc by nc"),
        (7, "words " * 20_000 + "cc by nc"),
        (None, "GNU General Public License"),
    ]
    docs = make_docs(spark, rows)
    got = licenses.summary(licenses.scan(docs, licenses.fit(docs))).collect()
    by = collections.defaultdict(list)
    for r in got:
        by[r.doc_id].append(r)
    assert (by[1][0].n_base, by[1][0].first_word, by[1][0].last_word) == (3, 0, 8)
    assert by[2][0].base_labels == "apache-2,cc-by-nc" and by[2][0].n_base == 2
    assert by[3][0].n_base == 0 and by[3][0].first_word is None and by[3][0].labels == ""
    assert by[4][0].n_words == by[5][0].n_words == 0 and by[4][0].score == 0.0
    assert by[6][0].labels == "bsd" and 0.75 <= by[6][0].score < 1
    assert [r.first_word for r in by[7]] == [20_000, 20_000]
    assert by[None][0].labels == "gpl"
    assert len(got) == len(rows)


def test_licence_plan_is_native(odd, none):
    _, docs = odd
    found = licenses.fit(docs)
    plan = licenses.summary(licenses.scan(docs, found))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas|Exchange", plan.replace("RoundRobinPartitioning", "").split("Physical Plan")[-1].replace("Exchange RoundRobin", "").replace("Exchange (", ""))
    assert licenses.summary(licenses.scan(none, licenses.fit(none))).count() == 0


def test_each_licence_template_matches_itself(spark):
    rows = [(i, " ".join(t.words)) for i, t in enumerate(licenses.templates())]
    docs = make_docs(spark, rows)
    got = {r.doc_id: r for r in licenses.summary(licenses.scan(docs, licenses.fit(docs))).collect()}
    for i, t in enumerate(licenses.templates()):
        assert t.label in got[i].labels.split(",") and got[i].score == pytest.approx(1)


# ---- packing and tokens


def reference_ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(BPE).encode(text or "", add_special_tokens=False).ids


def test_first_fit_decreasing_is_the_plain_one():
    rng = np.random.default_rng(1)
    for n in (0, 1, 2, 3, 50, 257):
        sizes = rng.integers(1, 101, n)
        bins, offsets = packing.first_fit_decreasing(sizes, 100)
        room = []
        for i in sorted(range(n), key=lambda i: (-sizes[i], i)):
            k = next((k for k, free in enumerate(room) if free >= sizes[i]), None)
            if k is None:
                room.append(100)
                k = len(room) - 1
            assert (bins[i], offsets[i]) == (k, 100 - room[k])
            room[k] -= sizes[i]


def test_packing_covers_each_document_once(odd, none):
    rows, docs = odd
    got = packing.pack(docs, BPE, group_pieces=20).toPandas()
    want = collections.Counter()
    for i, t in rows:
        ids = [*reference_ids(t), 1]
        for start in range(0, len(ids), 2048):
            piece = ids[start : start + 2048]
            want[(i, start, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes()), len(ids))] += 1
    have = collections.Counter(
        (None if math.isnan(r.doc_id) else int(r.doc_id), r.start, r.length, r.ids_crc32, r.doc_tokens)
        for r in got.itertuples()
    )
    assert have == want
    for _, seq in got.sort_values("offset").groupby("sequence_id"):
        assert seq.offset.tolist() == [0, *seq.length.cumsum().tolist()[:-1]]
        assert seq.length.sum() <= 2048
    assert packing.pack(none, BPE).count() == 0


def test_parts_encode_as_whole_texts():
    rng = random.Random(5)
    bits = ["a", " ", "  ", "\n", "\n\n", "\t", "\xa0", "é", "12", "'s", "!", "<|endoftext|>", "　", "\x1c", "日", "\0", " the", "\nOf", " x,"]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(3000)]
    cache = tokens.PartCache(tokens.Encoder(BPE))
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(BPE)
    got = [x for i in range(0, 3000, 300) for x in cache(texts[i : i + 300])]
    for text, ids in zip(texts, got, strict=True):
        assert "".join(tokens.parts(text)) == text
        assert np.frombuffer(ids, "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_token_counts(odd, none, monkeypatch):
    rows, docs = odd
    got = collections.Counter(map(tuple, tokens.token_counts(docs, BPE).collect()))
    want = collections.Counter()
    for i, t in rows:
        n = len(reference_ids(t))
        want[(i, len((t or "").encode()), n, n > 1024)] += 1
    assert got == want
    assert tokens.token_counts(none, BPE).count() == 0


def test_token_cache_forgets_and_stays_right(monkeypatch):
    monkeypatch.setattr(tokens, "CACHE_PARTS", 3)
    cache = tokens.PartCache(tokens.Encoder(BPE))
    for text in ["a b c d e f", "d e f g", "a b", "d " + "z" * 200, "a b c"] * 3:
        assert np.frombuffer(cache([text])[0], "<u4").tolist() == reference_ids(text)


# ---- near duplicates



def test_words_are_encoded_once_whatever_mark_ends_them():
    encoder, asked = tokens.Encoder(BPE), []
    encode = encoder.ids
    encoder.ids = lambda some: asked.extend(some) or encode(some)
    cache = tokens.PartCache(encoder)
    texts = ["a seldom. seldom, seldom\nseldom; é. 9. it's. x.. \t seldom!", "", ".", " seldom? a.b.", "\n."]
    for text, ids in zip(texts * 2, cache(texts) + cache(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == reference_ids(text)
    assert len(asked) == len(set(asked)) and asked.count(" seldom") == 1
    assert not {" seldom.", " seldom,", " seldom?"} & set(asked)


def brute_components(rows):
    sets = [shingle_set(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
            parent[root(a)] = root(b)
    groups = collections.defaultdict(list)
    for k, (i, _) in enumerate(rows):
        groups[root(k)].append((i is not None, i or 0))
    out = collections.Counter()
    for k, (i, _) in enumerate(rows):
        there, least = min(groups[root(k)])
        out[(i, len(sets[k]), least if there and sets[k] else i)] += 1
    return out


def test_near_duplicates_match_brute_force(odd, none):
    rows, docs = odd
    got = collections.Counter(map(tuple, ngram_join.near_duplicates(docs).collect()))
    assert got == brute_components(rows)
    assert ngram_join.near_duplicates(none).count() == 0


def test_links_across_a_list_leader(spark):
    """Chains and stars in one posting list, where most pairs do not link."""
    rng = random.Random(11)
    base = [f"w{k}" for k in range(120)]
    rows = []
    for k in range(60):
        copy = list(base)
        for _ in range(rng.randint(0, 5)):
            copy[rng.randrange(120)] = f"e{rng.randint(0, 10**6)}"
        rows.append((k, " ".join(copy)))
    for k in range(40):
        rows.append((100 + k, " ".join(base[:30] + [f"own{k}_{j}" for j in range(90)])))
    docs = make_docs(spark, rows)
    assert collections.Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute_components(rows)


@pytest.mark.parametrize("edge", [0, 3, 6, 9])
def test_small_sets_give_the_same_result_at_any_boundary(spark, monkeypatch, edge):
    monkeypatch.setattr(ngram_join, "boundary", lambda rare, percent=80: edge)
    rng = random.Random(edge)
    base = [f"w{k}" for k in range(14)]
    rows = []
    for k in range(80):
        n = rng.randint(1, 14)
        copy = base[:n]
        if rng.random() < 0.4:
            copy[rng.randrange(n)] = f"x{rng.randint(0, 2)}"
        rows.append((k, " ".join(copy)))
    docs = make_docs(spark, rows)
    assert collections.Counter(map(tuple, ngram_join.near_duplicates(docs).collect())) == brute_components(rows)


def test_keep_first_keeps_one_of_each_group(odd):
    rows, docs = odd
    kept = ngram_join.keep_first(docs)
    assert kept.columns == docs.columns
    left = [(r.doc_id, r.text) for r in kept.collect()]
    groups = brute_components(left)
    assert all(n == 1 and i == c for (i, size, c), n in groups.items() if size)
    assert sum(not (t or "").split() for _, t in left) == sum(not (t or "").split() for _, t in rows)


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 101), (101, 100), (200, 200)]
    got = components.components(spark.createDataFrame(edges, "a long, b long"))
    labels = {r.node: r.label for r in got.collect()}
    assert labels == {**{k: 0 for k in range(41)}, 100: 100, 101: 100, 200: 200}


def test_overlap_bounds():
    for a in range(1, 60):
        for b in range(a, 60):
            fits = [o for o in range(a + 1) if 100 * o >= 80 * (a + b - o)]
            assert setjoin.overlap_needed(a, b) == (fits[0] if fits else setjoin.overlap_needed(a, b))
            if fits:
                assert b in ngram_join.partner_sizes(a, 80)


# ---- line dedup


def brute_lines(rows):
    lines = []
    order = sorted({(i is not None, i or 0, t) for i, t in rows if t})
    at = {}
    for _, i, t in order:
        for n, line in enumerate(t.encode().lower().split(b"\n")):
            words = frozenset(line.split())
            if len(words) >= line_dedup.LEAST_WORDS:
                lines.append((i, t, n, words))
    gone = set()
    for k, (i, t, n, words) in enumerate(lines):
        if any(100 * len(words & o[3]) >= 80 * len(words | o[3]) for o in lines[:k]):
            gone.add((i, t, n))
    del at
    return gone


def test_sets_of_many_lines_are_made_together():
    texts = [(t or "").encode() for _, t in odd_texts()] + [b"\n\na b a\n", b"", b"B a", b"x\n\ny x y\n \nz"]
    got = {}
    for owners, units, sizes, flat in line_dedup.line_sets(texts):
        for i, unit, one in zip(owners.tolist(), units.tolist(), np.split(flat, np.cumsum(sizes)[:-1]), strict=True):
            assert (i, unit) not in got and (np.diff(one) > 0).all()
            got[i, unit] = set(one.view(np.int64).tolist())
    lines = {(i, n): x.lower().split() for i, t in enumerate(texts) for n, x in enumerate(t.split(b"\n"))}
    hashes = {w: words.word_hash(w) for x in lines.values() for w in x}
    assert got == {k: {hashes[w] for w in x} for k, x in lines.items() if x}
    assert list(line_dedup.line_sets([])) == []


def test_hashes_of_one_set_are_not_posted():
    """Prefixes by level and then hash; what only one set holds is left out and counted."""
    rng = np.random.default_rng(5)
    sizes = rng.integers(0, 70, 300)
    sizes[:4] = 0, 1, 64, 65
    flat = np.concatenate([np.sort(rng.choice(1 << 60, n, replace=False)) for n in sizes]).astype(np.uint64)
    levels = rng.choice([8, 8, 12, 16, 255], len(flat)).astype(np.uint8)
    wanted = rng.random(300) < 0.8
    skip, ends, posted = setjoin.prefixes(flat, sizes, wanted, levels)
    stops = np.cumsum(sizes)
    for k in range(300):
        own = sorted(zip(levels[stops[k] - sizes[k] : stops[k]].tolist(), flat[stops[k] - sizes[k] : stops[k]].tolist()))
        first = own[: setjoin.prefix_length(int(sizes[k]))] if wanted[k] and sizes[k] else []
        assert posted[ends[k] : ends[k + 1]].tolist() == [h for level, h in first if level > rarity.SINGLE]
        assert skip[k] == sum(level <= rarity.SINGLE for level, _ in first)
    assert rarity.Rarity(np.array([0, 1, 2, 3]), np.zeros(1)).levels[:3].tolist() == [0, rarity.SINGLE, 12]


def test_line_dedup_matches_brute_force(spark, none):
    rows = [r for r in odd_texts() if r[0] != 7] + [
        (400, "A b c d e f\na b c d e f\nshort"),
        (401, "short\n\nf e d c b a"),
        (402, "a b c d e f"),
        (402, "a b c d e f"),
    ]
    docs = make_docs(spark, rows)
    gone = brute_lines(rows)
    got = line_dedup.removed_lines(docs).collect()
    assert {(r.doc_id or 0, r.line) for r in got} == {(i, n) for i, _, n in gone}
    cleaned = line_dedup.dedup_lines(docs)
    assert cleaned.columns == docs.columns
    want = collections.Counter()
    for i, t in rows:
        lines = (t or "").split("\n")
        left = [x for n, x in enumerate(lines) if (i or 0, t, n) not in gone]
        text = None if t is None else "\n".join(left)
        if len(left) == len(lines) or text.split():
            want[(i, text)] += 1
    assert collections.Counter((r.doc_id, r.text) for r in cleaned.collect()) == want
    assert line_dedup.removed_lines(none).count() == 0 and line_dedup.dedup_lines(none).count() == 0


@pytest.mark.parametrize("percent", [80, 60])
def test_short_lines_are_deduplicated(spark, percent):
    """Lines of any number of words; four words match the same with one more."""
    rng = random.Random(8)
    words = ["home", "about", "Help", "legal", "jobs", "x", "y"]
    rows = [(1, "Home\nabout us\n\na b c d"), (2, "home\nHOME home\nus about\n\na b c d e"), (3, "menu " * 40)]
    rows += [(4, "MENU\n \nfooter"), (5, "a b c"), (6, "footer\na b c d f")]
    rows += [(10 + k, "\n".join(" ".join(rng.choices(words, k=rng.randint(0, 7))) for _ in range(4))) for k in range(60)]
    lines = [(i, n, frozenset(x.split())) for i, t in rows for n, x in enumerate(t.lower().split("\n")) if x.split()]
    gone = {
        (i, n)
        for k, (i, n, x) in enumerate(lines)
        if any(100 * len(x & y) >= percent * len(x | y) for _, _, y in lines[:k])
    }
    got = line_dedup.removed_lines(make_docs(spark, rows), percent=percent).collect()
    assert {(r.doc_id, r.line) for r in got} == gone and len(got) == len(gone)
    assert {(2, 0), (2, 1), (2, 2), (4, 0)} <= gone and ((2, 4) in gone) == (percent <= 80)


# ---- decontamination


def test_decontamination_matches_brute_force(spark, none):
    rng = random.Random(2)
    words = [f"w{k}" for k in range(40)]
    items = [(k, " ".join(rng.choices(words, k=rng.choice([3, 5, 9, 30, 70])))) for k in range(30)]
    items += [(30, None), (31, ""), (None, "null item with six whole words"), (5, items[5][1])]
    rows = [(1, None), (2, ""), (None, "x " + items[3][1])]
    for k in range(80):
        text = rng.choices(words, k=rng.randint(1, 400))
        for _ in range(rng.randint(0, 2)):
            part = (rng.choice(items)[1] or "").split()
            if part and rng.random() < 0.5:
                part[rng.randrange(len(part))] = "changed"
            at = rng.randrange(len(text) + 1)
            text[at:at] = part
        rows.append((10 + k, " ".join(text)))
    rows += [(500, items[0][1]), (500, items[0][1])]
    docs = make_docs(spark, rows)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = collections.Counter()
    for i, t in rows:
        have = shingle_set(t)
        for j, u in items:
            wanted = shingle_set(u)
            both = len(have & wanted)
            if wanted and 100 * both >= 80 * len(wanted):
                want[(i, j, both, len(wanted))] += 1
    for limit in (10**6, 200):
        got = decontaminate.contained_items(docs, bench, slice_shingles=limit)
        assert collections.Counter(map(tuple, got.collect())) == want
    clean = decontaminate.decontaminate(docs, bench)
    assert clean.columns == docs.columns
    dirty = {i for i, *_ in want}
    assert {r.doc_id for r in clean.collect()} == {i for i, _ in rows} - dirty
    assert decontaminate.contained_items(none, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).count() == len(rows)


# ---- sharding


def test_hilbert_curve_is_continuous():
    for dims, bits in ((2, 4), (3, 3), (4, 2), (1, 5)):
        side = 1 << bits
        cells = np.array(list(itertools.product(range(side), repeat=dims)))
        place = sharding.hilbert_index(cells, bits)
        assert sorted(place) == list(range(side**dims))
        path = cells[np.argsort(place)]
        assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_shards_are_even_and_gapless(odd, none):
    rows, docs = odd
    got = sharding.shard(docs, ["lang", "source", "n_chars"], shards=7).toPandas()
    sizes = got.groupby("shard").size()
    assert len(got) == len(rows) and sizes.max() - sizes.min() <= 1 and len(sizes) == 7
    for _, one in got.groupby("shard"):
        assert sorted(one.slot) == list(range(len(one)))
    assert got.sort_values(["shard", "slot"]).place.is_monotonic_increasing
    want = collections.Counter((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t in rows)
    assert collections.Counter(zip(got["size"], got.text_crc32)) == want
    assert sharding.shard(none, ["lang"]).count() == 0


def test_one_value_in_all_rows_still_shards(spark):
    docs = make_docs(spark, [(1, "same")] * 100)
    got = sharding.shard(docs, ["lang", "source"], shards=10).groupBy("shard").count().collect()
    assert [r["count"] for r in got] == [10] * 10


# ---- quality


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    runs = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    times = collections.Counter(runs)
    cover = {j for i, r in enumerate(runs) if times[r] > 1 for j in range(i, i + 8)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(cover)


def test_quality_counts_and_base_rules(odd, none):
    rows, docs = odd
    trees = quality.fit_trees(np.empty((0, 9)), np.empty(0), tuple(quality.FEATURES.values()))
    got = collections.Counter(
        (r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in quality.judge(docs, trees).collect()
    )
    want = collections.Counter()
    for i, t in rows:
        n = brute_counts(t or "")
        want[(i, *n, n[0] < 20 or 100 * n[4] > 30 * n[0])] += 1
    assert got == want
    assert quality.judge(none, trees).count() == 0
    assert quality.keep_good(docs, trees).columns == docs.columns


def test_trees_learn_and_are_monotonic():
    rng = np.random.default_rng(4)
    x = rng.random((4000, 9))
    y = ((x[:, 2] < 0.4) & (x[:, 7] > 0.2)).astype(float)
    y = np.where(rng.random(4000) < 0.03, 1 - y, y)
    signs = tuple(quality.FEATURES.values())
    trees = quality.fit_trees(x[:3000], y[:3000], signs)
    held = trees.score(x[3000:])
    assert ((held > 0.5) == (y[3000:] > 0.5)).mean() > 0.93
    for f, sign in enumerate(signs):
        if sign:
            grid = np.repeat(x[:50], 40, axis=0)
            grid[:, f] = np.tile(np.linspace(0, 1, 40), 50)
            steps = np.diff(trees.score(grid).reshape(50, 40), axis=1)
            assert (sign * steps >= -1e-12).all()


def test_quality_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    trees = quality.fit(docs, labels.where("doc_id % 4 <> 0"))
    held = quality.judge(docs, trees).join(labels.where("doc_id % 4 = 0"), "doc_id").toPandas()
    good = (held.score >= quality.THRESHOLD) == (held.quality == 1)
    assert good.mean() > 0.97


# ---- personal data


def test_pii_matches_plain_patterns(spark, none):
    rng = random.Random(6)
    bits = ["a.b@c.de", "@", "x@y.z-", ".", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111111111111112", "+1 (706) 555-3138", "+", "-", " ", "é", "123-45-6789", "9", "a"]
    texts = [None, "", *("".join(rng.choices(bits, k=rng.randint(1, 12))) for _ in range(400))]
    docs = make_docs(spark, [*enumerate(texts), (5, texts[5])])
    got = {r.doc_id: r for r in pii.find_pii(docs).collect()}
    patterns = [
        r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
        r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
        r"[0-9]([\x20-]?[0-9])+",
        r"\+[0-9][\x20().0-9-]+[0-9]",
    ]
    for i, text in enumerate(texts):
        spans = []
        for k, pattern in enumerate(patterns):
            for m in re.finditer(pattern, text or ""):
                digits = re.sub("[^0-9]", "", m[0])
                ok = (
                    True,
                    all(int(x) < 256 for x in m[0].split(".")) if k == 1 else True,
                    14 <= len(digits) <= 19 and pii.luhn(digits),
                    10 <= len(digits) <= 15,
                )[k]
                if ok:
                    spans.append((m.start(), k, m.end()))
        assert got[i].base_spans == pii.written(spans)
        assert set(got[i].base_spans.split(",")) - {""} <= set(got[i].spans.split(","))
    assert pii.find_pii(none).count() == 0


def test_pii_checks_and_context():
    assert pii.mod97("DE89370400440532013000") and not pii.mod97("DE89370400440532013001")
    assert pii.luhn("4111111111111111") and not pii.luhn("4111111111111112")

    def kinds(text):
        return [pii.KINDS[k] for _, k, _ in pii.added_spans(text)]

    assert kinds("IBAN DE89 3704 0044 0532 0130 00.") == ["iban"]
    assert kinds("DE89 3704 0044 0532 0130 01") == []
    assert kinds("SSN 123-45-6789") == ["ssn"] and kinds("order 123-45-6789") == []
    assert kinds('token = "' + "0a" * 20 + '"') == ["secret"] and kinds("0a" * 20) == []
    assert pii.redact("mail a@b.de now") == "mail [email] now"


def test_iban_before_a_capital_word():
    """A number ends where it checks, also when a capital word could belong to it."""

    def found(text):
        return [text[a:b] for a, k, b in pii.added_spans(text) if pii.KINDS[k] == "iban"]

    plain = ["ES9121000418450200051332", "AT611904300234573201", "AT61 1904 3002 3457 3201", "DE89370400440532013000"]
    for number in plain:
        for after in ("", " EUR", " BIC", " BANK", " EUR BANK", " A", " EUROPE", "."):
            assert found(f"pay {number}{after}") == [number]
    assert found("AB12 AT61 1904 3002 3457 3201") == ["AT61 1904 3002 3457 3201"]
    assert found(" ".join(plain[:2])) == plain[:2]
    assert found("AT611904300234573202 EUR") == []


def test_ip_parts_of_any_length(spark):
    texts = ["1" * 5000 + ".1.1.1", "1.1.1." + "9" * 5000, "0" * 5000 + "255.1.1.1", "0256.1.1.1", "000.00.0.0255"]
    docs = make_docs(spark, list(enumerate(texts)))
    got = {r.doc_id: r.base_spans for r in pii.find_pii(docs).collect()}
    assert got == {0: "", 1: "", 2: "ip:0:5009", 3: "", 4: "ip:0:13"}


def test_texts_are_decoded_range_by_range(monkeypatch):
    """No more than a range of a batch is held as strings, and a long text is alone or last."""
    monkeypatch.setattr(tokens, "BATCH_BYTES", 100)
    texts = ["\u00fc" * 30, "", "a" * 50, "b" * 500, "c", "\u4e2d" * 40, "d" * 30]
    for column in (pa.array(texts), pa.array(texts, pa.large_string()), pa.array(["x", *texts])[1:]):
        ranges = list(tokens.decoded(column))
        assert [low for low, _ in ranges] == [0, 3, 4, 6]
        assert [x for _, some in ranges for x in some] == texts
    assert list(tokens.decoded(pa.array([], pa.string()))) == []


def test_freed_memory_goes_back(monkeypatch):
    """After each batch of texts, whatever step worked on them."""
    calls = []
    for module in (tokens, quality):
        monkeypatch.setattr(module, "give_back", lambda: calls.append(1))
    assert len(list(tokens.decoded(pa.array(["a", "b"])))) == 1 and len(calls) == 1
    quality._counts([b"some words", b""])
    assert len(calls) == 2
    # Tasks are sent the function with what it names.
    pickle.loads(cloudpickle.dumps(words.give_back))()


# ---- language model


def test_base_scores_and_normalised_model(odd, none, spark):
    rows, docs = odd
    train = docs.where("doc_id % 3 <> 0")
    model, table = hpylm.fit(train, head_words=8, shipped_words=20)
    got = hpylm.score(docs, model, table).toPandas()
    counts = collections.Counter()
    for i, t in rows:
        if i is not None and i % 3:
            counts.update((t or "").encode().lower().split())
            counts[b" "] += 1
    total, kinds = sum(counts.values()), len(counts)
    assert (model.tokens, model.distinct) == (total, kinds)
    want = collections.defaultdict(list)
    for i, t in rows:
        words = [*(t or "").encode().lower().split(), b" "]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in words)
        want[i].append((len(words), sum(counts[w] > 0 for w in words), round(base, 6)))
    have = collections.defaultdict(list)
    for r in got.itertuples():
        have[None if math.isnan(r.doc_id) else int(r.doc_id)].append((r.n_tokens, r.n_known, round(r.base_score, 6)))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    assert (10.0**model.after).sum(axis=1) == pytest.approx(1)
    shipped = model.tail[model.dish == model.head + 1]
    beyond = table.select("lp").toPandas()["lp"].to_numpy()
    assert (10.0**shipped).sum() + (10.0**beyond).sum() + 10.0**model.tail_unseen == pytest.approx(1)
    assert np.isfinite(got.score).all() and hpylm.score(none, model, table).count() == 0


def test_sweeps_leave_one_table_of_each_kind(spark):
    """What a sweep wrote goes when the next one has read it; what scoring reads stays."""
    docs = make_docs(spark, [(k, f"a b c{k % 5} a b") for k in range(20)])
    before = set(os.listdir(shared_dir(spark)))
    model, table = hpylm.fit(docs, head_words=2, shipped_words=4)
    left = [x.rsplit("-", 1)[0] for x in os.listdir(shared_dir(spark)) if x not in before]
    assert sorted(left) == ["pairs", "parent", "seats"]
    assert spark.conf.get("spark.sql.classic.shuffleDependency.fileCleanup.enabled") == "false"
    assert hpylm.score(docs, model, table).count() == 20
    assert table.count() == model.distinct - len(model.words)


def test_model_of_nothing(odd, none):
    model, table = hpylm.fit(none)
    got = hpylm.score(odd[1], model, table).toPandas()
    assert np.isfinite(got.score).all() and (got.base_score == 0).all() and (got.n_known == 0).all()


def test_scores_of_stored_pairs_without_a_copy_of_the_words(spark):
    """Pairs of shipped words and all others give what the model says of them; no text's words are stored."""
    train = [f"the a{k % 7} of b{k % 5} z{k} z{k} the of" for k in range(40)] + ["", "the of", None]
    texts = [*train, "of a3 never b2 z3", "never never", "z3 z3 z3 the"]
    docs = make_docs(spark, list(enumerate(train)))
    before = set(os.listdir(shared_dir(spark)))
    model, table = hpylm.fit(docs, head_words=2, shipped_words=14)
    counts, pairs = collections.Counter(), collections.Counter()
    hashed = lambda t: [*(hpylm.word_hash(w.encode()) for w in (t or "").split()), hpylm.END_HASH]
    for t in train:
        words = hashed(t)
        counts.update(words)
        pairs.update(zip([hpylm.END_HASH, *words[:-1]], words, strict=True))
    found = model.pairs.collect()
    assert sorted((r.u, r.w) for r in found) == sorted(pairs)
    net = {(r.u, r.w): r.net for r in found}
    assert all(0 < net[k] < c for k, c in pairs.items())
    class_lp = model.after[-1, -1]
    root = 10 ** (model.after[-1, model.dish] + model.tail)
    known = {h: (s, r) for h, s, r in zip(model.words.tolist(), model.spare, root, strict=True)}
    known |= {r.h: (r.spare, 10 ** (class_lp + r.lp)) for r in table.collect()}
    assert set(known) == set(counts)
    unseen = (1.0, 10 ** (class_lp + model.tail_unseen))
    got = {r.doc_id: r.score for r in hpylm.score(make_docs(spark, list(enumerate(texts))), model, table).collect()}
    for i, t in enumerate(texts):
        words, total = hashed(t), 0.0
        for u, w in zip([hpylm.END_HASH, *words[:-1]], words, strict=True):
            p = net.get((u, w), 0) / (hpylm.STRENGTH + counts[u]) + known.get(u, unseen)[0] * known.get(w, unseen)[1]
            total += math.log10(p)
        assert got[i] == pytest.approx(total)
    left = sorted(x.rsplit("-", 1)[0] for x in os.listdir(shared_dir(spark)) if x not in before)
    assert left == ["judged", "pairs", "parent", "seats"]


def test_seats_follow_the_restaurant():
    """All dishes at once as a customer at a time, parties included; one customer has one table."""
    rng = np.random.default_rng(0)
    customers, others, parent, off = np.repeat([1, 2, 9, 700], 2000), 30.0, 0.01, 0.7
    got = hpylm.reseat(rng.permutation(customers), others, parent, off, rng)
    assert got.min() == 1 and len(got) == len(customers)
    got = hpylm.reseat(customers, others, parent, off, rng).reshape(4, -1).mean(axis=1)
    want = np.ones((4, 2000))
    for sat in range(1, 700):
        more = (np.array([1, 2, 9, 700]) > sat)[:, None]
        new = (hpylm.STRENGTH + off * (others + want)) * parent
        want += more & (rng.random(want.shape) < new / (new + sat - off * want))
    assert got == pytest.approx(want.mean(axis=1), rel=0.04)


def test_words_are_found_by_their_first_bits():
    rng = np.random.default_rng(1)
    some = np.unique(rng.integers(-(1 << 63), (1 << 63) - 1, 5000))
    close = np.arange(1 << 40, (1 << 40) + 50)
    words = np.unique(np.concatenate([some[::2], close[::2]]))
    asked = np.concatenate([some, close, [(1 << 63) - 1, -(1 << 63)]])
    at, known = hpylm.Places(words).find(asked)
    assert known.tolist() == np.isin(asked, words).tolist() and (words[at[known]] == asked[known]).all()
    assert not hpylm.Places(words[:0]).find(asked)[1].any()


def test_pairs_beyond_the_head_keep_both_words(spark):
    """Rare words as context and as next word; everything after a context adds up to 1."""
    texts = [f"the x{k} y{k} of z" for k in range(30)] * 2 + ["the of the z"] * 20
    docs = make_docs(spark, list(enumerate(texts)))
    asked = make_docs(spark, [(0, "x3 y3"), (1, "x3 y4"), (2, "x3 never"), (3, "never y3")])
    for shipped in (1000, 4):
        model, table = hpylm.fit(docs, head_words=3, shipped_words=shipped)
        got = {r.doc_id: r.score for r in hpylm.score(asked, model, table).collect()}
        assert got[0] > got[1] + 0.5 and got[0] > got[3] + 0.5 and np.isfinite(list(got.values())).all()
        # A context's pairs and what is left to the parent.
        counts = collections.Counter()
        for t in texts:
            counts.update([hpylm.END_HASH, *(hpylm.word_hash(w.encode()) for w in t.split())])
        spare = dict(zip(model.words.tolist(), model.spare.tolist(), strict=True))
        spare |= {r.h: r.spare for r in table.collect()}
        assert set(spare) == set(counts)
        net = collections.Counter()
        for r in model.pairs.collect():
            net[r.u] += r.net
        for u, c in counts.items():
            assert net[u] / (hpylm.STRENGTH + c) + spare[u] == pytest.approx(1)


def test_seats_follow_the_restaurant_rule():
    """The mean number of tables agrees with seating customers one by one."""
    off, others, parent, n = 0.6, 12.0, 0.05, 40
    rng = np.random.default_rng(0)
    got = hpylm.reseat(np.full(20_000, n), others, parent, off, rng).mean()
    chances = np.zeros(n + 1)
    chances[1] = 1.0
    for sat in range(1, n):
        after = np.zeros(n + 1)
        for t in range(1, sat + 1):
            new = (hpylm.STRENGTH + off * (others + t)) * parent
            p = new / (new + sat - off * t)
            after[t] += chances[t] * (1 - p)
            after[t + 1] += chances[t] * p
        chances = after
    assert got == pytest.approx((chances * np.arange(n + 1)).sum(), rel=0.02)


def test_model_beats_the_base_on_held_out_text(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model, table = hpylm.fit(docs.where("doc_id % 5 <> 0"))
    held = hpylm.score(docs.where("doc_id % 5 = 0"), model, table)
    row = hpylm.perplexity(held).first()
    assert row.perplexity < 0.75 * row.base_perplexity
    assert F.col is not None
