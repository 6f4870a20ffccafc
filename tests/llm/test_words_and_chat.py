"""Spelling variants, chat formatting and source divergence against plain versions."""

import collections
import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.test_llm_operators import make_docs, odd_texts
from trove.llm import chat, divergence, licenses, pii, sharding, spelling

DIR = "/root/testdata/sf0.001"


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


# ---- spelling variants


def one_edit(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return False
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute_words(rows):
    counts = collections.Counter()
    for i, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                counts[run] += 1
    return {w: n for w, n in counts.items() if n >= 2}


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [x for x in words if one_edit(w, x)] for w in words}
    form = {}
    for w, xs in near.items():
        best = min(xs, key=lambda x: (-words[x], x), default=None)
        form[w] = best if best and words[best] >= 10 * words[w] else None
    out = []
    for w, n in words.items():
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), words[form[w]] if form[w] else None))
    return sorted(out)


def test_near_pairs_of_random_words():
    rng = random.Random(5)
    for _ in range(80):
        rows = set()
        sizes = [rng.randint(1, 6) for _ in range(rng.randint(1, 4))]
        for g, m in enumerate(sizes):
            for _ in range(rng.randint(1, 25)):
                rows.add((g, bytes(rng.choice(b"ab\xe9") for _ in range(m + rng.randint(0, 1)))))
        rows = sorted(rows, key=lambda r: rng.random())
        groups = np.array([g for g, _ in rows])
        i, j = spelling.near_pairs(groups, [r for _, r in rows], np.array([sizes[g] for g in groups]))
        want = [
            (x, y)
            for x in range(len(rows))
            for y in range(x + 1, len(rows))
            if groups[x] == groups[y]
            and one_edit(rows[x][1], rows[y][1])
            and min(len(rows[x][1]), len(rows[y][1])) == sizes[groups[x]]
        ]
        assert sorted(tuple(sorted(p)) for p in zip(i.tolist(), j.tolist())) == want


def test_minimised_states_are_shared():
    words = sorted(a + b for a in (b"ab", b"ba", b"cc") for b in (b"xyz", b"xyq", b"wyz"))
    rests = np.array(words).view(np.uint8).reshape(len(words), -1)
    v = spelling.Acceptor(np.zeros(len(words), np.int64), rests)
    # One state each: start, three first letters, the shared rest (after two letters) and its tails.
    assert v.words[v.state[0]] == 9 and len(v.words) < len(v.state) / 2
    assert v.state[v.depth == 2].tolist() == [v.state[v.depth == 2][0]] * 3


def spelling_rows():
    rng = random.Random(8)
    base = ["colouring", "reasonable", "señalización", "übergänge", "aaaaaaaa", "seventhx"]
    rows = [(None, "Colouring colouring"), (1, None), (2, ""), (3, " \n"), (4, "COLOURING Ÿcolouring×")]
    rows += [(10 + k, " ".join(rng.choices(base, k=40))) for k in range(40)]
    rows += [(60, "coloring coloring colorin colorin xolorin xolorin aaaaaaa aaaaaaa aaaaaaaaa aaaaaaaaa")] * 2
    rows += [(60, "señalizacion señalizacion eventhx eventhx seventhxy seventhxy")]
    rows += [(70, "longword" * 400 + " " + "longword" * 400 + "s"), (71, ("longword" * 400 + " ") * 2)]
    rows += [(72, "longword" * 400 + "s")]
    return rows


@pytest.mark.parametrize("texts", [spelling_rows, odd_texts])
def test_variants_match_brute_force(spark, texts):
    rows = texts()
    got = sorted(map(tuple, spelling.variants(make_docs(spark, rows)).collect()), key=lambda r: r[0])
    assert got == brute_variants(rows)


def test_variants_of_the_small_table(spark):
    docs = spark.read.parquet(f"{DIR}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    words = brute_words(rows)
    got = {r.word: r for r in spelling.variants(docs).collect()}
    assert {w: r.n for w, r in got.items()} == words
    for w in random.Random(1).sample(sorted(words), 60):
        assert got[w].n_near == sum(one_edit(w, x) for x in words)


def test_split_partitions_give_the_same(spark):
    rng = random.Random(2)
    words = {"".join(rng.choices("abc", k=rng.randint(7, 9))): rng.randint(2, 90) for _ in range(900)}
    table = spark.createDataFrame(list(words.items()), "word string, n long")
    want = set()
    for w in words:
        near = [x for x in words if one_edit(w, x)]
        if near:
            best = min(near, key=lambda x: (-words[x], x))
            want.add((w, len(near), words[best], best))
    for size in (1 << 15, 12):
        assert {tuple(r) for r in spelling.near_words(table, size).collect()} == want


def test_variants_of_nothing(spark):
    assert spelling.variants(make_docs(spark, [], 1)).count() == 0
    assert spelling.variants(make_docs(spark, [(1, None), (2, "short words only here")])).count() == 0


def test_blocks_of_a_long_text(monkeypatch):
    text = "Überlänge wordword " * 9 + "x" * 50 + " ŸŸabcdefgh"
    whole = spelling.runs_of(text)
    monkeypatch.setattr(spelling, "BLOCK", 7)
    assert spelling.runs_of(text) == whole


# ---- chat formatting


CHAT = "conv_id long, turn long, role string, text string, part int, formatted string, _key string"


def chat_rows():
    marks = ["\\", "\\\\<|end|>", "<|start|>", "a<|next|>b", "[INST] x [/INST]</s><s>", "<<|end|>|end|>\\", "é😀\n"]
    rows = [(1, i, ["user", "assistant", "assistant"][i % 3], m) for i, m in enumerate(marks)]
    rows += [(2, 3, "assistant", "late"), (2, 1, "user", None), (2, 1, "user", "tie"), (2, 1, "user", "tie")]
    rows += [(3, 0, None, "x"), (3, None, "assistant", ""), (None, None, None, None), (None, 4, "user", "y")]
    rows += [(4, 0, "a<|message|>b\\", "\n"), (5, 0, "assistant", "long <s>" * 200_000), (5, 1, "assistant", "z")]
    rows += [(6, i, ["user", "assistant"][i // 3 % 2], f"turn {i}\\") for i in range(700)]
    return rows


def brute_chat(rows):
    by = collections.defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = {}
    for conv, turns in by.items():
        turns.sort()
        said = "".join(f"{r}\n{t}\n" for _, _, r, t in turns)
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        digest = (hashlib.sha256(s.encode()).hexdigest() for s in (said, loss))
        out[conv] = (len(turns), next(digest), len(loss), next(digest))
    return out


def chat_table(spark, rows):
    return spark.createDataFrame([(*r, 1, "f", "k") for r in rows], CHAT).repartition(5)


def test_conversations_read_back(spark):
    rows = chat_rows()
    out = chat.format_conversations(chat_table(spark, rows)).cache()
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in chat.digests(out).collect()}
    assert got == brute_chat(rows)
    parts = {r.conv_id: r["count"] for r in out.groupBy("conv_id").count().collect()}
    assert parts.pop(5) == 2 and parts.pop(6) == 3 and set(parts.values()) == {1}
    blocks = {r.conv_id: r.formatted for r in out.where("conv_id in (1, 2)").collect()}
    assert blocks[2] == "<|start|>user<|message|><|next|>tie<|next|>tie<|end|><|start|>assistant<|message|>late<|end|>"
    assert blocks[1].count("<|start|>") == blocks[1].count("<|end|>") == 5
    assert not re.search(r"\[/?INST\]|</?s>", blocks[1])


def test_loss_mask_covers_assistant_texts_only(spark):
    out = chat.format_conversations(chat_table(spark, chat_rows()))
    for r in out.where("conv_id in (1, 2, 3)").collect():
        for span in r.loss:
            inside = r.formatted[span.start : span.stop]
            assert not any(mark in inside for mark in chat.CONTROL)
            before = r.formatted[: span.start]
            assert before[before.rindex("<|start|>") :].startswith("<|start|>assistant<|message|>")


def test_chat_plan_is_expressions(spark):
    plan = chat.format_conversations(chat_table(spark, [(1, 0, "user", "x")]))._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan.split("Physical Plan")[-1])


def test_no_conversations_but_the_probe(spark):
    none = chat_table(spark, [])
    assert chat.digests(chat.format_conversations(none)).count() == 0
    (row,) = chat.digests(chat.format_conversations(chat.with_probe(none))).collect()
    assert (row.conv_id, row.n_turns, row.loss_chars) == (-1, 2, 21)


# ---- source divergence


def brute_divergence(rows):
    """``rows`` are (lang, source, text)."""
    docs, counts, groups = collections.Counter(), collections.defaultdict(collections.Counter), set()
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", lower(text))
        docs.update((lang, t) for t in set(found))
        counts[lang, source].update(found)
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for (x, t), n in docs.items() if x == lang and n >= 10]
        sources = sorted(s for x, s in groups if x == lang)
        whole = collections.Counter()
        for s in sources:
            whole.update({t: counts[lang, s][t] for t in kept})

        def share(c):
            total = sum(c[t] for t in kept) + 2 * len(kept)
            return {t: 1 + 10**9 * (c[t] + 2) // total for t in kept}

        p = {s: share(counts[lang, s]) for s in sources}
        q = share(whole)

        def gap(a, b):
            return (a - b) ** 2 // (a + b)

        for s in sources:
            pairs = [(-sum(gap(p[s][t], p[o][t]) for t in kept), o) for o in sources if o != s]
            terms = [(-gap(p[s][t], q[t]), t) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:10])):
                out += [(lang, s, part, o, -v, k) for k, (v, o) in enumerate(found, 1)]
    return sorted(out)


def divergence_table(spark, rows):
    full = [(*r, 1, 2, 3) for r in rows]
    schema = "lang string, source string, text string, n long, col long, row long"
    return spark.createDataFrame(full, schema).repartition(4)


def divergence_rows():
    rng = random.Random(4)
    words = [f"{a}{b}é{c}" for a in "abcdefgh" for b in "klmnop" for c in ("x", "y", "", "日本")]
    weights = [1 / (k + 1) for k in range(len(words))]
    rows = [(None, None, None), (None, "s", "Alpha"), ("xx", "only", "rare words here"), ("xx", "other", "")]
    for lang, n in (("en", 70), ("fr", 5)):
        for s in range(n):
            picked = rng.sample(range(len(words)), 40)
            for _ in range(3 if n > 9 else 12):
                text = " ".join(rng.choices([words[k] for k in picked], [weights[k] for k in picked], k=30))
                rows.append((lang, f"src{s}", text.upper() if s % 2 else text))
    rows += [("en", "src1", "hot word " * 3000)] * 12 + [("en", "empty", None), ("en", None, "1 2 3")]
    return rows


def test_divergence_matches_brute_force(spark):
    rows = divergence_rows()
    got = sorted(map(tuple, divergence.divergence(divergence_table(spark, rows)).collect()))
    assert got == brute_divergence(rows)


def test_divergence_of_nothing(spark):
    assert divergence.divergence(divergence_table(spark, [])).count() == 0
    (row,) = divergence.divergence(divergence_table(spark, [("a", "b", None), ("a", "c", "x"), ("d", "e", "")])).where(
        "source = 'b'"
    ).collect()
    assert (row.part, row.item, row.value, row["rank"]) == ("pair", "c", 0, 1)


def test_tiles_walk_only_what_holds_a_count():
    rng = np.random.default_rng(3)
    whole = rng.integers(1000, 5000, (2, divergence.ROWS))
    trees, dense = [], []
    for w in whole:
        at = rng.choice(divergence.ROWS * 200, 300, replace=False)
        counts = np.zeros((divergence.ROWS, divergence.COLUMNS), np.int64)
        counts[at // 200, at % 200] = rng.integers(1, 90, 300)
        r, c = np.nonzero(counts)
        trees.append(divergence.Tree(r, c, counts[r, c], w))
        dense.append(divergence.scaled_cells(counts[:, :5000], w[:, None]))
    zero = [divergence.scaled_cells(np.zeros_like(w), w) for w in whole]
    got = divergence.compare_tiles(trees[0], trees[1], 5000)
    for a in range(0, divergence.ROWS, 9):
        want = divergence.gaps(dense[0][a][None], dense[1]).sum(1) - 5000 * divergence.gaps(zero[0][a], zero[1])
        assert (got[a] == want).all()
    met = sum(len(c) for _, _, c in divergence.leaf_pairs(*trees))
    assert met <= 8 * 8 * 200 // divergence.LEAF


def test_shares_of_large_counts(spark):
    n, whole = 9 * 10**14 + 7, 10**15 + 9
    df = spark.createDataFrame([(n, whole)], "n long, w long")
    (got,) = df.select(divergence.scaled(F.col("n"), F.col("w"))).first()
    assert got == 1 + 10**9 * n // whole
    assert divergence.scaled_cells(np.array([n - 2]), np.array([whole]))[0] == got


def test_terms_of_a_long_text(monkeypatch):
    text = ("Ünï-code wörter 12 a_b " * 20 + "日本語" * 30).encode()
    whole = divergence.terms_of(text)
    assert whole["日本語".encode() * 30] == 1 and whole[b"code"] == 20
    monkeypatch.setattr(divergence, "BLOCK", 5)
    assert divergence.terms_of(text) == whole


# ---- licences

PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}


def brute_licences(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    found = [
        (i, label)
        for phrase, label in PHRASES.items()
        for i in range(len(words))
        if words[i : i + len(phrase.split())] == phrase.split()
    ]
    starts = [i for i, _ in found]
    labels = ",".join(sorted({label for _, label in found}))
    return len(words), len(found), min(starts, default=None), max(starts, default=None), labels


def test_base_licences_match_brute_force(spark):
    rng = random.Random(7)
    pieces = ["under", "the", "MIT", "license", "Apache", "License,", "version", "2", "2.0", "cc", "by", "nc", "BY-NC", "é", "x"]
    rows = [(i, " ".join(rng.choices(pieces, k=rng.randint(0, 60)))) for i in range(400)] + odd_texts()
    rows += [(9000 + i, " - ".join(rng.sample(list(PHRASES), 3)).upper()) for i in range(5)]
    rows += [(r.doc_id, r.text) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    docs = make_docs(spark, rows)
    got = licenses.summary(licenses.scan(docs, licenses.fit(docs))).collect()
    found = collections.Counter(
        (r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in got
    )
    assert found == collections.Counter((i, *brute_licences(t)) for i, t in rows)
    assert sum(r.n_base > 0 for r in got) > 20
    assert all(set(filter(None, r.base_labels.split(","))) <= set(r.labels.split(",")) for r in got)


# ---- shards


def brute_shards(rows, shards, bits=4):
    """Shard and slot of (id, text, lang, source), by whole strings."""
    side, cells = 1 << bits, []
    for at in (2, 3):
        given = sorted(r[at] for r in rows if r[at] is not None)
        below = {v: sum(x < v for x in given) * side // len(given) for v in set(given)}
        cells.append([below.get(r[at], 0) for r in rows])
    places = sharding.hilbert_index(np.array(cells).T, bits)
    keys = [(int(p), r[0], zlib.crc32(r[1].encode())) for p, r in zip(places, rows)]
    out = {}
    begun = collections.Counter()
    for rank, key in enumerate(sorted(keys)):
        shard = rank * shards // len(rows)
        out[key[1]] = (shard, begun[shard])
        begun[shard] += 1
    return out


def test_shards_follow_whole_strings(spark):
    rng = random.Random(6)
    sources = [f"https://site/{c}{d}" for c in "zyabé" for d in range(4)]
    rows = [
        (i, f"t{i}", rng.choice(["en", "de", "fr", None, "en"]), rng.choice([*sources, None, sources[0]]))
        for i in range(600)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5)
    got = {r.doc_id: (r.shard, r.slot) for r in sharding.shard(docs, ["lang", "source"], shards=40).collect()}
    assert got == brute_shards(rows, 40)
    # A common beginning hides nothing: a source lies in few shards.
    where = collections.defaultdict(set)
    for i, _, _, source in rows:
        where[source].add(got[i][0])
    assert sum(map(len, where.values())) < 0.45 * 40 * len(where)


# ---- personal data in texts of any length

EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")


def test_linear_patterns_give_the_same_spans():
    rng = random.Random(9)
    for n in range(20_000):
        text = "".join(rng.choices("aB1@.-+ é" if n % 2 else "01239.. -x", k=rng.randint(0, 30)))
        found = pii.base_spans(text)
        assert [(a, b) for a, k, b in found if k == 0] == [m.span() for m in EMAIL.finditer(text)], text
        ips = [m.span() for m in IP.finditer(text) if all(int(x) <= 255 for x in m[0].split("."))]
        assert [(a, b) for a, k, b in found if k == 1] == ips, text


@pytest.mark.parametrize(
    "text",
    [
        "7" * 1_000_000,
        "0" * 1_000_000 + ".1.2.3",
        "1." * 500_000,
        "1.2.3 " * 170_000,
        "1@" + "a-" * 500_000,
        "a" * 1_000_000 + "@" + "b" * 10,
        "a@" * 500_000,
        "a@b" * 300_000,
        "a." * 500_000 + "@",
        "+1 " * 300_000,
        "+" + "1 " * 500_000,
        "1 " * 500_000,
        "xoxa-" * 200_000,
        "AB12" * 250_000,
        "AB12 " * 200_000,
        "f" * 1_000_000,
        "sk-" * 300_000,
    ],
)
def test_long_runs_take_linear_time(text):
    start = time.process_time()
    pii.base_spans(text)
    pii.added_spans(text)
    assert time.process_time() - start < 8
