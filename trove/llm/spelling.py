"""Spelling variants: words one edit apart, by composing acceptors.

The vocabulary V is a minimised acceptor and E a transducer that makes exactly
one edit; V . E . V accepts the pairs of near words. Before the edit both sides
have read the same letters, so the composed state is a single state of V; after
it, both sides must read the same letters from two states of V. A state pair is
expanded once, whatever the number of beginnings that lead to it.

V is spread over tasks by initial states. Let m be the length of the shorter of
two near words. If their first edit is behind the first m // 2 letters, both
begin with these and meet in the partition of this beginning; else both end with
the same m - m // 2 letters and meet in the partition of this ending, whose
acceptor reads backwards. So each word goes to at most four partitions: its
beginning and its ending as the shorter word of a pair, and as the longer one.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.operators.skew import lookup
from trove.session import stored

MIN_LENGTH = 7
MIN_COUNT = 2
#: A form has at least this many times the count of its variant.
FORM_RATIO = 10
#: One run in this many loses a letter.
SPOILED = 31

#: A partition of more words is split in blocks, and each two blocks meet.
GROUP_WORDS = 1 << 15
#: Words and letters that are composed together.
CHUNK_WORDS, CHUNK_CELLS = 1 << 15, 1 << 22
#: Edited beginnings that are followed together.
FRONT = 1 << 18

#: Counters of a task are handed on beyond this many entries.
HELD = 400_000
#: Code points of a text that are split at once.
BLOCK = 1 << 20

# A-Z lower-cased, a-z and C0-FF stay; all else parts runs.
_RUNS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def runs_of(text: str) -> Counter:
    """How often each run of at least ``MIN_LENGTH`` letters stands in a text, as Latin-1."""
    found: Counter = Counter()
    low = 0
    while low < len(text):
        part = text[low : low + BLOCK]
        low += len(part)
        # A block ends behind a run, however long that is.
        if low < len(text) and _is_letter(text[low]):
            rest = low
            while rest < len(text) and _is_letter(text[rest]):
                rest += 1
            part += text[low:rest]
            low = rest
        words = part.encode("latin-1", "replace").translate(_RUNS).split()
        found.update(w for w in words if len(w) >= MIN_LENGTH)
    return found


def _is_letter(char: str) -> bool:
    return ord(char) < 256 and _RUNS[ord(char)] != 32


def spoil(run: bytes, head: int) -> bytes:
    """The run, less one letter if its check sum, continued from ``head``, says so."""
    code = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), head)
    if code % SPOILED:
        return run
    at = code % len(run)
    return run[:at] + run[at + 1 :]


def vocabulary(docs: DataFrame) -> DataFrame:
    """``word`` and ``n`` of all words with ``MIN_LENGTH`` letters and ``MIN_COUNT`` places."""
    rows = docs.select(
        F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows_of() -> pa.RecordBatch:
            words = pa.array([w.decode("latin-1") for w in held], pa.string())
            return pa.RecordBatch.from_arrays([words, pa.array(list(held.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                head = zlib.crc32(f"{doc_id.as_py()}:".encode())
                for run, n in runs_of(text.as_py()).items():
                    word = spoil(run, head)
                    if len(word) >= MIN_LENGTH:
                        held[word] += n
                if len(held) >= HELD:
                    yield rows_of()
                    held.clear()
        yield rows_of()

    counted = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= MIN_COUNT)


class Acceptor:
    """The minimised acceptor of sorted words, each behind its initial symbol.

    ``group`` and ``rests`` (a byte matrix padded with zeros) are sorted and
    distinct. A state is known by a hash of the words it accepts, checked
    against its arcs. A word's row is the sum of the skips along its path.
    """

    def __init__(self, group: np.ndarray, rests: np.ndarray):
        n, width = rests.shape
        lengths = (rests != 0).sum(1)
        same = np.zeros(n, np.int64)
        differs = rests[1:] != rests[:-1]
        shared = np.where(differs.any(1), differs.argmax(1), width)
        same[1:] = np.where(group[1:] == group[:-1], shared, -1)
        same[:1] = -1
        # The nodes of the trie by depth: first row, label, parent.
        rows, depths, parents, labels, ends = [], [], [], [], []
        above, base = np.zeros(n, np.int64), 0
        for depth in range(int(lengths.max(initial=0)) + 1):
            new = (same < depth) & (lengths >= depth)
            at = np.flatnonzero(new)
            node = base + np.cumsum(new) - 1
            rows.append(at)
            depths.append(np.full(len(at), depth))
            parents.append(above[at])
            labels.append(rests[at, depth - 1].astype(np.int64) if depth else group[at])
            ends.append(lengths[at] == depth)
            above, base = node, base + len(at)
        self.row, self.depth = np.concatenate(rows), np.concatenate(depths)
        parent, label, final = np.concatenate(parents), np.concatenate(labels), np.concatenate(ends)
        bounds = np.cumsum([0, *(len(r) for r in rows)])
        seed = 0
        while not self._minimise(parent, label, final, bounds, seed):
            seed += 1

    def _minimise(self, parent, label, final, bounds, seed) -> bool:
        odd = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)
        language = np.where(final, odd[1], np.uint64(seed * 2 + 1))
        words, spans = final.astype(np.int64), final.astype(np.uint64)
        for depth in range(len(bounds) - 2, 0, -1):
            here = slice(bounds[depth], bounds[depth + 1])
            mix = (language[here] + label[here].astype(np.uint64) * odd[0]) * odd[2]
            mix = (mix ^ (mix >> np.uint64(29))) * odd[1]
            np.add.at(language, parent[here], mix ^ (mix >> np.uint64(32)))
            np.add.at(words, parent[here], words[here])
            # Which numbers of letters may follow; those beyond 63 share the last bit.
            longer = spans[here] << np.uint64(1) | spans[here] & np.uint64(1 << 63)
            np.bitwise_or.at(spans, parent[here], longer)
        _, first, self.state = np.unique(language, return_index=True, return_inverse=True)
        self.final, self.words, self.spans = final[first], words[first], spans[first]
        # Arcs of each state, by label, from those of its first node.
        inner = np.arange(bounds[1], bounds[-1])
        # Nodes of a depth are in row order, so siblings are in label order.
        inner = inner[np.argsort(parent[inner], kind="stable")]
        counts = np.bincount(parent[inner], minlength=len(parent))
        begins = np.cumsum(counts) - counts
        degree = counts[first]
        same = (counts == degree[self.state]).all() and (final == self.final[self.state]).all()
        self.first = np.cumsum(degree) - degree
        self.degree = degree
        pick = np.repeat(begins[first] - self.first, degree) + np.arange(degree.sum())
        arcs = inner[pick]
        self.label, self.target = label[arcs], self.state[arcs]
        if not same:
            return False
        place = np.repeat(self.first[self.state] - begins, counts) + np.arange(counts.sum())
        if (self.label[place] != label[inner]).any() or (self.target[place] != self.state[inner]).any():
            return False
        self.owner = np.repeat(np.arange(len(first)), degree)
        # Words in front of an arc's: the one that ends in its state, and smaller labels'.
        before = np.cumsum(np.append(0, self.words[self.target]))
        self.skip = before[:-1] - before[self.first[self.owner]] + self.final[self.owner]
        self.code = self.owner * 256 + self.label
        return True

    def arcs(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each state in turn its arcs, and which of ``states`` each is of."""
        degree = self.degree[states]
        which = np.repeat(np.arange(len(states)), degree)
        begin = np.cumsum(degree) - degree
        return np.repeat(self.first[states] - begin, degree) + np.arange(degree.sum()), which

    def step(self, states: np.ndarray, labels: np.ndarray) -> np.ndarray:
        """The arc of each state with this label, or -1."""
        code = states * 256 + labels
        at = np.minimum(np.searchsorted(self.code, code), len(self.code) - 1)
        return np.where(self.code[at] == code, at, -1)


class Composed:
    """The part of V . E . V behind the edit, trimmed to what accepts.

    ``edits`` are, for each state of V, its ways to edit: the two arcs of a
    replaced letter, or one arc and -1 for a letter that only one side reads.
    """

    def __init__(self, v: Acceptor):
        self.v, size = v, len(v.words)
        one, own = v.arcs(v.owner)
        later = one > own
        a = np.concatenate([own[later], np.arange(len(v.owner))])
        b = np.concatenate([one[later], np.full(len(v.owner), -1)])
        left, right = v.target[a], np.where(b >= 0, v.target[b], v.owner[a])
        able = (v.spans[left] & v.spans[right]) != 0
        a, b, start = a[able], b[able], left[able] * size + right[able]
        # All state pairs that equal letters lead to, and the arcs between them.
        fresh = np.unique(start)
        self.pairs, links = fresh, []
        while len(fresh):
            s, t = fresh // size, fresh % size
            arc, which = v.arcs(s)
            other = v.step(t[which], v.label[arc])
            met = other >= 0
            arc, other, which = arc[met], other[met], which[met]
            to = v.target[arc] * size + v.target[other]
            able = (v.spans[v.target[arc]] & v.spans[v.target[other]]) != 0
            links.append((fresh[which][able], to[able], v.skip[arc][able], v.skip[other][able]))
            fresh = np.setdiff1d(to[able], self.pairs)
            self.pairs = np.union1d(self.pairs, fresh)
        origin, to, skip_a, skip_b = (np.concatenate(x) for x in zip(*links)) if links else [start[:0]] * 4
        origin, to = np.searchsorted(self.pairs, origin), np.searchsorted(self.pairs, to)
        self.accepts = v.final[self.pairs // size] & v.final[self.pairs % size]
        live = self.accepts.copy()
        while True:
            known = live.sum()
            live[origin[live[to]]] = True
            if live.sum() == known:
                break
        keep = live[to]
        order = np.argsort(origin[keep], kind="stable")
        self.to, self.skip_a, self.skip_b = to[keep][order], skip_a[keep][order], skip_b[keep][order]
        self.degree = np.bincount(origin[keep], minlength=len(self.pairs))
        self.first = np.cumsum(self.degree) - self.degree
        self.spans = v.spans[self.pairs // size] & v.spans[self.pairs % size]
        start = np.searchsorted(self.pairs, start)
        good = live[start]
        a, b, start = a[good], b[good], start[good]
        order = np.argsort(v.owner[a], kind="stable")
        self.edit_a, self.edit_b, self.start = a[order], b[order], start[order]
        self.edits = np.bincount(v.owner[a], minlength=size)
        self.first_edit = np.cumsum(self.edits) - self.edits

    def accepted(self, short: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Row pairs one edit apart; ``short`` is, by row, the letters that the shorter has.

        A beginning, which is a node of the trie, is paired with each edit of its
        state, and followed along equal letters.
        """
        v = self.v
        has = np.flatnonzero(self.edits[v.state])
        ends = np.cumsum(self.edits[v.state[has]])
        low = 0
        while low < len(has):
            done = ends[low - 1] if low else 0
            high = max(low + 1, int(np.searchsorted(ends, done + FRONT, "right")))
            nodes = has[low:high]
            low = high
            state = v.state[nodes]
            count = self.edits[state]
            which = np.repeat(np.arange(len(nodes)), count)
            begin = np.cumsum(count) - count
            edit = np.repeat(self.first_edit[state] - begin, count) + np.arange(count.sum())
            row = v.row[nodes][which]
            replaced = self.edit_b[edit] >= 0
            at = self.start[edit]
            # After a replaced letter both have one letter less to go.
            left = short[row] - v.depth[nodes][which] - replaced
            fits = (left >= 0) & (self.spans[at] >> np.clip(left, 0, 63).astype(np.uint64) & np.uint64(1) > 0)
            a = row[fits] + v.skip[self.edit_a[edit[fits]]]
            b = row[fits] + np.where(replaced[fits], v.skip[self.edit_b[edit[fits]]], 0)
            at, left = at[fits], left[fits]
            while len(at):
                over = self.accepts[at] & (left == 0)
                yield a[over], b[over]
                count = self.degree[at]
                which = np.repeat(np.arange(len(at)), count)
                begin = np.cumsum(count) - count
                link = np.repeat(self.first[at] - begin, count) + np.arange(count.sum())
                a, b = a[which] + self.skip_a[link], b[which] + self.skip_b[link]
                at, left = self.to[link], left[which] - 1
                fits = (left >= 0) & (self.spans[at] >> np.clip(left, 0, 63).astype(np.uint64) & np.uint64(1) > 0)
                a, b, at, left = a[fits], b[fits], at[fits], left[fits]


def near_pairs(group: np.ndarray, rests: list[bytes], short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All pairs of places ``(i, j)`` of one group whose rests are one edit apart.

    ``short`` is the length that the shorter rest of a pair has. Rests are
    distinct within a group.
    """
    packed = np.array(rests, dtype=f"S{max(1, max(map(len, rests)))}")
    order = np.lexsort((packed, group))
    matrix = packed[order].view(np.uint8).reshape(len(rests), -1)
    composed = Composed(Acceptor(group[order], matrix))
    found = [order[a] * len(rests) + order[b] for a, b in composed.accepted(short[order])]
    # A letter next to an equal one can be left out in two places.
    pairs = np.unique(np.concatenate(found)) if found else np.empty(0, np.int64)
    return pairs // len(rests), pairs % len(rests)


def _partitioned(words: DataFrame, group_words: int) -> DataFrame:
    """``side, m, part, low, high, block, word, n``: each word in its partitions."""
    m = F.col("m")
    roles = F.array(F.col("_length") - 1, F.col("_length"))
    head, tail = F.floor(m / 2).cast("int"), (m - F.floor(m / 2)).cast("int")
    ends = F.array(
        F.struct(F.lit(0).alias("side"), F.left("word", head).alias("part")),
        F.struct(F.lit(1).alias("side"), F.right("word", tail).alias("part")),
    )
    spread = words.withColumn("_length", F.char_length("word")).withColumn("m", F.explode(roles))
    spread = spread.where(m >= MIN_LENGTH).withColumn("_end", F.explode(ends))
    spread = spread.select("_end.side", "m", "_end.part", "word", "n", (F.col("_length") == m).alias("_short"))
    spread = spread.withColumn("_key", F.concat_ws(":", "side", "m", "part"))
    sizes = spread.groupBy("_key").agg(
        F.count(F.lit(1)).alias("_size"), F.max(F.col("_short").cast("int")).alias("_any")
    )
    large = stored(sizes.where(F.col("_size") > group_words), "large-partitions")
    total = large.agg(F.sum("_size")).first()[0]
    if total is None:
        return spread.select(
            "side", "m", "part", *(F.lit(0).alias(c) for c in ("low", "high", "block")), "word", "n"
        )
    marked = lookup(spread, large, "_key", F.col("_size"), F.lit(total))
    blocks = F.coalesce(F.ceil(2 * F.col("_size") / group_words), F.lit(1)).cast("int")
    own = F.pmod(F.xxhash64("word"), blocks).cast("int")
    met = marked.select("side", "m", "part", own.alias("block"), blocks.alias("_blocks"), "word", "n")
    met = met.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    return met.select(
        "side", "m", "part", F.least("block", "_other").alias("low"),
        F.greatest("block", "_other").alias("high"), "block", "word", "n",
    )


def near_words(words: DataFrame, group_words: int = GROUP_WORDS) -> DataFrame:
    """``word, n_near, best_n, best``: how many words are near, and which is commonest.

    ``words`` has distinct ``word`` (letters up to U+00FF, at least
    ``MIN_LENGTH``) and ``n``. Words without a near word are left out. Ties go
    to the smallest word in code-point order. A task composes whole partitions
    of at most ``group_words`` words, several at a time.
    """
    keys = ["side", "m", "part", "low", "high"]
    dealt = _partitioned(words, group_words).repartition(*keys).sortWithinPartitions(*keys)

    def compose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _chunks(batches, len(keys)):
            side, m, part, low, high, block, word, n = (table.column(i) for i in range(8))
            side, m, low, high, block, n = (x.to_numpy() for x in (side, m, low, high, block, n))
            text = [w.encode("latin-1") for w in word.to_pylist()]
            group, inside = _groups(table)
            sizes = np.bincount(group)
            short = np.array([len(w) for w in text]) == m
            usable = (sizes > 1) & (np.bincount(group, short) > 0)
            keep = np.flatnonzero(usable[group])
            if not len(keep):
                continue
            text = [text[i] for i in keep]
            side, m, block, n, group, inside = (x[keep] for x in (side, m, block, n, group, inside))
            half = m // 2
            rests = [
                w[h:] if s == 0 else w[: len(w) - (k - h)][::-1]
                for w, s, k, h in zip(text, side.tolist(), m.tolist(), half.tolist())
            ]
            i, j = near_pairs(group, rests, np.where(side == 0, m - half, half))
            heads = np.array([w[:h] for w, h in zip(text, half.tolist())])
            # Equal beginnings met in the partition of that beginning already.
            new = (side[i] == 0) | (heads[i] != heads[j])
            # Two words of one block meet in the group of that block alone.
            new &= inside[i] | (block[i] != block[j])
            i, j = i[new], j[new]
            rank = np.empty(len(text), np.int64)
            order = np.lexsort((np.array(text), -n))
            rank[order] = np.arange(len(text))
            best = np.full(len(text), len(text))
            np.minimum.at(best, i, rank[j])
            np.minimum.at(best, j, rank[i])
            near = np.bincount(np.concatenate([i, j]), minlength=len(text))
            got = np.flatnonzero(near)
            top = order[best[got]]
            decoded = [w.decode("latin-1") for w in text]
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([decoded[k] for k in got.tolist()], pa.string()),
                    pa.array(near[got]),
                    pa.array(n[top]),
                    pa.array([decoded[k] for k in top.tolist()], pa.string()),
                ],
                ["word", "n_near", "best_n", "best"],
            )

    found = dealt.mapInArrow(compose, "word string, n_near long, best_n long, best string")
    best = F.min(F.struct((-F.col("best_n")).alias("n"), F.col("best").alias("word")))
    return (
        found.groupBy("word")
        .agg(F.sum("n_near").alias("n_near"), best.alias("_best"))
        .select("word", "n_near", (-F.col("_best.n")).alias("best_n"), F.col("_best.word").alias("best"))
    )


def _groups(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the runs of equal keys, and whether a row's group has one block."""
    new = np.zeros(table.num_rows, bool)
    new[:1] = True
    for c in ("side", "m", "low", "high"):
        x = table.column(c).to_numpy()
        new[1:] |= x[1:] != x[:-1]
    part = np.array(table.column("part").to_pylist(), dtype=object)
    new[1:] |= part[1:] != part[:-1]
    return np.cumsum(new) - 1, table.column("low").to_numpy() == table.column("high").to_numpy()


def _chunks(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[pa.Table]:
    """Tables of whole groups: as many as fit, or a single one."""
    held: list[pa.RecordBatch] = []
    rows = cells = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(i).to_pylist() for i in range(n_keys))))
        begin, last = 0, tuple(c[-1].as_py() for c in held[-1].columns[:n_keys]) if held else None
        for i, key in enumerate(keys):
            if key != last and (rows >= CHUNK_WORDS or cells >= CHUNK_CELLS):
                held.append(batch.slice(begin, i - begin))
                yield pa.Table.from_batches([b for b in held if b.num_rows])
                held, begin, rows, cells = [], i, 0, 0
            last = key
            rows += 1
            cells += key[1]
        held.append(batch.slice(begin))
    if held:
        yield pa.Table.from_batches(held)


def variants(docs: DataFrame) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` of every word of the corpus.

    ``docs`` has ``doc_id, text``; other columns are ignored, whatever their
    names. A null text has no words; a null id counts as empty; repeated rows
    count repeatedly. A text of any length is split in blocks, and a word of any
    length is one word. An empty table gives no rows. A form's count is at least
    ``FORM_RATIO`` times that of its variant, so chains of forms end; each round
    doubles the steps that a word has followed.
    """
    words = stored(vocabulary(docs), "vocabulary")
    near = near_words(words)
    likely = F.col("best_n") >= FORM_RATIO * F.col("n")
    found = stored(
        words.join(near, "word", "left").select(
            "word",
            F.when(likely, F.col("best")).alias("form"),
            "n",
            F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
            F.when(likely, F.col("best_n")).alias("form_n"),
        ),
        "near-words",
    )
    roots = found.where("form IS NOT NULL").select("word", F.col("form").alias("root"))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        after = stored(
            roots.join(further, "root", "left").select(
                "word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")
            ),
            "roots",
        )
        roots = after.select("word", "root")
        if after.where("_moved").limit(1).count() == 0:
            break
    return found.join(roots, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )
