"""Token counts of whole texts, encoded in batches of about equal bytes.

Texts are split where the tokenizer's own pre-splitting always splits: before a
space or line break that follows a visible character. Each distinct part of a
batch is encoded once, and frequent parts stay in a bounded cache.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trove.llm.words import by_bytes, give_back, keyed

BATCH_BYTES = 4 << 20
CACHE_PARTS = 600_000
LONGEST_CACHED = 64
JOINED_PARTS = 1024

# A part is white space and what follows it; cuts lie before " " or "\n" only,
# and only in texts without other white space, whose runs could straddle them.
_PARTS = re.compile(r"[ \n]*[^ \n]+|[ \n]+")
_OTHER_SPACE = "\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u180e\u200b\u2028\u2029\u202f\u205f\u2060\u3000\ufeff" + "".join(
    map(chr, range(0x2000, 0x200B))
)
_RUNS = ("  ", "\n\n", " \n", "\n ", "\0")
# Between one of these letters and one of these marks there always is a cut.
_LETTER = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]").match
_MARKS = frozenset(".,;:!?")
_UNEVEN = (*_RUNS, *_OTHER_SPACE)
# In those, a cut lies before one space between two ASCII letters, digits or marks.
_SAFE = re.compile(r"(?<=[!-~])(?= [!-~])")


class Encoder:
    """Ids of parts by a ``tokenizers`` file of a byte-level vocabulary, in one thread."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        self._tokenizer.no_truncation()
        self._tokenizer.no_padding()
        vocabulary = self._tokenizer.get_vocab(with_added_tokens=True)
        # A token is written with one character per byte.
        self._bytes = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, number in vocabulary.items():
            self._bytes[number] = len(token)

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        found = self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, "<u4") for x in found]

    def ids(self, parts: list[str]) -> list[bytes]:
        """The ids of each part, as little-endian unsigned 32-bit numbers.

        Parts that begin with one white space and end visibly are encoded joined
        together, where they split as they do alone, and cut by byte lengths.
        """
        out: list[bytes] = [b""] * len(parts)
        joined, others = [], []
        for i, x in enumerate(parts):
            plain = len(x) > 1 and x[0] in " \n" and not (x[1].isspace() or x[-1].isspace())
            (joined if plain else others).append(i)
        for low in range(0, len(joined), JOINED_PARTS):
            places = joined[low : low + JOINED_PARTS]
            some = [parts[i] for i in places]
            (ids,) = self._encode(["".join(some)])
            ends = np.cumsum([len(x.encode()) for x in some])
            stops = np.searchsorted(self._bytes[ids].cumsum(), ends, "right") * 4
            data, start = ids.tobytes(), 0
            for i, stop in zip(places, stops.tolist(), strict=True):
                out[i] = data[start:stop]
                start = stop
        for i, ids in zip(others, self._encode([parts[i] for i in others]), strict=True):
            out[i] = ids.tobytes()
        return out


class PartCache(dict):
    """The ids of each part of a text, encoded once while they are kept.

    Two generations of parts are kept: when the young one is full it becomes the
    old one, from which parts that occur again move back.
    """

    def __init__(self, encoder: Encoder):
        self._encoder = encoder
        self._old: dict[str, bytes] = {}

    def _ids_of(self, some: list[str]) -> list[bytes]:
        """The ids of distinct parts; those not known yet are encoded together."""
        if len(self) > CACHE_PARTS:
            self._old = dict(self)
            self.clear()
        found = list(map(self.get, some))
        again = [i for i, ids in enumerate(found) if ids is None]
        new: dict[str, bytes] = {}
        marked = []
        for i in again:
            part = some[i]
            found[i] = self._old.get(part)
            if found[i] is not None:
                continue
            # A mark that ends a part is cut off after a letter: words recur without it.
            if len(part) > 2 and part[-1] in _MARKS and _LETTER(part[-2]):
                marked.append(i)
                for piece in (part[:-1], part[-1]):
                    if piece not in new:
                        new[piece] = self.get(piece) or self._old.get(piece) or b""
            else:
                new[part] = b""
        fresh = [piece for piece, ids in new.items() if not ids]
        new.update(zip(fresh, self._encoder.ids(fresh), strict=True))
        for i in marked:
            found[i] = new[some[i][:-1]] + new[some[i][-1]]
        for i in again:
            if found[i] is None:
                found[i] = new[some[i]]
        self.update((part, ids) for part, ids in new.items() if len(part) <= LONGEST_CACHED)
        self.update((some[i], found[i]) for i in again if len(some[i]) <= LONGEST_CACHED)
        return found

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers.

        Equal parts are found and counted off by Arrow; only distinct ones are
        looked up, and the ids of all places are copied together.
        """
        simple = [not any(map(text.__contains__, _UNEVEN)) for text in texts]
        marked = pa.array([x for x, one in zip(texts, simple) if one], pa.large_string())
        for space in " \n":
            marked = pc.replace_substring(marked, space, "\0" + space)
        cut = pc.split_pattern(marked, "\0")
        others = [parts(x) for x, one in zip(texts, simple) if not one]
        flat = [cut.flatten(), pa.array([x for one in others for x in one], pa.large_string())]
        coded = pa.concat_arrays(flat).dictionary_encode()
        sizes = np.empty(len(texts), np.int64)
        sizes[np.array(simple, bool)] = pc.list_value_length(cut).to_numpy()
        sizes[~np.array(simple, bool)] = list(map(len, others))
        # Where the parts of each text begin: first those of the simple texts.
        order = np.argsort(~np.array(simple, bool), kind="stable")
        stops = np.empty(len(texts), np.int64)
        stops[order] = np.cumsum(sizes[order])
        ids = self._ids_of(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        lengths = np.array(list(map(len, ids)), np.int64) // 4
        begins, codes = np.cumsum(lengths) - lengths, coded.indices.to_numpy()
        ends = np.append(0, np.cumsum(lengths[codes]))
        at = np.repeat(begins[codes] - ends[:-1], lengths[codes]) + np.arange(ends[-1])
        data = np.frombuffer(b"".join(ids), "<u4")[at].tobytes()
        return [data[4 * low : 4 * high] for low, high in zip(ends[stops - sizes].tolist(), ends[stops].tolist())]


_CACHES: dict[str, PartCache] = {}


def shared_cache(path: str) -> PartCache:
    """The cache of this Python worker for a tokenizer file, kept between its tasks."""
    if path not in _CACHES:
        _CACHES[path] = PartCache(Encoder(path))
    return _CACHES[path]


def parts(text: str) -> list[str]:
    """Pieces that join to ``text`` and encode as they do inside it."""
    if any(map(text.__contains__, _OTHER_SPACE)):
        return _SAFE.split(text)
    if any(map(text.__contains__, _RUNS)):
        return _PARTS.findall(text)
    return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")


def decoded(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Neighbouring texts of about ``BATCH_BYTES``, and the place of the first.

    A range is decoded when it is its turn, and what is freed by the end
    goes back to the system.
    """
    sizes = pc.binary_length(column).to_pylist()
    for start, stop in by_bytes(sizes, BATCH_BYTES, sizes):
        yield start, column.slice(start, stop - start).to_pylist()
    give_back()


def token_counts(
    docs: DataFrame,
    path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 1024,
) -> DataFrame:
    """``n_bytes``, ``n_tokens`` and ``over_limit`` (more than ``limit``) per row.

    One row comes out for each row that goes in, repeated rows included, with
    its id as it was (null too). A null or empty text has no bytes and no
    tokens. Long texts are encoded whole, in parts. ``path`` names the
    tokenizer file on every executor. Other columns are not read.
    """
    schema = docs.select(F.col(id_col)).schema.add("n_bytes", "long").add("n_tokens", "long")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoded = shared_cache(path)
        for batch in batches:
            sizes = pc.binary_length(batch.column(1))
            totals: list[int] = []
            for _, texts in decoded(batch.column(1)):
                totals += (len(ids) // 4 for ids in encoded(texts))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), sizes.cast(pa.int64()), pa.array(totals, pa.int64())],
                schema.names,
            )

    counted = keyed(docs, text_col, F.col(id_col)).mapInArrow(count, schema)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
