"""Conversations as one marked string, with a loss mask, built relationally.

Turn structs are collected and sorted, neighbours of the same role merge into
one block by array aggregation, and blocks are joined to a string. All of it is
Spark expressions. A block reads

    <|start|>role<|message|>text<|next|>text<|end|>

where ``<|next|>`` parts the turns that merged. A control string inside a role
or a text gets a backslash after its first character, and each backslash is
doubled, so no text can close a block and every text reads back as it was.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trove.operators.skew import lookup
from trove.session import stored

START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
#: Control strings of common templates; none starts in another's middle.
CONTROL = [START, MESSAGE, NEXT, END, "<|im_start|>", "<|im_end|>", "<s>", "</s>", "[INST]", "[/INST]"]
LOSS_ROLE = "assistant"

#: A part of a conversation has at most this many turns, ...
PART_TURNS = 256
#: ... and a turn begins a new part when this many characters went before.
PART_CHARS = 1 << 20

_TURN = "struct<role:string,text:string>"
_BLOCKS = "array<struct<role:string,texts:array<string>>>"
_SPANS = "array<struct<start:int,stop:int>>"


def escape(text: Column) -> Column:
    """``text`` without control strings; ``unescape`` gives it back."""
    ends = {}
    for word in CONTROL:
        ends.setdefault(word[0], []).append(re.escape(word[1:]))
    found = "|".join(f"{re.escape(c)}(?={'|'.join(rest)})" for c, rest in ends.items())
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), f"({found})", "$1\\\\")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _pieces(text: Column, mark: str) -> Column:
    return F.split(text, rf"\Q{mark}\E")


def merged(turns: Column) -> Column:
    """Sorted turn structs as blocks of neighbours that share their role."""

    def add(blocks: Column, turn: Column) -> Column:
        last = F.element_at(blocks, -1)
        longer = F.struct(
            last["role"].alias("role"), F.concat(last["texts"], F.array(turn["text"])).alias("texts")
        )
        fresh = F.struct(turn["role"].alias("role"), F.array(turn["text"]).alias("texts"))
        return F.when(
            (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == turn["role"]),
            F.concat(F.slice(blocks, 1, F.size(blocks) - 1), F.array(longer)),
        ).otherwise(F.concat(blocks, F.array(fresh)))

    return F.aggregate(turns, F.lit([]).cast(_BLOCKS), add)


def _spans(blocks: Column) -> Column:
    """Where the texts of ``LOSS_ROLE`` stand in the joined blocks."""

    def walk(at: Column, block: Column) -> Column:
        head = len(START) + len(MESSAGE) + F.char_length(block["role"])

        def text(inner: Column, one: Column) -> Column:
            size = F.char_length(one)
            span = F.struct(inner["at"].alias("start"), (inner["at"] + size).alias("stop"))
            return F.struct(
                (inner["at"] + size + len(NEXT)).alias("at"),
                F.when(block["role"] == LOSS_ROLE, F.concat(inner["spans"], F.array(span)))
                .otherwise(inner["spans"])
                .alias("spans"),
            )

        begin = F.struct((at["at"] + head).alias("at"), at["spans"].alias("spans"))
        return F.aggregate(
            block["texts"],
            begin,
            text,
            lambda got: F.struct(
                (got["at"] - len(NEXT) + len(END)).alias("at"), got["spans"].alias("spans")
            ),
        )

    zero = F.struct(F.lit(0).alias("at"), F.lit([]).cast(_SPANS).alias("spans"))
    return F.aggregate(blocks, zero, walk, lambda got: got["spans"])


def _numbered(rows: DataFrame) -> DataFrame:
    """Add ``_part``: 0 but in long conversations, whose parts are cut by running size.

    A long conversation's rows are dealt out by ranges of its turns; each task
    adds up its own rows, and what went before in earlier tasks is one number
    for each of them.
    """
    weight = F.char_length("text") + PART_CHARS // PART_TURNS
    rows = rows.withColumn("_size", weight.cast("long"))
    sizes = rows.groupBy("_key").agg(F.sum("_size").alias("_whole"))
    long = stored(sizes.where(F.col("_whole") > PART_CHARS), "long-conversations")
    total = long.agg(F.sum("_whole")).first()[0]
    if total is None:
        return rows.withColumn("_part", F.lit(0).cast("long"))
    marked = lookup(rows, long, "_key", F.col("_whole"), F.lit(total))
    short = marked.where(F.col("_whole").isNull())
    order = ["_key", "turn", "role", "text"]
    dealt = marked.where(F.col("_whole").isNotNull()).repartitionByRange(*order)
    dealt = stored(dealt.withColumn("_task", F.spark_partition_id()), "dealt-turns")
    here = Window.partitionBy("_task", "_key").orderBy(*order[1:])
    before = here.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("_key", "_task").agg(F.sum("_size").alias("_sum"))
    earlier = Window.partitionBy("_key").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    begun = sums.select("_key", "_task", F.sum("_sum").over(earlier).alias("_begun"))
    # A conversation that began in an earlier task: at most one for each task.
    begun = F.broadcast(begun.where("_begun IS NOT NULL"))
    placed = dealt.withColumn("_own", F.coalesce(F.sum("_size").over(before), F.lit(0)))
    placed = placed.join(begun, ["_key", "_task"], "left")
    ran = F.col("_own") + F.coalesce("_begun", F.lit(0))
    cut = placed.withColumn("_part", F.floor(ran / PART_CHARS).cast("long"))
    return short.withColumn("_part", F.lit(0).cast("long")).unionByName(cut.select(*short.columns, "_part"))


def format_conversations(turns: DataFrame) -> DataFrame:
    """``conv_id, part, formatted, loss`` of conversations given as rows.

    ``turns`` has ``conv_id, turn, role, text``; other columns are ignored,
    whatever their names. Turns are sorted by turn, then role, then text, so
    ties have one order and repeated rows stay repeated. A null text or role
    counts as empty; a null turn comes first; rows with a null id are
    one conversation. An empty table gives no rows.

    ``loss`` holds the places (code points, end exclusive) of every assistant
    text in ``formatted``, without marks. A conversation of more than
    ``PART_CHARS`` is written as several parts, numbered in order, each of which
    opens its own block; none of its turns is cut or left out.
    """
    rows = turns.select(
        F.col("conv_id").alias("conv_id"),
        F.col("turn").alias("turn"),
        F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.coalesce(F.concat(F.lit("="), F.col("conv_id").cast("string")), F.lit("")).alias("_key"),
    )
    grouped = _numbered(rows).groupBy("conv_id", "_part").agg(
        F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("_turns")
    )
    safe = F.transform(
        "_turns",
        lambda t: F.struct(escape(t["role"]).alias("role"), escape(t["text"]).alias("text")),
    ).cast(f"array<{_TURN}>")
    blocks = grouped.withColumn("_blocks", merged(safe))
    joined = F.array_join(
        F.transform(
            "_blocks",
            lambda b: F.concat(F.lit(START), b["role"], F.lit(MESSAGE), F.array_join(b["texts"], NEXT), F.lit(END)),
        ),
        "",
    )
    return blocks.select(
        "conv_id", F.col("_part").alias("part"), joined.alias("formatted"), _spans(F.col("_blocks")).alias("loss")
    )


def read_turns(formatted: Column) -> Column:
    """The turns that a formatted string holds, as ``role, text`` structs."""

    def block(one: Column) -> Column:
        role = F.substring_index(one, MESSAGE, 1)
        begin = F.char_length(role) + len(MESSAGE)
        texts = F.substring(one, begin + 1, F.char_length(one) - begin - len(END))
        return F.transform(
            _pieces(texts, NEXT),
            lambda t: F.struct(unescape(role).alias("role"), unescape(t).alias("text")),
        )

    pieces = _pieces(formatted, START)
    return F.flatten(F.transform(F.slice(pieces, 2, F.size(pieces)), block))


def read_loss(formatted: Column, loss: Column) -> Column:
    """The texts under the loss mask, one after another."""
    texts = F.transform(
        loss, lambda s: unescape(F.substring(formatted, s["start"] + 1, s["stop"] - s["start"]))
    )
    return F.array_join(texts, "")


_DIGEST = (
    "conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, "
    "loss_sha256 string, formatted_chars long"
)


def digests(formatted: DataFrame) -> DataFrame:
    """One row per conversation, read back from its parts.

    A digest runs over the parts in order and holds one of them at a time, so a
    conversation of any length needs the memory of one part.
    """
    turns = read_turns(F.col("formatted"))
    lines = F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    back = formatted.select(
        "conv_id",
        "part",
        F.size(turns).cast("long").alias("_turns"),
        F.array_join(lines, "").alias("_lines"),
        read_loss(F.col("formatted"), F.col("loss")).alias("_loss"),
        F.char_length("formatted").cast("long").alias("_chars"),
    ).withColumn("_loss_chars", F.char_length("_loss").cast("long"))
    dealt = back.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    kind = formatted.schema["conv_id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
        now, id_type = None, pa.int64()

        def rows(closed: list[list]) -> pa.RecordBatch:
            shown = [[c, n, t.hexdigest(), k, l.hexdigest(), f] for c, n, t, k, l, f in closed]
            types = [id_type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            arrays = [pa.array(list(v), t) for v, t in zip(zip(*shown), types)]
            return pa.RecordBatch.from_arrays(arrays, names)

        for batch in batches:
            id_type = batch.schema.field(0).type
            closed = []
            for i in range(batch.num_rows):
                conv, _, n, text, loss, chars, loss_chars = (c[i].as_py() for c in batch.columns)
                if now is None or conv != now[0]:
                    closed += [now] if now else []
                    now = [conv, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                now[1] += n
                now[2].update(text.encode())
                now[3] += loss_chars
                now[4].update(loss.encode())
                now[5] += chars
            if closed:
                yield rows(closed)
        if now:
            yield rows([now])

    return dealt.mapInArrow(run, _DIGEST.format(kind=kind.simpleString()))


def with_probe(turns: DataFrame, conv_id: int = -1) -> DataFrame:
    """``turns`` and one more conversation, whose texts are control strings."""
    probe = "</s>[INST] ok [/INST]"
    rows = [(conv_id, 0, "user", probe), (conv_id, 1, LOSS_ROLE, probe)]
    columns = ["conv_id", "turn", "role", "text"]
    more = turns.sparkSession.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    typed = more.select(*(F.col(c).cast(turns.schema[c].dataType) for c in columns))
    return turns.select(*columns).union(typed)
