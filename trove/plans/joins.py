"""How tables join: keys found in the data, and the cheapest tree that links some.

A column refers to a key when all its values are among those of the key: an
inclusion dependency. Bottom-k sketches of the columns' distinct values rule out
nearly all pairs; those left are verified on all values. Tables and dependencies
are a graph in which a question's tables are linked at least cost.
"""

from __future__ import annotations

import heapq
import re
from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trove.session import stored

#: Smallest hashes that a column's sketch holds.
SKETCH = 1024
#: How many times as many hashes are looked at for it.
SPARE = 4
#: What an edge costs whose columns are called alike, and any other.
ALIKE, UNLIKE = 1, 3

_PREFIX = re.compile(r"^[a-z]{1,2}_")
_EDGE = "child_table string, child_column string, parent_table string, parent_column string"


@dataclass(frozen=True)
class Edge:
    child_table: str
    child_column: str
    parent_table: str
    parent_column: str

    @property
    def cost(self) -> int:
        return ALIKE if plain_name(self.child_column) == plain_name(self.parent_column) else UNLIKE


def plain_name(column: str) -> str:
    """A column's name without the letter or two that stand for its table."""
    return _PREFIX.sub("", column)


def _kind(data_type: T.DataType) -> str | None:
    if isinstance(data_type, T.IntegralType):
        return "number"
    return "text" if isinstance(data_type, T.StringType) else None


def column_values(tables: dict[str, DataFrame]) -> DataFrame:
    """``(table, column, kind, hash, n)``: distinct values of whole-number and text columns.

    A value is known by a 64-bit hash, equal for all whole-number types; ``n`` is
    how often it occurs. Nulls are no values. Values are counted inside tasks first.
    """
    parts = []
    for name, df in sorted(tables.items()):
        cells, names, kinds = [], [], []
        for field in df.schema.fields:
            kind = _kind(field.dataType)
            if kind:
                value = F.col(f"`{field.name}`").cast("long" if kind == "number" else "string")
                hashed = F.when(value.isNotNull(), F.xxhash64(value))
                cells.append(F.struct(F.lit(len(cells)).alias("at"), hashed.alias("hash")))
                names.append(F.lit(field.name))
                kinds.append(F.lit(kind))
        if cells:
            # A column is a number while its values are counted: names are long.
            rows = df.select(F.explode(F.array(*cells)).alias("c")).where("c.hash IS NOT NULL")
            counted = rows.groupBy("c.at", "c.hash").agg(F.count(F.lit(1)).alias("n"))
            named = [F.array(*x)[F.col("at")].alias(c) for x, c in ((names, "column"), (kinds, "kind"))]
            parts.append(counted.select(F.lit(name).alias("table"), *named, "hash", "n"))
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    return found


def _lowest(values: DataFrame, columns: DataFrame, sketch: int) -> DataFrame:
    """The ``sketch`` smallest hashes of each column.

    Hashes are spread evenly, so a few times as many as are wanted lie below a
    bound that follows from their number, and only those are sorted. A column
    with too few below its bound is sorted whole.
    """
    names = ["table", "column"]
    share = F.lit(float(SPARE * sketch)) / F.col("distinct")
    bound = F.when(share < 0.5, (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long"))
    bounds = columns.select(*names, bound.alias("_bound"))
    near = values.join(F.broadcast(bounds), names).where("_bound IS NULL OR hash <= _bound")
    near = stored(near.select(*names, "kind", "hash"), "near-hashes")
    have = columns.join(near.groupBy(*names).agg(F.count(F.lit(1)).alias("_have")), names, "left")
    short = have.where(F.coalesce("_have", F.lit(0)) < F.least("distinct", F.lit(sketch))).select(*names)
    short = F.broadcast(stored(short, "short"))
    whole = values.join(short, names, "left_semi").select(*names, "kind", "hash")
    found = near.join(short, names, "left_anti").unionByName(whole)
    place = F.row_number().over(Window.partitionBy(*names).orderBy("hash"))
    return found.withColumn("_place", place).where(F.col("_place") <= sketch).drop("_place")


def inclusions(tables: dict[str, DataFrame], sketch: int = SKETCH) -> DataFrame:
    """``(child_table, child_column, parent_table, parent_column, n_child, n_parent)``.

    A parent is a column whose values never repeat. Every value of the child is
    among the parent's, which lies in another table; both have values, and are
    numbers or texts alike. ``n_`` are numbers of distinct values.
    """
    values = stored(column_values(tables), "column-values")
    columns = stored(
        values.groupBy("table", "column", "kind").agg(
            F.count(F.lit(1)).alias("distinct"), (F.max("n") == 1).alias("key")
        ),
        "columns",
    )
    lowest = stored(_lowest(values, columns, sketch), "sketches")
    # What a whole sketch says nothing about lies above its largest hash.
    reach = lowest.groupBy("table", "column").agg(F.max("hash").alias("reach"))
    keys = columns.where("key").join(reach, ["table", "column"])
    whole = F.col("distinct") <= sketch
    keys = keys.select(
        F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), "kind",
        F.col("distinct").alias("n_parent"), F.when(~whole, F.col("reach")).alias("reach"),
    )
    children = columns.select(
        F.col("table").alias("child_table"), F.col("column").alias("child_column"), "kind",
        F.col("distinct").alias("n_child"),
    )
    # Pairs of columns, of which a catalogue has few.
    pairs = children.join(keys, "kind").where("child_table <> parent_table AND n_child <= n_parent")
    mine = lowest.select(F.col("table").alias("child_table"), F.col("column").alias("child_column"), "hash")
    theirs = lowest.select(
        F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), "hash", F.lit(1).alias("there")
    )
    names = ["child_table", "child_column", "parent_table", "parent_column"]
    seen = pairs.join(mine, ["child_table", "child_column"]).where("reach IS NULL OR hash <= reach")
    missing = seen.join(theirs, ["parent_table", "parent_column", "hash"], "left").where("there IS NULL")
    likely = stored(pairs.join(missing.select(*names).distinct(), names, "left_anti"), "likely")

    all_mine = values.select(F.col("table").alias("child_table"), F.col("column").alias("child_column"), "hash")
    all_theirs = values.select(F.col("table").alias("parent_table"), F.col("column").alias("parent_column"), "hash")
    wanted = likely.select(*names).join(all_mine, ["child_table", "child_column"])
    absent = wanted.join(all_theirs, ["parent_table", "parent_column", "hash"], "left_anti")
    return likely.join(absent.select(*names).distinct(), names, "left_anti").select(*names, "n_child", "n_parent")


def edges(found: DataFrame) -> list[Edge]:
    """The dependencies, of which a catalogue has few, cheapest first."""
    names = [part.split()[0] for part in _EDGE.split(", ")]
    rows = [Edge(*r) for r in found.select(*names).collect()]
    return sorted(rows, key=lambda e: (e.cost, e.child_table, e.child_column, e.parent_table, e.parent_column))


def cheapest(found: list[Edge], start: str) -> dict[str, tuple[int, list[Edge]]]:
    """Cost and edges of the cheapest path from ``start`` to each table it reaches."""
    near: dict[str, list[tuple[str, Edge]]] = {}
    for e in found:
        near.setdefault(e.child_table, []).append((e.parent_table, e))
        near.setdefault(e.parent_table, []).append((e.child_table, e))
    done: dict[str, tuple[int, list[Edge]]] = {}
    todo: list = [(0, 0, start, [])]
    turn = 0
    while todo:
        cost, _, table, path = heapq.heappop(todo)
        if table in done:
            continue
        done[table] = (cost, path)
        for other, e in near.get(table, ()):
            if other not in done:
                turn += 1
                heapq.heappush(todo, (cost + e.cost, turn, other, [*path, e]))
    return done


def join_tree(found: list[Edge], tables: list[str]) -> list[Edge]:
    """Edges that link all of ``tables``, in the order in which they can be joined.

    Tables are added one after another, each by the cheapest path from those that
    are linked already. Raises ``ValueError`` for one that nothing links.
    """
    linked, out = [tables[0]], []
    left = [t for t in dict.fromkeys(tables) if t != tables[0]]
    while left:
        options = []
        for at in linked:
            reach = cheapest(found, at)
            options += [(reach[t][0], left.index(t), t, reach[t][1]) for t in left if t in reach]
        if not options:
            raise ValueError(f"nothing links {tables[0]} and {left[0]}")
        _, _, table, path = min(options, key=lambda o: o[:2])
        for e in path:
            if e not in out:
                out.append(e)
            linked += [t for t in (e.child_table, e.parent_table) if t not in linked]
        left = [t for t in left if t not in linked]
    return out


def join_statement(found: list[Edge], tables: list[str], select: str = "*") -> str:
    """A statement over all of ``tables`` and what lies between them."""
    have, parts = {tables[0]}, [f"SELECT {select} FROM {tables[0]}"]
    for e in join_tree(found, tables):
        new = e.parent_table if e.child_table in have else e.child_table
        on = f"{e.child_table}.{e.child_column} = {e.parent_table}.{e.parent_column}"
        if new not in have:
            parts.append(f"JOIN {new} ON {on}")
            have.add(new)
    return " ".join(parts)
