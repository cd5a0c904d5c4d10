"""Deeply nested JSON records to related flat tables, by shared inlining.

The shape of the records is a graph of elements: an edge leads from a parent
element to a child, once or repeated. `SchemaGraph.tables()` decides which
elements become tables of their own (the root, repeated ones, those with more
than one parent, and those that contain themselves); every other element is
inlined into the table of its nearest ancestor that has one. `shred` then builds
one DataFrame per table from variant values, with a key of its own and a foreign
key to its parent. All of it is column expressions and generators in the JVM.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stepfree.session import cut

_VARIANTS = "array<variant>"
#: Records nested deeper than this end the job with an error.
MOST_LEVELS = 64
_NUMBER = r"^\s*[-+]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][-+]?[0-9]+)?\s*$"


@dataclass(frozen=True)
class Edge:
    """`paths` are tried together, in order; `a[*].b` gathers the `b` of all
    objects in the array `a`, and `$` is the value itself."""

    parent: str
    child: str
    paths: tuple[str, ...]
    repeated: bool = False


@dataclass(frozen=True)
class Leaf:
    """A scalar of an element. kind: text (JSON strings), label (strings or
    numbers, as text), number (numbers or strings holding one), whole (integers),
    strict (numbers only), size (how many values an array has, null for no array)."""

    element: str
    name: str
    path: str
    kind: str


@dataclass(frozen=True)
class SchemaGraph:
    root: str
    edges: tuple[Edge, ...]
    leaves: tuple[Leaf, ...]

    def _reach(self, start: str) -> set[str]:
        seen: set[str] = set()
        todo = [start]
        while todo:
            here = todo.pop()
            for e in self.edges:
                if e.parent == here and e.child not in seen:
                    seen.add(e.child)
                    todo.append(e.child)
        return seen

    def tables(self) -> list[str]:
        """Elements with a table of their own, parents first."""
        elements = [self.root, *dict.fromkeys(e.child for e in self.edges)]
        chosen = set()
        for x in elements:
            incoming = [e for e in self.edges if e.child == x]
            if x == self.root or any(e.repeated for e in incoming) or len({e.parent for e in incoming}) > 1:
                chosen.add(x)
        for x in elements:  # of elements that contain each other, one has to have a table
            cycle = {y for y in self._reach(x) if x in self._reach(y)}
            if cycle and not cycle & chosen:
                chosen.add(x)
        return [x for x in elements if x in chosen]

    def inlined(self, table: str) -> list[tuple[str, tuple[str, ...]]]:
        """The table's element and the elements inlined into it, each with the
        path of keys that leads to it."""
        tables, found, todo = set(self.tables()), [(table, ())], [(table, ())]
        while todo:
            here, path = todo.pop(0)
            for e in self.edges:
                if e.parent == here and e.child not in tables:
                    step = (e.child, (*path, e.paths[0]))
                    found.append(step)
                    todo.append(step)
        return found

    def foreign_keys(self) -> list[tuple[str, str, Edge, tuple[str, ...]]]:
        """(child table, parent table, edge, path inside the parent's row)."""
        tables = set(self.tables())
        return [
            (e.child, owner, e, path)
            for owner in self.tables()
            for element, path in self.inlined(owner)
            for e in self.edges
            if e.parent == element and e.child in tables
        ]


def _step(value: str, path: str) -> str:
    """SQL of the array of variants that `path` gives on the variant `value`."""
    head, star, rest = path.partition("[*].")
    target = "$" if head == "$" else f"$.{head}"
    array = f"try_variant_get({value}, '{target}', '{_VARIANTS}')"
    if not star:
        return array
    inner = _step("s", rest)
    return f"flatten(transform({array}, s -> coalesce({inner}, cast(array() as {_VARIANTS}))))"


def _at(value: str, path: tuple[str, ...]) -> str:
    return f"try_variant_get({value}, '$.{'.'.join(path)}', 'variant')" if path else value


def _children(value: str, edge: Edge, inside: tuple[str, ...]) -> Column:
    at = _at(value, inside)
    if not edge.repeated:
        one = f"try_variant_get({at}, '$.{edge.paths[0]}', 'variant')"
        return F.expr(f"case when {one} is not null then array({one}) end")
    parts = ", ".join(f"coalesce({_step(at, p)}, cast(array() as {_VARIANTS}))" for p in edge.paths)
    return F.expr(f"concat({parts})")


def scalar(value: str, path: str, kind: str) -> Column:
    """A typed scalar of a variant; null where the value has another type."""
    got = f"try_variant_get({value}, '{path}', 'variant')"
    text = f"try_variant_get({value}, '{path}', 'string')"
    is_text = f"schema_of_variant({got}) = 'STRING'"
    is_number = f"(schema_of_variant({got}) in ('BIGINT', 'DOUBLE', 'FLOAT') or schema_of_variant({got}) like 'DECIMAL%')"
    as_number = f"try_cast({text} as double)"
    forms = {
        "text": f"case when {is_text} then {text} end",
        "label": f"case when {is_text} or {is_number} then {text} end",
        "number": f"case when {is_number} or ({is_text} and rlike({text}, '{_NUMBER}')) then {as_number} end",
        "whole": f"case when {is_number} then try_cast({text} as bigint) end",
        "strict": f"case when {is_number} then {as_number} end",
        "size": f"size(try_variant_get({value}, '{path}', '{_VARIANTS}'))",
    }
    return F.expr(forms[kind].replace("\\", "\\\\") if kind == "number" else forms[kind])


def whole_json(payload: Column) -> Column:
    """The variant of a text that is one whole JSON value, else null.

    The parser stops after the first value, so the text is wrapped in an object
    whose second key, a digest of the text itself, must be reached as well.
    """
    mark = F.md5(payload)
    return F.try_parse_json(F.concat(F.lit('{"v":'), payload, F.lit(',"'), mark, F.lit('":0}')))


def is_whole(payload: Column) -> Column:
    """Whether a text is one whole JSON value."""
    held = whole_json(payload).cast("map<string, variant>")
    return F.coalesce(F.map_contains_key(held, F.md5(payload)) & (F.size(held) == 2), F.lit(False))


def parse_records(df: DataFrame, key: str, payload: str, received: str | None = None) -> DataFrame:
    """(key, v) for each key's first delivery that is whole JSON.

    A key that comes several times counts once: the earliest delivery, then the
    lesser text, decides. Null keys, null, empty and damaged payloads are left
    out. Other columns are ignored, whatever their names. The aggregation keeps
    one row per key and task before anything is shuffled, so a record delivered
    a million times costs no task more than its own share.
    """
    when = F.col(received) if received else F.lit(0)
    rows = df.select(F.col(key).alias("key"), F.struct(when.alias("at"), F.col(payload).alias("payload")).alias("d"))
    one = rows.where(F.col("key").isNotNull() & F.col("d.payload").isNotNull()).groupBy("key").agg(F.min("d").alias("d"))
    wrapped = one.select("key", F.md5("d.payload").alias("mark"), whole_json(F.col("d.payload")).alias("w"))
    fits = "map_contains_key(cast(w as map<string, variant>), mark) and size(cast(w as map<string, variant>)) = 2"
    return wrapped.where(f"w is not null and {fits}").select("key", F.expr("try_variant_get(w, '$.v', 'variant')").alias("v"))


def _named(graph: SchemaGraph, table: str) -> list[tuple[str, Column]]:
    """Name and column of the scalars of a table and of what is inlined into it."""
    out = []
    for element, path in graph.inlined(table):
        for leaf in graph.leaves:
            if leaf.element == element:
                name = leaf.name if not path else f"{element}_{leaf.name}"
                at = "$" + "".join(p if p.startswith("[") else f".{p}" for p in (*path, leaf.path) if p != "$")
                out.append((name, scalar("v", at, leaf.kind).alias(name)))
    return out


def shred_values(records: DataFrame, graph: SchemaGraph, max_depth: int | None = None, keep: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """Per table (key, id, parent_id, parent_table, pos, v), before typing; see `shred`."""
    found: dict[str, DataFrame] = {
        graph.root: records.select(
            "key", F.col("key").cast("string").alias("id"), F.lit(None).cast("string").alias("parent_id"),
            F.lit(None).cast("string").alias("parent_table"), F.lit(0).alias("pos"), "v",
        )
    }
    keys = graph.foreign_keys()
    parents = {parent for _, parent, _, _ in keys}

    def below(parent: str, rows: DataFrame, edge: Edge, inside: tuple[str, ...]) -> DataFrame:
        tag = "/".join((*inside, edge.child))
        opened = rows.select("key", F.col("id").alias("parent_id"), F.posexplode(_children("v", edge, inside)).alias("pos", "v"))
        new = opened.select(
            "key", F.concat_ws(".", "parent_id", F.concat(F.lit(tag + ":"), F.col("pos").cast("string"))).alias("id"),
            "parent_id", F.lit(parent).alias("parent_table"), "pos", "v",
        )
        if keep and edge.child in keep:
            new = new.select("*", *[c for _, c in _named(graph, edge.child)]).where(keep[edge.child]).select(*new.columns)
        return new

    def add(child: str, part: DataFrame) -> None:
        found[child] = found[child].unionByName(part) if child in found else part

    if max_depth is None:
        # level by level: what is opened again is written once, so no branch is computed from the root
        level = {graph.root: found[graph.root]}
        for _ in range(MOST_LEVELS):
            ahead: dict[str, DataFrame] = {}
            for child, parent, edge, inside in keys:
                if parent in level:
                    part = below(parent, level[parent], edge, inside)
                    ahead[child] = ahead[child].unionByName(part) if child in ahead else part
            level = {}
            for child, part in ahead.items():
                if child in parents:
                    part = cut(part)
                    if part.take(1):
                        level[child] = part
                add(child, part)
            if not level:
                return found
        raise ValueError(f"records are nested deeper than {MOST_LEVELS} levels")
    # each way from the root through the tables is one branch
    frontier = [((graph.root,), found[graph.root])]
    while frontier:
        longer = []
        for way, rows in frontier:
            for child, parent, edge, inside in keys:
                if parent == way[-1] and way.count(child) <= max_depth:
                    part = below(parent, rows, edge, inside)
                    add(child, part)
                    longer.append(((*way, child), part))
        frontier = longer
    return found


def shred(records: DataFrame, graph: SchemaGraph, max_depth: int | None = None, keep: dict[str, str] | None = None) -> dict[str, DataFrame]:
    """The flat tables of `graph`: key, id, parent_id, parent_table, pos and the
    inlined scalars. Values of another type than declared come out null; rows are
    kept, so every child finds its parent. An empty input gives empty tables.

    `records` is (key, v). `pos` counts from 0 in the order written, over all the
    paths of an edge; an id is its parent's id, a dot, and "table:pos". Elements that
    contain themselves are followed to the end, level by level, each level written
    once; a `max_depth` follows them so many times and writes nothing. `keep` has
    conditions on columns of tables: other rows are left out with all below them,
    before anything in them is opened.
    """
    values = shred_values(records, graph, max_depth, keep)
    return {t: df.select("key", "id", "parent_id", "parent_table", "pos", *[c for _, c in _named(graph, t)]) for t, df in values.items()}


#: Image predictions: an array of items, or an object with `items`, or one with
#: `shards` that each hold `items`; a review may hold detections again.
PREDICTIONS = SchemaGraph(
    root="record",
    edges=(
        Edge("record", "run", ("run",)),
        Edge("record", "item", ("$", "items", "shards[*].items"), repeated=True),
        Edge("item", "detection", ("detections",), repeated=True),
        Edge("detection", "point", ("polygon_xy",), repeated=True),
        Edge("detection", "occlusion", ("occlusion",)),
        Edge("occlusion", "occluder", ("by",), repeated=True),
        Edge("detection", "review", ("review",)),
        Edge("review", "detection", ("detections",), repeated=True),
    ),
    leaves=(
        Leaf("run", "id", "run_id", "label"),
        Leaf("run", "device", "device", "text"),
        Leaf("item", "image_id", "image_id", "label"),
        Leaf("item", "image_width", "image_width", "whole"),
        Leaf("item", "image_height", "image_height", "whole"),
        Leaf("detection", "class_name", "class_name", "text"),
        Leaf("detection", "confidence", "confidence", "number"),
        Leaf("occlusion", "ratio", "ratio", "number"),
        Leaf("review", "verdict", "verdict", "text"),
        Leaf("point", "x", "[0]", "strict"),
        Leaf("point", "y", "[1]", "strict"),
        Leaf("point", "n_values", "$", "size"),
        Leaf("occluder", "class_name", "class_name", "text"),
        Leaf("occluder", "confidence", "confidence", "number"),
    ),
)


#: What makes items and detections valid; what is not is left out with all below it.
VALID = {
    "item": r"image_id rlike '\\S'",
    "detection": r"class_name rlike '\\S' and confidence > 0",
}


def valid_points(records: DataFrame) -> DataFrame:
    """(key, item_pos, det_pos, point_pos, x, y): one row per valid point of `records`.

    The rows of the point table of `shred` whose detection stands directly in an item
    (detections inside reviews are other rows of the detection table), with the
    positions read off the row's key. Valid: an item with a non-blank image_id (text
    or number) and an array of detections; a detection with a non-blank class_name text
    and a confidence above 0; a point that is an array of exactly two numbers. Invalid
    ones keep their position and give no row. The conditions are given to `shred`, so
    all of it is one pass without a shuffle.
    """
    points = shred(records, PREDICTIONS, 0, VALID)["point"].where("n_values = 2 and x is not null and y is not null")
    way = F.substring("parent_id", F.length(F.col("key").cast("string")) + 2, F.lit(2**31 - 1))
    steps = F.split(way, r"\.")
    number = lambda i: F.substring_index(steps[i], ":", -1).cast("int")
    return points.where(F.size(steps) == 2).select("key", number(0).alias("item_pos"), number(1).alias("det_pos"), F.col("pos").alias("point_pos"), "x", "y")
