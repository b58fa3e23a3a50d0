"""Deeply nested records to related flat tables (shared inlining).

1. The schema graph counts, per pair of element names, how a child stands under a parent; its
   size follows the schema, not the data.
2. ``inline_plan`` gives a table of its own to every element that is repeated under one
   parent, shared by several parents, or recursive; every other descendant is inlined into
   the columns of its nearest ancestor with a table.
3. The rows of all tables are written with their keys: a row number within the record, the
   number of the parent row, and, where declared, the natural ids of both ends.

``flatten`` does all three in one reading.  A plan drawn from the first bodies is only a
guess: the pass that writes the rows by it also counts the schema graph of all bodies, and if
the plan of the whole graph differs, the rows are written again by that one.
``Flat.table`` gives one typed frame per table.

Field-name style does not matter (``routineId``, ``routine-id`` and ``routine_id`` are one
name), a single object where a list is usual counts as a list of one, and an object written
as a JSON string counts as the object.  A body that is null or no valid JSON has no rows.
"""

from __future__ import annotations

import json
import re
from collections import defaultdict
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import fresh_path

#: Bodies that the first guess of the plan is drawn from.
GUESS_ROWS = 2_000
#: A schema graph of more edges than this is not a schema (ids used as field names).
MAX_EDGES = 50_000
ROOT = "record"
VALUE = "value"

_HUMP = re.compile(r"(?<=[a-z0-9])(?=[A-Z])|(?<=[A-Z])(?=[A-Z][a-z])")
_SEPARATORS = re.compile(r"[^0-9A-Za-z]+")
_names: dict[str, str] = {}


def field_name(raw: str) -> str:
    """The snake_case name of a field, whatever the writer's style."""
    name = _names.get(raw)
    if name is None:
        name = _SEPARATORS.sub("_", _HUMP.sub("_", raw)).strip("_").lower() or raw
        if len(_names) < 100_000:
            _names[raw] = name
    return name


def _no_constant(text: str):
    raise ValueError(f"{text} is not JSON")


_decode = json.JSONDecoder(parse_constant=_no_constant).decode


def parse_body(body: str | None):
    """The parsed body; None if it is null, no valid JSON, or nested too deeply to read."""
    if body is None:
        return None
    try:
        return _decode(body)
    except (ValueError, RecursionError):
        return None


#: What a JSON object or list in a string can start with, and the types that are plain values without a look inside.
_MAYBE = frozenset("{[ \t\r\n")
_PLAIN = frozenset((int, float, bool, type(None)))


def _opened(value):
    """An object or list given as a JSON string is opened; everything else stays."""
    if isinstance(value, str) and value[:1] in _MAYBE and value[:64].lstrip()[:1] in ("{", "["):
        try:
            inner = _decode(value)
        except (ValueError, RecursionError):
            return value
        return inner if isinstance(inner, (dict, list)) else value
    return value


def _items(value):
    """(items, is_list): the members under one field, lists in lists flattened, nulls left out."""
    value = _opened(value)
    if not isinstance(value, list):
        return ([] if value is None else [value]), False
    out, todo = [], [iter(value)]
    while todo:
        for item in todo[-1]:
            item = _opened(item)
            if isinstance(item, list):
                todo.append(iter(item))
                break
            if item is not None:
                out.append(item)
        else:
            todo.pop()
    return out, True


def _text(value) -> str:
    if isinstance(value, bool):
        return "true" if value else "false"
    return value if isinstance(value, str) else json.dumps(value)


@dataclass(frozen=True)
class Plan:
    """Which element names have a table of their own, and why."""

    tables: frozenset[str]
    reasons: dict[str, str] = field(default_factory=dict, hash=False, compare=False)


def inline_plan(edges: list[tuple], force: tuple[str, ...] = ()) -> Plan:
    """Tables for repeated, shared and recursive elements; ``force`` names elements that get one even if they are none of these.

    ``edges``: (parent, child, seen, most, is_object).  Plain values that are never repeated
    stay columns even if many parents have them.
    """
    parents, below = defaultdict(set), defaultdict(set)
    reasons: dict[str, str] = {}
    for parent, child, _, most, is_object in edges:
        if is_object:
            parents[child].add(parent)
            below[parent].add(child)
        if most > 1:
            reasons.setdefault(child, "repeated")
    for child, above in parents.items():
        if len(above) > 1:
            reasons.setdefault(child, "shared")

    def reaches_itself(start: str) -> bool:
        seen, todo = set(), list(below[start])
        while todo:
            name = todo.pop()
            if name == start:
                return True
            if name not in seen:
                seen.add(name)
                todo.extend(below[name])
        return False

    for name in list(parents):
        if name not in reasons and reaches_itself(name):
            reasons[name] = "recursive"
    for name in force:
        reasons.setdefault(name, "declared")
    return Plan(frozenset(reasons) | {ROOT}, reasons)


@dataclass(frozen=True)
class Link:
    """A declared parent-child link between natural ids.

    child_of: the element whose rows are the children; child_id: the field that holds the
    child's id (``value`` for plain values).  parent_id: the field of the holder, ``up``
    objects above the child.  If ``self_id`` is given, the nearest enclosing element of the
    same name comes before the holder and gives its ``self_id``.
    """

    name: str
    child_of: str
    child_id: str
    parent_id: str
    up: int = 1
    self_id: str | None = None


def _field(node, name: str):
    if not isinstance(node, dict):
        return None
    for raw, value in node.items():
        if field_name(raw) == name:
            return value
    return None


def _id_of(value) -> str | None:
    return _text(value) if isinstance(value, (str, int, float)) and not isinstance(value, bool) else None


#: Kinds of plain values, as bits; a column's type follows from all kinds seen in it.
_INT, _FLOAT, _BOOL, _STRING = 1, 2, 4, 8
_BITS = {int: _INT, float: _FLOAT, bool: _BOOL, str: _STRING}


def _sql_type(bits: int) -> str:
    return {_INT: "bigint", _FLOAT: "double", _INT | _FLOAT: "double", _BOOL: "boolean"}.get(bits, "string")


def _link_ids(link: Link, name: str, node, chain) -> tuple[str | None, str | None]:
    """(child_id, parent_id) of a row of a linked element."""
    child_id = _id_of(node) if link.child_id == VALUE else _id_of(_field(node, link.child_id))
    if link.self_id is not None:
        walk = chain
        while walk is not None:
            if walk[0] == name:
                return child_id, _id_of(_field(walk[1], link.self_id))
            walk = walk[2]
    for _ in range(link.up - 1):
        chain = chain[2] if chain is not None else None
    return child_id, _id_of(_field(chain[1], link.parent_id)) if chain is not None else None


class _Walk:
    """One task's reading of bodies: rows of the wanted tables, and what was seen of the schema."""

    def __init__(self, tables: frozenset, links: dict[str, Link], only: frozenset | None, with_columns: bool):
        self.tables, self.links, self.only, self.with_columns = tables, links, only, with_columns
        self.edges: dict[tuple, list] = {}
        self.kinds: dict[tuple, int] = {}
        self.known: dict[str, tuple[str, bool]] = {}  # field as written -> (name, whether it has a table)

    def _name(self, raw: str) -> tuple[str, bool]:
        name = field_name(raw)
        found = name, name in self.tables
        if len(self.known) < 100_000:
            self.known[raw] = found
        return found

    def rows(self, value) -> list[tuple]:
        """(table, row, parent table, parent row, ordinal, child id, parent id, columns) of one body, parents before children."""
        known, edges, kinds, only, out, count = self.known, self.edges, self.kinds, self.only, [], 0
        # chain: the enclosing objects as (element name, object, chain above)
        stack = [(ROOT, x, None, None, None, i) for i, x in reversed(list(enumerate(_items(value)[0])))]
        while stack:
            name, node, chain, parent_table, parent_row, ordinal = stack.pop()
            number, count = count, count + 1
            wanted = only is None or name in only
            columns: list | None = [] if wanted and self.with_columns else None
            children = []
            if isinstance(node, dict):
                inlined = [(node, name, "", (name, node, chain))]
                for obj, above, prefix, here in inlined:
                    for raw, sub in obj.items():
                        child, tabled = known.get(raw) or self._name(raw)
                        kind = type(sub)
                        if (kind is str and sub[:1] not in _MAYBE) or kind in _PLAIN:
                            if tabled:
                                if sub is not None:
                                    children.append((child, sub, here, name, number, 0))
                            elif columns is not None and sub is not None:
                                columns.append((prefix + child, sub))
                            continue
                        items, listed = _items(sub)
                        edge = edges.get((above, child))
                        if edge is None:
                            edge = edges[above, child] = [0, 0, 0]
                        edge[0] += 1
                        most = len(items)
                        if listed and most < 2:
                            most = 2
                        if most > edge[1]:
                            edge[1] = most
                        for i, x in enumerate(items):
                            if isinstance(x, dict):
                                edge[2] = 1
                                if not tabled:
                                    inlined.append((x, child, f"{prefix}{child}." if columns is not None else "", (child, x, here)))
                            elif not tabled and columns is not None:
                                columns.append((prefix + child, x))
                            if tabled:
                                children.append((child, x, here, name, number, i))
            elif columns is not None:
                columns.append((VALUE, node))
            if wanted:
                link = self.links.get(name)
                child_id, parent_id = (None, None) if link is None else _link_ids(link, name, node, chain)
                if columns:
                    for path, x in columns:
                        key = name, path
                        kinds[key] = kinds.get(key, 0) | _BITS.get(type(x), _STRING)
                out.append((name, number, parent_table, parent_row, ordinal, child_id, parent_id, [(p, _text(x)) for p, x in dict(columns).items()] if columns else []))
            children.reverse()
            stack.extend(children)
        return out

    def seen(self) -> str:
        return json.dumps([[[*k, *v] for k, v in self.edges.items()], [[*k, v] for k, v in self.kinds.items()]])


_ROW = pa.schema([
    ("record_id", pa.int64()), ("body_id", pa.int64()), ("table_name", pa.string()), ("row_no", pa.int32()), ("parent_table", pa.string()), ("parent_row", pa.int32()),
    ("ordinal", pa.int32()), ("child_id", pa.string()), ("parent_id", pa.string()), ("columns", pa.map_(pa.string(), pa.string())), ("seen", pa.string()),
])
ROW_DDL = "record_id bigint, body_id bigint, table_name string, row_no int, parent_table string, parent_row int, ordinal int, child_id string, parent_id string, columns map<string,string>, seen string"


def _read(df: DataFrame, plan: Plan, links: tuple[Link, ...], only, with_columns: bool, guess: bool = False) -> DataFrame:
    """Rows of the plan's tables, and per task a row that holds in ``seen`` what it saw of the schema (with ``guess`` that row alone)."""
    tables, by_name, chosen = plan.tables, {k.child_of: k for k in links}, None if only is None else frozenset(only)

    def run(batches):
        walk = _Walk(tables, by_name, frozenset() if guess else chosen, with_columns)
        for batch in batches:
            out = []
            for rid, bid, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                value = parse_body(text)
                if value is not None:
                    out.extend((rid, bid, *row, None) for row in walk.rows(value))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x, t.type) for x, t in zip(zip(*out), _ROW)], schema=_ROW)
        yield pa.RecordBatch.from_pylist([{"columns": [], "seen": walk.seen()}], schema=_ROW)

    return df.mapInArrow(run, ROW_DDL)


def _combined(seen: list[str]) -> tuple[list[tuple], dict[tuple, int]]:
    """(edges of the schema graph, kinds of values per table and column) from those of the tasks; an error if these are no fixed field names."""
    edges: dict[tuple, list] = {}
    kinds: dict[tuple, int] = {}
    for text in seen:
        one, more = json.loads(text)
        for parent, child, n, most, is_object in one:
            e = edges.setdefault((parent, child), [0, 0, 0])
            e[:] = [e[0] + n, max(e[1], most), max(e[2], is_object)]
        for table, column, bits in more:
            kinds[table, column] = kinds.get((table, column), 0) | bits
        if len(edges) > MAX_EDGES or len(kinds) > MAX_EDGES:
            raise ValueError(f"more than {MAX_EDGES} pairs of field names: these are no fixed field names")
    return [(*k, *v) for k, v in edges.items()], kinds


class Flat:
    """The flat tables of nested records: the plan, all rows in one frame, and one typed frame per table.

    (record_id, body_id, row_no) is a row's key and (record_id, body_id, parent_row) its foreign
    key into ``parent_table``; body_id is a hash of the body, so a record received twice gives
    equal rows, which ``table`` leaves out.
    """

    def __init__(self, plan: Plan, rows: DataFrame, kinds: dict[tuple, int]):
        self.plan, self.rows, self.kinds = plan, rows, kinds

    def columns_of(self, name: str) -> dict[str, str]:
        """Inlined columns of a table, by path, and their SQL types: one type for numbers, logical values and text."""
        return {c: _sql_type(bits) for (t, c), bits in sorted(self.kinds.items()) if t == name}

    def table(self, name: str) -> DataFrame:
        """record_id, body_id, row_no, parent_table, parent_row, ordinal, child_id, parent_id and a typed column per inlined field (dots of its path as __)."""
        keys = ["record_id", "body_id", "row_no"]
        typed = [F.try_element_at("columns", F.lit(path)).try_cast(kind).alias(path.replace(".", "__") if path not in _KEYS else f"{path}_") for path, kind in self.columns_of(name).items()]
        held = self.rows.filter(F.col("table_name") == name)
        return held.select(*keys, "parent_table", "parent_row", "ordinal", F.col("child_id").alias("link_child_id"), F.col("parent_id").alias("link_parent_id"), *typed).dropDuplicates(keys)


_KEYS = ("record_id", "body_id", "row_no", "parent_table", "parent_row", "ordinal", "link_child_id", "link_parent_id")


def flatten(df: DataFrame, links: tuple[Link, ...] = (), record_id: str = "record_id", body: str = "body", only: tuple[str, ...] | None = None, with_columns: bool = True) -> Flat:
    """All tables of nested records (or the rows of ``only`` these), by one reading; see the module's text.

    Elements named by a link have a table even if they are neither repeated, shared nor recursive.
    """
    spark, force = df.sparkSession, tuple(k.child_of for k in links)
    source = df.select(F.col(record_id).cast("bigint").alias("record_id"), F.xxhash64(body).alias("body_id"), F.col(body).alias("body"))
    nothing = Plan(frozenset({ROOT}))
    first = [r[0] for r in _read(source.limit(GUESS_ROWS), nothing, (), None, False, True).select("seen").collect()]  # a row per task
    plan = inline_plan(_combined(first)[0], force)
    for _ in range(2):
        path = fresh_path(spark, "nested")
        read = _read(source, plan, links, only, with_columns)
        read.withColumn("is_seen", F.col("seen").isNotNull()).write.partitionBy("is_seen").parquet(path)
        held = spark.read.schema(f"{ROW_DDL}, is_seen boolean").parquet(path)
        edges, kinds = _combined([r[0] for r in held.filter("is_seen").select("seen").collect()])  # a row per task, schema-sized
        whole = inline_plan(edges, force)
        if whole.tables == plan.tables:
            return Flat(whole, held.filter("not is_seen").drop("is_seen", "seen"), kinds)
        plan = whole
    raise RuntimeError("the records changed while they were read")


#: The links of fired records, by the element that holds the child.
FIRED_LINKS = (
    Link("action", "actions", "action_id", "routine_id", 1, "action_id"),
    Link("policy_ref", "policy_refs", VALUE, "decision_id", 2),
    Link("strategy", "declarative_updates", "strategy", "profile_id", 1),
)


def record_links(df: DataFrame, links: tuple[Link, ...] = FIRED_LINKS, record_id: str = "record_id", body: str = "body") -> DataFrame:
    """Each distinct link: record_id, link, parent_id, child_id.

    No link where either id is null or missing; none from a body that is no valid JSON.
    """
    flat = flatten(df, links, record_id, body, tuple(k.child_of for k in links), False)
    names = F.create_map(*[F.lit(x) for k in links for x in (k.child_of, k.name)])
    held = flat.rows.filter(F.col("child_id").isNotNull() & F.col("parent_id").isNotNull())
    return held.select("record_id", names[F.col("table_name")].alias("link"), "parent_id", "child_id").distinct()
