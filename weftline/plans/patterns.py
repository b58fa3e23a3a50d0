"""Query texts over property graphs and triples: MATCH with properties, step chains, SELECT and ASK.

nodes: id string, labels array<string>, properties map<string,string>; edges: src, dst, label;
triples: s, p, o.  Each text becomes a plan of joins and filters.  A form outside the language
raises ValueError: it is never answered in part.  Numbers compare as numbers.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import triples as tr

_OPS = {"=": lambda a, b: a == b, "<>": lambda a, b: a != b, "!=": lambda a, b: a != b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
_VALUE = r"'[^']*'|\"[^\"]*\"|-?\d+(?:\.\d+)?"


def _compare(column: Column, op: str, literal: str) -> Column:
    if literal[0] in "'\"":
        return _OPS[op](column, F.lit(literal[1:-1]))
    return _OPS[op](column.try_cast("double"), F.lit(float(literal)))


def match(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``MATCH (a:Person {city:'x'})-[:KNOWS]->(b) WHERE a.age > 10 AND b.name <> 'Al' RETURN b, b.name [ORDER BY b] [LIMIT n]``.

    A chain of nodes and outgoing or incoming edges; ``RETURN n`` gives the id, ``n.key`` the
    stored value (null if none), in columns named as written with a dot as underscore.
    """
    found = re.match(r"(?is)^\s*MATCH\s+(.+?)(?:\s+WHERE\s+(.+?))?\s+RETURN\s+(.+?)(?:\s+ORDER\s+BY\s+([\w.]+)(\s+DESC)?)?(?:\s+LIMIT\s+(\d+))?\s*;?\s*$", text)
    if not found:
        raise ValueError(f"not understood: {text}")
    chain, where, returned, order, descending, limit = found.groups()
    node = r"\(\s*(\w*)\s*((?::\w+)*)\s*(\{[^}]*\})?\s*\)"
    edge = r"(<?-)(?:\[\s*(?::(\w+))?\s*\])?(->?)"
    tokens = re.split(r"(\([^)]*\))", chain)
    if len(tokens) < 3 or tokens[0].strip() or tokens[-1].strip():
        raise ValueError(f"not a chain: {chain}")
    names: list[str] = []
    out = None
    for at in range(1, len(tokens), 2):
        n = re.fullmatch(node, tokens[at].strip())
        if not n:
            raise ValueError(f"not a node: {tokens[at]}")
        name = n[1] or f"_{at}"
        if name in names:
            raise ValueError(f"{name} stands twice")
        held = nodes.select(F.col("id").alias(name), F.col("labels").alias(f"{name}__l"), F.col("properties").alias(f"{name}__p"))
        for label in filter(None, n[2].split(":")):
            held = held.filter(F.array_contains(f"{name}__l", label))
        if n[3]:
            body = n[3].strip("{} ")
            pairs = re.findall(rf"(\w+)\s*:\s*({_VALUE})", body)
            if not body or re.sub(rf"\w+\s*:\s*(?:{_VALUE})", "", body).strip(" ,"):
                raise ValueError(f"not understood: {n[3]}")
            for key, value in pairs:
                held = held.filter(_compare(F.col(name) if key == "id" else F.col(f"{name}__p")[key], "=", value))
        if out is None:
            out = held
        else:
            e = re.fullmatch(edge, tokens[at - 1].strip())
            if not e or (e[1] == "<-") == (e[3] == "->"):
                raise ValueError(f"not an edge: {tokens[at - 1]}")
            mine, theirs = ("src", "dst") if e[3] == "->" else ("dst", "src")
            links = edges.filter(F.col("label") == e[2]) if e[2] else edges
            links = links.select(F.col(mine).alias(names[-1]), F.col(theirs).alias(name)).distinct()
            out = out.join(links, names[-1]).join(held, name)
        names.append(name)

    def value(term: str) -> Column:
        var, _, key = term.partition(".")
        if var not in names:
            raise ValueError(f"unknown name: {var}")
        return F.col(f"{var}__p")[key] if key and key != "id" else F.col(var)

    for part in re.split(r"(?i)\s+AND\s+", where) if where else []:
        c = re.fullmatch(rf"\s*(\w+(?:\.\w+)?)\s*(<>|!=|>=|<=|=|>|<)\s*({_VALUE})\s*", part)
        if not c:
            raise ValueError(f"not understood: {part}")
        out = out.filter(_compare(value(c[1]), c[2], c[3]))
    terms = [t.strip() for t in returned.split(",")]
    if not all(re.fullmatch(r"\w+(\.\w+)?", t) for t in terms):
        raise ValueError(f"not understood: {returned}")
    result = out.select(*[value(t).alias(t.replace(".", "_")) for t in terms]).distinct()
    if order:
        key = order.replace(".", "_")
        if key not in result.columns:
            raise ValueError("ORDER BY must name a returned column")
        result = result.orderBy(F.desc(key) if descending else F.asc(key), *[c for c in result.columns if c != key])
    elif limit:
        result = result.orderBy(*result.columns)
    return result.limit(int(limit)) if limit else result


def steps(text: str, nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``g.V('a').hasLabel('X').has('k','v').out('L').in().both().dedup().values('k').limit(3)``, ``.count()``: one column, value.

    Walkers are counted, so a vertex reached twice comes twice until ``dedup``.
    """
    found = re.fullmatch(r"\s*g\.V\(([^)]*)\)((?:\.\w+\([^)]*\))*)\s*", text)
    if not found:
        raise ValueError(f"not understood: {text}")
    strings = lambda s: [m[1:-1] for m in re.findall(r"'[^']*'|\"[^\"]*\"", s)]
    at = nodes.select(F.col("id").alias("value"))
    if found[1].strip():
        at = at.filter(F.col("value").isin(*strings(found[1])))
    vertices = True
    for name, raw in re.findall(r"\.(\w+)\(([^)]*)\)", found[2]):
        args = strings(raw)
        if not vertices and name not in ("dedup", "limit", "count"):
            raise ValueError(f"{name} needs vertices")
        if name == "hasLabel" and args:
            at = at.join(nodes.filter(F.arrays_overlap("labels", F.array(*[F.lit(a) for a in args]))).select(F.col("id").alias("value")), "value", "left_semi")
        elif name == "has" and len(args) == 2:
            at = at.join(nodes.filter(F.col("properties")[args[0]] == args[1]).select(F.col("id").alias("value")), "value", "left_semi")
        elif name in ("out", "in", "both"):
            links = edges.filter(F.col("label").isin(*args)) if args else edges
            out, back = links.select(F.col("src").alias("value"), F.col("dst").alias("to")), links.select(F.col("dst").alias("value"), F.col("src").alias("to"))
            way = out if name == "out" else back if name == "in" else out.unionByName(back)
            at = at.join(way, "value").select(F.col("to").alias("value"))
        elif name == "values" and len(args) == 1:
            at = at.join(nodes.select(F.col("id").alias("value"), F.col("properties")[args[0]].alias("v")), "value").filter("v is not null").select(F.col("v").alias("value"))
            vertices = False
        elif name == "dedup" and not raw.strip():
            at = at.distinct()
        elif name == "limit" and raw.strip().isdigit():
            at = at.orderBy("value").limit(int(raw))
        elif name == "count" and not raw.strip():
            at, vertices = at.agg(F.count(F.lit(1)).cast("string").alias("value")), False
        else:
            raise ValueError(f"unsupported step: {name}({raw})")
    return at


_TERM = r"\?\w+|<[^>]+>|\"[^\"]*\"|'[^']*'|[\w:./#-]+"


def _clean(term: str) -> str:
    return term.strip("<>") if term[0] == "<" else term[1:-1] if term[0] in "\"'" else term


def _group(body: str, data: DataFrame) -> DataFrame:
    """Bindings of a group: patterns, FILTER, OPTIONAL, MINUS, VALUES of one variable, and UNION of groups."""
    out, patterns, rest = None, [], body.strip()
    late, given = [], []
    while rest:
        block = re.match(r"(?is)(OPTIONAL|MINUS)\s*\{([^{}]*)\}\s*\.?\s*", rest)
        union = re.match(r"(?is)(\{[^{}]*\}(?:\s*UNION\s*\{[^{}]*\})+)\s*\.?\s*", rest)
        check = re.match(rf"(?is)FILTER\s*\(\s*\?(\w+)\s*(<=|>=|!=|=|<|>)\s*({_VALUE})\s*\)\s*\.?\s*", rest)
        triple = re.match(rf"({_TERM})\s+({_TERM})\s+({_TERM})\s*(?:\.\s*|$)", rest)
        values = re.match(r"(?is)VALUES\s+\?(\w+)\s*\{([^{}]*)\}\s*\.?\s*", rest)
        if values:
            given.append((values[1], [_clean(t) for t in re.findall(_TERM, values[2])]))
        elif block:
            late.append((block[1].upper(), block[2]))
        elif union:
            parts = [_group(g, data) for g in re.findall(r"\{([^{}]*)\}", union[1])]
            both = parts[0]
            for p in parts[1:]:
                both = both.unionByName(p, allowMissingColumns=True)
            out = both if out is None else out.join(both, [c for c in both.columns if c in out.columns])
        elif check:
            late.append(("FILTER", check))
        elif triple:
            patterns.append(tuple(_clean(t) for t in triple.groups()))
        else:
            raise ValueError(f"not understood: {rest[:60]}")
        rest = rest[(values or block or union or check or triple).end() :]
    if patterns:
        found = tr.match(data, patterns)
        if out is None:
            out = found
        else:
            shared = [c for c in found.columns if c in out.columns]
            if not shared:
                raise ValueError("the group falls apart")
            out = out.join(found, shared)
    if out is None:
        raise ValueError("an empty group")
    for name, terms in given:
        if name not in out.columns:
            raise ValueError(f"unknown variable ?{name}")
        out = out.filter(F.col(name).isin(terms))
    for kind, what in late:
        if kind == "FILTER":
            if what[1] not in out.columns:
                raise ValueError(f"unknown variable ?{what[1]}")
            out = out.filter(_compare(F.col(what[1]), what[2], what[3]))
        else:
            other = _group(what, data)
            if not set(other.columns) & set(out.columns):
                raise ValueError(f"{kind} shares no variable")
            out = tr.optional(out, other) if kind == "OPTIONAL" else tr.minus(out, other)
    return out


def select(text: str, data: DataFrame) -> DataFrame:
    """``SELECT [DISTINCT] ?a ?b WHERE { ... } [GROUP BY ?a] [LIMIT n]`` with ``(COUNT(?b) AS ?n)``; ``ASK { ... }`` gives one row, answer."""
    ask = re.match(r"(?is)^\s*ASK\s*(?:WHERE\s*)?\{(.*)\}\s*$", text)
    if ask:
        return _group(ask[1], data).limit(1).agg((F.count(F.lit(1)) > 0).alias("answer"))
    found = re.match(r"(?is)^\s*SELECT\s+(DISTINCT\s+)?(.+?)\s*WHERE\s*\{(.*)\}\s*(?:GROUP\s+BY\s+((?:\?\w+\s*)+))?(?:LIMIT\s+(\d+))?\s*$", text)
    if not found:
        raise ValueError(f"not understood: {text}")
    distinct, head, body, grouped, limit = found.groups()
    out = _group(body, data)
    counts = re.findall(r"(?i)\(\s*COUNT\s*\(\s*(\*|\?\w+)\s*\)\s+AS\s+\?(\w+)\s*\)", head)
    plain = re.findall(r"\?(\w+)", re.sub(r"\([^()]*\([^()]*\)[^()]*\)", "", head)) if head.strip() != "*" else out.columns
    if re.sub(r"(?i)\(\s*COUNT\s*\(\s*(?:\*|\?\w+)\s*\)\s+AS\s+\?\w+\s*\)|\?\w+|\*", "", head).strip() or any(v not in out.columns for v in plain):
        raise ValueError(f"not understood: SELECT {head}")
    if counts or grouped:
        keys = re.findall(r"\?(\w+)", grouped or "")
        if set(plain) - set(keys) or not counts:
            raise ValueError("every plain variable must be grouped, and something counted")
        out = out.groupBy(*keys).agg(*[F.count(F.lit(1) if v == "*" else F.col(v[1:])).alias(n) for v, n in counts]).select(*plain, *[n for _, n in counts])
    else:
        out = out.select(*plain)
    out = out.distinct() if distinct else out
    return out.orderBy(*out.columns).limit(int(limit)) if limit else out


def validate(data: DataFrame, shapes: list[dict]) -> DataFrame:
    """node, path, rule, value: where triples (s, p, o) break the shapes; nothing where they keep them.

    A shape: target (a class), path, and any of min, max (how many values), in (allowed values),
    pattern (a regular expression that values must hold), class (of the nodes that values name).
    An unknown key is an error.  Nodes without any value count for min.
    """
    types = data.filter("p = 'rdf:type'").select(F.col("s").alias("node"), F.col("o").alias("is_a")).distinct()
    out = None
    for shape in shapes:
        if set(shape) - {"target", "path", "min", "max", "in", "pattern", "class"} or not {"target", "path"} <= set(shape):
            raise ValueError(f"not understood: {shape}")
        nodes = types.filter(F.col("is_a") == shape["target"]).select("node")
        values = data.filter(F.col("p") == shape["path"]).select(F.col("s").alias("node"), F.col("o").alias("value")).distinct()
        held = nodes.join(values, "node", "left")
        breaks = []
        n = F.count("value")
        if "min" in shape or "max" in shape:
            wrong = F.when(n < shape.get("min", 0), "min").when(n > shape["max"], "max") if "max" in shape else F.when(n < shape["min"], "min")
            breaks.append(held.groupBy("node").agg(wrong.alias("rule")).filter("rule is not null").select("node", "rule", F.lit(None).cast("string").alias("value")))
        if "in" in shape:
            breaks.append(held.filter(~F.col("value").isin(list(shape["in"]))).select("node", F.lit("in").alias("rule"), "value"))
        if "pattern" in shape:
            breaks.append(held.filter(~F.col("value").rlike(shape["pattern"])).select("node", F.lit("pattern").alias("rule"), "value"))
        if "class" in shape:
            good = types.filter(F.col("is_a") == shape["class"]).select(F.col("node").alias("value"))
            breaks.append(held.filter("value is not null").join(good, "value", "left_anti").select("node", F.lit("class").alias("rule"), "value"))
        for b in breaks:
            one = b.select("node", F.lit(shape["path"]).alias("path"), "rule", "value")
            out = one if out is None else out.unionByName(one)
    if out is None:
        raise ValueError("no shape asks for anything")
    return out
