"""A small pattern language over property graphs: text -> plan -> joins.

``MATCH (a {id:7})-[:KNOWS]->(b)-[:WORKS]->(c) RETURN c`` walks one edge per step;
``MATCH (a)-[:KNOWS*1..3]->(b) WHERE a.id = 7 RETURN b`` takes nodes by distance.  The start
must be given by id.  Everything else is an error, not a guess.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from weftline.operators import graph

_NODE = r"\(\s*(\w+)?\s*(?:\{\s*id\s*:\s*('[^']*'|\"[^\"]*\"|-?\d+)\s*\})?\s*\)"
_STEP = r"-\[\s*(?::\s*(\w+))?\s*(?:\*\s*(\d+)\s*\.\.\s*(\d+))?\s*\]->|-->"
_QUERY = re.compile(rf"\s*MATCH\s+(?P<path>{_NODE}(?:\s*(?:{_STEP})\s*{_NODE})*)\s*(?:WHERE\s+(?P<var>\w+)(?:\.id)?\s*=\s*(?P<value>'[^']*'|\"[^\"]*\"|-?\d+)\s*)?RETURN\s+(?P<out>\w+)\s*;?\s*$", re.I)


@dataclass(frozen=True)
class Plan:
    """A seeded walk: fixed steps (a label or None each), or one step of a range of lengths."""

    start: str
    steps: tuple[str | None, ...]
    hops: tuple[int, int] | None = None


def parse(text: str) -> Plan:
    """The plan of a query; ValueError for anything outside the language."""
    found = _QUERY.match(text)
    if not found:
        raise ValueError(f"not understood: {text}")
    nodes = re.findall(_NODE, found["path"])
    steps = re.findall(_STEP, found["path"])
    names = [n for n, _ in nodes]
    if any(value for _, value in nodes[1:]):
        raise ValueError("only the first node may be given by id")
    start = nodes[0][1]
    if found["var"]:
        if start or found["var"] != names[0]:
            raise ValueError("WHERE must give the id of the first node, once")
        start = found["value"]
    if not start:
        raise ValueError("the first node needs an id")
    if not steps or found["out"] != names[-1] or names.count(found["out"]) > 1:
        raise ValueError("RETURN must name the last node")
    start = start.strip("'\"")
    ranged = [s for s in steps if s[1]]
    if ranged:
        if len(steps) > 1:
            raise ValueError("a range of lengths must be the only step")
        label, low, high = steps[0]
        if int(low) < 1 or int(high) < int(low):
            raise ValueError("a range of lengths must be low..high with 1 <= low")
        return Plan(start, (label or None,), (int(low), int(high)))
    return Plan(start, tuple(label or None for label, _, _ in steps))


def run(text: str, edges: DataFrame) -> DataFrame:
    """id: the nodes a query returns, each once."""
    plan = parse(text)
    kind = edges.schema["src"].dataType.simpleString()
    start = edges.sparkSession.createDataFrame([(plan.start,)], "id string").selectExpr(f"cast(id as {kind}) as id")
    if plan.hops:
        return graph.khop(edges, start, plan.hops[1], plan.hops[0], [plan.steps[0]] if plan.steps[0] else None).select("id")
    return graph.path_plan(edges, start, list(plan.steps))
