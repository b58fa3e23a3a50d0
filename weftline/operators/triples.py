"""Triples (s, p, o): tables as triples, graph patterns as joins, RDFS closure, descriptions of a resource."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.session import materialize

# fixed values: names of the vocabulary
TYPE, SUB_CLASS, SUB_PROPERTY, DOMAIN, RANGE, SYMMETRIC = "rdf:type", "rdfs:subClassOf", "rdfs:subPropertyOf", "rdfs:domain", "rdfs:range", "owl:SymmetricProperty"


def from_table(df: DataFrame, subject: str, key: str, cls: str | None = None, literals: dict[str, str] | None = None, references: dict[str, tuple[str, str]] | None = None) -> DataFrame:
    """Triples of a table: subject template with ``{}`` for the key, a class, literal columns, and references as (column, template).

    A row without a key has no triples; a null value has none.
    """
    name = lambda template, c: F.concat(F.lit(template.split("{}")[0]), F.col(c).cast("string"), F.lit(template.split("{}")[1]))
    s = name(subject, key)
    parts = [F.struct(s.alias("s"), F.lit(TYPE).alias("p"), F.lit(cls).alias("o"))] if cls else []
    parts += [F.struct(s.alias("s"), F.lit(p).alias("p"), F.col(c).cast("string").alias("o")) for p, c in (literals or {}).items()]
    parts += [F.struct(s.alias("s"), F.lit(p).alias("p"), name(t, c).alias("o")) for p, (c, t) in (references or {}).items()]
    return df.filter(F.col(key).isNotNull()).select(F.explode(F.array(*parts)).alias("t")).select("t.*").filter("o is not null")


def match(triples: DataFrame, patterns: list[tuple[str, str, str]]) -> DataFrame:
    """Bindings of a graph pattern: one column per variable (``?x``); constants stand for themselves.

    Patterns that share a variable are joined on it; a pattern that shares none with those
    before it is an error, as it would ask for a product.
    """
    out = None
    for pattern in patterns:
        one, seen = triples, {}
        for column, term in zip("spo", pattern):
            if not term.startswith("?"):
                one = one.filter(F.col(column) == term)
            elif term[1:] in seen:
                one = one.filter(F.col(column) == F.col(seen[term[1:]]))
            else:
                seen[term[1:]] = column
        one = one.select(*[F.col(c).alias(v) for v, c in seen.items()]).distinct()
        if out is None:
            out = one
        else:
            shared = [v for v in seen if v in out.columns]
            if not shared:
                raise ValueError("the pattern falls apart; it shares no variable with those before it")
            out = out.join(one, shared)
    return out


def optional(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns], "left")


def minus(left: DataFrame, right: DataFrame) -> DataFrame:
    return left.join(right, [c for c in right.columns if c in left.columns], "left_anti")


def rdfs_closure(triples: DataFrame, rounds: int = 50) -> DataFrame:
    """Triples and all that follow by sub-classes, sub-properties, domains, ranges and symmetric properties.

    Each round derives only from triples new in the round before; it stops when none is new.
    """
    known = materialize(triples.select("s", "p", "o").distinct(), "rdfs")
    new = known
    for _ in range(rounds):
        t, d = known, new
        pick = lambda f, p: f.filter(F.col("p") == p)
        schema = lambda f, p, a, b: pick(f, p).select(F.col("s").alias(a), F.col("o").alias(b))
        derived = []
        for x, y in ((t, d), (d, t)):  # one premise is new
            derived += [
                schema(x, SUB_CLASS, "s", "m").join(schema(y, SUB_CLASS, "m", "o"), "m").select("s", F.lit(SUB_CLASS).alias("p"), "o"),
                schema(x, SUB_PROPERTY, "s", "m").join(schema(y, SUB_PROPERTY, "m", "o"), "m").select("s", F.lit(SUB_PROPERTY).alias("p"), "o"),
                pick(x, TYPE).select("s", F.col("o").alias("m")).join(schema(y, SUB_CLASS, "m", "o"), "m").select("s", F.lit(TYPE).alias("p"), "o"),
                x.select("s", F.col("p").alias("m"), "o").join(schema(y, SUB_PROPERTY, "m", "p"), "m").select("s", "p", "o"),
                x.select("s", F.col("p").alias("m")).join(schema(y, DOMAIN, "m", "o"), "m").select("s", F.lit(TYPE).alias("p"), "o"),
                x.select(F.col("o").alias("s"), F.col("p").alias("m")).join(schema(y, RANGE, "m", "o"), "m").select("s", F.lit(TYPE).alias("p"), "o"),
                x.select("s", "p", "o").join(y.filter((F.col("p") == TYPE) & (F.col("o") == SYMMETRIC)).select(F.col("s").alias("p")), "p").select(F.col("o").alias("s"), "p", F.col("s").alias("o")),
            ]
        new = materialize(reduce(DataFrame.unionByName, derived).distinct().join(known, ["s", "p", "o"], "left_anti"), "rdfs")
        if new.isEmpty():
            return known
        known = materialize(known.unionByName(new), "rdfs")
    raise RuntimeError(f"the closure did not settle in {rounds} rounds")


def describe(triples: DataFrame, resource: str) -> DataFrame:
    """Triples with the resource as subject or object, each once."""
    return triples.filter((F.col("s") == resource) | (F.col("o") == resource)).distinct()
