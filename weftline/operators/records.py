"""Records from several places: layered settings, class hierarchies, status enrichment, evidence for figures, shapes of nodes and edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import broadcast_if_small, materialize


def layered(layers: list[DataFrame], keys: list[str], value: str) -> DataFrame:
    """keys, value, layer: settings of several layers in one; a later layer's value hides an earlier one's.

    A null value says nothing and hides nothing.  layer: the number of the layer that decided.
    One aggregate over the union, combined before its shuffle.
    """
    marked = [df.select(*keys, F.col(value), F.lit(i).alias("layer")) for i, df in enumerate(layers)]
    every = reduce(DataFrame.unionByName, marked).filter(F.col(value).isNotNull())
    top = F.max(F.struct("layer", value)).alias("t")
    return every.groupBy(*keys).agg(top).select(*keys, F.col(f"t.{value}").alias(value), F.col("t.layer").alias("layer"))


def inherited(classes: DataFrame, properties: DataFrame, depth: int = 12) -> DataFrame:
    """class, name, value, distance: own and inherited properties; of equal names the nearest class's counts (ties to the least value).

    classes: id, parent; properties: class, name, value.  Ancestors beyond ``depth`` steps are
    an error, so a cycle is one too.
    """
    up = materialize(classes.select(F.col("id").alias("class"), "parent").filter("parent is not null").distinct(), "classes")
    pairs = frontier = materialize(classes.select(F.col("id").alias("class"), F.col("id").alias("ancestor"), F.lit(0).alias("distance")).distinct(), "classes", count="true")
    for step in range(1, depth + 2):
        nxt = frontier.join(up.withColumnRenamed("class", "_c"), F.col("ancestor") == F.col("_c")).select("class", F.col("parent").alias("ancestor"), F.lit(step).alias("distance")).distinct()
        frontier = materialize(nxt, "classes", count="true")
        if not frontier._counted:
            break
        if step > depth:
            raise ValueError(f"a class has ancestors beyond {depth} steps")
        pairs = pairs.unionByName(frontier)
    held = pairs.join(properties.select(F.col("class").alias("ancestor"), "name", "value"), "ancestor")
    nearest = F.min(F.struct("distance", "value")).alias("n")
    return held.groupBy("class", "name").agg(nearest).select("class", "name", F.col("n.value").alias("value"), F.col("n.distance").alias("distance"))


def with_status(df: DataFrame, columns: list[str], statuses: DataFrame) -> DataFrame:
    """df with ``<column>_status``: the status of every value that is a known id; null elsewhere.  statuses: id, status."""
    known = broadcast_if_small(statuses.groupBy("id").agg(F.min("status").alias("status")))
    for c in columns:
        df = df.join(known.select(F.col("id").alias(f"_{c}"), F.col("status").alias(f"{c}_status")), F.col(c).cast("string") == F.col(f"_{c}"), "left").drop(f"_{c}")
    return df


def crosswalk(df: DataFrame, system: str, code: str, mapping: DataFrame, target: str) -> DataFrame:
    """df with target_code: codes of one system in another, null where there is none.

    mapping: from_system, from_code, to_system, to_code; of several targets the least counts.
    Systems and codes are compared without case and outer white space.
    """
    plain = lambda c: F.lower(F.trim(F.col(c)))
    one = mapping.filter(plain("to_system") == target.strip().lower()).groupBy(plain("from_system").alias("_s"), plain("from_code").alias("_c")).agg(F.min("to_code").alias("target_code"))
    return df.join(broadcast_if_small(one), (plain(system) == F.col("_s")) & (plain(code) == F.col("_c")), "left").drop("_s", "_c")


def best_evidence(cells: DataFrame, keys: list[str], fields: dict[str, tuple[str, ...]], label: str = "label", page: str = "page") -> DataFrame:
    """keys, field, the cells' columns, confidence: per document, period and field the cell that states it best.

    fields: field -> variants of its label.  A label equal to a variant has confidence 0.95, one
    that starts with it 0.9, one that holds it 0.6 (without case and punctuation); then the
    earlier page wins, then the smaller label.
    """
    plain = F.trim(F.regexp_replace(F.lower(F.col(label)), r"[^\p{L}\p{N}]+", " "))
    found = None
    for field, variants in fields.items():
        names = [" ".join("".join(c if c.isalnum() else " " for c in v.lower()).split()) for v in variants]
        some = lambda test, names=names: reduce(lambda a, b: a | b, [test(F.lit(n)) for n in names])
        confidence = F.when(plain.isin(names), 0.95).when(some(lambda n: plain.startswith(F.concat(n, F.lit(" ")))), 0.9).when(some(lambda n: F.contains(F.concat(F.lit(" "), plain, F.lit(" ")), F.concat(F.lit(" "), n, F.lit(" ")))), 0.6)
        one = cells.select("*", F.lit(field).alias("field"), confidence.alias("confidence")).filter("confidence is not null")
        found = one if found is None else found.unionByName(one)
    best = Window.partitionBy(*keys, "field").orderBy(F.desc("confidence"), F.col(page).asc_nulls_last(), F.col(label))
    return found.withColumn("_rn", F.row_number().over(best)).filter("_rn = 1").drop("_rn")


def conflicts(items: DataFrame, interactions: DataFrame, allergies: DataFrame, levels: tuple[str, ...] = ("minor", "moderate", "major")) -> DataFrame:
    """owner, kind, a, b, severity: what goes badly together among an owner's items.

    items: owner, item, class; interactions: a, b, severity (unordered); allergies: owner, term
    (an item or a class).  kinds: pair, allergy (severity the highest level), duplicate (several
    items of one class; a: the class, b: how many).  Only pairs that the table knows are built.
    """
    held = items.select("owner", "item", "class").distinct()
    order = F.array(*[F.lit(x) for x in levels])
    known = interactions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.array_position(order, F.col("severity")).alias("_s")).groupBy("a", "b").agg(F.max("_s").alias("_s"))
    named = held.select("owner", "item").distinct()
    first = named.select("owner", F.col("item").alias("a")).join(broadcast_if_small(known), "a")
    pairs = first.join(named.select("owner", F.col("item").alias("b")), ["owner", "b"]).select("owner", F.lit("pair").alias("kind"), "a", "b", F.try_element_at(order, F.col("_s").cast("int")).alias("severity"))
    terms = allergies.select("owner", F.col("term").alias("b")).distinct()
    by_name, by_class = held.join(terms, (held.owner == terms.owner) & (held.item == terms.b)), held.join(terms, (held.owner == terms.owner) & (held["class"] == terms.b))
    allergic = by_name.select(held.owner, "item", "b").union(by_class.select(held.owner, "item", "b")).distinct()
    allergic = allergic.select("owner", F.lit("allergy").alias("kind"), F.col("item").alias("a"), "b", F.lit(levels[-1]).alias("severity"))
    twice = held.groupBy("owner", "class").agg(F.countDistinct("item").alias("n")).filter("n > 1")
    twice = twice.select("owner", F.lit("duplicate").alias("kind"), F.col("class").alias("a"), F.col("n").cast("string").alias("b"), F.lit(levels[0]).alias("severity"))
    return pairs.unionByName(allergic).unionByName(twice)


def share_of_tags(df: DataFrame, keys: list[str], expected: str, seen: str) -> DataFrame:
    """keys, score: per group the share of rows with expected tags whose tags were all seen, times 100; null without such rows."""
    asked = F.size(F.coalesce(expected, F.array().cast("array<string>"))) > 0
    met = F.size(F.array_except(F.col(expected), F.coalesce(seen, F.array().cast("array<string>")))) == 0
    return df.groupBy(*keys).agg((100 * F.try_divide(F.count_if(asked & met), F.count_if(asked))).alias("score"))


def clamped_mean(scores: list[Column], low: float = 0.0, high: float = 1.0) -> Column:
    """Mean of the scores that are there, each brought into [low, high]; null if none is."""
    valid = [F.when(x.isNotNull() & ~F.isnan(x), F.greatest(F.lit(low), F.least(F.lit(high), x))) for x in scores]
    held = F.filter(F.array(*valid), lambda x: x.isNotNull())
    return F.try_divide(F.aggregate(held, F.lit(0.0), lambda a, x: a + x), F.size(held))


def met_share(conditions: list[Column]) -> Column:
    """Share of conditions that are true; null counts as not met."""
    return reduce(lambda a, b: a + b, [F.coalesce(c, F.lit(False)).cast("double") for c in conditions]) / len(conditions)


def contributor_graph(results: DataFrame, result: str, identifiers: str, contributors: str) -> tuple[DataFrame, DataFrame]:
    """(nodes: id, kind; edges: src, label, dst) of results with identifiers and nested contributors.

    identifiers: array of strings; contributors: array of struct(person, role, organisation).
    Persons and organisations are one node each, however often they are named.
    """
    base = results.filter(F.col(result).isNotNull())
    ids = base.select(F.col(result).alias("r"), F.explode(identifiers).alias("i")).filter("i is not null")
    people = base.select(F.col(result).alias("r"), F.explode(contributors).alias("c")).select("r", "c.person", "c.role", "c.organisation").filter("person is not null")
    edge = lambda df, s, label, o: df.select(F.concat(*s).alias("src"), label.alias("label"), F.concat(*o).alias("dst"))
    edges = [
        edge(ids, (F.lit("result:"), "r"), F.lit("HAS_IDENTIFIER"), (F.lit("identifier:"), "i")),
        edge(people, (F.lit("person:"), "person"), F.concat(F.lit("CONTRIBUTED_AS_"), F.upper(F.coalesce("role", F.lit("other")))), (F.lit("result:"), "r")),
        edge(people.filter("organisation is not null"), (F.lit("person:"), "person"), F.lit("AFFILIATED_WITH"), (F.lit("organisation:"), "organisation")),
    ]
    edges = reduce(DataFrame.unionByName, edges).distinct()
    ends = edges.select(F.explode(F.array("src", "dst")).alias("id")).unionByName(base.select(F.concat(F.lit("result:"), result).alias("id"))).distinct()
    return ends.select("id", F.substring_index("id", ":", 1).alias("kind")), edges


def to_shape(nodes: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """id, label, labels, props from id, labels (array), properties (map): the first label by name, properties without nulls (or ``keep`` only), as canonical JSON."""
    from weftline.sources.logs import canonical_json

    held = F.map_filter("properties", lambda k, v: v.isNotNull() & (k.isin(*keep) if keep else F.lit(True)))
    return nodes.select("id", F.array_min("labels").alias("label"), F.array_join(F.array_sort("labels"), ",").alias("labels"), canonical_json(held).alias("props"))


def from_shape(shaped: DataFrame) -> DataFrame:
    """The way back of ``to_shape``."""
    return shaped.select("id", F.split("labels", ",").alias("labels"), F.from_json("props", "map<string,string>").alias("properties"))


def cell_of(lat: Column, lon: Column, level: int) -> Column:
    """The square cell of a place: its quadrants from the whole globe down, one digit a level (longitude's half, then latitude's)."""
    n = 1 << level
    x = F.least(F.floor((lon + 180) / 360 * n), F.lit(n - 1)).cast("bigint")
    y = F.least(F.floor((lat + 90) / 180 * n), F.lit(n - 1)).cast("bigint")
    bits = [F.shiftright(x, b).bitwiseAND(F.lit(1)) * 2 + F.shiftright(y, b).bitwiseAND(F.lit(1)) for b in range(level - 1, -1, -1)]
    return F.concat(*[b.cast("string") for b in bits])


def in_cells(df: DataFrame, lat: str, lon: str, cells: DataFrame) -> DataFrame:
    """Rows within any of the cells (column cell, of any levels): one semi-join per level that occurs."""
    levels = sorted(r[0] for r in cells.select(F.length("cell")).distinct().limit(32).collect())  # levels, not cells
    marked = df.withColumn("_hit", F.lit(False))
    for level in levels:
        part = broadcast_if_small(cells.filter(F.length("cell") == level).select(F.col("cell").alias("_c")).distinct()).withColumn("_in", F.lit(True))
        marked = marked.join(part, cell_of(F.col(lat), F.col(lon), level) == F.col("_c"), "left").withColumn("_hit", F.col("_hit") | F.coalesce("_in", F.lit(False))).drop("_c", "_in")
    return marked.filter("_hit").drop("_hit")


def bucket_quantile(df: DataFrame, keys: list[str], le: str, count: str, q: float) -> DataFrame:
    """keys, value: a quantile from cumulative histogram buckets (upper bound, rows up to it), straight lines within a bucket.

    The rank falls into the first bucket whose count reaches q times the last one's; in the
    bucket without an upper bound the highest bound that is one is given.
    """
    w = Window.partitionBy(*keys).orderBy(F.col(le))
    held = df.groupBy(*keys, le).agg(F.sum(count).alias("_n"))
    total = F.max("_n").over(Window.partitionBy(*keys))
    steps = held.select(*keys, F.col(le).alias("_le"), F.col("_n"), (q * total).alias("_rank"), F.lag(le, 1).over(w).alias("_lo"), F.lag("_n", 1, 0).over(w).alias("_below"))
    hit = F.min(F.when(F.col("_n") >= F.col("_rank"), F.struct("_le", "_lo", "_n", "_below", "_rank"))).alias("h")
    found = steps.filter("_rank > 0").groupBy(*keys).agg(hit)
    lo = F.coalesce("h._lo", F.lit(0.0))
    inside = lo + (F.col("h._le") - lo) * F.try_divide(F.col("h._rank") - F.col("h._below"), F.col("h._n") - F.col("h._below"))
    return found.select(*keys, F.when(F.col("h._le") == float("inf"), F.col("h._lo")).otherwise(inside).alias("value"))
