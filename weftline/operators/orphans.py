"""References to records that are missing, deleted or recorded only later (skew-aware split).

References are counted per field, key and period before anything is shuffled.  The keys
with at least ``heavy`` references are few by arithmetic (at most all references divided by
``heavy``); they are checked by a broadcast join.  All other keys go through a shuffle
anti-join.  Both outcomes are united into one table of failing keys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.refs import id_key, ref_key
from weftline.session import BROADCAST_ROWS, broadcast_if_small, is_small, materialize

#: Beyond the broadcast's bound, facts are first sifted by a table of so many hash values of failing keys (4 million whole numbers at most).
SIEVE = 1 << 22
#: A key with this many references counts as heavy and is checked by broadcast.
HEAVY = 100_000


def references(facts: DataFrame, fact_id: str, ts: str, fields: list[str]) -> DataFrame:
    """One row per fact and reference field that holds a reference: fact_id, ts, field, key."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), ref_key(f).alias("key")) for f in fields]))
    return facts.select(F.col(fact_id).alias("fact_id"), F.col(ts).alias("ts"), pairs.alias("r")).select("fact_id", "ts", "r.field", "r.key").filter(F.col("key").isNotNull())


def target_keys(targets: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """Per field and key of the referenced tables: whether all rows are deleted, and the earliest created_at.

    ``targets`` maps a field to (table, id column).  Ids are compared without case and outer white space.
    """
    out = None
    for field, (table, column) in targets.items():
        one = (
            table.select(F.lit(field).alias("field"), id_key(column).alias("key"), "created_at", "deleted_at")
            .filter(F.col("key").isNotNull())
            .groupBy("field", "key")
            .agg(F.min(F.col("deleted_at").isNotNull()).alias("all_deleted"), F.min("created_at").alias("created"))
        )
        out = one if out is None else out.unionByName(one)
    return out


def failing_keys(refs: DataFrame, keys: DataFrame, heavy: int = HEAVY) -> DataFrame:
    """Keys with a failing reference: field, key, state ('missing', 'deleted', 'late'), created, heavy, and their counts per period.

    One row per field, key and month of ts; ``refs_n`` counts the references.  A key is
    'late' in a period if at least one reference of the period precedes ``created``.
    """
    counted = materialize(refs.groupBy("field", "key", F.trunc("ts", "month").alias("period")).agg(F.count(F.lit(1)).alias("refs_n"), F.min("ts").alias("first_ts")), "refs")
    totals = counted.groupBy("field", "key").agg(F.sum("refs_n").alias("total"))
    heavy_keys = totals.filter(F.col("total") >= heavy).select("field", "key")
    heavy_list = broadcast_if_small(heavy_keys)
    on = ["field", "key"]
    heavy_part = counted.join(heavy_list, on, "left_semi").join(broadcast_if_small(keys.join(heavy_list, on, "left_semi")), on, "left")
    light_part = counted.join(heavy_list, on, "left_anti").join(keys.withColumn("known", F.lit(True)), on, "left").drop("known")
    state = (
        F.when(F.col("all_deleted").isNull(), F.lit("missing"))
        .when(F.col("all_deleted"), F.lit("deleted"))
        .when(F.col("created") > F.col("first_ts"), F.lit("late"))
    )
    both = heavy_part.withColumn("heavy", F.lit(True)).unionByName(light_part.withColumn("heavy", F.lit(False)))
    return both.withColumn("state", state).filter(F.col("state").isNotNull()).select("field", "key", "period", "refs_n", "state", "created", "heavy")


def orphan_references(facts: DataFrame, targets: dict[str, tuple[DataFrame, str]], fact_id: str = "metric_fact_id", ts: str = "ts", heavy: int = HEAVY, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Each fact and field whose reference fails: fact_id, field, state, ts.

    Null, blank and placeholder words are no references.  A fact delivered several times
    with the same reference and time gives one row.  A null ts is never 'late'.  Empty tables
    give no rows (an empty referenced table makes every reference 'missing').

    The failing keys find their facts by broadcast where they are few.  Else the heavy ones
    still do, and the references of the others are sifted by the hash values of the failing
    keys, a broadcast of bounded size, before what is left is shuffled.
    """
    refs = references(facts, fact_id, ts, list(targets))
    failing = materialize(failing_keys(refs, target_keys(targets), heavy).select("field", "key", "state", "created", "heavy").distinct(), "failing")
    on = ["field", "key"]
    if is_small(failing, broadcast_rows):
        hit = refs.join(F.broadcast(failing.drop("heavy")), on)
    else:
        few = broadcast_if_small(failing.filter("heavy").drop("heavy"), max(broadcast_rows, BROADCAST_ROWS))
        light = failing.filter("not heavy").drop("heavy")
        place = F.pmod(F.xxhash64("field", "key"), F.lit(SIEVE)).cast("int")
        likely = refs.withColumn("_place", place).join(F.broadcast(light.select(place.alias("_place")).distinct()), "_place", "left_semi").drop("_place")
        hit = refs.join(few, on).unionByName(likely.join(light, on))
    kept = hit.filter((F.col("state") != "late") | (F.col("created") > F.col("ts")))
    return kept.select("fact_id", "field", "state", "ts").distinct()


def orphan_report(facts: DataFrame, targets: dict[str, tuple[DataFrame, str]], tables: dict[str, str], fact_id: str = "metric_fact_id", ts: str = "ts") -> DataFrame:
    """Orphan references per referenced table, month of ts and state, each fact counted once."""
    found = orphan_references(facts, targets, fact_id, ts)
    names = F.create_map(*[F.lit(x) for pair in tables.items() for x in pair])
    return found.groupBy(names[F.col("field")].alias("ref_table"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("state").alias("ref_state")).agg(F.count(F.lit(1)).alias("orphans"))
