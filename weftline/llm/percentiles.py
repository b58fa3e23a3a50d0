"""Mergeable percentiles with a stated error bound, by randomized compactor hierarchies (KLL).

A sketch keeps levels of sorted values; a full level keeps every other value, starting at
random, and hands them up with doubled weight.  Sketches merge level by level, so those of
days or partitions combine to the sketch of the whole with the same bound: with ``k`` the
rank of an answer is off by at most ``rank_error(k)`` of the count with 99 % confidence.  A
group of fewer than ``k`` values is exact.  Sketches are built by Spark's own aggregate, so
a group that holds a third of all rows is sketched in parts before anything is shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.functions.refs import id_key
from weftline.operators.units import common_units
from weftline.session import broadcast_if_small, materialize

K = 400
RANKS = (0.05, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)
MEASURES = ("latency_ms_p50", "value_scalar")


def rank_error(k: int = K) -> float:
    """Normalised rank error of an answer at 99 % confidence, as published for this sketch; it holds for the difference of two ranks too."""
    return 2.446 / k**0.9433


def sketches(df: DataFrame, keys: list[str], value: str, k: int = K) -> DataFrame:
    """keys, sketch: one mergeable sketch per group; null and NaN are left out, a group without values has no row."""
    number = F.col(value).cast("double")
    valid = df.filter(number.isNotNull() & ~F.isnan(number))
    return valid.groupBy(*keys).agg(F.expr(f"kll_sketch_agg_double(cast(`{value}` as double), {int(k)})").alias("sketch"))


def merge(parts: DataFrame, keys: list[str]) -> DataFrame:
    """keys, sketch: the sketches of equal keys merged, e.g. those of days to those of all time."""
    return parts.groupBy(*keys).agg(F.expr("kll_merge_agg_double(sketch)").alias("sketch"))


def quantiles(held: DataFrame, keys: list[str], ranks: tuple = RANKS, k: int = K) -> DataFrame:
    """keys, n, p05 ... p99, rank_error: the answers of each sketch (rank_error 0 where it holds all values)."""
    n = F.expr("kll_sketch_get_n_double(sketch)")
    asked = [F.expr(f"kll_sketch_get_quantile_double(sketch, {r}D)").alias(f"p{round(r * 100):02d}") for r in ranks]
    return held.select(*keys, n.alias("n"), *asked, F.when(n < k, F.lit(0.0)).otherwise(F.lit(rank_error(k))).alias("rank_error"))


def metric_values(facts: DataFrame, definitions: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """metric, model, month, measure, value: the latency and the figure in common units, each metric_fact_id once.

    A fact delivered several times counts once (of unequal copies the greatest); one without
    an id cannot be told from another and counts by itself.
    """
    carry = {"model": "lower(trim(model_release_id))", "latency": "latency_ms_p50", "month": "date_format(ts, 'yyyy-MM')"}
    rows = common_units(facts, definitions, crosswalks, carry).select("fact_id", "metric", "model", "month", "latency", "common")
    once = rows.filter(F.col("fact_id").isNotNull()).groupBy("fact_id").agg(F.max(F.struct("metric", "model", "month", "latency", "common")).alias("f")).select("f.*")
    rest = rows.filter(F.col("fact_id").isNull()).drop("fact_id")
    pair = F.explode(F.array(F.struct(F.lit(MEASURES[0]).alias("measure"), F.col("latency").alias("value")), F.struct(F.lit(MEASURES[1]).alias("measure"), F.col("common").alias("value"))))
    return once.unionByName(rest).select("metric", "model", "month", pair.alias("m")).select("metric", "model", "month", "m.measure", "m.value")


def metric_percentiles(facts: DataFrame, definitions: DataFrame, crosswalks: DataFrame, k: int = K) -> DataFrame:
    """Percentiles per metric, model and measure, merged from sketches of months."""
    keys = ["metric", "model", "measure"]
    monthly = sketches(metric_values(facts, definitions, crosswalks), [*keys, "month"], "value", k)
    found = quantiles(merge(monthly, keys), keys, k=k)
    return found.select(F.col("metric").alias("metric_definition_id"), F.col("model").alias("model_release_id"), "measure", *[c for c in found.columns if c not in keys])


def latency_counts(facts: DataFrame, k: int = K) -> DataFrame:
    """Values behind each metric's latency sketch per month, read from the sketches themselves."""
    light = facts.select("metric_fact_id", id_key("metric_definition_id").alias("metric"), F.date_format("ts", "yyyy-MM").alias("month"), F.col("latency_ms_p50").alias("latency"))
    once = light.groupBy("metric_fact_id").agg(F.max(F.struct("metric", "month", "latency")).alias("f")).select("f.*")
    held = sketches(once, ["metric", "month"], "latency", k)
    return held.select(F.col("metric").alias("metric_definition_id"), "month", F.expr("kll_sketch_get_n_double(sketch)").alias("n"))


def answers_within_bound(values: DataFrame, keys: list[str], value: str, ranks: tuple = RANKS, k: int = K) -> DataFrame:
    """keys, n, asked, within: of each group the values, the answers of its sketch, and how many of them lie within the stated bound of the exact rank.

    Exact ranks are counted: an answer is right if the values below it and those up to it
    enclose the rank asked for, give or take the bound.  One pass over the values besides the
    sketches; the answers per group go to the values by a join on the group.
    """
    number = F.col(value).cast("double")
    valid = values.select(*keys, number.alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    told = quantiles(sketches(valid, keys, "_v", k), keys, ranks, k)
    names = {c: f"_k{i}" for i, c in enumerate(keys)}
    answers = told.select(*[F.col(c).alias(x) for c, x in names.items()], F.array(*[f"p{round(r * 100):02d}" for r in ranks]).alias("_a"), "rank_error")
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(x)) for c, x in names.items()])
    joined = valid.join(broadcast_if_small(materialize(answers, "answers")), same)
    counted = joined.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.first("rank_error").alias("_e"),
        *[F.count_if(F.col("_v") < F.col("_a")[i]).alias(f"_lo{i}") for i in range(len(ranks))], *[F.count_if(F.col("_v") <= F.col("_a")[i]).alias(f"_hi{i}") for i in range(len(ranks))],
    )
    slack = F.greatest(F.col("_e"), 1 / F.col("n"))
    right = [((F.col(f"_lo{i}") / F.col("n") - slack <= r) & (F.col(f"_hi{i}") / F.col("n") + slack >= r)).cast("int") for i, r in enumerate(ranks)]
    return counted.select(*keys, "n", F.lit(len(ranks)).alias("asked"), reduce(lambda a, b: a + b, right).alias("within"))
