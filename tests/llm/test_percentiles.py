import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import percentiles
from weftline.session import load


def test_rank_error_stays_within_the_bound_after_merging(spark):
    rng = np.random.default_rng(1)
    values = np.concatenate([rng.lognormal(3, 2, 60_000), np.zeros(20_000), np.full(20_000, 7.0)])
    rng.shuffle(values)
    df = spark.createDataFrame([(int(i % 9), float(v)) for i, v in enumerate(values)], "day int, v double")
    merged = percentiles.merge(percentiles.sketches(df.withColumn("k", F.lit("a")), ["k", "day"], "v"), ["k"])
    row = percentiles.quantiles(merged, ["k"]).first()
    assert row["n"] == len(values) and row["rank_error"] == percentiles.rank_error()
    ordered = np.sort(values)
    for r in percentiles.RANKS:
        v = row[f"p{round(r * 100):02d}"]
        low, high = np.searchsorted(ordered, v, "left") / len(values), np.searchsorted(ordered, v, "right") / len(values)
        assert low - row["rank_error"] <= r <= high + row["rank_error"]


def test_small_groups_are_exact_and_nulls_left_out(spark):
    rng = random.Random(2)
    rows = [(g, rng.choice([None, float("nan"), *map(float, range(50))])) for g in ("a", "b", None) for _ in range(200)] + [("none", None), ("none", float("nan"))]
    df = spark.createDataFrame(rows, "g string, v double").withColumn("sketch", F.lit(1))
    got = {r["g"]: r for r in percentiles.quantiles(percentiles.sketches(df, ["g"], "v"), ["g"]).collect()}
    assert set(got) == {"a", "b", None}
    for g, r in got.items():
        v = sorted(x for k, x in rows if k == g and x is not None and x == x)
        assert r["n"] == len(v) and r["rank_error"] == 0.0 and r["p50"] in (v[len(v) // 2 - 1], v[len(v) // 2])
    assert percentiles.sketches(df.limit(0), ["g"], "v").count() == 0


def test_each_fact_counts_once_on_the_test_tables(spark, sf):
    tables = load(spark, sf, "metric_facts", "metric_definitions", "metric_crosswalks")
    got = percentiles.metric_percentiles(*tables)
    n = got.filter("measure = 'latency_ms_p50'").agg(F.sum("n")).first()[0]
    facts = tables[0].dropDuplicates(["metric_fact_id"]).filter("latency_ms_p50 is not null and not isnan(latency_ms_p50)")
    assert n == facts.count() and got.groupBy("metric_definition_id", "model_release_id", "measure").count().filter("count > 1").isEmpty()


def test_answers_are_held_against_exact_ranks(spark):
    rng = np.random.default_rng(4)
    rows = [("big", float(v)) for v in rng.lognormal(1, 2, 40_000)] + [("small", float(v)) for v in rng.integers(0, 5, 300)] + [("none", None), (None, 2.0)]
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r["g"]: r for r in percentiles.answers_within_bound(df, ["g"], "v").collect()}
    assert set(got) == {"big", "small", None} and got["big"]["n"] == 40_000 and all(r["within"] == r["asked"] == 7 for r in got.values())
    rough = percentiles.answers_within_bound(df, ["g"], "v", k=8).filter("g = 'big'").first()
    assert rough["within"] >= 6  # a wide bound, and it still holds
    assert percentiles.answers_within_bound(df.limit(0), ["g"], "v").count() == 0
