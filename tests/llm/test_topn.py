import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from weftline.llm import topn

DDL = "profile_score_id string, ts timestamp, profile_id string, subject_id string, score_window string, score double"
GROUP = ["profile_id", "score_window"]


def brute(rows, n):
    last = {}
    for i, ts, p, s, w, x in rows:
        if x is None or x != x or s is None:
            continue
        key, at = (p, w, s), (ts is not None, ts or dt.datetime(1, 1, 1), i or "")
        if key not in last or at > last[key][0]:
            last[key] = (at, x)
    groups = {}
    for (p, w, s), (_, x) in last.items():
        groups.setdefault((p, w), []).append((-x, s))
    return {(p, w, s, k + 1) for (p, w), held in groups.items() for k, (_, s) in enumerate(sorted(held)[:n])}


def run(df, n):
    scores = topn.latest_scores(df, GROUP, "subject_id", "score", "ts", "profile_score_id")
    got = topn.top_n(scores, GROUP, "subject_id", "score", n).select("profile_id", "score_window", "subject_id", "place").collect()
    assert len(got) == len({tuple(r) for r in got})
    return {tuple(r) for r in got}


@pytest.mark.parametrize("n", [1, 5, 50])
def test_equals_brute_force_with_a_hot_group_and_ties(spark, n):
    rng = random.Random(n)
    rows = []
    for i in range(4000):
        p = "hot" if rng.random() < 0.4 else rng.choice([None, *(f"p{k}" for k in range(30))])
        rows.append((f"i{i}", rng.choice([None, dt.datetime(2025, 1, 1 + rng.randrange(28))]), p, rng.choice([None, *(f"s{k:04d}" for k in range(900))]), rng.choice([None, "w1", "w2"]), rng.choice([None, float("nan"), *(round(rng.random(), 1) for _ in range(8))])))
    df = spark.createDataFrame(rows + rows[:300], DDL).repartition(7).withColumn("_part", F.lit(1)).withColumn("place", F.lit("x"))
    assert run(df, n) == brute(rows, n)


def test_empty_and_bad_n(spark):
    empty = spark.createDataFrame([], DDL)
    assert run(empty, 5) == set()
    with pytest.raises(ValueError):
        topn.top_n(empty, GROUP, "subject_id", "score", 0)
