import datetime as dt
import random

from pyspark.sql import functions as F

from weftline.operators import orphans

T = lambda d: dt.datetime(2025, 1, 1) + dt.timedelta(days=d)
FACTS, TARGET = "metric_fact_id string, ts timestamp, run_id string", "run_id string, created_at timestamp, deleted_at timestamp"


def brute(facts, targets):
    by = {}
    for k, c, d in targets:
        if k is not None:
            by.setdefault(k.strip().lower(), []).append((c, d))
    out = set()
    for i, ts, ref in facts:
        k = (ref or "").strip().lower()
        if k in ("", "none", "n/a", "-", "unknown"):
            continue
        rows = by.get(k)
        if rows is None:
            out.add((i, "missing"))
        elif all(d is not None for _, d in rows):
            out.add((i, "deleted"))
        else:
            made = [c for c, _ in rows if c is not None]
            if made and ts is not None and min(made) > ts:
                out.add((i, "late"))
    return out


def test_equals_brute_force_with_heavy_and_light_keys(spark):
    rng = random.Random(4)
    targets = [(rng.choice([f"R{i}", f" r{i} ", f"r{i}"]), rng.choice([None, T(rng.randrange(60))]), rng.choice([None, None, T(70)])) for i in range(40) for _ in range(rng.randrange(1, 3))] + [(None, T(1), None)]
    facts = []
    for i in range(3000):
        ref = "r7" if rng.random() < 0.2 else "ghost" if rng.random() < 0.2 else rng.choice([None, "", "  ", "N/A", "none", "-", "Unknown", f" R{rng.randrange(60)}", f"r{rng.randrange(60)}"])
        facts.append((f"f{i}", rng.choice([None, T(rng.randrange(60))]), ref))
    facts += facts[:100]
    f = spark.createDataFrame(facts, FACTS).withColumn("state", F.lit("x")).withColumn("key", F.lit("y"))
    t = spark.createDataFrame(targets, TARGET).withColumn("key", F.lit("z"))
    for heavy, few in ((1, 10**6), (300, 10**6), (10**9, 10**6), (300, 3), (1, 3), (10**9, 3)):
        got = orphans.orphan_references(f, {"run_id": (t, "run_id")}, heavy=heavy, broadcast_rows=few)
        assert {(r["fact_id"], r["state"]) for r in got.collect()} == brute(facts, targets), heavy
        assert got.count() == len(brute(facts, targets))


def test_empty_tables(spark):
    none, some = spark.createDataFrame([], TARGET), spark.createDataFrame([("a", T(1), "x")], FACTS)
    assert [r["state"] for r in orphans.orphan_references(some, {"run_id": (none, "run_id")}).collect()] == ["missing"]
    assert orphans.orphan_references(spark.createDataFrame([], FACTS), {"run_id": (none, "run_id")}).count() == 0


def test_report_counts_each_fact_once(spark):
    facts = spark.createDataFrame([("a", T(1), "x"), ("a", T(1), "x"), ("b", T(40), "x"), ("c", T(1), "y")], FACTS)
    targets = spark.createDataFrame([("y", T(5), None)], TARGET)
    got = orphans.orphan_report(facts, {"run_id": (targets, "run_id")}, {"run_id": "eval_runs"})
    assert sorted(map(tuple, got.collect())) == [("eval_runs", "2025-01", "late", 1), ("eval_runs", "2025-01", "missing", 1), ("eval_runs", "2025-02", "missing", 1)]


def test_both_ways_of_finding_the_facts_agree_on_the_test_tables(spark, sf):
    from weftline.session import load

    sf = sf.replace("0.001", "0.01")
    targets = {f: (load(spark, sf, t), f) for f, t in {"run_id": "eval_runs", "context_slice_id": "context_slices", "source_descriptor_id": "source_descriptors"}.items()}
    facts = load(spark, sf, "metric_facts")
    look = lambda **how: {tuple(r) for r in orphans.orphan_references(facts, targets, **how).select("fact_id", "field", "state").collect()}
    few = look()
    assert few and few == look(heavy=100, broadcast_rows=3) == look(heavy=10**9, broadcast_rows=3)
