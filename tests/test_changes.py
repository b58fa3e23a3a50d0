import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import changes
from weftline.session import fresh_path
from weftline.sources import files

DDL = "event_id string, seq bigint, kind string, label string, from_id string, to_id string, properties string, wall_time timestamp, ingest_time timestamp"
WORDS = {"c": ["node", "Node_Create", "edge.insert", "EDGE ", "node-add"], "u": ["node_update", "edge.SET", "Node-Patch", "edge_modify "], "d": ["node_delete", "Edge.Remove", "node-DROP", "edge_tombstone"]}


def feed(seed, n, keys=12):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        kind = rng.choice("ccuuud")
        key = "hot" if rng.random() < 0.35 else f"k{rng.randrange(keys)}"
        seq = None if rng.random() < 0.03 else rng.randrange(60)
        rows.append((key, seq, rng.choice(WORDS[kind]), f"l{i}", "", "", None if rng.random() < 0.2 else f'{{"i": {i}}}', None, dt.datetime(2025, 1, 1) + dt.timedelta(seconds=i)))
    return rows


def brute(rows):
    best = {}
    for r in rows:
        word = r[2].strip().lower()
        act = next(a for a, ws in WORDS.items() if word in [w.strip().lower() for w in ws])
        if r[0] is None or r[1] is None:
            continue
        k = (r[0], r[1])
        if k not in best or best[k][0] < r[8]:
            best[k] = (r[8], act)
    state = {}
    for (key, seq), (_, act) in sorted(best.items(), key=lambda x: x[0][1]):
        if act == "c" or (act == "u" and key in state):
            state[key] = seq
        elif act == "d":
            state.pop(key, None)
    return state


def got(df):
    return {r["event_id"]: r["seq"] for r in df.select("event_id", "seq").collect()}


def test_one_batch_equals_brute_force(spark):
    rows = feed(1, 600)
    df = spark.createDataFrame(rows + rows[:50], DDL)
    assert got(changes.apply_feed(spark, df, fresh_path(spark, "t"), 8)) == brute(rows)


def test_batches_in_any_order_and_repeated(spark):
    rows = feed(2, 400)
    parts = [rows[i::4] for i in range(4)]
    table = changes.BucketedTable(spark, fresh_path(spark, "t"), "event_id", "seq", "ingest_time", "_action", ["label"], 8)
    for i in (2, 0, 3, 2, 1):
        table.apply(spark.createDataFrame(parts[i], DDL).withColumn("_action", changes.change_action(F.col("kind"))))
    assert got(table.state()) == brute(rows)


def table_of(spark, path, buckets=16, hot_rows=changes.HOT_ROWS):
    return changes.BucketedTable(spark, path, "event_id", "seq", "ingest_time", "_action", ["label"], buckets, hot_rows)


def batch(spark, rows):
    return spark.createDataFrame(rows, DDL).withColumn("_action", changes.change_action(F.col("kind")))


def size_of(path):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, fs in os.walk(path) for f in fs if f.endswith(".parquet"))


def test_a_small_batch_rewrites_its_buckets_only_and_old_manifests_stay(spark):
    path = fresh_path(spark, "t")
    table = table_of(spark, path, 64)
    rows = [(f"k{i}", 1, "node", "a" * 20, "", "", None, None, dt.datetime(2025, 1, 1)) for i in range(4000)]
    first = table.apply(batch(spark, rows))
    before = size_of(path)
    second = table.apply(batch(spark, [("k3", 2, "node_delete", "a", "", "", None, None, dt.datetime(2025, 1, 2))]))
    moved = [b for b in first["gen"] if second["gen"][b] != first["gen"][b]]
    assert len(moved) == 1 and second["version"] == 2
    assert size_of(path) - before < 2.5 * before / 64  # one bucket of 64
    assert "k3" not in got(table.state()) and "k3" in got(table.state(version=1)) and len(got(table.state())) == 3999
    assert table.vacuum() == 0 and table.apply(batch(spark, rows[:1]))["version"] == 3 and table.vacuum(1) == 0  # files of gen 1 hold other buckets still


def test_of_two_writers_from_one_version_the_second_fails_and_nothing_is_lost(spark):
    path = fresh_path(spark, "t")
    one = table_of(spark, path)
    t = dt.datetime(2025, 1, 1)
    one.apply(batch(spark, [(f"k{i}", 1, "node", "", "", "", None, None, t) for i in range(40)]))
    other, seen = table_of(spark, path), one.manifest()
    one.apply(batch(spark, [(f"n{i}", 1, "node", "", "", "", None, None, t) for i in range(3)]), seen)
    with pytest.raises(OSError, match="another writer"):
        other.apply(batch(spark, [(f"x{i}", 1, "node", "", "", "", None, None, t) for i in range(5)]), seen)
    assert sorted(got(one.state())) == sorted([f"k{i}" for i in range(40)] + ["n0", "n1", "n2"])
    other.apply(batch(spark, [(f"x{i}", 1, "node", "", "", "", None, None, t) for i in range(5)]))
    assert len(got(one.state())) == 48 and not [n for n in files.list_names(spark, f"{path}/_manifests") if n.endswith(".tmp")]


def test_hot_buckets_give_the_same_as_others(spark):
    rows = feed(5, 900)
    rows += [r for r in rows if r[0] == "hot"] * 3
    for hot_rows in (10, 10**9):
        table = table_of(spark, fresh_path(spark, "t"), 8, hot_rows)
        for i in (1, 0, 2):
            made = table.apply(batch(spark, rows[i::3]))
        assert got(table.state()) == brute(rows) and bool(made["hot"]) == (hot_rows == 10)


def test_compaction_keeps_the_state_and_sets_late_changes_aside(spark):
    rows = feed(9, 800)
    early, later = [r for r in rows if r[1] is None or r[1] <= 30], [r for r in rows if r[1] is not None and r[1] > 30]
    table = table_of(spark, fresh_path(spark, "t"), 8)
    table.apply(batch(spark, early))
    before = table._read(table.manifest()).count()
    folded = table.compact(30)
    assert table._read(folded).count() < before / 4 and got(table.state()) == brute(early)
    table.apply(batch(spark, later))
    assert got(table.state()) == brute(rows)
    made = table.apply(batch(spark, [("k1", 12, "node", "late", "", "", None, None, dt.datetime(2026, 1, 1))]))
    assert len(made["late"]) == 1 and spark.read.parquet(f"{table.path}/late/gen={made['late'][0]}").count() == 1
    assert got(table.state()) == brute(rows)


def test_the_feed_goes_through_a_base_and_two_batches(spark):
    rows = feed(11, 500)
    path = fresh_path(spark, "t")
    assert got(changes.apply_feed(spark, spark.createDataFrame(rows, DDL), path, 32, hot_rows=50)) == brute(rows)
    names = files.list_names(spark, f"{path}/_manifests")
    gens = [files.read_json(spark, f"{path}/_manifests/{n}")["gen"] for n in names if n.endswith(".json")]
    assert len(gens) == 3 and len(set(gens[2].values())) >= 3  # files of all three stand side by side


def test_empty_feed_null_keys_unknown_kinds_and_clashing_columns(spark):
    none = spark.createDataFrame([], DDL)
    assert changes.apply_feed(spark, none, fresh_path(spark, "t")).count() == 0
    t = dt.datetime(2025, 1, 1)
    rows = [(None, 1, "node", "", "", "", None, None, t), ("a", None, "node", "", "", "", None, None, t), ("b", 1, "polish", "", "", "", None, None, t), ("c", 1, None, "", "", "", None, None, t), ("d", 5, "node_update", "", "", "", None, None, t), ("e", 1, "node", None, None, None, None, None, None)]
    df = spark.createDataFrame(rows, DDL).withColumn("_bucket", F.lit(99)).withColumn("gen", F.lit("x"))
    assert got(changes.apply_feed(spark, df, fresh_path(spark, "t"))) == {"e": 1}


def test_all_deleted_gives_an_empty_state(spark):
    t = dt.datetime(2025, 1, 1)
    rows = [("a", 1, "node", "", "", "", None, None, t), ("a", 2, "node_delete", "", "", "", None, None, t)]
    assert changes.apply_feed(spark, spark.createDataFrame(rows, DDL), fresh_path(spark, "t")).count() == 0


def test_bare_words_and_empty_kind(spark):
    df = spark.createDataFrame([(k,) for k in ("node", "EDGE ", "", " ", "Node.Set", "edge_tombstone", "nodes", None)], "kind string")
    assert [r[0] for r in df.select(changes.change_action(F.col("kind"))).collect()] == [1, 1, None, None, 2, 3, 1, None]


def test_most_of_a_feed_is_merged_into_a_table_that_is_there(spark, tmp_path, sf, monkeypatch):
    from weftline.session import load

    feed = load(spark, sf, "hellgraph_events")
    sizes = []
    apply = changes.BucketedTable.apply
    monkeypatch.setattr(changes.BucketedTable, "apply", lambda self, batch, *a: (sizes.append((self.manifest()["version"], batch.count())), apply(self, batch, *a))[1])
    got = changes.apply_feed(spark, feed, str(tmp_path / "t"))
    assert [v for v, _ in sizes] == [0, 1, 2] and sum(n for _, n in sizes) == feed.count()
    assert sum(n for v, n in sizes if v) > 0.6 * feed.count()
    monkeypatch.setattr(changes, "BASE", 1.0)
    whole = changes.apply_feed(spark, feed, str(tmp_path / "w"))
    assert sorted(map(tuple, got.select("event_id", "seq").collect())) == sorted(map(tuple, whole.select("event_id", "seq").collect()))
