import datetime as dt
import hashlib
import hmac
import random

import pytest
from pyspark.sql import functions as F

from weftline.operators import mart, policy, relational
from weftline.plans.submit import inline_rows, submit_sql
from weftline.plans.workflow import Engine, Kind
from weftline.session import broadcast_if_small, fresh_path, is_small
from weftline.sources import logs
from weftline.sources.versions import VersionStore


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_latest_wins_is_idempotent_and_total(spark):
    df = spark.createDataFrame([("a", 1, "x"), ("a", 2, "y"), ("a", 2, "z"), (None, 5, "n"), ("b", None, "q")], "k string, v int, w string")
    want = [("a", 2, "z"), ("b", None, "q"), (None, 5, "n")]
    assert rows(mart.latest_wins(df, ["k"], "v")) == sorted(want, key=repr) == rows(mart.latest_wins(df.unionByName(df).repartition(5), ["k"], "v"))


def test_ladder(spark):
    df = spark.createDataFrame([("a", "attested"), ("a", "observed"), ("b", "rumour"), ("b", "attested"), ("c", None)], "k string, w string")
    assert rows(df.groupBy("k").agg(mart.weakest(F.col("w")).alias("w"))) == [("a", "observed"), ("b", "unknown"), ("c", "unknown")]


@pytest.mark.parametrize(("value", "n", "direction", "want"), [(None, 99, "high", "insufficient_data"), (0.9, 5, "high", "insufficient_data"), (0.9, 50, "high", "ok"), (0.6, 50, "high", "sad"), (0.1, 50, "high", "bad"), (0.1, 50, "low", "ok"), (0.85, 50, "low", "bad")])
def test_grades(spark, value, n, direction, want):
    df = spark.createDataFrame([(value, n)], "v double, n int")
    ok, sad = (0.8, 0.5) if direction == "high" else (0.3, 0.6)
    assert df.select(mart.grade(F.col("v"), F.col("n"), ok, sad, direction, 30)).first()[0] == want


def test_small_cohorts_are_suppressed(spark):
    df = spark.createDataFrame([("a", 1.0)] * 11 + [("b", 1.0)] * 10, "k string, v double")
    assert [r["k"] for r in mart.cohort(df, ["k"], [F.avg("v").alias("m")]).collect()] == ["a"]


def test_masks(spark):
    key = b"k" * 80
    df = spark.createDataFrame([("Zoë", [("in", "x")], ("deep",)), (None, None, None), ("", [], ("",))], "name string, tags array<struct<name:string,keep:string>>, p struct<name:string>")
    digits = policy.TOKEN_DIGITS

    def token(text):
        n = int.from_bytes(hmac.new(key, text.encode(), hashlib.sha256).digest(), "big")
        return "tok_" + "".join(digits[(n >> (5 * i)) & 31] for i in range(16))

    got = policy.mask_frame(df, {"name": "token"}, key).collect()
    assert got[0]["name"] == token("Zoë") and got[0]["tags"][0]["name"] == token("in") and got[0]["tags"][0]["keep"] == "x" and got[0]["p"]["name"] == token("deep")
    assert got[1]["name"] is None and got[1]["tags"] is None and got[1]["p"] is None and got[2]["name"] == token("")
    m = lambda scheme: [r[0] for r in df.select(policy.mask(F.col("name"), scheme)).collect()]
    assert m("generalize") == ["Z**", None, ""] and m("suppress") == [None] * 3 and m("what?") == ["[REDACTED]", None, "[REDACTED]"]
    assert m("one_way_hash")[0] == "sha256:" + hashlib.sha256("Zoë".encode()).hexdigest()[:32]


def test_first_forbidden_mixture_denies(spark):
    df = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x"), ("c", None)], "k string, t string")
    assert rows(policy.forbidden_mixture(df, ["k"], "t", [{"z"}, {"y", "x"}])) == [("a", "deny", "x,y"), ("b", "allow", None), ("c", "allow", None)]


def test_as_of_and_range_joins(spark):
    left = spark.createDataFrame([("a", 5, "l1"), ("a", 1, "l2"), ("b", 9, "l3"), (None, 4, "l4")], "k string, t int, x string")
    right = spark.createDataFrame([("a", 2, 20), ("a", 5, 50), ("a", 5, 55), ("c", 1, 1), (None, 3, 33)], "k string, t int, y int")
    assert rows(relational.asof_join(left, right, ["k"], "t", ["y"]).select("x", "y")) == [("l1", 55), ("l2", None), ("l3", None), ("l4", 33)]
    rng = random.Random(1)
    start = dt.datetime(2025, 1, 1)
    at = lambda: start + dt.timedelta(minutes=rng.randrange(6000))
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", None])
    big_l, big_r = [(key(), at(), i) for i in range(400)], [(key(), at(), i) for i in range(60)]
    dl, dr = spark.createDataFrame(big_l, "k string, t timestamp, x int"), spark.createDataFrame(big_r, "k string, t timestamp, y int")
    want = sorted((x, max(((rt, y) for rk, rt, y in big_r if rk == k and rt <= t), default=(None, None))[1]) for k, t, x in big_l)
    for seconds in (None, 3600, 86_400):
        assert sorted(map(tuple, relational.asof_join(dl, dr, ["k"], "t", ["y"], seconds).select("x", "y").collect())) == want
    points = spark.createDataFrame([(0.5,), (9.9,), (10.0,), (None,), (-3.0,)], "p double")
    ranges = spark.createDataFrame([(0.0, 10.0), (-5.0, 0.0), (9.0, 30.0), (4.0, 4.0), (None, 1.0)], "lo double, hi double")
    want = sorted((p, lo, hi) for p in (0.5, 9.9, 10.0, -3.0) for lo, hi in ((0.0, 10.0), (-5.0, 0.0), (9.0, 30.0)) if lo <= p < hi)
    assert sorted(map(tuple, relational.range_join(points, ranges, "p", "lo", "hi", 4.0).collect())) == want


def test_versions_time_travel_and_unchanged_snapshots(spark):
    store = VersionStore(spark, fresh_path(spark, "v"))
    a, b = spark.createDataFrame([(1, "x")], "k int, v string"), spark.createDataFrame([(1, "y"), (2, None)], "k int, v string")
    assert store.write("s", a) == 0 and store.write("s", b) == 1
    assert rows(store.read("s", 0)) == [(1, "x")] and store.read("s").count() == 2
    for bad in (2, -1):
        with pytest.raises(KeyError):
            store.read("s", bad)
    with pytest.raises(KeyError):
        store.read("t")
    assert store.snapshot("u", b, "k") == (0, True) and store.snapshot("u", b.repartition(3), "k") == (0, False) and store.snapshot("u", a, "k") == (1, True)


def test_token_bucket(spark):
    df = spark.createDataFrame([("a", f"2025-01-01 00:00:{s:02d}", i) for i, s in enumerate((0, 0, 0, 1, 1, 5))] + [("b", "2025-01-01 00:00:00", 9)], "k string, t string, i int").withColumn("t", F.to_timestamp("t"))
    assert rows(mart.token_bucket(df, "k", "t", "i", 1.0, 2.0).select("i", "allowed")) == [(0, True), (1, True), (2, False), (3, True), (4, False), (5, True), (9, True)]


def test_broken_chain_is_found(spark):
    df = spark.createDataFrame([("p", 1, "a", None), ("p", 2, "b", "a"), ("p", 3, "c", "x"), ("q", 1, "z", None)], "k string, n int, own string, prev string")
    assert rows(mart.chain_verify(df, ["k"], "n", "own", "prev")) == [("p", 3, 1), ("q", 1, 0)]


def test_submitted_sql_leaves_nothing_behind(spark):
    df = spark.createDataFrame([(1,), (2,)], "n int")
    assert submit_sql(spark, "select sum(n) as s from t;", {"t": df}).first()[0] == 3
    assert submit_sql(spark, "with u as (select n + 1 as n from t) select max(n) from u", {"t": df}, limit=1).first()[0] == 3
    assert [t.name for t in spark.catalog.listTables() if t.name.startswith("_t_")] == []
    with pytest.raises(Exception):
        submit_sql(spark, "select * from t", {}).count()
    for bad in ("", "  "):
        with pytest.raises(ValueError):
            submit_sql(spark, bad, {})
    assert inline_rows(spark, []).columns == ["_empty"] and inline_rows(spark, [{"a": 1}]).count() == 1


def test_workflows(spark):
    engine = Engine()
    runs = []
    engine.register(Kind("one", lambda spec, i: runs.append(spec) or spark.range(spec["n"]), "verified", ("make",)))
    engine.register(Kind("both", lambda spec, i: i[0].join(i[1], "id"), "simulated"))
    steps = [{"name": "z", "kind": "both", "from": ["a", "b"]}, {"name": "a", "kind": "one", "spec": {"n": 3}}, {"name": "b", "kind": "one", "spec": {"n": 5}}]
    out, warrant = engine.run(steps)
    assert out["z"].count() == 3 and warrant == "simulated" and engine.find("make") == ["one"]
    engine.run(steps)
    assert len(runs) == 2
    one, two = engine.seal("p", "z", out["z"], {}), engine.seal("p", "z", out["z"].repartition(3), {})
    assert one["outputs_sha"] == two["outputs_sha"] and two["previous"] == one["id"] and engine.verify()
    engine.receipts[0]["rows"] = 99
    assert not engine.verify()
    for bad in ([{"name": "a", "kind": "one", "from": ["a"]}], [{"name": "a", "kind": "one", "from": ["x"]}], [{"name": "a", "kind": "one"}] * 2):
        with pytest.raises(ValueError):
            engine.run(bad)
    with pytest.raises(KeyError):
        engine.run([{"name": "a", "kind": "none"}])


def test_size_checks(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)
    assert "broadcast" in broadcast_if_small(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert "broadcast" not in broadcast_if_small(spark.range(6), 5)._jdf.queryExecution().logical().toString().lower()


def test_batch_hash_is_free_of_order(spark):
    a = spark.createDataFrame([("x",), ("y",), ("z",)], "i string")
    h = lambda df: df.agg(logs.batch_hash(F.col("i"))).first()[0]
    assert h(a) == h(a.orderBy(F.desc("i"))) != h(a.limit(2))
    t = spark.createDataFrame([("2025-01-01T00:00:00.123456Z",), ("what",), (None,)], "t string").select(logs.event_time(F.col("t")).cast("string").alias("t"))
    assert [r[0] for r in t.collect()] == ["2025-01-01 00:00:00.123", "1970-01-01 00:00:00", "1970-01-01 00:00:00"]


def test_sessions_are_the_same_in_slices(spark):
    rng = random.Random(3)
    rows_ = [("hot" if rng.random() < 0.5 else rng.choice(["a", None]), dt.datetime(2025, 1, 1) + dt.timedelta(minutes=rng.randrange(9000)), i) for i in range(500)]
    df = spark.createDataFrame(rows_, "k string, t timestamp, i int")
    want = []
    for k in {r[0] for r in rows_}:
        last = no = None
        for t in sorted(r[1] for r in rows_ if r[0] == k):
            if last is None or (t - last).total_seconds() > 1800:
                want.append([k, (no or 0) + 1, t, t, 0])
            want[-1][3], want[-1][4], last, no = t, want[-1][4] + 1, t, want[-1][1]
    for seconds in (None, 3600, 86_400):
        assert rows(relational.sessions(df, "k", "t", 1800, "i", seconds)) == sorted(map(tuple, want), key=repr)
