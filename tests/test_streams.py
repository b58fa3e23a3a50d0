import pytest
from pyspark.sql import functions as F

from weftline.operators import crdt, stats, triples
from weftline.session import fresh_path
from weftline.sources import logs
from weftline.streaming import cursor


def log(spark, *rows):
    return spark.createDataFrame([(e, s, f"l{s}") for e, s in rows], "event_id string, seq bigint, label string")


def test_crash_between_write_and_cursor_repeats_without_harm(spark):
    path = fresh_path(spark, "m")
    each, table = cursor.latest_wins_sink(spark, f"{path}/t", "event_id", "seq", ["label"], 4)
    all_rows = log(spark, ("a", 1), ("b", 2), ("a", 3), ("c", 3), ("d", 4))
    calls = []

    def failing(batch):
        each(batch, 0)
        calls.append(batch.count())
        if len(calls) == 1:
            raise RuntimeError("crash after the write")

    work = cursor.Materializer(spark, path, failing, limit=3)
    with pytest.raises(RuntimeError):
        work.run_once(all_rows)
    assert work.cursor() == -1
    first = work.run_once(all_rows)
    assert (first["from_cursor"], first["to_cursor"], first["row_count"]) == (-1, 3, 4)  # rows of one seq stay together
    assert work.lag(all_rows) == 1 and work.run_once(all_rows)["to_cursor"] == 4 and work.run_once(all_rows) is None
    assert sorted((r.event_id, r.seq) for r in table.state().collect()) == [("a", 3), ("b", 2), ("c", 3), ("d", 4)]


def test_stream_batches_into_a_table_are_idempotent(spark):
    src, path = fresh_path(spark, "src"), fresh_path(spark, "dst")
    each, table = cursor.latest_wins_sink(spark, path, "event_id", "seq", ["label"], 4)
    for rows in ([("a", 1), ("b", 5)], [("a", 4), ("b", 2)]):
        log(spark, *rows).coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema("event_id string, seq bigint, label string").option("maxFilesPerTrigger", 1).parquet(src)
    cursor.run_batches(stream, each, f"{path}-c1")
    want = [("a", 4), ("b", 5)]
    assert sorted((r.event_id, r.seq) for r in table.state().collect()) == want
    cursor.run_batches(stream, each, f"{path}-c2")
    assert sorted((r.event_id, r.seq) for r in table.state().collect()) == want


def test_percolation(spark):
    edges = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("d", "e", "x")], "src string, dst string, label string")
    batch = spark.createDataFrame([("a", "", ""), ("edge1", "d", "zz")], "event_id string, from_id string, to_id string")
    assert sorted(r.id for r in cursor.percolate(edges, batch).collect()) == ["a", "b", "c", "d", "e", "edge1", "zz"]


def test_whole_log_queries_reach_the_last_change(spark, sf):
    import __spark_entry__ as entry

    log_ = spark.read.parquet(f"{sf}/hellgraph_events.parquet")
    every = {x for r in log_.select("event_id", "from_id", "to_id").collect() for x in r if x}
    for name in ("log_changed_ids", "stream_percolate"):
        assert {r.id for r in entry.queries()[name](spark, sf).collect()} == every


OPS = [("r1", 1, 1, "add_node", "n", None, None, None, None, None, []), ("r2", 1, 2, "add_node", "n", None, None, None, None, None, []), ("r1", 2, 3, "del_node", "n", None, None, None, None, None, [("r1", 1)]),
       ("r1", 3, 4, "add_node", "m", None, None, None, None, None, []), ("r1", 4, 5, "add_edge", None, "n", "m", "L", None, None, []), ("r1", 5, 6, "add_edge", None, "n", "gone", "L", None, None, []),
       ("r1", 6, 9, "set_prop", "n", None, None, None, "k", "old", []), ("r2", 2, 9, "set_prop", "n", None, None, None, "k", "new", []), ("r2", 3, 8, "set_prop", "x", None, None, None, "k", "v", [])]


def test_replicas_converge(spark):
    one, two = (spark.createDataFrame([o for o in OPS if o[0] == r], crdt.LOG) for r in ("r1", "r2"))
    views = [tuple(sorted(map(tuple, f.collect())) for f in crdt.view(m)) for m in (crdt.merge(one, two), crdt.merge(two, one, two, one))]
    assert views[0] == views[1] == ([("m",), ("n",)], [("n", "m", "L")], [("n", "k", "new")])
    assert [tuple(r)[:2] for r in crdt.delta(crdt.merge(one, two), crdt.version_vector(one)).orderBy("seq").collect()] == [("r2", 1), ("r2", 2), ("r2", 3)]
    assert crdt.delta(two, crdt.version_vector(two)).count() == 0


def test_patterns_and_closure(spark):
    t = spark.createDataFrame([("a", "p", "b"), ("b", "p", "c"), ("a", "q", "a"), ("p", triples.SUB_PROPERTY, "pp"), ("p", triples.TYPE, triples.SYMMETRIC)], "s string, p string, o string")
    assert [tuple(r) for r in triples.match(t, [("?x", "p", "?y"), ("?y", "p", "?z")]).select("x", "y", "z").collect()] == [("a", "b", "c")]
    assert [r.x for r in triples.match(t, [("?x", "q", "?x")]).collect()] == ["a"]
    with pytest.raises(ValueError):
        triples.match(t, [("?x", "p", "?y"), ("?z", "q", "?w")])
    closed = {tuple(r) for r in triples.rdfs_closure(t).collect()}
    assert {("b", "p", "a"), ("c", "p", "b"), ("a", "pp", "b"), ("c", "pp", "b")} <= closed
    assert triples.rdfs_closure(t.limit(0)).count() == 0


def test_statistics(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2)) * [1, 5] + [3, -2]
    y = 2 * x[:, 0] - 0.5 * x[:, 1] + 7 + rng.normal(size=300) * 0.1
    df = spark.createDataFrame([(float(a), float(b), 1.0, float(c)) for (a, b), c in zip(x, y)] + [(None, 1.0, 1.0, 2.0)], "a double, b double, c double, y double")
    got = stats.ridge(df, ["a", "b", "c"], "y", 4.0)
    z = (x - x.mean(0)) / x.std(0)
    beta = np.linalg.solve(z.T @ z + 4 * np.eye(2), z.T @ (y - y.mean())) / x.std(0)
    assert np.allclose([got["a"], got["b"], got["c"], got["intercept"]], [*beta, 0, y.mean() - beta @ x.mean(0)])
    v = rng.normal(size=(40, 4))
    e = spark.createDataFrame([("k", [float(t) for t in r]) for r in v] + [("k", None), ("k", [0.0] * 4)], "k string, v array<double>").repartition(5)
    u = v / np.linalg.norm(v, axis=1)[:, None]
    values = np.linalg.eigvalsh(u @ u.T)
    row = stats.eigen_stability(e, "k", "v").first()
    assert row.n == 40 and abs(row.top_share - values[-1] / values.sum()) < 1e-9


def test_ticks_are_the_same_for_a_seed(spark):
    a, b = logs.ticks(spark, ["A", "B"], 50, 7), logs.ticks(spark, ["B", "A"], 50, 7)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect())) and a.filter(F.col("price") < 0.01).isEmpty()
    assert sorted(map(tuple, a.collect())) != sorted(map(tuple, logs.ticks(spark, ["A", "B"], 50, 8).collect()))
