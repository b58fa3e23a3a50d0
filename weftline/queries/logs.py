"""Replicated logs, triples, vectors, validation, streams and workflows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import crdt, stats, triples
from weftline.plans.workflow import Engine, Kind
from weftline.queries import graphs
from weftline.session import fresh_path, load
from weftline.sources import logs
from weftline.streaming import cursor


def op_log(spark, d):
    """Sign-ups add a user, errors delete what they have seen of it, purchases set a property, views add an edge."""
    e = load(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(Window.unboundedPreceding, -1)
    dot = F.struct(F.concat(F.lit("r"), F.col("user_id") % 3).alias("replica"), F.col("event_id").alias("seq"))
    seen = F.last(F.when(F.col("event_type") == "signup", dot), ignorenulls=True).over(w)
    op = F.create_map(*[F.lit(x) for x in ("signup", "add_node", "error", "del_node", "purchase", "set_prop", "view", "add_edge", "click", "del_edge")])[F.col("event_type")]
    node = F.concat(F.lit("u"), F.col("user_id"))
    removed = F.when((F.col("event_type") == "error") & seen.isNotNull(), F.array(seen)).otherwise(F.array().cast("array<struct<replica:string,seq:bigint>>"))
    return e.select(
        dot["replica"].alias("replica"), dot["seq"].alias("seq"), F.col("event_id").alias("hlc"), op.alias("op"), node.alias("id"), node.alias("src"), F.concat(F.lit("u"), (F.col("user_id") * 7) % 1500).alias("dst"),
        F.lit("SAW").alias("label"), F.lit("spent").alias("key"), F.col("value").cast("string").alias("value"), removed.alias("removed"),
    )


def crdt_fold(spark, d):
    log = op_log(spark, d)
    nodes, _, _ = crdt.view(crdt.merge(log, log))
    return nodes


def crdt_edges(spark, d):
    return crdt.view(op_log(spark, d))[1]


def crdt_registers(spark, d):
    return crdt.registers(op_log(spark, d)).select("id", F.round(F.col("value").cast("double"), 6).alias("spent"))


def crdt_delta(spark, d):
    log = op_log(spark, d)
    peer = log.filter((F.col("seq") < 4000) & (F.col("replica") != "r2"))
    return crdt.delta(log, crdt.version_vector(peer)).groupBy("replica").agg(F.count(F.lit(1)).alias("missing"), F.min("seq").alias("first_seq"))


def crdt_as_of(spark, d):
    """The log as it was half-way."""
    log = op_log(spark, d)
    return crdt.view(crdt.as_of(log, "hlc", log.agg(F.max("hlc")).first()[0] // 2))[0]


def _trade_triples(spark, d):
    c, n = load(spark, d, "customer", "nation")
    return triples.from_table(c, "ex:customer/{}", "c_custkey", "ex:Customer", {"ex:segment": "c_mktsegment"}, {"ex:nation": ("c_nationkey", "ex:nation/{}")}).unionByName(
        triples.from_table(n, "ex:nation/{}", "n_nationkey", "ex:Nation", {"ex:name": "n_name"}, {"ex:region": ("n_regionkey", "ex:region/{}")})
    )


def rdf_map(spark, d):
    return _trade_triples(spark, d)


def rdf_bgp(spark, d):
    t = _trade_triples(spark, d)
    return triples.match(t, [("?c", "ex:segment", "BUILDING"), ("?c", "ex:nation", "?n"), ("?n", "ex:region", "?r")])


def rdf_optional_minus(spark, d):
    t = _trade_triples(spark, d)
    people = triples.match(t, [("?c", "rdf:type", "ex:Customer"), ("?c", "ex:nation", "?n")])
    left = triples.minus(people, triples.match(t, [("?c", "ex:segment", "MACHINERY")]))
    return triples.optional(left, triples.match(t, [("?n", "ex:region", "ex:region/1"), ("?n", "ex:name", "?name")]))


def rdfs_closure(spark, d):
    schema = [("ex:Customer", triples.SUB_CLASS, "ex:Party"), ("ex:Party", triples.SUB_CLASS, "ex:Thing"), ("ex:nation", triples.SUB_PROPERTY, "ex:place"), ("ex:place", triples.RANGE, "ex:Place"), ("ex:segment", triples.DOMAIN, "ex:Buyer"), ("ex:Buyer", triples.SUB_CLASS, "ex:Party")]
    t = _trade_triples(spark, d).unionByName(spark.createDataFrame(schema, "s string, p string, o string"))
    return triples.rdfs_closure(t).filter(F.col("p") == triples.TYPE).groupBy("o").agg(F.countDistinct("s").alias("n"))


def rdf_describe(spark, d):
    return triples.describe(_trade_triples(spark, d), "ex:nation/7")


def vec_mean_pool(spark, d):
    p = stats.mean_pool(load(spark, d, "embeddings"), ["label"], "embedding")
    return p.select("label", F.posexplode("pooled").alias("i", "x")).select("label", "i", F.round("x", 5).alias("x"))


def vec_label_similarity(spark, d):
    """Cosine of every vector to the mean vector of its label."""
    e = load(spark, d, "embeddings")
    p = stats.mean_pool(e, ["label"], "embedding")
    return e.join(F.broadcast(p), "label").select("vec_id", F.round(stats.cosine(F.col("embedding"), F.col("pooled")), 5).alias("similarity"))


def vec_eigen_stability(spark, d):
    return stats.eigen_stability(load(spark, d, "embeddings"), "label", "embedding").select("label", "n", F.round("top_share", 6).alias("top_share"))


def stat_ridge(spark, d):
    found = stats.ridge(load(spark, d, "lineitem"), ["l_quantity"], "l_extendedprice", 10.0)
    return spark.createDataFrame([(k, round(v, 3)) for k, v in found.items()], "name string, coefficient double")


def stat_date_shift(spark, d):
    """Gaps between a customer's dates survive the shift."""
    o = load(spark, d, "orders").withColumn("moved", stats.date_shift(F.to_date("o_orderdate"), F.col("o_custkey"), "key"))
    return o.groupBy("o_custkey").agg(F.date_diff(F.max("moved"), F.min("moved")).alias("span_days"), (F.abs(F.date_diff(F.min("moved"), F.min(F.to_date("o_orderdate")))) <= 183).alias("near"))


def stat_backoff(spark, d):
    e = load(spark, d, "events").filter("event_type = 'error'")
    n = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select("event_id", stats.backoff(n, 5.0, 4).alias("wait"))


def log_validate(spark, d):
    ok, bad = stats.route_valid(load(spark, d, "metric_facts"), {"has_value": F.col("value_scalar").isNotNull() & ~F.isnan("value_scalar"), "has_run": F.trim("run_id") != "", "positive_latency": F.col("latency_ms_p50") > 0})
    broken = bad.groupBy(F.array_join("broken_rules", ",").alias("broken")).agg(F.count(F.lit(1)).alias("n"))
    return broken.unionByName(ok.agg(F.count(F.lit(1)).alias("n")).select(F.lit("").alias("broken"), "n"))


def log_envelope(spark, d):
    e = load(spark, d, "events")
    out = logs.envelope(e, "shop", F.col("event_type"), F.col("user_id"), F.date_trunc("second", "ts"), F.struct("event_id", "value"))
    return out.groupBy("type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("id").alias("ids"))


def log_changed_ids(spark, d):
    """The ids that any change of the log touches."""
    return logs.changed_ids(load(spark, d, "hellgraph_events"))


def log_event_rows(spark, d):
    """Log rows projected by kind: labels for nodes, ends for edges, canonical properties."""
    e = load(spark, d, "hellgraph_events")
    edge = F.col("event_id").startswith("edge")
    props = logs.canonical_json(F.from_json("properties", "map<string,string>"))
    return e.groupBy(F.when(edge, "edge").otherwise("node").alias("what"), F.when(edge, F.col("label")).otherwise(F.split("label", ",")[0]).alias("first_label")).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(props).alias("property_sets"))


def log_ticks(spark, d):
    return logs.ticks(spark, ["AAA", "BBB", "CCC"], 1000, 42)


def log_crawl(spark, d):
    """Pages made of documents, each linking to two others; a crawl of depth 6 from the first."""
    docs = load(spark, d, "documents")
    n = F.col("doc_id")
    site = F.concat(F.lit("https://hub.example/p"), n)
    html = F.concat(F.lit('<a href="/p'), n * 2, F.lit('#top">a</a> [b](https://hub.example/p'), n * 2 + 1, F.lit(") https://other.example/p"), n)
    pages = docs.select(site.alias("url"), html.alias("html"))
    return logs.crawl(pages, spark.createDataFrame([("https://hub.example/p1#x",)], "url string"), 6)


def stream_tumbling(spark, d):
    s = cursor.run_available(cursor.tumbling(cursor.event_stream(spark, d), "1 day", "10 minutes"))
    return s.withColumn("total", F.round("total", 2)).withColumn("started", F.col("started").cast("timestamp_ntz"))


def stream_sessions(spark, d):
    s = cursor.run_available(cursor.session_counts(cursor.event_stream(spark, d), "2 hours", "10 minutes"))
    return s.select("user_id", F.col("started").cast("timestamp_ntz").alias("started"), F.col("ended").cast("timestamp_ntz").alias("ended"), "n")


def stream_dedup(spark, d):
    s = cursor.event_stream(spark, d)
    twice = s.unionByName(s).withWatermark("ts", "40 days").dropDuplicatesWithinWatermark(["event_id"])
    return cursor.run_available(twice.select("event_id", "event_type"))


def stream_latest_wins(spark, d):
    each, table = cursor.latest_wins_sink(spark, fresh_path(spark, "latest"), "key", "event_id", ["value"])
    s = cursor.event_stream(spark, d).select(F.concat_ws("|", "user_id", "event_type").alias("key"), "event_id", "value")
    cursor.run_batches(s, each, fresh_path(spark, "latest-checkpoint"))
    return table.state()


def stream_percolate(spark, d):
    """What the whole log, taken as one batch, has to make anew."""
    return cursor.percolate(graphs.event_edges(spark, d), load(spark, d, "hellgraph_events"))


def stream_attempts(spark, d):
    s = cursor.event_stream(spark, d).filter("event_type = 'error'").select("user_id")
    out = cursor.run_available(cursor.attempts(s, "user_id", 3))
    return out.groupBy("user_id").agg(F.max("attempt").alias("attempts"), F.count_if("dead").alias("dead"))


def stream_materialize(spark, d):
    """The change log polled in pages into a latest-wins table, then a poll that finds nothing."""
    log = load(spark, d, "hellgraph_events").filter("seq is not null").select("event_id", "seq", "label")
    path = fresh_path(spark, "materialized")
    each, table = cursor.latest_wins_sink(spark, f"{path}/table", "event_id", "seq", ["label"])
    n = log.count()
    work = cursor.Materializer(spark, path, lambda batch: each(batch, 0), limit=max(1000, n // 3))
    while work.run_once(log) is not None:
        pass
    return table.state().select("event_id", "seq")


def workflow_run(spark, d):
    """A workflow of four steps over registered kinds, with its warrant."""
    engine = Engine()
    engine.register(Kind("table", lambda spec, _: load(spark, d, spec["name"]), "observed"))
    engine.register(Kind("join", lambda spec, i: i[0].join(i[1], F.expr(spec["on"]))))
    engine.register(Kind("count", lambda spec, i: i[0].groupBy(spec["by"]).agg(F.count(F.lit(1)).alias("n"))))
    steps = [
        {"name": "by_nation", "kind": "count", "from": ["joined"], "spec": {"by": "n_name"}}, {"name": "joined", "kind": "join", "from": ["customers", "nations"], "spec": {"on": "c_nationkey = n_nationkey"}},
        {"name": "customers", "kind": "table", "spec": {"name": "customer"}}, {"name": "nations", "kind": "table", "spec": {"name": "nation"}},
    ]
    out, warrant = engine.run(steps)
    engine.seal("demo", "by_nation", out["by_nation"], {"steps": steps})
    return out["by_nation"].withColumn("warrant", F.lit(warrant)).withColumn("verified", F.lit(engine.verify()))


_LIVE = "WITH s AS (SELECT user_id, event_id, event_type, lead(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS nxt FROM events), live AS (SELECT DISTINCT user_id FROM s a WHERE event_type = 'signup' AND NOT EXISTS (SELECT 1 FROM events e WHERE e.user_id = a.user_id AND e.event_type = 'error' AND e.event_id > a.event_id AND (a.nxt IS NULL OR e.event_id < a.nxt)))"
_T = """t AS (SELECT 'ex:customer/' || c_custkey AS s, unnest(['rdf:type', 'ex:segment', 'ex:nation']) AS p, unnest(['ex:Customer', c_mktsegment, 'ex:nation/' || c_nationkey]) AS o FROM customer
UNION ALL SELECT 'ex:nation/' || n_nationkey, unnest(['rdf:type', 'ex:name', 'ex:region']), unnest(['ex:Nation', n_name, 'ex:region/' || n_regionkey]) FROM nation)"""

QUERIES = {
    "crdt_fold": (crdt_fold, _LIVE + " SELECT 'u' || user_id AS id FROM live"),
    "crdt_edges": (crdt_edges, _LIVE + " SELECT DISTINCT 'u' || user_id AS src, 'u' || (user_id * 7) % 1500 AS dst, 'SAW' AS label FROM events WHERE event_type = 'view' AND user_id IN (SELECT user_id FROM live) AND (user_id * 7) % 1500 IN (SELECT user_id FROM live)"),
    "crdt_registers": (crdt_registers, "SELECT 'u' || user_id AS id, round(arg_max(value, event_id), 6) AS spent FROM events WHERE event_type = 'purchase' GROUP BY 1"),
    "crdt_delta": (crdt_delta, "WITH l AS (SELECT 'r' || user_id % 3 AS replica, event_id AS seq FROM events), v AS (SELECT replica, max(seq) AS seen FROM l WHERE seq < 4000 AND replica <> 'r2' GROUP BY 1) SELECT replica, count(*) AS missing, min(seq) AS first_seq FROM l LEFT JOIN v USING (replica) WHERE seen IS NULL OR seq > seen GROUP BY 1"),
    "crdt_as_of": (crdt_as_of, _LIVE.replace("FROM events)", "FROM events WHERE event_id <= (SELECT max(event_id) // 2 FROM events))").replace("FROM events e WHERE", "FROM events e WHERE e.event_id <= (SELECT max(event_id) // 2 FROM events) AND") + " SELECT 'u' || user_id AS id FROM live"),
    "rdf_map": (rdf_map, f"WITH {_T} SELECT s, p, o FROM t"),
    "rdf_bgp": (rdf_bgp, "SELECT 'ex:customer/' || c_custkey AS c, 'ex:nation/' || c_nationkey AS n, 'ex:region/' || n_regionkey AS r FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE c_mktsegment = 'BUILDING'"),
    "rdf_optional_minus": (rdf_optional_minus, "SELECT 'ex:customer/' || c_custkey AS c, 'ex:nation/' || c_nationkey AS n, n_name AS name FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey = 1) ON c_nationkey = n_nationkey WHERE c_mktsegment <> 'MACHINERY'"),
    "rdfs_closure": (rdfs_closure, "SELECT unnest(['ex:Customer', 'ex:Party', 'ex:Thing', 'ex:Buyer']) AS o, (SELECT count(*) FROM customer) AS n UNION ALL SELECT 'ex:Nation', count(*) FROM nation UNION ALL SELECT 'ex:Place', count(DISTINCT c_nationkey) FROM customer"),
    "rdf_describe": (rdf_describe, f"WITH {_T} SELECT s, p, o FROM t WHERE s = 'ex:nation/7' OR o = 'ex:nation/7'"),
    "vec_mean_pool": (vec_mean_pool, "SELECT label, i::INT AS i, round(avg(x), 5) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL"),
    "vec_label_similarity": (vec_label_similarity, "WITH m AS (SELECT label, i, avg(x) AS x FROM (SELECT label, unnest(range(len(embedding))) AS i, unnest(embedding)::DOUBLE AS x FROM embeddings) GROUP BY ALL), p AS (SELECT label, list(x ORDER BY i) AS pooled FROM m GROUP BY 1) SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], pooled), 5) AS similarity FROM embeddings JOIN p USING (label)"),
    "vec_eigen_stability": (vec_eigen_stability, None),
    "stat_ridge": (stat_ridge, "WITH m AS (SELECT covar_pop(l_quantity, l_extendedprice) AS c, var_pop(l_quantity) AS v, stddev_pop(l_quantity) AS sd, count(*) AS n, avg(l_quantity) AS mx, avg(l_extendedprice) AS my FROM lineitem), b AS (SELECT *, (n * c / sd) / (n + 10.0) / sd AS beta FROM m) SELECT 'l_quantity' AS name, round(beta, 3) AS coefficient FROM b UNION ALL SELECT 'intercept', round(my - beta * mx, 3) FROM b"),
    "stat_date_shift": (stat_date_shift, "SELECT o_custkey, (max(o_orderdate)::DATE - min(o_orderdate)::DATE)::INT AS span_days, true AS near FROM orders GROUP BY 1"),
    "stat_backoff": (stat_backoff, "SELECT event_id, CASE WHEN n <= 4 THEN 5.0 * pow(2, n - 1) END AS wait FROM (SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events WHERE event_type = 'error')"),
    "log_validate": (log_validate, "SELECT concat_ws(',', CASE WHEN value_scalar IS NULL OR isnan(value_scalar) THEN 'has_value' END, CASE WHEN NOT coalesce(trim(run_id) <> '', false) THEN 'has_run' END, CASE WHEN NOT coalesce(latency_ms_p50 > 0, false) THEN 'positive_latency' END) AS broken, count(*) AS n FROM metric_facts GROUP BY 1"),
    "log_envelope": (log_envelope, "SELECT event_type AS type, count(*) AS n, count(DISTINCT (user_id, date_trunc('second', ts), event_id, value)) AS ids FROM events GROUP BY 1"),
    "log_changed_ids": (log_changed_ids, "SELECT event_id AS id FROM hellgraph_events WHERE event_id <> '' UNION SELECT from_id FROM hellgraph_events WHERE from_id <> '' UNION SELECT to_id FROM hellgraph_events WHERE to_id <> ''"),
    "log_event_rows": (log_event_rows, """WITH r AS (SELECT CASE WHEN event_id LIKE 'edge%' THEN 'edge' ELSE 'node' END AS what, CASE WHEN event_id LIKE 'edge%' THEN label ELSE string_split(label, ',')[1] END AS first_label,
CASE WHEN json_valid(properties) THEN list_sort([k || '=' || coalesce(json_extract_string(properties, '$."' || k || '"'), chr(1)) for k in json_keys(properties)]) END AS p FROM hellgraph_events)
SELECT what, first_label, count(*) AS n, count(DISTINCT p) AS property_sets FROM r GROUP BY ALL"""),
    "log_ticks": (log_ticks, None),
    "log_crawl": (log_crawl, "WITH RECURSIVE c AS (SELECT 1::BIGINT AS n, 0 AS depth UNION SELECT d, depth + 1 FROM (SELECT unnest([n * 2, n * 2 + 1]) AS d, depth FROM c WHERE depth < 6) WHERE d IN (SELECT doc_id FROM documents)) SELECT 'https://hub.example/p' || n AS url, min(depth) AS depth FROM c GROUP BY n"),
    "stream_tumbling": (stream_tumbling, "WITH w AS (SELECT event_type, ts::DATE::TIMESTAMP AS started, count(*) AS n, round(sum(value), 2) AS total FROM events GROUP BY 1, 2) SELECT * FROM w WHERE started + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"),
    "stream_sessions": (stream_sessions, "WITH m AS (SELECT *, CASE WHEN ts < lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) + INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM m) SELECT user_id, min(ts) AS started, max(ts) + INTERVAL 2 HOUR AS ended, count(*) AS n FROM s GROUP BY user_id, k HAVING ended <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE"),
    "stream_dedup": (stream_dedup, "SELECT event_id, event_type FROM events"),
    "stream_latest_wins": (stream_latest_wins, "SELECT user_id || '|' || event_type AS key, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY 1"),
    "stream_percolate": (stream_percolate, "WITH RECURSIVE e AS (SELECT DISTINCT from_id AS src, to_id AS dst FROM hellgraph_events WHERE from_id <> '' AND to_id <> ''), s AS (SELECT event_id AS id FROM hellgraph_events WHERE event_id <> '' UNION SELECT from_id FROM hellgraph_events WHERE from_id <> '' UNION SELECT to_id FROM hellgraph_events WHERE to_id <> ''), c AS (SELECT id FROM s UNION SELECT dst FROM c JOIN e ON src = id) SELECT id FROM c"),
    "stream_attempts": (stream_attempts, "SELECT user_id, count(*) AS attempts, greatest(count(*) - 2, 0) AS dead FROM events WHERE event_type = 'error' GROUP BY 1"),
    "stream_materialize": (stream_materialize, "SELECT event_id, max(seq) AS seq FROM hellgraph_events WHERE seq IS NOT NULL GROUP BY 1"),
    "workflow_run": (workflow_run, "SELECT n_name, count(*) AS n, 'observed' AS warrant, true AS verified FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY 1"),
}
