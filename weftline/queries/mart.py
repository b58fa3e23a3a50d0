"""Marts, indicators, masking and snapshots."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import mart, policy
from weftline.operators import relational as rel
from weftline.session import fresh_path, load
from weftline.sources.versions import VersionStore


def latest_wins(spark, d):
    e = load(spark, d, "events").select("user_id", "event_type", "event_id", "value")
    return mart.latest_wins(e, ["user_id", "event_type"], "event_id")


def summing_merge(spark, d):
    e = load(spark, d, "events").select(F.to_date("ts").alias("day"), "event_type", "value", F.lit(1).cast("bigint").alias("n"))
    return mart.summing_merge(e, ["day", "event_type"], ["value", "n"]).withColumn("value", F.round("value", 2))


def upsert_merge(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    base = c.select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("balance"))
    changes = s.select((F.col("s_suppkey") * 20).alias("id"), F.col("s_acctbal").alias("balance"))
    return rel.upsert(base, changes, ["id"])


def versioned_read_as_of(spark, d):
    o = load(spark, d, "orders")
    store = VersionStore(spark, fresh_path(spark, "versions"))
    for status in ("F", "O"):
        store.write("orders", o.filter(F.col("o_orderstatus") == status).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("order_count")))
    return store.read("orders", as_of=0)


def snapshot_if_changed(spark, d):
    """Three snapshots of which the second changes nothing: their versions and whether they are new."""
    s = load(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey")
    store = VersionStore(spark, fresh_path(spark, "snapshots"))
    rows = []
    for step, frame in enumerate((s, s.repartition(3), s.withColumn("s_nationkey", F.col("s_nationkey") + 1))):
        version, new = store.snapshot("supplier", frame, "s_suppkey")
        rows.append((step, version, new))
    return spark.createDataFrame(rows, "step int, version int, is_new boolean")


def state_hash(spark, d):
    return mart.state_hash(load(spark, d, "nation"), "n_nationkey", ["n_name", "n_regionkey"])


def kpi_hit_rate(spark, d):
    hit = F.col("value") > 10
    return load(spark, d, "events").groupBy("event_type").agg(F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("hits"), F.count_if(~hit).alias("misses"), F.round(F.count_if(hit) / F.count(F.lit(1)), 4).alias("hit_rate"))


def kpi_hot_entries(spark, d):
    return load(spark, d, "lineitem").groupBy("l_partkey").agg(F.count(F.lit(1)).alias("hits")).orderBy(F.desc("hits"), "l_partkey").limit(20)


def kpi_cold_anti(spark, d):
    s, i = load(spark, d, "supplier", "lineitem")
    hit = i.filter("l_discount >= 0.1 and l_quantity > 46").select(F.col("l_suppkey").alias("s_suppkey"))
    return s.join(hit, "s_suppkey", "left_anti").select("s_suppkey")


def slo_grade(spark, d):
    k = kpi_hit_rate(spark, d)
    return k.select("event_type", mart.grade(F.col("hit_rate"), F.col("total"), 0.62, 0.5, "high", 30).alias("verdict"))


def k_anon_cohort(spark, d):
    c = load(spark, d, "customer")
    return mart.cohort(c, ["c_nationkey", "c_mktsegment"], [F.round(F.avg((F.col("c_acctbal") < 0).cast("double")), 6).alias("negative_rate")])


def hhi_concentration(spark, d):
    i, s = load(spark, d, "lineitem", "supplier")
    j = i.join(s, i.l_suppkey == s.s_suppkey)
    out = mart.concentration(j, ["s_nationkey"], "s_suppkey", "l_extendedprice")
    return out.select("s_nationkey", *[F.round(c, 6).alias(c) for c in ("hhi", "effective", "top_weight")])


def var_parametric(spark, d):
    daily = load(spark, d, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.sum("value").alias("v"))
    ret = daily.withColumn("ret", F.col("v") / F.lag("v").over(Window.partitionBy("event_type").orderBy("day")) - 1)
    total = daily.agg(F.sum("v").alias("t"))
    weights = daily.groupBy("event_type").agg(F.sum("v").alias("s")).join(F.broadcast(total)).select("event_type", (F.col("s") / F.col("t")).alias("weight"))
    return mart.parametric_var(ret, weights, "event_type", 1_000_000.0).select(F.round("var", 2).alias("var"))


def reconcile_tolerance(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    sums = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg((F.sum("l_extendedprice") / 1000).alias("thousands"))
    scaled = F.col("thousands") * 1000
    return o.join(sums, "o_orderkey").groupBy("o_orderstatus").agg(
        F.count(F.lit(1)).alias("compared"), F.count_if(F.abs(scaled - F.col("o_totalprice")) <= F.abs(F.col("o_totalprice")) * 0.1).alias("within_tolerance")
    )


def mask_fields(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.col("c_name").alias("name"), F.col("c_mktsegment").alias("segment"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation"))
    return policy.mask_frame(c, {"name": "one_way_hash", "segment": "generalize", "balance": "suppress", "nation": "redact"})


def mask_nested(spark, d):
    c = load(spark, d, "customer").select("c_custkey", F.struct(F.col("c_name").alias("name"), F.array(F.struct(F.col("c_mktsegment").alias("segment"))).alias("tags")).alias("properties"))
    out = policy.mask_frame(c, {"name": "one_way_hash", "segment": "generalize"})
    return out.select("c_custkey", F.col("properties.name").alias("name"), F.col("properties.tags")[0]["segment"].alias("segment"))


def mask_tokens(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", policy.token(b"test key", F.col("c_name")).alias("name_token"))


def forbidden_mixture(spark, d):
    e = load(spark, d, "events").filter("value > 25")
    return policy.forbidden_mixture(e, ["user_id"], "event_type", [{"purchase", "error"}, {"signup", "view"}])


def policy_reasons(spark, d):
    c = load(spark, d, "customer")
    rules = {"negative": F.col("c_acctbal") < 0, "far": F.col("c_nationkey") > 20, "machinery": F.col("c_mktsegment") == "MACHINERY"}
    return c.select("c_custkey", F.array_join(policy.reasons(rules), ",").alias("reasons"))


_STATUS = {"F": "verified", "O": "observed", "P": "hypothesis"}


def weakest_warrant(spark, d):
    o = load(spark, d, "orders")
    names = F.create_map(*[F.lit(x) for pair in _STATUS.items() for x in pair])
    return o.groupBy("o_custkey").agg(mart.weakest(names[F.col("o_orderstatus")]).alias("warrant"))


def leaderboard_rank(spark, d):
    p = load(spark, d, "profile_scores").filter(F.col("score").isNotNull() & ~F.isnan("score"))
    mean = p.groupBy("subject_kind", "score_policy_id").agg(F.round(F.avg("score"), 6).alias("mean_score"), F.count(F.lit(1)).alias("n"))
    return mean.withColumn("place", F.rank().over(Window.partitionBy("subject_kind").orderBy(F.desc("mean_score"))))


def provenance_rollup(spark, d):
    f = load(spark, d, "metric_facts")
    return f.groupBy("model_release_id").agg(
        F.array_join(F.array_sort(F.collect_set("source_trust_class")), ",").alias("trust_classes"), F.min("freshness_days").alias("freshest"), F.max("freshness_days").alias("stalest"),
        F.sum("trial_count").alias("trials"), F.max("reproduced_by_us").alias("reproduced"), F.count(F.lit(1)).alias("fact_count"),
    )


def provenance_order(spark, d):
    f = load(spark, d, "metric_facts")
    cols = ["metric_fact_id", "freshness_days", "ts", "sample_n"]
    return f.select(*cols).distinct().orderBy(F.desc_nulls_last("sample_n"), F.asc_nulls_last("freshness_days"), F.desc("ts"), "metric_fact_id").limit(200).select("metric_fact_id")


def balanced_accuracy(spark, d):
    e = load(spark, d, "events").withColumn("truth", F.col("event_type") == "error").withColumn("guess", F.col("value") > 20)
    return mart.balanced_accuracy(e, ["user_id"], "truth", "guess").select("user_id", F.round("score", 6).alias("score"))


def coding_f1(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    found = i.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k"))
    gold = o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k"))
    m = mart.precision_recall(found, gold, ["k"])
    return m.select("tp", "fp", "fn", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), F.round("f1", 6).alias("f1"))


def clause_diff(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    a = c.groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("v")).filter("k % 7 != 0")
    b = s.groupBy(F.col("s_nationkey").alias("k")).agg((F.count(F.lit(1)) * 15).alias("v")).filter("k % 4 != 0")
    return mart.set_diff(a, b, "k", "v")


def federated_blend(spark, d):
    i = load(spark, d, "lineitem")
    make = lambda flag: i.filter(F.col("l_returnflag") == flag).groupBy(F.concat(F.lit("Url/"), F.col("l_partkey")).alias("url")).agg(F.count(F.lit(1)).alias("score"))
    return mart.blend([make("A"), make("N"), make("R")], "url", 8, [F.desc("score"), F.asc("url")]).select("url", "source_no", "rank_no")


def rate_limit(spark, d):
    e = load(spark, d, "events").select("user_id", "event_id", "ts")
    return mart.token_bucket(e, "user_id", "ts", "event_id", 1 / 20000, 3.0).select("event_id", "allowed")


def visit_rollup(spark, d):
    return load(spark, d, "orders").groupBy("o_custkey").agg(F.count(F.lit(1)).alias("visits"), F.min("o_orderdate").alias("first_seen"), F.max("o_orderdate").alias("last_seen"))


def pair_interaction(spark, d):
    """Known pairs of brands (unordered, here neighbours by number) that meet in one order, with how many orders.

    The table of pairs drives the join, so no other pair of an order's brands is ever built.
    """
    i, p = load(spark, d, "lineitem", "part")
    number = F.regexp_extract("p_brand", r"(\d+)$", 1).cast("int")
    brands = p.select("p_brand", number.alias("no")).distinct()
    known = brands.alias("a").join(brands.alias("b"), F.col("b.no") == F.col("a.no") + 1).select(F.least("a.p_brand", "b.p_brand").alias("brand_a"), F.greatest("a.p_brand", "b.p_brand").alias("brand_b"))
    held = i.join(p, i.l_partkey == p.p_partkey).select("l_orderkey", F.col("p_brand").alias("brand_a")).distinct()
    both = held.join(known, "brand_a").join(held.withColumnRenamed("brand_a", "brand_b"), ["l_orderkey", "brand_b"])
    return both.groupBy("brand_a", "brand_b").agg(F.count(F.lit(1)).alias("orders_n"))


def slo_p99_window(spark, d):
    w = F.window("ts", "5 minutes")
    return load(spark, d, "events").groupBy("event_type", w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.expr("percentile_disc(0.99) WITHIN GROUP (ORDER BY value)").alias("p99")).select("event_type", F.col("w.start").alias("started"), "n", "p99")


def receipts_verify(spark, d):
    """Hash chains per user over events, each row sealed with the one before; a chain with a changed row is found broken."""
    e = load(spark, d, "events")
    w = Window.partitionBy("user_id").orderBy("event_id")
    own = e.withColumn("own", F.sha2(F.concat_ws("|", "event_id", "event_type"), 256))
    sealed = own.withColumn("prev", F.lag("own").over(w))
    changed = sealed.withColumn("own", F.when(F.col("event_type") == "signup", F.sha2(F.col("own"), 256)).otherwise(F.col("own")))
    return mart.chain_verify(changed, ["user_id"], "event_id", "own", "prev")


_DAILY = "WITH daily AS (SELECT event_type, ts::DATE AS day, sum(value) AS v FROM events GROUP BY ALL)"
_HIT = "SELECT event_type, count(*) AS total, count(*) FILTER (WHERE value > 10) AS hits, count(*) FILTER (WHERE NOT value > 10) AS misses, round(count(*) FILTER (WHERE value > 10) / count(*), 4) AS hit_rate FROM events GROUP BY 1"

QUERIES = {
    "latest_wins": (latest_wins, "SELECT user_id, event_type, max(event_id) AS event_id, arg_max(value, event_id) AS value FROM events GROUP BY ALL"),
    "summing_merge": (summing_merge, "SELECT ts::DATE AS day, event_type, round(sum(value), 2) AS value, count(*) AS n FROM events GROUP BY ALL"),
    "upsert_merge": (upsert_merge, "SELECT coalesce(c_custkey, k) AS id, CASE WHEN k IS NULL THEN c_acctbal ELSE s_acctbal END AS balance, CASE WHEN k IS NULL THEN 'kept' WHEN c_custkey IS NULL THEN 'inserted' ELSE 'updated' END AS action FROM customer FULL JOIN (SELECT s_suppkey * 20 AS k, s_acctbal FROM supplier) ON c_custkey = k"),
    "versioned_read_as_of": (versioned_read_as_of, "SELECT o_custkey, count(*) AS order_count FROM orders WHERE o_orderstatus = 'F' GROUP BY 1"),
    "snapshot_if_changed": (snapshot_if_changed, "SELECT * FROM (VALUES (0, 0, true), (1, 0, false), (2, 1, true)) t(step, version, is_new)"),
    "state_hash": (state_hash, "WITH h AS (SELECT sha256(concat_ws('|', n_nationkey, n_name, n_regionkey)) AS h FROM nation), f AS (SELECT h[1:3] AS p, sha256(string_agg(h, '' ORDER BY h)) AS ph, count(*) AS n FROM h GROUP BY 1) SELECT sha256(string_agg(ph, '' ORDER BY p)) AS state_hash, sum(n)::BIGINT AS rows FROM f"),
    "kpi_hit_rate": (kpi_hit_rate, _HIT),
    "kpi_hot_entries": (kpi_hot_entries, "SELECT l_partkey, count(*) AS hits FROM lineitem GROUP BY 1 ORDER BY hits DESC, l_partkey LIMIT 20"),
    "kpi_cold_anti": (kpi_cold_anti, "SELECT s_suppkey FROM supplier WHERE s_suppkey NOT IN (SELECT l_suppkey FROM lineitem WHERE l_discount >= 0.1 AND l_quantity > 46)"),
    "slo_grade": (slo_grade, f"WITH k AS ({_HIT}) SELECT event_type, CASE WHEN total < 30 THEN 'insufficient_data' WHEN hit_rate >= 0.62 THEN 'ok' WHEN hit_rate >= 0.5 THEN 'sad' ELSE 'bad' END AS verdict FROM k"),
    "k_anon_cohort": (k_anon_cohort, "SELECT c_nationkey, c_mktsegment, count(*) AS members, round(avg((c_acctbal < 0)::INT), 6) AS negative_rate FROM customer GROUP BY ALL HAVING count(*) >= 11"),
    "hhi_concentration": (hhi_concentration, "WITH h AS (SELECT s_nationkey, s_suppkey, sum(l_extendedprice) AS a FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL), q AS (SELECT s_nationkey, sum(a) AS t, sum(a * a) AS q, max(a) AS m FROM h GROUP BY 1) SELECT s_nationkey, round(q / (t * t), 6) AS hhi, round(t * t / q, 6) AS effective, round(m / t, 6) AS top_weight FROM q"),
    "var_parametric": (var_parametric, _DAILY + ", r AS (SELECT event_type, v / lag(v) OVER (PARTITION BY event_type ORDER BY day) - 1 AS ret FROM daily), s AS (SELECT event_type, CASE WHEN count(ret) < 3 THEN 0.02 ELSE stddev_samp(ret) END AS sd FROM r GROUP BY 1), w AS (SELECT event_type, sum(v) / (SELECT sum(v) FROM daily) AS weight FROM daily GROUP BY 1) SELECT round(sum(weight * sd) * 1.645 * 1000000, 2) AS var FROM w JOIN s USING (event_type)"),
    "reconcile_tolerance": (reconcile_tolerance, "SELECT o_orderstatus, count(*) AS compared, count(*) FILTER (WHERE abs(s - o_totalprice) <= abs(o_totalprice) * 0.1) AS within_tolerance FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS s FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey GROUP BY 1"),
    "mask_fields": (mask_fields, "SELECT c_custkey, 'sha256:' || sha256(c_name)[1:32] AS name, c_mktsegment[1] || repeat('*', length(c_mktsegment) - 1) AS segment, NULL::VARCHAR AS balance, '[REDACTED]' AS nation FROM customer"),
    "mask_nested": (mask_nested, "SELECT c_custkey, 'sha256:' || sha256(c_name)[1:32] AS name, c_mktsegment[1] || repeat('*', length(c_mktsegment) - 1) AS segment FROM customer"),
    "mask_tokens": (mask_tokens, None),
    "forbidden_mixture": (forbidden_mixture, "WITH t AS (SELECT user_id, list(DISTINCT event_type) AS t FROM events WHERE value > 25 GROUP BY 1), m AS (SELECT user_id, CASE WHEN list_has_all(t, ['purchase', 'error']) THEN 'error,purchase' WHEN list_has_all(t, ['signup', 'view']) THEN 'signup,view' END AS mixture FROM t) SELECT user_id, CASE WHEN mixture IS NULL THEN 'allow' ELSE 'deny' END AS verdict, mixture FROM m"),
    "policy_reasons": (policy_reasons, "SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'negative' END, CASE WHEN c_nationkey > 20 THEN 'far' END, CASE WHEN c_mktsegment = 'MACHINERY' THEN 'machinery' END) AS reasons FROM customer"),
    "weakest_warrant": (weakest_warrant, "SELECT o_custkey, CASE min(CASE o_orderstatus WHEN 'F' THEN 6 WHEN 'O' THEN 4 WHEN 'P' THEN 2 ELSE 1 END) WHEN 6 THEN 'verified' WHEN 4 THEN 'observed' WHEN 2 THEN 'hypothesis' ELSE 'unknown' END AS warrant FROM orders GROUP BY 1"),
    "leaderboard_rank": (leaderboard_rank, "WITH m AS (SELECT subject_kind, score_policy_id, round(avg(score), 6) AS mean_score, count(*) AS n FROM profile_scores WHERE score IS NOT NULL AND NOT isnan(score) GROUP BY ALL) SELECT *, rank() OVER (PARTITION BY subject_kind ORDER BY mean_score DESC) AS place FROM m"),
    "provenance_rollup": (provenance_rollup, "SELECT model_release_id, coalesce(string_agg(DISTINCT source_trust_class, ',' ORDER BY source_trust_class), '') AS trust_classes, min(freshness_days) AS freshest, max(freshness_days) AS stalest, sum(trial_count)::BIGINT AS trials, max(reproduced_by_us) AS reproduced, count(*) AS fact_count FROM metric_facts GROUP BY 1"),
    "provenance_order": (provenance_order, "SELECT metric_fact_id FROM (SELECT DISTINCT metric_fact_id, freshness_days, ts, sample_n FROM metric_facts) ORDER BY sample_n DESC NULLS LAST, freshness_days NULLS LAST, ts DESC, metric_fact_id LIMIT 200"),
    "balanced_accuracy": (balanced_accuracy, "WITH r AS (SELECT user_id, avg((value > 20)::INT) FILTER (WHERE event_type = 'error') AS p, avg((NOT value > 20)::INT) FILTER (WHERE event_type <> 'error') AS n FROM events GROUP BY 1) SELECT user_id, round(coalesce((p + n) / 2, p, n), 6) AS score FROM r"),
    "coding_f1": (coding_f1, "WITH f AS (SELECT DISTINCT l_orderkey AS k FROM lineitem WHERE l_returnflag = 'R'), g AS (SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F'), c AS (SELECT count(*) FILTER (WHERE f.k IS NOT NULL AND g.k IS NOT NULL) AS tp, count(*) FILTER (WHERE g.k IS NULL) AS fp, count(*) FILTER (WHERE f.k IS NULL) AS fn FROM f FULL JOIN g ON f.k = g.k) SELECT tp, fp, fn, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1 FROM c"),
    "clause_diff": (clause_diff, "WITH a AS (SELECT c_nationkey AS k, count(*) AS v FROM customer GROUP BY 1 HAVING k % 7 != 0), b AS (SELECT s_nationkey AS k, count(*) * 15 AS v FROM supplier GROUP BY 1 HAVING k % 4 != 0) SELECT coalesce(a.k, b.k) AS k, CASE WHEN b.k IS NULL THEN 'left_only' WHEN a.k IS NULL THEN 'right_only' WHEN a.v = b.v THEN 'shared' ELSE 'changed' END AS status FROM a FULL JOIN b ON a.k = b.k"),
    "federated_blend": (federated_blend, "WITH c AS (SELECT l_returnflag, 'Url/' || l_partkey AS url, count(*) AS score FROM lineitem GROUP BY ALL), r AS (SELECT url, CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 1 ELSE 2 END AS source_no, row_number() OVER (PARTITION BY l_returnflag ORDER BY score DESC, url)::INT AS rank_no FROM c) SELECT url, source_no, rank_no FROM r WHERE rank_no <= 8 QUALIFY row_number() OVER (PARTITION BY lower(url) ORDER BY source_no, rank_no) = 1"),
    "rate_limit": (rate_limit, """WITH RECURSIVE n AS (SELECT user_id, event_id, epoch_us(ts) / 1e6 AS s, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events),
b AS (SELECT user_id, event_id, s, i, true AS allowed, 2.0::DOUBLE AS level FROM n WHERE i = 1
UNION ALL SELECT n.user_id, n.event_id, n.s, n.i, least(3, b.level + (n.s - b.s) * (1.0 / 20000)) >= 1, least(3, b.level + (n.s - b.s) * (1.0 / 20000)) - CASE WHEN least(3, b.level + (n.s - b.s) * (1.0 / 20000)) >= 1 THEN 1 ELSE 0 END FROM b JOIN n ON n.user_id = b.user_id AND n.i = b.i + 1) SELECT event_id, allowed FROM b"""),
    "visit_rollup": (visit_rollup, "SELECT o_custkey, count(*) AS visits, min(o_orderdate) AS first_seen, max(o_orderdate) AS last_seen FROM orders GROUP BY 1"),
    "pair_interaction": (pair_interaction, "WITH h AS (SELECT DISTINCT l_orderkey, p_brand, regexp_extract(p_brand, '(\\d+)$', 1)::INT AS no FROM lineitem JOIN part ON l_partkey = p_partkey) SELECT least(a.p_brand, b.p_brand) AS brand_a, greatest(a.p_brand, b.p_brand) AS brand_b, count(*) AS orders_n FROM h a JOIN h b ON a.l_orderkey = b.l_orderkey AND b.no = a.no + 1 GROUP BY ALL"),
    "slo_p99_window": (slo_p99_window, "SELECT event_type, time_bucket(INTERVAL 5 MINUTE, ts) AS started, count(*) AS n, quantile_disc(value, 0.99) AS p99 FROM events GROUP BY ALL"),
    "receipts_verify": (receipts_verify, "WITH w AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, count(*) AS links, count(*) FILTER (WHERE p = 'signup') AS broken FROM w GROUP BY 1"),
}


def health_fold(spark, d):
    state = F.when(F.col("value") > 45, "down").when(F.col("value") > 1, "healthy").otherwise("unknown")
    e = load(spark, d, "events").withColumn("state", state)
    return e.groupBy("user_id", F.to_date("ts").alias("day")).agg(mart.health(F.col("state")).alias("health"), mart.worst(F.col("state"), ("unknown", "healthy", "down")).alias("worst"))


def composite_score(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", F.round(mart.composite({"p_size": 0.6, "p_retailprice": 0.01}, [F.col("p_type") != "ECONOMY"]), 4).alias("score"))


def cap_weights(spark, d):
    s = load(spark, d, "supplier").filter("s_acctbal > 0")
    return mart.cap_weights(s, ["s_nationkey"], "s_suppkey", "s_acctbal", 0.3).select("s_nationkey", "s_suppkey", F.round("weight", 6).alias("weight"), F.round("trim", 4).alias("trim"))


def reference_lookup(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    ref = s.select(F.col("s_nationkey").alias("c_nationkey"), "s_suppkey", "s_acctbal").filter("s_suppkey % 3 = 0")
    return mart.lookup(c.select("c_custkey", "c_nationkey"), ref, ["c_nationkey"], ["s_suppkey"], "s_acctbal")


def route_by_gap(spark, d):
    from weftline.operators import search

    e = load(spark, d, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("c"))
    share = e.withColumn("score", F.round(F.col("c") / F.sum("c").over(Window.partitionBy("user_id")), 9))
    return search.route(share, ["user_id"], "event_type", "score", 0.05, 0.25)


QUERIES |= {
    "health_fold": (health_fold, "WITH s AS (SELECT user_id, ts::DATE AS day, CASE WHEN value > 45 THEN 'down' WHEN value > 1 THEN 'healthy' ELSE 'unknown' END AS s FROM events) SELECT user_id, day, CASE WHEN count(*) FILTER (WHERE s <> 'unknown') = 0 THEN 'unknown' WHEN count(*) FILTER (WHERE s = 'down') = count(*) FILTER (WHERE s <> 'unknown') THEN 'down' WHEN count(*) FILTER (WHERE s = 'healthy') = count(*) THEN 'healthy' ELSE 'degraded' END AS health, CASE WHEN bool_or(s = 'down') THEN 'down' WHEN bool_or(s = 'healthy') THEN 'healthy' ELSE 'unknown' END AS worst FROM s GROUP BY ALL"),
    "composite_score": (composite_score, "SELECT p_partkey, round(CASE WHEN p_type <> 'ECONOMY' THEN p_size * 0.6 + p_retailprice * 0.01 ELSE 0 END, 4) AS score FROM part"),
    "cap_weights": (cap_weights, "WITH t AS (SELECT *, sum(s_acctbal) OVER (PARTITION BY s_nationkey) AS t FROM supplier WHERE s_acctbal > 0) SELECT s_nationkey, s_suppkey, round(s_acctbal / t, 6) AS weight, round(CASE WHEN s_acctbal / t > 0.3 THEN s_acctbal - 0.3 * t ELSE 0 END, 4) AS trim FROM t"),
    "reference_lookup": (reference_lookup, "SELECT c_custkey, c_nationkey, r.v AS reference_value FROM customer LEFT JOIN (SELECT s_nationkey, arg_min(s_acctbal, s_suppkey) AS v FROM supplier WHERE s_suppkey % 3 = 0 GROUP BY 1) r ON c_nationkey = s_nationkey"),
    "route_by_gap": (route_by_gap, "WITH n AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY 1, 2), c AS (SELECT user_id, event_type, round(c / sum(c) OVER (PARTITION BY user_id), 9) AS s FROM n), r AS (SELECT *, row_number() OVER w AS k, lead(s) OVER w AS nxt FROM c WINDOW w AS (PARTITION BY user_id ORDER BY s DESC, event_type)) SELECT user_id, event_type, CASE WHEN s < 0.25 THEN 'abstain' WHEN s - coalesce(nxt, 0) >= 0.05 THEN 'route' ELSE 'pick' END AS decision FROM r WHERE k = 1"),
}
