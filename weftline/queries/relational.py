"""Joins, aggregates, set operations and top-k over the star schema."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import relational as rel
from weftline.session import load



def money(c):
    return F.round(F.sum(c), 2)


def rel_join_inner(spark, d):
    o, c, n = load(spark, d, "orders", "customer", "nation")
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey)
    return j.groupBy("n_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("order_count"), F.countDistinct("c_custkey").alias("customer_count"), money("o_totalprice").alias("revenue"))


def rel_join_left(spark, d):
    c, o = load(spark, d, "customer", "orders")
    big = o.filter(F.col("o_totalprice") > 400000)
    return c.join(big, c.c_custkey == big.o_custkey, "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("big_orders"))


def rel_join_semi(spark, d):
    c, o = load(spark, d, "customer", "orders")
    return c.join(o.filter("o_orderstatus = 'P'"), c.c_custkey == o.o_custkey, "left_semi").select("c_custkey", "c_name")


def rel_join_anti(spark, d):
    p, i = load(spark, d, "part", "lineitem")
    return p.join(i.filter("l_quantity >= 45 and l_returnflag = 'R'"), p.p_partkey == i.l_partkey, "left_anti").select("p_partkey", "p_brand")


def rel_join_full(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    a = c.groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("customers")).filter("c_nationkey % 5 != 0")
    b = s.groupBy("s_nationkey").agg(F.count(F.lit(1)).alias("suppliers")).filter("s_nationkey % 3 != 0")
    return a.join(b, a.c_nationkey == b.s_nationkey, "full_outer").select(F.coalesce("c_nationkey", "s_nationkey").alias("nationkey"), "customers", "suppliers")


def rel_join_band(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    sums = i.groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_extendedprice").alias("line_total"))
    return rel.band_join(o.select("o_orderkey", "o_totalprice"), sums, ["o_orderkey"], "line_total", "o_totalprice", 0.25).select("o_orderkey", "o_totalprice", F.round("line_total", 2).alias("line_total"))


def rel_join_range(spark, d):
    o, p = load(spark, d, "orders", "part")
    bands = p.groupBy("p_size").agg(F.min("p_retailprice").alias("lo"), F.max("p_retailprice").alias("hi")).select("p_size", (F.col("lo") * 100).alias("lo"), (F.col("lo") * 100 + 500).alias("hi"))
    return rel.range_join(o.select("o_orderkey", "o_totalprice"), bands, "o_totalprice", "lo", "hi", 1000.0).select("o_orderkey", "p_size")


def rel_join_snapshot_rollup(spark, d):
    s, n, i = load(spark, d, "supplier", "nation", "lineitem")
    returned = i.filter("l_returnflag = 'R'").select("l_suppkey", "l_orderkey")
    j = s.join(n, s.s_nationkey == n.n_nationkey).join(returned, s.s_suppkey == returned.l_suppkey, "left")
    return j.groupBy("s_suppkey", "n_name").agg(F.count("l_orderkey").alias("returned_lines"))


def rel_agg_basic(spark, d):
    i = load(spark, d, "lineitem")
    return i.groupBy("l_returnflag", "l_linestatus").agg(
        money("l_quantity").alias("sum_qty"), F.round(F.avg("l_extendedprice"), 4).alias("avg_price"), F.min("l_shipdate").alias("first_ship"),
        F.max("l_shipdate").alias("last_ship"), money(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("revenue"), F.count(F.lit(1)).alias("line_count"),
    )


def rel_agg_distinct(spark, d):
    i = load(spark, d, "lineitem")
    return i.groupBy("l_suppkey").agg(F.countDistinct("l_partkey").alias("parts"), F.array_join(F.array_sort(F.collect_set("l_returnflag")), ",").alias("flags"))


def rel_agg_conditional(spark, d):
    o = load(spark, d, "orders")
    return o.groupBy("o_orderpriority").agg(
        F.count_if(F.col("o_orderstatus") == "F").alias("filled"), F.count_if(F.col("o_orderstatus") == "O").alias("open"), F.round(F.avg((F.col("o_orderstatus") == "F").cast("double")), 6).alias("fill_rate")
    )


def _three(spark, d):
    o, c = load(spark, d, "orders", "customer")
    return o.join(c, o.o_custkey == c.c_custkey).select("c_mktsegment", "o_orderstatus", F.year("o_orderdate").alias("o_year"), "o_totalprice")


_THREE = "WITH t AS (SELECT c_mktsegment, o_orderstatus, year(o_orderdate) AS o_year, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey) SELECT "


def rel_cube(spark, d):
    return _three(spark, d).cube("c_mktsegment", "o_orderstatus").agg(F.count(F.lit(1)).alias("order_count"), money("o_totalprice").alias("revenue"), F.grouping_id().cast("int").alias("level"))


def rel_rollup(spark, d):
    return _three(spark, d).rollup("c_mktsegment", "o_year").agg(F.count(F.lit(1)).alias("order_count"), money("o_totalprice").alias("revenue"))


def rel_grouping_sets(spark, d):
    return _three(spark, d).groupingSets([["c_mktsegment"], ["o_year", "o_orderstatus"], []], "c_mktsegment", "o_year", "o_orderstatus").agg(F.count(F.lit(1)).alias("order_count"))


def rel_pivot(spark, d):
    return _three(spark, d).groupBy("o_year").pivot("o_orderstatus", ["F", "O", "P"]).agg(F.count(F.lit(1))).na.fill(0).select("o_year", F.col("F").alias("f_count"), F.col("O").alias("o_count"), F.col("P").alias("p_count"))


def rel_unpivot(spark, d):
    i = load(spark, d, "lineitem").groupBy("l_returnflag").agg(money("l_quantity").alias("quantity"), money("l_tax").alias("tax"))
    return i.unpivot("l_returnflag", ["quantity", "tax"], "measure", "amount")


def rel_union(spark, d):
    c, s = load(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("nationkey"), F.lit("customer").alias("role")).unionByName(s.select(F.col("s_nationkey").alias("nationkey"), F.lit("supplier").alias("role"))).distinct()


def rel_intersect(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    return o.filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("k")).intersect(i.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("k")))


def rel_except(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    return o.select(F.col("o_orderkey").alias("k")).subtract(i.filter("l_discount > 0.03").select(F.col("l_orderkey").alias("k")))


def rel_topk_tiebreak(spark, d):
    return load(spark, d, "lineitem").orderBy(F.desc("l_quantity"), F.desc("l_extendedprice"), "l_orderkey", "l_partkey", "l_linenumber", "l_suppkey").limit(100).select("l_orderkey", "l_linenumber", "l_quantity", "l_extendedprice")


def rel_argmax_join(spark, d):
    o = load(spark, d, "orders")
    return rel.latest_by(o, ["o_custkey"], [F.desc("o_totalprice"), F.asc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


def rel_sql_submit(spark, d):
    """Any Spark SQL over tables registered for this call alone: names are private, so no other call sees them."""
    from weftline.plans.submit import submit_sql

    o, c = load(spark, d, "orders", "customer")
    text = "SELECT c_mktsegment, count(*) AS order_count, round(avg(o_totalprice), 4) AS avg_total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment"
    return submit_sql(spark, text, {"orders": o, "customer": c})


def rel_distinct_sketch(spark, d):
    """Approximate distinct counts from mergeable sketches of days, against the exact count: whether within 5 %."""
    e = load(spark, d, "events")
    daily = e.groupBy("event_type", F.to_date("ts").alias("day")).agg(F.expr("hll_sketch_agg(user_id, 14)").alias("s"))
    merged = daily.groupBy("event_type").agg(F.expr("hll_sketch_estimate(hll_union_agg(s))").alias("estimate"))
    exact = e.groupBy("event_type").agg(F.countDistinct("user_id").alias("users"))
    return exact.join(merged, "event_type").select("event_type", "users", (F.abs(F.col("estimate") - F.col("users")) <= 0.05 * F.col("users") + 1).alias("within_bound"))


QUERIES = {
    "rel_join_inner": (rel_join_inner, "SELECT n_name, o_orderpriority, count(*) AS order_count, count(DISTINCT c_custkey) AS customer_count, round(sum(o_totalprice), 2) AS revenue FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL"),
    "rel_join_left": (rel_join_left, "SELECT c_custkey, count(o_orderkey) AS big_orders FROM customer LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 400000) ON c_custkey = o_custkey GROUP BY ALL"),
    "rel_join_semi": (rel_join_semi, "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')"),
    "rel_join_anti": (rel_join_anti, "SELECT p_partkey, p_brand FROM part WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_partkey = p_partkey AND l_quantity >= 45 AND l_returnflag = 'R')"),
    "rel_join_full": (rel_join_full, "SELECT coalesce(c_nationkey, s_nationkey) AS nationkey, customers, suppliers FROM (SELECT c_nationkey, count(*) AS customers FROM customer GROUP BY 1 HAVING c_nationkey % 5 != 0) FULL JOIN (SELECT s_nationkey, count(*) AS suppliers FROM supplier GROUP BY 1 HAVING s_nationkey % 3 != 0) ON c_nationkey = s_nationkey"),
    "rel_join_band": (rel_join_band, "SELECT o_orderkey, o_totalprice, round(line_total, 2) AS line_total FROM orders JOIN (SELECT l_orderkey, sum(l_extendedprice) AS line_total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey WHERE abs(line_total - o_totalprice) <= abs(o_totalprice) * 0.25"),
    "rel_join_range": (rel_join_range, "SELECT o_orderkey, p_size FROM orders JOIN (SELECT p_size, min(p_retailprice) * 100 AS lo, min(p_retailprice) * 100 + 500 AS hi FROM part GROUP BY 1) ON o_totalprice >= lo AND o_totalprice < hi"),
    "rel_join_snapshot_rollup": (rel_join_snapshot_rollup, "SELECT s_suppkey, n_name, count(l_orderkey) AS returned_lines FROM supplier JOIN nation ON s_nationkey = n_nationkey LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag = 'R') ON s_suppkey = l_suppkey GROUP BY ALL"),
    "rel_agg_basic": (rel_agg_basic, "SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_extendedprice), 4) AS avg_price, min(l_shipdate) AS first_ship, max(l_shipdate) AS last_ship, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, count(*) AS line_count FROM lineitem GROUP BY ALL"),
    "rel_agg_distinct": (rel_agg_distinct, "SELECT l_suppkey, count(DISTINCT l_partkey) AS parts, string_agg(DISTINCT l_returnflag, ',' ORDER BY l_returnflag) AS flags FROM lineitem GROUP BY 1"),
    "rel_agg_conditional": (rel_agg_conditional, "SELECT o_orderpriority, count(*) FILTER (WHERE o_orderstatus = 'F') AS filled, count(*) FILTER (WHERE o_orderstatus = 'O') AS open, round(avg((o_orderstatus = 'F')::INT), 6) AS fill_rate FROM orders GROUP BY 1"),
    "rel_cube": (rel_cube, _THREE + "c_mktsegment, o_orderstatus, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue, grouping_id(c_mktsegment, o_orderstatus)::INT AS level FROM t GROUP BY CUBE (c_mktsegment, o_orderstatus)"),
    "rel_rollup": (rel_rollup, _THREE + "c_mktsegment, o_year, count(*) AS order_count, round(sum(o_totalprice), 2) AS revenue FROM t GROUP BY ROLLUP (c_mktsegment, o_year)"),
    "rel_grouping_sets": (rel_grouping_sets, _THREE + "c_mktsegment, o_year, o_orderstatus, count(*) AS order_count FROM t GROUP BY GROUPING SETS ((c_mktsegment), (o_year, o_orderstatus), ())"),
    "rel_pivot": (rel_pivot, _THREE + "o_year, count(*) FILTER (WHERE o_orderstatus = 'F') AS f_count, count(*) FILTER (WHERE o_orderstatus = 'O') AS o_count, count(*) FILTER (WHERE o_orderstatus = 'P') AS p_count FROM t GROUP BY 1"),
    "rel_unpivot": (rel_unpivot, "SELECT l_returnflag, 'quantity' AS measure, round(sum(l_quantity), 2) AS amount FROM lineitem GROUP BY 1 UNION ALL SELECT l_returnflag, 'tax', round(sum(l_tax), 2) FROM lineitem GROUP BY 1"),
    "rel_union": (rel_union, "SELECT c_nationkey AS nationkey, 'customer' AS role FROM customer UNION SELECT s_nationkey, 'supplier' FROM supplier"),
    "rel_intersect": (rel_intersect, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R'"),
    "rel_except": (rel_except, "SELECT o_orderkey AS k FROM orders EXCEPT SELECT l_orderkey FROM lineitem WHERE l_discount > 0.03"),
    "rel_topk_tiebreak": (rel_topk_tiebreak, "SELECT l_orderkey, l_linenumber, l_quantity, l_extendedprice FROM lineitem ORDER BY l_quantity DESC, l_extendedprice DESC, l_orderkey, l_partkey, l_linenumber, l_suppkey LIMIT 100"),
    "rel_argmax_join": (rel_argmax_join, "SELECT o_custkey, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "rel_sql_submit": (rel_sql_submit, "SELECT c_mktsegment, count(*) AS order_count, round(avg(o_totalprice), 4) AS avg_total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'P' GROUP BY c_mktsegment"),
    "rel_distinct_sketch": (rel_distinct_sketch, "SELECT event_type, count(DISTINCT user_id) AS users, true AS within_bound FROM events GROUP BY 1"),
}
