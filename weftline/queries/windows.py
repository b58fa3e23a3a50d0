"""Ranks, lags, rolling windows, sessions, as-of joins, bars and backtests."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import relational as rel
from weftline.operators import windows as win
from weftline.session import load


def win_rank_ties(spark, d):
    p = load(spark, d, "part")
    return p.select("p_partkey", "p_brand", F.rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("place"), F.dense_rank().over(Window.partitionBy("p_brand").orderBy(F.desc("p_size"))).alias("dense_place"))


def win_topk_per_key(spark, d):
    o = load(spark, d, "orders")
    w = Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey")
    return o.withColumn("place", F.row_number().over(w)).filter("place <= 3").select("o_custkey", "o_orderkey", "place")


def win_margin_best_second(spark, d):
    o = load(spark, d, "orders")
    return win.best_margin(o, ["o_custkey"], "o_orderkey", "o_totalprice").select("o_custkey", "o_orderkey", F.round("margin", 2).alias("margin"))


def _events(spark, d):
    return load(spark, d, "events")


def win_lag_return(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    e = _events(spark, d).withColumn("prev", F.lag("value").over(w))
    return e.select("event_id", F.round(F.when(F.col("prev") != 0, F.col("value") / F.col("prev") - 1), 6).alias("ret"))


def win_moving_avg(spark, d):
    return _events(spark, d).select("event_id", F.round(win.moving_average("value", ["user_id"], ["ts", "event_id"], 5), 6).alias("avg5"))


def win_rolling_std(spark, d):
    return _events(spark, d).select("event_id", F.round(win.rolling_std("value", ["user_id"], ["ts", "event_id"], 5), 5).alias("std5"))


def win_running_max_drawdown(spark, d):
    e = win.drawdown(_events(spark, d).withColumn("level", F.col("value") + 1), ["user_id"], ["ts", "event_id"], "level", slice_=win.time_slice("ts", 86_400))
    return e.groupBy("user_id").agg(F.round(F.min("drawdown"), 6).alias("max_drawdown"))


def win_cumprod(spark, d):
    e = _events(spark, d).withColumn("factor", 1 + F.col("value") / 10000)
    held = win.cumulative_product(e, ["user_id"], ["ts", "event_id"], "factor", "product", win.time_slice("ts", 86_400))
    return held.select("event_id", F.round("product", 6).alias("product"))


def win_hysteresis(spark, d):
    return win.hysteresis(_events(spark, d), ["user_id"], ["ts", "event_id"], "value", 5.0, 40.0, slice_=win.time_slice("ts", 86_400)).select("event_id", "holding")


def win_session_gap(spark, d):
    return rel.sessions(_events(spark, d), "user_id", "ts", 6 * 3600, "event_id", slice_seconds=86_400).select("user_id", F.col("session_no").cast("int").alias("session_no"), "started", "ended", "n")


def win_asof(spark, d):
    e = _events(spark, d)
    buys = e.filter("event_type = 'purchase'").select("user_id", "ts", "event_id")
    views = e.filter("event_type = 'view'").select("user_id", "ts", F.col("event_id").alias("view_id"))
    return rel.asof_join(buys, views, ["user_id"], "ts", ["view_id"], slice_seconds=86_400).select("event_id", "view_id")


def win_trend_band(spark, d):
    """Change over three bars, graded against a flat band of 2 %."""
    w = Window.partitionBy("event_type").orderBy("day")
    b = _bars(spark, d).withColumn("change", F.col("close") / F.lag("close", 2).over(w) - 1)
    return b.select("event_type", "day", F.when(F.col("change").isNull(), "unknown").when(F.col("change") > 0.02, "up").when(F.col("change") < -0.02, "down").otherwise("flat").alias("band"))


def win_gap_fill(spark, d):
    """The last known non-zero value before each event of a user (authority fill)."""
    upto = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return _events(spark, d).select("event_id", F.last(F.when(F.col("value") > 20, F.col("value")), ignorenulls=True).over(upto).alias("filled"))


def _bars(spark, d):
    return win.bars(_events(spark, d), "event_type", "ts", "value", "event_id")


def ts_bars(spark, d):
    return _bars(spark, d).withColumn("volume", F.round("volume", 2))


def _prices(spark, d):
    return _bars(spark, d).select(F.col("event_type").alias("symbol"), "day", (F.col("volume") + 1).alias("close"))


def ts_rsi(spark, d):
    return win.wilder_rsi(_prices(spark, d), "symbol", "day", "close").select("symbol", "day", F.round("rsi", 4).alias("rsi"))


def _curve(spark, d, strategy, **p):
    prices = _prices(spark, d)
    curve = win.backtest(prices, win.strategy_weights(prices, strategy, **p))
    return curve.withColumn("_first", F.when(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("day")) == 1, 1).otherwise(0))  # one row per calendar day


def ts_backtest_trend(spark, d):
    return win.backtest_metrics(_curve(spark, d, "trend"))


def ts_backtest_momentum(spark, d):
    return win.backtest_metrics(_curve(spark, d, "momentum"))


def ts_backtest_mean_reversion(spark, d):
    return win.backtest_metrics(_curve(spark, d, "mean_reversion", period=5))


def ts_backtest_market_neutral(spark, d):
    return _curve(spark, d, "market_neutral").select("day", F.round("ret", 6).alias("ret"), F.round("equity", 4).alias("equity"))


_W = "OVER (PARTITION BY user_id ORDER BY ts, event_id"
_PRICES = "b AS (SELECT event_type AS symbol, ts::DATE AS day, sum(value) + 1 AS close FROM events GROUP BY ALL)"
_METRICS = """,
held AS (SELECT b.symbol, b.day, close / lag(close) OVER (PARTITION BY b.symbol ORDER BY b.day) - 1 AS r, lag(weight) OVER (PARTITION BY b.symbol ORDER BY b.day) AS h FROM b JOIN wts USING (symbol, day)),
daily AS (SELECT day, sum(coalesce(h * r, 0)) AS ret FROM held GROUP BY day),
eq AS (SELECT day, ret, CASE WHEN min(1 + ret) OVER (ORDER BY day) > 0 THEN 100 * exp(sum(ln(1 + ret)) OVER (ORDER BY day)) END AS equity, row_number() OVER (ORDER BY day) AS rn FROM daily),
dd AS (SELECT *, equity / max(equity) OVER (ORDER BY day) - 1 AS drawdown FROM eq)
"""
_SUMMARY = _METRICS + """SELECT round(arg_max(equity, day) / arg_min(equity, day) - 1, 4) AS total_return, round(pow(arg_max(equity, day) / arg_min(equity, day), 252.0 / count(*)) - 1, 4) AS cagr,
  round(CASE WHEN stddev_pop(ret) FILTER (WHERE rn > 1) > 0 THEN avg(ret) FILTER (WHERE rn > 1) / stddev_pop(ret) FILTER (WHERE rn > 1) * sqrt(252) ELSE 0 END, 2) AS sharpe,
  round(min(drawdown), 4) AS max_drawdown, round(avg((ret > 0)::INT) FILTER (WHERE rn > 1), 4) AS win_rate, round(stddev_pop(ret) FILTER (WHERE rn > 1) * sqrt(252), 4) AS vol FROM dd"""

QUERIES = {
    "win_rank_ties": (win_rank_ties, "SELECT p_partkey, p_brand, rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS place, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size DESC) AS dense_place FROM part"),
    "win_topk_per_key": (win_topk_per_key, "SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS place FROM orders QUALIFY place <= 3"),
    "win_margin_best_second": (win_margin_best_second, "WITH r AS (SELECT o_custkey, o_orderkey, o_totalprice, row_number() OVER w AS rn, lead(o_totalprice) OVER w AS nxt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) SELECT o_custkey, o_orderkey, round(o_totalprice - coalesce(nxt, 0), 2) AS margin FROM r WHERE rn = 1"),
    "win_lag_return": (win_lag_return, f"SELECT event_id, round(CASE WHEN lag(value) {_W}) != 0 THEN value / lag(value) {_W}) - 1 END, 6) AS ret FROM events"),
    "win_moving_avg": (win_moving_avg, f"SELECT event_id, round(CASE WHEN count(*) {_W} ROWS 4 PRECEDING) = 5 THEN avg(value) {_W} ROWS 4 PRECEDING) END, 6) AS avg5 FROM events"),
    "win_rolling_std": (win_rolling_std, f"SELECT event_id, round(CASE WHEN count(*) {_W} ROWS 4 PRECEDING) = 5 THEN stddev_pop(value) {_W} ROWS 4 PRECEDING) END, 5) AS std5 FROM events"),
    "win_running_max_drawdown": (win_running_max_drawdown, f"SELECT user_id, round(min(dd), 6) AS max_drawdown FROM (SELECT user_id, (value + 1) / max(value + 1) {_W}) - 1 AS dd FROM events) GROUP BY 1"),
    "win_cumprod": (win_cumprod, f"SELECT event_id, round(exp(sum(ln(1 + value / 10000)) {_W})), 6) AS product FROM events"),
    "win_hysteresis": (win_hysteresis, f"SELECT event_id, coalesce(last_value(CASE WHEN value < 5 THEN true WHEN value > 40 THEN false END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING), false) AS holding FROM events"),
    "win_session_gap": (win_session_gap, f"WITH m AS (SELECT *, CASE WHEN lag(ts) {_W}) IS NULL OR ts - lag(ts) {_W}) > INTERVAL 6 HOUR THEN 1 ELSE 0 END AS new FROM events), s AS (SELECT *, sum(new) {_W})::INT AS session_no FROM m) SELECT user_id, session_no, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM s GROUP BY ALL"),
    "win_asof": (win_asof, "WITH v AS (SELECT user_id, ts, max(event_id) AS view_id FROM events WHERE event_type = 'view' GROUP BY ALL) SELECT p.event_id, v.view_id FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN v ON p.user_id = v.user_id AND p.ts >= v.ts"),
    "win_trend_band": (win_trend_band, "WITH b AS (SELECT event_type, ts::DATE AS day, arg_max(value, (ts, event_id)) AS close FROM events GROUP BY ALL), c AS (SELECT *, close / lag(close, 2) OVER (PARTITION BY event_type ORDER BY day) - 1 AS ch FROM b) SELECT event_type, day, CASE WHEN ch IS NULL THEN 'unknown' WHEN ch > 0.02 THEN 'up' WHEN ch < -0.02 THEN 'down' ELSE 'flat' END AS band FROM c"),
    "win_gap_fill": (win_gap_fill, f"SELECT event_id, last_value(CASE WHEN value > 20 THEN value END IGNORE NULLS) {_W} ROWS UNBOUNDED PRECEDING) AS filled FROM events"),
    "ts_bars": (ts_bars, "SELECT event_type, ts::DATE AS day, arg_min(value, (ts, event_id)) AS open, max(value) AS high, min(value) AS low, arg_max(value, (ts, event_id)) AS close, round(sum(value), 2) AS volume FROM events GROUP BY ALL"),
    "ts_rsi": (ts_rsi, f"""WITH RECURSIVE {_PRICES}, n AS (SELECT symbol, day, close, row_number() OVER w AS i, close - lag(close, 1, close) OVER w AS step FROM b WINDOW w AS (PARTITION BY symbol ORDER BY day)),
r AS (SELECT symbol, day, i, greatest(step, 0) / 14 AS g, greatest(-step, 0) / 14 AS l FROM n WHERE i = 1 UNION ALL SELECT n.symbol, n.day, n.i, (r.g * 13 + greatest(n.step, 0)) / 14, (r.l * 13 + greatest(-n.step, 0)) / 14 FROM r JOIN n ON n.symbol = r.symbol AND n.i = r.i + 1)
SELECT symbol, day, round(100 - 100 / (1 + CASE WHEN l > 0 THEN g / l ELSE 0 END), 4) AS rsi FROM r"""),
    "ts_backtest_trend": (ts_backtest_trend, f"""WITH {_PRICES}, s AS (SELECT symbol, day, CASE WHEN count(*) OVER w10 = 10 AND avg(close) OVER w5 > avg(close) OVER w10 THEN 1.0 ELSE 0.0 END AS w FROM b
WINDOW w5 AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING), w10 AS (PARTITION BY symbol ORDER BY day ROWS 9 PRECEDING)), wts AS (SELECT symbol, day, CASE WHEN sum(w) OVER (PARTITION BY day) > 0 THEN w / sum(w) OVER (PARTITION BY day) ELSE 0 END AS weight FROM s)""" + _SUMMARY),
    "ts_backtest_momentum": (ts_backtest_momentum, f"""WITH {_PRICES}, s AS (SELECT symbol, day, coalesce(greatest(close / lag(close, 5) OVER (PARTITION BY symbol ORDER BY day) - 1, 0), 0) AS w FROM b),
wts AS (SELECT symbol, day, CASE WHEN sum(w) OVER (PARTITION BY day) > 0 THEN w / sum(w) OVER (PARTITION BY day) ELSE 0 END AS weight FROM s)""" + _SUMMARY),
    "ts_backtest_mean_reversion": (ts_backtest_mean_reversion, None),
    "ts_backtest_market_neutral": (ts_backtest_market_neutral, f"""WITH {_PRICES}, r AS (SELECT symbol, day, coalesce(close / lag(close) OVER (PARTITION BY symbol ORDER BY day) - 1, 0) AS ret FROM b),
v AS (SELECT symbol, day, stddev_pop(ret) OVER w AS vol, count(*) OVER w AS n FROM r WINDOW w AS (PARTITION BY symbol ORDER BY day ROWS 4 PRECEDING)),
k AS (SELECT symbol, day, row_number() OVER (PARTITION BY day ORDER BY vol, symbol) AS k, count(*) OVER (PARTITION BY day) AS n FROM v WHERE n = 5),
wts AS (SELECT symbol, day, CASE WHEN k > n - greatest(1, n // 2) THEN -0.5 / greatest(1, n // 2) WHEN k <= greatest(1, n // 2) THEN 0.5 / greatest(1, n // 2) ELSE 0 END AS weight FROM k)""" + _METRICS + "SELECT day, round(ret, 6) AS ret, round(equity, 4) AS equity FROM dd"),
}
