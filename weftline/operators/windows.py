"""Window operators over ordered series.  Every order is total, so results don't depend on partitioning."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_margin(df: DataFrame, keys: list[str], item: str, score: str) -> DataFrame:
    """keys, item, score, margin: the best item of each key and its lead over the second (its score if alone).

    Equal scores go by ascending item, which leaves a margin of 0.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))
    held = df.withColumn("_rn", F.row_number().over(w)).filter("_rn <= 2").withColumn("_second", F.lead(score).over(w))
    return held.filter("_rn = 1").select(*keys, item, score, (F.col(score) - F.coalesce("_second", F.lit(0.0))).alias("margin"))


def moving_average(value: str, keys: list[str], order: list, width: int) -> Column:
    """Mean of the last ``width`` rows of a key; null until there are that many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == width, F.avg(value).over(w))


def rolling_std(value: str, keys: list[str], order: list, width: int) -> Column:
    """Population standard deviation of the last ``width`` rows; null until there are that many."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(-(width - 1), 0)
    return F.when(F.count(F.lit(1)).over(w) == width, F.stddev_pop(value).over(w))


def time_slice(time: str, seconds: int) -> Column:
    """The number of the stretch of time that a timestamp lies in: a slice for the running operators below."""
    return F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (seconds * 1_000_000))


def _running(df: DataFrame, keys: list[str], order: list, slice_: Column | None, parts: dict[str, tuple]) -> DataFrame:
    """df with a running value per name of ``parts``, up to each row.

    parts: name -> (value over a window, value of a slice as an aggregate, values of the slices
    before over a window, (own, carried) -> value).  With a slice (a number that never falls
    along the order) the windows run over one slice of a key, and what the slices before come
    to, one row each, is carried in: a key that holds a third of all rows is spread over its
    slices.  Without one, over the whole key.
    """
    whole = [Window.unboundedPreceding, Window.currentRow]
    if slice_ is None:
        upto = Window.partitionBy(*keys).orderBy(*order).rowsBetween(*whole)
        return df.select("*", *[own(upto).alias(name) for name, (own, _, _, _) in parts.items()])
    marked = df.withColumn("_slice", slice_)
    within = [*keys, "_slice"]
    upto = Window.partitionBy(*within).orderBy(*order).rowsBetween(*whole)
    ends = marked.groupBy(*within).agg(*[total.alias(f"_e_{name}") for name, (_, total, _, _) in parts.items()])
    before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(within)], *[over(F.col(f"_e_{name}"), before).alias(f"_c_{name}") for name, (_, _, over, _) in parts.items()])
    same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(within)]
    held = marked.select("*", *[own(upto).alias(f"_o_{name}") for name, (own, _, _, _) in parts.items()]).join(carried, same, "left")
    return held.select(*df.columns, *[merge(F.col(f"_o_{name}"), F.col(f"_c_{name}")).alias(name) for name, (_, _, _, merge) in parts.items()])


def hysteresis(df: DataFrame, keys: list[str], order: list, value: str, enter: float, leave: float, state: str = "holding", slice_: Column | None = None) -> DataFrame:
    """A state that switches on below ``enter`` and off above ``leave`` and else stays; off at first.  slice_: see ``time_slice``."""
    switch = F.when(F.col(value) < enter, F.lit(True)).when(F.col(value) > leave, F.lit(False))
    last = F.max_by(switch, F.when(switch.isNotNull(), F.struct(*order)))
    part = (lambda w: F.last(switch, ignorenulls=True).over(w), last, lambda e, w: F.last(e, ignorenulls=True).over(w), lambda own, held: F.coalesce(own, held))
    return _running(df, keys, order, slice_, {state: part}).withColumn(state, F.coalesce(state, F.lit(False)))


def drawdown(df: DataFrame, keys: list[str], order: list, level: str, name: str = "drawdown", slice_: Column | None = None) -> DataFrame:
    """How far each value lies below the highest value so far, as a (non-positive) share of that.  slice_: see ``time_slice``."""
    part = (lambda w: F.max(level).over(w), F.max(level), lambda e, w: F.max(e).over(w), lambda own, held: F.greatest(own, held))
    return _running(df, keys, order, slice_, {"_top": part}).withColumn(name, F.col(level) / F.col("_top") - 1).drop("_top")


def cumulative_product(df: DataFrame, keys: list[str], order: list, factor: str, name: str, slice_: Column | None = None) -> DataFrame:
    """Running product of positive factors, by logs; null once a factor is not positive.  slice_: see ``time_slice``."""
    logs = F.when(F.col(factor) > 0, F.log(F.when(F.col(factor) > 0, F.col(factor))))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    parts = {
        "_log": (lambda w: F.sum(logs).over(w), F.sum(logs), lambda e, w: F.sum(e).over(w), lambda own, held: zero(own) + zero(held)),
        "_low": (lambda w: F.min(factor).over(w), F.min(factor), lambda e, w: F.min(e).over(w), lambda own, held: F.least(own, held)),
    }
    return _running(df, keys, order, slice_, parts).withColumn(name, F.when(F.col("_low") > 0, F.exp("_log"))).drop("_log", "_low")


def wilder_rsi(df: DataFrame, key: str, order: str, value: str, period: int = 14) -> DataFrame:
    """key, order, value, rsi: relative strength with Wilder's smoothing, started at zero.

    The smoothed gain g_t = ((period-1) g_{t-1} + up_t)/period is a weighted sum of all
    earlier gains; it is computed per series in one vectorised pass (a series of bars is
    bounded by its calendar, not by the data).
    """
    schema = f"`{key}` {df.schema[key].dataType.simpleString()}, `{order}` {df.schema[order].dataType.simpleString()}, `{value}` double, rsi double"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order)
        step = pdf[value].diff().fillna(0.0)
        ewm = dict(alpha=1 / period, adjust=False)
        gain = pd.concat([pd.Series([0.0]), step.clip(lower=0)]).ewm(**ewm).mean().iloc[1:].to_numpy()
        loss = pd.concat([pd.Series([0.0]), (-step).clip(lower=0)]).ewm(**ewm).mean().iloc[1:].to_numpy()
        strength = pd.Series(gain).where(loss > 0, 0.0) / pd.Series(loss).where(loss > 0, 1.0)
        return pdf.assign(rsi=(100 - 100 / (1 + strength)).to_numpy())[[key, order, value, "rsi"]]

    return df.select(key, order, F.col(value).cast("double").alias(value)).groupBy(key).applyInPandas(run, schema)


def bars(df: DataFrame, key: str, time: str, value: str, tie: str) -> DataFrame:
    """key, day, open, high, low, close, volume: daily bars; open and close go by time, then ``tie``."""
    first, last = F.struct(time, tie), F.struct(time, tie)
    return df.groupBy(key, F.to_date(time).alias("day")).agg(
        F.min_by(value, first).alias("open"), F.max(value).alias("high"), F.min(value).alias("low"), F.max_by(value, last).alias("close"), F.sum(value).alias("volume")
    )


def strategy_weights(prices: DataFrame, strategy: str, key: str = "symbol", time: str = "day", price: str = "close", **p) -> DataFrame:
    """key, time, weight: target weights of a strategy at each time, summing to 1 (or 0) over keys.

    trend: fast average above slow average, equal weights.  momentum: positive return over
    ``lookback``, in proportion.  mean_reversion: RSI hysteresis, equal weights.
    market_neutral: half long the calmer half of keys, half short the wilder half.
    """
    order = [time]
    if strategy == "trend":
        s = prices.withColumn("_f", moving_average(price, [key], order, p.get("fast", 5))).withColumn("_s", moving_average(price, [key], order, p.get("slow", 10)))
        raw = s.withColumn("_w", F.coalesce((F.col("_f") > F.col("_s")).cast("double"), F.lit(0.0)))
    elif strategy == "momentum":
        back = F.lag(price, p.get("lookback", 5)).over(Window.partitionBy(key).orderBy(time))
        raw = prices.withColumn("_w", F.coalesce(F.greatest(F.col(price) / back - 1, F.lit(0.0)), F.lit(0.0)))
    elif strategy == "mean_reversion":
        rsi = hysteresis(wilder_rsi(prices, key, time, price, p.get("period", 14)), [key], order, "rsi", p.get("enter", 30.0), p.get("leave", 55.0))
        raw = rsi.withColumn("_w", F.col("holding").cast("double"))
    elif strategy == "market_neutral":
        back = F.col(price) / F.lag(price).over(Window.partitionBy(key).orderBy(time)) - 1
        vol = prices.withColumn("_r", F.coalesce(back, F.lit(0.0))).withColumn("_v", rolling_std("_r", [key], order, p.get("window", 5))).filter("_v is not null")
        ranked = vol.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(time))).withColumn("_k", F.row_number().over(Window.partitionBy(time).orderBy("_v", key)))
        half = F.greatest(F.lit(1), F.floor(F.col("_n") / 2))
        return ranked.select(key, time, F.when(F.col("_k") > F.col("_n") - half, -0.5 / half).when(F.col("_k") <= half, 0.5 / half).otherwise(0.0).alias("weight"))
    else:
        raise ValueError(f"unknown strategy: {strategy}")
    total = F.sum("_w").over(Window.partitionBy(time))
    return raw.select(key, time, F.when(total > 0, F.col("_w") / total).otherwise(0.0).alias("weight"))


def backtest(prices: DataFrame, weights: DataFrame, key: str = "symbol", time: str = "day", price: str = "close") -> DataFrame:
    """time, ret, equity, drawdown: weights of one time earn the returns of the next; equity starts at 100."""
    series = Window.partitionBy(key).orderBy(time)
    earned = prices.join(weights, [key, time]).withColumn("_ret", F.col(price) / F.lag(price).over(series) - 1).withColumn("_held", F.lag("weight").over(series))
    daily = earned.groupBy(time).agg(F.sum(F.coalesce(F.col("_held") * F.col("_ret"), F.lit(0.0))).alias("ret"))
    # one row per calendar day from here on
    out = daily.withColumn("_all", F.lit(1)).withColumn("_g", 1 + F.col("ret"))
    out = cumulative_product(out, ["_all"], [time], "_g", "_p").withColumn("equity", 100 * F.col("_p"))
    return drawdown(out, ["_all"], [time], "equity").select(time, "ret", "equity", "drawdown")


def backtest_metrics(curve: DataFrame, periods: int = 252) -> DataFrame:
    """total_return, cagr, sharpe, max_drawdown, win_rate, vol of an equity curve (population deviation; 0 if flat)."""
    r = curve.agg(
        F.count(F.lit(1)).alias("n"), F.max_by("equity", "day").alias("e1"), F.min_by("equity", "day").alias("e0"), F.avg(F.when(F.col("_first") == 0, F.col("ret"))).alias("mu"),
        F.stddev_pop(F.when(F.col("_first") == 0, F.col("ret"))).alias("sd"), F.min("drawdown").alias("mdd"), F.avg(F.when(F.col("_first") == 0, (F.col("ret") > 0).cast("double"))).alias("win"),
    )
    return r.select(
        F.round(F.col("e1") / F.col("e0") - 1, 4).alias("total_return"), F.round(F.pow(F.col("e1") / F.col("e0"), F.lit(float(periods)) / F.col("n")) - 1, 4).alias("cagr"),
        F.round(F.when(F.col("sd") > 0, F.col("mu") / F.col("sd") * periods**0.5).otherwise(0.0), 2).alias("sharpe"), F.round("mdd", 4).alias("max_drawdown"), F.round("win", 4).alias("win_rate"), F.round(F.col("sd") * periods**0.5, 4).alias("vol"),
    )
