"""Facts and marts: latest-wins, merges, snapshots, indicators, grades, cohorts, concentration, risk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# fixed values: the ladder of evidence, weakest first
LADDER = ("unknown", "hypothesis", "simulated", "observed", "derived", "verified", "attested")


def latest_wins(df: DataFrame, keys: list[str], version: str) -> DataFrame:
    """One row per key: that of the greatest version, ties by all other columns; combined before the shuffle."""
    rest = [c for c in df.columns if c not in keys]
    best = F.max(F.struct(F.col(version).alias("_v"), *[F.col(c) for c in rest])).alias("_b")
    return df.groupBy(*keys).agg(best).select(*keys, *[F.col(f"_b.{c}").alias(c) for c in rest])


def summing_merge(df: DataFrame, keys: list[str], sums: list[str]) -> DataFrame:
    """Numeric columns added up per key, as merging parts of a summing table does.  Means must not be given here."""
    return df.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in sums])


def weakest(column: Column, ladder: tuple[str, ...] = LADDER) -> Column:
    """Aggregate: the weakest step of a ladder; a step that isn't on it counts as the weakest, as does no row at all."""
    names = F.array(*[F.lit(x) for x in ladder])
    place = F.min(F.greatest(F.coalesce(F.array_position(names, column), F.lit(0)), F.lit(1))).cast("int")
    return F.coalesce(F.element_at(names, place), F.lit(ladder[0]))


def grade(value: Column, n: Column, ok: float, sad: float, direction: str, least: int) -> Column:
    """ok, sad, bad, or insufficient_data for a null value or fewer than ``least`` observations."""
    good, fair = (value >= ok, value >= sad) if direction == "high" else (value <= ok, value <= sad)
    return F.when(value.isNull() | (n < least), "insufficient_data").when(good, "ok").when(fair, "sad").otherwise("bad")


def cohort(df: DataFrame, keys: list[str], aggregates: list[Column], least: int = 11) -> DataFrame:
    """Aggregates per cohort; cohorts of fewer than ``least`` members are suppressed."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("members"), *aggregates).filter(F.col("members") >= least)


def concentration(df: DataFrame, keys: list[str], holder: str, amount: str) -> DataFrame:
    """keys, hhi, effective, top_weight: how concentrated amounts are among holders; a total of zero or less gives null."""
    held = df.groupBy(*keys, holder).agg(F.sum(amount).alias("_a"))
    squares = held.groupBy(*keys).agg(F.sum("_a").alias("_t"), F.sum(F.col("_a") * F.col("_a")).alias("_q"), F.max("_a").alias("_m"))
    hhi = F.when(F.col("_t") > 0, F.col("_q") / (F.col("_t") * F.col("_t")))
    return squares.select(*keys, hhi.alias("hhi"), (1 / hhi).alias("effective"), F.when(F.col("_t") > 0, F.col("_m") / F.col("_t")).alias("top_weight"))


def parametric_var(returns: DataFrame, weights: DataFrame, key: str, market_value: float, z: float = 1.645, default: float = 0.02) -> DataFrame:
    """One row: z * sum(weight * deviation) * market value; a key with fewer than three returns has the default deviation."""
    dev = returns.groupBy(key).agg(F.count("ret").alias("_n"), F.stddev_samp("ret").alias("_s"))
    sigma = F.when(F.coalesce(F.col("_n"), F.lit(0)) < 3, F.lit(default)).otherwise(F.col("_s"))
    return weights.join(dev, key, "left").agg((F.sum(F.col("weight") * sigma) * z * market_value).alias("var"))


def state_hash(df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row: the SHA-256 over the sorted SHA-256 of the rows, the same for any order and partitioning.

    Row hashes are folded in two steps (by their first three digits, then over those), so no
    task holds more than a 4,096th of them.
    """
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in [key, *columns]])
    rows = df.select(F.sha2(text, 256).alias("h"))
    folded = rows.groupBy(F.substring("h", 1, 3).alias("p")).agg(F.sha2(F.array_join(F.array_sort(F.collect_list("h")), ""), 256).alias("ph"), F.count(F.lit(1)).alias("n"))
    return folded.agg(F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p", "ph"))), lambda x: x["ph"]), ""), 256).alias("state_hash"), F.sum("n").alias("rows"))


def balanced_accuracy(df: DataFrame, keys: list[str], truth: str, guess: str) -> DataFrame:
    """keys, score: mean of sensitivity and specificity; one of them alone if the other has no cases."""
    rate = lambda t: F.avg(F.when(F.col(truth) == F.lit(t), (F.col(guess) == F.lit(t)).cast("double")))
    held = df.groupBy(*keys).agg(rate(True).alias("_p"), rate(False).alias("_n"))
    return held.select(*keys, F.coalesce((F.col("_p") + F.col("_n")) / 2, F.col("_p"), F.col("_n")).alias("score"))


def precision_recall(found: DataFrame, gold: DataFrame, keys: list[str]) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 of distinct keys against gold keys (null where undefined)."""
    f, g = found.select(*keys).distinct().withColumn("_f", F.lit(1)), gold.select(*keys).distinct().withColumn("_g", F.lit(1))
    c = f.join(g, keys, "full_outer").agg(F.count_if(F.col("_f").isNotNull() & F.col("_g").isNotNull()).alias("tp"), F.count_if(F.col("_g").isNull()).alias("fp"), F.count_if(F.col("_f").isNull()).alias("fn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    return c.withColumn("precision", p).withColumn("recall", r).withColumn("f1", F.try_divide(2 * F.col("tp"), 2 * F.col("tp") + F.col("fp") + F.col("fn")))


def set_diff(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """key, status: shared, changed, left_only or right_only."""
    a, b = left.select(key, F.col(value).alias("_a"), F.lit(1).alias("_l")), right.select(key, F.col(value).alias("_b"), F.lit(1).alias("_r"))
    status = F.when(F.col("_r").isNull(), "left_only").when(F.col("_l").isNull(), "right_only").when(F.col("_a").eqNullSafe(F.col("_b")), "shared").otherwise("changed")
    return a.join(b, key, "full_outer").select(key, status.alias("status"))


def blend(sources: list[DataFrame], key: str, each: int, order: list[Column]) -> DataFrame:
    """Up to ``each`` rows of every source in order of sources, one per lower-cased key, the earliest source first."""
    out = None
    for number, source in enumerate(sources):
        w = Window.partitionBy(F.lit(1)).orderBy(*order)
        top = source.orderBy(*order).limit(each).withColumn("source_no", F.lit(number)).withColumn("rank_no", F.row_number().over(w))
        out = top if out is None else out.unionByName(top)
    first = Window.partitionBy(F.lower(key)).orderBy("source_no", "rank_no")
    return out.withColumn("_rn", F.row_number().over(first)).filter("_rn = 1").drop("_rn")


def chain_verify(df: DataFrame, keys: list[str], order: str, own: str, previous: str) -> DataFrame:
    """keys, links, broken: rows of each hash chain, and those whose ``previous`` is not the row before's own hash."""
    before = F.lag(own).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_ok", F.col(previous).eqNullSafe(before)).groupBy(*keys).agg(F.count(F.lit(1)).alias("links"), F.count_if(~F.col("_ok")).alias("broken"))


def token_bucket(df: DataFrame, key: str, time: str, tie: str, rate: float, burst: float) -> DataFrame:
    """Each row with whether a token was there: the bucket refills by elapsed seconds, up to ``burst``; a row takes one.

    Sequential within a key; the fold runs over batches of a sorted partition with one state
    per key, so no key is ever held as a whole.
    """
    import pandas as pd

    schema = df.select(key, tie).schema.simpleString()[7:-1].replace(":", " ") + ", allowed boolean"

    def run(batches):
        current, level, last = object(), burst, 0.0
        for pdf in batches:
            out = []
            for k, at in zip(pdf[key], pdf["_s"]):
                if k != current:
                    current, level, last = k, burst, at
                level = min(burst, level + (at - last) * rate)
                last = at
                ok = level >= 1
                level -= ok
                out.append(ok)
            yield pd.DataFrame({key: pdf[key], tie: pdf[tie], "allowed": out})

    seconds = F.unix_micros(F.col(time).cast("timestamp")) / 1e6
    return df.select(key, tie, seconds.alias("_s")).repartition(key).sortWithinPartitions(key, "_s", tie).mapInPandas(run, schema)


def composite(axes: dict[str, float], gates: list[Column] | None = None) -> Column:
    """Weighted sum of score columns (a null axis counts 0); 0 where a gate is not true, whatever the scores."""
    total = sum((F.coalesce(F.col(c), F.lit(0.0)) * w for c, w in axes.items()), F.lit(0.0))
    for gate in gates or []:
        total = F.when(F.coalesce(gate, F.lit(False)), total).otherwise(0.0)
    return total


def health(column: Column) -> Column:
    """Aggregate of states: none or all unknown: unknown; all known ones down: down; all healthy: healthy; else degraded."""
    n = F.count(F.lit(1))
    known = F.count_if(F.coalesce(column, F.lit("unknown")) != "unknown")
    return F.when(known == 0, "unknown").when(F.count_if(column == "down") == known, "down").when(F.count_if(column == "healthy") == n, "healthy").otherwise("degraded")


def worst(column: Column, ladder: tuple[str, ...]) -> Column:
    """Aggregate: the highest step of a ladder that occurs; null if none does."""
    names = F.array(*[F.lit(x) for x in ladder])
    return F.try_element_at(names, F.nullif(F.max(F.array_position(names, column)), F.lit(0)).cast("int"))


def cap_weights(df: DataFrame, keys: list[str], item: str, amount: str, most: float) -> DataFrame:
    """keys, item, weight, trim: each item's share, and the amount to sell where it is above ``most``."""
    total = F.sum(amount).over(Window.partitionBy(*keys))
    weight = F.when(total > 0, F.col(amount) / total)
    return df.select(*keys, item, weight.alias("weight"), F.when(weight > most, F.col(amount) - most * total).otherwise(0.0).alias("trim"))


def lookup_absolute(df: DataFrame, figures: DataFrame, keys: list[str], value: str, absolute: str, resolve=None) -> DataFrame:
    """df with reference_value: of the figures of equal keys the absolute one, else the one as printed; null if none.

    Several figures of one key must agree; the greatest is taken.  resolve: a function
    (df, figures, keys) -> frame that looks the figures up in its own way instead.
    """
    if resolve is not None:
        return resolve(df, figures, keys)
    one = figures.groupBy(*keys).agg(F.coalesce(F.max(absolute), F.max(value)).alias("reference_value"))
    return df.join(one, keys, "left")


def federate(sources: dict, key: str, each: int, order: list[Column]) -> tuple[DataFrame, list[str]]:
    """(rows, failed): ``blend`` over sources given as functions, in their order; a source that fails is named and left out.

    At most ``each`` rows of a source are kept, and they are read when it is asked, so a source
    fails here and not later.
    """
    frames, failed = [], []
    for name, ask in sources.items():
        try:
            df = ask()
            top = df.orderBy(*order).limit(each)
            frames.append(df.sparkSession.createDataFrame(top.collect(), top.schema))  # at most ``each`` rows
        except Exception:
            failed.append(name)
    if not frames:
        raise RuntimeError(f"all sources failed: {', '.join(failed)}")
    return blend(frames, key, each, order), failed


def lookup(df: DataFrame, reference: DataFrame, keys: list[str], prefer: list[str], value: str) -> DataFrame:
    """df with reference_value: of the reference rows of equal keys, the first by ``prefer`` (nulls last); null if none."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).asc_nulls_last() for c in prefer], F.col(value))
    best = reference.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").select(*keys, F.col(value).alias("reference_value"))
    return df.join(best, keys, "left")
