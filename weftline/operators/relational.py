"""Relational operators beyond what a DataFrame method says by itself."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest_by(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One whole row per key: the first in ``order`` (a total order makes it deterministic).

    Spark cuts to one row per key within each partition before the shuffle, so a key with a
    third of all rows is no hot task.  Null keys are a key of their own.
    """
    ranked = df.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col("_rn") == 1).drop("_rn")


def band_join(left: DataFrame, right: DataFrame, keys: list[str], value: str, reference: str, tolerance: float, scale: Column | None = None) -> DataFrame:
    """Equi-join on keys, kept where |value*scale - reference| <= |reference| * tolerance; null values never match."""
    scaled = F.col(value) * scale if scale is not None else F.col(value)
    return left.join(right, keys).filter(F.abs(scaled - F.col(reference)) <= F.abs(F.col(reference)) * tolerance)


def range_join(points: DataFrame, ranges: DataFrame, point: str, low: str, high: str, width: float) -> DataFrame:
    """Points within [low, high) of ranges, by an equi-join on buckets of ``width``.

    A range is copied to each bucket it touches, so choose a width near the usual length of
    the ranges.  Null points and ranges match nothing; an empty side gives no rows.
    """
    bucket = lambda c: F.floor(F.col(c).cast("double") / width)
    spread = ranges.filter(F.col(low) < F.col(high)).withColumn("_bucket", F.explode(F.sequence(bucket(low), bucket(high))))
    return points.withColumn("_bucket", bucket(point)).join(spread, "_bucket").filter((F.col(point) >= F.col(low)) & (F.col(point) < F.col(high))).drop("_bucket")


def asof_join(left: DataFrame, right: DataFrame, keys: list[str], time: str, values: list[str], slice_seconds: int | None = None) -> DataFrame:
    """Each left row with the values of the last right row of its keys at or before its time (null if none).

    Both sides go through one window per key instead of a theta join: no pair is ever built.
    Of right rows with equal time the one with the greatest values counts.  With
    ``slice_seconds`` (for timestamps) the window is one slice of time of a key, and what the
    slices before left over is carried in; so a key that holds a third of all rows is spread
    over its slices.
    """
    pack = F.struct(*[F.col(v) for v in values])
    columns = [c for c in left.columns if c not in keys and c != time]
    a = left.select(*keys, time, F.struct(*[F.col(c) for c in columns]).alias("_l"), F.lit(None).cast(_struct_of(right, values)).alias("_r"), F.lit(1).alias("_side"))
    b = right.select(*keys, time, F.lit(None).cast(_struct_of(left, columns)).alias("_l"), pack.alias("_r"), F.lit(0).alias("_side"))
    both, within = a.unionByName(b), list(keys)
    if slice_seconds:
        both = both.withColumn("_slice", F.floor(F.unix_micros(F.col(time).cast("timestamp")) / (slice_seconds * 1_000_000)))
        within.append("_slice")
    upto = Window.partitionBy(*within).orderBy(time, "_side", "_r").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    found = both.withColumn("_last", F.last("_r", ignorenulls=True).over(upto)).filter("_side = 1")
    if slice_seconds:
        # one row per key and slice: its last right row, then the last of all slices before
        ends = both.groupBy(*within).agg(F.max(F.when(F.col("_side") == 0, F.struct(F.col(time).alias("t"), F.col("_r").alias("r")))).alias("_e"))
        before = Window.partitionBy(*keys).orderBy("_slice").rowsBetween(Window.unboundedPreceding, -1)
        carried = ends.withColumn("_c", F.last(F.col("_e.r"), ignorenulls=True).over(before)).select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(within)], "_c")
        same = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(within)]
        found = found.join(carried, same, "left").withColumn("_last", F.coalesce("_last", "_c"))
    return found.select(*keys, time, *[F.col(f"_l.{c}").alias(c) for c in columns], *[F.col(f"_last.{v}").alias(v) for v in values])


def _struct_of(df: DataFrame, columns: list[str]) -> str:
    return "struct<" + ",".join(f"`{c}`:{df.schema[c].dataType.simpleString()}" for c in columns) + ">"


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, tie: str, slice_seconds: int | None = None) -> DataFrame:
    """key, session_no, started, ended, n: runs of rows of a key with no gap longer than ``gap_seconds``.

    With ``slice_seconds`` the windows run over one slice of time of a key; the end of the
    slices before and their number of sessions are carried in, so a key that holds a third of
    all rows is spread over its slices.  Rows with a null time form the key's first session.
    """
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rows, within = df.select(key, time, tie), [key]
    if slice_seconds:
        rows, within = rows.withColumn("_slice", F.floor(micros(time) / (slice_seconds * 1_000_000))), [key, "_slice"]
    w = Window.partitionBy(*within).orderBy(time, tie)
    before = Window.partitionBy("_k0").orderBy("_k1").rowsBetween(Window.unboundedPreceding, -1)
    carry = lambda df, column: df.join(column, [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(within)], "left").drop("_k0", "_k1")
    marked = rows.withColumn("_last", F.lag(time).over(w))
    if slice_seconds:
        ends = rows.groupBy(F.col(key).alias("_k0"), F.col("_slice").alias("_k1")).agg(F.max(time).alias("_end"))
        marked = carry(marked, ends.select("_k0", "_k1", F.max("_end").over(before).alias("_prev"))).withColumn("_last", F.coalesce("_last", "_prev"))
    gap = micros(time) - micros("_last")
    marked = marked.withColumn("_new", F.when(gap.isNull() | (gap > gap_seconds * 1_000_000), 1).otherwise(0))
    numbered = marked.withColumn("session_no", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    if slice_seconds:
        starts = marked.groupBy(F.col(key).alias("_k0"), F.col("_slice").alias("_k1")).agg(F.sum("_new").alias("_s"))
        numbered = carry(numbered, starts.select("_k0", "_k1", F.sum("_s").over(before).alias("_off"))).withColumn("session_no", F.col("session_no") + F.coalesce("_off", F.lit(0)))
    return numbered.groupBy(key, "session_no").agg(F.min(time).alias("started"), F.max(time).alias("ended"), F.count(F.lit(1)).alias("n"))


def upsert(base: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Base rows overwritten by changes of equal keys, other changes added; action says inserted, updated or kept.

    Expects at most one change per key (see ``latest_by``).  Columns of changes count even
    if null; null keys never match.
    """
    values = [c for c in base.columns if c not in keys]
    b = base.select(*keys, F.struct(*values).alias("_b"))
    c = changes.select(*keys, F.struct(*values).alias("_c"))
    action = F.when(F.col("_c").isNull(), "kept").when(F.col("_b").isNull(), "inserted").otherwise("updated")
    joined = b.join(c, keys, "full_outer")
    return joined.select(*keys, *[F.when(F.col("_c").isNull(), F.col(f"_b.{v}")).otherwise(F.col(f"_c.{v}")).alias(v) for v in values], action.alias("action"))
