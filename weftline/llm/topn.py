"""The N best items of every group, by partition lower bounds.

The N-th best score within one partition of a group is a bound that no item of the group's
final N can fall below.  So: rank within each partition (Spark cuts there before its
shuffle, to at most N rows per group and partition), take the highest of these bounds per
group, drop the rows below it, and rank the few survivors.  A group that holds a third of
all rows is spread over all partitions until then; no task ever holds a whole group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import materialize


def latest_scores(df: DataFrame, group: list[str], item: str, score: str, ts: str, row_id: str) -> DataFrame:
    """One score per group and item: of the row with the latest ts (null ts first of all), then the greatest row_id.

    Rows whose score is null or NaN, or whose item is null, are left out first; a null group
    column is a group of its own.  Repeated rows do not matter.  Combined before the shuffle.
    """
    valid = df.filter(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    best = F.max(F.struct(F.col(ts).alias("t"), F.col(row_id).alias("i"), F.col(score).alias("s")))
    return valid.groupBy(*group, item).agg(best.alias("_b")).select(*group, item, F.col("_b.s").alias(score))


def top_n(df: DataFrame, group: list[str], item: str, score: str, n: int, place: str = "place") -> DataFrame:
    """group, item, score, place: the n best items of each group, higher scores first, equal scores by ascending item.

    Expects one row per group and item.  An empty table gives no rows; ``n`` < 1 is an error.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    order = [F.col(score).desc(), F.col(item).asc()]
    spread = df.select(*group, item, score).withColumn("_part", F.spark_partition_id())
    within = Window.partitionBy(*group, "_part").orderBy(*order)
    local = materialize(spread.withColumn("_rn", F.row_number().over(within)).filter(F.col("_rn") <= n), "topn")
    bounds = local.filter(F.col("_rn") == n).groupBy(*group).agg(F.max(score).alias("_bound"))
    names = [f"_g{i}" for i in range(len(group))]
    bounds = bounds.select(*[F.col(g).alias(x) for g, x in zip(group, names)], "_bound")
    same = reduce(lambda a, b: a & b, [F.col(g).eqNullSafe(F.col(x)) for g, x in zip(group, names)])
    survivors = local.join(bounds, same, "left").filter(F.col("_bound").isNull() | (F.col(score) >= F.col("_bound")))
    ranked = survivors.withColumn(place, F.row_number().over(Window.partitionBy(*group).orderBy(*order)))
    return ranked.filter(F.col(place) <= n).select(*group, item, score, place)
