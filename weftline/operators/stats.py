"""Statistics over vectors and samples: pooling, eigen-stability, ridge regression, date shifts."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def mean_pool(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, pooled: the mean vector per key, over positions; combined before the shuffle.  Null vectors are left out."""
    cells = df.select(*keys, F.posexplode(vector).alias("i", "x")).groupBy(*keys, "i").agg(F.avg("x").alias("m"))
    return cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("c")).select(*keys, F.transform("c", lambda c: c["m"]).alias("pooled"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 if one of them is all zero, null if one is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda acc, v: acc + F.coalesce(v, F.lit(0.0)))
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(F.when(norm.isNotNull(), 0.0))


def eigen_stability(df: DataFrame, key: str, vector: str) -> DataFrame:
    """key, n, top_share: how much of the spread of a key's unit vectors lies in one direction.

    The eigenvalues of the Gram matrix of n vectors are those of their d x d moment matrix,
    which is added up per partition; so a key of any size needs d*d numbers, not n*n.
    Null and zero vectors are left out.
    """
    kind = df.schema[key].dataType.simpleString()

    def moments(batches):
        held: dict = {}
        for pdf in batches:
            pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) > 0)]
            for k, part in pdf.groupby(key, dropna=False):
                m = np.vstack(part[vector].to_numpy()).astype(float)
                norm = np.linalg.norm(m, axis=1)
                m = m[norm > 0] / norm[norm > 0][:, None]
                n, s = held.get(k, (0, 0.0))
                held[k] = (n + len(m), s + m.T @ m)
        rows = [(k, n, s.ravel()) for k, (n, s) in held.items() if n]
        yield pd.DataFrame(rows, columns=[key, "n", "moments"])

    def shares(pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum(np.vstack(pdf["moments"].to_numpy()), axis=0)
        d = int(round(len(total) ** 0.5))
        values = np.linalg.eigvalsh(total.reshape(d, d))
        return pd.DataFrame({key: [pdf[key].iloc[0]], "n": [int(pdf["n"].sum())], "top_share": [float(values[-1] / values.sum())]})

    parts = df.select(key, vector).mapInPandas(moments, f"{key} {kind}, n bigint, moments array<double>")
    return parts.groupBy(key).applyInPandas(shares, f"{key} {kind}, n bigint, top_share double")


def ridge(df: DataFrame, features: list[str], target: str, strength: float) -> dict[str, float]:
    """Coefficients (and ``intercept``) of a ridge regression on standardised features, from one pass of sums.

    Rows with a null are left out.  A constant feature gets 0; the intercept carries no penalty.
    """
    names = [*features, target]
    clean = df.select(*[F.col(c).cast("double").alias(c) for c in names]).na.drop()
    means = clean.agg(*[F.avg(c).alias(c) for c in names], F.count(F.lit(1)).alias("_n")).first()
    if not means["_n"]:
        raise ValueError("no rows")
    centred = [(F.col(c) - F.lit(means[c])) for c in names]
    sums = clean.agg(*[F.sum(centred[i] * centred[j]).alias(f"m{i}_{j}") for i in range(len(names)) for j in range(i, len(names))]).first()
    k = len(features)
    full = np.array([[sums[f"m{min(i, j)}_{max(i, j)}"] for j in range(k + 1)] for i in range(k + 1)])
    sd = np.sqrt(np.diag(full)[:k] / means["_n"])
    use = sd > 0
    scale = np.where(use, sd, 1.0)
    gram = full[:k, :k] / np.outer(scale, scale)
    beta = np.zeros(k)
    beta[use] = np.linalg.solve(gram[np.ix_(use, use)] + strength * np.eye(int(use.sum())), (full[:k, k] / scale)[use])
    beta = beta / scale
    return dict(zip(features, beta.tolist())) | {"intercept": float(means[target] - sum(b * means[f] for b, f in zip(beta, features)))}


def date_shift(date: Column, subject: Column, key: str, back: int = 183, ahead: int = 182) -> Column:
    """A date moved by a number of days in [-back, ahead] that is the same for all dates of a subject; null stays null."""
    days = F.pmod(F.conv(F.substring(F.sha2(F.concat_ws("|", F.lit(key), subject.cast("string")), 256), 1, 12), 16, 10).cast("bigint"), F.lit(back + ahead + 1)) - back
    return F.date_add(date, days.cast("int"))


def date_shift_text(text: Column, subject: Column, key: str) -> Column:
    """``date_shift`` over written dates: a year alone passes, what can't be read becomes 'unshiftable', null stays null."""
    day = F.to_date(F.try_to_timestamp(F.trim(text)))
    return F.when(text.isNull(), F.lit(None)).when(F.trim(text).rlike(r"^\d{4}$"), F.trim(text)).when(day.isNotNull(), F.date_format(date_shift(day, subject, key), "yyyy-MM-dd")).otherwise("unshiftable")


def variance(df: DataFrame, keys: list[str], vector: str) -> DataFrame:
    """keys, n, variance: mean squared distance of vectors from their mean (population variance, summed over the places)."""
    one = df.select(*keys, F.monotonically_increasing_id().alias("_id"), F.posexplode(vector).alias("_i", "_x"))
    by_place = one.groupBy(*keys, "_i").agg(F.var_pop(F.col("_x").cast("double")).alias("v"), F.count(F.lit(1)).alias("n"))
    return by_place.groupBy(*keys).agg(F.max("n").alias("n"), F.sum("v").alias("variance"))


def backoff(attempt: Column, base: float, most: int = 3, exponential: bool = True) -> Column:
    """Seconds before the next attempt (base, doubling); null once ``most`` attempts are made: a dead letter."""
    return F.when(attempt <= most, F.lit(base) * F.pow(F.lit(2.0), attempt - 1) if exponential else F.lit(base))


def route_valid(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """(accepted, quarantined): rows that meet every rule, and the others with the names of the rules they break.

    A rule that is null for a row is broken.
    """
    broken = F.filter(F.array(*[F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items()]), lambda x: x.isNotNull())
    marked = df.withColumn("_broken", broken)
    return marked.filter(F.size("_broken") == 0).drop("_broken"), marked.filter(F.size("_broken") > 0).withColumnRenamed("_broken", "broken_rules")
