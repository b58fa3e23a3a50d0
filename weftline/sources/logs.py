"""Logs as tables: pages since a cursor, row projections, envelopes, synthetic ticks, crawls over stored pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import text
from weftline.session import materialize


def page(log: DataFrame, since: int, limit: int, order: str = "seq", tie: tuple[str, ...] = ()) -> DataFrame:
    """The next rows after a cursor (exclusive), ascending."""
    return log.filter(F.col(order) > since).orderBy(order, *tie).limit(limit)


def batch_hash(ids: Column) -> Column:
    """Aggregate: a SHA-256 of a batch that does not depend on its order: over the XOR and sum of the ids' hashes and their count."""
    h = F.xxhash64(ids)
    return F.sha2(F.concat_ws("|", F.bit_xor(h).cast("string"), F.sum(F.shiftright(h, 20)).cast("string"), F.count(ids).cast("string")), 256)


def event_time(column: Column) -> Column:
    """A timestamp from ISO text, cut to milliseconds; the epoch where it can't be read."""
    return F.coalesce(F.date_trunc("millisecond", F.try_to_timestamp(column)), F.lit("1970-01-01").cast("timestamp"))


def canonical_json(column: Column) -> Column:
    """JSON of a map with its keys in order; equal maps give equal text."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(column))))


def envelope(df: DataFrame, source: str, kind: Column, subject: Column, time: Column, payload: Column) -> DataFrame:
    """id, type, source, subject, time, payload: event envelopes whose id depends on their content alone."""
    body = F.to_json(payload)
    return df.select(F.sha2(F.concat_ws("|", F.lit(source), kind, subject.cast("string"), time.cast("string"), body), 256).alias("id"), kind.alias("type"), F.lit(source).alias("source"), subject.cast("string").alias("subject"), time.alias("time"), body.alias("payload"))


def changed_ids(log: DataFrame) -> DataFrame:
    """id: what a piece of the log touched: nodes and both ends of edges, each once."""
    ids = F.explode(F.array("event_id", "from_id", "to_id"))
    return log.select(ids.alias("id")).filter("id is not null and id <> ''").distinct()


def ticks(spark: SparkSession, symbols: list[str], n: int, seed: int, start: float = 100.0) -> DataFrame:
    """symbol, seq, price, volume: a seeded random walk per symbol with floor 0.01, the same at any partitioning."""
    import numpy as np
    import pandas as pd

    frame = spark.createDataFrame([(s,) for s in symbols], "symbol string")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        name = pdf["symbol"].iloc[0]
        rng = np.random.default_rng([seed, *name.encode()])
        steps, price, out = rng.normal(0, 0.5, n), start, np.empty(n)
        for i, step in enumerate(steps):
            price = max(0.01, price + step)
            out[i] = round(price, 4)
        return pd.DataFrame({"symbol": name, "seq": np.arange(n), "price": out, "volume": rng.integers(1, 1000, n)})

    return frame.groupBy("symbol").applyInPandas(run, "symbol string, seq bigint, price double, volume bigint")


def crawl(pages: DataFrame, seeds: DataFrame, most_depth: int, url: str = "url", html: str = "html", rules: list[tuple[str, str]] | None = None) -> DataFrame:
    """url, depth: pages reached from the seeds over links to the same origin, each at its least depth.

    rules: of the origin's robots.txt; pages they forbid are not read.

    Runs over stored pages; fragments are cut off, so ``a#x`` and ``a`` are one page.
    """
    plain = lambda c: F.regexp_replace(c, "#.*$", "")
    origin = lambda c: F.regexp_extract(c, r"^(https?://[^/]+)", 1)
    out = pages.select(plain(F.col(url)).alias("src"), F.explode(text.links(F.col(html))).alias("t"))
    out = out.withColumn("dst", plain(F.when(F.col("t").startswith("/"), F.concat(origin(F.col("src")), F.col("t"))).otherwise(F.col("t"))))
    edges = materialize(out.filter(origin(F.col("src")) == origin(F.col("dst"))).select("src", "dst").distinct(), "crawl")
    stored = pages.select(plain(F.col(url)).alias("url")).distinct()
    if rules:
        stored = stored.filter(text.may_fetch(F.regexp_replace("url", r"^https?://[^/]+", ""), rules))
    seen = frontier = materialize(seeds.select(plain(F.col("url")).alias("url")).distinct().withColumn("depth", F.lit(0)).join(stored, "url", "left_semi"), "crawl")
    for depth in range(1, most_depth + 1):
        found = frontier.join(edges, F.col("url") == F.col("src")).select(F.col("dst").alias("url")).distinct().join(stored, "url", "left_semi").join(seen.select("url"), "url", "left_anti")
        frontier = materialize(found.withColumn("depth", F.lit(depth)), "crawl")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        if depth % 10 == 0:
            seen = materialize(seen, "crawl")
    return seen
