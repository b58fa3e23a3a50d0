"""Cursor-checkpointed micro-batches and Structured Streaming pipelines with idempotent sinks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.operators.changes import CREATE, BucketedTable
from weftline.session import fresh_path
from weftline.sources import files
from weftline.sources.logs import batch_hash, changed_ids, page


class Materializer:
    """Poll a log since a cursor, write the batch, mint a receipt, then move the cursor.

    A crash between the write and the cursor repeats the batch; the sink must take that
    without harm (latest-wins by key does).  An empty poll does nothing.
    """

    def __init__(self, spark: SparkSession, path: str, sink: Callable[[DataFrame], None], limit: int = 1000):
        self.spark, self.path, self.sink, self.limit = spark, path.rstrip("/"), sink, limit

    def cursor(self) -> int:
        names = files.list_names(self.spark, f"{self.path}/cursors")
        done = [n for n in names if n.endswith(".json")]
        return files.read_json(self.spark, f"{self.path}/cursors/{done[-1]}")["to_cursor"] if done else -1

    def lag(self, log: DataFrame) -> int:
        """How far the log's end is ahead of the cursor."""
        return (log.agg(F.max("seq")).first()[0] or 0) - max(self.cursor(), 0)

    def run_once(self, log: DataFrame) -> dict | None:
        """One batch; its receipt, or None if nothing is new.

        Rows of one seq stay in one batch, so a page may be longer than its limit.
        """
        since = self.cursor()
        top = page(log, since, self.limit, "seq", ("event_id",)).agg(F.max("seq")).first()[0]
        if top is None:
            return None
        batch = log.filter((F.col("seq") > since) & (F.col("seq") <= top))
        self.sink(batch)
        row = batch.agg(F.count(F.lit(1)).alias("n"), batch_hash(F.concat_ws("|", "event_id", F.col("seq").cast("string"))).alias("h")).first()
        receipt = {"from_cursor": since, "to_cursor": top, "row_count": row["n"], "batch_hash": row["h"]}
        files.commit_json(self.spark, f"{self.path}/cursors/{top:020d}.json", receipt)
        return receipt


def file_stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A Parquet file or folder of a directory as a stream; its schema is read once from the files."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", f"{name}.parquet").parquet(folder)


def event_stream(spark: SparkSession, folder: str) -> DataFrame:
    """The events as a stream with a time that takes a watermark."""
    return file_stream(spark, folder, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def run_available(stream: DataFrame, mode: str = "append", name: str = "stream") -> DataFrame:
    """Run a streaming query over what is there, into files of the shared folder, and read them."""
    spark = stream.sparkSession
    path = fresh_path(spark, name)
    query = stream.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(stream.schema).parquet(path)


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Run a function over every micro-batch of what is there; a batch may come twice after a failure."""
    stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def tumbling(stream: DataFrame, width: str, late: str) -> DataFrame:
    """event_type, started, n, total: windows of a width; a window is out once the watermark passes its end, later rows are dropped."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("started"), "n", "total")


def sliding(stream: DataFrame, width: str, step: str, late: str) -> DataFrame:
    """event_type, started, n, total: windows of a width that start every step, so a row counts in several."""
    w = stream.withWatermark("ts", late).groupBy(F.window("ts", width, step).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select("event_type", F.col("w.start").alias("started"), "n", "total")


def session_counts(stream: DataFrame, gap: str, late: str) -> DataFrame:
    """user_id, started, ended, n: session windows per user."""
    w = stream.withWatermark("ts", late).groupBy(F.session_window("ts", gap).alias("w"), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return w.select("user_id", F.col("w.start").alias("started"), F.col("w.end").alias("ended"), "n")


def latest_wins_sink(spark: SparkSession, path: str, key: str, order: str, payload: list[str], buckets: int = 16):
    """(function for run_batches, table): batches go into a bucketed copy-on-write table, the greatest order of a key wins.

    Every row sets its key, whether there or not; replays change nothing.
    """
    table = BucketedTable(spark, path, key, order, "_tie", "_action", payload, buckets)

    def each(batch: DataFrame, _: int) -> None:
        table.apply(batch.withColumn("_tie", F.lit(0)).withColumn("_action", F.lit(CREATE)))

    return each, table


def percolate(edges: DataFrame, batch: DataFrame) -> DataFrame:
    """id: everything downstream of what a batch of the log touched, itself included: what has to be made anew."""
    start = changed_ids(batch)
    down = graph.khop(edges, start, None).select("id")
    return start.unionByName(down).distinct()


def attempts(stream: DataFrame, key: str, most: int) -> DataFrame:
    """key, attempt, dead: per failed event its number among the key's failures so far; dead from ``most`` on.

    The count is state kept by the engine, so it goes on over batches and restarts.
    """
    import pandas as pd
    from pyspark.sql.streaming.state import GroupStateTimeout

    kind = stream.schema[key].dataType.simpleString()

    def run(group, batches, state):
        seen = state.get[0] if state.exists else 0
        for pdf in batches:
            n = len(pdf)
            yield pd.DataFrame({key: [group[0]] * n, "attempt": range(seen + 1, seen + n + 1), "dead": [i >= most for i in range(seen + 1, seen + n + 1)]})
            seen += n
        state.update((seen,))

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, attempt bigint, dead boolean", "seen bigint", "append", GroupStateTimeout.NoTimeout)
