"""Applying a feed of inserts, updates and deletes to a table (bucketed copy-on-write).

The table is cut into buckets by the key's hash.  A bucket's files hold the winning changes,
one per key and sequence number, sorted by both; the last change of each key also carries
what the key's changes fold to.  A batch is routed to its buckets, its winners are
sort-merged with the files of the touched buckets only, the merged buckets are written as
replacement files under a name nothing else uses, and a new manifest that names them is
committed atomically.  Readers hold one manifest, so they never see half a batch, and of two
writers that start from one version the second fails and leaves nothing behind.  A batch may
be applied again, late, or in any order with the same result, as the merge keys on
(key, sequence).  ``compact`` folds all changes up to a sequence number that will see no more
corrections into one row per key; later arrivals below it are set aside, not lost.

Skew: rows are counted per bucket first.  A bucket within bounds is shuffled once, whole.  A
hot one (a key that holds a third of all rows) is combined per (key, sequence) before its
shuffle, spread over tasks by sequence, and its few partial folds are merged when read.
"""

from __future__ import annotations

import gc
import json
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from weftline.sources import files

CREATE, UPDATE, DELETE = 1, 2, 3

# fixed values: the words writers use for the three kinds of change; a bare object word is a creation
CREATE_WORDS = ("", "create", "created", "add", "added", "insert", "inserted", "new", "put")
UPDATE_WORDS = ("update", "updated", "set", "modify", "modified", "patch", "patched", "change", "changed", "edit", "edited")
DELETE_WORDS = ("delete", "deleted", "remove", "removed", "drop", "dropped", "tombstone", "tombstoned", "del", "erase", "purge")


def change_action(kind: Column) -> Column:
    """CREATE, UPDATE or DELETE from a freely spelled kind such as ``Node_Update`` or ``edge.remove ``.

    Null for a null kind and for words that are none of the known ones.
    """
    words = F.regexp_replace(F.lower(F.trim(kind)), r"[^a-z]+", " ")
    verb = F.trim(F.regexp_replace(words, r"\b(node|edge|vertex|link)s?\b", " "))
    return (
        F.when(verb.isin(*CREATE_WORDS) & (words != " ") & (words != ""), F.lit(CREATE))
        .when(verb.isin(*UPDATE_WORDS), F.lit(UPDATE))
        .when(verb.isin(*DELETE_WORDS), F.lit(DELETE))
    )


#: Rows per bucket when the number of buckets is chosen by size, and the bounds of that number.
BUCKET_ROWS, LEAST_BUCKETS, MOST_BUCKETS = 8_000, 16, 4_096
#: A bucket is hot if a batch brings it so many rows and so many times the mean; it is then spread over up to ``SPREAD`` tasks.
HOT_ROWS, HOT_TIMES, SPREAD = 100_000, 4, 64


def buckets_for(rows: int) -> int:
    """A power of two that leaves about ``BUCKET_ROWS`` rows in a bucket, within bounds."""
    return min(MOST_BUCKETS, max(LEAST_BUCKETS, 1 << max(0, -(-rows // BUCKET_ROWS) - 1).bit_length()))


class BucketedTable:
    """A table under ``path`` that takes change batches by bucketed copy-on-write.

    Rows whose key, order or action is null are ignored, so are columns beyond the declared
    ones.  Of rows equal in key and order the one with the greatest tiebreak counts, then the
    greatest action, then the greatest payload, so the result does not depend on file order.
    Empty and repeated batches are allowed.  ``buckets`` is fixed when the table is created.
    """

    def __init__(self, spark: SparkSession, path: str, key: str, order: str, tiebreak: str, action: str, payload: list[str], buckets: int = 64, hot_rows: int = HOT_ROWS):
        self.spark, self.path, self.hot_rows = spark, path.rstrip("/"), hot_rows
        self.key, self.order, self.tiebreak, self.action, self.payload = key, order, tiebreak, action, list(payload)
        self.columns = list(dict.fromkeys([key, order, tiebreak, action, *payload]))
        self.buckets = buckets
        found = self.manifest()
        if found["version"] and found["buckets_n"] != buckets:
            raise ValueError(f"the table has {found['buckets_n']} buckets, not {buckets}")

    def manifest(self, version: int | None = None) -> dict:
        """The given or the latest committed manifest: bucket number -> name of the files that hold it."""
        names = [n for n in files.list_names(self.spark, f"{self.path}/_manifests") if n.endswith(".json")]
        if version is not None:
            names = [n for n in names if int(n[1:-5]) <= version]
        if not names:
            return {"version": 0, "buckets_n": self.buckets, "gen": {}, "hot": [], "folded_to": None, "late": []}
        return files.read_json(self.spark, f"{self.path}/_manifests/{names[-1]}")

    def _read(self, manifest: dict, buckets=None) -> DataFrame | None:
        paths = [f"{self.path}/log/gen={g}/_bucket={b}" for b, g in manifest["gen"].items() if buckets is None or int(b) in buckets]
        if not paths:
            return None
        schema = StructType.fromJson(json.loads(manifest["schema"])).add("_bucket", "integer")
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/log").parquet(*paths)

    def _winners(self, rows: DataFrame, by: list[str]) -> DataFrame:
        """One change per key and order, with what it adds to the fold (_made, _gone)."""
        rest = [c for c in self.columns if c not in (self.key, self.order, self.tiebreak, self.action)]
        best = F.max(F.struct(F.col(self.tiebreak).alias("t"), F.col(self.action).alias("a"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(rest)]))
        won = rows.groupBy(*by, self.key, self.order).agg(best.alias("_w"))
        act, at = F.col("_w.a"), F.col(self.order)
        return won.select(
            *by, self.key, self.order, F.col("_w.t").alias(self.tiebreak), act.alias(self.action), *[F.col(f"_w.p{i}").alias(c) for i, c in enumerate(rest)],
            F.when(act == CREATE, at).alias("_made"), F.when(act == DELETE, at).alias("_gone"),
        )

    def _marked(self, rows: DataFrame) -> DataFrame:
        """The last change of a key, within its task, carries the key's fold: _tail, _t_made, _t_gone.  Needs (_bucket, _salt) in one task, sorted."""
        keyed = Window.partitionBy("_bucket", "_salt", self.key).orderBy(self.order)
        so_far = keyed.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        last = F.lead(F.lit(1)).over(keyed).isNull()
        return rows.select(
            *rows.columns, last.alias("_tail"), F.when(last, F.max("_made").over(so_far)).alias("_t_made"), F.when(last, F.max("_gone").over(so_far)).alias("_t_gone"),
        ).drop("_salt")

    def _write(self, rows: DataFrame, gen: str) -> dict[str, str]:
        """Write marked rows under a new name: bucket -> name."""
        path = f"{self.path}/log/gen={gen}"
        rows.write.option("compression", "zstd").partitionBy("_bucket").parquet(path)
        return {n.split("=")[1]: gen for n in files.list_names(self.spark, path) if n.startswith("_bucket=")}

    def _settled(self, rows: DataFrame, hot: list[int]) -> DataFrame:
        """Rows with _bucket and _salt, each pair whole in one task and sorted by key and order.

        _salt: 0, or in a hot bucket a number by the sequence, so that such a bucket is spread over several tasks.
        """
        if not hot:
            return rows.repartition("_bucket").sortWithinPartitions("_bucket", self.key, self.order).withColumn("_salt", F.lit(0))
        salt = F.pmod(F.xxhash64(F.col(self.order)), F.lit(SPREAD)).cast("int")
        salted = rows.withColumn("_salt", F.when(F.col("_bucket").isin(hot), salt).otherwise(F.lit(0)))
        return salted.repartition("_bucket", "_salt").sortWithinPartitions("_bucket", "_salt", self.key, self.order)

    def _commit(self, old: dict, gen: dict, rows: DataFrame, **more) -> dict:
        kept = StructType([f for f in rows.schema if f.name not in ("_bucket", "_salt")])
        new = {**old, "version": old["version"] + 1, "buckets_n": self.buckets, "gen": gen, "schema": kept.json(), **more}
        files.commit_json(self.spark, f"{self.path}/_manifests/v{new['version']:09d}.json", new)
        return new

    def apply(self, changes: DataFrame, current: dict | None = None) -> dict:
        """Apply one batch on top of the latest manifest (or of ``current``); returns the committed one, or the old one if the batch has no valid change.

        It is an error if another writer commits in between; nothing is lost then, and the batch can be applied again.
        """
        current = current or self.manifest()
        valid = changes.filter(F.col(self.key).isNotNull() & F.col(self.order).isNotNull() & F.col(self.action).isNotNull())
        routed = valid.select(F.pmod(F.xxhash64(F.col(self.key)), F.lit(self.buckets)).cast("int").alias("_bucket"), *self.columns)
        name, late = uuid.uuid4().hex[:12], list(current["late"])
        if current["folded_to"] is not None:
            below = routed.filter(F.col(self.order) <= current["folded_to"])
            if not below.isEmpty():
                below.write.parquet(f"{self.path}/late/gen={name}")
                late.append(name)
            routed = routed.filter(F.col(self.order) > current["folded_to"])
        sizes = {r[0]: r[1] for r in routed.groupBy("_bucket").count().collect()}  # at most `buckets` rows
        if not sizes:
            return current if late == current["late"] else self._commit(current, current["gen"], self._read(current), late=late)
        limit = max(self.hot_rows, HOT_TIMES * sum(sizes.values()) // self.buckets)
        hot = sorted({b for b, n in sizes.items() if n > limit} | set(current["hot"]) & set(sizes))
        if current["gen"]:
            gen, rows = self._merge(current, routed, sorted(sizes), hot, name)
        else:
            gen, rows = self._load(routed, sizes, hot, name)
        return self._commit(current, dict(current["gen"]) | gen, rows, hot=sorted({*current["hot"], *hot}), late=late)

    def _load(self, routed: DataFrame, sizes: dict, hot: list[int], name: str) -> tuple[dict, DataFrame]:
        """The first batch: buckets within bounds in one shuffle, hot ones combined before theirs."""
        gen: dict = {}
        rows = None
        if len(hot) < len(sizes):
            cold = routed.filter(~F.col("_bucket").isin(hot)) if hot else routed
            rows = self._marked(self._winners(cold.repartition("_bucket"), ["_bucket"]).withColumn("_salt", F.lit(0)))
            gen |= self._write(rows, f"{name}-a")
        if hot:
            won = self._winners(routed.filter(F.col("_bucket").isin(hot)), ["_bucket"])
            rows = self._marked(self._settled(won, hot))
            gen |= self._write(rows, f"{name}-b")
        return gen, rows

    def _merge(self, current: dict, routed: DataFrame, touched: list[int], hot: list[int], name: str) -> tuple[dict, DataFrame]:
        """A batch and the files of the touched buckets; of two changes of one key and order the greater wins.

        Buckets within bounds: both in one shuffle by bucket.  Hot ones: the batch's winners are sort-merged with the files.
        """
        on, gen, rows = ["_bucket", self.key, self.order], {}, None
        cold = sorted(set(touched) - set(hot))
        if cold:
            base = self._read(current, set(cold))
            act, at = F.col(self.action), F.col(self.order)
            new = (routed.filter(~F.col("_bucket").isin(hot)) if hot else routed).withColumns({"_made": F.when(act == CREATE, at), "_gone": F.when(act == DELETE, at)})
            rest = [self.tiebreak, self.action, *[c for c in new.columns if c not in (*on, self.tiebreak, self.action)]]
            both = new.select(*on, *rest) if base is None else base.select(*on, *rest).unionByName(new.select(*on, *rest))
            won = both.repartition("_bucket").groupBy(*on).agg(F.max(F.struct(*rest)).alias("_w")).select(*on, "_w.*")
            rows = self._marked(won.withColumn("_salt", F.lit(0)))
            gen |= self._write(rows, f"{name}-a")
        if hot:
            new = self._winners(routed.filter(F.col("_bucket").isin(hot)), ["_bucket"])
            rest = [c for c in new.columns if c not in on]
            base = self._read(current, set(hot))
            merged = new
            if base is not None:
                held = base.select(*on, F.struct(*rest).alias("_b")).hint("merge").join(new.select(*on, F.struct(*rest).alias("_n")), on, "full_outer")
                wins = F.col("_b").isNull() | (F.col("_n").isNotNull() & (F.col("_n") > F.col("_b")))
                merged = held.select(*on, F.when(wins, F.col("_n")).otherwise(F.col("_b")).alias("_w")).select(*on, "_w.*")
            rows = self._marked(self._settled(merged, hot))
            gen |= self._write(rows, f"{name}-b")
        return gen, rows

    def compact(self, folded_to: int) -> dict:
        """Fold all changes up to ``folded_to`` into one row per key; keys that are gone by then and have no later change are dropped.

        From then on changes up to ``folded_to`` count as late: they are kept aside under ``late``.
        """
        current = self.manifest()
        rows = self._read(current)
        if rows is None:
            return current
        old = F.col(self.order) <= folded_to
        rest = [c for c in self.columns if c not in (self.key, self.order)]
        names = {c: f"p{i}" for i, c in enumerate(rest)}
        last = F.max(F.struct(F.col(self.order).alias("o"), *[F.col(c).alias(x) for c, x in names.items()]))
        folded = rows.filter(old).groupBy("_bucket", self.key).agg(F.max("_made").alias("_made"), F.max("_gone").alias("_gone"), last.alias("_l"))
        later = rows.filter(~old).select("_bucket", self.key).distinct().withColumn("_later", F.lit(True))
        there = F.col("_made").isNotNull() & (F.col("_gone").isNull() | (F.col("_made") > F.col("_gone")))
        folded = folded.join(later, ["_bucket", self.key], "left").filter(there | F.col("_later").isNotNull())
        columns = ["_bucket", self.key, self.order, *rest, "_made", "_gone"]
        one = folded.select("_bucket", self.key, F.col("_l.o").alias(self.order), *[F.col(f"_l.{x}").alias(c) for c, x in names.items()], "_made", "_gone")
        kept = self._marked(self._settled(one.unionByName(rows.filter(~old).select(*columns)), current["hot"]))
        gen = self._write(kept, uuid.uuid4().hex[:12])
        return self._commit(current, gen, kept, folded_to=max(folded_to, current["folded_to"] or folded_to))

    def vacuum(self, versions: int = 1) -> int:
        """Remove files that none of the last ``versions`` manifests names, and older manifests; returns how many sets of files went."""
        latest = self.manifest()["version"]
        held = {g for v in range(max(1, latest - versions + 1), latest + 1) for g in self.manifest(v)["gen"].values()}
        gone = [n for n in files.list_names(self.spark, f"{self.path}/log") if n.startswith("gen=") and n[4:] not in held]
        for n in files.list_names(self.spark, f"{self.path}/_manifests"):
            if n.endswith(".json") and int(n[1:-5]) <= latest - versions:
                files.remove(self.spark, f"{self.path}/_manifests/{n}")
        for n in gone:
            files.remove(self.spark, f"{self.path}/log/{n}")
        return len(gone)

    def state(self, version: int | None = None) -> DataFrame | None:
        """The present entities as of a manifest (the latest by default); None for a table never written.

        A key is present if its last creation comes after its last deletion; every later change
        is then an update that took effect, so its last change of all is the one shown.
        """
        manifest = self.manifest(version)
        rows = self._read(manifest)
        if rows is None:
            return None
        shown = list(dict.fromkeys([self.key, self.order, *self.payload]))
        rest = [c for c in shown if c not in (self.key, self.order)]
        there = F.col("_t_made").isNotNull() & (F.col("_t_gone").isNull() | (F.col("_t_made") > F.col("_t_gone")))
        tails, hot = rows.filter("_tail"), manifest["hot"]
        parts = [(tails.filter(~F.col("_bucket").isin(hot)) if hot else tails).filter(there).select(*shown)]
        if hot:
            last = F.max(F.struct(F.col(self.order).alias("o"), *[F.col(c).alias(f"p{i}") for i, c in enumerate(rest)]))
            few = tails.filter(F.col("_bucket").isin(hot)).groupBy(self.key).agg(F.max("_t_made").alias("_t_made"), F.max("_t_gone").alias("_t_gone"), last.alias("_l"))
            parts.append(few.filter(there).select(self.key, F.col("_l.o").alias(self.order), *[F.col(f"_l.p{i}").alias(c) for i, c in enumerate(rest)]).select(*shown))
        return reduce(DataFrame.unionByName, parts)


#: Share of the feed that is loaded before the first batch is merged into it.
BASE = 0.25


def apply_feed(spark: SparkSession, feed: DataFrame, path: str, buckets: int | None = None, payload=("label", "from_id", "to_id", "properties", "wall_time"), hot_rows: int = HOT_ROWS) -> DataFrame:
    """Rebuild the state of a graph from its change feed: event_id, seq of the last change that took effect, payload.

    The feed is taken as it came in (by ingest_time): the first quarter is loaded as the base, all
    else but the last arrivals is one batch that is merged into it, and the last ones (about one
    per sixteen buckets) are another, which rewrites only the few buckets that it touches.  Where
    the cuts lie changes nothing about the result.
    Rows without seq or event_id, and rows of unknown kind, are ignored.  An empty feed gives
    an empty frame.
    """
    feed = feed.select("event_id", "seq", "ingest_time", change_action(F.col("kind")).alias("_action"), *[c for c in payload if c not in ("event_id", "seq", "ingest_time")])
    n, base = feed.agg(F.count(F.lit(1)), F.percentile_approx("ingest_time", BASE, 1_000)).first()
    buckets = buckets or buckets_for(n)
    table = BucketedTable(spark, path, "event_id", "seq", "ingest_time", "_action", list(payload), buckets, hot_rows)
    few = max(1, buckets // 16)
    last = [r[0] for r in feed.select("ingest_time").filter("ingest_time is not null").orderBy(F.desc("ingest_time")).limit(few + 1).collect()]  # by the number of buckets
    at = F.col("ingest_time")
    if len(last) == few + 1 and base < last[few]:
        slices = [at.isNull() | (at <= F.lit(base)), (at > F.lit(base)) & (at <= F.lit(last[few])), at > F.lit(last[few])]
    else:
        slices = [F.lit(True)]
    for taken in slices:
        table.apply(feed.filter(taken))
        gc.collect()
        spark.sparkContext._jvm.System.gc()  # Spark then removes the shuffle files of what is written
    found = table.state()
    return found if found is not None else feed.select("event_id", "seq", *payload).limit(0)
