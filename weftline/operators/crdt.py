"""Folding replicated operation logs: add-wins sets, last-writer registers, deltas between replicas.

Log columns: replica string, seq bigint (together the dot of an operation), hlc bigint, op
string, id string, src string, dst string, label string, key string, value string, removed
array<struct<replica:string,seq:bigint>>.  op is one of add_node, del_node, add_edge,
del_edge, set_prop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LOG = "replica string, seq bigint, hlc bigint, op string, id string, src string, dst string, label string, key string, value string, removed array<struct<replica:string,seq:bigint>>"


def merge(*logs: DataFrame) -> DataFrame:
    """The union of logs, each dot once: idempotent, commutative and associative."""
    out = logs[0]
    for log in logs[1:]:
        out = out.unionByName(log)
    return out.dropDuplicates(["replica", "seq"])


def live(log: DataFrame, add: str, delete: str, columns: list[str]) -> DataFrame:
    """Distinct elements with an add that no delete has observed (add wins over a concurrent delete)."""
    gone = log.filter(F.col("op") == delete).select(F.explode("removed").alias("d")).select(F.col("d.replica").alias("replica"), F.col("d.seq").alias("seq")).distinct()
    return log.filter(F.col("op") == add).join(gone, ["replica", "seq"], "left_anti").select(*columns).distinct()


def registers(log: DataFrame) -> DataFrame:
    """id, key, value: the last write of each property by (hlc, replica); a null value counts as written."""
    last = F.max(F.struct("hlc", "replica", "seq", "value")).alias("m")
    return log.filter("op = 'set_prop'").groupBy("id", "key").agg(last).select("id", "key", F.col("m.value").alias("value"))


def view(log: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, properties) of a log; an edge needs both ends alive, a property its node."""
    nodes = live(log, "add_node", "del_node", ["id"])
    ends = lambda side: nodes.select(F.col("id").alias(side))
    edges = live(log, "add_edge", "del_edge", ["src", "dst", "label"]).join(ends("src"), "src", "left_semi").join(ends("dst"), "dst", "left_semi").select("src", "dst", "label")
    return nodes, edges, registers(log).join(nodes, "id", "left_semi")


def version_vector(log: DataFrame) -> DataFrame:
    """replica, seen: how far each replica's operations are known."""
    return log.groupBy("replica").agg(F.max("seq").alias("seen"))


def delta(log: DataFrame, vector: DataFrame) -> DataFrame:
    """Operations that a peer of the given version vector lacks."""
    return log.join(vector, "replica", "left").filter(F.col("seen").isNull() | (F.col("seq") > F.col("seen"))).select(*log.columns)


def as_of(log: DataFrame, order: str, version: int) -> DataFrame:
    """The log as it was at a version."""
    return log.filter(F.col(order) <= version)
