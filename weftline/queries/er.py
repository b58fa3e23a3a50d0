"""Entity resolution over customers and a second, noisy list of the same people."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import er
from weftline.session import load

PARTS = ("bal", "cor", "dro", "ela", "fen", "gar", "hul", "isa", "jor", "kel", "lum", "mar", "nov", "ori", "pel", "quin", "ras", "sel", "tor", "var")


def _word(key, salt):
    parts = F.array(*[F.lit(p) for p in PARTS])
    pick = lambda k: F.element_at(parts, (F.pmod(F.floor(key / k) * 7 + salt, F.lit(20)) + 1).cast("int"))
    return F.initcap(F.concat(pick(1), pick(20), pick(400)))


def records(spark, d):
    """Two records per customer: the list's own, and one with a letter dropped, swapped or upper case by key."""
    c = load(spark, d, "customer").select(F.col("c_custkey").alias("k"), "c_nationkey", "c_mktsegment")
    name = F.concat_ws(" ", _word(F.col("k"), 3), _word(F.floor(F.col("k") / 3), 11))
    base = c.select(F.concat(F.lit("a"), F.lpad(F.col("k").cast("string"), 9, "0")).alias("id"), "k", name.alias("name"), "c_nationkey", "c_mktsegment", F.lit("process").alias("scope"))
    noisy = F.when(F.col("k") % 3 == 0, F.expr("concat(substring(name, 1, 6), substring(name, 8))")).when(F.col("k") % 3 == 1, F.upper("name")).otherwise(F.concat(F.lit(" "), F.regexp_replace("name", " ", "   ")))
    other = base.select(F.concat(F.lit("b"), F.substring("id", 2, 9)).alias("id"), "k", noisy.alias("name"), "c_nationkey", "c_mktsegment", F.lit("cloud").alias("scope"))
    return base.unionByName(other).select(
        "id", "name", F.create_map(F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("email"), F.concat(F.lit("u"), F.col("k").cast("string"), F.lit("@example.org"))).alias("attributes"),
        "scope", F.array(F.col("c_mktsegment")).alias("primes"),
    )


def er_block_pairs(spark, d):
    return er.block_pairs(records(spark, d))


def er_score(spark, d):
    return er.score_blocks(records(spark, d)).filter("decision <> 'NO_MATCH'").select("a", "b", "score", "decision")


def er_clusters(spark, d):
    return er.resolve(records(spark, d))


def er_golden(spark, d):
    r = records(spark, d)
    g = er.golden(r, er.resolve(r))
    return g.select("entity", "survivor", "name", "members", F.col("attributes")["email"].alias("email"))


def er_incremental(spark, d):
    """The first list is known; the second comes new."""
    r = records(spark, d)
    return er.resolve(r, r.filter("id like 'a%'").select("id"))


_P = ", ".join(f"'{p}'" for p in PARTS)


def _w(key, salt):
    pick = lambda k: f"([{_P}])[(({key}) // {k} * 7 + {salt}) % 20 + 1]"
    text = f"({pick(1)} || {pick(20)} || {pick(400)})"
    return f"upper({text}[1]) || {text}[2:]"


_RECORDS = f"""base AS (SELECT c_custkey AS k, c_nationkey AS nation, c_mktsegment AS seg, {_w('c_custkey', 3)} || ' ' || {_w('c_custkey // 3', 11)} AS name FROM customer),
r AS (SELECT 'a' || lpad(k::VARCHAR, 9, '0') AS id, name FROM base UNION ALL SELECT 'b' || lpad(k::VARCHAR, 9, '0'), CASE k % 3 WHEN 0 THEN name[1:6] || name[8:] WHEN 1 THEN upper(name) ELSE ' ' || replace(name, ' ', '   ') END FROM base),
n AS (SELECT id, regexp_replace(trim(lower(name)), '\\s+', ' ', 'g') AS name FROM r),
bk AS (SELECT id, name[1:3] || '|' || (list_sort(list_filter(string_split_regex(name, '[^\\w]+'), lambda w: w <> ''))[1])[1:4] AS b FROM n)"""

QUERIES = {
    "er_block_pairs": (er_block_pairs, f"WITH {_RECORDS} SELECT x.id AS a, y.id AS b FROM bk x JOIN bk y ON x.b = y.b AND x.id < y.id"),
    "er_score": (er_score, None),
    "er_clusters": (er_clusters, "SELECT 'a' || lpad(c_custkey::VARCHAR, 9, '0') AS id, 'a' || lpad(c_custkey::VARCHAR, 9, '0') AS entity FROM customer UNION ALL SELECT 'b' || lpad(c_custkey::VARCHAR, 9, '0'), 'a' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer"),
    "er_golden": (er_golden, f"WITH {_RECORDS} SELECT 'a' || lpad(k::VARCHAR, 9, '0') AS entity, 'a' || lpad(k::VARCHAR, 9, '0') AS survivor, name, 2 AS members, 'u' || k || '@example.org' AS email FROM base"),
    "er_incremental": (er_incremental, "SELECT 'a' || lpad(c_custkey::VARCHAR, 9, '0') AS id, 'a' || lpad(c_custkey::VARCHAR, 9, '0') AS entity FROM customer UNION ALL SELECT 'b' || lpad(c_custkey::VARCHAR, 9, '0'), 'a' || lpad(c_custkey::VARCHAR, 9, '0') FROM customer"),
}
