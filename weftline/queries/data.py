"""Queries p1, p2, p3 and p6 over the domain tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.operators import changes, nested, orphans, units
from weftline.session import fresh_path, load


def p1_found(spark, d):
    state = changes.apply_feed(spark, load(spark, d, "hellgraph_events"), fresh_path(spark, "graph"))
    return state.select("event_id", "seq")


P1_SQL = """
WITH words AS (
  SELECT event_id, seq, ingest_time, trim(regexp_replace(lower(trim(kind)), '[^a-z]+', ' ', 'g')) AS w FROM hellgraph_events
  WHERE event_id IS NOT NULL AND seq IS NOT NULL AND kind IS NOT NULL),
acts AS (
  SELECT event_id, seq, ingest_time,
    CASE WHEN w IN ('node', 'edge') OR regexp_matches(w, '(^| )(create|add|insert)$') THEN 1
         WHEN regexp_matches(w, '(^| )(update|set|modify|patch)$') THEN 2
         WHEN regexp_matches(w, '(^| )(delete|remove|drop|tombstone)$') THEN 3 END AS act FROM words),
won AS (
  SELECT event_id, seq, act FROM acts WHERE act IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY event_id, seq ORDER BY ingest_time DESC, act DESC) = 1)
SELECT event_id, max(seq) AS seq FROM won GROUP BY event_id
HAVING max(CASE WHEN act = 1 THEN seq END) > coalesce(max(CASE WHEN act = 3 THEN seq END), -9223372036854775808)
"""


def p3_found(spark, d):
    return nested.record_links(load(spark, d, "fired_records"))


def p3_tables(spark, d):
    """Rows of every flat table that the schema graph calls for, each received record counted once."""
    rows = nested.flatten(load(spark, d, "fired_records"), nested.FIRED_LINKS, with_columns=False).rows
    once = rows.select("record_id", "body_id", "row_no", "table_name", "parent_table").distinct()
    return once.groupBy("table_name", "parent_table").agg(F.count(F.lit(1)).alias("row_count"), F.countDistinct("record_id").alias("record_count"))


def p3_actions(spark, d):
    """The typed table of actions, as commands per target."""
    held = nested.flatten(load(spark, d, "fired_records"), nested.FIRED_LINKS, only=("actions",)).table("actions")
    return held.groupBy("command", "target_node_id").agg(F.count(F.lit(1)).alias("action_count"), F.countDistinct("record_id").alias("record_count"))


def _snake(k):
    return rf"trim(lower(regexp_replace(regexp_replace({k}, '([a-z0-9])([A-Z])', '\1_\2', 'g'), '[^0-9A-Za-z]+', '_', 'g')), '_')"


def _plain(v, name):
    """SQL: the text of a field of a JSON object, whatever its style of names; null for objects, lists and logical values."""
    held = f"""[json_extract({v}, '$."' || k || '"') for k in json_keys({v}) if {_snake("k")} = '{name}'][1]"""
    return f"CASE WHEN json_type({held}) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE') THEN json_extract_string({held}, '$') END"


#: Every object and value of every body with its holder (p), the holder's holder (pp) and the id of the nearest enclosing action (in a list, which is null outside actions).
_P3 = rf"""
WITH RECURSIVE bodies AS (SELECT DISTINCT record_id, body FROM fired_records WHERE json_valid(body)),
nodes AS (
  SELECT record_id, 'record' AS name, body::JSON AS v, '{{}}'::JSON AS p, '{{}}'::JSON AS pp, NULL::VARCHAR[] AS act FROM bodies
  UNION ALL
  SELECT record_id, name, CASE WHEN json_type(w) = 'VARCHAR' AND regexp_matches(w->>'$', '^\s*[{{\[]') AND json_valid(w->>'$') THEN (w->>'$')::JSON ELSE w END AS v, p, pp, act
  FROM (
    SELECT n.record_id, n.name, unnest(n.v::JSON[]) AS w, n.p, n.pp, n.act FROM nodes n WHERE json_type(n.v) = 'ARRAY'
    UNION ALL
    SELECT record_id, {_snake("k")}, json_extract(v, '$."' || k || '"'), v, p, CASE WHEN name = 'actions' THEN [{_plain("v", "action_id")}] ELSE act END
    FROM (SELECT n.*, unnest(json_keys(n.v)) AS k FROM nodes n WHERE json_type(n.v) = 'OBJECT'))
  WHERE json_type(w) <> 'NULL')
"""
P3_SQL = _P3 + f"""
SELECT DISTINCT * FROM (
  SELECT record_id, 'action' AS link, CASE WHEN act IS NULL THEN {_plain("p", "routine_id")} ELSE act[1] END AS parent_id, {_plain("v", "action_id")} AS child_id FROM nodes WHERE name = 'actions' AND json_type(v) = 'OBJECT'
  UNION ALL SELECT record_id, 'policy_ref', {_plain("pp", "decision_id")}, json_extract_string(v, '$') FROM nodes WHERE name = 'policy_refs' AND json_type(v) IN ('VARCHAR', 'BIGINT', 'UBIGINT', 'DOUBLE')
  UNION ALL SELECT record_id, 'strategy', {_plain("p", "profile_id")}, {_plain("v", "strategy")} FROM nodes WHERE name = 'declarative_updates' AND json_type(v) = 'OBJECT')
WHERE parent_id IS NOT NULL AND child_id IS NOT NULL"""
P3_ACTIONS_SQL = _P3 + f"""
SELECT command, target_node_id, count(*) AS action_count, count(DISTINCT record_id) AS record_count FROM (
  SELECT record_id, {_plain("v", "command")} AS command, {_plain("v", "target_node_id")} AS target_node_id FROM nodes WHERE name = 'actions' AND json_type(v) = 'OBJECT') GROUP BY ALL"""

TARGETS = {"run_id": "eval_runs", "context_slice_id": "context_slices", "source_descriptor_id": "source_descriptors"}


def _targets(spark, d):
    return {f: (load(spark, d, t), f) for f, t in TARGETS.items()}


def p6_found(spark, d):
    found = orphans.orphan_references(load(spark, d, "metric_facts"), _targets(spark, d))
    return found.select(F.col("fact_id").alias("metric_fact_id"), F.col("field").alias("ref_field"), F.col("state").alias("ref_state"))


def p6_report(spark, d):
    return orphans.orphan_report(load(spark, d, "metric_facts"), _targets(spark, d), TARGETS)


_P6 = """
WITH refs AS (
  SELECT metric_fact_id, ts, 'run_id' AS ref_field, lower(trim(run_id)) AS k FROM metric_facts
  UNION ALL SELECT metric_fact_id, ts, 'context_slice_id', lower(trim(context_slice_id)) FROM metric_facts
  UNION ALL SELECT metric_fact_id, ts, 'source_descriptor_id', lower(trim(source_descriptor_id)) FROM metric_facts),
real_refs AS (SELECT * FROM refs WHERE k IS NOT NULL AND k NOT IN ('', 'none', 'n/a', '-', 'unknown')),
targets AS (
  SELECT 'run_id' AS ref_field, lower(trim(run_id)) AS k, min(created_at) AS created, bool_and(deleted_at IS NOT NULL) AS gone FROM eval_runs GROUP BY ALL
  UNION ALL SELECT 'context_slice_id', lower(trim(context_slice_id)), min(created_at), bool_and(deleted_at IS NOT NULL) FROM context_slices GROUP BY ALL
  UNION ALL SELECT 'source_descriptor_id', lower(trim(source_descriptor_id)), min(created_at), bool_and(deleted_at IS NOT NULL) FROM source_descriptors GROUP BY ALL),
states AS (
  SELECT DISTINCT metric_fact_id, r.ts, r.ref_field, CASE WHEN t.k IS NULL THEN 'missing' WHEN t.gone THEN 'deleted' WHEN t.created > r.ts THEN 'late' END AS ref_state
  FROM real_refs r LEFT JOIN targets t ON t.ref_field = r.ref_field AND t.k = r.k)
"""
P6_SQL = _P6 + "SELECT DISTINCT metric_fact_id, ref_field, ref_state FROM states WHERE ref_state IS NOT NULL"
P6_REPORT_SQL = _P6 + """
SELECT CASE ref_field WHEN 'run_id' THEN 'eval_runs' WHEN 'context_slice_id' THEN 'context_slices' ELSE 'source_descriptors' END AS ref_table,
  strftime(ts, '%Y-%m') AS month, ref_state, count(*) AS orphans FROM states WHERE ref_state IS NOT NULL GROUP BY ALL"""

QUERIES = {
    "p1_found": (p1_found, P1_SQL),
    "p3_found": (p3_found, P3_SQL),
    "p3_tables": (p3_tables, None),
    "p3_actions": (p3_actions, P3_ACTIONS_SQL),
    "p6_found": (p6_found, P6_SQL),
    "p6_report": (p6_report, P6_REPORT_SQL),
}


def _metric_tables(spark, d):
    return load(spark, d, "metric_facts", "metric_definitions", "metric_crosswalks")


def p2_found(spark, d):
    return units.recorded_elsewhere(*_metric_tables(spark, d))


#: A third of the facts, by their id: their texts' statements are withheld from the model.
HIDDEN = "substring(md5(metric_fact_id), 1, 1) in ('0', '1', '2', '3', '4')"


def p2_hidden(spark, d):
    """Per quantity: facts whose statements were withheld, and whether the model still gave 95 % of all of them the stated unit."""
    rows = units.common_units(*_metric_tables(spark, d), {"scalar": "value_scalar"}, HIDDEN).filter("hidden and quantity is not null and scalar is not null and not isnan(scalar)")
    same = F.abs(F.col("stated_size") / F.col("size") - 1) < 1e-9
    held = rows.groupBy("quantity").agg(F.count(F.lit(1)).alias("hidden_count"), F.count_if(same).alias("right"))
    every = Window.partitionBy(F.lit(1))  # one row per quantity
    return held.select("quantity", "hidden_count", (F.sum("right").over(every) >= 0.95 * F.sum("hidden_count").over(every)).alias("recovered"))


P2_HIDDEN_SQL = """
SELECT CASE WHEN m LIKE '%_spend' THEN 'money' WHEN m LIKE '%_footprint' THEN 'memory' WHEN m LIKE '%_text_volume' THEN 'tokens'
  WHEN m LIKE '%_exactness' OR m LIKE '%_share' THEN 'share' ELSE 'time' END AS quantity, count(*) AS hidden_count, true AS recovered
FROM (SELECT lower(trim(metric_definition_id)) AS m FROM metric_facts WHERE value_scalar IS NOT NULL AND NOT isnan(value_scalar) AND substr(md5(metric_fact_id), 1, 1) < '5')
WHERE m IN (SELECT lower(trim(metric_definition_id)) FROM metric_definitions) GROUP BY 1"""

QUERIES |= {"p2_found": (p2_found, None), "p2_hidden": (p2_hidden, P2_HIDDEN_SQL)}
