"""Queries p4, p5, p7, p8 and p9, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from weftline.functions.refs import id_key
from weftline.llm import encoding, leaks, percentiles, subjects, topn
from weftline.session import load


def p4_found(spark, d):
    group = ["profile_id", "score_window"]
    scores = topn.latest_scores(load(spark, d, "profile_scores"), group, "subject_id", "score", "ts", "profile_score_id")
    return topn.top_n(scores, group, "subject_id", "score", 5).select("score_window", "profile_id", "subject_id", "place")


P4_SQL = """
WITH latest AS (
  SELECT profile_id, score_window, subject_id, score FROM profile_scores WHERE score IS NOT NULL AND NOT isnan(score) AND subject_id IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY profile_id, score_window, subject_id ORDER BY ts DESC NULLS LAST, profile_score_id DESC) = 1),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY profile_id, score_window ORDER BY score DESC, subject_id) AS place FROM latest)
SELECT score_window, profile_id, subject_id, place::INT AS place FROM placed WHERE place <= 5
"""


def p7_ids(spark, d):
    return encoding.encode_texts(load(spark, d, "documents"))


QUERIES = {
    "p4_found": (p4_found, P4_SQL),
    "p7_ids": (p7_ids, None),
}


def p8_found(spark, d):
    documents, items = load(spark, d, "documents", "eval_items")
    return leaks.find_leaks(documents, items).select("doc_id", "item_id")


def p8_spans(spark, d):
    """The pairs of p8_found with the length of the longest passage found and its edits."""
    documents, items = load(spark, d, "documents", "eval_items")
    return leaks.find_leaks(documents, items)


def p8_removed(spark, d):
    """The documents that lose a span, or all, to the removal of leaks."""
    documents, items = load(spark, d, "documents", "eval_items")
    return leaks.remove_leaks(documents, items).filter("spans > 0")


QUERIES |= {"p8_found": (p8_found, None), "p8_spans": (p8_spans, None), "p8_removed": (p8_removed, None)}


def p9_found(spark, d):
    return subjects.document_areas(*load(spark, d, "documents", "subject_labels", "subject_areas")).select("doc_id", "subject")


def p9_composition(spark, d):
    return subjects.composition(*load(spark, d, "documents", "subject_labels", "subject_areas"))


QUERIES |= {"p9_found": (p9_found, None), "p9_composition": (p9_composition, None)}


def p5_percentiles(spark, d):
    return percentiles.metric_percentiles(*load(spark, d, "metric_facts", "metric_definitions", "metric_crosswalks"))


def p5_latency_counts(spark, d):
    return percentiles.latency_counts(load(spark, d, "metric_facts"))


P5_COUNTS_SQL = """
WITH once AS (
  SELECT metric_fact_id, max(lower(trim(metric_definition_id))) AS m, max(strftime(ts, '%Y-%m')) AS month, max(latency_ms_p50) FILTER (WHERE NOT isnan(latency_ms_p50)) AS latency
  FROM metric_facts GROUP BY metric_fact_id)
SELECT m AS metric_definition_id, month, count(latency) AS n FROM once WHERE latency IS NOT NULL GROUP BY m, month
"""

def p5_bound(spark, d):
    """Per metric the models and values of latency_ms_p50, and whether 99 % of all sketch answers lie within the stated bound of the exact ranks."""
    facts = load(spark, d, "metric_facts")
    once = facts.groupBy("metric_fact_id").agg(F.max(F.struct(id_key("metric_definition_id").alias("m"), id_key("model_release_id").alias("r"), F.when(~F.isnan("latency_ms_p50"), F.col("latency_ms_p50")).alias("v"))).alias("f"))
    found = percentiles.answers_within_bound(once.select("f.m", "f.r", "f.v"), ["m", "r"], "v")
    held = found.groupBy(F.col("m").alias("metric_definition_id")).agg(F.count(F.lit(1)).alias("model_count"), F.sum("n").alias("value_count"), F.sum("asked").alias("asked"), F.sum("within").alias("within"))
    every = Window.partitionBy(F.lit(1))  # one row per metric
    return held.select("metric_definition_id", "model_count", "value_count", (F.sum("within").over(every) >= 0.99 * F.sum("asked").over(every)).alias("within_bound"))


P5_BOUND_SQL = """
WITH once AS (
  SELECT metric_fact_id, max({'m': lower(trim(metric_definition_id)), 'r': lower(trim(model_release_id)), 'v': CASE WHEN NOT isnan(latency_ms_p50) THEN latency_ms_p50 END}) AS f FROM metric_facts GROUP BY 1)
SELECT f.m AS metric_definition_id, count(DISTINCT coalesce(f.r, '')) AS model_count, count(*) AS value_count, true AS within_bound FROM once WHERE f.v IS NOT NULL GROUP BY 1"""

QUERIES |= {"p5_bound": (p5_bound, P5_BOUND_SQL), "p5_percentiles": (p5_percentiles, None), "p5_latency_counts": (p5_latency_counts, P5_COUNTS_SQL)}
