"""Text queries over documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import text
from weftline.session import load


def _docs(spark, d):
    return load(spark, d, "documents")


def txt_normalize(spark, d):
    t = text.normalize(F.col("text"))
    return _docs(spark, d).select("doc_id", F.length(t).alias("n"), F.sha2(F.encode(t, "utf-8"), 256).alias("sha"))


def txt_sentence_spans(spark, d):
    s = _docs(spark, d).select("doc_id", text.normalize(F.col("text")).alias("t")).select("doc_id", "t", F.explode(text.spans(F.col("t"))).alias("s"))
    return s.groupBy("doc_id").agg(F.count(F.lit(1)).alias("sentences"), F.sum(F.col("s.end") - F.col("s.start")).alias("covered"))


def txt_paragraphs(spark, d):
    p = F.filter(F.split(text.normalize(F.col("text")), r"\n\n"), lambda x: F.trim(x) != "")
    return _docs(spark, d).filter("text is not null").select("doc_id", F.size(p).alias("paragraphs"))


def txt_entities_cooccur(spark, d):
    return text.cooccurrence(_docs(spark, d), "doc_id", "text")


def txt_template_extract(spark, d):
    found = text.template_extract(_docs(spark, d), ["doc_id"], "text", {"step": "Step {n:number}: open the {what:word}, wait", "receipt": "Receipt {n:number} links this {what:word} to"})
    return found.select("doc_id", "template", F.col("variables")["n"].alias("n"), F.col("variables")["what"].alias("what"), F.round("confidence", 2).alias("confidence"))


def txt_exact_dup(spark, d):
    return text.exact_copies(_docs(spark, d), "doc_id", "text").filter("copies > 1")


def txt_html_to_text(spark, d):
    """Every document with a page around it, back to text."""
    docs = _docs(spark, d).withColumn("text", F.concat(F.lit("<html><style>p{}</style><p>"), "text", F.lit("</p><p>end &amp; out</p></html>")))
    return docs.select("doc_id", text.html_to_text(F.col("text")).alias("plain"))


def txt_parse_figure(spark, d):
    """Order totals written in several styles, read back."""
    o = load(spark, d, "orders").select("o_orderkey", "o_totalprice")
    style = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("$"), F.format_number("o_totalprice", 2))).when(F.col("o_orderkey") % 3 == 1, F.concat(F.lit("("), F.format_number("o_totalprice", 2), F.lit(")"))).otherwise(F.concat(F.format_number(F.round("o_totalprice"), 0), F.lit(" k")))
    return o.select("o_orderkey", F.round(text.parse_figure(style), 2).alias("figure"))


_NORM = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)[ \\t]+$', '', 'g'), '\\n{3,}', chr(10) || chr(10), 'g'), '^\\s+|\\s+$', '', 'g')"

#: The same steps over any SQL expression.
def _norm_of(x):
    return _NORM.replace("(text,", f"({x},")


_PLAIN = "regexp_replace('<html><style>p{}</style><p>' || text || '</p><p>end &amp; out</p></html>', '<script\\b.*?</script\\s*>|<style\\b.*?</style\\s*>|<!--.*?-->', ' ', 'gis')"
_PLAIN = f"regexp_replace(regexp_replace({_PLAIN}, '<br\\s*/?>|</(p|div|h[1-6]|li|tr|table|ul|ol)\\s*>', chr(10), 'gi'), '</?[A-Za-z][^<>]*>', '', 'g')"
for _entity, _sign in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&amp;", "&")):
    _PLAIN = f"replace({_PLAIN}, '{_entity}', '{_sign}')"
_SPANS = f"""WITH p AS (SELECT doc_id, unnest(string_split({_NORM}, chr(10) || chr(10))) AS p FROM documents WHERE text IS NOT NULL), s AS (SELECT doc_id, trim(unnest(string_split(regexp_replace(p, '([.!?])[\\s\\pZ\\x{{0b}}\\x{{1c}}-\\x{{1f}}\\x{{85}}]+', '\\1' || chr(1), 'g'), chr(1))), ' ' || chr(9) || chr(10) || chr(160)) AS s FROM p)
SELECT doc_id, count(*) AS sentences, sum(length(s))::BIGINT AS covered FROM s WHERE s <> '' GROUP BY 1"""

QUERIES = {
    "txt_normalize": (txt_normalize, f"SELECT doc_id, length({_NORM})::INT AS n, sha256({_NORM}) AS sha FROM documents"),
    "txt_sentence_spans": (txt_sentence_spans, _SPANS),
    "txt_paragraphs": (txt_paragraphs, f"SELECT doc_id, len(list_filter(string_split({_NORM}, chr(10) || chr(10)), lambda x: trim(x) <> ''))::INT AS paragraphs FROM documents WHERE text IS NOT NULL"),
    "txt_entities_cooccur": (txt_entities_cooccur, None),
    "txt_template_extract": (txt_template_extract, """WITH s AS (SELECT doc_id, 'step' AS template, unnest(regexp_extract_all(text, 'Step [-+]?\\d+(?:[.,]\\d+)*: open the \\p{L}+, wait')) AS m FROM documents UNION ALL SELECT doc_id, 'receipt', unnest(regexp_extract_all(text, 'Receipt [-+]?\\d+(?:[.,]\\d+)* links this \\p{L}+ to')) FROM documents)
SELECT doc_id, template, regexp_extract(m, '([-+]?\\d+(?:[.,]\\d+)*)', 1) AS n, CASE template WHEN 'step' THEN regexp_extract(m, 'the (\\p{L}+), wait', 1) ELSE regexp_extract(m, 'this (\\p{L}+) to', 1) END AS what, 0.7::DOUBLE AS confidence FROM s"""),
    "txt_exact_dup": (txt_exact_dup, f"WITH h AS (SELECT doc_id, sha256({_NORM}) AS h FROM documents WHERE text IS NOT NULL), c AS (SELECT h, min(doc_id) AS class_id, count(*) AS copies FROM h GROUP BY 1 HAVING count(*) > 1) SELECT doc_id, class_id, copies FROM h JOIN c USING (h)"),
    "txt_html_to_text": (txt_html_to_text, f"SELECT doc_id, {_norm_of(f"regexp_replace({_PLAIN}, '[ ' || chr(9) || ']+', ' ', 'g')")} AS plain FROM documents"),
    "txt_parse_figure": (txt_parse_figure, "SELECT o_orderkey, round(CASE o_orderkey % 3 WHEN 0 THEN o_totalprice WHEN 1 THEN -o_totalprice ELSE round(o_totalprice) * 1000 END, 2) AS figure FROM orders"),
}
