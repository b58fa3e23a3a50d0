"""Search queries over documents and embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import search
from weftline.session import load

ASKED = [(1, "reconciled ledger hedge"), (2, "photon yield spectrum"), (3, "covenant clause of the contract"), (4, "Impfung und Diagnose"), (5, "zzzz")]
_ASKED = "(VALUES " + ", ".join(f"({i}, '{q}')" for i, q in ASKED) + ") q(query_id, query)"


def _queries(spark):
    return spark.createDataFrame(ASKED, "query_id int, query string")


def search_bm25(spark, d):
    found = search.bm25(load(spark, d, "documents"), _queries(spark))
    return found.select("query_id", "doc_id", F.round("score", 5).alias("score"))


def search_bm25_top(spark, d):
    scored = search.bm25(load(spark, d, "documents"), _queries(spark)).withColumn("score", F.round("score", 5))
    return search.top_k(scored, "query_id", "doc_id", "score", 10)


def search_token_overlap(spark, d):
    return search.token_overlap(load(spark, d, "documents"), "the ledger record of a reconciled hedge", F.col("text")).select("doc_id", F.round("score", 6).alias("score"))


def _embedded(spark, d):
    e = load(spark, d, "embeddings")
    return e, e.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "embedding")


def search_cosine_topk(spark, d):
    """The stated query set (ids divisible by 50) against all rows."""
    base, asked = _embedded(spark, d)
    return search.vector_top_k(base, asked, 10).select("query_id", "vec_id", F.round("similarity", 5).alias("similarity"))


def search_neighbour_purity(spark, d):
    base, asked = _embedded(spark, d)
    near = search.vector_top_k(base, asked, 11).filter("vec_id <> query_id")
    own = base.select(F.col("vec_id").alias("query_id"), F.col("label").alias("own"))
    return near.join(base.select("vec_id", "label"), "vec_id").join(own, "query_id").groupBy("query_id").agg(F.round(F.avg((F.col("label") == F.col("own")).cast("double")), 4).alias("purity"))


def search_rrf(spark, d):
    """Lexical and hashed-vector rankings of documents, fused."""
    docs = load(spark, d, "documents").select("doc_id", "text")
    lexical = search.top_k(search.bm25(docs, _queries(spark)).withColumn("score", F.round("score", 5)), "query_id", "doc_id", "score", 20)
    vectors = docs.select("doc_id", search.hashing_embedding(F.col("text"), 32, "weft").alias("embedding"))
    asked = _queries(spark).select("query_id", search.hashing_embedding(F.col("query"), 32, "weft").alias("embedding"))
    dense = search.vector_top_k(vectors, asked, 20, item="doc_id")
    return search.fuse([lexical, dense], "query_id", "doc_id", 10).select("query_id", "doc_id", "rank")


def search_facets(spark, d):
    return search.facets(load(spark, d, "documents"), ["lang", "source", "doc_kind"])


def search_snippets(spark, d):
    docs = load(spark, d, "documents").filter("lower(text) like '%ledger%'")
    return docs.select("doc_id", search.snippet(F.col("text"), "the ledger hedge").alias("snippet"))


def search_claim_verify(spark, d):
    """The first line of each document as a claim against the rest of it."""
    docs = load(spark, d, "documents").filter("text is not null")
    claims = docs.select(F.col("doc_id").alias("claim_id"), F.substring_index("text", "\n", 1).alias("claim"))
    evidence = docs.select(F.col("doc_id").alias("claim_id"), F.expr("substring(text, length(substring_index(text, '\\n', 1)) + 1)").alias("evidence"))
    return search.verify_claims(claims, evidence)


def search_hashing_embedder(spark, d):
    c = load(spark, d, "customer")
    return c.select("c_custkey", F.transform(search.hashing_embedding(F.concat_ws(" ", "c_name", "c_mktsegment"), 16, "weft"), lambda x: F.round(x, 6)).alias("vector")).select("c_custkey", *[F.col("vector")[i].alias(f"v{i:02d}") for i in range(16)])


def search_memory_recall(spark, d):
    docs = load(spark, d, "documents")
    memories = docs.select(
        F.col("doc_id").alias("memory_id"), "text", F.when(F.col("doc_id") % 4 == 1, "w1").alias("workload"), F.when(F.col("doc_id") % 4 == 2, "s1").alias("workspace"),
        F.when(F.col("doc_id") % 4 == 1, F.when(F.col("doc_id") % 8 == 1, "u1").otherwise("u2")).when(F.col("doc_id") % 4 == 3, "u3").alias("user"), (F.col("doc_id") % 10 == 0).alias("revoked"),
    )
    return search.recall(memories, "ledger record hedge", "w1", "s1", "u1", 50)


_TOK = "list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'), ' '), lambda w: w <> '')"
_STOP = ", ".join(f"'{w}'" for w in search.STOP_WORDS)
_CONTENT = "list_distinct(list_filter(string_split(regexp_replace(lower(coalesce({0}, '')), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: length(w) >= {1} AND w NOT IN (" + _STOP + ")))"
_BM25 = f"""WITH docs AS (SELECT doc_id, {_TOK.format('text')} AS w FROM documents), q AS (SELECT DISTINCT query_id, unnest({_TOK.format('query')}) AS word FROM {_ASKED}),
st AS (SELECT count(*) AS n, avg(len(w)) AS avg_len FROM docs), posts AS (SELECT doc_id, any_value(len) AS len, word, count(*) AS tf FROM (SELECT doc_id, len(w) AS len, unnest(w) AS word FROM docs) WHERE word IN (SELECT word FROM q) GROUP BY doc_id, word),
df AS (SELECT word, count(*) AS df FROM posts GROUP BY 1),
scored AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / avg_len))), 5) AS score FROM posts JOIN df USING (word) JOIN q USING (word), st GROUP BY ALL)"""
_COS = "SELECT a.vec_id AS query_id, b.vec_id, round(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 9) AS s, b.label AS label, a.label AS own FROM (SELECT * FROM embeddings WHERE vec_id % 50 = 0) a, embeddings b"

QUERIES = {
    "search_bm25": (search_bm25, _BM25 + " SELECT * FROM scored"),
    "search_bm25_top": (search_bm25_top, _BM25 + " SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank FROM scored QUALIFY rank <= 10"),
    "search_token_overlap": (search_token_overlap, f"WITH s AS (SELECT doc_id, len(list_intersect({_CONTENT.format('text', 2)}, ['hedge', 'ledger', 'reconciled', 'record'])) / 4 AS s FROM documents) SELECT doc_id, round(s, 6) AS score FROM s WHERE s > 0"),
    "search_cosine_topk": (search_cosine_topk, f"SELECT query_id, vec_id, round(s, 5) AS similarity FROM ({_COS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 10"),
    "search_neighbour_purity": (search_neighbour_purity, f"WITH n AS (SELECT * FROM ({_COS}) QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) <= 11) SELECT query_id, round(avg((label = own)::INT), 4) AS purity FROM n WHERE vec_id <> query_id GROUP BY 1"),
    "search_rrf": (search_rrf, None),
    "search_facets": (search_facets, "SELECT 'lang' AS facet, lang AS value, count(*) AS n FROM documents GROUP BY ALL UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY ALL UNION ALL SELECT 'doc_kind', doc_kind, count(*) FROM documents GROUP BY ALL"),
    "search_snippets": (search_snippets, None),
    "search_claim_verify": (search_claim_verify, f"WITH c AS (SELECT doc_id, {_CONTENT.format('string_split(text, chr(10))[1]', 4)} AS w, {_CONTENT.format('text[length(string_split(text, chr(10))[1]) + 1:]', 3)} AS e FROM documents WHERE text IS NOT NULL), h AS (SELECT doc_id, len(w) AS n, len(list_intersect(w, e)) AS hits FROM c) SELECT doc_id AS claim_id, hits::INT AS hits, CASE WHEN hits >= 2 AND hits >= 0.5 * n THEN 'supported' WHEN hits >= 1 THEN 'weakly-supported' ELSE 'unverified' END AS verdict FROM h"),
    "search_hashing_embedder": (search_hashing_embedder, None),
    "search_memory_recall": (search_memory_recall, f"""WITH m AS (SELECT doc_id, len(list_intersect({_CONTENT.format('text', 2)}, ['hedge', 'ledger', 'record'])) / 3 AS s,
CASE WHEN doc_id % 8 = 1 THEN 2 WHEN doc_id % 4 = 2 THEN 1 WHEN doc_id % 4 = 0 THEN 0 END AS scope FROM documents WHERE doc_id % 10 <> 0)
SELECT doc_id AS memory_id, scope, round(s + 0.1 * scope, 6) AS score FROM m WHERE s > 0 AND scope IS NOT NULL ORDER BY scope DESC, score DESC, doc_id LIMIT 50"""),
}
