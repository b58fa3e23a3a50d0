"""Lexical, vector and hybrid search, facets, snippets and claim checks."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.session import broadcast_if_small, materialize

# fixed values: words that carry no meaning in queries
STOP_WORDS = ("a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "has", "how", "in", "is", "it", "of", "on", "or", "that", "the", "this", "to", "was", "what", "when", "which", "with")


def tokens(text: Column) -> Column:
    """Lower-case runs of letters and digits; an empty array for null."""
    return F.filter(F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " "), " "), lambda w: w != "")


def content_tokens(text: Column, least: int = 2) -> Column:
    """Distinct ASCII tokens of at least ``least`` letters that are no stop words."""
    words = F.split(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^a-z0-9]+", " "), " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= least) & ~w.isin(*STOP_WORDS)))


def bm25(documents: DataFrame, queries: DataFrame, doc_id: str = "doc_id", text: str = "text", query_id: str = "query_id", query: str = "query", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """query_id, doc_id, score: BM25 of every document that shares a word with a query.

    Only the postings of query words leave the scan; document counts and the mean length
    cover all documents.  A query word counts once.  Null texts are documents without words.
    """
    asked = queries.select(query_id, F.explode(F.array_distinct(tokens(F.col(query)))).alias("word"))
    words = broadcast_if_small(asked.select("word").distinct())
    docs = documents.select(doc_id, tokens(F.col(text)).alias("w")).withColumn("len", F.size("w"))
    stats = docs.agg(F.count(F.lit(1)).alias("n_docs"), F.avg("len").alias("avg_len"))
    posts = docs.select(doc_id, "len", F.explode("w").alias("word")).join(words, "word", "left_semi").groupBy(doc_id, "len", "word").agg(F.count(F.lit(1)).alias("tf"))
    posts = materialize(posts, "posts")
    df = posts.groupBy("word").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log1p((F.col("n_docs") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    norm = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("avg_len")))
    weighted = posts.join(broadcast_if_small(df), "word").join(F.broadcast(stats)).select("word", doc_id, (idf * norm).alias("s"))
    return weighted.join(broadcast_if_small(asked), "word").groupBy(query_id, doc_id).agg(F.sum("s").alias("score"))


def top_k(scored: DataFrame, query_id: str, item: str, score: str, k: int) -> DataFrame:
    """query_id, item, score, rank: the k best items of each query, equal scores by ascending item."""
    w = Window.partitionBy(query_id).orderBy(F.desc(score), F.asc(item))
    return scored.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def token_overlap(records: DataFrame, query: str, text: Column, weight: Column | None = None) -> DataFrame:
    """All columns and score: share of the query's content words a record holds (times its weight), where not 0.

    A blank query finds nothing.
    """
    import re

    asked = sorted({w for w in re.split(r"[^a-z0-9]+", query.lower()) if len(w) > 1 and w not in STOP_WORDS})
    if not asked:
        return records.withColumn("score", F.lit(0.0)).limit(0)
    share = F.size(F.array_intersect(content_tokens(text), F.array(*[F.lit(w) for w in asked]))) / F.lit(len(asked))
    return records.withColumn("score", share * (weight if weight is not None else F.lit(1.0))).filter("score > 0")


def vector_top_k(base: DataFrame, queries: DataFrame, k: int, item: str = "vec_id", vector: str = "embedding", query_id: str = "query_id", block: int = 2_000) -> DataFrame:
    """query_id, item, similarity, rank: the k rows of highest cosine for every query; exact.

    Queries go out in blocks of at most ``block`` vectors; each partition keeps its k best per
    query, and only these are shuffled.  Null, empty and zero vectors match nothing.
    Similarities are rounded to 9 digits before ranking, so ties don't hang on summation order.
    """
    spark = base.sparkSession
    kind, qkind = base.schema[item].dataType.simpleString(), queries.schema[query_id].dataType.simpleString()
    total = queries.count()
    keyed = queries.select(query_id, vector).withColumn("_b", F.pmod(F.xxhash64(query_id), F.lit(max(1, -(-total // block)))))
    out = None
    for number in range(max(1, -(-total // block))):
        rows = keyed.filter(F.col("_b") == number).select(query_id, vector).collect()  # one block of queries
        rows = [r for r in rows if r[1] and np.linalg.norm(np.nan_to_num(np.asarray(r[1], float))) > 0]
        if not rows:
            continue
        unit = np.asarray([np.asarray(r[1], float) / np.linalg.norm(np.asarray(r[1], float)) for r in rows])
        shared = spark.sparkContext.broadcast(([r[0] for r in rows], unit))

        def run(batches, shared=shared):
            ids, unit = shared.value
            best: list = []
            for pdf in batches:
                pdf = pdf[pdf[vector].map(lambda v: v is not None and len(v) == unit.shape[1])]
                if pdf.empty:
                    continue
                m = np.vstack(pdf[vector].to_numpy()).astype(float)
                norm = np.linalg.norm(m, axis=1)
                ok = norm > 0
                names, m = pdf[item].to_numpy()[ok], m[ok] / norm[ok][:, None]
                sims = np.round(unit @ m.T, 9)
                for q in range(len(ids)):
                    at = np.lexsort((names, -sims[q]))[:k]
                    best.append(pd.DataFrame({query_id: ids[q], item: names[at], "similarity": sims[q][at]}))
                if len(best) > 4 * len(ids):
                    best = [_cut(pd.concat(best), query_id, item, k)]
            if best:
                yield _cut(pd.concat(best), query_id, item, k)

        part = base.select(item, vector).mapInPandas(run, f"{query_id} {qkind}, {item} {kind}, similarity double")
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"{query_id} {qkind}, {item} {kind}, similarity double, rank int")
    return top_k(out, query_id, item, "similarity", k)


def _cut(pdf: pd.DataFrame, query_id: str, item: str, k: int) -> pd.DataFrame:
    pdf = pdf.sort_values([query_id, "similarity", item], ascending=[True, False, True])
    return pdf.groupby(query_id, sort=False).head(k)


def fuse(rankings: list[DataFrame], query_id: str, item: str, k: int, offset: int = 60) -> DataFrame:
    """query_id, item, score, rank: reciprocal rank fusion, the sum of 1/(offset + rank) over rankings."""
    both = None
    for r in rankings:
        one = r.select(query_id, item, (F.lit(1.0) / (F.col("rank") + offset)).alias("s"))
        both = one if both is None else both.unionByName(one)
    fused = both.groupBy(query_id, item).agg(F.round(F.sum("s"), 12).alias("score"))
    return top_k(fused, query_id, item, "score", k)


def facets(df: DataFrame, columns: list[str]) -> DataFrame:
    """facet, value, n: counts of each value of each column, from one pass (grouping sets)."""
    sets = [[c] for c in columns]
    counted = df.groupingSets(sets, *columns).agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_g"))
    facet, value = F.lit(None).cast("string"), F.lit(None).cast("string")
    for i, c in enumerate(columns):
        mine = F.col("_g") == ((1 << len(columns)) - 1) ^ (1 << (len(columns) - 1 - i))
        facet, value = F.when(mine, c).otherwise(facet), F.when(mine, F.col(c).cast("string")).otherwise(value)
    return counted.select(facet.alias("facet"), value.alias("value"), "n")


def snippet(text: Column, query: str, before: int = 60, width: int = 240) -> Column:
    """A window of the text from ``before`` characters ahead of the first query word of four or more letters, words in <b>.

    Without such words the first 200 characters.  An ellipsis marks a cut end.
    """
    import re

    words = [w for w in query.lower().split() if len(w) >= 4]
    if not words:
        return F.substring(text, 1, 200)
    low = F.lower(text)
    at = F.array_min(F.filter(F.array(*[F.instr(low, w) for w in words]), lambda p: p > 0))
    start = F.greatest(F.coalesce(at, F.lit(1)) - before, F.lit(1))
    marked = F.regexp_replace(F.substring(text, start, F.lit(width)), "(?i)(" + "|".join(re.escape(w) for w in sorted(words, key=len, reverse=True)) + ")", "<b>$1</b>")
    return F.concat(F.when(start > 1, "…").otherwise(""), marked, F.when(start + width <= F.length(text), "…").otherwise(""))


def verify_claims(claims: DataFrame, evidence: DataFrame, claim_id: str = "claim_id", claim: str = "claim", evidence_text: str = "evidence") -> DataFrame:
    """claim_id, hits, verdict: a claim's content words (four letters or more) that stand as whole words in its evidence.

    supported: at least two, and half of all; weakly-supported: at least one; else unverified.
    """
    words = content_tokens(F.col(claim), 4)
    held = claims.select(claim_id, words.alias("w")).join(evidence.select(claim_id, content_tokens(F.col(evidence_text), 3).alias("e")), claim_id, "left")
    hits = F.size(F.array_intersect("w", F.coalesce("e", F.array().cast("array<string>"))))
    verdict = F.when((hits >= 2) & (hits >= 0.5 * F.size("w")), "supported").when(hits >= 1, "weakly-supported").otherwise("unverified")
    return held.select(claim_id, hits.alias("hits"), verdict.alias("verdict"))


def hashing_embedding(text: Column, dimension: int, salt: str = "", features: Column | None = None) -> Column:
    """A unit vector of the text's words (or of ``features``, an array of strings), hashed: feature h adds +1 or -1 at one place; zeros without any.

    The lower bits of a 64-bit hash give the place, its sign the sign.  Words are cut and hashed
    by built-in functions, each once; the hashes of an Arrow batch are summed in one numpy step.
    """
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "") if features is None else F.coalesce(features, F.array().cast("array<string>"))

    @F.pandas_udf("array<double>")
    def summed(hashes: pd.Series) -> pd.Series:
        flat = np.concatenate([np.asarray(h, dtype=np.int64) for h in hashes]) if len(hashes) else np.empty(0, np.int64)
        rows = np.repeat(np.arange(len(hashes)), [len(h) for h in hashes])
        out = np.zeros((len(hashes), dimension))
        np.add.at(out, (rows, flat % dimension), np.where(flat < 0, -1.0, 1.0))
        norm = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return pd.Series(list(out / np.where(norm > 0, norm, 1.0)))

    return summed(F.transform(words, lambda w: F.xxhash64(w, F.lit(salt))))


def trigram_embedding(text: Column, dimension: int, salt: str = "") -> Column:
    """The same over the distinct runs of three characters of the plain text; a text shorter than that is one run."""
    low = F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")
    # a look ahead at every place: one pass over the text, however long
    runs = F.when(F.length(low) > 2, F.array_distinct(F.regexp_extract_all(low, F.lit(r"(?s)(?=(.{3}))"), F.lit(1)))).when(low != "", F.array(low))
    return hashing_embedding(text, dimension, salt, runs)


def recall(memories: DataFrame, query: str, workload: str, workspace: str, user: str, k: int) -> DataFrame:
    """memory_id, scope, score: remembered texts visible to a caller, ranked by overlap plus a bonus for nearness of scope.

    memories: memory_id, text, workload, workspace, user, revoked.  scope 2: own workload and
    user, 1: own workspace, 0: shared (all three null); others and revoked ones are never seen.
    """
    scope = (
        F.when((F.col("workload") == workload) & (F.col("user") == user), 2)
        .when((F.col("workspace") == workspace) & F.col("user").isNull(), 1)
        .when(F.col("workload").isNull() & F.col("workspace").isNull() & F.col("user").isNull(), 0)
    )
    seen = memories.withColumn("scope", scope).filter(F.col("scope").isNotNull() & ~F.coalesce("revoked", F.lit(False)))
    scored = token_overlap(seen, query, F.col("text")).withColumn("score", F.round(F.col("score") + 0.1 * F.col("scope"), 6))
    best = scored.groupBy("memory_id").agg(F.max(F.struct("score", "scope")).alias("b")).select("memory_id", F.col("b.scope").alias("scope"), F.col("b.score").alias("score"))
    return best.orderBy(F.desc("scope"), F.desc("score"), "memory_id").limit(k)


def ground(nodes: DataFrame, edges: DataFrame, facts: DataFrame, question: str, hops: int = 1, most_seeds: int = 12, most_facts: int = 24) -> DataFrame:
    """n, s, p, o: numbered facts about the nodes that a question names and their neighbours within ``hops``.

    nodes: id, text; facts: s, p, o.  A node is named by the question's words of three letters
    or more that stand in its text; the most words come first, ties by id.
    """
    import re

    words = sorted({w for w in re.split(r"[^a-z0-9]+", question.lower()) if len(w) > 2 and w not in STOP_WORDS})
    if not words:
        return facts.limit(0).select(F.lit(0).alias("n"), "s", "p", "o")
    low = F.lower(F.concat_ws(" ", "id", "text"))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    seeds = nodes.select("id", hits.alias("h")).filter("h > 0").orderBy(F.desc("h"), "id").limit(most_seeds).select("id")
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    seen = frontier = seeds
    for _ in range(max(1, hops)):
        frontier = frontier.join(both, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct().join(seen, "id", "left_anti")
        seen = seen.unionByName(frontier)
    held = facts.join(broadcast_if_small(seen.select(F.col("id").alias("s")).distinct()), "s", "left_semi").select("s", "p", "o").distinct()
    top = held.orderBy("s", "p", "o").limit(most_facts)
    return top.select(F.row_number().over(Window.partitionBy(F.lit(1)).orderBy("s", "p", "o")).alias("n"), "s", "p", "o")  # at most most_facts rows


def ground_hybrid(nodes: DataFrame, question: str, vectors: DataFrame, asked: list[float], gate: float = 0.2, most: int = 12) -> DataFrame:
    """id, words, cosine, rank: nodes that a question names, or whose vector is nearer than ``gate`` to the question's.

    nodes: id, text; vectors: id, embedding; asked: the question's vector.  Named nodes come
    first, by number of words, then the others by cosine; ties by id.
    """
    words = sorted({w for w in re.split(r"[^a-z0-9]+", question.lower()) if len(w) > 2 and w not in STOP_WORDS})
    low = F.lower(F.concat_ws(" ", F.col("id").cast("string"), "text"))
    hits = sum((F.contains(low, F.lit(w)).cast("int") for w in words), F.lit(0))
    q = F.array(*[F.lit(float(x)) for x in asked])
    length = lambda v: F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x))
    v = F.transform("embedding", lambda x: x.cast("double"))
    dot = F.aggregate(F.zip_with(v, q, lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
    near = vectors.select("id", F.try_divide(dot, length(v) * length(q)).alias("cosine")).filter(F.col("cosine") > gate)
    held = nodes.select("id", hits.alias("words")).join(near, "id", "full_outer").filter("coalesce(words, 0) > 0 or cosine is not null")
    top = held.select("id", F.coalesce("words", F.lit(0)).alias("words"), "cosine").orderBy(F.desc("words"), F.desc_nulls_last("cosine"), "id").limit(most)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("words"), F.desc_nulls_last("cosine"), "id")))  # at most ``most`` rows


def rank_candidates(df: DataFrame, asked: list[str], least_trust: float, k: int = 1_000, grade=None) -> tuple[DataFrame, DataFrame]:
    """(ranked, excluded): candidates by coverage of the asked verbs times trust; exclusions are kept with their reason.

    df: id, verbs array, trust, verified boolean, access ('granted', 'requires-consent',
    'denied').  An unverified claim counts 0.8, one that needs consent 0.85.  The k best are
    ranked, by a top-k that no task holds whole.  grade: a function from the access column to
    its factor (null: denied), in place of the one above.
    """
    reason = F.when(F.coalesce(F.col("trust"), F.lit(0.0)) < least_trust, "trust below the floor").when(F.col("access") == "denied" if grade is None else grade(F.col("access")).isNull(), "access denied")
    marked = df.withColumn("reason", reason)
    share = F.size(F.array_intersect("verbs", F.array(*[F.lit(v) for v in sorted(set(asked))]))) / F.lit(len(set(asked))) if asked else F.lit(0.5)
    score = share * F.col("trust") * F.when(F.col("verified"), 1.0).otherwise(0.8) * (F.when(F.col("access") == "granted", 1.0).otherwise(0.85) if grade is None else grade(F.col("access")))
    ranked = marked.filter("reason is null").withColumn("score", F.round(score, 9)).drop("reason")
    top = ranked.orderBy(F.desc("score"), "id").limit(k)
    return top.withColumn("rank", F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("score"), "id"))), marked.filter("reason is not null").select("id", "reason")


def route(scored: DataFrame, keys: list[str], item: str, score: str, gap: float = 0.15, floor: float = 0.5) -> DataFrame:
    """keys, item, decision: 'route' if the best is at least ``floor`` and leads the second by ``gap``, 'pick' if it leads by less, else 'abstain'."""
    from weftline.operators.windows import best_margin

    best = best_margin(scored, keys, item, score)
    decision = F.when(F.col(score) < floor, "abstain").when(F.col("margin") >= gap, "route").otherwise("pick")
    return best.select(*keys, item, decision.alias("decision"))
