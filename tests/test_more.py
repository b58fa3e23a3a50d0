from pyspark.sql import functions as F

from weftline.operators import graph, mart, search, text
from weftline.sources import files


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_exploration_leaves_seeds_out(spark):
    e = spark.createDataFrame([("a", "b", "x"), ("b", "c", "x"), ("c", "d", "x"), ("a", "c", "x")], "src string, dst string, label string")
    seeds = spark.createDataFrame([("a",)], "id string")
    got = [r.id for r in graph.explore(e, seeds, 2, 5).orderBy("rank").collect()]
    assert got == ["b", "c"]  # each leads one list: a tie, by id


def test_grounding_reaches_the_neighbours_of_named_nodes(spark):
    nodes = spark.createDataFrame([("n1", "Ada Lovelace"), ("n2", "engine"), ("n3", "elsewhere"), ("n4", None)], "id string, text string")
    edges = spark.createDataFrame([("n1", "n2"), ("n2", "n3")], "src string, dst string")
    facts = spark.createDataFrame([("n1", "wrote", "notes"), ("n2", "is", "brass"), ("n3", "is", "far")], "s string, p string, o string")
    assert rows(search.ground(nodes, edges, facts, "What did Lovelace write?")) == [(1, "n1", "wrote", "notes"), (2, "n2", "is", "brass")]
    assert search.ground(nodes, edges, facts, "is it of the").count() == 0 and search.ground(nodes, edges, facts, "zebra").count() == 0


def test_candidates_are_ranked_or_excluded_with_a_reason(spark):
    df = spark.createDataFrame([("a", ["read", "write"], 0.9, True, "granted"), ("b", ["read"], 0.9, False, "requires-consent"), ("c", ["read"], 0.1, True, "granted"), ("d", ["read"], 0.9, True, "denied"), ("e", None, None, None, None)], "id string, verbs array<string>, trust double, verified boolean, access string")
    ranked, out = search.rank_candidates(df, ["read", "write"], 0.5)
    assert [(r.id, r.score, r["rank"]) for r in ranked.collect()] == [("a", 0.9, 1), ("b", 0.306, 2)]
    assert rows(out) == [("c", "trust below the floor"), ("d", "access denied"), ("e", "trust below the floor")]


def test_mentions_hash_personal_data():
    got = text.mentions_of("Dr. Ann Lee of Acme Corp met acme corp staff; mail ann@x.org", {"Acme Corp": "ORG"}, {"Dr.": "PERSON"})
    assert [(k, s) for k, s, _, _ in got][:3] == [("PERSON", "Ann Lee"), ("ORG", "Acme Corp"), ("ORG", "acme corp")]
    assert got[3][0] == "EMAIL" and got[3][1].startswith("sha256:") and "ann@" not in str(got) and text.mentions_of(None, {}) == []


def test_compound_readings(spark):
    df = spark.createDataFrame([("138/85",), ("138",), ("x/85",), (None,), ("1/2/3",)], "v string")
    got = [r[0] for r in df.select(text.split_reading(F.col("v"), ("sys", "dia"))).collect()]
    assert [[tuple(x) for x in g] for g in got] == [[("sys", 138.0), ("dia", 85.0)], [], [], [], []]


def test_folds(spark):
    df = spark.createDataFrame([("a", "down"), ("a", "unknown"), ("b", "healthy"), ("c", "healthy"), ("c", "down"), ("d", None)], "k string, s string")
    assert rows(df.groupBy("k").agg(mart.health(F.col("s")).alias("h"))) == [("a", "down"), ("b", "healthy"), ("c", "degraded"), ("d", "unknown")]
    assert rows(df.groupBy("k").agg(mart.worst(F.col("s"), ("healthy", "down")).alias("w"))) == [("a", "down"), ("b", "healthy"), ("c", "down"), ("d", None)]


def test_hyperedges_and_provenance(spark):
    c = spark.createDataFrame([("c1", "p2", "supports"), ("c1", "p1", "supports"), ("c1", "p3", "attacks"), ("c2", "p1", "attacks"), (None, "p", "supports")], "claim string, premise string, stance string")
    got = graph.hyperedges(c, "claim", "premise", "stance").collect()
    assert [(r.hyperedge_id, [tuple(m) for m in r.members]) for r in got] == [("argument:c1", [("claim", "c1"), ("premise", "p1"), ("premise", "p2")])]
    runs = spark.createDataFrame([("r", "x", ["i"], ["o1", "o2"]), ("s", None, None, [])], "run string, receipt string, i array<string>, o array<string>")
    assert rows(graph.provenance(runs, "run", "receipt", "i", "o")) == [("o1", "WAS_GENERATED_BY", "r"), ("o2", "WAS_GENERATED_BY", "r"), ("r", "HAS_RECEIPT", "x"), ("r", "USED", "i")]


def test_content_addresses(spark, tmp_path):
    import hashlib

    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.7 x")
    (tmp_path / "b.txt").write_bytes(b"plain")
    got = {r.media: r.content_id for r in files.ingest(spark, f"file://{tmp_path}").collect()}
    assert got == {"application/pdf": hashlib.sha256(b"%PDF-1.7 x").hexdigest(), "text/plain": hashlib.sha256(b"plain").hexdigest()}
