import re

import pytest
from pyspark.sql import functions as F

from weftline.operators import search, text
from weftline.operators import windows as win


@pytest.mark.parametrize(("content", "kinds"), [
    ("mail ann.lee@example.org now", ["EMAIL"]), ("ann dot lee at example dot org", ["EMAIL"]), ("pay GB82 WEST 1234 5698 7654 32 today", ["IBAN"]), ("pay GB82 WEST 1234 5698 7654 33 today", []),
    ("card 4111 1111 1111 1111.", ["CREDIT_CARD"]), ("card 4111 1111 1111 1112.", []), ("ssn 123-45-6789", ["NATIONAL_ID"]), ("not 000-45-6789 or 666-45-6789", []), ("nino AB 12 34 56 C", ["NATIONAL_ID"]),
    ("call +44 20 7946 0958", ["PHONE"]), ("call (555) 123-4567", ["PHONE"]), ("born on 4 May 1980", ["DATE_OF_BIRTH"]), ("met on 4 May 1980", []), ("at 12 High Street.", ["STREET_ADDRESS"]), ("P.O. Box 77", ["STREET_ADDRESS"]), ("case 88251 had 12 of 45", []), ("", []), (None, []),
    ("ring oh two seven double four nine one six oh three now", ["PHONE"]), ("it took one two three days", []), ("passport no. X9-33812", ["NATIONAL_ID"]), ("born March 3, 1991", ["DATE_OF_BIRTH"]), ("dob: 03/04/1991", ["DATE_OF_BIRTH"]),
    ("card four double one one, one one one one, one one one one, one one one one", ["CREDIT_CARD"]), ("flat 9 on the hill", []), ("7b Old Mill Lane", ["STREET_ADDRESS"]), ("versions 1.2.3 and 10.20.30.40", []), ("nino BG 12 34 56 C", []),
])
def test_personal_data(content, kinds):
    assert [k for _, _, k in text.pii_of(content)] == kinds


def test_redaction_spans_and_numbers():
    t = "ann@x.org, bob@x.org and ann@x.org"
    assert text.redact_of(t) == "[REDACTED:EMAIL], [REDACTED:EMAIL] and [REDACTED:EMAIL]"
    assert text.redact_of(t, numbered=True) == "[EMAIL_1], [EMAIL_2] and [EMAIL_1]"
    assert [t[a:b] for a, b, _ in text.pii_of(t)] == ["ann@x.org", "bob@x.org", "ann@x.org"] and text.redact_of(None) is None


def test_further_finders_can_be_given(spark):
    badge = (("BADGE", lambda t: [(m.start(), m.end()) for m in re.finditer(r"B-\d{3}", t.raw)]),)
    df = spark.createDataFrame([("B-123 for ann@x.org",), (None,)], "t string")
    got = df.select(text.redact(F.col("t"), extra=badge).alias("r"), text.pii(F.col("t"), badge).alias("p")).collect()
    assert got[0].r == "[REDACTED:BADGE] for [REDACTED:EMAIL]" and [x.type for x in got[0].p] == ["BADGE", "EMAIL"] and got[1].r is None


def test_quantities():
    got = [(q["kind"], q["value"], q["unit"]) for q in text.quantities_of("AUD 1,138.9m and $1.2 million, 22.6% of 2024, 5 bananas, 3k")]
    assert got == [("currency", 1138900000.0, "AUD"), ("currency", 1200000.0, None), ("percentage", 22.6, "percent"), ("number", 3000.0, None)]
    assert text.quantities_of(None) == text.quantities_of("in 2024, page 7") == []


def test_spans_are_exact_even_for_repeated_sentences():
    t = "One. One. Two!\nstill two\n\n Three?  Four"
    spans = text.spans_of(t)
    assert [t[a:b] for a, b, _ in spans] == [x for _, _, x in spans] == ["One.", "One.", "Two!", "still two", "Three?", "Four"]
    assert len({a for a, _, _ in spans}) == 6 and len(text.spans_of(t, "paragraph")) == 2 and text.spans_of(None) == []


def test_normal_form_is_idempotent(spark):
    df = spark.createDataFrame([("a \r\nb\t\n\n\n\nc ",), (None,), ("",), (" \n ",)], "t string")
    once = df.select(text.normalize(F.col("t")).alias("t"))
    assert [r[0] for r in once.collect()] == ["a\nb\n\nc", None, "", ""] and once.select(text.normalize(F.col("t"))).collect() == once.collect()


def test_templates_links_and_html(spark):
    df = spark.createDataFrame([(1, "Step 5: open the door. Step x: no."), (2, None)], "id int, t string")
    got = text.template_extract(df, ["id"], "t", {"s": "Step {n:number}: open the {what:word}."}).collect()
    assert [(r.id, r.variables, r.confidence) for r in got] == [(1, {"n": "5", "what": "door"}, 0.7)]
    with pytest.raises(ValueError):
        text.template_pattern("{a:colour}")
    page = '<a href="https://a.org/x">x</a> [y](/y) https://b.org/z. <img src=\'/i.png\'>'
    html = "<style>p{}</style><p>One &amp; <b>two</b></p><script>x</script><p>3 &lt; 4</p>"
    r = spark.createDataFrame([(page, html)], "p string, h string").select(text.links(F.col("p")).alias("l"), text.html_to_text(F.col("h")).alias("t")).first()
    assert r.l == ["https://a.org/x", "/y", "https://b.org/z.", "/i.png"] and r.t == "One & two\n 3 < 4"


def test_figures(spark):
    df = spark.createDataFrame([(x,) for x in ("$1,234.50", "(12.5)", "-3", "22.6%", "1.5bn", "7 million", "none", None, "")], "t string")
    assert [r[0] for r in df.select(text.parse_figure(F.col("t"))).collect()] == [1234.5, -12.5, -3.0, 22.6, 1.5e9, 7e6, None, None, None]


def test_copies_and_robots(spark):
    df = spark.createDataFrame([(3, "a \n"), (1, "a"), (2, "b"), (4, None), (5, "a")], "id int, t string")
    assert sorted(map(tuple, text.exact_copies(df, "id", "t").collect())) == [(1, 1, 3), (2, 2, 1), (3, 1, 3), (5, 1, 3)]
    rules = [("disallow", "/private"), ("allow", "/private/open"), ("disallow", "/*.pdf$"), ("disallow", "")]
    assert [text.robots_allowed(rules, p) for p in ("/a", "/private/x", "/private/open/x", "/a.pdf", "/a.pdfx")] == [True, False, True, False, True]


def test_search_edges(spark):
    docs = spark.createDataFrame([(1, "the ledger ledger"), (2, None), (3, ""), (4, "Hedge, the LEDGER!")], "doc_id int, text string").withColumn("score", F.lit(5)).withColumn("word", F.lit("x"))
    asked = spark.createDataFrame([(1, "ledger hedge hedge"), (2, "nothing"), (3, None), (4, "")], "query_id int, query string")
    got = {(r.query_id, r.doc_id): r.score for r in search.bm25(docs, asked).collect()}
    assert set(got) == {(1, 1), (1, 4)} and got[1, 4] > got[1, 1]
    assert search.bm25(docs.limit(0), asked).count() == 0 and search.token_overlap(docs, "of the", F.col("text")).count() == 0
    snip = [r.s for r in docs.select(search.snippet(F.col("text"), "some ledger", 4, 11).alias("s")).collect()]
    assert snip == ["the <b>ledger</b> …", None, "", "…the <b>LEDGER</b>!"]


def test_vectors_by_brute_force_and_without_a_direction(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    m = rng.normal(size=(60, 5))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(m)] + [(100, None), (101, []), (102, [0.0] * 5)]
    base = spark.createDataFrame(rows, "vec_id int, embedding array<double>")
    asked = base.filter("vec_id % 10 = 0").selectExpr("vec_id as query_id", "embedding")
    unit = m / np.linalg.norm(m, axis=1)[:, None]
    for block in (2, 100):
        got = {}
        for r in search.vector_top_k(base, asked, 4, block=block).collect():
            got.setdefault(r.query_id, []).append((r["rank"], r.vec_id))
        assert {q: [i for _, i in sorted(v)] for q, v in got.items()} == {q: np.lexsort((np.arange(60), -np.round(unit @ unit[q], 9)))[:4].tolist() for q in range(0, 60, 10)}


def test_strategies_sum_to_one_and_unknown_ones_fail(spark):
    prices = spark.createDataFrame([(s, d, float(10 + d * k + (d % 3))) for s, k in (("A", 1), ("B", -0.2), ("C", 0.5), ("D", 0)) for d in range(1, 30)], "symbol string, day int, close double")
    for name in ("trend", "momentum", "mean_reversion"):
        sums = {round(r[1], 9) for r in win.strategy_weights(prices, name).groupBy("day").sum("weight").collect()}
        assert sums <= {0.0, 1.0}
    assert {round(r[1], 9) for r in win.strategy_weights(prices, "market_neutral").groupBy("day").sum("weight").collect()} == {0.0}
    with pytest.raises(ValueError):
        win.strategy_weights(prices, "luck")


def test_running_values_are_the_same_in_slices_and_over_whole_keys(spark):
    import random

    rng = random.Random(3)
    rows = [(rng.choice(["a", "b", None]), i, rng.choice([None, rng.uniform(0.5, 1.5)])) for i in range(400)]
    df = spark.createDataFrame(rows, "k string, t bigint, v double")
    cut = F.floor(F.col("t") / 7)
    for run in (
        lambda s: win.hysteresis(df, ["k"], ["t"], "v", 0.7, 1.3, slice_=s), lambda s: win.drawdown(df, ["k"], ["t"], "v", slice_=s).withColumn("drawdown", F.round("drawdown", 9)),
        lambda s: win.cumulative_product(df, ["k"], ["t"], "v", "p", s).withColumn("p", F.round("p", 9)),
    ):
        assert sorted(map(tuple, run(None).collect()), key=repr) == sorted(map(tuple, run(cut).collect()), key=repr)


def test_hashed_vectors_have_unit_length_and_do_not_depend_on_order(spark):
    df = spark.createDataFrame([(1, "Blue harbour, blue boat"), (2, "boat blue BLUE harbour"), (3, ""), (4, None), (5, "w " * 50_000)], "id int, t string")
    got = {r.id: r.v for r in df.select("id", search.hashing_embedding(F.col("t"), 16, "s").alias("v")).collect()}
    assert got[1] == got[2] and abs(sum(x * x for x in got[1]) - 1) < 1e-9 and got[3] == got[4] == [0.0] * 16 and sorted(map(abs, got[5]))[-1] == 1.0
    three = {r.id: r.v for r in df.select("id", search.trigram_embedding(F.col("t"), 16).alias("v")).collect()}
    assert len(three[1]) == 16 and three[3] == [0.0] * 16
    assert df.limit(0).select(search.hashing_embedding(F.col("t"), 4).alias("v")).count() == 0
