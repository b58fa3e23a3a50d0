import io
import random
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from weftline.functions import sql
from weftline.operators import graph, mart, records, search, stats, text
from weftline.plans import patterns
from weftline.session import fresh_path
from weftline.sources import documents, logs, stores


def slides():
    a, p = "http://schemas.openxmlformats.org/drawingml/2006/main", "http://schemas.openxmlformats.org/presentationml/2006/main"
    shape = lambda text, kind: f'<p:sp><p:nvSpPr><p:nvPr>{kind}</p:nvPr></p:nvSpPr><p:spPr><a:xfrm><a:off x="127000" y="254000"/><a:ext cx="1270000" cy="635000"/></a:xfrm></p:spPr><p:txBody><a:p><a:r><a:t>{text}</a:t></a:r></a:p></p:txBody></p:sp>'
    page = lambda body: f'<p:sld xmlns:a="{a}" xmlns:p="{p}"><p:cSld><p:spTree>{body}</p:spTree></p:cSld></p:sld>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("ppt/slides/slide2.xml", page(shape("Second", "")))
        z.writestr("ppt/slides/slide1.xml", page(shape("Harbour plan", '<p:ph type="title"/>') + shape("Three berths", "")))
    return out.getvalue()


def pdf():
    one, two = b"BT /F1 12 Tf 72 700 Td (Berth \\(east\\)) Tj 0 -14 Td [(Dep) -20 (th 9 m)] TJ ET", b"BT /F1 10 Tf 1 0 0 1 50 600 Tm <48 65 72 6F 6E> Tj ET"
    obj = lambda n, head, data: b"%d 0 obj << /Length %d %s>> stream\n%s\nendstream endobj\n" % (n, len(data), head, data)
    return b"%PDF-1.4\n" + obj(4, b"", one) + obj(5, b"/Filter /FlateDecode ", zlib.compress(two)) + b"%%EOF"


def test_documents_to_blocks(spark):
    plain = "# Title\nfirst line\nsecond line\n\n- a\n- b\n\n```\ncode # not a heading\n```\n| x | y |\n| 1 | 2 |\fnext page"
    rows = [("p.pdf", pdf()), ("s.pptx", slides()), ("t.md", plain.encode()), ("none", None), ("empty", b""), ("bad.pptx", b"PK\x03\x04zzz")]
    got = documents.parse(spark.createDataFrame(rows, "path string, content binary")).collect()
    of = lambda n: [(r.page, r.kind, r.text) for r in got if r.path == n]
    assert of("p.pdf") == [(1, "text", "Berth (east)\nDepth 9 m"), (2, "text", "Heron")]
    assert of("s.pptx") == [(1, "heading", "Harbour plan"), (1, "text", "Three berths"), (2, "text", "Second")]
    assert of("t.md") == [(1, "heading", "# Title"), (1, "text", "first line\nsecond line"), (1, "list", "- a\n- b"), (1, "code", "code # not a heading"), (1, "table", "| x | y |\n| 1 | 2 |"), (2, "text", "next page")]
    assert of("none") == of("empty") == [] and of("bad.pptx")[0][1] == "unreadable"
    first = next(r for r in got if r.path == "s.pptx")
    assert (first.x, first.y, first.width, first.height) == (10.0, 20.0, 100.0, 50.0) and next(r for r in got if r.path == "p.pdf").x == 72.0


def test_document_store_and_records(spark, tmp_path):
    store = stores.DocumentStore(spark, fresh_path(spark, "s"), "id bigint, t string", "id", most=3)
    assert store.read().count() == 0
    store.append(spark.createDataFrame([(1, "a"), (2, "b"), (None, "x")], "id bigint, t string"))
    store.append(spark.createDataFrame([(2, "c"), (3, None)], "id bigint, t string"))
    assert sorted(map(tuple, store.read().collect()), key=repr) == [(1, "a"), (2, "c"), (3, None)]
    store.append(spark.createDataFrame([(4, "d")], "id bigint, t string"))
    with pytest.raises(ValueError, match="more than 3"):
        store.read()
    (tmp_path / "r.json").write_text('[{"a": 1},\n {"a": 2}]')
    (tmp_path / "r.jsonl").write_text('{"a": 1}\nnot json\n{"a": 3}\n')
    assert sorted(r.a for r in stores.read_records(spark, f"{tmp_path}/r.json").collect()) == [1, 2]
    lines = stores.read_records(spark, f"{tmp_path}/r.jsonl", "a bigint, _corrupt string").collect()
    assert sorted((r.a or 0, r._corrupt) for r in lines) == [(0, "not json"), (1, None), (3, None)]


def test_database_writes_are_all_or_nothing(spark, tmp_path):
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url).createStatement().execute('CREATE TABLE T ("id" BIGINT PRIMARY KEY, "v" VARCHAR(20))')
    except Exception as error:
        pytest.skip(f"no embedded database here: {error}")
    stores.write_table(spark.createDataFrame([(i, f"v{i}") for i in range(20)], "id bigint, v string"), url, "T")
    with pytest.raises(Exception):  # noqa: B017 - a key that is there already: nothing of the batch stays
        stores.write_table(spark.createDataFrame([(50, "new"), (3, "again")], "id bigint, v string"), url, "T")
    assert stores.read_table(spark, url, "T", ("id", 0, 20, 4)).count() == 20
    stores.write_table(spark.createDataFrame([(7, "only")], "id bigint, v string"), url, "T", replace=True)
    assert [tuple(r) for r in stores.read_table(spark, url, "T").collect()] == [(7, "only")]


def test_a_database_in_the_drivers_memory_is_reached_from_a_cluster(spark, monkeypatch):
    """Rows pass through the driver in batches, into the table and out of it."""
    import uuid

    monkeypatch.setattr(stores, "ROWS_AT_ONCE", 7)
    url = f"jdbc:derby:memory:t{uuid.uuid4().hex};create=true"
    try:
        spark.sparkContext._jvm.java.sql.DriverManager.getConnection(url).createStatement().execute('CREATE TABLE T ("id" BIGINT PRIMARY KEY, "v" VARCHAR(20), "x" DOUBLE)')
    except Exception as error:
        pytest.skip(f"no embedded database here: {error}")
    rows = [(i, None if i % 3 else f"v'{i}", i / 2) for i in range(20)]
    frame = lambda some: spark.createDataFrame(some, "id bigint, v string, x double")
    stores.write_table(frame(rows), url, "T", driver=True)
    with pytest.raises(Exception):  # noqa: B017 - a key that is there already: nothing of the batch stays
        stores.write_table(frame([(50, "new", 0.0), (3, "again", 0.0)]), url, "T", driver=True)
    assert sorted(map(tuple, stores.read_table(spark, url, "T", driver=True).collect())) == rows
    assert sorted(r.id for r in stores.read_table(spark, url, "T", ("id", 0, 20, 4), where='"x" > 8', driver=True).collect()) == [17, 18, 19]
    stores.write_table(frame([]), url, "T", replace=True, driver=True)
    assert stores.read_table(spark, url, "T", driver=True).count() == 0


def test_operation_log_compaction_keeps_the_view(spark):
    from weftline.operators import crdt

    rows = [("r1", 1, 1, "add_node", "n", None, None, None, None, None, []), ("r1", 2, 2, "add_node", "m", None, None, None, None, None, []), ("r1", 3, 3, "del_node", "m", None, None, None, None, None, [("r1", 2)]), ("r2", 1, 4, "set_prop", "n", None, None, None, "k", "old", []), ("r2", 2, 5, "set_prop", "n", None, None, None, "k", "new", [])]
    log = stores.OpLog(spark, fresh_path(spark, "log"))
    assert log.read().count() == 0
    log.append(spark.createDataFrame(rows[:3], crdt.LOG))
    log.append(spark.createDataFrame(rows[1:], crdt.LOG))
    before = [sorted(map(tuple, f.collect())) for f in log.replay()]
    assert log.read().count() == 5 and log.compact() == 3 and log.read().count() == 2
    assert [sorted(map(tuple, f.collect())) for f in log.replay()] == before == [[("n",)], [], [("n", "k", "new")]]


def test_layers_hierarchies_and_status(spark):
    layer = lambda *rows: spark.createDataFrame(rows, "k string, v string")
    got = records.layered([layer(("a", "1"), ("b", "1")), layer(("a", None), ("c", "2")), layer(("b", "3"))], ["k"], "v")
    assert sorted(map(tuple, got.collect())) == [("a", "1", 0), ("b", "3", 2), ("c", "2", 1)]
    classes = spark.createDataFrame([("tug", "ship"), ("ship", "craft"), ("craft", None)], "id string, parent string")
    props = spark.createDataFrame([("craft", "hull", "any"), ("ship", "hull", "steel"), ("tug", "pull", "40 t")], "class string, name string, value string")
    assert sorted(map(tuple, records.inherited(classes, props).filter("class = 'tug'").collect())) == [("tug", "hull", "steel", 1), ("tug", "pull", "40 t", 0)]
    with pytest.raises(ValueError, match="beyond"):
        records.inherited(spark.createDataFrame([("a", "b"), ("b", "a")], "id string, parent string"), props)
    df = spark.createDataFrame([("x", 1), ("y", 2), (None, 3)], "a string, b int")
    assert sorted(map(tuple, records.with_status(df, ["a"], spark.createDataFrame([("x", "known"), ("x", "known")], "id string, status string")).collect()), key=repr) == [("x", 1, "known"), ("y", 2, None), (None, 3, None)]


def test_probe_and_partition_on_random_graphs(spark):
    rng = random.Random(4)
    rows = {(rng.randrange(80), rng.randrange(80)) for _ in range(400)}
    edges = spark.createDataFrame(sorted(rows), "src bigint, dst bigint")
    asked = spark.createDataFrame([(i, j) for i in range(40) for j in range(3)], "src bigint, dst bigint")
    assert all(r.there == ((r.src, r.dst) in rows) for r in graph.probe(asked, edges).collect()) and graph.probe(asked, edges).count() == 120
    group = lambda n, by: spark.createDataFrame([(i, i % by if i % 9 else None) for i in range(n)] + [(5, 2), (5, 2)], "id bigint, group int")
    one, other = group(60, 4), group(30, 3)
    every = one.withColumnsRenamed({"id": "src"}).join(other.withColumnsRenamed({"id": "dst"}), "group").select("src", "dst")
    want = (every.count(), graph.probe(every, edges).filter("there").count())
    for some in (edges, edges.unionByName(edges)):
        counts = graph.probe_counts(one, other, some)
        assert tuple(counts.first()) == want and "there#" in counts._jdf.queryExecution().optimizedPlan().toString()
    near = [(c * 50 + rng.randrange(50), c * 50 + rng.randrange(50)) for c in range(4) for _ in range(900)] + [(rng.randrange(200), rng.randrange(200)) for _ in range(60)]
    e = spark.createDataFrame(near, "src bigint, dst bigint")
    for rule in ("ldg", "fennel"):
        placed = graph.partition(e, 4, rule)
        assert placed.count() == graph.nodes_of(e).count() == placed.select("id").distinct().count()
        cut = graph.edge_cut(e, placed).first()
        assert cut["balance"] <= 1.35 and cut["share"] < 0.74, rule


def test_warm_ranks_and_gated_grounding(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "src string, dst string")
    far = {r.id: r["rank"] for r in graph.pagerank(e, rounds=40).collect()}
    warm = {r.id: r["rank"] for r in graph.pagerank(e, rounds=1, start=spark.createDataFrame(list(far.items()), "id string, rank double")).collect()}
    assert all(abs(far[k] - warm[k]) < 1e-3 for k in far) and abs(sum(warm.values()) - 1) < 1e-9
    nodes = spark.createDataFrame([("a", "the harbour"), ("b", "a hill"), ("c", "a lake")], "id string, text string")
    vectors = spark.createDataFrame([("b", [1.0, 0.1]), ("c", [0.0, 1.0]), ("d", None)], "id string, embedding array<double>")
    assert [(r.id, r.words) for r in search.ground_hybrid(nodes, "Where is the harbour?", vectors, [1.0, 0.0]).collect()] == [("a", 1), ("b", 0)]


def test_shapes_values_and_sql_functions(spark):
    data = spark.createDataFrame([("s1", "rdf:type", "Ship"), ("s2", "rdf:type", "Ship"), ("s1", "draught", "11"), ("s2", "draught", "x"), ("s2", "draught", "4")], "s string, p string, o string")
    got = patterns.validate(data, [{"target": "Ship", "path": "draught", "max": 1, "pattern": r"^\d+$"}, {"target": "Ship", "path": "flag", "min": 1}])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([("s2", "draught", "max", None), ("s2", "draught", "pattern", "x"), ("s1", "flag", "min", None), ("s2", "flag", "min", None)], key=repr)
    with pytest.raises(ValueError):
        patterns.validate(data, [{"target": "Ship", "path": "x", "colour": 1}])
    assert [r[0] for r in patterns.select("SELECT ?s WHERE { ?s draught ?d . VALUES ?d { 11 12 } }", data).collect()] == ["s1"]
    sql.register(spark)
    row = spark.sql("SELECT weft_plain('  Ann   LEE '), weft_reference(' N/A '), weft_card_ok('4111 1111 1111 1111'), weft_mean(v) FROM VALUES (1.0D), (3.0D) t(v) GROUP BY ALL").first()
    assert tuple(row) == ("ann lee", None, True, 2.0)


def test_robots_delay_groups_and_crawl(spark):
    content = "# site\nUser-agent: *\nDisallow: /\n\nUser-agent: weft\nUser-agent: other\nAllow: /a\nDisallow: /a/b # not this\nCrawl-delay: 1.5\n"
    rules, delay = text.robots_rules(content, "weft/1.0")
    assert rules == [("allow", "/a"), ("disallow", "/a/b")] and delay == 1.5 and text.robots_rules(content)[0] == [("disallow", "/")] and text.robots_rules(None) == ([], None)
    paths = ["/a", "/a/b", "/a/bc", "/c", "/"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    assert [r[0] for r in df.select(text.may_fetch(F.col("p"), rules)).collect()] == [text.robots_allowed(rules, p) for p in paths]
    pages = spark.createDataFrame([("https://h.x/a", '<a href="/a/b">b</a> <a href="/c">c</a>'), ("https://h.x/a/b", ""), ("https://h.x/c", "")], "url string, html string")
    seeds = spark.createDataFrame([("https://h.x/a",)], "url string")
    assert sorted(r.url for r in logs.crawl(pages, seeds, 3, rules=rules).collect()) == ["https://h.x/a", "https://h.x/c"]


def test_sources_that_fail_and_other_ways_to_look_up(spark):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "k string, n int")
    rows, failed = mart.federate({"one": lambda: df, "two": lambda: df.select("nothing")}, "k", 5, [F.col("n")])
    assert failed == ["two"] and rows.count() == 2
    with pytest.raises(RuntimeError, match="all sources"):
        mart.federate({"two": lambda: df.select("nothing")}, "k", 5, [F.col("n")])
    own = mart.lookup_absolute(df, df, ["k"], "n", "n", resolve=lambda d, f, keys: d.withColumn("reference_value", F.lit("mine")))
    assert {r.reference_value for r in own.collect()} == {"mine"}
    ranked, out = search.rank_candidates(spark.createDataFrame([("x", ["v"], 0.9, True, "gold"), ("y", ["v"], 0.9, True, "none")], "id string, verbs array<string>, trust double, verified boolean, access string"), ["v"], 0.1, grade=lambda a: F.when(a == "gold", 0.5))
    assert [(r.id, r.score) for r in ranked.collect()] == [("x", 0.45)] and [r.id for r in out.collect()] == ["y"]


def test_buckets_statements_and_shifts(spark):
    df = spark.createDataFrame([("a", 1.0, 10), ("a", 2.0, 30), ("a", float("inf"), 40), ("b", float("inf"), 0)], "k string, le double, n bigint")
    assert [(r.k, r.value) for r in records.bucket_quantile(df, ["k"], "le", "n", 0.5).collect()] == [("a", 1.5)]
    assert records.bucket_quantile(df, ["k"], "le", "n", 0.99).first()["value"] == 2.0
    t = spark.createDataFrame([("Ann Lee wrote the first draft. It might fail, perhaps.",), (None,)], "t string")
    said = t.select(text.statements(F.col("t")).alias("s"), text.stance(F.col("t")).alias("m")).collect()
    assert [tuple(x) for x in said[0].s] == [("Ann Lee", "wrote", "the first draft")] and said[0].m.tone == "hedged" and said[1].s == [] and said[1].m.tone == "neutral"
    d = spark.createDataFrame([("1980", 1), ("1980-05-04", 1), ("1980-05-06", 1), ("soon", 1), (None, 1)], "d string, s int").select(stats.date_shift_text(F.col("d"), F.col("s"), "key").alias("m"))
    m = [r.m for r in d.collect()]
    assert m[0] == "1980" and m[3] == "unshiftable" and m[4] is None and (int(m[2][-2:]) - int(m[1][-2:])) in (2, 2 - 31, 2 - 30, 2 - 28, 2 - 29)
