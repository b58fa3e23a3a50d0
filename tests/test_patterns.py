import pytest

from weftline.plans import patterns


@pytest.fixture(scope="module")
def world(spark):
    """Four ships and a port: who tows whom, and where they lie."""
    nodes = spark.createDataFrame([("s1", ["Ship"], {"title": "Heron", "draught": "11"}), ("s2", ["Ship"], {"title": "Ibis", "draught": "4"}), ("s3", ["Ship", "Tug"], {"title": "Jay"}), ("p1", ["Port"], {"title": "Quay"})], "id string, labels array<string>, properties map<string,string>")
    edges = spark.createDataFrame([("s3", "s1", "TOWS"), ("s3", "s2", "TOWS"), ("s1", "s2", "TOWS"), ("s1", "p1", "LIES"), ("s3", "p1", "LIES")], "src string, dst string, label string")
    return nodes, edges


@pytest.mark.parametrize(("text", "want"), [
    ("MATCH (v:Ship) RETURN v, v.title", [("s1", "Heron"), ("s2", "Ibis"), ("s3", "Jay")]), ("MATCH (v) RETURN v LIMIT 2", [("p1",), ("s1",)]), ("MATCH (v)-[:TOWS]->(w) WHERE w.draught > 9 RETURN v", [("s3",)]),
    ("MATCH (v)-[:TOWS]->(w) WHERE w.draught < 9 AND v.title <> 'Jay' RETURN v, w", [("s1", "s2")]), ("MATCH (q:Port {title:'Quay'})<-[:LIES]-(v:Tug) RETURN v.title", [("Jay",)]), ("MATCH (v:Ship) RETURN v.draught, v ORDER BY v DESC LIMIT 1", [(None, "s3")]), ("MATCH (v {id:'s3'})-->(w)-->(x) RETURN x", [("p1",), ("s2",)]),
])
def test_match(world, text, want):
    assert sorted(map(tuple, patterns.match(text, *world).collect()), key=repr) == sorted(want, key=repr)


@pytest.mark.parametrize("text", ["MATCH (a), (b) RETURN a", "MATCH (a)-[:K]-(b) RETURN a", "MATCH (a) RETURN z", "MATCH (a) WHERE a.x =~ 'y' RETURN a", "MATCH (a) DELETE a", "MATCH (a)-[:K*1..2]->(b) RETURN b", "MATCH (a {name: b}) RETURN a", "MATCH (a) RETURN count(a)", ""])
def test_match_refuses_the_rest(world, text):
    with pytest.raises(ValueError):
        patterns.match(text, *world)


@pytest.mark.parametrize(("text", "want"), [
    ("g.V().limit(2)", ["p1", "s1"]), ("g.V('s3').out('TOWS').out('LIES')", ["p1"]), ("g.V().hasLabel('Port').in('LIES').values('title')", ["Heron", "Jay"]), ("g.V('s2').both()", ["s1", "s3"]), ("g.V().out('LIES')", ["p1", "p1"]), ("g.V().out('LIES').dedup()", ["p1"]), ("g.V().has('title','Ibis').count()", ["1"]),
])
def test_steps(world, text, want):
    assert sorted(r.value for r in patterns.steps(text, *world).collect()) == want


def test_steps_refuse_the_rest(world):
    for bad in ("g.E()", "g.V().repeat(out())", "g.V().values('a').out()", "V()", "g.V().order().by('x')"):
        with pytest.raises(ValueError):
            patterns.steps(bad, *world)


@pytest.fixture(scope="module")
def facts(spark):
    return spark.createDataFrame([("elm", "shades", "fern"), ("fern", "shades", "moss"), ("elm", "height", "31"), ("fern", "height", "2"), ("moss", "on", "stone")], "s string, p string, o string")


@pytest.mark.parametrize(("text", "want"), [
    ("SELECT ?s ?o WHERE { ?s shades ?o }", [("elm", "fern"), ("fern", "moss")]), ("SELECT ?x WHERE { ?x shades ?y . ?y shades ?z }", [("elm",)]), ("SELECT ?x WHERE { ?x height ?n . FILTER(?n > 10) }", [("elm",)]), ("SELECT ?x WHERE { {?x shades fern} UNION {?x on stone} }", [("elm",), ("moss",)]),
    ("SELECT ?x ?n WHERE { ?y shades ?x . OPTIONAL {?x height ?n} }", [("fern", "2"), ("moss", None)]), ("SELECT ?x WHERE { ?x ?p ?o . MINUS {?x height ?n} }", [("moss",)]), ("SELECT ?p (COUNT(?s) AS ?n) WHERE { ?s ?p ?o } GROUP BY ?p", [("height", 2), ("on", 1), ("shades", 2)]), ("ASK { elm shades ?x }", [(True,)]), ("ASK { moss shades ?x }", [(False,)]), ("SELECT DISTINCT ?p WHERE { ?s ?p ?o } LIMIT 1", [("height",)]),
])
def test_select(facts, text, want):
    assert sorted(map(tuple, patterns.select(text, facts).collect()), key=repr) == sorted(want, key=repr)


def test_select_refuses_the_rest(facts):
    for bad in ("SELECT ?s WHERE { ?s shades ?o . ?x height ?y }", "SELECT ?z WHERE { ?s shades ?o }", "SELECT ?s WHERE { SERVICE <u> { ?s ?p ?o } }", "CONSTRUCT { ?s ?p ?o } WHERE { ?s ?p ?o }", "SELECT ?s WHERE { }", "SELECT (SUM(?o) AS ?n) WHERE { ?s height ?o }", "SELECT ?s (COUNT(?o) AS ?n) WHERE { ?s height ?o }"):
        with pytest.raises(ValueError):
            patterns.select(bad, facts)
