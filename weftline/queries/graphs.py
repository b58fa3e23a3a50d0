"""Graph queries over the trade graph (customers, suppliers, parts, nations, regions) and the event graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.plans import cypher, patterns
from weftline.session import load


def _name(letter, column):
    return F.concat(F.lit(letter), F.col(column).cast("string"))


def trade(spark, d):
    """Edges src, dst, label: BUYS_FROM, SUPPLIES, IN_NATION, IN_REGION."""
    c, s, o, i, n = load(spark, d, "customer", "supplier", "orders", "lineitem", "nation")
    # distinct by number, before the names: half the bytes to shuffle
    buys = o.join(i, o.o_orderkey == i.l_orderkey).select("o_custkey", "l_suppkey").distinct().select(_name("c", "o_custkey").alias("src"), _name("s", "l_suppkey").alias("dst"), F.lit("BUYS_FROM").alias("label"))
    supplies = i.select("l_suppkey", "l_partkey").distinct().select(_name("s", "l_suppkey").alias("src"), _name("p", "l_partkey").alias("dst"), F.lit("SUPPLIES").alias("label"))
    at = c.select(_name("c", "c_custkey").alias("src"), _name("n", "c_nationkey").alias("dst"), F.lit("IN_NATION").alias("label")).unionByName(s.select(_name("s", "s_suppkey").alias("src"), _name("n", "s_nationkey").alias("dst"), F.lit("IN_NATION").alias("label")))
    within = n.select(_name("n", "n_nationkey").alias("src"), _name("r", "n_regionkey").alias("dst"), F.lit("IN_REGION").alias("label"))
    return buys.unionByName(supplies).unionByName(at).unionByName(within)


TRADE = """trade AS (
  SELECT DISTINCT 'c' || o_custkey AS src, 's' || l_suppkey AS dst, 'BUYS_FROM' AS label FROM orders JOIN lineitem ON o_orderkey = l_orderkey
  UNION ALL SELECT DISTINCT 's' || l_suppkey, 'p' || l_partkey, 'SUPPLIES' FROM lineitem
  UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey, 'IN_NATION' FROM customer
  UNION ALL SELECT 's' || s_suppkey, 'n' || s_nationkey, 'IN_NATION' FROM supplier
  UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 'IN_REGION' FROM nation)"""


def event_edges(spark, d):
    """Distinct edges of the event graph, whatever became of them later."""
    e = load(spark, d, "hellgraph_events").filter("from_id <> '' and to_id <> '' and from_id is not null and to_id is not null")
    return e.select(F.col("from_id").alias("src"), F.col("to_id").alias("dst"), "label").distinct()


EVENT = "ev AS (SELECT DISTINCT from_id AS src, to_id AS dst, label FROM hellgraph_events WHERE from_id <> '' AND to_id <> '')"
EVENT_U = EVENT + ", u AS (SELECT src, dst FROM ev WHERE src <> dst UNION SELECT dst, src FROM ev WHERE src <> dst), nodes AS (SELECT src AS id FROM ev UNION SELECT dst FROM ev)"


def _ids(spark, *ids):
    return spark.createDataFrame([(x,) for x in ids], "id string")


def graph_stats(spark, d):
    e = trade(spark, d)
    return e.groupBy("label").agg(F.count(F.lit(1)).alias("edge_count"), F.countDistinct("src").alias("sources"), F.countDistinct("dst").alias("targets"))


def graph_degree(spark, d):
    return graph.degrees(trade(spark, d))


def graph_surface(spark, d):
    return graph.surface(trade(spark, d), 50)


def graph_induced(spark, d):
    e = trade(spark, d)
    keep = graph.nodes_of(e).filter("id like 'n%' or id like 's%'")
    return graph.induced(e, keep)


def graph_label_scan(spark, d):
    """Nodes whose comma-separated labels hold one label: the latest label text of each event node."""
    e = load(spark, d, "hellgraph_events").filter("event_id like 'node%' and seq is not null")
    last = e.groupBy("event_id").agg(F.max(F.struct("seq", "ingest_time", "label")).alias("m"))
    return last.select("event_id", F.split("m.label", ",").alias("labels")).filter(F.array_contains("labels", "Person")).select("event_id")


def graph_log_tail(spark, d):
    """A page of the log: changes after a cursor (exclusive), ascending, with the cursor to go on from."""
    e = load(spark, d, "hellgraph_events").filter("seq > 5000")
    page = e.orderBy("seq", "event_id", "ingest_time", "kind").limit(1000).select("seq", "event_id")
    return page.groupBy("event_id").agg(F.count(F.lit(1)).alias("changes"), F.max("seq").alias("cursor"))


def graph_khop(spark, d):
    return graph.khop(trade(spark, d), _ids(spark, "c1", "c2"), 2)


def graph_path(spark, d):
    return graph.path_plan(trade(spark, d), _ids(spark, "c1"), ["BUYS_FROM", "SUPPLIES"])


def graph_cypher_fixed(spark, d):
    return cypher.run("MATCH (a {id:'c5'})-[:BUYS_FROM]->(b)-[:IN_NATION]->(c)-[:IN_REGION]->(e) RETURN e", trade(spark, d))


def graph_cypher_var(spark, d):
    return cypher.run("MATCH (a)-[*2..3]->(b) WHERE a.id = 'c5' RETURN b", trade(spark, d))


def graph_wcc(spark, d):
    return graph.components(event_edges(spark, d))


def graph_component_sizes(spark, d):
    sizes = graph_wcc(spark, d).groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("n").agg(F.count(F.lit(1)).alias("components"))


def graph_bfs(spark, d):
    return graph.shortest_paths(trade(spark, d), _ids(spark, "c3")).select("id", F.col("distance").cast("int").alias("level"))


def _weighted(spark, d):
    o, i = load(spark, d, "orders", "lineitem")
    buys = o.join(i, o.o_orderkey == i.l_orderkey).select(_name("c", "o_custkey").alias("src"), _name("s", "l_suppkey").alias("dst"), F.col("l_quantity").alias("w"))
    back = i.select(_name("s", "l_suppkey").alias("src"), _name("p", "l_partkey").alias("dst"), (F.col("l_quantity") + 1).alias("w"))
    return buys.unionByName(back)


def graph_sssp(spark, d):
    return graph.shortest_paths(_weighted(spark, d), _ids(spark, "c3"), "w")


PR_ROUNDS = 8


def graph_pagerank(spark, d):
    return graph.pagerank(event_edges(spark, d), rounds=PR_ROUNDS).select("id", F.round("rank", 9).alias("rank"))


def graph_ppr(spark, d):
    return graph.pagerank(trade(spark, d), rounds=4, restart=_ids(spark, "c1", "s1")).filter("rank > 0").select("id", F.round("rank", 9).alias("rank"))


def graph_khop_ranked(spark, d):
    e = event_edges(spark, d)
    ranks = graph.pagerank(e, rounds=PR_ROUNDS)
    start = graph.degrees(e).orderBy(F.desc("out_degree"), "id").limit(5).select("id")
    near = graph.khop(e, start, 3)
    return near.join(ranks, "id").select("id", "hops", F.round("rank", 9).alias("rank")).orderBy(F.desc("rank"), "id").limit(25)


def graph_cdlp(spark, d):
    return graph.label_propagation(event_edges(spark, d), 3)


def graph_triangles(spark, d):
    t = graph.triangles(trade(spark, d))
    return t.select(F.explode(F.array("a", "b", "c")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("triangles"))


def graph_lcc(spark, d):
    return graph.clustering(trade(spark, d)).select("id", F.round("lcc", 9).alias("lcc"))


def graph_closure(spark, d):
    return graph.closure(trade(spark, d), _ids(spark, "c7"))


def graph_toposort(spark, d):
    return graph.topological_levels(trade(spark, d))


def graph_lineage(spark, d):
    return graph.lineage(trade(spark, d), _ids(spark, "s4"), ["BUYS_FROM", "IN_NATION", "IN_REGION"])


def graph_betweenness(spark, d):
    return graph.betweenness(trade(spark, d)).select("id", F.round("betweenness", 6).alias("betweenness"))


def graph_louvain(spark, d):
    e = event_edges(spark, d)
    return graph.louvain(e)


def graph_kronecker(spark, d):
    return graph.degrees(graph.kronecker(spark, 10, 8, 42)).groupBy("degree").agg(F.count(F.lit(1)).alias("n"))


def _pagerank_sql(edges, first, rounds, damping=0.85, restart=None):
    text = f"WITH {edges}, deg AS (SELECT src, count(*) AS n FROM e GROUP BY 1), ids AS (SELECT src AS id FROM e UNION SELECT dst FROM e), "
    base = f"CASE WHEN id IN ({restart}) THEN 1.0 / {restart.count(',') + 1} ELSE 0 END" if restart else "1.0 / (SELECT count(*) FROM ids)"
    text += f"b AS (SELECT id, ({base})::DOUBLE AS base FROM ids), r0 AS (SELECT id, base AS rank FROM b)"
    for k in range(1, rounds + 1):
        text += f""", r{k} AS MATERIALIZED (SELECT b.id, {1 - damping!r} * b.base + {damping} * (coalesce(g.g, 0) + b.base * (SELECT coalesce(sum(rank), 0) FROM r{k - 1} WHERE id NOT IN (SELECT src FROM deg))) AS rank
FROM b LEFT JOIN (SELECT dst, sum(rank / n) AS g FROM e JOIN deg USING (src) JOIN r{k - 1} ON id = src GROUP BY dst) g ON g.dst = b.id)"""
    return text, f"r{rounds}"


_PR, _PR_LAST = _pagerank_sql(EVENT + ", e AS (SELECT src, dst FROM ev)", None, PR_ROUNDS)
_PPR, _PPR_LAST = _pagerank_sql(TRADE + ", e AS (SELECT src, dst FROM trade)", None, 4, restart="'c1', 's1'")


def _wcc_sql(rounds=40):
    text = f"WITH {EVENT_U}, w0 AS (SELECT id, id AS c FROM nodes)"
    for k in range(1, rounds + 1):
        text += f", w{k} AS MATERIALIZED (SELECT id, min(c) AS c FROM (SELECT id, c FROM w{k - 1} UNION ALL SELECT u.dst, c FROM w{k - 1} JOIN u ON u.src = id) GROUP BY id)"
    return text, f"w{rounds}"


_WCC, _WCC_LAST = _wcc_sql()


def _cdlp_sql(rounds):
    text = f"WITH {EVENT}, both_ways AS (SELECT src, dst FROM ev UNION ALL SELECT dst, src FROM ev), l0 AS (SELECT id, id AS c FROM (SELECT src AS id FROM ev UNION SELECT dst FROM ev))"
    for k in range(1, rounds + 1):
        text += f", l{k} AS MATERIALIZED (SELECT dst AS id, c FROM (SELECT dst, c, count(*) AS v FROM both_ways JOIN l{k - 1} ON id = src GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY dst ORDER BY v DESC, c) = 1)"
    return text + f" SELECT id, c AS community FROM l{rounds}"


def _khop_sql(edges, start, most, prefix="h"):
    text = f"{prefix}0 AS (SELECT unnest([{start}]) AS id, 0 AS hops)" if "SELECT" not in start else f"{prefix}0 AS (SELECT id, 0 AS hops FROM ({start}))"
    for k in range(1, most + 1):
        text += f", {prefix}{k} AS MATERIALIZED (SELECT id, min(hops) AS hops FROM (SELECT * FROM {prefix}{k - 1} UNION ALL SELECT dst, hops + 1 FROM {prefix}{k - 1} JOIN {edges} ON src = id) GROUP BY id)"
    return text


_NEAR = f"WITH {TRADE}, u AS (SELECT src, dst FROM trade UNION SELECT dst, src FROM trade), t AS (SELECT a.src AS id, count(*) / 2 AS t FROM u a JOIN u b ON a.dst = b.src JOIN u c ON b.dst = c.src AND c.dst = a.src GROUP BY 1)"

QUERIES = {
    "graph_stats": (graph_stats, f"WITH {TRADE} SELECT label, count(*) AS edge_count, count(DISTINCT src) AS sources, count(DISTINCT dst) AS targets FROM trade GROUP BY 1"),
    "graph_degree": (graph_degree, f"WITH {TRADE} SELECT id, sum(o)::BIGINT AS out_degree, sum(i)::BIGINT AS in_degree, count(*) AS degree FROM (SELECT src AS id, 1 AS o, 0 AS i FROM trade UNION ALL SELECT dst, 0, 1 FROM trade) GROUP BY 1"),
    "graph_surface": (graph_surface, f"WITH {TRADE} SELECT id, count(*) AS degree FROM (SELECT src AS id FROM trade UNION ALL SELECT dst FROM trade) GROUP BY 1 ORDER BY degree DESC, id LIMIT 50"),
    "graph_induced": (graph_induced, f"WITH {TRADE} SELECT * FROM trade WHERE src[1] IN ('n', 's') AND dst[1] IN ('n', 's')"),
    "graph_label_scan": (graph_label_scan, "SELECT event_id FROM (SELECT event_id, label FROM hellgraph_events WHERE event_id LIKE 'node%' AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC, ingest_time DESC, label DESC NULLS LAST) = 1) WHERE list_contains(string_split(label, ','), 'Person')"),
    "graph_log_tail": (graph_log_tail, "WITH p AS (SELECT seq, event_id FROM hellgraph_events WHERE seq > 5000 ORDER BY seq, event_id, ingest_time, kind LIMIT 1000) SELECT event_id, count(*) AS changes, max(seq) AS cursor FROM p GROUP BY 1"),
    "graph_khop": (graph_khop, f"WITH {TRADE}, {_khop_sql('trade', chr(39) + 'c1' + chr(39) + ', ' + chr(39) + 'c2' + chr(39), 2)} SELECT * FROM h2 WHERE hops > 0"),
    "graph_path": (graph_path, f"WITH {TRADE} SELECT DISTINCT b.dst AS id FROM trade a JOIN trade b ON a.dst = b.src WHERE a.src = 'c1' AND a.label = 'BUYS_FROM' AND b.label = 'SUPPLIES'"),
    "graph_cypher_fixed": (graph_cypher_fixed, f"WITH {TRADE} SELECT DISTINCT c.dst AS id FROM trade a JOIN trade b ON a.dst = b.src JOIN trade c ON b.dst = c.src WHERE a.src = 'c5' AND a.label = 'BUYS_FROM' AND b.label = 'IN_NATION' AND c.label = 'IN_REGION'"),
    "graph_cypher_var": (graph_cypher_var, f"WITH {TRADE}, {_khop_sql('trade', chr(39) + 'c5' + chr(39), 3)} SELECT id FROM h3 WHERE hops BETWEEN 2 AND 3"),
    "graph_wcc": (graph_wcc, f"{_WCC} SELECT id, c AS component FROM {_WCC_LAST}"),
    "graph_component_sizes": (graph_component_sizes, f"{_WCC} SELECT n, count(*) AS components FROM (SELECT c, count(*) AS n FROM {_WCC_LAST} GROUP BY c) GROUP BY n"),
    "graph_bfs": (graph_bfs, f"WITH {TRADE}, {_khop_sql('trade', chr(39) + 'c3' + chr(39), 5)} SELECT id, hops AS level FROM h5"),
    "graph_sssp": (graph_sssp, "WITH a AS (SELECT 's' || l_suppkey AS id, min(l_quantity) AS d FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE o_custkey = 3 GROUP BY 1), b AS (SELECT 'p' || l_partkey AS id, min(d + l_quantity + 1) AS d FROM lineitem JOIN a ON id = 's' || l_suppkey GROUP BY 1) SELECT 'c3' AS id, 0.0::DOUBLE AS distance UNION ALL SELECT * FROM a UNION ALL SELECT * FROM b"),
    "graph_pagerank": (graph_pagerank, f"{_PR} SELECT id, round(rank, 9) AS rank FROM {_PR_LAST}"),
    "graph_ppr": (graph_ppr, f"{_PPR} SELECT id, round(rank, 9) AS rank FROM {_PPR_LAST} WHERE rank > 0"),
    "graph_khop_ranked": (graph_khop_ranked, f"{_PR}, {_khop_sql('ev', 'SELECT src AS id FROM (SELECT src, count(*) AS n FROM ev GROUP BY 1) ORDER BY n DESC, src LIMIT 5', 3)} SELECT h3.id, hops, round(rank, 9) AS rank FROM h3 JOIN {_PR_LAST} ON h3.id = {_PR_LAST}.id WHERE hops > 0 ORDER BY rank DESC, h3.id LIMIT 25"),
    "graph_cdlp": (graph_cdlp, _cdlp_sql(3)),
    "graph_triangles": (graph_triangles, _NEAR + " SELECT id, t::BIGINT AS triangles FROM t"),
    "graph_lcc": (graph_lcc, _NEAR + ", dg AS (SELECT src AS id, count(*) AS d FROM u GROUP BY 1) SELECT id, round(CASE WHEN d >= 2 THEN 2 * coalesce(t, 0) / (d * (d - 1)) ELSE 0 END, 9) AS lcc FROM dg LEFT JOIN t USING (id)"),
    "graph_closure": (graph_closure, f"WITH RECURSIVE {TRADE}, c AS (SELECT 'c7' AS id, 0 AS level UNION SELECT dst, level + 1 FROM c JOIN trade ON src = id) SELECT id, max(level) AS level FROM c GROUP BY 1"),
    "graph_toposort": (graph_toposort, f"WITH RECURSIVE {TRADE}, c AS (SELECT DISTINCT src AS id, 0 AS level FROM trade WHERE src NOT IN (SELECT dst FROM trade) UNION SELECT dst, level + 1 FROM c JOIN trade ON src = id) SELECT id, max(level) AS level FROM c GROUP BY 1"),
    "graph_lineage": (graph_lineage, f"WITH {TRADE}, f AS (SELECT src, dst FROM trade WHERE label <> 'SUPPLIES'), g AS (SELECT dst AS src, src AS dst FROM f), {_khop_sql('f', chr(39) + 's4' + chr(39), 4)}, {_khop_sql('g', chr(39) + 's4' + chr(39), 4, 'k')} SELECT id, hops, 'down' AS direction FROM h4 WHERE hops > 0 UNION ALL SELECT id, hops, 'up' FROM k4 WHERE hops > 0"),
    "graph_betweenness": (graph_betweenness, None),
    "graph_louvain": (graph_louvain, None),
    "graph_kronecker": (graph_kronecker, None),
}


def _property_nodes(spark, d):
    """id, labels, properties of the event graph's nodes, by their latest change."""
    e = load(spark, d, "hellgraph_events").filter("event_id like 'node%' and seq is not null")
    last = e.groupBy("event_id").agg(F.max(F.struct("seq", "ingest_time", "label", "properties")).alias("m"))
    return last.select(F.col("event_id").alias("id"), F.split("m.label", ",").alias("labels"), F.from_json("m.properties", "map<string,string>").alias("properties"))


def graph_explore(spark, d):
    return graph.explore(trade(spark, d), _ids(spark, "s1", "s2"), 20).select("id", "rank")


def graph_enrich(spark, d):
    return graph.enrich_class(_property_nodes(spark, d), "Device").select("key", F.round("coverage", 6).alias("coverage"))


def graph_edge_cut(spark, d):
    e = trade(spark, d)
    parts = graph.nodes_of(e).select("id", F.pmod(F.regexp_extract("id", r"(\d+)", 1).cast("int"), F.lit(4)).alias("part"))
    return graph.edge_cut(e, parts).select("cut", "edges", F.round("share", 6).alias("share"), F.round("balance", 6).alias("balance"))


def graph_scope(spark, d):
    e = trade(spark, d)
    _, seen = graph.scope(graph.nodes_of(e), e, ~F.col("id").startswith("p") & ~F.col("id").endswith("3"))
    return seen


def graph_ground(spark, d):
    from weftline.operators import search

    n = load(spark, d, "nation").select(_name("n", "n_nationkey").alias("id"), F.col("n_name").alias("text"))
    e = trade(spark, d).filter("label in ('IN_NATION', 'IN_REGION') and src not like 'c%'")
    return search.ground(n, e, e.select(F.col("src").alias("s"), F.col("label").alias("p"), F.col("dst").alias("o")), "which suppliers are in NATION_7 or nation_3?")


def graph_match(spark, d):
    return patterns.match("MATCH (a:Device)-[:DEPENDS_ON]->(b) WHERE a.weight > 50 RETURN a, b, b.owner", _property_nodes(spark, d), event_edges(spark, d))


def graph_steps(spark, d):
    return patterns.steps("g.V().hasLabel('Device').out('DEPENDS_ON').dedup()", _property_nodes(spark, d), event_edges(spark, d))


def graph_select(spark, d):
    t = trade(spark, d).select(F.col("src").alias("s"), F.col("label").alias("p"), F.col("dst").alias("o"))
    return patterns.select("SELECT ?n (COUNT(?c) AS ?customers) WHERE { ?c BUYS_FROM s1 . ?c IN_NATION ?n } GROUP BY ?n", t)


_NODES = "nd AS (SELECT event_id AS id, label, properties FROM hellgraph_events WHERE event_id LIKE 'node%' AND seq IS NOT NULL QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY seq DESC, ingest_time DESC NULLS LAST, label DESC NULLS LAST, properties DESC NULLS LAST) = 1), dev AS (SELECT * FROM nd WHERE list_contains(string_split(label, ','), 'Device'))"

QUERIES |= {
    "graph_explore": (graph_explore, None),
    "graph_enrich": (graph_enrich, f"WITH {_NODES} SELECT key, round(count(DISTINCT id) / (SELECT count(*) FROM dev), 6) AS coverage FROM (SELECT id, unnest(json_keys(properties)) AS key FROM dev WHERE properties IS NOT NULL) GROUP BY 1"),
    "graph_edge_cut": (graph_edge_cut, f"WITH {TRADE}, e AS (SELECT src, dst, src[2:]::INT % 4 AS pa, dst[2:]::INT % 4 AS pb FROM trade), z AS (SELECT p, count(*) AS n FROM (SELECT src AS id, pa AS p FROM e UNION SELECT dst, pb FROM e) GROUP BY 1) SELECT count(*) FILTER (WHERE pa <> pb) AS cut, count(*) AS edges, round(count(*) FILTER (WHERE pa <> pb) / count(*), 6) AS share, (SELECT round(max(n) / avg(n), 6) FROM z) AS balance FROM e"),
    "graph_scope": (graph_scope, f"WITH {TRADE} SELECT * FROM trade WHERE src[1] <> 'p' AND dst[1] <> 'p' AND src[-1] <> '3' AND dst[-1] <> '3'"),
    "graph_ground": (graph_ground, f"WITH {TRADE}, s AS (SELECT 'n' || n_nationkey AS id FROM nation WHERE n_name LIKE '%NATION%' ORDER BY 1), e AS (SELECT * FROM trade WHERE label IN ('IN_NATION', 'IN_REGION') AND src[1] <> 'c'), seeds AS (SELECT id FROM (SELECT id, 1 + 0 AS h FROM s) ORDER BY h DESC, id LIMIT 12), seen AS (SELECT id FROM seeds UNION SELECT dst FROM e JOIN seeds ON src = id UNION SELECT src FROM e JOIN seeds ON dst = id) SELECT row_number() OVER (ORDER BY src, label, dst)::INT AS n, src AS s, label AS p, dst AS o FROM (SELECT DISTINCT src, label, dst FROM e WHERE src IN (SELECT id FROM seen) ORDER BY src, label, dst LIMIT 24)"),
    "graph_match": (graph_match, f"WITH {EVENT}, {_NODES} SELECT a.id AS a, b.id AS b, json_extract_string(b.properties, '$.owner') AS b_owner FROM dev a JOIN (SELECT DISTINCT src, dst FROM ev WHERE label = 'DEPENDS_ON') e ON e.src = a.id JOIN nd b ON b.id = e.dst WHERE TRY_CAST(json_extract_string(a.properties, '$.weight') AS DOUBLE) > 50"),
    "graph_steps": (graph_steps, f"WITH {EVENT}, {_NODES} SELECT DISTINCT dst AS value FROM ev WHERE label = 'DEPENDS_ON' AND src IN (SELECT id FROM dev)"),
    "graph_select": (graph_select, f"WITH {TRADE} SELECT b.dst AS n, count(DISTINCT b.src) AS customers FROM trade a JOIN trade b ON a.src = b.src AND a.label = 'BUYS_FROM' AND a.dst = 's1' AND b.label = 'IN_NATION' GROUP BY 1"),
}
