import json
import random

from pyspark.sql import functions as F

from weftline.operators import nested
from weftline.session import load


def brute_links(record_id, body):
    """Plain recursion over a body, written apart from the operator."""
    try:
        root = json.loads(body) if body is not None else None
    except ValueError:
        return set()
    name = lambda k: "".join("_" + c.lower() if c.isupper() else c for c in k).lstrip("_").replace("-", "_")
    out = set()

    def opened(v):
        if isinstance(v, str) and v.strip()[:1] in ("{", "["):
            try:
                return json.loads(v)
            except ValueError:
                return v
        return v

    def many(v):
        v = opened(v)
        return [y for x in v for y in many(x)] if isinstance(v, list) else [] if v is None else [v]

    def walk(o, action):
        o = opened(o)
        if isinstance(o, list):
            for x in o:
                walk(x, action)
        if not isinstance(o, dict):
            return
        o = {name(k): v for k, v in o.items()}
        for k, v in o.items():
            if k == "actions":
                for a in many(v):
                    if isinstance(a, dict):
                        held = {name(x): y for x, y in a.items()}
                        parent = action[0] if action else o.get("routine_id")
                        if parent is not None and held.get("action_id") is not None:
                            out.add((record_id, "action", str(parent), str(held["action_id"])))
                        walk(a, (held.get("action_id"),))
                continue
            if k == "basis":
                for b in many(v):
                    if isinstance(b, dict):
                        for ref in many({name(x): y for x, y in b.items()}.get("policy_refs")):
                            if o.get("decision_id") is not None and not isinstance(ref, dict):
                                out.add((record_id, "policy_ref", str(o["decision_id"]), str(ref)))
            if k == "declarative_updates":
                for u in many(v):
                    if isinstance(u, dict):
                        s = {name(x): y for x, y in u.items()}.get("strategy")
                        if s is not None and o.get("profile_id") is not None:
                            out.add((record_id, "strategy", str(o["profile_id"]), str(s)))
            walk(v, action)

    walk(root, None)
    return out


def test_links_equal_brute_force_on_the_test_records(spark, sf):
    bodies = load(spark, sf, "fired_records")
    want = set().union(*(brute_links(r.record_id, r.body) for r in bodies.collect()))
    assert {tuple(r) for r in nested.record_links(bodies).collect()} == want and len(want) > 100


def random_record(rng, depth=0):
    action = lambda d: {rng.choice(["action_id", "actionId"]): rng.choice([None, f"a{rng.randrange(99)}"]), **({"actions": group(d + 1)} if d < 3 and rng.random() < 0.5 else {}), **({"on_failure": {"actions": group(d + 1)}} if d < 3 and rng.random() < 0.2 else {}), **({"guard": {"decision": decision()}} if rng.random() < 0.3 else {})}

    def group(d):
        items = [action(d) for _ in range(rng.randrange(3))]
        return items[0] if len(items) == 1 and rng.random() < 0.5 else items

    def decision():
        basis = {rng.choice(["policy_refs", "policyRefs"]): rng.choice([None, [], "p0", ["p1", None, "p2", "p1"], [["p3"]]])}
        return {"decision_id": rng.choice([None, f"d{rng.randrange(9)}"]), "basis": json.dumps(basis) if rng.random() < 0.3 else basis, "decision": {"outcome": "x"}}

    routine = {"routine_id": rng.choice([None, "r1"]), "actions": group(0), "trigger": {"kind": "k"}}
    profile = {"profile_id": "f1", "declarative_updates": rng.choice([None, {"strategy": "s"}, [{"strategy": "s", "gate": {"decision": decision()}}, {"strategy": None}]])}
    one = rng.choice([{"routine": routine}, {"routine": json.dumps(routine)}, decision(), profile, {"records": [{"record": decision()}, {"record": {"routine": routine}}]}])
    return json.dumps({"envelope": {"body": one}} if rng.random() < 0.3 else one)


def test_links_equal_brute_force_on_random_records(spark):
    rng = random.Random(7)
    rows = [(i, random_record(rng)) for i in range(400)]
    df = spark.createDataFrame(rows + rows[:20], "record_id bigint, body string")
    assert {tuple(r) for r in nested.record_links(df).collect()} == set().union(*(brute_links(*r) for r in rows))


def test_bad_null_empty_and_long_bodies(spark):
    deep = '{"routine":{"routine_id":"r","actions":' + '[{"action_id":"a","actions":' * 60 + "[]" + "}]" * 60 + "}}"
    rows = [(1, None), (2, ""), (3, "{"), (4, "[]"), (5, "null"), (6, '"x"'), (7, '{"basis": NaN}'), (8, deep), (9, '{"decision_id": "d", "basis": {"policy_refs": ["' + "x" * 200_000 + '"]}}'), (10, "[" * 100_000)]
    df = spark.createDataFrame(rows, "record_id bigint, body string").withColumn("row_no", F.lit(1)).withColumn("table_name", F.lit("x"))
    got = nested.record_links(df).collect()
    assert sorted((r.record_id, r.link) for r in got) == [(8, "action"), (8, "action"), (9, "policy_ref")]
    assert nested.record_links(df.limit(0)).count() == 0


def test_plan_and_round_trip(spark):
    body = json.dumps({"id": 1, "name": {"first": "A", "last": "B"}, "tags": ["x", "y"], "home": {"city": "C"}, "work": {"city": "D", "boss": {"name": {"first": "E"}}}, "kids": [{"n": 1}, {"n": 2}]})
    df = spark.createDataFrame([(1, body)], "record_id bigint, body string")
    flat = nested.flatten(df)
    plan = flat.plan
    assert plan.reasons["tags"] == plan.reasons["kids"] == "repeated" and plan.reasons["name"] == "shared" and "home" not in plan.tables
    rows = {r.row_no: r for r in flat.rows.collect()}
    root = rows[0]
    assert root.columns["home.city"] == "C" and root.columns["work.city"] == "D" and root.columns["id"] == "1"
    by = sorted((r.table_name, r.parent_row, r.ordinal, tuple(sorted(r.columns.items()))) for r in rows.values() if r.row_no)
    assert by == [("kids", 0, 0, (("n", "1"),)), ("kids", 0, 1, (("n", "2"),)), ("name", 0, 0, (("first", "A"), ("last", "B"))), ("name", 0, 0, (("first", "E"),)), ("tags", 0, 0, (("value", "x"),)), ("tags", 0, 1, (("value", "y"),))]


    home = flat.table("record").collect()[0]
    assert home.id == 1 and home.home__city == "C" and dict(flat.table("record").dtypes)["id"] == "bigint"


def test_a_wrong_guess_is_put_right_by_the_whole_schema(spark, monkeypatch):
    """The first bodies show one kid each; only a later one shows that kids repeat."""
    monkeypatch.setattr(nested, "GUESS_ROWS", 2)
    bodies = [json.dumps({"id": i, "kid": {"n": i, "age": 1.5}}) for i in range(6)] + [json.dumps({"id": 9, "kid": [{"n": 7}, {"n": "8"}]})]
    df = spark.createDataFrame(list(enumerate(bodies)) + [(0, bodies[0])], "record_id bigint, body string").coalesce(1)
    flat = nested.flatten(df)
    assert flat.plan.reasons == {"kid": "repeated"}
    kids = flat.table("kid")
    assert kids.count() == 8 and dict(kids.dtypes)["n"] == "string" and dict(kids.dtypes)["age"] == "double" and {r.parent_table for r in kids.collect()} == {"record"}


def test_recursive_elements_get_a_table():
    edges = [("record", "node", 1, 1, 1), ("node", "left", 1, 1, 1), ("left", "node", 1, 1, 1)]
    assert nested.inline_plan([("record", "a", 1, 1, 1), ("a", "b", 1, 1, 1), ("b", "a", 1, 1, 1)]).reasons == {"a": "shared", "b": "recursive"}
    assert nested.inline_plan(edges).reasons["node"] == "shared"
