import pytest
from pyspark.sql import functions as F

from weftline.operators import er

DDL = "id string, name string, attributes map<string,string>, scope string, primes array<string>"


def frame(spark, *rows):
    return spark.createDataFrame([r + ({}, "process", [])[len(r) - 2 :] for r in rows], DDL)


def groups(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.entity, set()).add(r.id)
    return sorted(map(sorted, out.values()))


def decisions(spark, *rows):
    f = frame(spark, *rows)
    return {(r.a, r.b): r.decision for r in er.decisive(er.score_pairs(f, er.block_pairs(f))).collect()}


@pytest.mark.parametrize(("a", "b", "want"), [("martha", "marhta", 0.9611), ("dixon", "dicksonx", 0.8133), ("same", "same", 1.0), ("", "", 1.0), ("a", "", 0.0), ("abc", "xyz", 0.0)])
def test_jaro_winkler(a, b, want):
    assert round(er.jaro_winkler_one(a, b), 4) == want


def test_half_transpositions_count_as_halves_and_the_boost_is_unconditional():
    # all eight match, three of them stand elsewhere: 1.5 transpositions; prefix 2
    jaro = (1 + 1 + (8 - 1.5) / 8) / 3
    assert abs(er.jaro_winkler_one("abcdefgh", "abecdfgh") - (jaro + 0.2 * (1 - jaro))) < 1e-12
    weak = (1 / 4 + 1 / 4 + 1) / 3
    assert abs(er.jaro_winkler_one("abcd", "axyz") - (weak + 0.1 * (1 - weak))) < 1e-12


def test_equal_names_merge_and_conflicts_block(spark):
    assert decisions(spark, ("1", "Ann Lee"), ("2", " ann  lee", {"city": "x"})) == {}  # 0.7 by name, no attribute in common
    email = lambda v: {"email": v}
    assert decisions(spark, ("1", "Ann Lee", email("a@x")), ("2", "Ann Lee", email("b@x"))) == {("1", "2"): "MERGE_BLOCKED"}
    assert decisions(spark, ("1", "Ann Lee", email("a@x")), ("2", "Ann Leo", email("A@x "))) == {("1", "2"): "MERGE_VERIFIED"}
    assert decisions(spark, ("1", "Ann Lee", {}, "hsm", ["patient"]), ("2", "Ann Lee", {}, "cloud", ["founder"])) == {("1", "2"): "MERGE_BLOCKED"}


def test_a_name_alone_needs_a_clear_margin(spark):
    two = decisions(spark, ("1", "Ann Lee", {}, "a"), ("2", "ann lee", {}, "b"))
    assert two == {("1", "2"): "MERGE_VERIFIED"}
    three = decisions(spark, ("1", "Ann Lee", {}, "a"), ("2", "ann lee", {}, "b"), ("3", "Ann  Lee", {}, "c"))
    assert set(three.values()) == {"REQUIRES_REVIEW"}


def test_no_entity_holds_two_values_of_an_identifying_key(spark):
    rows = [("a", "Ann Lee", {"ssn": "1", "city": "x"}), ("b", "Ann Lee", {"city": "x", "zip": "9"}), ("c", "Ann Lee", {"ssn": "2", "zip": "9"})]
    assert groups(er.resolve(frame(spark, *rows))) in ([["a", "b"], ["c"]], [["a"], ["b", "c"]])


def test_copies_never_meet_and_share_an_entity(spark):
    rows = [(f"k{i:04d}", "Ann Lee", {"email": "a@x"}) for i in range(500)] + [("z", "Ann Leigh", {"email": "a@x"})]
    f = frame(spark, *rows)
    assert er.block_pairs(f).count() == 1 and groups(er.resolve(f)) == [sorted(r[0] for r in rows)]


def test_golden_record_fills_gaps_in_order(spark):
    f = frame(spark, ("a", "Ann Lee", {"email": "a@x", "city": "x", "zip": "1"}, "cloud"), ("b", "Ann Lee", {"email": "a@x", "city": "y", "job": "j"}, "hsm"), ("c", "Ann L", {"email": "a@x", "tel": "5"}, "hsm"))
    g = er.golden(f, er.resolve(f)).collect()
    assert len(g) == 1 and g[0].survivor == "b" and g[0].attributes == {"email": "a@x", "city": "y", "job": "j", "zip": "1", "tel": "5"} and g[0].members == 3


def test_new_records_attach_to_anchors_only_anew(spark):
    f = frame(spark, ("a", "Ann Lee", {"email": "a@x"}), ("b", "Ann Lee", {"email": "a@x", "zip": "1"}), ("n", "Ann Leo", {"email": "a@x"}))
    anchors = spark.createDataFrame([("a",), ("b",)], "id string")
    assert {(r.a, r.b) for r in er.block_pairs(f, anchors).collect()} == {("a", "n"), ("b", "n")}


def test_nulls_and_empty(spark):
    f = spark.createDataFrame([("a", None, None, None, None), ("b", "", {}, None, []), ("c", None, {"email": None}, "x", None), (None, "x", None, None, None)], DDL).withColumn("block", F.lit(1))
    assert er.resolve(f).count() == 3 and er.resolve(f.limit(0)).count() == 0


def test_pairs_with_unlike_keys_are_not_listed(spark):
    """300 people of one name and as many e-mail addresses: records meet where what both know of a person is equal."""
    rows = [(f"a{i:03d}", "Ann Lee", {"email": f"u{i}@x"}) for i in range(300)] + [(f"b{i:03d}", "Ann Lee", {"email": f"U{i}@x", "zip": "1"}) for i in range(300)]
    rows += [("p", "Ann Lee", {"email": "u7@x", "ssn": "1"}), ("q", "Ann Lee", {"ssn": "1"}), ("r", "Ann Lee", {"ssn": "2"}), ("s", "Ann Leo", {})]
    reps = er._sides(er._prepared(frame(spark, *rows))).select("id", "block", "_s", F.lit(False).alias("known"))
    sides = {r[0]: {k: v.lower() for k, v in r[2].items() if k in er.EXCLUSIVE} for r in rows}
    fits = lambda a, b: all(sides[b].get(k, v) == v for k, v in sides[a].items())
    want = {(a, b) for a in sides for b in sides if a < b and fits(a, b)}
    met = er._unblocked(reps)
    assert {(r.a, r.b) for r in met.select("a", "b").collect()} == want and met.count() == len(want)
    on = met._jdf.queryExecution().optimizedPlan().toString()
    assert "_v" in on  # values are part of what the join asks, so unlike ones are never paired
    assert len([g for g in groups(er.resolve(frame(spark, *rows[:-3]))) if len(g) == 2]) == 299


def test_pairs_are_scored_where_they_meet(spark, sf):
    from weftline.queries import er as queries

    r = queries.records(spark, sf).filter("substring(id, 2) < '000000120'")
    rows = lambda df: sorted(map(repr, df.collect()))
    found = er.score_blocks(r)
    assert rows(found) == rows(er.score_pairs(r, er.block_pairs(r))) != []
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") == 1  # pairs are not joined with records again


def test_names_compared_at_once_equal_one_by_one():
    import random

    import numpy as np

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcde \u00e9\U0001d4b3") for _ in range(rng.choice([0, 1, 2, 3, 5, 8, 13, 20, er.LONG, er.LONG + 1])))
    a = [word() for _ in range(2000)]
    b = [rng.choice([word(), x, x[1:], x[::-1]]) for x in a]
    assert er.jaro_winkler_many(np.array(a, dtype=object), np.array(b, dtype=object)).tolist() == [er.jaro_winkler_one(*p) for p in zip(a, b)]
    assert er.jaro_winkler_many(np.array([], dtype=object), np.array([], dtype=object)).tolist() == []


@pytest.mark.parametrize("keys", [2, 6, 9])
def test_blocks_are_scored_as_pairs_are(spark, keys, monkeypatch):
    """Absent, empty and unlike attributes, primes with nulls, scopes without; groups and tiles smaller than a name's records; few keys and many."""
    import random

    monkeypatch.setattr(er, "GROUP", 16), monkeypatch.setattr(er, "TILE", 4)
    rng = random.Random(keys)
    names = ["Ann Lee", "ANN  lee", "Ann Leo", "Anna Lee", "Annabel Lee", "Bo", "", None]
    held = ["email", "ssn", "city", "zip", "tel", "job", "dob", "x", "y"][:keys]
    rows = [
        (f"i{i:03d}", rng.choice(names), {k: rng.choice(["1", "2", "A", "a ", "", None]) for k in rng.sample(held, rng.randrange(keys + 1))} if rng.random() < 0.9 else None, rng.choice(["hsm", "cloud", None]), rng.choice([["p"], ["p", "q"], ["r", None], [], None]))
        for i in range(150)
    ]
    f = spark.createDataFrame(rows, DDL)
    shown = lambda df: sorted(map(repr, df.collect()))
    want = shown(er.score_pairs(f, er.block_pairs(f)))
    assert len(want) > 1000 and shown(er.score_blocks(f)) == want
    live = "decision <> 'NO_MATCH'"
    assert shown(er.score_blocks(f).filter(live).select("a", "b", "score", "decision")) == shown(er.score_pairs(f, er.block_pairs(f)).filter(live).select("a", "b", "score", "decision"))


def test_names_are_compared_once_for_all_who_bear_them(spark):
    """400 records of two names: no Python call per pair, and loops that HotSpot compiles."""
    import re

    f = frame(spark, *[(f"i{i:03d}", ("Ann Lee", "Ann Leo")[i % 2], {"email": f"u{i}@x"}) for i in range(400)])
    scored = er.score_blocks(f).filter("decision <> 'NO_MATCH'").select("a", "b", "score", "decision")
    assert scored.count() == 400 * 399 // 2
    assert "EvalPython" not in scored._jdf.queryExecution().optimizedPlan().toString()
    code = spark._jvm.org.apache.spark.sql.execution.debug.package.codegenString(scored._jdf.queryExecution().sparkPlan())
    assert all(int(x) < 8000 for x in re.findall(r"maxMethodCodeSize:(\d+)", code))
