"""Entity resolution: blocking, pair scores, constrained clusters, golden records, incremental runs.

Records: id string, name string, attributes map<string,string>, scope string, primes array<string>.
Equal records (same content, other id) are compared once: the smallest id stands for them and
the others join its entity, so copies of one record never make pairs among themselves.
"""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from weftline.operators import graph
from weftline.session import counted, materialize

# fixed values: weights and limits of a match, keys that identify a person, order of trust
NAME_WEIGHT, ATTRIBUTE_WEIGHT = 0.7, 0.3
MERGE, REVIEW, MARGIN = 0.90, 0.75, 0.08
EXCLUSIVE = ("email", "dob", "ssn", "national_id", "id_number")
SCOPES = ("hsm", "process", "container", "cloud")

#: Records of a block that go to one cell together, and of one name that are met as one.
GROUP, TILE = 1024, 64
#: Up to so many attribute keys get a column each when pairs are scored.
KEYS = 6
#: Pairs of names that are compared at once, each of at most so many characters.
PAIRS, LONG = 50_000, 64


def plain(text: Column) -> Column:
    """Trimmed, lower-case, white space collapsed; "" for null."""
    return F.regexp_replace(F.trim(F.lower(F.coalesce(text, F.lit("")))), r"\s+", " ")


def block_key(name: Column) -> Column:
    """The first three characters of the plain name, a bar, four of its smallest token."""
    words = F.filter(F.split(plain(name), r"[^\p{L}\p{N}_]+"), lambda w: w != "")
    return F.concat(F.substring(plain(name), 1, 3), F.lit("|"), F.substring(F.coalesce(F.array_min(words), F.lit("")), 1, 4))


def jaro_winkler_one(a: str, b: str) -> float:
    """Jaro-Winkler with prefix 4 and factor 0.1, boosted always; half transpositions count as halves."""
    if a == b:
        jaro = 1.0
    elif not a or not b:
        jaro = 0.0
    else:
        reach = max(len(a), len(b)) // 2 - 1
        free = list(b)
        left, where = [], []
        for i, ch in enumerate(a):
            for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
                if free[j] == ch:
                    free[j] = None
                    left.append(ch)
                    where.append(j)
                    break
        m = len(left)
        if not m:
            jaro = 0.0
        else:
            right = [b[j] for j in sorted(where)]
            swaps = sum(x != y for x, y in zip(left, right)) / 2
            jaro = (m / len(a) + m / len(b) + (m - swaps) / m) / 3
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return jaro + prefix * 0.1 * (1 - jaro)


def jaro_winkler_many(a, b):
    """``jaro_winkler_one`` of arrays of names, character by character over all pairs at once; long names one by one."""
    import numpy as np

    names, numbers = np.unique(np.concatenate([a, b]).astype(object), return_inverse=True)
    lengths = np.array([len(x) for x in names], dtype=np.int32)
    n, out = len(a), np.zeros(len(a))
    ia, ib = numbers[:n], numbers[n:]
    la, lb = lengths[ia], lengths[ib]
    long = np.maximum(la, lb) > LONG
    out[long] = [jaro_winkler_one(a[i], b[i]) for i in np.flatnonzero(long)]
    rest = np.flatnonzero(~long)
    if not len(rest):
        return out
    ia, ib, la, lb = ia[rest], ib[rest], la[rest], lb[rest]
    short = np.where(lengths <= LONG, names, "")
    letters, codes = np.unique([ord(c) for x in short for c in x], return_inverse=True)
    width = max(1, max(map(len, short)))
    table = np.zeros((len(names), width), dtype=np.int32)  # 0: past the end
    table[np.arange(width) < np.where(lengths <= LONG, lengths, 0)[:, None]] = codes + 1
    table = table.astype(np.uint8 if len(letters) < 255 else np.int32)
    x, y = np.ascontiguousarray(table[ia].T), np.ascontiguousarray(table[ib].T)
    reach = np.maximum(la, lb) // 2 - 1
    within = [reach >= d for d in range(max(0, int(reach.max()) + 1))]
    left, right = np.zeros(x.shape, dtype=bool), np.zeros(y.shape, dtype=bool)
    for i in range(int(la.max())):
        free = x[i] > 0
        for j in range(max(0, i - len(within) + 1), min(int(lb.max()), i + len(within))):
            hit = (x[i] == y[j]) & free & ~right[j] & within[abs(i - j)]
            right[j] |= hit
            free &= ~hit
            left[i] |= hit
    m = left.sum(axis=0)
    rank, other = np.cumsum(left, axis=0) - 1, np.cumsum(right, axis=0) - 1
    met, found = np.zeros(x.shape, dtype=x.dtype), np.zeros(x.shape, dtype=x.dtype)
    for seen, rows, place, text in ((met, left, rank, x), (found, right, other, y)):
        i, k = np.nonzero(rows)
        seen[place[i, k], k] = text[i, k]
    swaps = (met != found).sum(axis=0) / 2
    some = np.maximum(m, 1)
    jaro = np.where(m > 0, (m / np.maximum(la, 1) + m / np.maximum(lb, 1) + (m - swaps) / some) / 3, 0.0)
    jaro[ia == ib] = 1.0
    prefix, same = np.zeros(len(ia), dtype=np.int64), np.ones(len(ia), dtype=bool)
    for u, v in zip(x[:4], y[:4]):
        same &= (u == v) & (u > 0)
        prefix += same
    out[rest] = jaro + prefix * 0.1 * (1 - jaro)
    return out


def jaro_winkler(a: Column, b: Column) -> Column:
    """``jaro_winkler_one`` over Arrow batches; equal pairs of a batch are computed once."""

    @F.pandas_udf("double")
    def run(x: pd.Series, y: pd.Series) -> pd.Series:
        known: dict = {}
        return pd.Series([known[p] if p in known else known.setdefault(p, jaro_winkler_one(*p)) for p in zip(x, y)], dtype=float)

    return run(a, b)


def _prepared(records: DataFrame) -> DataFrame:
    clean = F.map_filter(F.transform_values(F.coalesce("attributes", F.create_map().cast("map<string,string>")), lambda k, v: plain(v)), lambda k, v: k.isNotNull())
    return records.filter("id is not null").dropDuplicates(["id"]).select("id", plain(F.col("name")).alias("name"), clean.alias("attributes"), "scope", F.array_sort(F.array_distinct(F.coalesce("primes", F.array().cast("array<string>")))).alias("primes"), block_key(F.col("name")).alias("block"))


def representatives(records: DataFrame) -> DataFrame:
    """id, same_as: every record and the smallest id with equal content, by SHA-256 of the content.

    Classes form by partial aggregates; a class that holds a third of all records is split by
    AQE where it is joined back.
    """
    p = _prepared(records)
    text = F.concat_ws("\x02", "name", F.to_json(F.array_sort(F.map_entries("attributes"))), F.coalesce("scope", F.lit("")), F.array_join("primes", "\x01"))
    marked = p.select("id", F.sha2(F.encode(text, "utf-8"), 256).alias("h"))
    return marked.join(marked.groupBy("h").agg(F.min("id").alias("same_as")), "h").select("id", "same_as")


def block_pairs(records: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """a, b: ids of representatives that share a block, a < b.

    anchors (column id): known records; pairs of two anchors are left out.  A large block is
    split over tasks by AQE's skew join; within a block every pair is compared, as scores ask.
    """
    p = _prepared(records).select("id", "block")
    keep = representatives(records).filter("id = same_as").select("id")
    p = p.join(keep, "id", "left_semi")
    if anchors is not None:
        p = p.join(anchors.select("id", F.lit(True).alias("anchor")), "id", "left").na.fill(False, ["anchor"])
    else:
        p = p.withColumn("anchor", F.lit(False))
    x, y = p.alias("x"), p.alias("y")
    met = x.join(y, (F.col("x.block") == F.col("y.block")) & (F.col("x.id") < F.col("y.id")) & ~(F.col("x.anchor") & F.col("y.anchor")))
    return met.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"))


def score_pairs(records: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b, name_sim, attr_sim, score, matched, conflict, veto, decision of each pair.

    conflict: the first identifying key on which both have unlike values; veto: disjoint
    primes in unlike scopes; either blocks.  A high score merges only with an equal name or
    a matched attribute.
    """
    p = _sides(_prepared(records))
    side = lambda s: p.select(F.col("id").alias(s), F.col("_s").alias(f"_{s}"))
    return _scored(pairs.join(side("a"), "a").join(side("b"), "b"))


def score_blocks(records: DataFrame) -> DataFrame:
    """``score_pairs`` of all ``block_pairs``: pairs are scored where they meet, so only records are shuffled.

    Names are compared once for all records that bear them.  The records of a block are cut
    by name into groups, and each group meets the whole block in a cell of its own; within a
    cell, tiles (records of one name) meet, so that a pair costs two steps of a loop.
    """
    reps = _sides(_prepared(records)).join(representatives(records).filter("id = same_as").select("id"), "id", "left_semi")
    by = Window.partitionBy("block")
    r = F.row_number().over(by.orderBy("name", "id")) - 1
    p = materialize(reps.select("block", "name", "id", "_s", F.floor(r / GROUP).cast("int").alias("g"), F.floor(r / TILE).cast("int").alias("t"), F.count(F.lit(1)).over(by).alias("of")), "er")
    keys = [k[0] for k in p.select(F.explode(F.map_keys("_s.attributes"))).distinct().limit(KEYS + 1).collect()]
    keys = sorted(keys, key=str.encode) if len(keys) <= KEYS else None
    member = F.struct("id", "_s") if keys is None else _spread("_s", keys)
    met = p.groupBy("block", "g", "t", "name").agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.first("of").alias("of"), F.collect_list(member).alias("m"))
    tiles = materialize(met.withColumn("place", F.row_number().over(Window.partitionBy("block", "g").orderBy("t", "name")) - 1), "er", drop=(p,))
    near = tiles.groupBy("block", F.col("g").alias("c")).agg(F.array_sort(F.collect_list(F.struct("place", "name", "hi"))).alias("near"))
    x = tiles.select("block", F.explode(F.sequence(F.lit(0), F.floor((F.col("of") - 1) / GROUP).cast("int"))).alias("c"), "name", "lo", F.col("m").alias("xs")).join(near.hint("shuffle_hash"), ["block", "c"])
    x = materialize(x.select("block", "c", F.col("name").alias("_na"), "xs", _similarities(F.col("name"), F.col("lo"), F.col("near.name"), F.col("near.hi")).alias("sims")), "er")
    y = tiles.select("block", F.col("g").alias("c"), F.col("name").alias("_nb"), F.col("m").alias("ys"), "place").hint("shuffle_hash")
    cells = x.join(y, ["block", "c"]).select("xs", "ys", F.col("sims")[F.col("place")].alias("n"), (F.col("_na") == F.col("_nb")).alias("same_name")).filter("n >= 0")
    of_tiles = ["n", "same_name"]
    if keys is not None:
        cells, of_tiles = _by_slot(cells, len(keys)), [*of_tiles, "_scores", "_decisions"]
    fields = [f.name for f in cells.schema["xs"].dataType.elementType]
    side = lambda s: [f"{f}_{s}" for f in fields]
    each = cells.select(F.inline("xs").alias(*side("a")), "ys", *of_tiles).select(*side("a"), F.inline("ys").alias(*side("b")), *of_tiles).filter("id_a < id_b")
    each = each.withColumnsRenamed({"id_a": "a", "id_b": "b", "_s_a": "_a", "_s_b": "_b"})
    return _scored(each) if keys is None else _spread_scored(each, keys)


def _similarities(name: Column, lo: Column, names: Column, hi: Column) -> Column:
    """``jaro_winkler_one`` of a tile's name and each of a list; -1 where no id of that one's tile comes after the tile's first."""

    @F.pandas_udf("array<double>")
    def run(name: pd.Series, lo: pd.Series, names: pd.Series, hi: pd.Series) -> pd.Series:
        import numpy as np

        sizes, out, at = names.str.len().to_numpy(), [], 0
        while at < len(name):
            end = max(at + 1, int(np.searchsorted(np.cumsum(sizes[at:]), PAIRS, "right")) + at)
            some, near = sizes[at:end], np.concatenate(names[at:end].to_numpy())
            found, asked = np.full(len(near), -1.0), np.repeat(lo[at:end].to_numpy(), some) < np.concatenate(hi[at:end].to_numpy())
            found[asked] = jaro_winkler_many(np.repeat(name[at:end].to_numpy(), some)[asked], near[asked])
            out += np.split(found, np.cumsum(some)[:-1])
            at = end
        return pd.Series(out)

    return run(name, lo, names, hi)


def _sides(prepared: DataFrame) -> DataFrame:
    """prepared with _s: all that a score looks at."""
    exclusive = F.transform(F.array(*[F.lit(k) for k in EXCLUSIVE]), lambda k: F.nullif(F.try_element_at("attributes", k), F.lit("")))
    return prepared.withColumn("_s", F.struct("name", "attributes", "scope", "primes", exclusive.alias("x")))


def _veto(primes_a: Column, scope_a: Column, primes_b: Column, scope_b: Column) -> Column:
    return (F.size(primes_a) > 0) & (F.size(primes_b) > 0) & ~F.arrays_overlap(primes_a, primes_b) & ~scope_a.eqNullSafe(scope_b)


def _clash(a: str, b: str) -> tuple[Column, Column]:
    """(conflict, veto) of two sides."""
    unlike = F.zip_with(F.col(f"{a}.x"), F.col(f"{b}.x"), lambda u, v: F.coalesce(u != v, F.lit(False)))
    conflict = F.try_element_at(F.array(*[F.lit(k) for k in EXCLUSIVE]), F.nullif(F.array_position(unlike, F.lit(True)), F.lit(0)).cast("int"))
    return conflict, _veto(F.col(f"{a}.primes"), F.col(f"{a}.scope"), F.col(f"{b}.primes"), F.col(f"{b}.scope"))


def _weighed(n: Column, at: Column) -> Column:
    return NAME_WEIGHT * n + ATTRIBUTE_WEIGHT * at


def _decided(score: Column, similar: Column) -> Column:
    """The decision on a pair that is not blocked; similar: of one name, or an attribute agrees."""
    return F.when((score >= MERGE) & similar, "MERGE_VERIFIED").when(score >= REVIEW, "REQUIRES_REVIEW").otherwise("NO_MATCH")


def _scored(j: DataFrame) -> DataFrame:
    """Scores of pairs with their sides (_a, _b).  n, same_name: of their names, where they are known."""
    ka, kb = F.col("_a.attributes"), F.col("_b.attributes")
    shared = F.array_intersect(F.map_keys(ka), F.map_keys(kb))
    matched = F.array_sort(F.filter(shared, lambda k: (ka[k] == kb[k]) & (ka[k] != "")))
    attr = F.when(F.size(shared) > 0, F.size(matched) / F.size(shared)).otherwise(0.0)
    conflict, veto = _clash("_a", "_b")
    if "n" not in j.columns:
        j = j.select("*", jaro_winkler(F.col("_a.name"), F.col("_b.name")).alias("n"), (F.col("_a.name") == F.col("_b.name")).alias("same_name"))
    s = j.select("a", "b", "n", attr.alias("at"), matched.alias("matched"), conflict.alias("conflict"), veto.alias("veto"), ((F.size(ka) > 0) | (F.size(kb) > 0)).alias("has"), "same_name")
    s = s.withColumn("score", F.round(F.when(F.col("has"), _weighed(F.col("n"), F.col("at"))).otherwise(F.col("n")), 4))
    decision = F.when(F.col("conflict").isNotNull() | F.col("veto"), "MERGE_BLOCKED").otherwise(_decided(F.col("score"), F.col("same_name") | (F.size("matched") > 0)))
    return s.select("a", "b", F.round("n", 4).alias("name_sim"), F.round("at", 4).alias("attr_sim"), "score", "matched", "conflict", "veto", decision.alias("decision"))


def _spread(side: str, keys: list[str]) -> Column:
    """A record with a field for each of all attribute keys: pairs are compared without a walk over maps."""
    attributes = F.col(f"{side}.attributes")
    values = [F.try_element_at(attributes, F.lit(k)).alias(f"k{i}") for i, k in enumerate(keys)]
    return F.struct("id", *values, (F.size(attributes) > 0).alias("has"), F.col(f"{side}.scope").alias("scope"), F.col(f"{side}.primes").alias("primes"))


def _by_slot(cells: DataFrame, keys: int) -> DataFrame:
    """cells with scores and decisions of all pairs of two names: at s * (keys + 1) + m for m of s shared keys agreed, last without attributes.

    By transform, which is no part of the generated loops: HotSpot leaves methods beyond 8,000 bytes uncompiled.
    """
    shares = F.array(*[F.lit(m / s if 0 < m <= s else 0.0) for s in range(keys + 1) for m in range(keys + 1)])
    scores = F.concat(F.transform(shares, lambda at: F.round(_weighed(F.col("n"), at), 4)), F.array(F.round("n", 4)))
    return cells.withColumn("_scores", scores).withColumn("_decisions", F.transform("_scores", lambda s, i: _decided(s, F.col("same_name") | (i % (keys + 1) > 0))))


def _spread_scored(j: DataFrame, keys: list[str]) -> DataFrame:
    """``_scored`` of two records that ``_spread`` made, with what ``_by_slot`` tells of their names."""
    values = {k: (F.col(f"k{i}_a"), F.col(f"k{i}_b")) for i, k in enumerate(keys)}
    same = {k: F.coalesce((u == v) & (u != ""), F.lit(False)) for k, (u, v) in values.items()}
    shared = reduce(Column.__add__, [(u.isNotNull() & v.isNotNull()).cast("int") for u, v in values.values()], F.lit(0))
    agreed = reduce(Column.__add__, [s.cast("int") for s in same.values()], F.lit(0))
    matched = F.array_compact(F.array(F.lit(None).cast("string"), *[F.when(s, F.lit(k)) for k, s in same.items()]))
    conflict = F.coalesce(F.lit(None).cast("string"), *[F.when((values[k][0] != values[k][1]) & (values[k][0] != "") & (values[k][1] != ""), F.lit(k)) for k in EXCLUSIVE if k in values])
    slot = F.when(F.col("has_a") | F.col("has_b"), shared * (len(keys) + 1) + agreed).otherwise((len(keys) + 1) ** 2)
    decision = F.when(conflict.isNotNull() | _veto(F.col("primes_a"), F.col("scope_a"), F.col("primes_b"), F.col("scope_b")), "MERGE_BLOCKED").otherwise(F.col("_decisions")[slot])
    attr = F.when(shared > 0, agreed / shared).otherwise(0.0)
    return j.select("a", "b", F.round("n", 4).alias("name_sim"), F.round(attr, 4).alias("attr_sim"), F.col("_scores")[slot].alias("score"), matched.alias("matched"), conflict.alias("conflict"), _veto(F.col("primes_a"), F.col("scope_a"), F.col("primes_b"), F.col("scope_b")).alias("veto"), decision.alias("decision"))


def decisive(scored: DataFrame) -> DataFrame:
    """Scored pairs with verified merges by name alone put to review unless each is the other's best by a clear margin."""
    live = scored.filter("decision <> 'NO_MATCH'")
    ends = live.select(F.col("a").alias("r"), F.col("b").alias("o"), "score").unionByName(live.select(F.col("b").alias("r"), F.col("a").alias("o"), "score"))
    w = Window.partitionBy("r").orderBy(F.desc("score"), F.desc("o"))
    best = ends.withColumn("rn", F.row_number().over(w)).withColumn("second", F.lead("score").over(w)).filter("rn = 1").select("r", "o", (F.col("score") - F.coalesce("second", F.lit(0.0))).alias("m"))
    lead = lambda me, other, name: best.select(F.col("r").alias(me), F.col("o").alias(other), F.col("m").alias(name))
    j = live.join(lead("a", "b", "ma"), ["a", "b"], "left").join(lead("b", "a", "mb"), ["a", "b"], "left")
    weak = (F.col("decision") == "MERGE_VERIFIED") & (F.size("matched") == 0) & ~((F.coalesce("ma", F.lit(-1.0)) >= MARGIN) & (F.coalesce("mb", F.lit(-1.0)) >= MARGIN))
    return j.withColumn("decision", F.when(weak, "REQUIRES_REVIEW").otherwise(F.col("decision"))).drop("ma", "mb")


def _blocked(conflict: Column, veto: Column) -> Column:
    return conflict.isNotNull() | veto


def _unblocked(reps: DataFrame) -> DataFrame:
    """a, b, _a, _b: the pairs of a block that no identifying key and no veto blocks (reps: id, block, _s, known).

    Records fall into classes by which identifying keys they hold.  The pairs of two classes are
    met on the block and on the values of the keys that both hold, which must be equal; only
    records without a key in common meet on the block alone.  A record goes once to each class.
    """
    held = reps.withColumn("_c", reduce(Column.__add__, [F.when(F.col("_s.x")[i].isNotNull(), 1 << i).otherwise(0) for i in range(len(EXCLUSIVE))]))
    classes = F.array(*[F.lit(r[0]) for r in held.select("_c").distinct().orderBy("_c").collect()]).cast("array<int>")  # at most 2 ** len(EXCLUSIVE)
    values = F.array(*[F.when(F.col("_p").bitwiseAND(F.col("_q")).bitwiseAND(F.lit(1 << i)) != 0, F.col("_s.x")[i]).otherwise("") for i in range(len(EXCLUSIVE))]).alias("_v")
    x = held.select("*", F.col("_c").alias("_p"), F.explode(F.filter(classes, lambda c: c >= F.col("_c"))).alias("_q")).select("block", "_p", "_q", values, F.struct("id", "known", "_s").alias("_x"))
    y = held.select("*", F.explode(F.filter(classes, lambda c: c <= F.col("_c"))).alias("_p"), F.col("_c").alias("_q")).select("block", "_p", "_q", values, F.struct("id", "known", "_s").alias("_y"))
    met = x.join(y, ["block", "_p", "_q", "_v"]).filter(((F.col("_p") < F.col("_q")) | (F.col("_x.id") < F.col("_y.id"))) & ~(F.col("_x.known") & F.col("_y.known")))
    ahead = F.col("_x.id") < F.col("_y.id")
    one, other = F.when(ahead, F.col("_x")).otherwise(F.col("_y")), F.when(ahead, F.col("_y")).otherwise(F.col("_x"))
    sides = met.select(one.alias("_1"), other.alias("_2")).select(F.col("_1.id").alias("a"), F.col("_2.id").alias("b"), F.col("_1._s").alias("_a"), F.col("_2._s").alias("_b"))
    return sides.filter(~_blocked(*_clash("_a", "_b")))


def resolve(records: DataFrame, anchors: DataFrame | None = None) -> DataFrame:
    """id, entity: the entity of every record, named by its smallest id.

    Verified pairs join in order of score (then ids); a union that would bring unlike values
    of an identifying key into one entity is refused, however indirect.  The order matters
    only within a connected component, so each component is one group.  With ``anchors``
    only pairs with a new record are scored; the anchors' own entities stay apart.
    """
    prepared = materialize(_prepared(records), "er")
    same = materialize(representatives(records), "er")
    reps = _sides(prepared.join(same.filter("id = same_as").select("id"), "id", "left_semi"))
    known = F.lit(False) if anchors is None else F.coalesce("_known", F.lit(False))
    if anchors is not None:
        reps = reps.join(anchors.select("id", F.lit(True).alias("_known")).distinct(), "id", "left")
    reps = materialize(reps.select("id", "block", "_s", known.alias("known")), "er")

    def met(some_a: DataFrame, some_b: DataFrame) -> DataFrame:
        """Pairs of a block, with their sides, that are blocked; told while they are joined."""
        x, y = some_a.select(F.col("id").alias("a"), "block", F.col("_s").alias("_a"), F.col("known").alias("_ka")), some_b.select(F.col("id").alias("b"), "block", F.col("_s").alias("_b"), F.col("known").alias("_kb"))
        is_blocked = _blocked(*_clash("_a", "_b"))
        return x.join(y, "block").filter((F.col("a") < F.col("b")) & ~(F.col("_ka") & F.col("_kb")) & is_blocked).select("a", "b", "_a", "_b")

    free = materialize(_scored(_unblocked(reps)).filter("decision <> 'NO_MATCH'"), "er")
    # blocked pairs matter only for the margins of merges by name alone
    weak = materialize(free.filter("decision = 'MERGE_VERIFIED' and size(matched) = 0").select(F.explode(F.array("a", "b")).alias("id")).distinct(), "er", count="true")
    scored = free
    if counted(weak):
        few, others = reps.join(weak, "id", "left_semi"), reps.join(weak, "id", "left_anti")
        scored = free.unionByName(_scored(met(few, reps).unionByName(met(others, few))))
    pairs = materialize(decisive(scored), "er").filter("decision = 'MERGE_VERIFIED'")
    edges = pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))
    comp = materialize(graph.components(edges), "er")
    # a component of one link has nothing to refuse: its pair was not blocked
    linked = pairs.join(comp, F.col("a") == F.col("id")).select("component", "a", "b", "score")
    many = linked.groupBy("component").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("component")
    values = prepared.select("id", F.map_filter("attributes", lambda k, v: k.isin(*EXCLUSIVE) & (v != "")).alias("x"))
    members = comp.join(many, "component", "left_semi").join(values, "id").select("component", "id", F.to_json("x").alias("x"), F.lit(None).cast("string").alias("b"), F.lit(None).cast("double").alias("score"))
    links = linked.join(many, "component", "left_semi").select("component", F.col("a").alias("id"), F.lit(None).cast("string").alias("x"), "b", "score")
    rows = members.unionByName(links).repartition("component").sortWithinPartitions("component", "score", "id", "b")
    joined = rows.mapInPandas(_constrained_unions, "id string, entity string")
    simple = comp.join(many, "component", "left_anti").select("id", F.col("component").alias("entity"))
    named = same.join(joined.unionByName(simple).select(F.col("id").alias("same_as"), "entity"), "same_as", "left").select("id", F.coalesce("entity", "same_as").alias("entity"))
    least = named.groupBy("entity").agg(F.min("id").alias("name"))
    return named.join(least, "entity").select("id", F.col("name").alias("entity"))


def _constrained_unions(batches):
    """Entities of the components of a sorted partition, one component in memory at a time."""
    import json

    def settle(component: list) -> pd.DataFrame:
        root = {i: i for i, x, _, _ in component if x is not None}
        held = {i: json.loads(x) for i, x, _, _ in component if x is not None}

        def find(i):
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for _, a, b in sorted((-score, i, b) for i, x, b, score in component if x is None):
            ra, rb = find(a), find(b)
            if ra != rb and not any(k in held[ra] and held[ra][k] != v for k, v in held[rb].items()):
                lo, hi = min(ra, rb), max(ra, rb)
                root[hi] = lo
                held[lo] = {**held[hi], **held[lo]}
        return pd.DataFrame({"id": list(root), "entity": [find(i) for i in root]})

    current, component = None, []
    for pdf in batches:
        for c, i, x, b, score in zip(pdf["component"], pdf["id"], pdf["x"], pdf["b"], pdf["score"]):
            if c != current and component:
                yield settle(component)
                component = []
            current = c
            component.append((i, x, b, score))
    if component:
        yield settle(component)


def golden(records: DataFrame, entities: DataFrame) -> DataFrame:
    """entity, survivor, name, attributes, members: one record per entity.

    The survivor has the most attributes, then the most trusted scope, then the smallest id;
    attributes it lacks come from the others in the same order.
    """
    trust = F.coalesce(F.nullif(F.array_position(F.array(*[F.lit(s) for s in SCOPES]), plain(F.col("scope"))), F.lit(0)), F.lit(99))
    attributes = F.coalesce("attributes", F.create_map().cast("map<string,string>"))
    held = records.join(entities, "id").select("entity", "id", "name", F.array_sort(F.map_entries(attributes)).alias("e"), (-F.size(attributes)).alias("_n"), trust.alias("_t"))
    # equal members count, but only one of them is gathered
    once = held.groupBy("entity", "_n", "_t", "name", "e").agg(F.min("id").alias("id"), F.count(F.lit(1)).alias("c"))
    ranked = once.groupBy("entity").agg(F.array_sort(F.collect_list(F.struct("_n", "_t", "id", "name", "e"))).alias("m"), F.sum("c").cast("int").alias("members"))
    merged = F.aggregate("m", F.create_map().cast("map<string,string>"), lambda acc, r: F.map_concat(acc, F.map_from_entries(F.filter(r["e"], lambda e: ~F.map_contains_key(acc, e["key"])))))
    return ranked.select("entity", F.col("m")[0]["id"].alias("survivor"), F.col("m")[0]["name"].alias("name"), merged.alias("attributes"), "members")
