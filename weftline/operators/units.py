"""Quantities recorded in different units: a hidden Markov model per series.

A series is one metric as reported by one source ("device").  The hidden state of a fact is
the unit its figure was recorded in, and the decoded state alone gives a fact its unit.
Evidence for a state is what the texts say and how near the figure, read in that unit, lies
to the series' level, a smooth curve of log values; units rarely switch from one fact to the
next, and start as the metric's stated units are spread.  Viterbi decoding finds the most likely sequence of units.

The texts rank as the data's rules do: the fact's own JSON before the source's crosswalk
before the metric's definition.  Their weights are set so that a statement outweighs all
lesser ones, the level and two switches together; a path through a stated fact therefore
agrees with its statement.  A fact whose texts are silent or unreadable takes its unit from
its neighbours in the series and from the level.

The level takes no statement for granted: it starts from the metric's median over all
sources and the statements, every fact is then given the unit that fits it best with the
statements as hints only, and the curve is drawn anew through those.

A metric whose definition names no unit has the quantity that its crosswalks and facts name
most often, and the level of the facts that state their unit.  Without any, nothing is decoded.

Distribution: facts are range-partitioned by (series, time), so a series that holds a third
of all rows is spread over many tasks.  A series inside one partition is decoded at once.
For the two series at a partition's edges the decoder returns the path for every entry and
exit state, and a score for each pair; these scores, at most two blocks per partition, are
chained on the driver to the exact path over the whole series, and the rows pick theirs.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StringType, StructField, StructType

from weftline.functions.refs import id_key, ref_key
from weftline.functions.units import COMMON, STATES, json_statement, note_statement, unit_of
from weftline.session import broadcast_if_small, fresh_path

#: States of the widest quantity, and one for a size that only a crosswalk's factor names.
K = max(len(s) for s in STATES.values()) + 1
OTHER = K - 1
PAIRS = K * K
QUANTITY_NAMES = sorted(STATES)
#: Log-odds of a switch of units, and the most that the level counts against a unit: more than two switches.
SWITCH = math.log(0.01)
LEVEL_CAP = 14.0
#: Log-odds of the statements: each exceeds the lesser ones, the level, a rare start and two switches together.
DEFINITION_WEIGHT = 40.0
CROSSWALK_WEIGHT = 2 * DEFINITION_WEIGHT
JSON_WEIGHT = 2 * CROSSWALK_WEIGHT
#: The same as hints, while the level is drawn: less than the level's cap.
HINTS = (6.0, 3.0, 2.0)
#: Spread of log10 values about the level where the metric's own is unknown, and the least that is believed.
SPREAD, LEAST_SPREAD = 0.6, 0.1
#: Facts per knot of the curve, and how many facts the metric's level counts for in a knot.
KNOT, PRIOR_FACTS = 48, 2.0
NEVER = -1e9
BLOCK = 512
#: Facts per range partition; bounds the memory of one task.
PARTITION_ROWS = 200_000
#: Small tables of definitions and crosswalks beyond this many rows are joined by shuffle.
SMALL = 100_000


def scales(definitions: DataFrame, crosswalks: DataFrame, facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(metric, quantity, definition_size, level) and (source, metric, crosswalk_size): the units that texts state, in millionths.

    Of several crosswalk rows of one source and metric the first in order of note that says
    anything counts; rows of unknown metrics and silent notes are left out.  A metric whose
    definition names no unit has the quantity that its notes and facts name, a null size and
    a level; it is left out if no fact gives a level.  Only then are the facts (metric,
    source, value, json) read here.  Column level is null for the other metrics.
    """

    def define(batches):
        for b in batches:
            units = [unit_of(x) for x in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([u and u[0] for u in units], pa.string()), pa.array([u and u[1] for u in units], pa.float64())], names=["metric", "quantity", "definition_size"])

    named = definitions.select(id_key("metric_definition_id").alias("metric"), "unit").filter(F.col("metric").isNotNull())
    one = named.groupBy("metric").agg(F.max("unit").alias("unit"))
    defined = _pinned(one.mapInArrow(define, "metric string, quantity string, definition_size double"))
    by_metric, silent = defined.filter(F.col("quantity").isNotNull()), defined.filter(F.col("quantity").isNull()).select("metric")

    def read_notes(batches):
        for b in batches:
            sizes = []
            for note, quantity, own in zip(*(b.column(i).to_pylist() for i in (2, 3, 4))):
                said = note_statement(note, quantity)
                sizes.append(None if said is None else said[1] if said[0] == "unit" else None if own is None else _whole(own * said[1]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(sizes, pa.float64())], names=["source", "metric", "note", "crosswalk_size"])

    notes = crosswalks.select(ref_key("source_descriptor_id").alias("source"), id_key("canonical_metric_definition_id").alias("metric"), F.col("transform_notes").alias("note"))
    notes = notes.filter(F.col("source").isNotNull())
    unread = not silent.isEmpty()
    if unread:
        by_metric = by_metric.unionByName(_pinned(_quantities(silent, notes, facts)).withColumn("definition_size", F.lit(None).cast("double")))
    known = notes.join(by_metric, "metric").select("source", "metric", "note", "quantity", "definition_size")
    said = known.mapInArrow(read_notes, "source string, metric string, note string, crosswalk_size double").filter(F.col("crosswalk_size").isNotNull())
    by_pair = _pinned(said.groupBy("source", "metric").agg(F.min(F.struct("note", "crosswalk_size")).alias("s")).select("source", "metric", F.col("s.crosswalk_size").alias("crosswalk_size")))
    if unread:
        levels = _pinned(_levels(by_metric.filter(F.col("definition_size").isNull()).select("metric", "quantity"), by_pair, facts))
        by_metric = by_metric.join(levels, "metric", "left").filter(F.col("definition_size").isNotNull() | F.col("level").isNotNull())
    else:
        by_metric = by_metric.withColumn("level", F.lit(None).cast("double"))
    return _pinned(by_metric), by_pair


def _quantities(silent: DataFrame, notes: DataFrame, facts: DataFrame) -> DataFrame:
    """metric, quantity: what most notes and facts of each given metric name a unit of (ties to the first by name)."""

    def read(says, batches):
        for b in batches:
            named = [(m, q) for m, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()) for q in QUANTITY_NAMES if says(text, q)]
            yield pa.RecordBatch.from_arrays([pa.array([m for m, _ in named], pa.string()), pa.array([q for _, q in named], pa.string())], names=["metric", "quantity"])

    def of_note(note, quantity):
        said = note_statement(note, quantity)
        return said is not None and said[0] == "unit"

    kinds = "metric string, quantity string"
    by_note = notes.join(silent, "metric").select("metric", "note").mapInArrow(lambda batches: read(of_note, batches), kinds)
    by_fact = facts.filter(F.col("json").isNotNull()).join(silent, "metric").select("metric", "json").mapInArrow(lambda batches: read(lambda text, q: json_statement(text, q)[1] is not None, batches), kinds)
    votes = by_note.unionByName(by_fact).groupBy("metric", "quantity").agg((-F.count(F.lit(1))).alias("n"))
    return votes.groupBy("metric").agg(F.min(F.struct("n", "quantity")).alias("v")).select("metric", "v.quantity")


def _levels(metrics: DataFrame, by_pair: DataFrame, facts: DataFrame) -> DataFrame:
    """metric, level: the median log10 figure, in millionths, of each metric's facts whose JSON or crosswalk states the unit."""

    def read(batches):
        for b in batches:
            metric, level = [], []
            for m, quantity, value, text, cross in zip(*(b.column(i).to_pylist() for i in range(5))):
                figure, size = json_statement(text, quantity)
                raw, size = figure if value is None else value, cross if size is None else size
                if raw and size and math.isfinite(raw):
                    metric.append(m)
                    level.append(math.log10(abs(raw)) + math.log10(size))
            yield pa.RecordBatch.from_arrays([pa.array(metric, pa.string()), pa.array(level, pa.float64())], names=["metric", "level"])

    stated = facts.join(metrics, "metric").join(by_pair, ["source", "metric"], "left").filter("json is not null or crosswalk_size is not null")
    found = stated.select("metric", "quantity", "value", "json", "crosswalk_size").mapInArrow(read, "metric string, level double")
    return found.groupBy("metric").agg(F.percentile_approx("level", 0.5).alias("level"))


def _whole(size: float) -> float:
    """A size that differs from a whole number by rounding alone is that number."""
    near = float(round(size))
    return near if near and abs(size / near - 1) < 1e-9 else size


def _pinned(df: DataFrame) -> DataFrame:
    """A schema-sized frame as local rows if it is small; else as it is.  Keeps its Python stage from running again."""
    rows = df.limit(SMALL + 1).collect()
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema)) if len(rows) <= SMALL else df


def _sizes_of(quantity, other):
    """Sizes (rows x K) of the states of each row's quantity; NaN where there is none."""
    sizes = np.full((len(QUANTITY_NAMES) + 1, K), np.nan)
    for i, name in enumerate(QUANTITY_NAMES):
        sizes[i, : len(STATES[name])] = STATES[name]
    of_row = sizes[quantity]
    of_row[:, OTHER] = other
    return of_row


def unnamed_sizes(quantity, cross_size):
    """The crosswalk's sizes that are no unit of the quantity's; NaN elsewhere."""
    known = np.isclose(_sizes_of(quantity, np.nan), cross_size[:, None], rtol=1e-9).any(axis=1)
    return np.where(known | (quantity == len(QUANTITY_NAMES)), np.nan, cross_size)


def _emissions(value, quantity, said, starts, base, spread, other=np.nan):
    """Log-evidence (rows x K) for each state; states beyond a quantity's units are impossible.

    said: the sizes stated by JSON, crosswalk and definition, NaN where they are silent.
    starts: where each series begins, and the end.  base, spread: the metric's level and the
    spread about it, NaN where unknown.
    """
    of_row = _sizes_of(quantity, other)
    with np.errstate(invalid="ignore", divide="ignore"):
        agrees = [np.isclose(of_row, x[:, None], rtol=1e-9) for x in said]
        possible = ~np.isnan(of_row)
        logs = np.log10(np.abs(value))
        logs[~np.isfinite(logs)] = np.nan
        common = logs[:, None] + np.log10(of_row)
        width = np.where(np.isnan(spread), SPREAD, np.maximum(spread, LEAST_SPREAD))[:, None]

        def about(level):
            far = (common - level[:, None]) / width
            return np.where(np.isfinite(far), np.minimum(0.5 * far * far, LEVEL_CAP), 0.0)

        best = np.where(np.isnan(said[0]), np.where(np.isnan(said[1]), said[2], said[1]), said[0])
        hints = sum(np.where(a, w, 0.0) for a, w in zip(agrees, HINTS))
        level = _curve(logs + np.log10(best), starts, base)
        fit = np.where(possible, hints - about(level), NEVER).argmax(axis=1)
        told = ~np.isnan(best) | ~np.isnan(level)
        level = _curve(np.where(told, common[np.arange(len(fit)), fit], np.nan), starts, base)
        e = np.where(possible, -about(level), NEVER)
    for a, weight in zip(agrees, (JSON_WEIGHT, CROSSWALK_WEIGHT, DEFINITION_WEIGHT)):
        e += np.where(a, weight, 0.0)
    e[quantity == len(QUANTITY_NAMES), 0] = 0.0
    return e


def _curve(common, starts, base):
    """The level of each row: medians of stretches of its series, drawn to the metric's level where they hold few
    facts, averaged with their neighbours, and straight lines between; NaN where nothing is known."""
    out = np.full(len(common), np.nan)
    for a, b in zip(starts[:-1], starts[1:]):
        cuts = np.linspace(a, b, max(1, (b - a) // KNOT) + 1).astype(int)
        knots = np.full(len(cuts) - 1, np.nan)
        for i, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
            part = common[x:y]
            part = part[np.isfinite(part)]
            if len(part):
                middle = np.median(part)
                knots[i] = middle if np.isnan(base[a]) else (len(part) * middle + PRIOR_FACTS * base[a]) / (len(part) + PRIOR_FACTS)
        held = np.flatnonzero(~np.isnan(knots))
        if not len(held):
            out[a:b] = base[a]
            continue
        level = knots[held]
        if len(level) > 2:
            level = np.convolve(np.concatenate([level[:1], level, level[-1:]]), (0.25, 0.5, 0.25), "valid")
        out[a:b] = level[0] if len(level) == 1 else np.interp(np.arange(a, b), (cuts[held] + cuts[held + 1]) / 2, level)
    return out


def _forward(e, starts):
    """Scores (blocks, entry, exit) and back-pointers (rows, entry, state) of every block, all blocks side by side."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    begin, longest = starts[:-1][order], int(sizes.max())
    active = np.searchsorted(-sizes[order], -np.arange(longest), side="left")
    back = np.empty((len(e), K, K), dtype=np.int8)
    trans = np.full((K, K), SWITCH)
    np.fill_diagonal(trans, 0.0)
    score = trans[None] + e[begin][:, None, :]
    back[begin] = np.arange(K, dtype=np.int8)[:, None]
    for t in range(1, longest):
        m = active[t]
        live = score[:m]
        top = live.max(axis=2)
        arg = live.argmax(axis=2).astype(np.int8)
        stay = live >= top[:, :, None] + SWITCH
        rows = begin[:m] + t
        score[:m] = np.where(stay, live, top[:, :, None] + SWITCH) + e[rows][:, None, :]
        back[rows] = np.where(stay, np.arange(K, dtype=np.int8)[None, None, :], arg[:, :, None])
    out = np.empty_like(score)
    out[order] = score
    return out, back


def _backward(back, starts, entry, leave, codes):
    """Fill codes (rows x pairs) of every block given its entry and exit states (blocks x pairs)."""
    sizes = np.diff(starts)
    order = np.argsort(-sizes, kind="stable")
    ends, sizes = starts[1:][order], sizes[order]
    state, entry = leave[order].copy(), entry[order]
    for t in range(int(sizes.max())):
        m = int(np.searchsorted(-sizes, -t, side="left"))
        rows = ends[:m] - 1 - t
        codes[rows] = state[:m]
        state[:m] = back[rows[:, None], entry[:m], state[:m]]


def decode(e, blocks, spanning: bool):
    """Viterbi over one series cut into blocks (row offsets): (codes, scores).

    spanning: codes (rows, K*K) for every (entry, exit) pair and the series' scores (K, K);
    else codes (rows, 1) of the best path with free ends, and None.
    """
    score, back = _forward(e, blocks)
    n = len(blocks) - 1
    total, choice = score[0], np.empty((n, K, K), dtype=np.int8)  # choice[i][entry, exit of i]: the exit of i-1
    for i in range(1, n):
        steps = total[:, :, None] + score[i][None]
        choice[i], total = steps.argmax(axis=1), steps.max(axis=1)
    if spanning:
        first, leave = np.repeat(np.arange(K), K), np.tile(np.arange(K), K)
    else:
        first, leave = (np.array([x]) for x in np.unravel_index(total.argmax(), total.shape))
    entries, leaves = np.empty((n, len(first)), dtype=np.int8), np.empty((n, len(first)), dtype=np.int8)
    at = leave
    for i in range(n - 1, -1, -1):
        leaves[i] = at
        at = choice[i][first, at] if i else first
        entries[i] = at
    codes = np.empty((len(e), len(first)), dtype=np.int8)
    _backward(back, blocks, entries, leaves, codes)
    return codes, total if spanning else None


_OUT = StructType([
    StructField("fact_id", StringType()), StructField("metric", StringType()), StructField("source", StringType()), StructField("quantity", StringType()),
    StructField("figure", DoubleType()), StructField("stated_size", DoubleType()), StructField("other_size", DoubleType()), StructField("codes", StringType()), StructField("part", LongType()), StructField("edge", LongType()),
    StructField("is_block", BooleanType()), StructField("scores", StringType()),
])


def _decode_partition(batches, carry: tuple[str, ...] = ()):
    """Statements, evidence and Viterbi over one range partition; see the module's text."""
    table = pa.Table.from_batches(list(batches))
    n = table.num_rows
    if not n:
        return
    part = TaskContext.get().partitionId()
    metric, source, quantity = (table.column(c).to_pylist() for c in ("metric", "source", "quantity"))
    number = {name: i for i, name in enumerate(QUANTITY_NAMES)}
    figure = table.column("value").to_numpy(zero_copy_only=False).astype(float)
    absent = np.asarray(table.column("value").is_null())
    own, cross, base, spread = (table.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("definition_size", "crosswalk_size", "level", "spread"))
    hidden = table.column("hidden").to_numpy(zero_copy_only=False).astype(bool)
    said = np.full(n, np.nan)
    for i, text in enumerate(table.column("json").to_pylist()):
        if text is not None:
            fig, size = json_statement(text, quantity[i])
            if size is not None:
                said[i] = size
            if fig is not None and absent[i]:
                figure[i] = fig
    codes_q = np.array([number.get(q, len(QUANTITY_NAMES)) for q in quantity])
    change = [0] + [i for i in range(1, n) if metric[i] != metric[i - 1] or source[i] != source[i - 1]] + [n]
    blocks = [0]
    for a, b in zip(change[:-1], change[1:]):
        blocks.extend([*range(a + BLOCK, b, BLOCK), b])
    blocks = np.array(blocks)
    seen = [np.where(hidden, np.nan, x) for x in (said, cross, own)]
    other = unnamed_sizes(codes_q, seen[1])
    e = _emissions(figure, codes_q, seen, change, base, spread, other)
    rarity = table.column("rarity").to_pylist()
    for a in change[:-1]:
        if rarity[a]:
            e[a] -= [int(c) for c in rarity[a]]
    edge = np.zeros(n, dtype=np.int64)
    text = np.empty(n, dtype=object)
    summary = []
    last = len(change) - 2
    # the series inside the partition, side by side
    inner_from, inner_to = change[1] if last >= 0 else 0, change[last]
    if last >= 2:
        starts = blocks[(blocks >= inner_from) & (blocks <= inner_to)] - inner_from
        score, back = _forward(e[inner_from:inner_to], starts)
        entry, leave = np.empty((len(starts) - 1, 1), dtype=np.int8), np.empty((len(starts) - 1, 1), dtype=np.int8)
        where = np.searchsorted(starts, np.array(change[1 : last + 1]) - inner_from)
        for lo, hi in zip(where[:-1], where[1:]):
            total, choice = score[lo], []
            for i in range(lo + 1, hi):
                steps = total[:, :, None] + score[i][None]
                choice.append(steps.argmax(axis=1))
                total = steps.max(axis=1)
            first, at = np.unravel_index(total.argmax(), total.shape)
            for i in range(hi - 1, lo - 1, -1):
                leave[i, 0] = at
                at = choice[i - lo - 1][first, at] if i > lo else first
                entry[i, 0] = at
        codes = np.empty((inner_to - inner_from, 1), dtype=np.int8)
        _backward(back, starts, entry, leave, codes)
        text[inner_from:inner_to] = np.array([str(k) for k in range(K)], dtype=object)[codes[:, 0]]
    for which, at in ((1, 0), *(((2, last),) if last else ())):
        a, b = change[at], change[at + 1]
        codes, scores = decode(e[a:b], blocks[(blocks >= a) & (blocks <= b)] - a, True)
        edge[a:b] = which
        same = (codes == codes[:, :1]).all(axis=1)
        chars = (codes + 48).astype(np.uint8)
        text[a:b] = [chr(c[0]) if s else c.tobytes().decode() for c, s in zip(chars, same)]
        summary.append((metric[a], source[a], quantity[a], part, which, ",".join(repr(float(x)) for x in scores.ravel())))
    stated = np.where(np.isnan(said), np.where(np.isnan(cross), own, cross), said)
    nulls = lambda x: pa.array(x, pa.float64(), from_pandas=True)
    yield from pa.table({
        "fact_id": table.column("fact_id"), "metric": table.column("metric"), "source": table.column("source"), "quantity": table.column("quantity"), "figure": nulls(figure), "stated_size": nulls(stated), "other_size": nulls(other),
        "codes": pa.array(text, pa.string()), "part": pa.array(np.full(n, part), pa.int64()), "edge": pa.array(edge), "is_block": pa.array(np.zeros(n, dtype=bool)), "scores": pa.nulls(n, pa.string()), **{c: table.column(c) for c in carry},
    }).to_batches(max_chunksize=20_000)
    kinds = {"figure": pa.float64(), "stated_size": pa.float64(), "other_size": pa.float64(), "part": pa.int64(), "edge": pa.int64(), "is_block": pa.bool_()} | {c: table.schema.field(c).type for c in carry}
    schema = pa.schema([(name, kinds.get(name, pa.string())) for name in (*_OUT.names, *carry)])
    blocks = [{"metric": m, "source": s, "quantity": q, "part": p, "edge": w, "is_block": True, "scores": x} for m, s, q, p, w, x in summary]
    yield pa.RecordBatch.from_pylist(blocks, schema=schema)


def _chain(blocks: list) -> list[tuple[int, int, int]]:
    """(part, edge, entry * K + exit) of every edge block: the best path over each series' blocks."""
    by_series: dict[tuple, list] = {}
    for b in sorted(blocks, key=lambda b: (b.part, b.edge)):
        by_series.setdefault((b.metric, b.source), []).append(b)
    out = []
    for held in by_series.values():
        scores = [np.array([float(x) for x in b.scores.split(",")]).reshape(K, K) for b in held]
        total, choice = scores[0], []
        best_first = [total.max(axis=0)]
        firsts = total.argmax(axis=0)
        now = best_first[0]
        for s in scores[1:]:
            steps = now[:, None] + s
            choice.append(steps.argmax(axis=0))
            now = steps.max(axis=0)
        at, path = int(now.argmax()), []
        for i in range(len(held) - 1, -1, -1):
            entry = int(choice[i - 1][at]) if i else int(firsts[at])
            path.append((held[i].part, held[i].edge, entry * K + at))
            at = entry
        out.extend(path)
    return out


def common_units(facts: DataFrame, definitions: DataFrame, crosswalks: DataFrame, carry: dict[str, str] | None = None, hide: str | None = None) -> DataFrame:
    """fact_id, metric, source, quantity, figure, stated_size, size, hidden, common, and the carried columns.

    figure: value_scalar, or where that is null the figure in value_json (null or NaN: none).
    stated_size: the unit by the texts, size: the unit by the model, both in millionths of
    the common unit; common: the figure in the common unit.  One row per fact row (repeats
    stay).  A fact has a null size if its metric is unknown, or has no readable unit
    anywhere.  Empty tables give no rows.  carry: new name -> SQL expression over the facts,
    for columns that go along.  hide: SQL condition over the facts; what texts state about
    the unit of such facts is withheld from the model, to measure it.
    """
    spark, carry = facts.sparkSession, carry or {}
    light = facts.select(
        F.col("metric_fact_id").alias("fact_id"), "ts", id_key("metric_definition_id").alias("metric"), ref_key("source_descriptor_id").alias("source"), F.col("value_scalar").cast("double").alias("value"),
        F.when(F.length("value_json") > 6, F.col("value_json")).alias("json"), F.coalesce(F.expr(hide or "false"), F.lit(False)).alias("hidden"), *[F.expr(e).alias(c) for c, e in carry.items()],
    )
    by_metric, by_pair = scales(definitions, crosswalks, light.filter("not hidden").select("metric", "source", "value", "json"))
    habits, rows_n = _habits(light, by_metric, by_pair)
    by_metric = by_metric.withColumnRenamed("level", "stated_level").join(habits, "metric", "left")
    by_metric = by_metric.select("metric", "quantity", "definition_size", F.coalesce("stated_level", "level").alias("level"), "spread", "rarity")
    joined = light.join(_pinned(by_metric), "metric", "left").join(by_pair, ["source", "metric"], "left")
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows_n // PARTITION_ROWS))
    keys = ["metric", "source", "ts", "fact_id"]
    series = joined.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("ts")
    path, names = fresh_path(spark, "units"), tuple(carry) + (("hidden",) if hide else ())
    schema = StructType([*_OUT.fields, *[StructField(c, light.schema[c].dataType) for c in names]])
    series.mapInArrow(lambda batches: _decode_partition(batches, names), schema).write.partitionBy("is_block").parquet(path)
    held = spark.read.schema(schema).parquet(path)
    picks = _chain(held.filter("is_block").select("metric", "source", "part", "edge", "scores").collect())  # two rows per partition at most
    picked = F.broadcast(spark.createDataFrame(picks, "part bigint, edge bigint, pair int"))
    rows = held.filter("not is_block").join(picked, ["part", "edge"], "left")
    at = F.when(F.length("codes") == 1, F.lit(1)).otherwise(F.coalesce(F.col("pair"), F.lit(0)) + 1)
    state = F.substring(F.col("codes"), at, F.lit(1)).cast("int")
    decoded = F.when(state == OTHER, F.col("other_size")).when(F.col("quantity").isNotNull(), F.try_element_at(_state_sizes()[F.col("quantity")], state + 1))
    return rows.select("fact_id", "metric", "source", "quantity", "figure", "stated_size", decoded.alias("size"), (F.col("hidden") if hide else F.lit(False)).alias("hidden"), (F.col("figure") * decoded / F.lit(COMMON)).alias("common"), *carry)


def _state_sizes():
    """SQL map: quantity -> sizes of its states."""
    return F.create_map(*[x for q in QUANTITY_NAMES for x in (F.lit(q), F.array(*[F.lit(float(v)) for v in STATES[q]]))])


def _habits(light: DataFrame, by_metric: DataFrame, by_pair: DataFrame) -> tuple[DataFrame, int]:
    """(metric, level, spread, rarity) and the number of all facts: one pass without Python.

    level, spread: median and half the middle two thirds of the log10 figures, in millionths,
    of the facts without value_json whose crosswalk or definition states a unit; the median
    stands against sources that state a wrong one.  rarity: a digit per state, how many nats
    its share of all stated units is below one (9: or more), the start of every series.
    """
    size = F.coalesce("crosswalk_size", "definition_size")
    raw = F.abs("value")
    counts = F.col("json").isNull() & ~F.col("hidden")
    logs = F.when(counts & (raw > 0) & ~F.isnan(raw) & (raw < float("inf")), F.log10(raw) + F.log10(size))
    found = light.join(by_metric.select("metric", "quantity", "definition_size"), "metric", "left").join(by_pair, ["source", "metric"], "left")
    state = F.when(counts, F.array_position(F.try_element_at(_state_sizes(), F.col("quantity")), size))
    rows = found.select("metric", logs.alias("logs"), state.alias("state")).groupBy("metric").agg(F.percentile_approx("logs", [0.16, 0.5, 0.84], 500).alias("p"), F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == k + 1).alias(f"s{k}") for k in range(OTHER)])
    held = rows.groupBy(F.when(F.col("p").isNotNull(), F.col("metric")).alias("metric")).agg(F.max("p").alias("p"), F.sum("n").alias("n"), *[F.max(f"s{k}").alias(f"s{k}") for k in range(OTHER)]).collect()  # metrics with a readable unit
    kept = []
    for r in held:
        if r["metric"] is not None and r["p"] is not None:
            seen = np.array([r[f"s{k}"] for k in range(OTHER)] + [0]) + 0.5
            rarity = "".join(str(min(9, round(-math.log(x)))) for x in seen / seen.sum())
            kept.append((r["metric"], float(r["p"][1]), float(r["p"][2] - r["p"][0]) / 2, rarity))
    return F.broadcast(light.sparkSession.createDataFrame(kept, "metric string, level double, spread double, rarity string")), sum(r["n"] for r in held)


def recorded_elsewhere(facts: DataFrame, definitions: DataFrame, crosswalks: DataFrame) -> DataFrame:
    """metric_fact_id, value_micro: facts recorded in another than the common unit, and their figure in millionths of it.

    A fact with no figure (null or NaN) is no case; a fact delivered several times gives one row.
    """
    known = common_units(facts, definitions, crosswalks).filter(F.col("figure").isNotNull() & ~F.isnan("figure") & (F.col("size") != COMMON))
    return known.select(F.col("fact_id").alias("metric_fact_id"), F.rint(F.col("figure") * F.col("size")).cast("bigint").alias("value_micro")).distinct()
