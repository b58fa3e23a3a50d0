import random

import numpy as np
from pyspark.sql import functions as F

from weftline.llm import subjects
from weftline.session import load

AREAS = ["law", "science", "sport"]
NOUNS = {"law": ["covenant", "statute", "plaintiff", "deed"], "science": ["photon", "enzyme", "spectrum", "isotope"], "sport": ["goalkeeper", "marathon", "referee", "league"]}


def line(rng, area):
    if area is None:
        return f"The page was read by {rng.choice(['Ann', 'Bob', 'Cid'])} on {rng.choice(['Monday', 'Friday'])}."
    return f"The {rng.choice(NOUNS[area])} and the {rng.choice(NOUNS[area])} were seen by {rng.choice(['Ann', 'Bob', 'Cid'])}."


def corpus(rng, n):
    rows, truth = [], {}
    for i in range(n):
        kind = rng.random()
        if kind < 0.1:
            parts, held = [line(rng, None) for _ in range(9)], set()
        elif kind < 0.6:
            a, b = rng.sample(AREAS, 2)
            parts, held = [line(rng, a) for _ in range(10)] + [line(rng, b)] + [line(rng, None)], {a}
        else:
            a, b = rng.sample(AREAS, 2)
            parts, held = [line(rng, a) for _ in range(5)] + [line(rng, b) for _ in range(4)] + [line(rng, None) for _ in range(2)], {a, b}
        rng.shuffle(parts)
        rows.append((i, " ".join(parts), "en", rng.choice(["hub", "mail"]), f"hub/{i}.md"))
        truth[i] = held
    return rows, truth


def test_held_out_documents_get_their_areas(spark):
    rng = random.Random(1)
    rows, truth = corpus(rng, 500)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, path string")
    labels = [(i, rng.choice([a.upper(), f" {a}", a]), "r") for i, held in truth.items() if i < 200 for a in held if rng.random() < 0.9]
    labels += [(i, rng.choice(AREAS), "r") for i in range(0, 200, 25)] + labels[:20] + [(10**9, "law", "r"), (3, None, "r"), (4, "cooking", "r"), (None, "law", "r")]
    lab = spark.createDataFrame(labels, "doc_id bigint, subject string, labelled_by string")
    areas = spark.createDataFrame([(a, "x") for a in AREAS], "subject string, about string")
    got = {}
    for r in subjects.document_areas(docs, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    wrong = [i for i in range(200, 500) if got.get(i, set()) != truth[i]]
    assert len(wrong) <= 6


def test_nothing_gives_no_row(spark):
    docs = spark.createDataFrame([(1, None, "en", None, None), (2, "", "en", "s", "p"), (3, " \n ", "en", "s", "p"), (4, "```\ncode\n```", None, "s", "p"), (5, "word " * 100_000, None, "s", "p")], "doc_id bigint, text string, lang string, source string, path string").withColumn("subject", F.lit("law")).withColumn("votes", F.lit(1))
    lab = spark.createDataFrame([], "doc_id bigint, subject string, labelled_by string")
    areas = spark.createDataFrame([("law", "x")], "subject string, about string")
    assert subjects.document_areas(docs, lab, areas).count() == 0
    assert subjects.document_areas(docs.limit(0), lab, areas).count() == 0


def drawn(rng, n, k, accuracy, speaks, stray, none):
    """Votes drawn from the model itself: (class, packed votes)."""
    truth = np.where(rng.random(n) < none, k, rng.integers(0, k, n))
    packed = np.zeros(n, np.int64)
    for j, (right, often, chance) in enumerate(zip(accuracy, speaks, stray)):
        wrong = (rng.random(n) > right) | (truth == k)
        vote = np.where(wrong, (truth + rng.integers(1, k, n)) % k, truth) + 1
        strong = rng.random(n) < 0.5
        cast = rng.random(n) < np.where(truth == k, chance, often)
        packed |= np.where(cast, vote | strong * 16, 0).astype(np.int64) << (5 * j)
    return truth, packed


def test_accuracies_and_the_share_of_none_are_learned_without_labels():
    rng = np.random.default_rng(3)
    accuracy, speaks, stray = (0.95, 0.85, 0.7, 0.6, 0.9, 0.5, 0.8), (0.8, 0.7, 0.8, 0.6, 0.9, 0.5, 0.4), (0.1, 0.05, 0.1, 0.1, 0.2, 0.3, 0.1)
    truth, packed = drawn(rng, 40_000, 4, accuracy, speaks, stray, 0.3)
    patterns, back, counts = np.unique(packed, return_inverse=True, return_counts=True)
    model = subjects.LabelModel(4).learn(patterns, counts.astype(float))
    assert np.abs(model.accuracy[:, 1:] - np.array(accuracy)[:, None]).max() < 0.05 and abs(model.prior[4] - 0.3) < 0.03
    assert np.abs(1 - model.speaks[:, 0] - speaks).max() < 0.05 and np.abs(1 - model.stray[:, 0] - stray).max() < 0.05
    found = model.posteriors(patterns).argmax(axis=1)[back]
    area, strength = subjects._unpack(packed)
    single = max((np.where(strength[:, j] > 0, area[:, j], 4) == truth).mean() for j in range(7))
    assert (found == truth).mean() > single + 0.05


def test_a_stray_word_makes_no_area_but_short_texts_keep_theirs(spark):
    """General sentences that name one word of an area now and then are about none; no share of the text decides that."""
    rng = random.Random(5)
    rows, truth = corpus(rng, 400)
    general = lambda: line(rng, None)
    for i in range(400, 460):
        rows.append((i, " ".join([general() for _ in range(6)] + ["Ann kept the deed of the page as it was on Monday."]), "en", "hub", "x.md"))
    for i in range(460, 480):
        rows.append((i, " ".join([line(rng, "law"), line(rng, "law"), *[general() for _ in range(10)]]), "en", "hub", "y.md"))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, path string")
    lab = spark.createDataFrame([(i, a, "r") for i, held in truth.items() if i < 300 for a in held], "doc_id bigint, subject string, labelled_by string")
    areas = spark.createDataFrame([(a, "x") for a in AREAS], "subject string, about string")
    got = {}
    for r in subjects.document_areas(docs, lab, areas).collect():
        got.setdefault(r.doc_id, set()).add(r.subject)
    assert sum(i in got for i in range(400, 460)) <= 6
    assert sum(got.get(i) == {"law"} for i in range(460, 480)) >= 18


def test_views_rest_on_separate_words_and_silent_origins_have_no_say():
    rng = random.Random(2)
    rows, truth = corpus(rng, 200)
    lexicon = subjects.Lexicon.fit(AREAS, [(text, {AREAS.index(a) for a in truth[i]}, path, source) for i, text, _, source, path in rows])
    assert {v for v, _ in lexicon.words.values()} == {0, 1, 2} and not any(a in lexicon.words or b in lexicon.words for a, b in lexicon.pairs)
    assert lexicon.sources == {} and lexicon.addresses == {}
    told = [("The covenant stands.", {0}, f"law/{i}.md", "court") for i in range(30)] + [("The photon moves.", {1}, f"lab/{i}.md", "lab") for i in range(30)]
    assert subjects.Lexicon.fit(AREAS, told).sources == {"court": 0, "lab": 1}


def test_labelled_half_predicts_the_other_on_the_test_tables(spark, sf):
    sf = sf.replace("0.001", "0.01")
    docs, labels, areas = load(spark, sf, "documents", "subject_labels", "subject_areas")
    fit = labels.filter("doc_id % 2 = 0")
    got = subjects.document_areas(docs, fit, areas).select("doc_id", "subject")
    names = F.regexp_replace(F.lower(F.trim("subject")), r"[\s_-]+", "_")
    held = labels.filter("doc_id % 2 = 1").select("doc_id", names.alias("subject")).distinct()
    found = got.join(held.select("doc_id").distinct(), "doc_id", "left_semi")
    right = found.join(held, ["doc_id", "subject"]).count()
    assert right >= 0.6 * held.count() and right >= 0.6 * found.count()
