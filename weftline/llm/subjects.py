"""Subject areas of documents: labelling functions combined by an accuracy-learning latent model.

Each sentence gets votes from labelling functions that rest on separate evidence: three views
of its words (the vocabulary is cut in three, so no word speaks in two of them), its pairs of
words that hold no word of the views, the section around it, the document's address and its
source.  A lexicon vote is weak or strong.  The latent class of a sentence is an area or none;
how often each function speaks, and how often it is right, in sentences about an area, and
what it says by chance in sentences about none, are learned without labels by EM over the vote
patterns of all sentences of the corpus.  A sentence goes to its most probable class, and a
document gets every area that holds at least ``LEAST_SHARE`` of its sentences about any area.

The lexicon is fitted on hand labels of at most ``FIT_DOCS`` documents (those with the
smallest hash of their id) of at most ``FIT_CHARS`` characters, refined by EM over their
sentences.  Everything else covers all documents.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import clean
from weftline.session import materialize

#: Labelled documents the lexicon is fitted on; a bound on the driver's work, not on the corpus.
FIT_DOCS = 6_000
#: Longer labelled documents are left out of the fit (not of the result): bounds the driver's bytes.
FIT_CHARS = 50_000
#: A term enters the lexicon if this many fitted documents hold it, its gain is at least this share of the most
#: it could be (the log of the number of areas), and its documents times its gain are at least so many nats (a
#: test of significance that is the same for any number of fitted documents); earlier rounds ask for less.
TERM_DOCS, TERM_GAIN, EVIDENCE = 3, 0.3, 4.0
#: Prior of an area that a fitted document isn't labelled with, against 0.45 of one it is; small, so that a
#: general sentence of many documents can't drift to one area in the fit.
OTHER_PRIOR = 0.005
#: A vote needs this much summed log-lift; a strong one this share of the most that one word could have.
VOTE, STRONG = 0.7, 0.95
LEAST_SHARE = 0.25
ROUNDS, EM_ROUNDS = 3, 60
#: Views of the vocabulary; a word belongs to one, by a checksum.
VIEWS = 3
#: Labelling functions, in the order of their five bits in a packed vote: 0 (silent) or area + 1, and 16 for a strong vote.
FUNCTIONS = (*(f"words_{i}" for i in range(VIEWS)), "pairs", "section", "address", "source")
#: In a sentence about none at least this share of a lexicon function's chances is silence (else the class would
#: take an area's place), its votes are no stronger than elsewhere, and half of what it says is spread evenly.
LEAST_SILENCE = 0.8
#: A path word or a source votes if at least so many labelled documents have it and its gain suffices.
ORIGIN_DOCS = 20

_FENCE = re.compile(r"```.*?(?:```|\Z)|^[ \t]*\|.*$", re.S | re.M)
_SENTENCE = re.compile(r"(?<=[.!?])[\"')\]»”]*\s+|\n+")
_WORD = re.compile(r"[^\W_]+")
#: A line end within a sentence: the next line goes on in lower case.
_WRAP = re.compile(r"(?<![.!?:\n])[ \t\r]*\n[ \t>]*(?=[a-z\u00df-\u00f6\u00f8-\u00ff])")
#: A line of at most this many words without a full stop is a heading, not a sentence.
HEADING = 8


def sentences(text: str | None) -> list[list[str]]:
    """The sentences of a text as normal words; code, table rows, headings and sentences of two words or fewer are left out."""
    if not text:
        return []
    if "```" in text or "|" in text:
        text = _FENCE.sub("\n", text)
    if "\n" in text:
        text = _WRAP.sub(" ", text)
    out = []
    for piece in _SENTENCE.split(clean(text)):
        found = _WORD.findall(piece)
        if len(found) > HEADING or (len(found) > 2 and piece.rstrip(" \t\r\"')]*_")[-1:] in (".", "!", "?", ";", "\u3002")):
            out.append(found)
    return out


def area_key(name: str | None) -> str:
    """A subject's name without case, outer white space, and hyphens or blanks for underscores."""
    return re.sub(r"[\s_-]+", "_", (name or "").strip().lower())


class Lexicon:
    """Words and pairs of words with the log-lift of each area; path words and sources that tell an area.

    words: word -> (view, row of weights).  Pairs hold no word of ``words``.
    """

    def __init__(self, areas: list[str], words: dict, pairs: dict, weights: np.ndarray, addresses: dict, sources: dict):
        self.areas, self.words, self.pairs, self.weights, self.addresses, self.sources = areas, words, pairs, weights, addresses, sources

    @classmethod
    def fit(cls, areas: list[str], labelled: list[tuple]) -> Lexicon:
        """From (text, set of area numbers, path, source); labels may be wrong or incomplete."""
        k = len(areas)
        index: dict = {}
        flat, sent_of, doc_of, prior_rows = [], [], [], []
        for number, (text, held, _, _) in enumerate(labelled):
            prior = np.full(k, OTHER_PRIOR)
            prior[list(held)] = 0.45
            for words in sentences(text):
                terms = [index.setdefault(t, len(index)) for t in words if not t.isdigit()]
                terms += [index.setdefault(p, len(index)) for p in zip(words, words[1:]) if not (p[0].isdigit() or p[1].isdigit())]
                flat.extend(terms)
                sent_of.extend([len(prior_rows)] * len(terms))
                doc_of.extend([number] * len(terms))
                prior_rows.append(prior)
        if not flat:
            return cls(areas, {}, {}, np.zeros((0, k), np.float32), {}, {})
        flat, sent_of, doc_of = (np.asarray(x, dtype=np.int64) for x in (flat, sent_of, doc_of))
        seen = np.unique(flat * (len(labelled) + 1) + doc_of) // (len(labelled) + 1)
        doc_count = np.bincount(seen, minlength=len(index))
        enough = doc_count >= TERM_DOCS
        doc_count = doc_count[enough]
        number = np.cumsum(enough) - 1
        keep = enough[flat]
        flat, sent_of = number[flat[keep]], sent_of[keep]
        once = np.unique(sent_of * (int(enough.sum()) + 1) + flat)
        sent_of, flat = once // (int(enough.sum()) + 1), once % (int(enough.sum()) + 1)
        size, n = int(enough.sum()), len(prior_rows)
        prior = np.asarray(prior_rows)
        post = prior / prior.sum(axis=1, keepdims=True)
        weights = np.zeros((size, k))
        for step in range(ROUNDS):
            counts = np.stack([np.bincount(flat, weights=post[sent_of, j], minlength=size) for j in range(k)], axis=1)
            base = (post.sum(axis=0) + 1e-6) / (post.sum() + 1e-6 * k)
            total = counts.sum(axis=1, keepdims=True)
            share = (counts + base) / (total + 1)
            lift = np.log(share / base)
            gain = (share * lift).sum(axis=1)
            clear = (gain > TERM_GAIN * np.log(k) * (step + 1) / ROUNDS) & (total[:, 0] >= TERM_DOCS)
            clear &= np.minimum(doc_count, total[:, 0]) * gain > EVIDENCE * (step + 1) / ROUNDS
            weights = np.where(clear[:, None], np.maximum(lift, -3.0), 0.0)
            score = np.stack([np.bincount(sent_of, weights=weights[flat, j], minlength=n) for j in range(k)], axis=1)
            told = np.abs(score).sum(axis=1) > 0
            z = score + np.log(prior)
            z = np.exp(z - z.max(axis=1, keepdims=True))
            post = np.where(told[:, None], z / z.sum(axis=1, keepdims=True), 0.0)
        chosen = np.flatnonzero(np.abs(weights).sum(axis=1) > 0)
        row = {int(t): i for i, t in enumerate(chosen)}
        words, pairs = {}, {}
        for term, at in index.items():
            if enough[at] and int(number[at]) in row:
                if isinstance(term, tuple):
                    pairs[term] = row[int(number[at])]
                else:
                    words[term] = zlib.crc32(term.encode()) % VIEWS, row[int(number[at])]
        pairs = {p: r for p, r in pairs.items() if p[0] not in words and p[1] not in words}
        addresses = cls._origins(k, [(set(_WORD.findall((path or "").lower())), held) for _, held, path, _ in labelled])
        sources = cls._origins(k, [({source} if source else set(), held) for _, held, _, source in labelled])
        return cls(areas, words, pairs, weights[chosen].astype(np.float32), addresses, sources)

    @staticmethod
    def _origins(k: int, seen: list[tuple[set, set]]) -> dict[str, int]:
        """What of a document's origin tells its area: word -> area."""
        by: dict = defaultdict(lambda: np.zeros(k))
        base = np.ones(k)
        for names, held in seen:
            for area in held:
                base[area] += 1 / len(held)
                for name in names:
                    by[name][area] += 1 / len(held)
        base /= base.sum()
        out = {}
        for name, counts in by.items():
            share = (counts + base) / (counts.sum() + 1)
            if counts.sum() >= ORIGIN_DOCS and (share * np.log(share / base)).sum() > TERM_GAIN * np.log(k):
                out[name] = int(share.argmax())
        return out


def _votes(scores: np.ndarray) -> np.ndarray:
    """Packed vote of each row's summed weights: 0 where no area reaches VOTE."""
    best = scores.max(axis=1)
    return np.where(best > VOTE, scores.argmax(axis=1) + 1, 0) | np.where(best > max(VOTE, STRONG * np.log(scores.shape[1])), 16, 0)


def _sums(weights: np.ndarray, flat: list, lens: list) -> np.ndarray:
    """Summed weights per sentence."""
    out = np.zeros((len(lens), weights.shape[1]), np.float32)
    if flat:
        lens = np.asarray(lens)
        some = np.flatnonzero(lens)
        out[some] = np.add.reduceat(weights[np.asarray(flat)], np.concatenate([[0], np.cumsum(lens[some])[:-1]]), axis=0)
    return out


def votes(lexicon: Lexicon, texts: list, paths: list, sources: list) -> list[np.ndarray]:
    """Per document the packed votes of its sentences, five bits per labelling function."""
    words, pairs, k = lexicon.words, lexicon.pairs, len(lexicon.areas)
    flat, lens = [[] for _ in range(VIEWS + 1)], [[] for _ in range(VIEWS + 1)]
    doc_of, sizes = [], []
    for number, text in enumerate(texts):
        held = sentences(text)
        for s in held:
            before = [len(f) for f in flat]
            for w in s:
                if w in words:
                    view, row = words[w]
                    flat[view].append(row)
            flat[VIEWS] += [pairs[p] for p in zip(s, s[1:]) if p in pairs]
            for n, f, b in zip(lens, flat, before):
                n.append(len(f) - b)
        doc_of += [number] * len(held)
        sizes.append(len(held))
    n = len(doc_of)
    if not n or not len(lexicon.weights):
        return [np.zeros(size, np.int64) for size in sizes]
    doc_of = np.asarray(doc_of)
    sums = [_sums(lexicon.weights, f, m) for f, m in zip(flat, lens)]
    packed = np.zeros(n, np.int64)
    for j, found in enumerate(sums):
        packed |= _votes(found).astype(np.int64) << (5 * j)
    # section: the area most of the four sentences around speak for, within the document
    whole = _votes(np.add.reduce(sums)) & 15
    one = np.zeros((n, k + 1), np.int32)
    one[np.arange(n), whole] = 1
    one[:, 0] = 0
    around = np.zeros((n, k + 1), np.int32)
    for shift in (-2, -1, 1, 2):
        at = np.arange(n) + shift
        ok = (at >= 0) & (at < n)
        ok[ok] &= doc_of[at[ok]] == doc_of[np.flatnonzero(ok)]
        around[ok] += one[at[ok]]
    most = around.max(axis=1)
    section = np.where(most >= 1, around.argmax(axis=1), 0) | np.where(most >= 2, 16, 0)
    origin = np.zeros(len(texts), np.int64)
    for i, (path, name) in enumerate(zip(paths, sources)):
        told = {lexicon.addresses[w] for w in _WORD.findall((path or "").lower()) if w in lexicon.addresses} if lexicon.addresses else ()
        if len(told) == 1:
            origin[i] |= (told.pop() + 1) << 5 * (VIEWS + 2)
        if name in lexicon.sources:
            origin[i] |= (lexicon.sources[name] + 1) << 5 * (VIEWS + 3)
    packed |= section.astype(np.int64) << (5 * (VIEWS + 1)) | origin[doc_of]
    ends = np.cumsum(sizes)
    return [packed[a:b] for a, b in zip(np.concatenate([[0], ends[:-1]]), ends)]


def _unpack(patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(patterns x functions): the area voted for, -1 where silent; and the strength, 0 silent, 1 weak, 2 strong."""
    code = (patterns[:, None] >> (5 * np.arange(len(FUNCTIONS)))) & 31
    area = (code & 15) - 1
    return area, np.where(area < 0, 0, 1 + (code >> 4))


class LabelModel:
    """Class of a sentence from its votes: areas 0 to k - 1, and k for none.

    speaks[f, s], stray[f, s]: how often function f is silent, weak or strong in sentences about
    an area and about none; accuracy[f, s]: how often its votes in the former are right;
    chance[f, s, a]: what it says in the latter; prior: of the classes.
    """

    def __init__(self, k: int):
        f = len(FUNCTIONS)
        self.k = k
        self.speaks, self.stray = np.tile([0.4, 0.2, 0.4], (f, 1)), np.tile([0.9, 0.07, 0.03], (f, 1))
        self.accuracy = np.tile([1.0, 0.8, 0.9], (f, 1))
        self.chance = np.full((f, 3, k), 1 / k)
        self.prior = np.full(k + 1, 0.8 / k)
        self.prior[k] = 0.2

    def posteriors(self, patterns: np.ndarray) -> np.ndarray:
        """Probability of each class for each vote pattern."""
        k = self.k
        area, strength = _unpack(patterns)
        z = np.tile(np.log(self.prior), (len(patterns), 1))
        for j in range(len(FUNCTIONS)):
            s, cast = strength[:, j], np.flatnonzero(strength[:, j])
            z[:, :k] += np.log(self.speaks[j, s])[:, None]
            z[:, k] += np.log(self.stray[j, s])
            right = self.accuracy[j, s[cast]]
            wrong = np.log((1 - right) / max(k - 1, 1))
            z[cast, :k] += wrong[:, None]
            z[cast, area[cast, j]] += np.log(right) - wrong
            z[cast, k] += np.log(self.chance[j, s[cast], area[cast, j]])
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def learn(self, patterns: np.ndarray, counts: np.ndarray) -> LabelModel:
        """EM over vote patterns and their counts."""
        if not len(patterns):
            return self
        k = self.k
        area, strength = _unpack(patterns)
        for _ in range(EM_ROUNDS):
            post = self.posteriors(patterns) * counts[:, None]
            about, none = post[:, :k].sum(axis=1), post[:, k]
            for j in range(len(FUNCTIONS)):
                for s in range(3):
                    at = np.flatnonzero(strength[:, j] == s)
                    self.speaks[j, s], self.stray[j, s] = (about[at].sum() + 1) / (about.sum() + 3), (none[at].sum() + 1) / (none.sum() + 3)
                    if s and len(at):
                        self.accuracy[j, s] = np.clip((post[at, area[at, j]].sum() + 8) / (about[at].sum() + 10), 1 / k, 0.9999)
                        self.chance[j, s] = 0.5 / k + 0.5 * (np.bincount(area[at, j], weights=none[at], minlength=k) + 1) / (none[at].sum() + k)
                cast = self.stray[j, 1:].sum()
                strong = min(self.stray[j, 2] / cast, self.speaks[j, 2] / self.speaks[j, 1:].sum())
                self.stray[j, 1:] = cast * (1 - strong), cast * strong
                if j <= VIEWS and self.stray[j, 0] < LEAST_SILENCE:
                    self.stray[j, 1:] *= (1 - LEAST_SILENCE) / self.stray[j, 1:].sum()
                    self.stray[j, 0] = LEAST_SILENCE
            self.prior = (post.sum(axis=0) + 1) / (post.sum() + k + 1)
        return self


def fit_lexicon(documents: DataFrame, labels: DataFrame, areas: list[str], fit_docs: int = FIT_DOCS) -> Lexicon:
    """The lexicon from hand labels of at most ``fit_docs`` documents; unknown subjects and documents are ignored."""
    key = F.regexp_replace(F.lower(F.trim("subject")), r"[\s_-]+", "_")
    known = labels.select("doc_id", key.alias("subject")).filter(F.col("subject").isin(areas)).distinct()
    by_doc = known.groupBy("doc_id").agg(F.array_sort(F.collect_set("subject")).alias("held"))
    chosen = by_doc.orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_docs)
    number = {a: i for i, a in enumerate(areas)}
    short = documents.select("doc_id", "text", "path", "source").filter(F.length("text") <= FIT_CHARS)
    rows = short.join(F.broadcast(chosen), "doc_id").orderBy("doc_id").limit(2 * fit_docs).collect()  # at most fit_docs documents; a document may stand twice
    return Lexicon.fit(areas, [(r["text"], {number[s] for s in r["held"]}, r["path"], r["source"]) for r in rows])


def area_names(subject_areas: DataFrame) -> list[str]:
    """The names of the areas; at most 14 fit the packed votes."""
    names = sorted({r[0] for r in subject_areas.select("subject").distinct().limit(16).collect() if r[0]})
    if len(names) > 14:
        raise ValueError("more than 14 subject areas")
    return names


def document_votes(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, votes: packed votes of each document's sentences; one narrow pass over all texts."""
    shared = documents.sparkSession.sparkContext.broadcast(lexicon)

    def run(batches):
        held = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                found = votes(held, *(part.column(i).to_pylist() for i in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "votes"])

    source = documents.select("doc_id", F.col("text").cast("string").alias("text"), "path", "source")
    return source.mapInArrow(run, f"doc_id {source.schema[0].dataType.simpleString()}, votes array<bigint>")


def document_areas(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame, least_share: float = LEAST_SHARE, fit_docs: int = FIT_DOCS) -> DataFrame:
    """doc_id, subject, n_sentences, share: each document and area with at least ``least_share`` of its sentences about any area.

    Null, empty and blank texts and texts about no area have no row.  Repeated rows of a
    document give repeated rows.  Without any usable label there is no lexicon and no row.
    """
    spark = documents.sparkSession
    areas = area_names(subject_areas)
    lexicon = fit_lexicon(documents, labels, [area_key(a) for a in areas], fit_docs)
    held = materialize(document_votes(documents, lexicon), "votes")
    seen = held.select(F.explode("votes").alias("pattern")).groupBy("pattern").count().collect()  # patterns, not sentences
    k = len(areas)
    model = LabelModel(k).learn(np.array([r[0] for r in seen], dtype=np.int64), np.array([r[1] for r in seen], dtype=float))
    kind = held.schema[0].dataType.simpleString()

    def run(batches):
        for batch in batches:
            column = batch.column(1)
            lens, flat = np.asarray(column.value_lengths()), np.asarray(column.flatten(), dtype=np.int64)
            patterns, back = np.unique(flat, return_inverse=True)
            best = model.posteriors(patterns).argmax(axis=1)[back] if len(flat) else np.empty(0, np.int64)
            counts = np.zeros((len(lens), k + 1), np.int64)
            np.add.at(counts, (np.repeat(np.arange(len(lens)), lens), best), 1)
            counts = counts[:, :k]
            total = counts.sum(axis=1, keepdims=True)
            docs, at = np.nonzero((counts > 0) & (counts >= least_share * total))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(docs)), pa.array([areas[i] for i in at], pa.string()), pa.array(counts[docs, at].astype(np.int32)), pa.array(counts[docs, at] / total[docs, 0])], names=["doc_id", "subject", "n_sentences", "share"]
            )

    return held.mapInArrow(run, f"doc_id {kind}, subject string, n_sentences int, share double")


def composition(documents: DataFrame, labels: DataFrame, subject_areas: DataFrame) -> DataFrame:
    """subject, documents, characters: what the corpus is made of, a document counting for each of its areas."""
    found = document_areas(documents, labels, subject_areas)
    sizes = documents.select("doc_id", F.length("text").alias("chars"))
    return found.join(sizes, "doc_id").groupBy("subject").agg(F.count(F.lit(1)).alias("document_count"), F.sum("chars").alias("char_count"))
