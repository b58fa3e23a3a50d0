"""Evaluation texts in training texts, by a generalised suffix automaton of the test items.

The automaton holds every run of words of every item.  The words of a document are streamed
through it, tracking the longest run that ends at each word.  Where that run has ``SEED``
words or more, the items that hold it are known, and an exact check follows: the run is
extended to both sides with edits, for a passage of at least ``LEAST`` words of the item of
which at most one in ``ONE_IN`` is changed, dropped or added.

Why no passage is missed for the seed: cut a passage into pieces of ``LEAST`` to 2 ``LEAST`` - 1
words.  One of them has no more edits for its length than the whole, so at most 4, and is a
passage itself.  Its words without edits stand in at most 5 runs, the longest of which has 6
words or more, or 4 if a word of the piece is written as two or two as one besides (which is
no edit but ends a run).  So a run is looked at only if it and the other runs near it, of
four words or more on nearly the same diagonal, hold 7 words together: 16 or more words without
edits in at most 4 runs, three of which may be too short to be seen, leave no fewer (longer
pieces leave more).  From the longest run the piece is found with ``FIRST_EDITS`` edits; a run
from which nothing is found with so many is given up, and from the others the whole passage
is found with all the edits its item allows.

The items are counted first.  Those that fit one automaton are broadcast; more go in blocks,
one pass over the documents each, and a worker holds one automaton at a time.  Documents are
never shuffled.
"""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.words import words
from weftline.session import materialize

LEAST, ONE_IN, SEED = 20, 8, 4
#: Edits within which a piece of a passage is found from its longest run.
FIRST_EDITS = (2 * LEAST - 1) // ONE_IN
#: Characters of items in one automaton; some 40 bytes each in a worker.
BLOCK_CHARS = 6_000_000


class Automaton:
    """Generalised suffix automaton over the words of items."""

    def __init__(self, items: list[tuple], seed: int = SEED):
        self.seed = seed
        self.ids = [i for i, _ in items]
        self.items = [w for _, w in items]
        self.vocabulary: dict[str, int] = {}
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: list[tuple[int, int, int]] = []
        for number, item in enumerate(self.items):
            last = 0
            for at, word in enumerate(item):
                last = self._extend(last, self.vocabulary.setdefault(word, len(self.vocabulary)))
                ends.append((last, number, at))
        self.occurs = self._occurrences(ends)

    def _state(self, length: int, link: int, moves: dict) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.next) - 1

    def _split(self, p: int, word: int, q: int) -> int:
        """The state for the runs of q that p's run plus the word is a part of."""
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = copy
        while p != -1 and self.next[p].get(word) == q:
            self.next[p][word] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, word: int) -> int:
        held = self.next[last].get(word)
        if held is not None:
            return held if self.length[held] == self.length[last] + 1 else self._split(last, word, held)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p != -1 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p != -1:
            q = self.next[p][word]
            self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, word, q)
        return new

    def seed_state(self, state: int) -> int:
        """The state of the run's last ``seed`` words: the highest one on the suffix path that still has them."""
        while self.length[self.link[state]] >= self.seed:
            state = self.link[state]
        return state

    def _occurrences(self, ends) -> dict[int, list[tuple[int, int]]]:
        """Where the last ``seed`` words of a state occur: (item, position of the last word)."""
        out: dict[int, list] = {}
        for state, number, at in ends:
            if at + 1 >= self.seed:
                out.setdefault(self.seed_state(state), []).append((number, at))
        return out

    def seeds(self, text: list[str]):
        """(position in the text, [(item, position)]) for every word at which a run of ``seed`` words of items ends."""
        get, moves, link, length, seed = self.vocabulary.get, self.next, self.link, self.length, self.seed
        state = run = 0
        at = -1
        for word in map(get, text):
            at += 1
            if word is None:
                state = run = 0
                continue
            to = moves[state].get(word)
            if to is not None:
                state = to
                run += 1
                if run >= seed:
                    yield at, self.occurs.get(self.seed_state(state), ())
                continue
            while state and word not in moves[state]:
                state = link[state]
            to = moves[state].get(word)
            if to is None:
                state = run = 0
            else:
                run = length[state] + 1
                state = to
                if run >= seed:
                    yield at, self.occurs.get(self.seed_state(state), ())


def _reach(doc: list[str], item: list[str], i: int, j: int, step: int, most: int) -> list[tuple[int, int]]:
    """reach[e]: (words of the item, words of the document) passed from (i, j) on with e edits, ending on a match.

    step 1 goes right, -1 left.  Two words written as one, or one as two, are no edit.
    """
    n, m = len(doc), len(item)
    level = {0: 0}  # doc words minus item words passed -> item words passed
    best, out = (0, 0), []
    for _ in range(most + 1):
        for shift in sorted(level):
            y = level[shift]
            moved = False
            while True:
                x = y + shift
                a, b = i + step * x, j + step * y
                if not (0 <= a < n and 0 <= b < m):
                    break
                if doc[a] == item[b]:
                    y += 1
                    moved = True
                    continue
                a2, b2 = a + step, b + step
                if 0 <= a2 < n and len(item[b]) == len(doc[a]) + len(doc[a2]) and item[b] == (doc[a] + doc[a2] if step > 0 else doc[a2] + doc[a]):
                    y, shift, moved = y + 1, shift + 1, True
                    continue
                if 0 <= b2 < m and len(doc[a]) == len(item[b]) + len(item[b2]) and doc[a] == (item[b] + item[b2] if step > 0 else item[b2] + item[b]):
                    y, shift, moved = y + 2, shift - 1, True
                    continue
                break
            if moved:
                best = max(best, (y, y + shift))
            level[shift] = max(level.get(shift, 0), y)
        out.append(best)
        following: dict[int, int] = {}
        for shift, y in level.items():
            for to, yy in ((shift, y + 1), (shift + 1, y), (shift - 1, y + 1)):
                if yy > following.get(to, -1):
                    following[to] = yy
        level = following
    return out


def passage(doc: list[str], item: list[str], i: int, j: int, seed: int = SEED, least: int = LEAST, one_in: int = ONE_IN) -> tuple[int, int, int, int] | None:
    """(words, edits, start, end) of the longest passage around the run that ends at doc[i] and item[j]; None if none is long enough.

    The edits allowed grow with the length, so both sides are tried with ``FIRST_EDITS`` edits
    first and given up if that gives no passage (see the module's text), then with more.
    """
    top = len(item) // one_in
    most = min((2 * least - 1) // one_in, top)
    while True:
        right, left = _reach(doc, item, i + 1, j + 1, 1, most), _reach(doc, item, i - seed, j - seed, -1, most)
        found = None
        for e in range(most + 1):
            for k in range(e + 1):
                n = seed + left[k][0] + right[e - k][0]
                if n >= least and one_in * e <= n and (found is None or n > found[0]):
                    found = (n, e, i - seed + 1 - left[k][1], i + 1 + right[e - k][1])
        if found is None or most >= top:
            return found
        most = min(top, most * 2)


def leaks_in(automata: list[Automaton], text: list[str], least: int = LEAST, one_in: int = ONE_IN, every: bool = False) -> list[tuple]:
    """(item id, words, edits, start, end) of the items that a document leaks; start and end count its words.

    The longest passage of each item (of equal ones that of fewest edits, then the first), or with
    ``every`` one for every run that doesn't lie within a passage of the item found before.
    """
    out = []
    if len(text) < least - least // one_in:
        return out
    for automaton in automata:
        starts: dict[tuple, list] = {}
        for at, held in automaton.seeds(text):
            for number, pos in held:
                # a run goes on along one diagonal: its first seed stands for it
                known = starts.setdefault((number, pos - at), [])
                if not known or at > known[-1][2] + 1:
                    known.append([at, pos, at])
                else:
                    known[-1][2] = at
        by_item: dict[int, list] = {}
        for (number, diagonal), runs in starts.items():
            if len(automaton.items[number]) >= least:
                by_item.setdefault(number, []).extend((first, diagonal, pos, last - first + automaton.seed) for first, pos, last in runs)
        spans: dict[int, list] = {}
        best: dict[int, tuple] = {}
        for number, runs in by_item.items():
            item = automaton.items[number]
            for at, pos in _promising(runs, least, one_in):
                if every and any(a <= at < b for a, b in spans.get(number, ())):
                    continue
                found = passage(text, item, at, pos, automaton.seed, least, one_in)
                if not found:
                    continue
                if every:
                    spans.setdefault(number, []).append(found[2:])
                    out.append((automaton.ids[number], *found))
                else:
                    known = best.get(number)
                    if known is None or (-found[0], found[1], found[2]) < (-known[0], known[1], known[2]):
                        best[number] = found
        out += [(automaton.ids[number], *found) for number, found in best.items()]
    return out


def _promising(runs: list[tuple], least: int, one_in: int):
    """(position in the text, position in the item) of the runs that a piece of a passage may hold; see the module's text.

    runs: (position, diagonal, position in the item, words); positions are those of the end of
    a run's first seed.
    """
    size = 2 * least - 1
    drift = size // one_in + 1  # edits, and one word written as two
    few = least // one_in
    # the words of the shortest piece without edits, and beside one joined pair; runs of three words are not seen
    enough = least - few - 2 - 3 * (few + 1)
    if max(n for _, _, _, n in runs) < enough and len(runs) == 1:
        return
    runs.sort()
    near = size + drift
    low = 0
    for i, (at, diagonal, pos, n) in enumerate(runs):
        if n < enough:
            while runs[low][0] < at - near:
                low += 1
            total, j = 0, low
            while j < len(runs) and runs[j][0] <= at + near and total < enough:
                total += runs[j][3] if abs(runs[j][1] - diagonal) <= drift else 0
                j += 1
            if total < enough:
                continue
        yield at, pos


def word_offset(text: str, count: int) -> int:
    """The least length of a prefix of the text that holds more than ``count`` words, less its last word; the text's length if none does."""
    low, high = 0, len(text)
    if len(words(text)) <= count:
        return len(text)
    while low < high:
        middle = (low + high) // 2
        if len(words(text[:middle])) > count:
            high = middle
        else:
            low = middle + 1
    while low > 0 and text[low - 1 : low].isalnum():
        low -= 1
    return low


def without_spans(text: str, spans: list[tuple[int, int]], coverage: float = 0.5) -> tuple[str | None, int, float]:
    """(clean text, spans cut, share of words cut): the spans, in words, cut out of the text as written.

    A text of which more than ``coverage`` goes is no text any more: None.
    """
    merged: list[list[int]] = []
    for a, b in sorted(spans):
        if merged and a <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b])
    if not merged:
        return text, 0, 0.0
    share = sum(b - a for a, b in merged) / len(words(text))
    if share > coverage:
        return None, len(merged), share
    parts, at = [], 0
    for a, b in merged:
        parts.append(text[at : word_offset(text, a)])
        at = word_offset(text, b)
    return "".join(parts) + text[at:], len(merged), share


_built: dict[int, list[Automaton]] = {}


def _blocks(documents: DataFrame, items: DataFrame, item_id: str, item_text: str, least: int, block_chars: int) -> list:
    """Per block of items a function that gives a worker its automaton, built once from the broadcast block.

    The items' characters are counted first; each block is collected and broadcast by itself.
    """
    spark = documents.sparkSession
    known = items.select(F.col(item_id).alias("i"), F.col(item_text).alias("t")).filter(F.col("t").isNotNull()).distinct()
    chars = known.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-chars // block_chars))
    out = []
    for block in range(n):
        part = known if n == 1 else known.filter(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == block)
        shared = spark.sparkContext.broadcast([(r[0], r[1]) for r in part.orderBy("i", "t").collect()])  # about block_chars characters

        def automata(shared=shared) -> list[Automaton]:
            key = hash((least, *shared.value))
            if key not in _built:
                _built.clear()
                held = [(number, split) for number, content in shared.value if len(split := words(content)) >= least]
                _built[key] = [Automaton(held)] if held else []
            return _built[key]

        out.append(automata)
    return out


def find_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least: int = LEAST, one_in: int = ONE_IN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, item_id, n_words, n_edits: each document and item of which it holds a passage.

    n_words counts the item's words in the longest passage, n_edits its changes.  Null and
    blank texts and items of fewer than ``least`` words leak nothing.  Whole texts are read,
    however long.  A repeated row of either table gives no second row of a pair.
    """
    kind, item_kind = documents.schema[doc_id].dataType, items.schema[item_id].dataType
    source = documents.select(F.col(doc_id), F.col(text).cast("string").alias("_text"))

    def pairs_of(automata) -> DataFrame:
        def run(batches):
            built = automata()
            for batch in batches:
                out = [(d, *found[:3]) for d, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()) if content for found in leaks_in(built, words(content), least, one_in)]
                cols = list(zip(*out)) if out else [[], [], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(cols[0], batch.schema[0].type), pa.array(cols[1], _arrow(item_kind)), pa.array(cols[2], pa.int32()), pa.array(cols[3], pa.int32())], names=["d", "i", "n_words", "n_edits"])

        return source.mapInArrow(run, f"d {kind.simpleString()}, i {item_kind.simpleString()}, n_words int, n_edits int")

    pairs = reduce(DataFrame.unionByName, [pairs_of(automata) for automata in _blocks(documents, items, item_id, item_text, least, block_chars)])
    best = F.max(F.struct(F.col("n_words"), (-F.col("n_edits")).alias("e")))
    return pairs.groupBy(F.col("d").alias(doc_id), F.col("i").alias(item_id)).agg(best.alias("b")).select(doc_id, item_id, F.col("b.n_words").alias("n_words"), (-F.col("b.e")).alias("n_edits"))


def remove_leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "item_text", least: int = LEAST, one_in: int = ONE_IN, coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """doc_id, clean, spans, share: the documents with leaking spans cut out; clean is null where more than ``coverage`` of the words leak.

    One row per row; a text without leaks is as it was, a null text stays null.  Spans of all
    blocks of items are marked on the text as it came, then cut together.
    """
    kind = documents.schema[doc_id].dataType.simpleString()
    held = documents.select(F.col(doc_id).alias("d"), F.col(text).cast("string").alias("t"), F.array().cast("array<int>").alias("s"))
    schema = f"d {kind}, t string, s array<int>"

    def marked(frame: DataFrame, automata) -> DataFrame:
        def run(batches):
            built = automata()
            for batch in batches:
                more = [[x for found in leaks_in(built, words(t), least, one_in, True) for x in found[3:5]] if t else [] for t in batch.column(1).to_pylist()]
                spans = [known + new for known, new in zip(batch.column(2).to_pylist(), more)]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(spans, pa.list_(pa.int32()))], names=["d", "t", "s"])

        return frame.mapInArrow(run, schema)

    blocks = _blocks(documents, items, item_id, item_text, least, block_chars)
    for number, automata in enumerate(blocks):
        held = marked(held, automata)
        if number + 1 < len(blocks):
            held = materialize(held, "leaks")  # a worker holds one automaton at a time

    def cut(batches):
        for batch in batches:
            out = [without_spans(t, list(zip(s[::2], s[1::2])), coverage) if t else (t, 0, 0.0) for t, s in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            clean, spans, share = zip(*out) if out else ([], [], [])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string()), pa.array(spans, pa.int32()), pa.array(share, pa.float64())], names=[doc_id, "clean", "spans", "share"])

    return held.mapInArrow(cut, f"{doc_id} {kind}, clean string, spans int, share double")


def _arrow(kind) -> pa.DataType:
    return {"bigint": pa.int64(), "int": pa.int32()}.get(kind.simpleString(), pa.string())
