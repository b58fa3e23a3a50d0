"""Text operators: normal form, spans, quantities, personal data, entities, templates, links."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from weftline.operators import personal

# fixed values: scale words and currency codes of quantities
SCALES = {"thousand": 1e3, "k": 1e3, "million": 1e6, "m": 1e6, "mn": 1e6, "billion": 1e9, "bn": 1e9, "b": 1e9, "trillion": 1e12, "tn": 1e12}
CURRENCIES = ("AUD", "USD", "EUR", "GBP", "NZD", "CAD", "JPY", "CHF", "CNY", "SGD", "HKD")


def normalize(text: Column) -> Column:
    """LF line ends, no blanks at line ends, at most one empty line in a row, trimmed; null stays null.  Idempotent."""
    t = F.regexp_replace(text, r"\r\n?", "\n")
    t = F.regexp_replace(t, r"(?m)[ \t]+$", "")
    t = F.regexp_replace(t, r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


SPAN = "array<struct<start:int,end:int,text:string>>"
_SENTENCE_END = re.compile(r"(?<=[.!?])\s+")
_PARAGRAPH = re.compile(r"[^\n]+(?:\n[^\n]+)*")


def spans_of(text: str | None, grain: str = "sentence") -> list[tuple[int, int, str]]:
    """(start, end, text) of the paragraphs or sentences of a normalised text, offsets exact."""
    out = []
    for p in _PARAGRAPH.finditer(text or ""):
        cuts = [0]
        if grain == "sentence":
            for m in _SENTENCE_END.finditer(p.group()):
                cuts += [m.start(), m.end()]
        cuts.append(len(p.group()))
        for a, b in zip(cuts[::2], cuts[1::2]):
            piece = p.group()[a:b]
            lead = len(piece) - len(piece.lstrip())
            if piece.strip():
                out.append((p.start() + a + lead, p.start() + a + len(piece.rstrip()), piece.strip()))
    return out


def spans(text: Column, grain: str = "sentence") -> Column:
    """Array of (start, end, text) of a text's sentences or paragraphs; empty for null."""

    @F.pandas_udf(SPAN)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "text"), x)) for x in spans_of(t, grain)])

    return run(text)


#: A figure with or without thousands separators.
_FIGURE = re.compile(r"(?<![\w.,])\d+(?:,\d{3})*(?:\.\d+)?")
_SIGNS = "$£€¥"
_SCALE_WORD = re.compile(r"\s?([A-Za-z]+)(?![A-Za-z])")
_PER_CENT = re.compile(r"\s?(?:%|per ?cent(?:age)?\b)", re.I)


def _currency_before(text: str, at: int) -> tuple[int, str | None]:
    """(start, code) of a currency that ends right before a figure; a sign alone names no currency; (at, None) if there is none."""
    head = text[:at].rstrip(" ") if at and text[at - 1] == " " else text[:at]
    if head[-1:] in _SIGNS and head:
        start = len(head) - 1
        while start and head[start - 1].isascii() and head[start - 1].isupper() and len(head) - start < 3:
            start -= 1
        return start, None
    code = head[-3:].upper()
    if code in CURRENCIES and not head[-4:-3].isalnum():
        return len(head) - 3, code
    return at, None


def quantities_of(text: str | None) -> list[dict]:
    """kind (percentage, currency, number), value, unit and surface of each quantity; bare numbers are none.

    A figure is read with what stands at its sides: a currency before it, a word of scale and
    a per cent sign after it.  A bare dollar sign names no currency.
    """
    out = []
    for m in _FIGURE.finditer(text or ""):
        start, code = _currency_before(text, m.start())
        end, factor = m.end(), 1.0
        word = _SCALE_WORD.match(text, end)
        if word and word[1].lower() in SCALES and (len(word[1]) > 1 or word.start(1) == end):
            end, factor = word.end(), SCALES[word[1].lower()]
        share = _PER_CENT.match(text, end)
        money = start < m.start()
        if share:
            end, kind, unit = share.end(), "percentage", "percent"
        elif money:
            kind, unit = "currency", code
        elif factor != 1.0:
            kind, unit = "number", None
        else:
            continue
        out.append({"kind": kind, "value": float(m.group().replace(",", "")) * factor, "unit": unit, "surface": text[start:end]})
    return out


def quantities(text: Column) -> Column:
    """Array of the quantities of a text; empty for null."""

    @F.pandas_udf("array<struct<kind:string,value:double,unit:string,surface:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(quantities_of)

    return run(text)


def pii_of(text: str | None, extra: tuple = ()) -> list[tuple[int, int, str]]:
    """(start, end, type) of personal data, see ``personal.found_in``; ``extra``: further (type, finder) pairs."""
    return personal.found_in(text, extra)


def pii(text: Column, extra: tuple = ()) -> Column:
    """Array of (start, end, type) of a text's personal data; the values themselves are never returned."""

    @F.pandas_udf("array<struct<start:int,end:int,type:string>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("start", "end", "type"), x)) for x in pii_of(t, extra)])

    return run(text)


def redact_of(text: str | None, numbered: bool = False, extra: tuple = ()) -> str | None:
    """The text with personal data replaced by [REDACTED:TYPE], or by [TYPE_n], one number per value by first appearance."""
    if text is None:
        return None
    out, at, seen = [], 0, {}
    for start, end, kind in pii_of(text, extra):
        value = text[start:end]
        if numbered:
            names = seen.setdefault(kind, {})
            mark = f"[{kind}_{names.setdefault(value, len(names) + 1)}]"
        else:
            mark = f"[REDACTED:{kind}]"
        out += [text[at:start], mark]
        at = end
    return "".join(out) + text[at:]


def redact(text: Column, numbered: bool = False, extra: tuple = ()) -> Column:
    """``redact_of`` over Arrow batches; null stays null."""

    @F.pandas_udf("string")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: redact_of(t, numbered, extra))

    return run(text)


def entities(text: Column) -> Column:
    """Distinct proper-noun phrases of a text, lower-case: runs of capitalised words, in built-in functions."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"\b([A-Z][a-zA-Z0-9]+(?: [A-Z][a-zA-Z0-9]+)*)\b"), F.lit(1))
    return F.array_distinct(F.transform(found, F.lower))


def cooccurrence(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    """a, b, n: pairs of entities (a < b) named in one sentence, and the number of their sentences.

    Pairs are built within a sentence only and are counted before the shuffle.
    """
    sentence = F.explode(F.split(F.col(text), r"(?<=[.!?])\s+|\n"))
    named = df.select(doc_id, sentence.alias("s")).select(F.array_sort(entities(F.col("s"))).alias("e")).filter(F.size("e") > 1)
    first = named.select(F.posexplode("e").alias("i", "a"), "e")
    pairs = first.select("a", F.explode(F.expr("slice(e, i + 2, size(e))")).alias("b"))
    return pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))


_KINDS = {"number": r"[-+]?\d+(?:[.,]\d+)*", "word": r"[^\W\d_]+", "name": r"[A-Z]\w*", "text": r".+?", "id": r"[\w.:-]+"}


def template_pattern(template: str) -> tuple[str, list[str]]:
    """(Java pattern, names) of a template such as ``Step {n:number}: open the {what:text}.``; an unknown kind is an error."""
    pattern, names, at = "", [], 0
    for m in re.finditer(r"\{(\w+):(\w+)\}", template):
        if m[2] not in _KINDS or m[1] in names:
            raise ValueError(f"bad variable {m.group()}")
        pattern += re.escape(template[at : m.start()]) + f"({_KINDS[m[2]]})"
        names.append(m[1])
        at = m.end()
    return pattern + re.escape(template[at:]), names


def template_extract(df: DataFrame, keys: list[str], text: str, templates: dict[str, str]) -> DataFrame:
    """keys, template, variables (map), confidence: every place a template matches; confidence .5 + .1 per variable, at most 1."""
    out = None
    for name, template in templates.items():
        pattern, variables = template_pattern(template)
        java = "(?U)" + pattern.replace(r"[^\W\d_]+", r"\p{L}+")
        whole = F.explode(F.regexp_extract_all(F.col(text), F.lit(f"({java})"), F.lit(1)))
        parts = [x for i, v in enumerate(variables) for x in (F.lit(v), F.regexp_extract(F.col("_m"), java, i + 1))]
        one = df.select(*keys, whole.alias("_m")).select(*keys, F.lit(name).alias("template"), F.create_map(*parts).alias("variables"), F.lit(min(1.0, 0.5 + 0.1 * len(variables))).alias("confidence"))
        out = one if out is None else out.unionByName(one)
    return out


def links(text: Column) -> Column:
    """Targets of the links of a text, in order: HTML href and src, Markdown targets, bare http addresses."""
    pattern = r"""(?i)(?:href|src)\s*=\s*["']([^"'\s>]+)["']|\]\(([^()\s]+)\)|(?<!["'(=])\b(https?://[^\s<>"')\]]+)"""
    each = lambda g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(g))
    return F.filter(F.flatten(F.transform(F.arrays_zip(each(1).alias("a"), each(2).alias("b"), each(3).alias("c")), lambda z: F.array(z["a"], z["b"], z["c"]))), lambda u: u != "")


def html_to_text(html: Column) -> Column:
    """Text of an HTML page: scripts, styles and tags out, block ends as line ends, the five basic entities decoded."""
    t = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|h[1-6]|li|tr|table|ul|ol)\s*>", "\n")
    t = F.regexp_replace(t, r"(?s)</?[A-Za-z][^<>]*>", "")
    for entity, plain in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        t = F.replace(t, F.lit(entity), F.lit(plain))
    return normalize(F.regexp_replace(t, r"[ \t]+", " "))


def parse_figure(text: Column) -> Column:
    """The number a table cell states: currency signs and separators off, k/m/bn scaled, per cent as given, brackets negative; null if none."""
    t = F.lower(F.trim(text))
    digits = F.try_to_number(F.regexp_replace(F.regexp_extract(t, r"(\d[\d,]*\.?\d*)", 1), ",", ""), F.lit("999999999999999999.999999999999")).cast("double")
    scale = F.regexp_extract(t, r"\d\s*(thousand|million|billion|bn|mn|k|m|b)\b", 1)
    factor = F.when(scale.isin("thousand", "k"), 1e3).when(scale.isin("million", "mn", "m"), 1e6).when(scale.isin("billion", "bn", "b"), 1e9).otherwise(1.0)
    return digits * factor * F.when(t.rlike(r"^\(.*\)$|^-"), -1.0).otherwise(1.0)


def exact_copies(df: DataFrame, key: str, text: str) -> DataFrame:
    """key, class_id, copies: each row with the smallest key of its class of equal normalised texts.  Null texts are in no class.

    Texts are compared by SHA-256, and classes of any size are formed by partial aggregates.
    """
    marked = df.select(key, F.sha2(F.encode(normalize(F.col(text)), "utf-8"), 256).alias("h")).filter("h is not null")
    classes = marked.groupBy("h").agg(F.min(key).alias("class_id"), F.count(F.lit(1)).alias("copies"))
    return marked.join(classes, "h").select(key, "class_id", "copies")


def robots_rules(content: str | None, agent: str = "*") -> tuple[list[tuple[str, str]], float | None]:
    """(rules, crawl delay) of a robots.txt for an agent: its own group if there is one, else that of all."""
    groups: dict[str, tuple[list, list]] = {}
    names, fresh = [], True
    for line in (content or "").splitlines():
        field, _, value = line.split("#", 1)[0].partition(":")
        field, value = field.strip().lower(), value.strip()
        if field == "user-agent":
            names = [value.lower()] if fresh else [*names, value.lower()]
            fresh = False
            groups.setdefault(value.lower(), ([], []))
        elif field in ("allow", "disallow", "crawl-delay"):
            fresh = True
            for name in names:
                if field != "crawl-delay":
                    groups[name][0].append((field, value))
                elif re.fullmatch(r"\d+(?:\.\d+)?", value):
                    groups[name][1].append(float(value))
    own = [n for n in groups if n != "*" and n in agent.lower()]
    rules, delays = groups.get(max(own, key=len) if own else "*", ([], []))
    return rules, delays[0] if delays else None


def robots_allowed(rules: list[tuple[str, str]], path: str) -> bool:
    """Whether a path may be fetched: the longest matching rule decides, allow wins ties; no rule allows."""
    best = (-1, True)
    for kind, pattern in rules:
        if not pattern:
            continue
        rx = re.escape(pattern).replace(r"\*", ".*")
        rx = rx[:-2] + "$" if rx.endswith(r"\$") else rx
        if re.match(rx, path):
            best = max(best, (len(pattern), kind.lower() == "allow"))
    return best[1]


def may_fetch(path: Column, rules: list[tuple[str, str]]) -> Column:
    """``robots_allowed`` in built-in functions: the rules are few and known, the paths are not."""
    best = F.lit(0)
    for kind, pattern in rules:
        if pattern:
            rx = "^" + re.escape(pattern).replace(r"\*", ".*")
            rx = rx[:-2] + "$" if rx.endswith(r"\$") else rx
            best = F.greatest(best, F.when(path.rlike(rx), F.lit(2 * len(pattern) + (kind.lower() == "allow"))).otherwise(F.lit(0)))
    return (best == 0) | (best % 2 == 1)


# fixed values: words of doubt, assertion and mood
HEDGES = ("may", "might", "could", "perhaps", "possibly", "likely", "probably", "seems", "appears", "suggests")
ASSERTS = ("is", "are", "was", "were", "must", "will", "always", "never", "proves", "shows", "confirms")
GOOD, BAD = ("good", "better", "best", "improved", "gain", "success", "stable", "clear"), ("bad", "worse", "worst", "failed", "fails", "loss", "lost", "broken", "missing")


def stance(text: Column) -> Column:
    """struct(hedges, asserts, good, bad, polarity, tone): counts of words in a text; polarity (good - bad) / (good + bad), 0 without either; tone by hedges against assertions."""
    words = F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}]+"), lambda w: w != "")
    count = lambda held: F.size(F.filter(words, lambda w: w.isin(*held)))
    hedges, asserts, good, bad = (count(x) for x in (HEDGES, ASSERTS, GOOD, BAD))
    tone = F.when(hedges + asserts == 0, "neutral").when(hedges > asserts, "hedged").when(asserts > hedges, "assertive").otherwise("balanced")
    return F.struct(hedges.alias("hedges"), asserts.alias("asserts"), good.alias("good"), bad.alias("bad"), F.coalesce(F.try_divide(good - bad, good + bad), F.lit(0.0)).alias("polarity"), tone.alias("tone"))


def statements(text: Column) -> Column:
    """Array of struct(subject, verb, object): clauses of names and plain verbs, such as ``Ann Lee wrote the first draft``.

    Without a language model: a capitalised name, a word in -s or -ed, and the words up to a stop.
    """
    pattern = r"\b([A-Z]\w+(?: [A-Z]\w+)*) (\w+(?:ed|s|ote|ook|ave)) ((?:the |a |an )?[^.;:,!?\n]{1,80})"
    each = lambda g: F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(pattern), F.lit(g))
    return F.transform(F.arrays_zip(each(1).alias("subject"), each(2).alias("verb"), each(3).alias("object")), lambda z: F.struct(z["subject"].alias("subject"), z["verb"].alias("verb"), F.trim(z["object"]).alias("object")))


def mentions_of(text: str | None, gazetteer: dict[str, str], cues: dict[str, str] | None = None) -> list[tuple[str, str, int, int]]:
    """(type, surface, start, end) of mentions: gazetteer names as whole words, words after a cue, personal data.

    Mentions may overlap; of personal data only the SHA-256 is given, never the value.
    """
    import hashlib

    out = []
    if not text:
        return out
    if gazetteer:
        names = {k.lower(): v for k, v in gazetteer.items()}
        for m in re.finditer(r"(?<!\w)(?:" + "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True)) + r")(?!\w)", text, re.I):
            out.append((names[m.group().lower()], m.group(), m.start(), m.end()))
    for cue, kind in (cues or {}).items():
        for m in re.finditer(rf"(?<!\w){re.escape(cue)}\s+([A-Z][\w-]*(?:\s+[A-Z][\w-]*)*)", text):
            out.append((kind, m[1], m.start(1), m.end(1)))
    for start, end, kind in pii_of(text):
        out.append((kind, "sha256:" + hashlib.sha256(text[start:end].encode()).hexdigest(), start, end))
    return sorted(out, key=lambda x: (x[2], x[3], x[0]))


def mentions(text: Column, gazetteer: dict[str, str], cues: dict[str, str] | None = None) -> Column:
    """``mentions_of`` over Arrow batches; empty for null."""

    @F.pandas_udf("array<struct<type:string,surface:string,start:int,end:int>>")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [dict(zip(("type", "surface", "start", "end"), x)) for x in mentions_of(t, gazetteer, cues)])

    return run(text)


def split_reading(value: Column, codes: tuple[str, ...]) -> Column:
    """Array of (code, value) of a compound reading such as ``138/85``; empty if its parts are not as many numbers as codes."""
    parts = F.split(F.trim(value), r"\s*/\s*")
    numbers = F.transform(parts, lambda x: x.try_cast("double"))
    pairs = F.zip_with(F.array(*[F.lit(c) for c in codes]), numbers, lambda c, v: F.struct(c.alias("code"), v.alias("value")))
    good = (F.size(parts) == len(codes)) & ~F.exists(numbers, lambda x: x.isNull())
    return F.when(good, pairs).otherwise(F.array().cast("array<struct<code:string,value:double>>"))
