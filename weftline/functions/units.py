"""Units of measure in free text: names, prefixes, stated factors, printed figures.

Every unit is a number of millionths of the common unit of its quantity, so that values in
common units come out exactly: share (fraction of one), time (milliseconds), money (US
dollars), memory (megabytes of 10^6 bytes), tokens (single tokens).
"""

from __future__ import annotations

import json
import re
import unicodedata

COMMON = 1e6

# fixed values: names of units by quantity; multipliers are millionths of the common unit
_SHARES = {
    1e6: ("fraction", "fraction of one", "of 1", "of one", "0 1 fraction", "ratio", "ratio between 0 and 1", "share", "shares", "shares of 1.0", "fraction correct", "fraction resolved", "proportion"),
    1e4: ("percent", "per cent", "pct", "%", "% of cases", "percent of cases", "percentage", "percentages", "0 100 percentage", "percentage points"),
    1e3: ("per mille", "permille", "‰", "parts per thousand"),
    1e2: ("basis points", "basis point", "bps", "bp"),
    1.0: ("ppm", "parts per million"),
}
_TIMES = {
    1.0: ("ns", "nsec", "nanosecond", "nanoseconds", "nanos"),
    1e3: ("us", "usec", "usecs", "microsecond", "microseconds", "micros"),
    1e6: ("ms", "msec", "msecs", "millisecond", "milliseconds", "millis"),
    1e9: ("s", "sec", "secs", "second", "seconds"),
    6e10: ("min", "mins", "minute", "minutes"),
    3.6e12: ("h", "hr", "hrs", "hour", "hours"),
    8.64e13: ("d", "day", "days"),
}
_MONEY = {
    1.0: ("uusd", "micro usd", "micro dollars", "microdollars", "u$"),
    1e3: ("musd", "milli usd", "milli dollars", "millidollars", "mills", "m$"),
    1e4: ("cent", "cents", "us cent", "us cents", "usd cents", "¢"),
    1e6: ("usd", "us$", "$", "dollar", "dollars", "us dollar", "us dollars"),
    1e9: ("kusd", "k usd", "k$", "thousand dollars", "thousands of dollars", "thousand usd", "thousands of usd"),
    1e12: ("million dollars", "millions of dollars", "million usd", "millions of usd", "mega usd"),
}


def _memory() -> dict[float, tuple[str, ...]]:
    """Bytes with decimal and binary prefixes, from the prefixes."""
    table = {1.0: ("b", "byte", "bytes")}
    for power, (letter, decimal, binary) in enumerate((("k", "kilo", "kibi"), ("m", "mega", "mebi"), ("g", "giga", "gibi"), ("t", "tera", "tebi")), 1):
        table[1000.0**power] = (f"{letter}b", f"{letter} bytes", f"{decimal}byte", f"{decimal}bytes")
        table[1024.0**power] = (f"{letter}ib", f"{binary}byte", f"{binary}bytes")
    return table


def _tokens() -> dict[float, tuple[str, ...]]:
    table = {1e6: ("tok", "toks", "token", "tokens", "token count", "single tokens", "single token")}
    for size, letter, decimal, word in ((1e9, "k", "kilo", "thousand"), (1e12, "m", "mega", "million"), (1e15, "g", "giga", "billion")):
        table[size] = (f"{letter}tok", f"{letter} tok", f"{letter}tokens", f"{letter} tokens", f"{letter} token", f"{decimal}tokens", f"{word} tokens", f"{word}s of tokens", f"{word} of tokens")
    return table


for _size, _part in ((1.0, "millionth"), (1e3, "thousandth"), (1e4, "hundredth")):
    _MONEY[_size] += tuple(f"{_part}{s} of {a}{d}" for s in ("", "s") for a in ("", "a ", "one ") for d in ("dollar", "dollars", "us dollar", "us dollars", "usd"))


QUANTITIES = {"share": _SHARES, "time": _TIMES, "money": _MONEY, "memory": _memory(), "tokens": _tokens()}
#: The hidden states of each quantity: its units as multipliers, ascending.
STATES = {quantity: tuple(sorted(table)) for quantity, table in QUANTITIES.items()}
_NAMES = {name: (quantity, size) for quantity, table in QUANTITIES.items() for size, names in table.items() for name in names}

_BRACKETS = re.compile(r"\(([^)]*)\)")
_LEAD = re.compile(r"^(?:(?:in|a|an|the|plain|whole|single)\s+)+")


def unit_of(text: str | None) -> tuple[str, float] | None:
    """(quantity, millionths of the common unit) of a unit's name; None if it is none.

    Case, hyphens, underscores and a bracketed range do not matter; ``MUSD`` reads as
    thousandths of a dollar, as writers use it.
    """
    if not text:
        return None
    s = unicodedata.normalize("NFKC", text).lower().replace("μ", "u").replace("_", " ").replace("-", " ").replace("–", " ")
    s = " ".join(s.split()).strip(" .,;:")
    if s in _NAMES:
        return _NAMES[s]
    inner = _BRACKETS.search(s)
    if inner:
        outer = " ".join(_BRACKETS.sub(" ", s).split())
        s = outer if outer else inner.group(1).strip()
    return _NAMES.get(s) or _NAMES.get(_LEAD.sub("", s))


_NUMBER = r"\d[\d,'    ]*(?:\.\d+)?(?:[eE][-+]?\d+)?"
_FACTORS = [
    (re.compile(rf"\bdivide(?:d)?\s+(?:it\s+|them\s+)?by\s+({_NUMBER})", re.I), -1),
    (re.compile(rf"\bmultipl(?:y|ied)\s+(?:it\s+|them\s+)?by\s+({_NUMBER})", re.I), 1),
    (re.compile(rf"=\s*source value\s*[/÷]\s*({_NUMBER})", re.I), -1),
    (re.compile(rf"=\s*source value\s*[x×*]\s*({_NUMBER})", re.I), 1),
    (re.compile(rf"({_NUMBER})\s*source units? (?:make|makes|are|is|equals?) (?:one|1|a) registry unit", re.I), -1),
    (re.compile(rf"(?:one|1|a) source unit (?:is|makes|equals?) ({_NUMBER})\s*registry units?", re.I), 1),
    (re.compile(rf"\bneeds?\s*[÷/]\s*({_NUMBER})", re.I), -1),
    (re.compile(rf"\bneeds?\s*[×x*]\s*({_NUMBER})", re.I), 1),
    (re.compile(rf"\bscaled? down by (?:a factor of )?({_NUMBER})", re.I), -1),
    (re.compile(rf"\bscaled? up by (?:a factor of )?({_NUMBER})", re.I), 1),
]
_SPELLINGS = "|".join(re.escape(n).replace(r"\ ", r"[\s_-]+") for n in sorted(_NAMES, key=len, reverse=True))
#: A unit after a word that introduces one and before the end of the statement; never after a number.
_STATED = re.compile(
    rf"(?:\b(?:in|as|are|is|carry|carries|use|uses|unit|units)|[:=,])\s+((?:(?:a|an|the|plain|whole|single)\s+)*(?:{_SPELLINGS}|a\s+0[-–]1\s+fraction|0[-–]100\s+percentage))(?:\s*\([^)]*\))?"
    r"(?=\s*(?:$|[.;,]|and\b|in the\b|per\b|throughout\b|;))",
    re.I,
)


def number_of(text: str) -> float:
    return float(re.sub(r"[,'    ]", "", text))


def note_statement(note: str | None, quantity: str | None = None) -> tuple[str, float] | None:
    """What a note says about scale: ('factor', factor to the definition's unit), ('unit', millionths) or None.

    A number that belongs to something else (a batch size, a time limit, a price cap) says
    nothing.  A unit of another quantity than ``quantity`` says nothing.
    """
    if not note:
        return None
    text = unicodedata.normalize("NFKC", note).replace("μ", "u")
    for pattern, sign in _FACTORS:
        found = pattern.search(text)
        if found:
            size = number_of(found.group(1))
            if size > 0:
                return "factor", size**sign
    for found in _STATED.finditer(text):
        unit = unit_of(found.group(1))
        if unit and (quantity is None or unit[0] == quantity):
            return "unit", unit[1]
    return None


_UNIT_KEYS = ("unit", "units", "uom", "unitofmeasure", "measureunit", "scale")
_FIGURE_KEYS = ("value", "figure", "reported", "raw", "asprinted", "printed", "score", "text")
_PRINTED = re.compile(rf"^([^\d]*?)([-+]?{_NUMBER})\s*(.*)$", re.S)


def printed_figure(text: str, quantity: str | None = None) -> tuple[float, float | None] | None:
    """(figure, millionths or None) of a printed figure such as ``about 1,204.5 ms``; None if it is none."""
    found = _PRINTED.match(text.strip())
    if not found:
        return None
    before, digits, after = found.groups()
    unit = unit_of(after) or unit_of(before)
    if unit is None and after.strip(" .") and not before.strip(" ~≈"):
        return None
    if unit is not None and quantity is not None and unit[0] != quantity:
        return None
    return number_of(digits.rstrip(" ,'")) * (-1 if digits.startswith("-") else 1) if digits[0] not in "+-" else float(re.sub(r"[,' ]", "", digits)), unit[1] if unit else None


def json_statement(text: str | None, quantity: str | None = None) -> tuple[float | None, float | None]:
    """(figure, millionths): the figure and the unit that a fact's value_json states, None where it states none.

    Confidence limits, page numbers and counts are neither.  Text that is no JSON object states nothing.
    """
    if not text or len(text) < 7 or text.lstrip()[:1] not in "{[":
        return None, None
    try:
        todo = [("", json.loads(text))]
    except ValueError:
        return None, None
    figure = size = None
    while todo:
        key, node = todo.pop(0)
        if isinstance(node, dict):
            todo.extend((re.sub(r"[^a-z]", "", str(k).lower()), v) for k, v in node.items())
        elif isinstance(node, list):
            todo.extend((key, v) for v in node)
        elif isinstance(node, str):
            if key in _UNIT_KEYS:
                unit = unit_of(node)
                if unit and (quantity is None or unit[0] == quantity):
                    size = unit[1]
            else:
                printed = printed_figure(node, quantity)
                if printed and figure is None and (printed[1] is not None or key in _FIGURE_KEYS):
                    figure = printed[0]
                    size = size if printed[1] is None else printed[1]
        elif isinstance(node, (int, float)) and not isinstance(node, bool) and key in _FIGURE_KEYS and figure is None:
            figure = float(node)
    return figure, size
