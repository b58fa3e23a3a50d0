"""Personal data in text, found by the public formats of its kinds.

A text is cut once into words with their places.  Each finder goes over the words (or over
the text) and proposes spans of its kind; where spans of several finders overlap, the kind
with the stronger proof stands: a checksum before a fixed shape before a cue in words before
a shape that other numbers may have too.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable
from dataclasses import dataclass

Span = tuple[int, int]
_WORD = re.compile(r"[^\W_]+")
#: Atoms of mail addresses joined by dots (RFC 5322), and host labels (RFC 1123).
_ATOM = r"[0-9A-Za-z!#$%&'*+/=?^_`{|}~-]+"
_LABEL = r"[0-9A-Za-z](?:[0-9A-Za-z-]*[0-9A-Za-z])?"
_MAIL = re.compile(rf"(?<![\w.@]){_ATOM}(?:\.{_ATOM})*@(?:{_LABEL}\.)+[A-Za-z]{{2,63}}(?![\w@])")
#: Digits in groups, as people write numbers: one separator between groups, brackets about one group.
_NUMBER = re.compile(r"(?<![\w.,-])\+?(?:\(\d+\)|\d+)(?:[ ./-]?(?:\(\d+\)|\d+))*(?![\w])")

# fixed values: words of the finders
_DIGIT_WORDS = {"zero": "0", "oh": "0", "nought": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_REPEAT_WORDS = {"double": 2, "triple": 3, "treble": 3}
_ID_CUES = (("social", "security"), ("ssn",), ("national", "insurance"), ("nino",), ("passport",), ("driving", "licence"), ("driver", "license"), ("drivers", "license"), ("drivers", "licence"), ("tax", "file"), ("medicare",), ("nhs",), ("national", "id"))
_ID_FILLERS = ("number", "card", "no", "is", "id")
_BIRTH_CUES = (("date", "of", "birth"), ("dob",), ("born", "on"), ("born",), ("birthday",))
_MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
_STREETS = frozenset("avenue ave boulevard blvd close court ct crescent drive dr lane ln place pl road rd square sq street st terrace way".split())


def luhn_ok(digits: str) -> bool:
    """The checksum of card numbers (ISO 7812) of 12 to 19 digits."""
    if not (digits.isdigit() and 12 <= len(digits) <= 19):
        return False
    doubled = [int(d) for d in reversed(digits)]
    return sum(d if i % 2 == 0 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(doubled)) % 10 == 0


def iban_ok(text: str) -> bool:
    """The mod-97 check of bank account numbers (ISO 13616)."""
    s = re.sub(r"[\s-]", "", text).upper()
    return bool(re.fullmatch(r"[A-Z]{2}\d{2}[A-Z0-9]{10,30}", s)) and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


@dataclass(frozen=True)
class Text:
    """A text, its words in lower case, and where they stand."""

    raw: str
    words: list[str]
    spans: list[Span]

    @classmethod
    def of(cls, raw: str) -> Text:
        found = [(m.group().lower(), m.span()) for m in _WORD.finditer(raw)]
        return cls(raw, [w for w, _ in found], [s for _, s in found])

    def gap(self, i: int) -> str:
        """What stands between word i and the next."""
        return self.raw[self.spans[i][1] : self.spans[i + 1][0]] if i + 1 < len(self.spans) else "\n"

    def after(self, cues: tuple[tuple[str, ...], ...]) -> Iterable[int]:
        """The number of the word after each place where one of the cues stands; the longest cue counts."""
        first: dict[str, list] = {}
        for cue in sorted(cues, key=len, reverse=True):
            first.setdefault(cue[0], []).append(cue)
        for i, word in enumerate(self.words):
            for cue in first.get(word, ()):
                if tuple(self.words[i : i + len(cue)]) == cue:
                    yield i + len(cue)
                    break


def mail_addresses(t: Text) -> Iterable[Span]:
    return (m.span() for m in _MAIL.finditer(t.raw)) if "@" in t.raw else ()


def spoken_mail_addresses(t: Text) -> Iterable[Span]:
    """``ann dot lee at example dot org``: the words of a name joined by dot, underscore or hyphen, at, labels joined by dot."""
    joins = ("dot", "underscore", "hyphen", "dash")
    for i, word in enumerate(t.words):
        if word != "at" or not 0 < i < len(t.words) - 3 or t.words[i + 2] != "dot":
            continue
        a = i - 1
        while a >= 2 and t.words[a - 1] in joins:
            a -= 2
        b = i + 1
        while b + 2 < len(t.words) and t.words[b + 1] == "dot":
            b += 2
        if all(t.gap(k).isspace() for k in range(a, b)):
            yield t.spans[a][0], t.spans[b][1]


def bank_accounts(t: Text) -> Iterable[Span]:
    """Two letters, two digits, ten to thirty further signs in groups: the longest run of words that passes the check."""
    for i, word in enumerate(t.words):
        if not (len(word) >= 4 and word[:2].isalpha() and word[:2].isascii() and word[2:4].isdigit()):
            continue
        ends, size = [], len(word)
        for j in range(i, len(t.words)):
            if j > i:
                if t.gap(j - 1) not in (" ", "-") or not t.words[j].isascii():
                    break
                size += len(t.words[j])
            if size > 34:
                break
            ends.append(t.spans[j][1])
        start = t.spans[i][0]
        yield from ((start, end) for end in reversed(ends[:]) if iban_ok(t.raw[start:end]))


def _numbers(t: Text) -> Iterable[tuple[int, int, str, list[str]]]:
    """(start, end, digits, groups) of numbers as written."""
    for m in _NUMBER.finditer(t.raw):
        groups = re.findall(r"\d+", m.group())
        yield m.start(), m.end(), "".join(groups), groups


def card_numbers(t: Text) -> Iterable[Span]:
    return ((a, b) for a, b, digits, _ in _numbers(t) if 13 <= len(digits) <= 19 and luhn_ok(digits) and t.raw[a] != "+")


def _security_number(groups: list[str]) -> bool:
    """3-2-4 digits, none of the groups zero, the first neither 666 nor from 900 on."""
    return [len(g) for g in groups] == [3, 2, 4] and groups[0] not in ("000", "666") and groups[0] < "900" and int(groups[1]) > 0 and int(groups[2]) > 0


def security_numbers(t: Text) -> Iterable[Span]:
    return ((a, b) for a, b, _, groups in _numbers(t) if _security_number(groups) and t.raw[a : b].isascii() and "." not in t.raw[a:b] and "/" not in t.raw[a:b])


def insurance_numbers(t: Text) -> Iterable[Span]:
    """Two letters (not all are given out), six digits, a letter from A to D; in pairs or in one."""
    for m in re.finditer(r"(?<!\w)([A-Za-z]{2})((?: ?\d\d){3}) ?([A-Da-d])(?!\w)", t.raw):
        prefix = m[1].upper()
        if not set(prefix) & set("DFIQUV") and prefix[1] != "O" and prefix not in ("BG", "GB", "KN", "NK", "NT", "TN", "ZZ"):
            yield m.span()


def cued_ids(t: Text) -> Iterable[Span]:
    """After words such as passport or national insurance number: a word of five signs or more that holds a digit."""
    for i in t.after(_ID_CUES):
        while i < len(t.words) and t.words[i] in _ID_FILLERS:
            i += 1
        end = i
        while end < len(t.words) and end - i < 4 and (end == i or t.gap(end - 1) in ("-", "")):
            end += 1
        if i < len(t.words) and (start := t.spans[i][0]) is not None:
            found = t.raw[start : t.spans[end - 1][1]]
            if len(found) >= 5 and any(c.isdigit() for c in found):
                yield start, start + len(found)


def phone_numbers(t: Text) -> Iterable[Span]:
    """International numbers (E.164), national ones with a leading zero, and three-three-four digits."""
    for a, b, digits, groups in _numbers(t):
        if t.raw[a] == "+":
            good = 8 <= len(digits) <= 15
        elif digits[0] == "0":
            good = 10 <= len(digits) <= 11 and len(groups[-1]) >= 3
        else:
            good = [len(g) for g in groups] == [3, 3, 4]
        if good and "/" not in t.raw[a:b]:
            yield a, b


def birth_dates(t: Text) -> Iterable[Span]:
    """After words such as born: a date in figures, or a day, a month and a year in either order."""
    for i in t.after(_BIRTH_CUES):
        while i < len(t.words) and t.words[i] in ("is", "was", "on"):
            i += 1
        three = t.words[i : i + 3]
        if len(three) < 3 or any("\n" in t.gap(k) for k in (i, i + 1)):
            continue
        figures = all(w.isdigit() for w in three) and all(t.gap(k) in ("-", "/", ".") for k in (i, i + 1))
        day = lambda w: re.fullmatch(r"\d{1,2}(?:st|nd|rd|th)?", w) is not None
        month = lambda w: len(w) > 2 and any(m.startswith(w) for m in _MONTHS)
        year = len(three[2]) == 4 and three[2].isdigit()
        if (figures and sorted(map(len, three))[-1] in (2, 4)) or (year and ((day(three[0]) and month(three[1])) or (month(three[0]) and day(three[1])))):
            yield t.spans[i][0], t.spans[i + 2][1]


def street_addresses(t: Text) -> Iterable[Span]:
    """A house number, one to four words, a word for a street; or a post office box."""
    for i, word in enumerate(t.words):
        if re.fullmatch(r"\d{1,5}[a-z]?", word):
            for j in range(i + 1, min(i + 6, len(t.words))):
                if not set(t.gap(j - 1)) <= set(" .'-") or not t.gap(j - 1):
                    break
                if t.words[j] in _STREETS and j > i + 1:
                    yield t.spans[i][0], t.spans[j][1]
                    break
        elif word == "box" and i + 1 < len(t.words) and t.words[i + 1].isdigit():
            before = "".join(t.words[max(0, i - 2) : i])
            if before.endswith("po"):
                yield t.spans[i - (1 if t.words[i - 1] == "po" else 2)][0], t.spans[i + 1][1]


def _spoken(t: Text) -> Iterable[tuple[int, int, str]]:
    """(start, end, digits) of runs of seven digits or more that are spelled out, with ``double`` and ``triple``."""
    i, n = 0, len(t.words)
    while i < n:
        digits, at, last = "", i, i
        while at < n:
            word, times = t.words[at], 1
            if word in _REPEAT_WORDS and at + 1 < n:
                times, at, word = _REPEAT_WORDS[word], at + 1, t.words[at + 1]
            if word not in _DIGIT_WORDS or (digits and not set(t.raw[t.spans[last][1] : t.spans[at][0]]) <= set(" ,-\t")) and times == 1:
                break
            digits += _DIGIT_WORDS[word] * times
            last, at = at, at + 1
        if len(digits) >= 7:
            yield t.spans[i][0], t.spans[last][1], digits
            i = last + 1
        else:
            i += 1


def spoken_cards(t: Text) -> Iterable[Span]:
    return ((a, b) for a, b, digits in _spoken(t) if 13 <= len(digits) <= 19 and luhn_ok(digits))


def spoken_ids(t: Text) -> Iterable[Span]:
    return ((a, b) for a, b, digits in _spoken(t) if len(digits) == 9)


def spoken_phones(t: Text) -> Iterable[Span]:
    return ((a, b) for a, b, digits in _spoken(t) if len(digits) in (7, 8, 10, 11, 12))


#: Kinds and finders, stronger proof first.
FINDERS: tuple[tuple[str, Callable[[Text], Iterable[Span]]], ...] = (
    ("IBAN", bank_accounts), ("CREDIT_CARD", card_numbers), ("CREDIT_CARD", spoken_cards), ("EMAIL", mail_addresses), ("EMAIL", spoken_mail_addresses), ("NATIONAL_ID", security_numbers),
    ("NATIONAL_ID", insurance_numbers), ("DATE_OF_BIRTH", birth_dates), ("NATIONAL_ID", cued_ids), ("STREET_ADDRESS", street_addresses), ("PHONE", phone_numbers), ("NATIONAL_ID", spoken_ids), ("PHONE", spoken_phones),
)


def found_in(raw: str | None, extra: tuple = ()) -> list[tuple[int, int, str]]:
    """(start, end, kind) of personal data, in order of place, without overlaps.

    Of overlapping spans the one of the stronger finder stands, then the earlier, then the
    longer.  extra: further (kind, finder) pairs; a finder takes a ``Text`` and gives spans.
    They come before the others.
    """
    if not raw:
        return []
    text = Text.of(raw)
    proposed = sorted((rank, a, -b, kind) for rank, (kind, find) in enumerate((*extra, *FINDERS)) for a, b in find(text))
    taken: list[tuple[int, int, str]] = []
    for _, a, b, kind in proposed:
        if all(-b <= x or a >= y for x, y, _ in taken):
            taken.append((a, -b, kind))
    return sorted(taken)
