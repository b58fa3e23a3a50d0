"""Texts as the words a reader sees: one normal form for case, punctuation, markup, accents and encodings."""

from __future__ import annotations

import html
import re
import unicodedata

# fixed values: Cyrillic and Greek letters that look like Latin ones, and letters that don't decompose
_ALIKE = {
    "\u0430": "a", "\u0432": "b", "\u0435": "e", "\u0451": "e", "\u043a": "k", "\u043c": "m", "\u043d": "h", "\u043e": "o", "\u0440": "p", "\u0441": "c", "\u0442": "t",
    "\u0443": "y", "\u0445": "x", "\u0455": "s", "\u0456": "i", "\u0458": "j", "\u0501": "d", "\u04bb": "h", "\u04cf": "l",
    "\u03b1": "a", "\u03b2": "b", "\u03b5": "e", "\u03b9": "i", "\u03ba": "k", "\u03bd": "v", "\u03bf": "o", "\u03c1": "p", "\u03c4": "t", "\u03c5": "u", "\u03c7": "x",
    "\u00f8": "o", "\u0142": "l", "\u0111": "d", "\u00f0": "d", "\u0127": "h", "\u0131": "i", "\u0153": "oe", "\u00e6": "ae", "\u00fe": "th", "\u00df": "ss",
}
_ALIKE_TABLE = str.maketrans(_ALIKE)
_CP1252 = "€‚ƒ„…†‡ˆ‰Š‹ŒŽ‘’“”•–—˜™š›œžŸ"
_BROKEN = re.compile(rf"[\u00c2-\u00f4][\u0080-\u00bf{_CP1252}]{{1,3}}")
_INVISIBLE = re.compile("[\\u00ad\\u034f\\u061c\\u180e\\u200b-\\u200f\\u202a-\\u202e\\u2060-\\u2064\\ufe00-\\ufe0f\\ufeff]")
_TAG = re.compile(r"</?[A-Za-z][^<>]{0,200}>|<!--.{0,400}?-->", re.S)
_LINK = re.compile(r"\]\([^()\s]{0,400}\)")
_ESCAPED = re.compile(r"\\u([0-9a-fA-F]{4})")
_WRAPPED = re.compile(r"(?<=[^\W\d_])[-\u2010\u2011][ \t]*\r?\n[>\s|#*]*(?=[^\W\d_])")
_GLUED = re.compile(r"(?<=\w)['\u2019\u2018`*_~]+(?=\w)")
_THOUSANDS = re.compile(r"(?<=\d)[,\u2019'](?=\d{3}(?!\d))")
_ASCII_WORD = re.compile(r"[a-z0-9]+")
_WORD = re.compile(r"[^\W_]+")


def _mend(match: re.Match) -> str:
    """UTF-8 that was read as Windows-1252 or Latin-1, read again; as it was if that fails."""
    raw = bytearray()
    for ch in match.group():
        try:
            raw += ch.encode("cp1252")
        except UnicodeEncodeError:
            raw += bytes([ord(ch)]) if ord(ch) < 256 else b"?"
    for size in range(len(raw), 1, -1):
        try:
            return raw[:size].decode("utf-8") + match.group()[size:]
        except UnicodeDecodeError:
            continue
    return match.group()


def clean(text: str | None) -> str:
    """The text in lower case without accents, markup, entities, escapes and invisible characters.

    Look-alike letters, wrongly decoded UTF-8 and words wrapped with a hyphen are mended;
    punctuation and line ends stay.  "" for None.
    """
    if not text:
        return ""
    if "<" in text:
        text = _TAG.sub(" ", text)
    if "&" in text:
        text = html.unescape(text)
    if "\\" in text:
        text = _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text)
        text = text.replace("\\n", "\n").replace("\\r", "\r").replace("\\t", "\t").replace("\\", "")
    if "](" in text:
        text = _LINK.sub("] ", text)
    plain = text.isascii()
    if not plain:
        if _BROKEN.search(text):
            text = _BROKEN.sub(_mend, text)
        text = _INVISIBLE.sub("", text)
    if "\n" in text:
        text = _WRAPPED.sub("", text)
    if not plain:
        text = unicodedata.normalize("NFKD", text)
        if not text.isascii():
            text = "".join([c for c in text if not unicodedata.combining(c)])
    text = _THOUSANDS.sub("", _GLUED.sub("", text))
    return text.lower() if text.isascii() else text.casefold().translate(_ALIKE_TABLE)


def words(text: str | None) -> list[str]:
    """The normal words of a text, in order; [] for None and blank.

    Differences of writing that ``clean`` removes, and punctuation, make no difference.  A
    hyphen within a line separates words.
    """
    text = clean(text)
    return _ASCII_WORD.findall(text) if text.isascii() else _WORD.findall(text)
