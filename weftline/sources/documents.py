"""Documents to blocks of text: plain text and Markdown, slides (PPTX), and PDF with its text layer."""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCKS = "path string, page int, block int, kind string, text string, x double, y double, width double, height double"
_LIST = re.compile(r"^\s*(?:[-*+]|\d+[.)])\s+")


def text_blocks(raw: str) -> list[tuple]:
    """(page, kind, text, box) of the paragraphs of a text; kinds: heading, list, code, table, text; form feeds end pages."""
    out = []
    for page, content in enumerate(raw.replace("\r\n", "\n").replace("\r", "\n").split("\f"), 1):
        pieces, code = [], None
        for line in [*content.split("\n"), ""]:
            if line.lstrip().startswith("```"):
                if code is None:
                    code = []
                else:
                    pieces.append(("code", code))
                    code = None
            elif code is not None:
                code.append(line)
            elif not line.strip():
                pieces.append((None, []))
            else:
                kind = "heading" if line.startswith("#") else "list" if _LIST.match(line) else "table" if line.lstrip().startswith("|") else "text"
                if kind != "heading" and pieces and pieces[-1][0] == kind:
                    pieces[-1][1].append(line)
                else:
                    pieces.append((kind, [line]))
        if code:
            pieces.append(("code", code))
        out += [(page, kind, "\n".join(lines).strip("\n"), None) for kind, lines in pieces if kind and lines]
    return out


def slide_blocks(raw: bytes) -> list[tuple]:
    """(slide, kind, text, box in points) of the shapes of a slide deck; titles are headings."""
    a, p = "{http://schemas.openxmlformats.org/drawingml/2006/main}", "{http://schemas.openxmlformats.org/presentationml/2006/main}"
    out = []
    with zipfile.ZipFile(io.BytesIO(raw)) as deck:
        names = sorted((int(m[1]), n) for n in deck.namelist() if (m := re.fullmatch(r"ppt/slides/slide(\d+)\.xml", n)))
        for number, name in names:
            for shape in ElementTree.fromstring(deck.read(name)).iter(f"{p}sp"):
                text = "\n".join("".join(t.text or "" for t in para.iter(f"{a}t")) for para in shape.iter(f"{a}p")).strip()
                if not text:
                    continue
                at, size, role = shape.find(f".//{a}off"), shape.find(f".//{a}ext"), shape.find(f".//{p}ph")
                box = None if at is None or size is None else tuple(int(v) / 12700 for v in (at.get("x"), at.get("y"), size.get("cx"), size.get("cy")))
                out.append((number, "heading" if role is not None and "itle" in (role.get("type") or "") else "text", text, box))
    return out


_STREAM = re.compile(rb"(\d+)\s+\d+\s+obj\s*(<<.*?>>)\s*stream\r?\n(.*?)\r?\nendstream", re.S)
_TEXT_OPS = re.compile(rb"\((?:\\.|[^\\()])*\)|\[(?:\((?:\\.|[^\\()])*\)|[^\]])*\]|<[0-9A-Fa-f\s]*>|[-+.\d]+|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


def _pdf_string(token: bytes) -> str:
    if token[:1] == b"<":
        return bytes.fromhex(re.sub(rb"\s", b"", token[1:-1]).decode() + ("0" if len(re.sub(rb"\s", b"", token)) % 2 else "")).decode("latin-1")
    plain = re.sub(rb"\\(\d{1,3}|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1].isdigit() else _ESCAPES.get(m[1], m[1]), token[1:-1], flags=re.S)
    return plain.decode("latin-1")


def pdf_blocks(raw: bytes) -> list[tuple]:
    """(page, kind, text, box) of the text lines of a PDF with simple fonts: one block per text object, at its place on the page.

    Pages are counted by their content streams in order of number; compressed streams are
    opened.  A PDF without a text layer, or encrypted, has no blocks.
    """
    out, page = [], 0
    if b"/Encrypt" in raw:
        return out
    for m in sorted(_STREAM.finditer(raw), key=lambda m: int(m[1])):
        data = m[3]
        if b"FlateDecode" in m[2]:
            try:
                data = zlib.decompress(data)
            except zlib.error:
                continue
        if b"BT" not in data or b"Tj" not in data and b"TJ" not in data:
            continue
        page += 1
        for body in re.findall(rb"\bBT\b(.*?)\bET\b", data, re.S):
            stack, text, x, y, size, place = [], [], 0.0, 0.0, 0.0, None
            for token in _TEXT_OPS.findall(body):
                if token in (b"Td", b"TD") and len(stack) >= 2:
                    x, y = x + float(stack[-2]), y + float(stack[-1])
                    if text and float(stack[-1]):
                        text.append("\n")
                elif token == b"Tm" and len(stack) >= 6:
                    x, y = float(stack[-2]), float(stack[-1])
                elif token == b"Tf" and stack:
                    size = float(stack[-1])
                elif token == b"T*":
                    text.append("\n")
                elif token in (b"Tj", b"'") and stack:
                    text.append(_pdf_string(stack[-1]))
                    place = place or (x, y)
                elif token == b"TJ" and stack:
                    text.append("".join(_pdf_string(t) for t in re.findall(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>", stack[-1], re.S)))
                    place = place or (x, y)
                else:
                    stack.append(token)
                    continue
                stack = []
            found = "".join(text).strip()
            if found and place:
                out.append((page, "text", found, (*place, size * 0.5 * max(map(len, found.split("\n"))), size * len(found.split("\n")))))
    return out


def blocks_of(raw: bytes | None) -> list[tuple]:
    """Blocks of a document by what its first bytes are; one that can't be read has a single block of kind 'unreadable'."""
    if not raw:
        return []
    try:
        if raw[:4] == b"%PDF":
            return pdf_blocks(raw)
        if raw[:4] == b"PK\x03\x04":
            return slide_blocks(raw)
        return text_blocks(raw.decode("utf-8", "replace"))
    except Exception as error:
        return [(0, "unreadable", type(error).__name__, None)]


def parse(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """path, page, block, kind, text, x, y, width, height: the blocks of documents (content: binary, or text).  Null and empty ones have none."""

    def run(batches):
        for batch in batches:
            rows = []
            for name, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                rows += [(name, page, i, kind, text, *(box or (None,) * 4)) for i, (page, kind, text, box) in enumerate(blocks_of(raw))]
            yield pa.RecordBatch.from_pylist([dict(zip(_NAMES, r)) for r in rows], schema=_SCHEMA)

    return df.select(F.col(path).cast("string"), F.col(content).cast("binary")).mapInArrow(run, BLOCKS)


_NAMES = ("path", "page", "block", "kind", "text", "x", "y", "width", "height")
_SCHEMA = pa.schema([("path", pa.string()), ("page", pa.int32()), ("block", pa.int32()), ("kind", pa.string()), ("text", pa.string()), *[(c, pa.float64()) for c in _NAMES[5:]]])
