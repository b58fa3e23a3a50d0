"""Encoding of texts with a public byte-level BPE vocabulary, by prefix dynamic programming.

For every byte prefix of a piece exactly one token can be the last one of a valid encoding.
``PrefixEncoder.prefix_tokens`` stores that token for each prefix; the encoding is read off
backwards.  A token may follow another only if no merge would cross their boundary, which is
decided from the merge trees alone (``fits``).  As a prefix's entry never changes when bytes
are added, a text can be appended to exactly (``TextState.append``), and an edit re-encodes
only the pieces it touches (``TextState.replace``).

Nothing is trained: the vocabulary file is a parameter.  Strings that look like special
tokens are ordinary text; a null and an empty text both give an empty list.
"""

from __future__ import annotations

import base64
import re
from array import array
from bisect import bisect_right
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabulary files lie; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
VOCABULARY = "byte_bpe_50k.tiktoken"

# fixed values: how the vocabulary's texts are cut into pieces before merging
PIECES = regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: The same for pure ASCII text, in the faster engine.
ASCII_PIECES = re.compile(r"'(?:[sdmt]|ll|ve|re)| ?[A-Za-z]+| ?[0-9]+| ?[^\t-\r A-Za-z0-9]+|[\t-\r ]+(?![^\t-\r ])|[\t-\r ]+")
#: A worker forgets its pieces beyond this many (memory only; results do not change).
CACHE_PIECES = 400_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes -> rank, from a file of lines ``base64 rank``."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


class PrefixEncoder(dict):
    """The encoder of one vocabulary; as a dict it maps a piece to its ids and fills itself."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        import ahocorasick

        self.ranks = ranks
        self.token_bytes = {rank: token for token, rank in ranks.items()}
        self._right: dict[int, tuple] = {}
        self._left: dict[int, tuple] = {}
        self._halves: dict[int, tuple | None] = {}
        self._fits: dict[tuple[int, int], bool] = {}
        self._ends = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._ends.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ends.make_automaton()

    def _split(self, rank: int) -> tuple[int, int] | None:
        """The two tokens whose merge makes this one; None for a single byte."""
        if rank not in self._halves:
            token = self.token_bytes[rank]
            parts = [token[i : i + 1] for i in range(len(token))]
            while len(parts) > 2:
                merged = [self.ranks.get(parts[i] + parts[i + 1], rank) for i in range(len(parts) - 1)]
                at = min(range(len(merged)), key=merged.__getitem__)
                if merged[at] >= rank:
                    break
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
            self._halves[rank] = (self.ranks[parts[0]], self.ranks[parts[1]]) if len(parts) == 2 else None
        return self._halves[rank]

    def _spine(self, rank: int, side: int) -> tuple:
        """(token, when it is used up) for a token and its outermost parts on one side."""
        out, used, at = [], 1 << 60, rank
        while True:
            out.append((self.token_bytes[at], used))
            halves = self._split(at)
            if halves is None:
                return tuple(out)
            used, at = at, halves[side]

    def fits(self, first: int, second: int) -> bool:
        """Whether ``second`` may follow ``first`` within a piece: no merge across the boundary comes first.

        Merges go by rank, equal ranks from the left; a part on the left spine or right spine
        is there until the merge that uses it up.
        """
        key = (first, second)
        known = self._fits.get(key)
        if known is None:
            if first not in self._right:
                self._right[first] = self._spine(first, 1)
            if second not in self._left:
                self._left[second] = self._spine(second, 0)
            known, ranks = True, self.ranks
            for left, left_used in self._right[first]:
                for right, right_used in self._left[second]:
                    merged = ranks.get(left + right)
                    if merged is not None and merged < left_used and merged <= right_used:
                        known = False
                        break
                if not known:
                    break
            if len(self._fits) > 2_000_000:
                self._fits.clear()
            self._fits[key] = known
        return known

    def prefix_tokens(self, piece: bytes, last: list | None = None) -> list:
        """last[i]: the (token, start) that ends the valid encoding of the first i bytes.

        With the table of a prefix of ``piece`` given as ``last``, only the new bytes are worked on.
        """
        done = len(last) - 1 if last else 0
        last = (last or [None]) + [None] * (len(piece) - done)
        fits = self.fits
        longest_reach = max(0, done - 256)
        for end, (token, size) in self._ends.iter(piece[longest_reach:].decode("latin-1")):
            end += 1 + longest_reach
            if end <= done or last[end] is not None:
                continue
            start = end - size
            if start == 0 or (last[start] is not None and fits(last[start][0], token)):
                last[end] = (token, start)
        return last

    def encode_piece(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return [whole]
        last, ids, at = self.prefix_tokens(piece), [], len(piece)
        while at:
            token, at = last[at]
            ids.append(token)
        ids.reverse()
        return ids

    def __missing__(self, piece: str) -> list[int]:
        ids = self.encode_piece(piece.encode("utf-8", "replace"))
        if len(self) > CACHE_PIECES:
            self.clear()
        if len(piece) < 64:
            self[piece] = ids
        return ids

    def pieces(self, text: str) -> list[str]:
        return ASCII_PIECES.findall(text) if text.isascii() and not _RARE_SPACE.search(text) else PIECES.findall(text)

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; [] for None and ''."""
        return list(chain.from_iterable(map(self.__getitem__, self.pieces(text)))) if text else []

    def decode(self, ids) -> bytes:
        return b"".join(self.token_bytes[i] for i in ids)


#: Control characters on which engines differ as to whether they are white space.
_RARE_SPACE = re.compile(r"[\x1c-\x1f]")


class TextState:
    """A text with its pieces, which can be appended to and edited with exact ids.

    A piece's ids depend on the piece alone, and where a piece ends depends on at most the
    piece and the white space after it; so an edit re-cuts from two pieces before it until
    the cuts meet the old ones again.
    """

    def __init__(self, encoder: PrefixEncoder, text: str = ""):
        self.encoder, self.text, self.cuts, self.ids, self.encoded = encoder, "", [0], [], 0
        self.replace(0, 0, text)

    def append(self, text: str) -> None:
        self.replace(len(self.text), len(self.text), text)

    def replace(self, start: int, end: int, new: str) -> None:
        """Replace text[start:end]; ``encoded`` counts the pieces worked on."""
        shift = len(new) - (end - start)
        self.text = self.text[:start] + new + self.text[end:]
        first = max(0, bisect_right(self.cuts, start) - 3)
        old = {cut + shift: i for i, cut in enumerate(self.cuts) if cut > end}
        at, cuts, ids, stop = self.cuts[first], [], [], None
        for match in PIECES.finditer(self.text, at):
            cuts.append(match.end())
            ids.append(self.encoder[match.group()])
            self.encoded += 1
            if match.end() in old and old[match.end()] + 1 < len(self.cuts) and len(cuts) > 2 and match.end() > start + len(new) + 2:
                stop = old[match.end()]
                break
        tail_cuts = [c + shift for c in self.cuts[stop + 1 :]] if stop is not None else []
        tail_ids = self.ids[stop:] if stop is not None else []
        self.cuts = self.cuts[: first + 1] + cuts + tail_cuts
        self.ids = self.ids[:first] + ids + tail_ids

    def token_ids(self) -> list[int]:
        return list(chain.from_iterable(self.ids))


_encoders: dict[tuple, PrefixEncoder] = {}


def encoder_of(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once per process."""
    if path not in _encoders:
        _encoders[path] = PrefixEncoder(read_ranks(path))
    return _encoders[path]


def encode_texts(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary: str = f"{TOKENIZERS}/{VOCABULARY}") -> DataFrame:
    """key, ids: the token ids of every text, one row per row, without a shuffle.

    Whole texts are encoded, however long.  The vocabulary's file must be at the same path
    on every executor.
    """

    def run(batches):
        encoder = encoder_of(vocabulary)
        get, pieces = encoder.__getitem__, encoder.pieces
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                flat, ends = array("i"), [0]
                for value in part.column(1).to_pylist():
                    if value:
                        flat.extend(chain.from_iterable(map(get, pieces(value))))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.asarray(ends, dtype=np.int32)), pa.array(np.frombuffer(flat, dtype=np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), ids], names=[key, "ids"])

    source = df.select(F.col(key), F.col(text).cast("string").alias("_text"))
    kind = source.schema[0].dataType.simpleString()
    return source.mapInArrow(run, f"{key} {kind}, ids array<int>")
