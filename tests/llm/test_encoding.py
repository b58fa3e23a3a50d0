import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from weftline.llm import encoding
from weftline.session import load

PATH = f"{encoding.TOKENIZERS}/{encoding.VOCABULARY}"
pytestmark = pytest.mark.skipif(not os.path.exists(PATH), reason="no vocabulary here")


@pytest.fixture(scope="module")
def encoder():
    return encoding.encoder_of(PATH)


@settings(max_examples=400, deadline=None)
@given(text=st.text(max_size=80) | st.text(alphabet="aAbB '\t\n 0äñ中\x1c ", max_size=120) | st.text(alphabet="ab", max_size=200))
def test_equals_the_public_tokenizer(text):
    encoder, reference = encoding.encoder_of(PATH), _public()
    assert encoder.encode(text) == reference.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text.encode()


_held = {}


def _public():
    if not _held:
        import base64

        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(PATH, "rb"))}
        _held["e"] = tiktoken.Encoding("own", pat_str=r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+", mergeable_ranks=ranks, special_tokens={})
    return _held["e"]


def test_prefix_tables_give_every_prefix(encoder):
    piece = b" internationalisationxyzzyqqkelan"
    last = encoder.prefix_tokens(piece)
    for n in range(1, len(piece) + 1):
        ids, at = [], n
        while at:
            token, at = last[at]
            ids.append(token)
        assert ids[::-1] == _public().encode_ordinary(piece[:n].decode())
    grown = encoder.prefix_tokens(piece[:9])
    assert encoder.prefix_tokens(piece, grown) == last


def test_appends_and_edits_are_exact_and_local(encoder):
    rng = random.Random(3)
    words = ["alpha", " beta", "  ", "\n", "'ll", "9", "--", " Ünïcode", "中文", "'", " ", "s"]
    text = "".join(rng.choice(words) for _ in range(400))
    state = encoding.TextState(encoder, text)
    for _ in range(200):
        a = rng.randrange(len(text) + 1)
        b = min(len(text), a + rng.randrange(6))
        new = "".join(rng.choice(words) for _ in range(rng.randrange(4)))
        if rng.random() < 0.3:
            a = b = len(text)
        before = state.encoded
        text = text[:a] + new + text[b:]
        state.replace(a, b, new)
        assert state.text == text and state.token_ids() == encoder.encode(text)
        assert state.encoded - before < 60


def test_whole_tables_nulls_and_special_strings(spark, sf):
    got = {r["doc_id"]: list(r["ids"]) for r in encoding.encode_texts(load(spark, sf, "documents")).collect()}
    rows = load(spark, sf, "documents").select("doc_id", "text").collect()
    assert got == {r["doc_id"]: _public().encode_ordinary(r["text"] or "") for r in rows}
    df = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (4, "<|endoftext|>"), (5, "ab" * 30_000), (5, "x")], "doc_id bigint, text string")
    out = encoding.encode_texts(df).collect()
    by = {r["doc_id"]: list(r["ids"]) for r in out}
    assert by[1] == by[2] == [] and by[4] == _public().encode_ordinary("<|endoftext|>") and 50256 not in by[4] and len(out) == 6
    assert encoding.encode_texts(df.limit(0)).count() == 0
