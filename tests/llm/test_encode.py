import os

import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st

from lodestock.llm import encode as e

pytestmark = pytest.mark.skipif(not os.path.exists(e.VOCABULARY), reason="no vocabulary file")
TEXTS = ["", " ", "Hello, world!", "it's they'LL we've", "<|endoftext|> [INST] </s>", "a\r\n\t b   \n\n", "日本語のテキスト", "👨‍👩‍👧 ❤️", "\u0000﻿­", "éé", "x" * 3000, "ab" * 5000, " " * 2000 + "\n" * 500, "0123456789" * 30, "&amp;<br/>[b]x[/b]"]


@pytest.fixture(scope="module")
def encoder():
    return e.Encoder(e.parse(open(e.VOCABULARY, "rb").read()))


@pytest.fixture(scope="module")
def public():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=e.PATTERN, mergeable_ranks=e.parse(open(e.VOCABULARY, "rb").read()), special_tokens={})


@pytest.mark.parametrize("text", TEXTS)
def test_ids_equal_the_public_encoder(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text


@settings(max_examples=200, deadline=None)
@given(st.text(st.characters(exclude_categories=["Cs"]), max_size=60))
def test_any_text(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)
    assert encoder.decode(encoder.encode(text)) == text


@settings(max_examples=500, deadline=None)
@given(st.text(" \n\t\r\u00a0\u3000a1',\0é", max_size=14))
def test_white_space_around_parts(encoder, public, text):
    assert encoder.encode(text) == public.encode_ordinary(text)


def test_forgetting_changes_nothing(public, monkeypatch):
    monkeypatch.setattr(e, "REMEMBERED", 2)
    small = e.Encoder(e.parse(open(e.VOCABULARY, "rb").read()))
    for text in [*TEXTS, "one two three, one two three!", "x" * 100 + " " + "y" * 100]:
        assert small.encode(text) == public.encode_ordinary(text)
        assert len(small) <= 2


def test_queue_equals_rescanning(encoder):
    """Against the plain rule: merge the leftmost pair of least rank until there is none."""
    for piece in [b"abababab", b"aaaaaaa", " running".encode(), "Straße".encode(), bytes(range(200))]:
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while True:
            ranked = [(encoder.ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in encoder.ranks]
            if not ranked:
                break
            i = min(ranked)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert encoder.merge(piece) == [encoder.ranks[p] for p in parts]


def test_pattern_splits_without_loss():
    for text in TEXTS:
        assert "".join(regex.findall(e.PATTERN, text)) == text


def test_memory_is_bounded(encoder, monkeypatch):
    monkeypatch.setattr(e, "REMEMBERED", 3)
    own = e.Encoder(encoder.ranks)
    assert own.encode("a b c d e f g h") == encoder.encode("a b c d e f g h") and len(own) <= 3


def test_frames(spark, encoder, monkeypatch):
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate([*TEXTS, None, TEXTS[2]])], "doc_id bigint, text string, other string")
    got = {r["doc_id"]: r["ids"] for r in e.encode(df, "text").collect()}
    assert got == {i: encoder.encode(t) for i, t in enumerate([*TEXTS, None, TEXTS[2]])}
    assert got[len(TEXTS)] == []
    back = e.decode(e.encode(df, "text"), "ids")
    assert back.columns == ["doc_id", "other", "text"]
    assert {r["doc_id"]: r["text"] for r in back.collect()} == {i: t or "" for i, t in enumerate([*TEXTS, None, TEXTS[2]])}
    assert e.encode(df.where("false"), "text").count() == 0
    monkeypatch.setattr(e, "BROADCAST_BYTES", 1)
    assert {r["doc_id"]: r["ids"] for r in e.encode(df, "text").collect()} == got
    odd = e.encode(df.toDF("ids", "text", "TEXT"), "text")
    assert odd.columns == ["TEXT", "ids"] and odd.count() == len(got)
    assert e.encode(df, "text", "other").columns == ["doc_id", "other"]
