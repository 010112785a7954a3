import hashlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from sheafline.llm import bpe as B

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
MINE = B.WordBpe(PATH)


def same(text):
    want = LIBRARY.encode(text, add_special_tokens=False).ids
    got = MINE.encode_batch([text])[0]
    assert np.frombuffer(got, "<u4").tolist() == want
    assert MINE.decode(got) == LIBRARY.decode(want, skip_special_tokens=False)


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from("aaabAB lst'<|>\n\x1c\x85 é́Σσ²5."), max_size=40))
def test_is_the_library(text):
    same(text)


@pytest.mark.parametrize("text", ["", " ", "aaaa aaaaa hahahahaha", "x<|endoftext|>y <|startoftext|><|endoftext|>", "<|EndOfText|> <|endoftext", "İSTANBUL ΑΣ ΑΣ.", "it's I'LL don't 'S", "日本語 テキスト 👩‍👩‍👧 ֋՘ ⅷ", "z" * 20000, "é" * 50, "a b​c d"])
def test_odd_texts(text):
    same(text)


def test_given_documents(spark, sf):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = B.op8_bpe_round(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        ids = LIBRARY.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 3)
    df = spark.createDataFrame([(1, None, "a"), (1, "", "b"), (None, "one two", "c"), (2, "one two", "d"), (2, "one two", "d")], "doc_id long, text string, ids string")
    rows = sorted(((r.doc_id or 0), len(r.ids), r.decoded) for r in B.bpe_round(df, PATH).collect())
    assert rows == [(0, 8, "one</w> two</w>"), (1, 0, ""), (1, 0, ""), (2, 8, "one</w> two</w>"), (2, 8, "one</w> two</w>")]
    assert B.bpe_round(df.limit(0), PATH).count() == 0


def test_forgets(monkeypatch):
    monkeypatch.setattr(B, "REMEMBERED", 2)
    for text in ["a b c", "d e a", "a"]:
        same(text)


def test_known_words_take_no_room_again(monkeypatch):
    """Words that a task knows are split once, also when known and asked ones together exceed the room."""
    monkeypatch.setattr(B, "REMEMBERED", 3)
    coder, asked = B.WordBpe(PATH), []
    split = coder.pre_tokens
    monkeypatch.setattr(coder, "pre_tokens", lambda w: asked.append(w) or split(w))
    first = coder.encode_batch(["one two"])
    assert coder.encode_batch(["one two"]) == first and sorted(asked) == ["one", "two"]
    assert coder.encode_batch(["three four one"])[0][-4:] == coder.encode_batch(["one"])[0] and len(coder.known) == 3
