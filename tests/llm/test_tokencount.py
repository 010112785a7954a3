import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.llm import tokencount as K

PATH = public_tokenizers.path("piece_bpe_32k.model")
SP = sentencepiece.SentencePieceProcessor(model_file=PATH)


def by_units(text):
    return sum(len(x) - 2 for x in SP.encode(["\n" + u for u in K.pre_tokens(text)]))


@settings(max_examples=300, deadline=None)
@given(st.text(max_size=60) | st.text(st.sampled_from(" ▁\n\r\t.,;)(<>/sab1é²_\x00�"), max_size=40))
def test_sums_are_the_library(text):
    assert "".join(K.pre_tokens(text)) == (" " + text if text else "")
    assert by_units(text) == len(SP.encode(text))


def test_given_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in K.op2_token_counts(spark, sf).collect()}
    want = {r.doc_id: (len(r.text.encode()), n := len(SP.encode(r.text)), n > 4096) for r in docs}
    assert got == want


@pytest.mark.parametrize("head", [1 << 20, 20])
def test_odd_rows(spark, monkeypatch, head):
    monkeypatch.setattr(K, "HEAD", head)
    texts = [None, "", " ", "\n", "<s> </s> <unk> <pad>", "a b a b a", "x" * 20000, "the " * 9000, "the same", "the same"]
    rows = [(i, t) for i, t in enumerate(texts)] + [(1, "again"), (None, "no id")]
    df = spark.createDataFrame([(*r, 7, "u") for r in rows], "doc_id long, text string, n_tokens int, unit string").repartition(3)
    got = sorted(((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in K.count_tokens(df, PATH).collect()), key=str)
    want = sorted(((i, len((t or "").encode()), n := len(SP.encode(t or "")), n > 4096) for i, t in rows), key=str)
    assert got == want
    assert K.count_tokens(df.limit(0), PATH).count() == 0


def test_vocabulary_that_reaches_across_is_refused(monkeypatch):
    import re
    monkeypatch.setattr(K, "UNIT", re.compile(r"\w"))
    with pytest.raises(ValueError):
        K.pieces_model(PATH)
