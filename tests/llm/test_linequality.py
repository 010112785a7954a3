import re
import zlib
from collections import Counter
from itertools import product

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from sheafline.llm import linequality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain(text):
    text = text or ""
    words = WORD.findall(text)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    covered = {j for i in range(len(words) - 4) if windows[tuple(words[i : i + 5])] > 1 for j in range(i, i + 5)}
    lines = text.split("\n")
    dup = sum(bool(WORD.search(x)) and x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered)


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("ab \n#|\t\x1c\x85é"), max_size=120))
def test_base_numbers(text):
    m = Q.measure(text)
    assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain(text)


@pytest.mark.parametrize("text", [None, "", "\n \n", "a b c d e a b c d e", "x " * 30000, "one\none\none"])
def test_base_numbers_of_odd_texts(text):
    m = Q.measure(text)
    if len(text or "") < 1000:
        assert (m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words) == plain(text)
    else:
        assert m.n_words == m.n_repeat_words == 30000


def score(field, x, y):
    return sum(x[i] @ field.weights[:, y[i]] for i in range(len(y))) + sum(field.moves[a, b] for a, b in zip(y, y[1:], strict=False))


def test_viterbi_and_loss_against_all_labellings():
    rng = np.random.default_rng(4)
    for n in (1, 2, 5):
        field = Q.Field(rng.standard_normal((len(Q.FEATURES), 2)), rng.standard_normal((2, 2)))
        x = rng.standard_normal((n, len(Q.FEATURES)))
        every = list(product((0, 1), repeat=n))
        best = max(every, key=lambda y: score(field, x, y))
        assert tuple(field.viterbi(x)) == best
        y = np.array([rng.integers(0, 2, n)])
        padded, live = np.zeros((1, n + 2, x.shape[1])), np.array([[True] * n + [False] * 2])
        padded[0, :n] = x
        truth = np.concatenate([y, [[0, 0]]], 1)
        loss, g_w, g_m = field.loss(padded, truth, live, np.ones(1))
        want = np.log(sum(np.exp(score(field, x, e)) for e in every)) - score(field, x, y[0])
        assert abs(loss - want) < 1e-9
        for value, g in ((field.weights, g_w), (field.moves, g_m)):
            value[1, 1] += 1e-5
            up = field.loss(padded, truth, live, np.ones(1))[0]
            value[1, 1] -= 1e-5
            assert abs((up - loss) / 1e-5 - g[1, 1]) < 1e-3


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    quality = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    rows = Q.op3_line_quality(spark, sf).collect()
    assert len(rows) == len(texts)
    for r in rows:
        base = plain(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == base
        assert r.base_failed == (base[0] < 10 or 100 * base[4] > 20 * base[0]) and not (r.base_failed and r.kept)
    open_ = [r for r in rows if not r.base_failed and r.doc_id in quality]
    good = [r.kept for r in open_ if quality[r.doc_id] == 1]
    bad = [r.kept for r in open_ if quality[r.doc_id] == 0]
    assert np.mean(good) > 0.98 and np.mean(bad) < 0.3


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 5), (1, "", 5), (None, "a fine line of ten words that goes on and on.", 5), (2, "A fine line.", None)], "doc_id long, text string, kept int")
    out = Q.with_line_quality(df, Q.Field.empty())
    assert out.columns[:2] == ["doc_id", "text"] and out.columns.count("kept") == 1
    assert sorted((r.n_words, r.kept) for r in out.collect()) == [(0, False), (0, False), (3, False), (11, True)]
    assert Q.with_line_quality(df.limit(0), Q.Field.empty()).count() == 0
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert (Q.fit(df, none).weights == Q.Field.empty().weights).all()


def held_out_lines(sf, spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {0: [], 1: []}
    for r in spark.read.parquet(f"{sf}/labels.parquet").collect():
        if zlib.crc32(str(r.doc_id).encode()) % 5 == 0 and r.doc_id in docs:
            lines = [x for x in docs[r.doc_id].split("\n") if x.strip()]
            if len(lines) > 2 or r.quality == 0 and lines:
                out[r.quality].append(lines[:8])
    return out


def test_mixed_documents_line_by_line(spark):
    """Prose between boilerplate is told apart line by line."""
    sf = "/root/testdata/sf0.01"
    field = Q.fit(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet"))
    lines, right, total, switched, n = held_out_lines(sf, spark), 0, 0, 0, 0
    for i, good in enumerate(lines[1][:60]):
        bad = lines[0][i % len(lines[0])]
        bad = (bad * 3)[:4]
        text, want = "\n".join([*bad, *good, *bad]), [1] * len(bad) + [0] * len(good) + [1] * len(bad)
        got = field.viterbi(Q.measure(text).x)
        right, total, n = right + (got == want).sum(), total + len(want), n + 1
        switched += 0 < got.sum() < len(got)
    assert n > 20 and switched >= 0.8 * n and right >= 0.85 * total, (n, switched, right, total)


def test_ties_go_to_content():
    field = Q.Field(np.zeros((len(Q.FEATURES), 2)), np.zeros((2, 2)))
    assert field.viterbi(np.ones((4, len(Q.FEATURES)))).tolist() == [0] * 4


def test_a_repeated_id_is_learned_from_once(spark):
    good, bad = "A fine line of words that goes on.", "buy | now $$$ !!! ###"
    ids = [k for k in range(200) if zlib.crc32(str(k).encode()) % 5]
    docs = spark.createDataFrame([(k, (good if k % 2 else bad) + f" {k}") for k in ids] + [(ids[0], "x" * 10 + f" {k}") for k in range(500)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in ids], "doc_id long, quality int")
    field = Q.fit(docs, labels)
    assert field.viterbi(Q.measure(good).x).tolist() == [0] and field.viterbi(Q.measure(bad).x).tolist() == [1]


def test_columns_of_any_name_stay(spark):
    df = spark.createDataFrame([("a fine line of ten words that goes on and on.", "y", "z")], "text string, `a``b` string, c0 string")
    out = Q.with_line_quality(df, Q.Field.empty())
    assert out.columns[:3] == ["text", "a`b", "c0"] and tuple(out.first())[1:3] == ("y", "z")
