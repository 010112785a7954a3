import random
import re

import numpy as np
import pytest

from sheafline.llm import winnowing as W


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain(docs, items):
    """[(id, n_words, hit words, items)] by looking every window up."""
    windows = {}
    for item, text in items:
        w = plain_words(text)
        m = min(len(w), W.WINDOW)
        for i in range(len(w) - m + 1) if m and item is not None else ():
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = []
    for doc, text in docs:
        w = plain_words(text)
        hit, owners = set(), set()
        for m in {len(x) for x in windows}:
            for i in range(len(w) - m + 1):
                if own := windows.get(tuple(w[i : i + m])):
                    hit |= set(range(i, i + m))
                    owners |= own
        out.append((doc, len(w), sorted(hit), sorted(owners)))
    return sorted(out, key=str)


def rows(df):
    return sorted(((r.doc_id, r.n_words, [k for s in r.spans for k in range(s.start, s.end)], r["items"]) for r in df.collect()), key=str)


DOCS, ITEMS = "doc_id long, text string, items int, n_words string", "item_id int, text string, doc_id int"


def frames(spark, docs, items):
    return spark.createDataFrame([(*x, 1, "x") for x in docs], DOCS), spark.createDataFrame([(*x, 7) for x in items], ITEMS)


@pytest.mark.parametrize("words", [3, 40])
def test_random_texts_against_every_window(spark, monkeypatch, words):
    """Few words: nearly every window occurs somewhere, with ties among equal k-grams; short items of every length."""
    monkeypatch.setattr(W, "CHUNK", 50)
    rng = random.Random(words)
    vocab = ["a", "B", "ñu", "x9", "日本", *[f"w{i}" for i in range(words)]][-words:]
    text = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choices(vocab, k=n))
    items = [(i, text(rng.randint(0, 14))) for i in range(30)] + [(3, text(12)), (None, text(12)), (50, None), (51, " .,")]
    docs = [(i, text(rng.randint(0, 60))) for i in range(60)]
    docs += [(100 + i, f"{text(9)} {rng.choice(items)[1]} {text(9)}") for i in range(60)] + [(None, None), (None, ""), (7, "."), (5, text(30)), (5, text(30))]
    got = rows(W.contamination(*frames(spark, docs, items)))
    assert got == plain(docs, items)
    assert any(r[2] for r in got)


def test_a_shared_window_is_never_missed():
    """Any ten shared words, wherever they lie, keep the same fingerprint in both texts."""
    rng = random.Random(2)
    for _ in range(200):
        shared = " ".join(rng.choices("abcd", k=10))
        a, b = (W.Words([(" ".join(rng.choices("abcdefgh", k=rng.randint(0, 9))) + " " + shared + " " + " ".join(rng.choices("abcdefgh", k=rng.randint(0, 9)))).encode()]) for _ in range(2))
        fps = [{(r["fp"], d) for _, r in x.records(10, np.array([True]), None) for d in r["digests"]} for x in (a, b)]
        assert fps[0] & fps[1]


def test_words_over_pieces(monkeypatch):
    texts = ["", None, "x" * 500, "One two, THREE\x00four ÄÖ", " ", "a" * 3000 + " b"]
    whole = W.Words([None if t is None else t.encode() for t in texts])
    monkeypatch.setattr(W, "CHUNK", 7)
    cut = W.Words([None if t is None else t.encode() for t in texts])
    assert whole.hashes.tolist() == cut.hashes.tolist() and whole.counts().tolist() == cut.counts().tolist() == [len(plain_words(t)) for t in texts]


def test_query_equals_plain(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: (n, len(hit), len(own)) for d, n, hit, own in plain(docs, items)}
    got = {r.doc_id: (r.n_words, r.n_hit, r.n_items) for r in W.op11_decontamination(spark, sf).collect()}
    assert got == want and any(x[1] for x in got.values())


def test_empty_tables_and_long_texts(spark):
    words = [f"w{i}" for i in range(20000)]
    docs, items = frames(spark, [(1, " ".join(words)), (2, " ".join(words[::-1]))], [(9, " ".join(words[15000:15030]))])
    assert [(r[0], r[1], r[2][:1], len(r[2])) for r in rows(W.contamination(docs, items))] == [(1, 20000, [15000], 30), (2, 20000, [], 0)]
    assert rows(W.contamination(docs, items.limit(0))) == [(1, 20000, [], []), (2, 20000, [], [])]
    assert rows(W.contamination(docs.limit(0), items)) == []


def test_a_passage_of_half_the_documents(spark):
    passage = " ".join(f"p{i}" for i in range(25))
    docs = [(i, f"d{i} e{i} {passage if i % 2 else ''} f{i}") for i in range(400)]
    items = [(i, passage) for i in range(20)] + [(30, "other " + passage)]
    assert rows(W.contamination(*frames(spark, docs, items))) == plain(docs, items)
