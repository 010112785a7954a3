import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from sheafline.llm import partenum as P


def plain_near(a, b):
    """By making all texts that one edit of the shorter one allows."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 5:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= 3}


def plain_variants(n):
    """[(word, form, root, n, n_near, form_n)] by comparing all pairs whose letters allow it."""
    words = sorted(n)
    near = {w: [] for w in words}
    for i, a in enumerate(words):
        for b in words[:i]:
            if abs(len(a) - len(b)) <= 1 and plain_near(a, b):
                near[a].append(b)
                near[b].append(a)
    form = {}
    for w in words:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        if best is not None and n[best] >= 2 * n[w]:
            form[w] = best
    out = []
    for w in words:
        root = w
        while root in form:
            root = form[root]
        out.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    return out


def rows(df):
    return sorted((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("bucket", [2048, 3])
@pytest.mark.parametrize("letters", ["ab", "abcdeñÀ÷"])
def test_random_words_against_all_pairs(spark, monkeypatch, bucket, letters):
    """Few letters make large signatures, many pairs and ties; a bucket of three sends nearly all of them to deletion variants."""
    monkeypatch.setattr(P, "BUCKET", bucket)
    rng = random.Random(len(letters))
    words = {"".join(rng.choices(letters, k=rng.randint(5, 9))) for _ in range(250)}
    n = {w: rng.choice([3, 4, 6, 8, 12, 16, 24, 50]) for w in words}
    assert rows(P.variants(spark.createDataFrame(list(n.items()), "word string, n long"))) == sorted(plain_variants(n))


def test_near_words_share_a_signature():
    rng = random.Random(1)
    for _ in range(500):
        a = "".join(rng.choices("abcdefghij", k=rng.randint(1, 12)))
        i = rng.randrange(len(a) + 1)
        b = rng.choice([a[:i] + rng.choice("abcxyz") + a[i:], a[:i] + a[i + 1 :], a[:i] + rng.choice("abcxyz") + a[i + 1 :]])
        assert P.near(a, b) == plain_near(a, b)
        if P.near(a, b) and min(len(a), len(b)):
            s = P.signatures([a, b])
            assert set(s[0].tolist()) & set(s[1].tolist())


@pytest.mark.parametrize("n", [5, 40])
def test_bucket_pairs(n):
    rng = random.Random(n)
    words = sorted({"".join(rng.choices("abc", k=rng.randint(4, 6))) for _ in range(n)})
    want = {(a, b) for a in words for b in words if a < b and plain_near(a, b)}
    assert set(P.bucket_pairs(words)) == want


@pytest.mark.parametrize("letters", ["ab", "abñc"])
def test_pairs_of_lists(letters):
    """Lists of one length, and of two that differ by one; those that only hold the longer words give the pairs among them or none."""
    rng = random.Random(len(letters))
    lists = []
    for _ in range(120):
        n = rng.randint(3, 7)
        lists.append(sorted({"".join(rng.choices(letters, k=n + rng.randint(0, rng.choice([0, 1])))) for _ in range(rng.choice([2, 3, 9, 60]))}))
    lists = [x for x in lists if len(x) > 1]
    got = P.list_pairs(pa.array([w for x in lists for w in x]), np.array([len(x) for x in lists]))
    mixed = lambda x: len({len(w) for w in x}) == 2
    want = {(a, b) for x in lists for a in x for b in x if a < b and plain_near(a, b) and (len(a) != len(b) or not mixed(x))}
    every = {(a, b) for x in lists for a in x for b in x if a < b and plain_near(a, b)}
    assert want <= got <= every
    assert P.list_pairs(pa.array([], pa.string()), np.zeros(0, np.int64)) == set()


def test_query_equals_all_pairs(spark, sf):
    docs = [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    n = plain_counts(docs)
    got = rows(P.op12_spelling_variants(spark, sf))
    assert {r[0]: r[3] for r in got} == n
    rest = {}
    for w in n:  # all pairs of the words that lose a letter to the same rest
        for r in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            rest.setdefault(r, set()).add(w)
    near = {w: {b for r in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))} for b in rest[r] if plain_near(w, b)} for w in n}
    form = {w: b for w in n if (b := min(near[w], key=lambda x: (-n[x], x), default=None)) is not None and n[b] >= 2 * n[w]}
    want = []
    for w in n:
        root = w
        while root in form:
            root = form[root]
        want.append((w, form.get(w), root, n[w], len(near[w]), n.get(form.get(w))))
    assert got == sorted(want)


def test_odd_documents(spark):
    schema = "doc_id long, text string, word int, n string"
    docs = [(1, "Straße straße STRASSE Ñandú ñandú"), (2, None), (None, "Straße ñandú ñandu"), (None, "ñandu Ñandú"), (3, ""), (4, "1 2 3 ._"), (1, "Straße straße STRASSE Ñandú ñandú"), (5, "alphabet " * 20001), (6, "alphabat alphabat alphabat"), (7, "x" * 100000 + " " + "alphabets " * 9)]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], schema)
    assert rows(P.spelling_variants(df)) == sorted(plain_variants(plain_counts(docs)))
    assert rows(P.spelling_variants(df.limit(0))) == rows(P.spelling_variants(df.where("doc_id in (2, 3, 4)"))) == []


def test_chains(spark):
    words = ["aaaaa", "aaaab", "aaabb", "aabbb", "abbbb", "bbbbb"]
    n = {w: 3 * 2**i for i, w in enumerate(words)}
    got = rows(P.variants(spark.createDataFrame(list(n.items()), "word string, n long")))
    assert got == sorted(plain_variants(n)) and {r[2] for r in got} == {"bbbbb"}
