import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import similar as S


def plain_sets(texts):
    out = []
    for t in texts:
        w = [x.lower() if x.isascii() else x for x in (t or "").split()]
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) > 5 else {tuple(w)})
    return out


def plain_groups(texts, threshold=0.8):
    sets, root = plain_sets(texts), list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            a, b = sets[i], sets[j]
            if len(a & b) >= threshold * len(a | b) and (a | b) != {()} or a == b:
                root[find(i)] = find(j)
    least = {}
    for i in range(len(texts)):
        least.setdefault(find(i), i)
    return sorted(least.values())


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k = rng.randrange(len(out))
        out[k] = f"w{rng.randrange(10**6)}"
    return out


def corpus(seed, n_bases=12, copies=8, length=200):
    rng = random.Random(seed)
    texts = []
    for _ in range(n_bases):
        base = [f"w{rng.randrange(10**6)}" if rng.random() < 0.7 else rng.choice(["the", "of", "and", "to", "in"]) for _ in range(length)]
        texts += [" ".join(edited(rng, base, rng.choice([0, 1, 2, 3, 4, 8, 12]))) for _ in range(copies)]
        texts.append(" ".join(base))
    return texts


@pytest.mark.parametrize("group,lists", [(1000, 4096), (4, 6)])
def test_groups_against_brute_force(spark, monkeypatch, group, lists):
    monkeypatch.setattr(S, "GROUP_LIMIT", group)
    monkeypatch.setattr(S, "LIST_LIMIT", lists)
    texts = corpus(1)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert sorted(r.doc_id for r in S.keep_one(df).collect()) == plain_groups(texts)


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    want = {rows[i][0] for i in plain_groups([t for _, t in rows])}
    got = {r.doc_id for r in S.keep_one(docs).collect()}
    assert want <= got and len(got - want) <= 0.01 * len(want)
    assert len(rows) - len(got) >= 0.95 * (len(rows) - len(want))


def changed(rng, words, kind, share):
    """A text whose similarity with words is about share, by edits, an appended or cut part, or another order of its paragraphs."""
    n = len(words)
    new = lambda k: [f"n{rng.randrange(10**6)}" for _ in range(k)]
    if kind == "append":
        return words + new(int(n / share) - n)
    if kind == "cut":
        return words[: int(n * share)]
    if kind == "edit":
        out = list(words)
        for k in rng.sample(range(n), max(1, int(n * (1 - share) / (1 + share) / 5))):
            out[k] = f"e{rng.randrange(10**6)}"
        return out
    parts = [words[k : k + 60] for k in range(0, n, 60)]
    rng.shuffle(parts)
    return [w for p in parts for w in p]


def test_recall_by_similarity_and_kind_of_change(spark):
    """Every pair at the threshold is found, whatever changed and however weak the link."""
    rng, pairs, texts = random.Random(9), [], []
    for kind in ("append", "cut", "edit", "order"):
        for share in (0.79, 0.82, 0.87, 0.93, 0.98):
            for n in (60, 120, 400, 1500):
                base = [f"w{rng.randrange(10**5)}" if rng.random() < 0.6 else rng.choice("abcdefgh") for _ in range(n)]
                a, b = " ".join(base), " ".join(changed(rng, base, kind, share))
                x, y = plain_sets([a, b])
                pairs.append((len(x & y) / len(x | y), len(texts)))
                texts += [a, b]
    left = {r.doc_id for r in S.keep_one(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for low, high in ((0.8, 0.85), (0.85, 0.9), (0.9, 0.95), (0.95, 1.01)):
        found = [k + 1 not in left for j, k in pairs if low <= j < high]
        assert len(found) >= 8 and all(found), (low, len(found), sum(found))
    assert all(k + 1 in left for j, k in pairs if j < 0.8)


@pytest.mark.parametrize("n", [150, 300, 600])
def test_edges_grow_with_a_group_and_not_with_its_square(spark, n):
    rng = random.Random(n)
    base = [f"w{rng.randrange(10**6)}" for _ in range(150)]
    texts = [" ".join(edited(rng, base, 1)) for _ in range(n)]
    marks = [(i, S.shingle_set(t)) for i, t in enumerate(texts)]
    none = np.zeros(0, np.int64)
    lists = {}
    for i, s in marks:
        for key in S.prefix(s, none, none, 0.8).tolist():
            lists.setdefault(key, []).append(np.array([i, i, len(s)]).tobytes() + S.parity(s))
    large = [m for m in lists.values() if len(m) > S.PAIRED]
    edges = {(int(a), int(b)) for m in large for a, b, _ in S._pairs_of_large(m, 0.8)}
    assert len(large) > 20 and len(edges) <= 12 * n


def test_blocks_of_a_group_by_its_labels(spark, monkeypatch):
    """A group whose largest part has one label meets the rest only; all links between labels are found."""
    monkeypatch.setattr(S, "GROUP_LIMIT", 20)
    sets = [(i, list(range(i % 3, 50))) for i in range(60)] + [(100, list(range(2, 58)))] + [(200 + k, list(range(1000 * k, 1000 * k + 40))) for k in range(1, 15)]
    df = spark.createDataFrame(sets, "cls long, shingles array<long>")
    groups = df.select("cls", F.lit(1).cast("long").alias("grp"), F.when(F.col("cls") < 60, 0).otherwise(F.col("cls")).cast("long").alias("label"))
    found = {frozenset(0 if x < 60 else x for x in r) for r in S.rest_edges(groups, df, 0.8).collect()}
    assert found == {frozenset({0, 100})}


def test_shingles_and_fingerprints():
    assert len(S.shingle_set("a b c d e f")) == 2 and len(S.shingle_set("A b")) == 1 and len(S.shingle_set("")) == len(S.shingle_set(None)) == 0
    assert (S.shingle_set("a B  c\n") == S.shingle_set("A b c")).all()


def test_odd_rows(spark):
    text = "a b c d e f g h"
    df = spark.createDataFrame([(5, text, "x", 1), (5, text, "x", 1), (4, text.upper(), "y", 2), (None, text, "z", 3), (None, None, "n", 4), (None, "", "n", 5), (7, "other words are here now", None, 6)],
                               "doc_id long, text string, fp string, row int")
    out = S.keep_one(df)
    assert out.columns == df.columns
    got = sorted(((r.doc_id or -1), r.text or "", r.fp) for r in out.collect())
    assert got == [(-1, "", "n"), (4, text.upper(), "y"), (7, "other words are here now", None)]
    assert S.keep_one(df.limit(0)).count() == 0


@pytest.mark.parametrize("group,lists", [(1000, 4096), (4, 6)])
def test_appended_truncated_and_long_texts_against_brute_force(spark, monkeypatch, group, lists):
    monkeypatch.setattr(S, "GROUP_LIMIT", group)
    monkeypatch.setattr(S, "LIST_LIMIT", lists)
    monkeypatch.setattr(S, "SAMPLE", 20)
    rng, texts = random.Random(4), []
    common = [f"c{k}" for k in range(30)]
    new = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    for n in [40, 100, 200, 400] * 6 + [6000, 20000]:
        base = common + new(n - 30)
        for share in (0.8, 0.81, 0.85, 0.9):
            k = int(share * n) + 1
            texts += [" ".join(base[:k])] if rng.random() < 0.5 else [" ".join(base + new(int(n / share - n)))]
        texts += [" ".join(base), " ".join(base[:100] + edited(rng, base[100:], n // 50) if n > 100 else base[1:]), " ".join(edited(rng, base, n // 40))]
    rng.shuffle(texts)
    want = plain_groups(texts)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert len(want) < 0.5 * len(texts) and sorted(r.doc_id for r in S.keep_one(df).collect()) == want


def test_prefixes_meet_and_bitmaps_lose_no_pair():
    rng = np.random.default_rng(3)
    for n in (1, 2, 5, 9, 50, 333, 5000):
        for _ in range(40):
            a = np.unique(rng.integers(-2**63, 2**63 - 1, n))
            gone = int(rng.integers(0, n // 5 + 1))
            b = np.unique(np.concatenate([rng.permutation(a)[gone:], rng.integers(-2**63, 2**63 - 1, int(rng.integers(0, gone + 1)))]))
            frequent = np.sort(rng.permutation(a)[: n // 2])
            shared = len(np.intersect1d(a, b))
            if shared >= 0.8 * (len(a) + len(b) - shared):
                p, q = (S.prefix(x, frequent, np.arange(len(frequent)) % 3 + 3, 0.8) for x in (a, b))
                x, y = S.parity(a), S.parity(b)
                assert len(np.intersect1d(p, q))
                for size in (S.BYTES, min(len(x), len(y))):
                    assert np.bitwise_count(S.fold(x, size) ^ S.fold(y, size)).sum() <= len(a) + len(b) - 2 * shared
