import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from sheafline.llm import simhash
from sheafline.llm.components import connected_components


def plain_fingerprint(text):
    low = re.sub("[A-Z]", lambda m: chr(ord(m[0]) + 32), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [" ".join(words)] if words else []
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(nodes, linked):
    """ids by smallest reachable id; nodes: [(id, value)]."""
    root = list(range(len(nodes)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(nodes)):
        for j in range(i):
            if linked(nodes[i][1], nodes[j][1]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(nodes):
        least[find(i)] = min(least.get(find(i), k), k)
    return [least[find(i)] for i in range(len(nodes))]


@pytest.mark.parametrize("text", [None, "", "  \n\t ", "one", "One TWO three", "a b c d", "a b c d e f a b c d", "Ärger ÄÖ x y z  q\x0br", "w " * 20001])
def test_fingerprint_is_the_plain_one(text):
    assert simhash.fingerprint(text) == plain_fingerprint(text)


def test_spark_hash_is_the_same(spark):
    assert spark.sql("select xxhash64('a b c d') h").first().h % 2**64 == xxhash.xxh64_intdigest(b"a b c d", 42)


def test_documents_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in simhash.op6_simhash_classes(spark, sf).collect()}
    fps = [(r.doc_id, plain_fingerprint(r.text)) for r in rows]
    assert {k: v[0] for k, v in got.items()} == {k: f"{v:016x}" for k, v in fps}
    want = plain_components(fps, lambda x, y: (x ^ y).bit_count() <= 4)
    assert [got[k][1] for k, _ in fps] == want


@pytest.mark.parametrize("limit", [4096, 8])
def test_links_of_dense_fingerprints(spark, monkeypatch, limit):
    """Dense neighbourhoods and lists over the limit lose no link."""
    monkeypatch.setattr(simhash, "LIST_LIMIT", limit)
    rng = random.Random(1)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0, 2**64 - 1}
    for base in list(fps)[:12]:
        for _ in range(12):
            x = base
            for b in rng.sample(range(64), rng.randint(1, 5)):
                x ^= 1 << b
            fps.add(x)
    nodes = [(x, x) for x in sorted(fps)]
    signed = np.array([x for x, _ in nodes], np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(x,) for x in signed], "fp long")
    parts = {r.node % 2**64: r.component for r in connected_components(simhash.fingerprint_links(df)).collect()}
    want = plain_components(nodes, lambda x, y: (x ^ y).bit_count() <= 4)
    groups, mine = {}, {}
    for (x, _), w in zip(nodes, want, strict=True):
        groups.setdefault(w, set()).add(x)
        mine.setdefault(parts.get(x, x if x < 2**63 else x - 2**64), set()).add(x)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_odd_rows(spark):
    schema = "doc_id long, text string, fingerprint string, component_id int, fp string"
    df = spark.createDataFrame([(3, None, "x", 1, "y"), (2, "", "x", 1, "y"), (None, " ", "x", 1, "y"), (9, "a b c d e", "x", 1, "y"), (9, "a b c d e", "x", 1, "y"), (8, "A b C d e", None, None, None)], schema)
    got = sorted(simhash.near_duplicate_classes(df).collect(), key=str)
    assert sorted(((r.doc_id or -1), r.fingerprint == 0, r.component_id) for r in got) == [(-1, True, 2), (2, True, 2), (3, True, 2), (8, False, 8), (9, False, 8), (9, False, 8)]
    assert simhash.near_duplicate_classes(df.limit(0)).count() == 0


def test_components_of_a_long_path(spark):
    n = 300
    ids = random.Random(3).sample(range(10**6), n)
    path = spark.createDataFrame([(a, b) for a, b in zip(ids, ids[1:], strict=False)] + [(5, 5), (None, 4)], "a long, b long")
    got = connected_components(path)
    assert got.count() == n and [r.component for r in got.select("component").distinct().collect()] == [min(ids)]
    assert connected_components(path.where(F.lit(False))).count() == 0
