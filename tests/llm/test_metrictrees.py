import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sheafline.llm import metrictrees as M


def plain_owners(points, entries):
    d = ((points[:, None].astype(np.int64) - entries[None]) ** 2).sum(2)
    return d.argmin(1), d.min(1)


def plain(rows):
    """({position of a row: (code, error)}, codebooks) of (id, vector) by full search."""
    kept = [i for i, (_, v) in enumerate(rows) if v and all(x is not None and math.isfinite(x) for x in v)]
    q = np.array([[math.floor(256 * x) for x in rows[i][1]] for i in kept], np.int64).reshape(len(kept), M.PARTS, -1)
    first = sorted(range(len(kept)), key=lambda k: (rows[kept[k]][0] is None, rows[kept[k]][0] or 0, rows[kept[k]][1]))[: M.ENTRIES]
    books = q[first].transpose(1, 0, 2).copy()
    for step in range(M.ROUNDS + 1):
        own = [plain_owners(q[:, p], books[p]) for p in range(M.PARTS)]
        if step < M.ROUNDS:
            for p in range(M.PARTS):
                for e in set(own[p][0].tolist()):
                    mine = q[own[p][0] == e, p]
                    books[p, e] = [s // len(mine) for s in mine.sum(0).tolist()]
    code = np.stack([o[0] for o in own], 1).astype(np.uint8)
    error = sum(o[1] for o in own)
    return {i: (code[k].tobytes().hex(), int(error[k])) for k, i in enumerate(kept)}, books


@pytest.mark.parametrize("n,d,spread", [(0, 2, 9), (1, 2, 9), (15, 3, 2), (700, 4, 60), (3000, 4, 4), (900, 1, 500), (400, 24, 900), (600, 4, 1)])
def test_tree_owners_are_those_of_a_full_search(n, d, spread):
    """Small spreads give many equal points and ties."""
    rng = np.random.default_rng(n + d)
    points = rng.integers(-spread, spread, (n, d)).astype(np.int32)
    if n > 100:
        points[: n // 3] = points[0]
        points[n // 3 : n // 2] //= 8
    entries = np.concatenate([points[:30], rng.integers(-2 * spread, 2 * spread, (34, d))]).astype(np.int64)
    tree = M.Tree(points)
    assert sorted(tree.order.tolist()) == list(range(n))
    owner, counts, sums = M.owners(tree, entries)
    want = plain_owners(points, entries)[0] if n else np.zeros(0, int)
    assert owner.tolist() == want[tree.order].tolist()
    for e in range(len(entries)):
        assert counts[e] == (want == e).sum() and sums[e].tolist() == points[want == e].sum(0).tolist()


def test_balls_hold_their_points_and_own_whole_clusters():
    rng = np.random.default_rng(4)
    centres = rng.integers(-5000, 5000, (40, 4))
    points = (centres[rng.integers(0, 40, 5000)] + rng.integers(-20, 20, (5000, 4))).astype(np.int32)
    tree = M.Tree(points)
    for s, n, left, right, c, r, t in zip(tree.start, tree.size, tree.left, tree.right, tree.centre, tree.radius, tree.total, strict=True):
        own = tree.points[s : s + n]
        assert np.sqrt(((own - c) ** 2).sum(1)).max() <= r * (1 + 1e-12) + 1e-9 and own.sum(0).tolist() == t.tolist()
        if left >= 0:
            assert tree.start[left] == s and tree.start[right] == s + tree.size[left] and tree.size[left] + tree.size[right] == n
    assert len(tree.start) < 5000


def test_query_equals_full_search(spark, sf):
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    codes, books = plain([r[:2] for r in rows])
    got = {r.vec_id: r for r in M.op13_vector_codes(spark, sf).collect()}
    assert {k: (r.code, r.error) for k, r in got.items()} == {rows[i][0]: x for i, x in codes.items()}
    labels = {}
    for i, (_, error) in codes.items():
        labels[rows[i][2]] = labels.get(rows[i][2], 0) + error
    assert {rows[i][0]: labels[rows[i][2]] for i in codes} == {k: r.label_error for k, r in got.items()}
    assert {r.codebooks_sha256 for r in got.values()} == {hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()}


SCHEMA = "vec_id long, embedding array<float>, label int, code string, error int, id string"


@pytest.mark.parametrize("block", [1 << 20, 32 * 50])
def test_odd_vectors(spark, monkeypatch, block):
    """Nulls, copies, repeated ids, vectors that cannot be coded, clashing columns; blocks of any size give the same."""
    monkeypatch.setattr(M, "BLOCK", block)
    rng = np.random.default_rng(8)
    vec = lambda: [float(x) for x in rng.normal(0, 1, 32).astype(np.float32)]
    one = vec()
    rows = [(i, vec(), i % 3) for i in range(300)] + [(1000 + i, one, None) for i in range(150)]
    rows += [(5, one, 1), (5, vec(), 1), (None, vec(), None), (7, None, 1), (8, [*one[:31], None], 1), (9, [*one[:31], float("nan")], 1), (9, [*one[:31], float("-inf")], 1), (-5, [], 1), (2000, [0.5] * 16, 1), (-9, [0.5] * 17, 1)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA).repartition(5)
    out, books = M.compress(df)
    same = [(r[0], r[1] if r[1] and len(r[1]) == 32 else None) for r in rows]
    codes, want = plain(same)
    assert books.tolist() == want.tolist()
    assert sorted(((r.vec_id, r.label, r.code, r.error) for r in out.collect()), key=str) == sorted(((rows[i][0], rows[i][2], *x) for i, x in codes.items()), key=str)


def test_few_and_no_vectors(spark):
    rows = [(i, [float(i)] * 16, None) for i in range(3)]
    df = spark.createDataFrame([(*r, "x", 1, "y") for r in rows], SCHEMA)
    out, books = M.compress(df)
    assert books.shape == (16, 3, 1) and [(r.code, r.error) for r in out.orderBy("vec_id").collect()] == [(f"0{i}" * 16, 0) for i in range(3)]
    out, books = M.compress(df.where(F.lit(False)))
    assert out.count() == 0 and books.shape[1] == 0
    with pytest.raises(Exception, match="components must lie"):
        M.compress(spark.createDataFrame([(1, [1e30] * 16, 1, "x", 1, "y")], SCHEMA))[0].collect()
