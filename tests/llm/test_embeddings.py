import numpy as np
import pytest

from sheafline.llm import embeddings as E


def brute(rows, t=0.98):
    """rows: (id, vector, label)."""
    n, root, links = len(rows), list(range(len(rows))), [0] * len(rows)

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    good = []
    for _, v, label in rows:
        v = None if v is None or any(x is None for x in v) else np.array(v, float)
        good.append(v if v is not None and label is not None and len(v) and np.isfinite(v).all() and v.any() else None)
    for i in range(n):
        for j in range(i):
            a, b = good[i], good[j]
            if a is not None and b is not None and rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.sqrt((a @ a) * (b @ b)) >= t:
                links[i] += 1
                links[j] += 1
                root[find(i)] = find(j)
    least = {}
    for i in range(n):
        least[find(i)] = min(least.get(find(i), rows[i][0]), rows[i][0])
    return sorted((rows[i][0], links[i], least[find(i)]) for i in range(n))


def test_given_table(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.op10_embedding_classes(spark, sf).collect())
    assert got == brute(rows)


def test_odd_rows_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(E, "BLOCK", 5)
    rng = np.random.default_rng(0)
    base = rng.standard_normal((6, 16))
    rows = [(i, [float(x) for x in base[i % 6] + rng.standard_normal(16) * 0.1], i % 2) for i in range(60)]
    nan, inf = float("nan"), float("inf")
    rows += [(70, None, 0), (71, [0.0] * 16, 0), (72, [nan] * 16, 0), (73, [1.0, None], 0), (74, [inf] + [1.0] * 15, 1), (75, rows[3][1], None), (3, rows[3][1], 1), (3, rows[3][1], 1), (76, [], 1), (77, [2.0], 1), (78, [3.0], 1)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, row string, n_links int")
    got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.embedding_classes(df).collect())
    assert got == brute(rows)
    assert E.embedding_classes(df.limit(0)).count() == 0


def test_estimates_are_unbiased_and_bounded():
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 64))
    y = x + rng.standard_normal((400, 64)) * 0.15
    codes = E.Codes.of(E.unit(np.concatenate([x, y])))
    codes = E.Codes.unpack(codes.pack(), 64)
    cos = (x * y).sum(1) / np.linalg.norm(x, axis=1) / np.linalg.norm(y, axis=1)
    i, j = np.arange(400), np.arange(400, 800)
    est = codes.estimates(i, j)
    assert abs((est - cos).mean()) < 0.005
    hit, f, step = cos >= 0.98, codes.numbers[:400, 0], codes.numbers[400:, 2]
    low = lambda confidence: 0.98 - np.diag(E.slack(f, step, 0.98, 64, confidence))
    assert hit.sum() > 100 and (est[hit] >= low(1.0)[hit]).all()
    assert (est[hit] >= low(0.99)[hit]).mean() > 0.97
    differ = np.bitwise_count(codes.signs[i] ^ codes.signs[j]).sum(1)
    assert (differ[hit] <= codes.most_bits(0.98, 0.9999)).all()


def test_partners_share_a_cell():
    """With confidence 1 every pair at the threshold shares a cell; else nearly every one."""
    rng = np.random.default_rng(2)
    x = E.unit(rng.standard_normal((500, 32)))
    d = rng.standard_normal((500, 32))
    d = E.unit(d - (d * x).sum(1, keepdims=True) * x)
    y, pivots = E.unit(0.98 * x + np.sqrt(1 - 0.98**2) * d + 1e-9 * x), E.unit(rng.standard_normal((60, 32)))
    shared = lambda c: np.mean([bool(np.intersect1d(a, b).size) for a, b in zip(E.probes(x, pivots, 0.98, c), E.probes(y, pivots, 0.98, c), strict=True)])
    usual = E.usual_width(32, 0.9999)
    assert shared(1.0) == 1 and shared(usual) > 0.995
    assert sum(map(len, E.probes(x, pivots, 0.98, usual))) < sum(map(len, E.probes(x, pivots, 0.98, 1.0)))


def test_recall_against_brute_force(spark):
    """Single pairs at all angles up to the threshold's, groups and equal vectors of one label."""
    rng, rows = np.random.default_rng(8), []
    for _ in range(150):
        a = E.unit(rng.standard_normal((1, 48)))[0]
        b = rng.standard_normal(48)
        b = E.unit((b - (b @ a) * a)[None])[0]
        c = rng.uniform(0.9801, 0.985)
        rows += [(len(rows), a.tolist(), 1), (len(rows) + 1, (3 * (c * a + np.sqrt(1 - c * c) * b)).tolist(), 1)]
    group = rng.standard_normal(48)
    for k in range(200):
        rows.append((len(rows), (group if k % 4 == 0 else group + rng.standard_normal(48) * 0.14).tolist(), 1))
    want = brute(rows)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    for confidence, least in ((1.0, 1.0), (E.CONFIDENCE, 0.995)):
        got = sorted((r.vec_id, r.n_links, r.component_id) for r in E.embedding_classes(df, confidence=confidence).collect())
        assert all(g[1] <= w[1] for g, w in zip(got, want, strict=True))
        assert sum(g[1] for g in got) >= least * sum(w[1] for w in want)
        if least == 1:
            assert got == want


def test_needed_width_is_where_cells_meet():
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3, 64))
    x, pivots = E.unit(rng.standard_normal((300, 3)) @ base), E.unit(rng.standard_normal((20, 3)) @ base)
    y = E.unit(x + 0.1 * E.unit(rng.standard_normal((300, 3)) @ base))
    need = E.needed_width(x, y, pivots, 0.98)
    for width in (0.0, 0.3, 0.6, 1.0):
        a, b = E.probes(x, pivots, 0.98, width), E.probes(y, pivots, 0.98, width)
        meet = np.array([bool(np.intersect1d(p, q).size) for p, q in zip(a, b, strict=True)])
        assert meet[need <= width].all()
    assert need.max() > 0.2


@pytest.mark.parametrize("dim", [64, 384, 1536])
@pytest.mark.parametrize("inner", [2, 3, 4])
def test_recall_in_few_dimensions(spark, dim, inner):
    """Vectors in a subspace: partners lie in the direction of other pivots, so cells have to be widened."""
    rng = np.random.default_rng(dim + inner)
    n = {2: 300, 3: 700, 4: 1200}[inner]
    x = E.unit(rng.standard_normal((n, inner)) @ rng.standard_normal((inner, dim)))
    rows = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    links = ((x @ x.T) >= 0.98).sum(1) - 1
    got = {r.vec_id: r.n_links for r in E.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)).collect()}
    found = np.array([got[i] for i in range(n)])
    assert (found <= links).all() and found.sum() >= 0.99 * links.sum()


def test_very_large_and_small_numbers(spark):
    rows = [(1, [1e200, 1e200], 1), (2, [2e200, 2e200], 1), (3, [1e-200, 1e-200], 1), (4, [1e-200, -1e-200], 1), (5, [0.0, -0.0], 1)]
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in E.embedding_classes(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    assert got == {1: (2, 1, True), 2: (2, 1, False), 3: (2, 1, False), 4: (0, 4, True), 5: (0, 5, True)}
