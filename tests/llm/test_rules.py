import numpy as np
import pytest

from sheafline.llm import rules as R


def test_lasso_is_at_its_optimum_and_sparse():
    rng = np.random.default_rng(1)
    r = rng.standard_normal((400, 12))
    y = (r[:, 0] - 2 * r[:, 3] + rng.standard_normal(400) > 0).astype(float)
    w, b = R.lasso(r, y, np.ones(400), 0.03, 3000)
    g = r.T @ ((1 / (1 + np.exp(-(r @ w + b))) - y) / 400)
    live = w != 0
    assert np.allclose(g[live], -0.03 * np.sign(w[live]), atol=1e-4) and (np.abs(g[~live]) <= 0.03 + 1e-4).all()
    assert live[0] and live[3] and live.sum() < 10


def test_paths_are_rules_over_their_rows():
    rng = np.random.default_rng(2)
    x = rng.random((300, len(R.FEATURES)))
    y = ((x[:, 0] > 0.5) & (x[:, 2] <= 0.4)).astype(float)
    model = R.RuleModel.train(x, y)
    assert 0 < len(model.rules) < 60 and ((model.scores(x) > 0.5) == y).mean() > 0.95
    assert all(len(rule) <= R.DEPTH for rule, _ in model.rules) and len(model.describe()) == len(model.rules)


def test_column_equals_numpy_and_held_out_quality(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = R.fit(docs, labels)
    rows = R.with_scores(R.with_features(docs.select("doc_id", "text"), "text"), model).drop("text").collect()
    x = np.array([[r[f"__q_{f}"] for f in R.FEATURES] for r in rows])
    assert np.allclose([r.score for r in rows], model.scores(x))
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [(r.score, truth[r.doc_id]) for r in R.op7_quality_rules(spark, sf).collect() if r.held_out and r.doc_id in truth]
    good, bad = np.array([s for s, q in out if q == 1]), np.array([s for s, q in out if q == 0])
    auc = (good[:, None] > bad[None]).mean() + 0.5 * (good[:, None] == bad[None]).mean()
    assert auc > 0.97 and (good >= 0.3).mean() > 0.99 and (bad < 0.3).mean() > 0.8


def test_statistics_and_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, " \n ", "x"), (3, "Ab c\nAb c\n\n*| 12!", None)], "doc_id long, text string, score string")
    rows = {r.text: [r[f"__q_{f}"] for f in R.FEATURES] for r in R.with_features(df, "text").collect()}
    assert rows[None] == rows[""] == [0.0] * len(R.FEATURES)
    got = dict(zip(R.FEATURES, rows["Ab c\nAb c\n\n*| 12!"], strict=True))
    assert got["words"] == 6 and abs(got["distinct_word_share"] - 4 / 6) < 1e-9 and abs(got["distinct_line_share"] - 2 / 3) < 1e-9
    assert got["symbols_per_word"] == 1 / 6 and got["bars_per_word"] == 1 / 6 and got["upper_share"] == 2 / 11 and got["word_length"] == 11 / 6
    scored = R.with_scores(df, R.RuleModel())
    assert scored.columns == ["doc_id", "text", "score", "predicted"] and {r.predicted for r in scored.collect()} == {1}
    assert R.with_scores(df.limit(0), R.RuleModel()).count() == 0
    assert R.fit(df, spark.createDataFrame([(1, 1), (2, None)], "doc_id long, quality int")).rules == []


@pytest.mark.parametrize("rows", [[], [(0, 1)], [(0, 0), (1, 1)], [(5, k % 2) for k in range(40)], [(k, 1) for k in range(30)]])
def test_few_constant_and_one_class_rows(rows):
    x = np.array([[float(a)] * len(R.FEATURES) for a, _ in rows]).reshape(-1, len(R.FEATURES))
    model = R.RuleModel.train(x, np.array([b for _, b in rows], float))
    got = model.scores(x)
    assert np.isfinite(got).all() and ((got >= 0) & (got <= 1)).all()
    assert (got == 0.5).all() or len({b for _, b in rows}) < 2 and (got > 0.99).all()


def plain_tree(x, cuts, g, h, rows, depth):
    """Rules and leaf values of one tree, by trying every cut on its own."""
    best = (1e-6, None)
    if depth:
        for f, points in enumerate(cuts):
            for cut in points:
                more = x[rows, f] > cut
                if min(more.sum(), (~more).sum()) >= 5:
                    part = lambda m: g[rows[m]].sum() ** 2 / (h[rows[m]].sum() + 1)
                    gain = part(more) + part(~more) - part(np.ones(len(rows), bool))
                    if gain > best[0] + 1e-12:
                        best = (gain, (f, float(cut)))
    if best[1] is None:
        return set(), {int(r): -g[rows].sum() / (h[rows].sum() + 1) for r in rows}
    f, cut = best[1]
    rules, leaves = set(), {}
    for more in (False, True):
        inner, own = plain_tree(x, cuts, g, h, rows[(x[rows, f] > cut) == more], depth - 1)
        rules |= {((f, more, cut),)} | {((f, more, cut), *r) for r in inner}
        leaves |= own
    return rules, leaves


def test_trees_against_a_plain_grower():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, 4)).round(1)
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.1, 0.9, 8))) for f in range(4)]
    g, h, rows = rng.standard_normal(200), rng.random(200), np.arange(0, 200, 2)
    found, out = set(), np.zeros(200)
    R.grow(x, cuts, g, h, rows, 3, (), found, out)
    rules, leaves = plain_tree(x, cuts, g, h, rows, 3)
    assert found == rules and all(abs(out[r] - v) < 1e-9 for r, v in leaves.items()) and (out[1::2] == 0).all()


def test_repeated_rows_long_texts_and_clashing_columns(spark):
    df = spark.createDataFrame([(1, "word " * 200_000, "a", "b"), (1, "word " * 200_000, "a", "b"), (None, None, "c", "d")], "doc_id long, text string, __q_words string, `x``y` string")
    out = R.with_scores(df, R.RuleModel([(((0, True, 5.0),), 1.0)], 0.0))
    rows = out.collect()
    assert out.columns == ["doc_id", "text", "__q_words", "x`y", "score", "predicted"]
    assert sorted(round(r.score, 3) for r in rows) == [0.5, 0.731, 0.731] and {r[2] for r in rows} == {"a", "c"}
