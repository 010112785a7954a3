import zlib

import numpy as np

from sheafline.llm import langid as G


def test_gradients_match_differences():
    rng = np.random.default_rng(3)
    net = G.Network.fresh(["a", "b", "c"])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    x, y = rng.integers(0, 256, (5, 7)), rng.integers(0, 3, 5)
    _, g = net.gradients(x, y)
    for name, value in net.p.items():
        flat, d = value.reshape(-1), g[name].reshape(-1)
        for i in [*np.argsort(-np.abs(d))[:3], 0]:
            was, eps = flat[i], 1e-4
            flat[i] = was + eps
            up = net.gradients(x, y)[0]
            flat[i] = was - eps
            down = net.gradients(x, y)[0]
            flat[i] = was
            assert abs((up - down) / (2 * eps) - d[i]) < 1e-5 + 1e-3 * abs(d[i]), name


def plain_states(net, side, data):
    """One state after the other, by the unit's equations."""
    h, out = np.zeros(G.HIDDEN), []
    for byte in data:
        a, g = net.p["w" + side][byte].astype(float), h @ net.p["u" + side]
        n = G.HIDDEN
        r, z = (1 / (1 + np.exp(-(a[k : k + n] + g[k : k + n]))) for k in (0, n))
        c = np.tanh(a[2 * n :] + r * g[2 * n :])
        h = z * h + (1 - z) * c
        out.append(h)
    return out


def test_windows_against_the_plain_recurrence():
    """Every byte of a text is labelled once, by states that start MARGIN bytes outside of its window in each direction."""
    net = G.Network.fresh(["a", "b", "c"], seed=4)
    text = ("one two three-very-long-word-that-is-not-cut " * 9).encode()[:300]
    m, size, total = G.MARGIN, G.WINDOW, np.zeros(3)
    padded = bytes(m) + text + bytes(2 * size)
    for k in range(0, len(text), size):
        ahead = plain_states(net, "f", padded[k : k + m + size])[m:]
        back = plain_states(net, "b", padded[k + m : k + 2 * m + size][::-1])[m:][::-1]
        for p in range(min(size, len(text) - k)):
            y = np.concatenate([ahead[p], back[p]]) @ net.p["o"] + net.p["b"]
            total += np.exp(y) / np.exp(y).sum()
    names, scores = net.predict([text.decode()])
    assert names == [net.languages[total.argmax()]] and abs(scores[0] - total.max() / len(text)) < 1e-5


def test_labels_of_a_word_depend_on_its_neighbours():
    net = G.Network.fresh(["a", "b"], seed=2)
    x = [np.frombuffer(t, np.uint8)[None] for t in (b"aaa word bbb", b"ccc word ddd")]
    one, other = (net.positions(k)[4:8, 0] for k in x)
    assert np.abs(one - other).max() > 1e-3
    assert net.positions(x[0]).shape == (12, 1, 2)


def test_window_sums_are_those_of_positions():
    net = G.Network.fresh(["a", "b"], seed=1)
    x = np.random.default_rng(0).integers(0, 256, (5, 40)).astype(np.uint8)
    want = net.positions(x).sum(0)
    assert np.abs(net.window_sums(x, np.full(5, 40), margin=0) - want).max() < 1e-4


def test_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = G.op9_language(spark, sf).collect()
    assert len(rows) == len(truth)
    out = [r for r in rows if r.held_out]
    assert {r.doc_id for r in out} == {k for k in truth if zlib.crc32(str(k).encode()) % 5 == 0}
    assert np.mean([truth[r.doc_id][0] == r.lang_pred for r in out]) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "en", "x"), (1, "", "en", "x"), (None, "12 34", None, "x"), (4, "the word " * 9, "en", "x"), (4, "le mot " * 9, "fr", None), (5, "x" * 50000, None, "x")], "doc_id long, text string, lang string, lang_pred string")
    net = G.fit(df)
    assert net.languages == ["en", "fr"]
    rows = G.identify(df, net).collect()
    assert sorted(r.lang_pred for r in rows)[-3:] == ["und"] * 3 and len(rows) == 6
    none = G.fit(df.limit(0))
    assert G.identify(df.limit(0), none).count() == 0
    assert {r.lang_pred for r in G.identify(df, none).collect()} == {"und"}


def test_windows_agree_with_the_uncut_network(spark):
    """Texts of 20,000 words, by windows and by states that are carried over the whole text."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    net = G.fit(docs.where(~G.held_out(docs.doc_id)))
    rows = docs.where("length(text) > 300").orderBy("doc_id").select("text", "lang").collect()
    for lang in ("de", None):
        text = " ".join(" ".join(r.text for r in rows if lang in (r.lang, None)).split()[:20000])
        whole = net.positions(np.frombuffer(G.encoded(text), np.uint8)[None]).mean((0, 1))
        names, scores = net.predict([text])
        assert names == [net.languages[whole.argmax()]] and abs(scores[0] - whole.max()) < 0.01


def test_ties_and_repeated_rows(spark):
    net = G.Network.fresh(["a", "b", "c"])
    net.p = {k: np.zeros_like(v) for k, v in net.p.items()}
    df = spark.createDataFrame([(1, "some text")] * 3, "doc_id long, text string")
    assert [(r.doc_id, r.lang_pred, round(r.score, 5)) for r in G.identify(df, net).collect()] == [(1, "a", 0.33333)] * 3
