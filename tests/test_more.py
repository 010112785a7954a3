import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from sheafline.functions import register
from sheafline.operators import images, markdown
from sheafline.plans import catalog
from sheafline.sources import clients, graph_store


def test_markdown(spark):
    body = "Intro[^a] [x](@/a.md#b) ![i](p.png)\n<!-- MORE -->\n# One\n```\n# no [c](d)\n```\n## Two {#two}\n# One\n### *Three*\n`[e](f)` [](  )[^b][^a]\n\n[^a]: note"
    df = spark.createDataFrame([(1, body), (2, "")], "id int, body string")
    h = [(r.pos, r.level, r.title, r.anchor, r.parent_pos) for r in markdown.headings(df, "id", "body").orderBy("pos").collect()]
    assert h == [(0, 1, "One", "one", None), (1, 2, "Two", "two", 0), (2, 1, "One", "one-1", None), (3, 3, "Three", "three", 2)]
    assert [(r.text, r.link) for r in markdown.inline_links(df, "id", "body").orderBy("pos").collect()] == [("x", "@/a.md#b"), ("", "")]
    assert markdown.empty_links(df, "id", "body").count() == 1
    assert [r.name for r in markdown.footnote_references(df, "id", "body").orderBy("pos").collect()] == ["a", "b", "a"]
    assert [r[0] for r in df.coalesce(1).select(markdown.summary(F.col("body"))).collect()] == ["Intro [x](@/a.md#b) ![i](p.png)", None]


def test_boilerplate(spark):
    body = "Blog\n[Home](/) [Blog](/b)\n![l](x.png)Brand\n\n# Title\nText ![a](wp.png)\n![D](/wp-content/litespeed/avatar/x)May\n\n\n\nMore text.\n- [BuilderBuild](u)\nafter"
    df = spark.createDataFrame([(body,), ("",)], "b string").coalesce(1)
    assert [r[0] for r in df.select(markdown.strip_boilerplate(F.col("b"))).collect()] == ["# Title\nText ![a](wp.png)\n\nMore text.", ""]


def test_boilerplate_around_blank_texts_and_texts_with_marks(spark, tmp_path):
    odd = [None, "", " ", "\n", "\u00e9", "a  ", "We use cookies to improve your experience", "x RejectAccept\ny", "Search"]
    docs = spark.createDataFrame([(i, t, "en", "web", 0) for i, t in enumerate(odd)], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got = catalog.QUERIES["md_boilerplate"](spark, str(tmp_path)).select("doc_id", "body").collect()
    assert sorted(map(tuple, got)) == sorted(con.sql(catalog.ORACLES["md_boilerplate"]).select("doc_id", "body").fetchall())


def test_images(spark):
    png = b"\x89PNG\r\n\x1a\n" + b"\0\0\0\rIHDR" + struct.pack(">II", 30, 20)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 5, 9) + b"\0" * 8
    df = spark.createDataFrame([("a.png", png), ("b.jpg", jpg), ("c.svg", b'<svg viewBox="0 0 40 50">'), ("d.gif", b"GIF89a" + struct.pack("<HH", 3, 4)), ("e.bin", b"zz")], "path string, content binary")
    got = {r.path: (r.format, r.width, r.height) for r in images.read_metadata(df).collect()}
    assert got == {"a.png": ("png", 30, 20), "b.jpg": ("jpeg", 9, 5), "c.svg": ("svg", 40, 50), "d.gif": ("gif", 3, 4), "e.bin": (None, None, None)}
    req = spark.createDataFrame([("a.png", 300, 200, "png"), ("a.png", 300, 200, "png"), ("b.jpg", 30, 20, "jpeg")], "path string, width int, height int, format string")
    out = images.plan(req, "fit", 100, 100).collect()
    assert len(out) == 2 and sorted(r.output.rsplit(".", 1)[1] for r in out) == ["jpeg", "png"]
    bad = spark.createDataFrame([("jpeg", 0, "lanczos3"), ("jpeg", 75, "x"), ("png", None, "nearest")], "format string, quality int, filter string")
    assert images.bad_requests(bad).count() == 2


def test_graph_store(spark, tmp_path):
    t = graph_store.load(spark, str(tmp_path))
    assert all(df.count() == 0 for df in t.values())
    graph_store.save({"topics": spark.createDataFrame([("go", "Go")], "id string, label string"), "meta": spark.createDataFrame([(2, "https://x.org", "now")], graph_store.SCHEMAS["meta"])}, str(tmp_path))
    t = graph_store.load(spark, str(tmp_path))
    assert t["topics"].collect()[0].label == "Go" and graph_store.migrated_for(t["meta"], "https://x.org") and not graph_store.migrated_for(t["meta"], "https://y.org")


def test_sql_functions(spark):
    register.register(spark)
    r = spark.sql("SELECT slug_ascii(' A b!') s, escape_xml('<a>') x, reading_minutes(239, 'en-GB') m, is_external_link('http://a') e, content_hash(' a ') h, get_hash('x') g, strip_tags('a<b>c') t").first()
    assert (r.s, r.x, r.m, r.e, r.t) == ("a-b", "&lt;a&gt;", 2, True, "ac") and r.h == spark.sql("SELECT sha2('a', 256) h").first().h and len(r.g) == 64


@pytest.mark.parametrize("send", [None, lambda host, urls: 200])
def test_clients(spark, send):
    urls = spark.createDataFrame([(f"https://X.org/{i}",) for i in range(5)] + [("https://y.org/",), ("https://X.org/1",)], "url string")
    got = clients.submit_urls(urls, "x.org", send, 2).orderBy("batch").collect()
    assert [r.n for r in got] == [2, 2, 1] and {r.status for r in got} == {200 if send else None}
    pages = spark.createDataFrame([("p", "t", "river river bank")], "id string, title string, body string")
    assert clients.extract_topics(pages).count() == 2
    assert [r.label for r in clients.extract_topics(pages, lambda t, b: [("A", ["b", ""]), (" ", [])]).collect()] == ["A"]


def test_stream_keeps_no_table_in_the_driver(spark, sf):
    from sheafline.plans.stream import stream_last_change

    before = {t.name for t in spark.catalog.listTables()}
    out = stream_last_change(spark, sf)
    assert {t.name for t in spark.catalog.listTables()} == before and out.inputFiles()
    assert out.count() == out.select("path").distinct().count() > 0


def test_queries_on_odd_texts_equal_their_sql(spark, tmp_path):
    """Words between letters beyond ASCII, an address of more than 57 bytes, and nulls."""
    texts = ["été été", "éabc éabd", "abc abcé", "abc abd", "ABC", "", None]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "https://example.org/" + "a" * 80, "<p>x"), (2, None, None)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    con = duckdb.connect()
    for name in ("documents", "pages"):
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name in ("prose_filter", "encodings"):
        df = catalog.QUERIES[name](spark, str(tmp_path))
        want = con.sql(catalog.ORACLES[name]).select(*df.columns).fetchall()
        assert sorted(map(str, (tuple(r) for r in df.collect()))) == sorted(map(str, want))
