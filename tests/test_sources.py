import json

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from sheafline.sources import data, documents
from sheafline.streaming import changes

FILES = {
    "content/_index.md": "+++\ntitle = \"Home\"\nsort_by = \"weight\"\n+++\nhello",
    "content/blog/_index.md": "+++\ntransparent = true\n+++\n",
    "content/blog/2024-03-04-first.md": "+++\ntitle = \"First\"\naliases = [\"old\"]\n[taxonomies]\ntags = [\"a\", \"b\"]\n[extra]\nwhen = 2020-01-01\nn = {x = [1]}\n+++\nBody one\n",
    "content/blog/second.fr.md": "---\ntitle: Deux\ndate: 2020-01-02\npath: /p/deux\nextra:\n  k: [1, 2]\n---\nCorps\n",
    "content/blog/pic/index.md": "+++\ntitle = \"Pic\"\n+++\n",
    "content/bad.md": "no header", "content/bad2.md": "+++\nweight = -1\n+++\n", "content/blog/bad/_index.md": "+++\nfoo = 1\n+++\n", "content/bad3.md": "+++\nslug = \"\"\n+++\n",
}


@pytest.fixture(scope="module")
def parsed(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("site")
    for name, content in FILES.items():
        p = root / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(content, encoding="utf-8")
    (root / "content/.hidden.md").write_text("+++\n+++\n")
    (root / "content/blog/pic/a.png").write_bytes(b"x")
    return documents.parse_documents(documents.scan_files(spark, str(root))), root


def test_scan_and_parse(parsed):
    rows = {r.file: r for r in parsed[0].collect()}
    assert set(rows) == set(FILES)
    bad = {f for f, r in rows.items() if r.error}
    assert bad == {f for f in FILES if "bad" in f} and "unknown field foo" in rows["content/blog/bad/_index.md"].error
    first = rows["content/blog/2024-03-04-first.md"]
    assert first.title == "First" and first.aliases == ["old"] and first.taxonomies == {"tags": ["a", "b"]} and first.render and not first.draft and first.hidden is None and first.body == "Body one\n"
    assert json.loads(first.extra) == {"when": "2020-01-01", "n": {"x": [1]}}
    home = rows["content/_index.md"]
    assert home.is_section and home.sort_by == "weight" and home.weight == 0 and home.paginate_path == "page" and home.transparent is False
    with pytest.raises(ValueError, match="bad2"):
        documents.raise_errors(parsed[0])


def test_keys(parsed):
    good = documents.with_keys(parsed[0].where("error IS NULL"), ["fr"])
    rows = {r.file: r for r in good.collect()}
    first, second, pic = rows["content/blog/2024-03-04-first.md"], rows["content/blog/second.fr.md"], rows["content/blog/pic/index.md"]
    assert (first.date, first.slug, first.url_path, first.lang) == ("2024-03-04", "first", "/blog/first/", "en")
    assert (second.lang, second.url_path, second.canonical, second.permalink) == ("fr", "/p/deux/", "blog/second", "https://example.org/p/deux/")
    assert (pic.url_path, pic.components, pic.slug) == ("/blog/pic/", ["blog"], "pic")
    assert rows["content/blog/_index.md"].url_path == "/blog/" and rows["content/_index.md"].url_path == "/"


def test_assets_and_search(spark, parsed):
    files = spark.createDataFrame([(f,) for f in ["c/p/index.md", "c/p/a.png", "c/p/sub/b.jpg", "c/p/x.md", "c/p/.y", "c/q/z.png", "static/s.css"]], "file string")
    assert sorted(tuple(r) for r in documents.colocated_assets(files).collect()) == [("c/p/index.md", "a.png", "c/p/a.png"), ("c/p/index.md", "sub/b.jpg", "c/p/sub/b.jpg")]
    wanted = spark.createDataFrame([("s.css",), ("@/p/a.png",), ("../etc",), ("none",)], "path string")
    assert {r.path: r.file for r in documents.first_existing(wanted, files, ["", "static", "c"]).collect()} == {"s.css": "static/s.css", "@/p/a.png": "c/p/a.png", "../etc": None, "none": None}
    both = spark.createDataFrame([("a/index.md",), ("a/_index.md",), ("b/index.md",)], "file string")
    assert [r.dir for r in documents.index_beside_section(both).collect()] == ["a"]


def test_changes_between_snapshots(spark):
    a = spark.createDataFrame([("x.md", "1"), ("y.fr.md", "1"), ("z.md", "1")], "file string, content string")
    b = spark.createDataFrame([("x.md", "1"), ("y.fr.md", "2"), ("n.md", "1")], "file string, content string")
    changed = documents.changed_files(a, b)
    assert sorted(tuple(r) for r in changed.collect()) == [("n.md", "create"), ("y.fr.md", "modify"), ("z.md", "remove")]
    pages = spark.createDataFrame([("y.md", "/y/"), ("y.fr.md", "/fr/y/"), ("x.md", "/x/")], "file string, permalink string")
    urls, rest = documents.url_family(changed, pages, ["fr"])
    assert sorted(r.url for r in urls.collect()) == ["/fr/y/", "/y/"] and sorted(r.file for r in rest.collect()) == ["n.md", "z.md"]


DATA = {
    "a.json": '{"key": "v", "arr": [1, 2]}', "a.yaml": "key: v\narr:\n  - 1\n  - 2\n", "a.toml": 'key = "v"\ndate = 1979-05-27T07:32:00Z\n', "a.csv": "Number,Title\n1,G\n2,\"a,b\"\n", "uneven.csv": "a,b\n1\n",
    "a.xml": "<root><key>v</key><array>1</array><array>2</array></root>", "a.bib": "@article{k, Title = {T {X}}, year = 2020}", "a.css": ".x{}", "bad.json": "{", "none.json": None}


def test_load_data(spark):
    df = spark.createDataFrame(list(DATA.items()), "file string, content string")
    rows = {r.file: r for r in data.load_data(df).select("file", F.to_json("data").alias("json"), "error").collect()}
    value = {f: json.loads(r.json) if r.json else None for f, r in rows.items()}
    assert value["a.json"] == value["a.yaml"] == {"key": "v", "arr": [1, 2]}
    assert value["a.toml"] == {"key": "v", "date": "1979-05-27T07:32:00+00:00"} and value["a.csv"] == {"headers": ["Number", "Title"], "records": [["1", "G"], ["2", "a,b"]]}
    assert value["a.xml"] == {"root": {"key": "v", "array": ["1", "2"]}} and value["a.bib"]["bibliographies"] == [{"entry_type": "article", "citation_key": "k", "tags": {"title": "T X", "year": "2020"}}]
    assert value["a.css"] == ".x{}" and {f for f, r in rows.items() if r.error} == {"uneven.csv", "bad.json", "none.json"}
    assert data.load_data(df.where("file = 'none.json'"), required=False).first().error is None


def test_leaves(spark):
    df = spark.createDataFrame([(1, '{"a": "x", "b": {"c": ["y", {"d": "z"}]}, "slug": "no", "n": 1}'), (2, "{}")], "id int, extra string")
    assert sorted(tuple(r) for r in data.leaves(df, "id", "extra").collect()) == [(1, "a", "x"), (1, "b.c[0]", "y"), (1, "b.c[1].d", "z")]
    v = df.where("id = 1").select(F.parse_json("extra").alias("v"))
    assert v.select(data.leaf(F.col("v"), "b.c[1].d"), data.string_list(F.col("v"), "a"), data.string_list(F.col("v"), "zz")).first()[:] == ("z", ["x"], [])


def test_merge_tables():
    assert data.merge_tables({"a": 1, "t": {"x": 1}}, {"a": 2, "t": {"x": 2, "y": 3}, "z": 4}) == {"a": 1, "t": {"x": 1, "y": 3}, "z": 4}
    with pytest.raises(ValueError):
        data.merge_tables({"a": 1}, {"a": {}})


def test_site_maps(spark):
    site = {"r": "<sitemapindex><sitemap><loc>s1</loc></sitemap><sitemap><loc>r</loc></sitemap></sitemapindex>", "s1": "<urlset><url><loc> /a?x=1&amp;y </loc></url><url><loc>/b</loc></url></urlset>"}
    assert sorted(r.url for r in documents.discover_urls(spark, ["r"], site.get).collect()) == ["/a?x=1&y", "/b"]
    got = documents.fetch_pages(spark.createDataFrame([("u",), ("e",)], "url string"), lambda u: "<p>" if u == "u" else "").collect()
    assert sorted((r.url, r.html, r.error) for r in got) == [("e", "", "empty body"), ("u", "<p>", None)]


def test_change_events(spark):
    rows = [(1, "/content/a.md", "create.file"), (2, "/content/a.md", "modify.data"), (3, "/content/a.md", "access"), (1, "/content/b.md~", "modify"), (1, "/readme.txt", "modify"), (1, "/config.toml", "modify"), (5, "/static/x.png", "remove.file"), (1, "/data/x.json", "create")]
    df = spark.createDataFrame(rows, "ts int, path string, raw string")
    last = changes.last_changes(changes.meaningful(df))
    assert sorted((r.path, r.kind, r.change_kind) for r in last.collect()) == [("/config.toml", "modify", "config"), ("/content/a.md", "modify", "content"), ("/data/x.json", "create", "extra"), ("/static/x.png", "remove", "static")]
    assert {(r.change_kind, r.action) for r in changes.rebuild_plan(last).collect()} == {("config", "full"), ("content", "partial"), ("extra", "partial"), ("static", "copy")}


def test_stream_of_files(spark, tmp_path):
    src, seen = tmp_path / "in", {}
    spark.createDataFrame([(1, "/content/a.md", "create"), (2, "/content/a.md", "remove")], "ts int, path string, raw string").write.parquet(str(src))

    def apply(df, n):
        seen.update({r.path: r.kind for r in df.collect()})

    q = changes.apply_stream(changes.stream_table(spark, str(src), "ts int, path string, raw string"), apply, str(tmp_path / "state"))
    q.awaitTermination()
    assert seen == {"/content/a.md": "remove"}
    state = spark.createDataFrame([("a", 1), ("b", 1)], "k string, v int")
    new = changes.upsert(state, spark.createDataFrame([("b", 2), ("c", 3)], "k string, v int"), spark.createDataFrame([("a",)], "k string"), "k")
    assert sorted(tuple(r) for r in new.collect()) == [("b", 2), ("c", 3)]


def test_headers_of_a_batch_are_read_in_slices(spark, monkeypatch):
    """A task holds about HELD_BYTES of text as objects, whatever Spark puts into a batch; rows and their order stay."""
    monkeypatch.setattr(documents, "HELD_BYTES", 100)
    contents = [("x" * 40) if i % 3 else None for i in range(10)] + ["y" * 300, "z"]
    batch = pa.RecordBatch.from_pydict({"file": [f"{i}.md" for i in range(12)], "content": pa.array(contents, pa.string())})
    parts = list(documents.slices(batch, 1))
    assert pa.Table.from_batches(parts) == pa.Table.from_batches([batch]) and [p.num_rows for p in parts] == [4, 3, 3, 1, 1]
    assert list(documents.slices(batch.slice(0, 0), 1)) == []
    handed = []
    fake = type("Rows", (), {"select": lambda self, *_: self, "mapInArrow": lambda self, run, schema: handed.append(run)})()
    documents.parse_documents(fake)
    out = list(handed[0](iter([batch])))
    assert [o.num_rows for o in out] == [4, 3, 3, 1, 1] and [f for o in out for f in o.column(0).to_pylist()] == batch.column(0).to_pylist()
