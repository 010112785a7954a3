import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sheafline.operators import graph, headings, hierarchy, links, ordering, paginate, publish, quality, search, taxonomy


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_hierarchy(spark):
    s = spark.createDataFrame([([], None, False, None), (["a"], True, True, "t"), (["a", "b"], None, True, None), (["a", "b", "d"], False, False, None)],
                              "components array<string>, hidden boolean, transparent boolean, page_template string").withColumn("lang", F.lit("en"))
    s = hierarchy.section_keys(s)
    p = spark.createDataFrame([(1, ["a", "b"], None), (2, ["a", "b", "d"], None), (3, ["x"], None), (4, ["a", "b", "c"], None), (5, ["a"], False)], "id int, components array<string>, hidden boolean").withColumn("lang", F.lit("en"))
    assert rows(hierarchy.resolve_hidden(s).select("section_path", "is_hidden")) == [("", False), ("a", True), ("a/b", True), ("a/b/d", False)]
    assert rows(hierarchy.page_hidden(p, hierarchy.resolve_hidden(s)).select("id", "is_hidden")) == [(1, True), (2, False), (3, False), (4, False), (5, False)]
    assert rows(hierarchy.roll_up(p, s, "id").select("id", "section_path")) == [(1, ""), (1, "a"), (1, "a/b"), (2, "a/b/d"), (5, ""), (5, "a")]
    assert rows(hierarchy.orphans(p, s).select("id")) == [(3,), (4,)]
    assert rows(hierarchy.nearest_setting(p, s, "id", "page_template", True)) == [(1, "t"), (2, "t"), (4, "t"), (5, "t")]
    langs = spark.createDataFrame([("en",), ("fr",)], "lang string")
    assert hierarchy.default_sections(s, langs).where("lang = 'fr'").count() == 1
    assert rows(hierarchy.subsections(s).select("section_path", "child_path")) == [("", "a"), ("a", "a/b"), ("a/b", "a/b/d")]


def test_sections_sort_by_weight_by_default(spark):
    s = spark.createDataFrame([("/b/", 2, "B"), ("/a/", 2, "A"), ("/c/", 1, "C")], "permalink string, weight int, title string")
    assert [r.permalink for r in ordering.sort_sections(s, "date")[0].orderBy("rank").collect()] == ["/c/", "/a/", "/b/"]
    assert [r.title for r in ordering.sort_sections(s, "title")[0].orderBy("rank").collect()] == ["A", "B", "C"]
    assert ordering.sort_pages(s, "none")[1].count() == 0


def test_global_rank(spark):
    df = ordering.global_rank(spark.range(1000).withColumn("k", F.hash("id")), ["k", "id"])
    got = [r["rank"] for r in df.orderBy("k", "id").collect()]
    assert got == list(range(1, 1001))


@pytest.mark.parametrize("partitions", [1, 8, 200])
def test_groups_of_any_size_are_ranked_by_one_plan(spark, partitions):
    """A group of most rows, small ones, a null one, and ties; as a window ranks them, whatever the number of partitions."""
    name = F.when(F.col("id") < 400, "hot").when(F.col("id") % 7 > 0, F.concat(F.lit("g"), F.col("id") % 7))
    df = spark.range(500).select(name.alias("g"), (F.hash("id") % 20).alias("weight"), F.concat(F.lit("/"), "id", F.lit("/")).alias("permalink"))
    w = Window.partitionBy("g").orderBy("weight", "permalink")
    want = rows(df.select("permalink", F.row_number().over(w).alias("rank"))), rows(df.select("permalink", F.lag("permalink").over(w).alias("lower"), F.lead("permalink").over(w).alias("higher")).na.fill("-"))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        got = rows(ordering.sort_pages(df, "weight", "g")[0].select("permalink", "rank")), rows(ordering.siblings(df, "weight", "g").select("permalink", "lower", "higher").na.fill("-"))
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert got == want and len(got[0]) == 500
    assert ordering.sort_pages(df.limit(0), "weight", "g")[0].count() == ordering.siblings(df.limit(0), "weight", "g").count() == 0


def plain_batches(items, most, size, pages):
    """The fold, item by item: [(size, page)] to batch numbers."""
    out, count, total, held = [], 0, 0, set()
    for n, page in items:
        n = n or 0
        if count and (count + 1 > most or total + n > size or (pages and page not in held and len(held) + 1 > pages)):
            count, total, held = 0, 0, set()
        if not count:
            out.append((out[-1] if out else 0) + 1)
        else:
            out.append(out[-1])
        count, total = count + 1, total + n
        held.add(page)
    return out


@pytest.mark.parametrize("most,size,pages", [(3, 12, None), (9, 99, 2), (24, 60, 4), (1, 5, None), (40, 10**9, 3)])
def test_greedy_batches_equal_the_fold(spark, monkeypatch, most, size, pages):
    """A key of half of all items over many ranges, items over the limit, null sizes and a null key."""
    monkeypatch.setattr(paginate, "RANGE", 16)
    rng = random.Random(most)
    keys = ["hot"] * 200 + [rng.choice(["a", "b", None]) for _ in range(150)] + ["one"]
    data = [(k, i, f"p{i // rng.randint(1, 5)}", rng.choice([None, 0, 1, 5, 5, 20, size + 7 if size < 10**9 else 3])) for i, k in enumerate(keys)]
    df = spark.createDataFrame(data, "lang string, i int, page string, size long").repartition(4)
    got = {r.i: r.batch for r in paginate.greedy_batches(df, "lang", ["i"], "size", most, size, "page" if pages else None, pages).collect()}
    want = {}
    for key in set(keys):
        own = [x for x in data if x[0] == key]
        want |= dict(zip([x[1] for x in own], plain_batches([(x[3], x[2]) for x in own], most, size, pages), strict=True))
    assert got == want
    assert paginate.greedy_batches(df.limit(0), "lang", ["i"], "size", most, size).count() == 0


def test_taxonomy(spark):
    p = spark.createDataFrame([("/1/", {"Tags": ["Go", "go"]}, 2), ("/2/", {"tags": ["GO!"]}, 1)], "permalink string, t map<string,array<string>>, date int").withColumn("lang", F.lit("en"))
    m = taxonomy.merge_terms(taxonomy.explode_terms(p, "t"))
    assert [(r.permalink, r.term, r["name"]) for r in m.orderBy("rank").collect()] == [("/2/", "GO!", "GO!"), ("/1/", "Go", "GO!"), ("/1/", "go", "GO!")]
    assert rows(taxonomy.term_counts(taxonomy.explode_terms(p, "t"))) == [("en", "tags", "go", "GO!", 3)]


def test_links(spark):
    html = spark.createDataFrame([(1, '<a href="@/b.md#x">1</a> <A class="k" href="https://E.org/p">2</A><a href="">3</a>')], "id int, html string")
    found = links.extract_links(html, "id", "html")
    assert rows(found) == [(1, 0, "@/b.md#x"), (1, 1, "https://E.org/p"), (1, 2, "")]
    known = spark.createDataFrame([("b.md", "/b/"), ("c d+.md", "/c/")], "file string, permalink string")
    asked = spark.createDataFrame([("@/b.md#x",), ("@/no.md",), ("@/c%20d+.md",)], "link string")
    assert sorted((r.link, r.permalink, r.error is None) for r in links.resolve_internal(asked, known).collect()) == sorted([("@/b.md#x", "/b/#x", True), ("@/c%20d+.md", "/c/", True), ("@/no.md", None, False)], key=str)
    want = spark.createDataFrame([("b.md", "x"), ("b.md", "y"), ("b.md", "z"), ("b.md", "top"), ("b.md", None)], "file string, anchor string")
    heads, pages = spark.createDataFrame([("b.md", "x")], "file string, anchor string"), spark.createDataFrame([("b.md", "<p id='y'>")], "file string, html string")
    assert rows(links.missing_anchors(want, heads, pages).select("anchor")) == [("z",)]
    got = links.check_external(found, lambda u, body: (404, None)).collect()
    assert [(r.url, r.domain, r.ok, r.message) for r in got] == [("https://E.org/p", "e.org", False, "client error status 404")]
    assert rows(links.broken_links(found, links.check_external(found, lambda u, body: (404, None)), "id")) == [(1, "https://E.org/p", "client error status 404")]


def test_external_checks_keep_their_distance(spark, tmp_path):
    """Over two runs each address is called once, calls to a domain keep their spacing, and what a run leaves the next one takes."""
    import json
    import time

    log = tmp_path / "calls"

    def fetch(url, body):
        with open(log, "a") as f:
            f.write(json.dumps([url, time.time()]) + "\n")
        return 200, "<p id='x'>" if body else None

    found = spark.createDataFrame([(f"https://{d}.org/{i}",) for d in "ab" for i in range(7)] + [("https://a.org/0#x",), ("https://a.org/0#y",), ("http://",), ("/site",), ("https://skip.org/",)] * 2, "link string").repartition(3)
    check = lambda: links.check_external(found, fetch, cache=str(tmp_path / "cache"), per_domain=5, spacing=0.2, skip_prefixes=("https://skip",))
    assert check().where("ok IS NULL").count() == 6
    got = {r.url: (r.ok, r.message) for r in check().collect()}
    assert len(got) == 17 and got["https://a.org/0#x"] == (True, "200") and got["https://a.org/0#y"] == (False, "no anchor #y on the page") and got["http://"] == (False, "no host")
    calls = [json.loads(x) for x in log.read_text().splitlines()]
    assert sorted(u for u, _ in calls) == sorted(u for u in got if u != "http://")
    for d in "ab":
        at = sorted(t for u, t in calls if f"{d}.org" in u)
        assert len(at) > 6 and sum(y - x < 0.19 for x, y in zip(at, at[1:], strict=False)) <= 1  # the runs stand apart by themselves


@pytest.mark.parametrize("url,want", [("https://e.org/a#x", True), ("https://e.org/a", False), ("https://e.org/#/x", False), ("https://e.org/#!x", False), ("https://e.org/#", False), ("https://s.org/#x", False)])
def test_fragments_that_name_a_place(url, want):
    assert links.wants_anchor(url, ("https://s.org/",)) is want


def test_publish(spark, tmp_path):
    items = spark.createDataFrame([("en", 2, "B & b", "/b/", "2024-01-01", None, "s"), ("en", 1, "A", "/a/", "2024-01-02", "2024-02-02", None)], "lang string, rank int, title string, permalink string, date string, updated string, summary string")
    items = items.withColumn("date", F.to_timestamp("date"))
    atom = publish.feed_xml(items, "lang", F.lit("Site"), F.lit("/atom.xml"), F.lit("2024-02-02"), "atom").first().content
    assert atom.index("/a/") < atom.index("/b/") and "B &amp; b" in atom and atom.count("<entry") == 2
    rss = publish.feed_xml(items, "lang", F.lit("Site"), F.lit("/rss.xml"), F.lit("x"), "rss").first().content
    assert "Tue, 02 Jan 2024 00:00:00 +0000" in rss
    entries = spark.createDataFrame([(f"/{i}/", None) for i in range(5)], "permalink string, updated string")
    files = {r.path: r.content for r in publish.sitemap_xml(entries, "https://x.org", 2).collect()}
    assert set(files) == {"sitemap.xml", "sitemap1.xml", "sitemap2.xml", "sitemap3.xml"} and files["sitemap.xml"].count("<sitemap>") == 3
    assert [r.path for r in publish.sitemap_xml(entries, "https://x.org", 9).collect()] == ["sitemap.xml"]
    pages = spark.createDataFrame([("/new/", ["/old", "x.html"])], "permalink string, aliases array<string>")
    out = publish.alias_outputs(pages)
    assert sorted(r.path for r in out.collect()) == ["old/index.html", "x.html"]
    publish.write_outputs(out, str(tmp_path))
    assert "url=/new/" in (tmp_path / "old/index.html").read_text()
    old = spark.createDataFrame([("a", 1), ("b", 5)], "rel string, changed int")
    assert rows(publish.stale_files(spark.createDataFrame([("a", 2), ("b", 5), ("c", 0)], "rel string, changed int"), old)) == [("a", 2), ("c", 0)]


def test_graph(spark):
    files = spark.createDataFrame([("blog/a.md", "A", "# Head\ntext", None, None), ("blog/a.fr.md", "A", "# Head\ntext", None, None), ("_index.md", "Home", "", None, None), ("x.md", "—", "t", True, None), ("privacy.md", "P", "t", None, False)],
                                  "rel string, title string, body string, noindex boolean, sitemap_flag boolean")
    f = {r.id: r for r in graph.page_fields(files, ["fr"]).collect()}
    a, fr, home, x, pr = (f[f"content/{n}"] for n in ("blog/a.md", "blog/a.fr.md", "_index.md", "x.md", "privacy.md"))
    assert (a.canonical_path, a.lang, a.h1, a.thin, a.sitemap, a.translation_of, a.summary) == ("/blog/a/", "en", "Head", True, True, None, "Head text")
    assert (fr.canonical_path, fr.lang, fr.translation_of) == ("/fr/blog/a/", "fr", "content/blog/a.md")
    assert (home.stub, home.thin, home.canonical_path) == (False, False, "/") and x.stub and x.noindex and not x.sitemap and not pr.thin and not pr.sitemap
    hidden = {r.id: r.sitemap for r in graph.hide_untranslated(graph.page_fields(files, ["fr"])).collect()}
    assert not hidden["content/blog/a.fr.md"] and hidden["content/blog/a.md"]
    topics = spark.createDataFrame([("go", "Go"), ("go-2", "GO?")], "id string, label string")
    labels = spark.createDataFrame([("go",), ("Go!",), ("New Topic",), ("日本",)], "label string")
    assert rows(graph.new_topic_ids(labels, topics)) == [("Go!", "go-3"), ("New Topic", "new-topic"), ("日本", "topic")]
    gaps = spark.createDataFrame([("x", "X"), ("x-5", "X five"), ("top-10", "Top 10"), ("y", "Y"), ("y-02", "Y 02")], "id string, label string")
    labels = spark.createDataFrame([(x,) for x in ("x!", "x?", "x..", "x .", "x,", "Top", "Y?", "Y 2")], "label string")
    assert rows(graph.new_topic_ids(labels, gaps)) == sorted([("Top", "top"), ("Y 2", "y-2"), ("Y?", "y-3"), ("x .", "x-2"), ("x!", "x-3"), ("x,", "x-4"), ("x..", "x-6"), ("x?", "x-7")])
    assert graph.new_topic_ids(labels.limit(0), gaps).count() == 0 and rows(graph.new_topic_ids(labels.limit(2), gaps.limit(0)).select("id")) == [("x",), ("x-2",)]
    ex = spark.createDataFrame([("content/a.md", "GO", ["New", "go"])], "page string, label string, related array<string>")
    every, rel = graph.merge_extracts(spark.createDataFrame([], "from string, to string, kind string"), topics.where("id = 'go'"), ex)
    assert rows(rel) == [("content/a.md", "go", "about"), ("go", "new", "related")] and rows(every.select("id")) == [("go",), ("new",)]
    v1 = spark.createDataFrame([("https://x.org/a/", 1), ("https://x.org", 2)], "url string, n int")
    pages, edges = graph.upgrade_v1(v1, spark.createDataFrame([("https://x.org/a/", "topic", "about")], "from string, to string, kind string"))
    assert rows(pages.select("id")) == [("content/_index.md",), ("content/a.md",)] and edges.first()["from"] == "content/a.md"


def test_quality(spark):
    pages = spark.createDataFrame([("content/a.md", "/a/", True, False, True, False), ("http://x/b", "b", False, True, True, True)], "id string, canonical_path string, stub boolean, noindex boolean, sitemap boolean, thin boolean")
    found = quality.all_violations(quality.path_ids(pages), quality.sitemap_flags(pages), quality.thin_published(pages))
    assert rows(found.select("code", "page_id")) == [("noindex_in_sitemap", "http://x/b"), ("path_id", "http://x/b"), ("stub_in_sitemap", "content/a.md")]
    heads = spark.createDataFrame([("a", '<link rel="canonical" href="https://X.org/a"><link rel=alternate hreflang=fr href=https://x.org/fr/a/>'), ("f", "<link rel='canonical' href='https://x.org/fr/a/'><link rel='alternate' hreflang='en' href='https://x.org/a/'>"),
                                   ("b", '<link rel="canonical" href="https://y.org/b/"><link rel="alternate" hreflang="en" href="https://x.org/a/">')], "path string, html string")
    assert rows(quality.hreflang_reciprocal(heads).select("page_id")) == [("https://y.org/b/",)]
    site = spark.createDataFrame([("sitemap.xml", "<urlset><url><loc>\n https://X.org/ </loc></url></urlset>")], "path string, html string")
    assert rows(quality.canonical_hosts(heads.unionByName(site)).select("page_id")) == [("b",)] and quality.canonical_hosts(heads).count() == 0
    lines = spark.createDataFrame([("/old /new 301",), ("# no /x",), ("one",)], "value string")
    need = spark.createDataFrame([("/old", "/new/"), ("/z", "/y")], "from string, to string")
    assert rows(quality.missing_redirects(need, need.limit(0), quality.redirects(lines)).select("page_id")) == [("/z/",)]
    html = spark.createDataFrame([("p", '{"@type": "AggregateRating"}'), ("q", "")], "path string, html string")
    claims = spark.createDataFrame([(True, ""), (False, "https://e.org"), (None, None), (True, None)], "allows_aggregate_rating boolean, evidence_url string")
    assert rows(quality.rating_without_claim(html, claims).select("page_id")) == rows(quality.rating_without_claim(html, claims.limit(0)).select("page_id")) == [(None,)]
    assert quality.rating_without_claim(html, claims.unionByName(spark.createDataFrame([(True, "x")], claims.schema))).count() == quality.rating_without_claim(html.where("path = 'q'"), claims).count() == 0


def test_search_and_footnotes(spark):
    docs = spark.createDataFrame([(1, "The quick fox the fox", "/a-b/c"), (2, None, "/x")], "id int, body string, path string")
    ix = search.inverted_index(docs, "id", ["body", "path"], paths=["path"])
    assert ("body", "fox", 1, 2) in rows(ix) and ("path", "b", 1, 1) in rows(ix) and not [r for r in rows(ix) if r[1] == "the"]
    refs = spark.createDataFrame([(1, 0, "b"), (1, 1, "a"), (1, 2, "b")], "page int, pos int, name string")
    assert rows(headings.footnote_numbers(refs, "page").select("pos", "number", "ref")) == [(0, 1, 1), (1, 2, 1), (2, 1, 2)]
