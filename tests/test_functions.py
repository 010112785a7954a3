import base64
import datetime as dt
import hashlib

import pytest
from pyspark.sql import functions as F

from sheafline.functions import dates, paths, text
from sheafline.operators import headings, i18n, ordering


def values(spark, rows, expr, schema="s string"):
    df = spark.createDataFrame([(x,) if not isinstance(x, tuple) else x for x in rows], schema).coalesce(1)
    return [r[0] for r in df.select(expr).collect()]


def test_slugs(spark):
    s = F.col("s")
    assert values(spark, ["Hello, World!", "Crème Brûlée", "日本 x", "Größe", "ΔΕΛΤΑ мир", "--a--"], paths.slugify_paths(s)) == ["hello-world", "creme-brulee", "x", "grosse", "delta-mir", "a"]
    assert values(spark, ['a<b>:"c/d|?*\\ . '], paths.slugify_paths(s, "safe")) == ["abcd"]
    assert values(spark, ["a b\tc"], paths.slugify_anchors(s, "off")) == ["a_b_c"]
    assert values(spark, ["Ünïx C++", None], paths.slug_ascii(s)) == ["n-x-c", None]


def test_file_keys(spark):
    s = F.col("s")
    files = ["content/posts/a.fr.md", "content/index.md", "x/content/a/b/_index.md"]
    assert values(spark, files, F.array_join(paths.components(s), "/")) == ["posts", "", "a/b"]
    assert values(spark, files, paths.stem_language(paths.file_stem(s), ["fr"], "en")) == ["fr", "en", "en"]
    assert values(spark, ["a.fr.md", "dir/.fr.md", "a.md", "a.txt"], paths.language_neutral_path(s, ["fr"])) == ["a.md", "dir/.fr.md", "a.md", None]
    assert values(spark, ["img/a.png", "a"], paths.path_with_language(s, "fr", "en")) == ["img/a.fr.png", "a"]


def test_addresses(spark):
    s = F.col("s")
    assert values(spark, ["", "a", "/a/", "atom.xml", "a#b"], paths.make_permalink("https://x.org/", s)) == [f"https://x.org/{t}" for t in ("", "a/", "a/", "atom.xml", "a#b")]
    assert values(spark, ["https://X.org", "http://a.B/c?d#e", "c", " ", "/"], paths.norm_href(s)) == ["https://x.org/", "http://a.b/c/", "/c/", "", "/"]
    assert values(spark, ["/a.PNG?x=1", "/a.html", "/a.woff2#z", "a.pngx"], paths.is_asset_url(s)) == [True, False, True, False]
    assert values(spark, ["a.png", "./a.png", "../a", "a/b", "a#b", "mailto:x", ""], paths.is_colocated_link(s)) == [True, False, False, False, False, False, False]
    assert values(spark, ['<a href="x y">', "<a data-href='no' href='z'>", "<a href=q>", "<a>"], paths.attr_value(s, "href")) == ["x y", "z", "q", None]
    assert values(spark, ["http://h.org", "http://h.org/a/b/"], paths.url_to_content_path(s)) == ["home", "a/b"]


@pytest.mark.parametrize("raw,want", [
    ("2002-12-14", dt.datetime(2002, 12, 14)), ("2001-12-15T02:59:43.1Z", dt.datetime(2001, 12, 15, 2, 59, 43, 100000)), ("2001-12-14 21:59:43.10 -5", dt.datetime(2001, 12, 15, 2, 59, 43, 100000)),
    ("2001-1-2t03:04:05+01:30", dt.datetime(2001, 1, 2, 1, 34, 5)), ("2001-12-15 2:59:43", dt.datetime(2001, 12, 15, 2, 59, 43)), ("2001-13-01", None), ("2001-02-30", None), ("now", None), ("", None)])
def test_dates(spark, raw, want):
    assert values(spark, [raw], F.date_format(dates.parse_datetime(F.col("s")), "yyyy-MM-dd HH:mm:ss.SSSSSS"))[0] == (want and want.strftime("%Y-%m-%d %H:%M:%S.%f"))


def test_own_date_keeps_the_offset(spark):
    got = values(spark, ["2024-01-01T00:30:00+02:00", "x"], dates.own_date(F.col("s")))
    assert (got[0].year, got[0].month, got[0].day) == (2024, 1, 1) and got[1] is None
    assert values(spark, ["2024-05-06"], dates.date_text(dates.parse_datetime(F.col("s")), "%d %B %Y at %H")) == ["06 May 2024 at 00"]


def test_counts_and_times(spark):
    rows = [("a b ```x y``` c", "en"), ("你好 world", "zh-CN"), ("", "fr"), ("don't stop", "en-US")]
    assert values(spark, rows, text.word_count(F.col("s"), F.col("l")), "s string, l string") == [3, 7, 0, 2]
    assert values(spark, [(238, "en"), (239, "en-GB"), (0, "fr"), (440, "zh")], text.reading_minutes(F.col("n"), F.col("l")), "n int, l string") == [1, 2, 0, 2]
    assert values(spark, ["a <b>bold</b> 日本", "x > y", "<unclosed"], text.graph_word_count(F.col("s"))) == [5, 2, 0]
    assert values(spark, ["ar", "en", "he-IL", "mn-Mong"], text.text_direction(F.col("s"))) == ["rtl", "ltr", "rtl", "ltr"]


def test_html(spark):
    s = F.col("s")
    page = "<html><head><TITLE> A &amp;lt; B </TITLE><style>x</style></head><body><h1 class=a>Top <i>x</i></h1><p>one  two</p>\n\n<pre>code</pre><script>s</script><p>three</p></body>"
    assert values(spark, [page], text.html_title(s)) == ["A < B"]
    assert values(spark, [page, "# Mark\n<h1>no</h1>", "none"], text.first_h1(s)) == ["Top x", "Mark", None]
    assert values(spark, [page], text.search_body(s)) == ["A &amp;lt; B Top xone two\nthree"]
    assert values(spark, ["<p>a<b>b</b></p><ul><li>c</li></ul><script>x</script>&amp;"], text.html_to_text(s)) == ["ab\n\nc\n\n&"]
    assert values(spark, [('<h2 id="x-1">', "x-1"), ("<a name=y >", "y"), ('<p id="xx">', "x"), ('<p data-id="x">', "x")], text.has_anchor(F.col("h"), F.col("a")), "h string, a string") == [True, True, False, False]


def test_small_functions(spark):
    s = F.col("s")
    assert values(spark, [1234567, -999, 100000], text.num_format(s, "en"), "s long") == ["1,234,567", "-999", "100,000"]
    assert values(spark, [1234567, 999], text.num_format(s, "en-IN"), "s long") == ["12,34,567", "999"]
    assert values(spark, [1234567], text.num_format(s, "de"), "s long") == ["1.234.567"]
    assert values(spark, ["<a & 'b'>"], text.escape_xml(s)) == ["&lt;a &amp; &#39;b&#39;&gt;"]
    assert values(spark, ["# T\n\n## U\nbody"], text.summarize(s)) == ["T U body"]
    assert values(spark, ["abcdef", "abc"], text.clip(s, 3)) == ["abc…", "abc"]
    assert values(spark, ["x"], text.hash_of(s, 256, False)) == ["2d711642b726b04401627ca9fbac32f5c8530fb1903cc4db02258717921a4881"]
    assert values(spark, ["/Posts/my-page x"], F.array_join(text.path_tokens(s), " ")) == ["posts my page x"]


@pytest.mark.parametrize("op,size,want", [
    ("scale", (300, 200), (40, 60)), ("fit_width", (300, 380), (40, 50)), ("fit_height", (300, 380), (47, 60)), ("fit", (300, 380), (40, 50)), ("fit", (30, 20), (30, 20)), ("fill", (300, 380), (40, 60))])
def test_resize(spark, op, size, want):
    r = spark.createDataFrame([size], "w int, h int").select(text.resize_geometry(op, F.col("w"), F.col("h"), 40, 60).alias("g")).first().g
    assert (r.width, r.height) == want
    if op == "fill":
        assert (r.crop_x, r.crop_y, r.crop_width, r.crop_height) == (23, 0, 253, 380)


def test_natural_order(spark):
    titles = ["bagel", "track_3", "microkernel", "métro", "BART", "Underground", "track_13", "μ-kernel", "meter", "track_1"]
    df = spark.createDataFrame([(t, f"/{i}/") for i, t in enumerate(titles)], "title string, permalink string")
    got, rest = ordering.sort_pages(df, "title")
    assert [r.title for r in got.orderBy("rank").collect()] == ["bagel", "BART", "μ-kernel", "meter", "métro", "microkernel", "track_1", "track_3", "track_13", "Underground"]
    assert rest.count() == 0
    got, rest = ordering.sort_pages(df.limit(0), "title")
    assert got.count() == 0


def test_heading_ids(spark):
    df = spark.createDataFrame([(["a", "a", "a-1", "b", "a"], [None, None, None, "a-2", None])], "s array<string>, e array<string>")
    assert df.select(headings.unique_ids(F.col("s"), F.col("e"))).first()[0] == ["a", "a-1", "a-1-1", "a-2", "a-3"]


def test_translation_gates(spark):
    rows = [("Use `x` <b>now</b> {{ v }}", "Usa `x` <b>ya</b> {{ v }}", []), ("Use `x`", "Usa x", ["code_spans"]), ("<b>a</b> b", "<i>a</i> c", ["tags"]),
            ("Hi {{ name }}", "Hola", ["placeholders"]), ("some lower words here", "some lower words here", ["translated"]), ("Acme rocks", "Mola", ["glossary"]), ("x", " ", ["not_empty"])]
    df = spark.createDataFrame([r[:2] for r in rows], "a string, b string").coalesce(1)
    assert [r.failed for r in i18n.check_translations(df, "a", "b", ["Acme"]).collect()] == [r[2] for r in rows]


def test_segments_join_again(spark):
    t = "# H\n\ntext `a`\n```py\ncode # no\n```\n| a |\n- item\n> q\n1. x\n\ttail"
    df = spark.createDataFrame([(t,), ("",), ("\n\n",)], "t string").coalesce(1).select(i18n.split_segments(F.col("t")).alias("p"))
    got = df.select(i18n.join_segments(F.col("p")), F.transform("p", lambda x: x["kind"])).collect()
    assert [r[0] for r in got] == [t, "", "\n\n"]
    assert got[0][1] == ["heading", "blank", "prose", "code", "code", "code", "table", "list", "quote", "list", "prose"]


def test_batch_reply(spark):
    rows = [('{"translations": ["a"]}', 1), ('{"ok": false, "message": "no"}', 1), ('{"code": 500, "translations": ["a"]}', 1), ('{"translations": ["a"]}', 2), ("x", 1)]
    df = spark.createDataFrame(rows, "r string, n int").coalesce(1).select(i18n.parse_batch_reply(F.col("r"), F.col("n")).alias("x"))
    assert [r.x.error for r in df.collect()] == [None, "not a reply", "code 500", "another number of texts", "not a reply"]


def test_base64_stays_on_one_line(spark):
    long = "https://example.org/" + "a" * 80
    coded = values(spark, [long, None], text.base64_line(F.encode(F.col("s"), "UTF-8")))
    assert coded == [base64.b64encode(long.encode()).decode(), None]
    assert values(spark, ["x"], text.hash_of(F.col("s"), 512)) == [base64.b64encode(hashlib.sha512(b"x").digest()).decode()]
