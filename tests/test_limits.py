"""Depths, lengths and rules without a limit of their own."""
import json

import pytest
from pyspark.sql import functions as F

from sheafline.functions import text
from sheafline.operators import ordering, quality
from sheafline.sources import data, documents, shared


def test_site_maps_listed_fifteen_levels_down(spark):
    site = {f"/m{i}": f"<sitemapindex><loc>/m{i + 1}</loc><loc>/m0</loc></sitemapindex>" for i in range(15)} | {"/m15": "<urlset><loc>/page</loc></urlset>"}
    assert [r.url for r in documents.discover_urls(spark, ["/m0"], site.get).collect()] == ["/page"]


def test_leaves_fifteen_levels_down(spark):
    value = {"last": "x", "slug": "y"}
    for _ in range(15):
        value = {"n": [value]}
    rows = data.leaves(spark.createDataFrame([(1, json.dumps(value)), (2, "{}"), (3, "[]")], "id int, extra string"), "id", "extra").collect()
    assert [tuple(r) for r in rows] == [(1, ".".join(["n[0]"] * 15) + ".last", "x")]


def test_underscored_files_and_folders_at_any_depth(spark, tmp_path):
    deep = tmp_path.joinpath(*[f"d{i}" for i in range(15)])
    (deep / "_hidden" / "more").mkdir(parents=True)
    for name in ("_index.md", "plain.md", "_hidden/a.md", "_hidden/more/_b.md"):
        (deep / name).write_text(name)
    found = {r.file.rsplit("d14/", 1)[1]: r.content for r in documents.scan_files(spark, str(tmp_path)).collect()}
    assert found == {n: n for n in ("_index.md", "plain.md", "_hidden/a.md", "_hidden/more/_b.md")}


def test_long_digit_runs_sort_by_value(spark):
    titles = ["a" + "9" * 21, "a" + "1" + "0" * 29, "a0005", "a" + "8" * 25, "a40"]
    rows = ordering.sort_pages(spark.createDataFrame([(t, t) for t in titles], "title string, permalink string"), "title")[0].orderBy("rank").collect()
    assert [r.title for r in rows] == ["a0005", "a40", "a" + "9" * 21, "a" + "8" * 25, "a" + "1" + "0" * 29]


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Session())


def test_authors_of_articles(spark):
    pages = spark.createDataFrame([("a", ["Article"], None), ("b", ["BlogPosting"], "person:ghost"), ("c", ["Article"], "person:x"), ("d", ["WebPage"], None), ("e", None, None), ("f", ["Article"], "")],
                                  "id string, schema_types array<string>, author string")
    persons = spark.createDataFrame([("person:x", "X"), ("", "nobody")], "id string, name string")
    assert sorted(r.page_id for r in quality.missing_person(pages, persons).collect()) == ["a", "b", "f"]


@pytest.mark.parametrize("size,crop", [((300, 380), (23, 0, 253, 380)), ((80, 118), (None,) * 4), ((80, 100), (6, 0, 67, 100))])
def test_fill_cuts_only_what_differs(spark, size, crop):
    g = spark.createDataFrame([size], "w int, h int").select(text.resize_geometry("fill", F.col("w"), F.col("h"), 40, 60).alias("g")).first().g
    assert (g.width, g.height) == (40, 60) and (g.crop_x, g.crop_y, g.crop_width, g.crop_height) == crop


def test_locales(spark):
    one = lambda locale: spark.range(1).select(text.num_format(F.lit(1234567), locale)).first()[0]
    assert (one("en"), one("de"), one("hi-IN"), one("da")) == ("1,234,567", "1.234.567", "12,34,567", "1.234.567")
    with pytest.raises(ValueError):
        one("qq")
