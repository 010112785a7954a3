"""Column functions and output files over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, paths, text
from ..operators import images, ordering, publish
from ..sources import data
from ..sources.adapters import DOC_PAGES_SQL, doc_pages, table
from .catalog import query

_NAMES = {"date": "published", "updated": "updated", "title": "title", "weight": "weight", "slug": "slug"}


@query("slug_titles", "SELECT p_partkey, regexp_replace(regexp_replace(lower(p_name || ' & ' || p_type), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug FROM part")
def slug_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", paths.slugify_paths(F.concat("p_name", F.lit(" & "), "p_type")).alias("slug"))


@query("permalinks", DOC_PAGES_SQL + "SELECT doc_id, 'https://example.org' || path AS permalink, 'https://example.org/feed/' || lang || '.xml' AS feed, CASE WHEN lang = 'en' THEN '' ELSE '/' || lang END || '/tags/' || section || '/' AS term FROM doc_pages")
def permalinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    site = lambda c: paths.make_permalink("https://example.org/", c)
    return doc_pages(spark, sf_dir).select("doc_id", site(F.col("path")).alias("permalink"), site(F.concat(F.lit("feed/"), "lang", F.lit(".xml"))).alias("feed"),
                                           paths.taxonomy_path(F.col("lang"), "en", F.lit("tags"), F.col("section")).alias("term"))


@query("escaped_titles", DOC_PAGES_SQL + "SELECT doc_id, replace(replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;') AS title FROM doc_pages")
def escaped_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).select("doc_id", text.escape_xml(F.col("title")).alias("title"))


@query("clipped_texts", "SELECT doc_id, CASE WHEN length(text) > 200 THEN substring(text, 1, 200) || '…' ELSE text END AS clip FROM documents")
def clipped_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", text.clip(F.col("text"), 200).alias("clip"))


@query("number_formats", "SELECT o_orderkey, format('{:,}', o_orderkey * 12345) AS en, replace(format('{:,}', o_orderkey * 12345), ',', '.') AS de FROM orders")
def number_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("o_orderkey") * 12345
    return table(spark, sf_dir, "orders").select("o_orderkey", text.num_format(n, "en").alias("en"), text.num_format(n, "de").alias("de"))


@query("date_texts", "SELECT o_orderkey, strftime(o_orderdate, '%d.%m.%Y %H:%M') AS shown, o_orderdate < TIMESTAMP '1995-06-17' AS early FROM orders")
def date_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.col("o_orderdate").cast("timestamp")
    return table(spark, sf_dir, "orders").select("o_orderkey", dates.date_text(day, "%d.%m.%Y %H:%M").alias("shown"), dates.before(F.col("o_orderdate").cast("string"), F.lit("1995-06-17")).alias("early"))


@query("parsed_dates", """SELECT event_id, strftime(CASE event_id % 3 WHEN 0 THEN date_trunc('day', ts) WHEN 1 THEN date_trunc('second', ts) ELSE date_trunc('second', ts) - INTERVAL 90 MINUTE END, '%Y-%m-%d %H:%M:%S') AS utc,
  CAST(month(ts) AS INT) AS own_month FROM events""")
def parsed_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as documents write them: a day, a time in UTC, a time with an offset."""
    ts = F.col("ts").cast("timestamp")
    written = F.when(F.col("event_id") % 3 == 0, F.date_format(ts, "yyyy-M-d")).when(F.col("event_id") % 3 == 1, F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(ts, "yyyy-MM-dd HH:mm:ss'+01:30'"))
    out = table(spark, sf_dir, "events").select("event_id", written.alias("w"))
    return out.select("event_id", F.date_format(dates.parse_datetime(F.col("w")), "yyyy-MM-dd HH:mm:ss").alias("utc"), dates.own_date(F.col("w"))["month"].alias("own_month"))


@query("path_tokens", "SELECT page_id, array_to_string(list_filter(regexp_split_to_array(lower(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1)), '[\\s/-]+'), lambda x: x <> ''), ' ') AS tokens FROM pages")
def path_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.array_join(text.path_tokens(F.regexp_extract("url", "^[a-zA-Z]+://[^/?#]*([^?#]*)", 1)), " ").alias("tokens"))


@query("file_hashes", "SELECT page_id, sha256(html) AS sha256, substring(sha256(html), 1, 20) AS cachebust FROM pages")
def file_hashes(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.hash_of(F.col("html"), 256, as_base64=False)
    return table(spark, sf_dir, "pages").select("page_id", h.alias("sha256"), F.substring(h, 1, 20).alias("cachebust"))


@query("json_leaves", "SELECT event_id, 'name' AS path, event_type AS text FROM events UNION ALL SELECT event_id, 'more.list[1]', 'v' || user_id FROM events")
def json_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    extra = F.to_json(F.struct(c("event_type").alias("name"), c("event_id").alias("slug"), F.struct(F.array(F.lit(None).cast("string"), F.concat(F.lit("v"), "user_id")).alias("list")).alias("more")), {"ignoreNullFields": "false"})
    return data.leaves(table(spark, sf_dir, "events").select("event_id", extra.alias("extra")), "event_id", "extra")


@query("feed_files", DOC_PAGES_SQL + """SELECT section, count(*) AS n_entries, string_agg(CAST(doc_id AS VARCHAR), ',' ORDER BY rank) AS ids FROM (
  SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY published DESC, path) AS rank FROM doc_pages WHERE published IS NOT NULL AND NOT hidden AND NOT draft) WHERE rank <= 10 GROUP BY section""")
def feed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Atom files of sections, taken apart again: entries and their order."""
    pages = doc_pages(spark, sf_dir).where("published IS NOT NULL AND NOT hidden AND NOT draft")
    top = ordering.top_k(pages, 10, ordering.order("date", "path", **_NAMES), ["section"])
    items = top.select("section", "rank", "title", F.col("path").alias("permalink"), F.col("published").alias("date"), "updated", F.lit(None).cast("string").alias("summary"))
    files = publish.feed_xml(items, "section", F.col("section"), F.concat(F.lit("/"), "section", F.lit("/atom.xml")), F.max(F.col("date").cast("string")))
    ids = F.regexp_extract_all("content", F.lit("<id>[^<]*/doc-([0-9]+)/</id>"), F.lit(1))
    return files.select("section", F.regexp_count("content", F.lit("<entry")).cast("long").alias("n_entries"), F.array_join(ids, ",").alias("ids"))


_ESCAPED = "replace(replace(replace(replace(replace({}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '''', '&#39;')"


@query("feed_elements", DOC_PAGES_SQL + f"""SELECT kind, section, CASE kind WHEN 'atom' THEN '<?xml version="1.0" encoding="UTF-8"?>' || e || '<feed xmlns="http://www.w3.org/2005/Atom" xml:lang="en">' || e || '<title>Site &amp; Co - ' || section || '</title>' || e || '<subtitle>All of it</subtitle>' || e
    || '<link rel="self" type="application/atom+xml" href="/' || section || '/atom.xml"/>' || e || '<link rel="alternate" type="text/html" href="/' || section || '/"/>' || e || '<generator>sheafline</generator>' || e || '<updated>' || CAST(max(published) AS VARCHAR) || '</updated>' || e || '<id>/' || section || '/atom.xml</id>' || e
    || string_agg('<entry xml:lang="' || lang || '">' || e || '<title>' || title || '</title>' || e || '<published>' || CAST(published AS VARCHAR) || '</published>' || e || '<updated>' || CAST(coalesce(updated, published) AS VARCHAR) || '</updated>' || e
      || CASE doc_id % 3 WHEN 0 THEN '<author><name>A &lt;a&gt;</name>' || e || '</author>' || e || '<author><name>B</name>' || e || '</author>' || e ELSE '<author><name>Desk</name>' || e || '</author>' || e END || '<link rel="alternate" type="text/html" href="' || path || '"/>' || e || '<id>' || path || '</id>' || e
      || CASE WHEN doc_id % 2 = 0 THEN '<summary type="html">' || summary || '</summary>' ELSE '<content type="html" xml:base="' || path || '">' || content || '</content>' END || e || '</entry>', chr(10) ORDER BY rank) || e || '</feed>' || e
  ELSE '<?xml version="1.0" encoding="UTF-8"?>' || e || '<rss xmlns:atom="http://www.w3.org/2005/Atom" version="2.0">' || e || '<channel>' || e || '<title>Site &amp; Co - ' || section || '</title>' || e || '<link>/' || section || '/</link>' || e || '<description>All of it</description>' || e || '<generator>sheafline</generator>' || e || '<language>en</language>' || e
    || '<atom:link href="/' || section || '/atom.xml" rel="self" type="application/rss+xml"/>' || e || '<lastBuildDate>' || CAST(max(published) AS VARCHAR) || '</lastBuildDate>' || e
    || string_agg('<item>' || e || '<title>' || title || '</title>' || e || '<pubDate>' || strftime(published, '%a, %d %b %Y 00:00:00 +0000') || '</pubDate>' || e || '<author>' || CASE doc_id % 3 WHEN 0 THEN 'A &lt;a&gt;' ELSE 'Desk' END || '</author>' || e || '<link>' || path || '</link>' || e || '<guid>' || path || '</guid>' || e
      || '<description xml:base="' || path || '">' || CASE WHEN doc_id % 2 = 0 THEN summary ELSE content END || '</description>' || e || '</item>', chr(10) ORDER BY rank) || e || '</channel>' || e || '</rss>' || e END AS content
FROM (SELECT section, lang, doc_id, path, published, updated, chr(10) AS e, {_ESCAPED.format("coalesce(title, '')")} AS title, {_ESCAPED.format("'<b>' || section || '</b>'")} AS summary, {_ESCAPED.format("coalesce(text, '')")} AS content, row_number() OVER (PARTITION BY section ORDER BY published DESC, path) AS rank
  FROM doc_pages WHERE published IS NOT NULL AND NOT hidden AND NOT draft), (VALUES ('atom'), ('rss')) k(kind) WHERE rank <= 10 GROUP BY kind, section, e""")
def feed_elements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole feeds of sections, both kinds: names, authors, languages, summaries or contents."""
    c = F.col
    pages = doc_pages(spark, sf_dir).where("published IS NOT NULL AND NOT hidden AND NOT draft")
    top = ordering.top_k(pages, 10, ordering.order("date", "path", **_NAMES), ["section"])
    authors = F.when(c("doc_id") % 3 == 0, F.array(F.lit("A <a>"), F.lit("B"))).when(c("doc_id") % 3 == 1, F.array().cast("array<string>"))
    items = top.select("section", "rank", "title", c("path").alias("permalink"), c("published").alias("date"), "updated", "lang", c("text").alias("content"), authors.alias("authors"),
                       F.when(c("doc_id") % 2 == 0, F.concat(F.lit("<b>"), "section", F.lit("</b>"))).when(c("doc_id") % 4 == 1, "").alias("summary"))
    path = lambda name: F.concat(F.lit("/"), "section", F.lit(name))
    both = {kind: publish.feed_xml(items, "section", F.lit("Site & Co"), path("/atom.xml"), F.max(c("date").cast("string")), kind, name=c("section"), subtitle=F.lit("All of it"), home=path("/"), lang=F.lit("en"), author=F.lit("Desk")) for kind in ("atom", "rss")}
    return both["atom"].withColumn("kind", F.lit("atom")).unionByName(both["rss"].withColumn("kind", F.lit("rss")))


@query("alias_redirects", "SELECT 'alias' AS kind, 'old/' || page_id || '/index.html' AS path FROM pages UNION ALL SELECT 'alias', 'p' || page_id || '.html' FROM pages")
def alias_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("url").alias("permalink"), F.array(F.concat(F.lit("/old/"), "page_id"), F.concat(F.lit("p"), "page_id", F.lit(".html"))).alias("aliases"))
    return publish.alias_outputs(pages).select("kind", "path")


@query("output_collisions", "SELECT path, count(*) AS n, string_agg(DISTINCT kind, ',' ORDER BY kind) AS kinds FROM (SELECT 'p' || page_id || '.html' AS path, 'page' AS kind FROM pages UNION ALL SELECT 'p' || page_id * 3 || '.html', 'alias' FROM pages) GROUP BY path HAVING count(*) > 1")
def output_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    name = lambda n: F.concat(F.lit("p"), F.col("page_id") * n, F.lit(".html")).alias("path")
    plan = publish.output_plan({"page": pages.select(name(1)), "alias": pages.select(name(3))})
    return publish.colliding_outputs(plan).select("path", "n", F.array_join("kinds", ",").alias("kinds"))


@query("stale_files", "SELECT o_orderkey AS rel FROM orders WHERE NOT (o_custkey % 2 = 0 AND o_orderdate <= TIMESTAMP '1996-01-01')")
def stale_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    built = orders.where("o_custkey % 2 = 0").select(F.col("o_orderkey").alias("rel"), F.lit("1996-01-01").cast("timestamp_ntz").alias("changed"))
    return publish.stale_files(orders.select(F.col("o_orderkey").alias("rel"), F.col("o_orderdate").alias("changed")), built).select("rel")


@query("resize_plans", """SELECT 'i' || p_partkey || '.png' AS path, CAST(CASE WHEN w <= 120 AND h <= 90 THEN w WHEN w * 90 > h * 120 THEN 120 ELSE w * 90 // h END AS INT) AS width, CAST(CASE WHEN w <= 120 AND h <= 90 THEN h WHEN w * 90 > h * 120 THEN h * 120 // w ELSE 90 END AS INT) AS height
  FROM (SELECT p_partkey, CAST(p_size * 10 AS BIGINT) AS w, CAST(p_partkey % 300 + 5 AS BIGINT) AS h FROM part)""")
def resize_plans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every image is asked for twice and planned once."""
    c = F.col
    req = table(spark, sf_dir, "part").select(F.concat(F.lit("i"), "p_partkey", F.lit(".png")).alias("path"), (c("p_size") * 10).alias("width"), (c("p_partkey") % 300 + 5).cast("int").alias("height"), F.lit("png").alias("format"))
    return images.plan(req.unionByName(req), "fit", 120, 90).select("path", "geometry.width", "geometry.height")


@query("search_files", "SELECT lang, count(*) AS n_documents FROM documents GROUP BY lang")
def search_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Search files of each language, taken apart again; the index proper is `inverted_index`."""
    docs = table(spark, sf_dir, "documents").select("lang", F.concat(F.lit("/doc-"), "doc_id", F.lit("/")).alias("url"), F.substring("text", 1, 40).alias("title"))
    sizes = publish.search_index(docs).select("lang", F.size(F.from_json("content", "array<struct<url:string,title:string>>")).cast("long").alias("n"))
    return sizes.groupBy("lang").agg(F.sum("n").alias("n_documents"))
