"""Sorting, siblings, feeds and pagers over documents seen as pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.paths import make_permalink
from ..operators import ordering, paginate
from ..sources.adapters import DOC_PAGES_SQL, doc_pages, table
from .catalog import query

_NAMES = {"date": "published", "updated": "updated", "title": "title", "weight": "weight", "slug": "slug"}


def _sorted(by: str, key: str, order: str, select: str) -> tuple[str, object]:
    sql = DOC_PAGES_SQL + f"""SELECT section, doc_id, CAST(row_number() OVER (PARTITION BY section ORDER BY {order}, path) AS INT) AS rank
      FROM doc_pages WHERE {key} IS NOT NULL"""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        out, _ = ordering.sort_pages(doc_pages(spark, sf_dir).drop("text"), by, "section", "path", **_NAMES)  # what is ranked is written once: without the texts
        return out.select("section", "doc_id", F.col("rank").cast("int").alias("rank"))

    return sql, run


for _name, _by, _key, _order in (
    ("sort_date_permalink", "date", "published", "published DESC"),
    ("sort_update_date", "update_date", "coalesce(published, updated)", "greatest(published, updated) DESC"),
    ("sort_weight", "weight", "weight", "weight"),
    ("sort_title_bytes", "title_bytes", "title", "title"),
    ("sort_permalink", "permalink", "path", "path"),
):
    _sql, _run = _sorted(_by, _key, _order, "")
    query(_name, _sql)(_run)


@query("unsortable_pages", DOC_PAGES_SQL + "SELECT section, count(*) AS n_unsortable, min(doc_id) AS first_id FROM doc_pages WHERE published IS NULL GROUP BY section")
def unsortable_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, rest = ordering.sort_pages(doc_pages(spark, sf_dir), "date", "section", "path", **_NAMES)
    return rest.groupBy("section").agg(F.count("*").alias("n_unsortable"), F.min("doc_id").alias("first_id"))


@query("siblings", DOC_PAGES_SQL + """SELECT section, doc_id, lag(path) OVER w AS lower, lead(path) OVER w AS higher
  FROM doc_pages WHERE published IS NOT NULL WINDOW w AS (PARTITION BY section ORDER BY published DESC, path)""")
def siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.siblings(doc_pages(spark, sf_dir).drop("text"), "date", "section", "path", **_NAMES).select("section", "doc_id", "lower", "higher")


_FEED = "published IS NOT NULL AND NOT hidden AND NOT draft"


def _feed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return doc_pages(spark, sf_dir).where(_FEED)


@query("feed_topk_lang", DOC_PAGES_SQL + f"""SELECT lang, rank, doc_id, title, published FROM (
  SELECT lang, doc_id, title, published, CAST(row_number() OVER (PARTITION BY lang ORDER BY published DESC, path) AS INT) AS rank
  FROM doc_pages WHERE {_FEED}) WHERE rank <= 20""")
def feed_topk_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ordering.top_k(_feed(spark, sf_dir), 20, ordering.order("date", "path", **_NAMES), ["lang"])
    return out.select("lang", "rank", "doc_id", "title", "published")


@query("feed_topk_site", DOC_PAGES_SQL + f"""SELECT CAST(row_number() OVER (ORDER BY published DESC, path) AS INT) AS rank, doc_id, path, published
  FROM doc_pages WHERE {_FEED} ORDER BY published DESC, path LIMIT 50""")
def feed_topk_site(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k(_feed(spark, sf_dir), 50, ordering.order("date", "path", **_NAMES)).select("rank", "doc_id", "path", "published")


@query("feed_topk_section", DOC_PAGES_SQL + f"""SELECT section, rank, doc_id FROM (
  SELECT section, doc_id, CAST(row_number() OVER (PARTITION BY section ORDER BY published DESC, path) AS INT) AS rank FROM doc_pages WHERE {_FEED}) WHERE rank <= 10""")
def feed_topk_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.top_k(_feed(spark, sf_dir), 10, ordering.order("date", "path", **_NAMES), ["section"]).select("section", "rank", "doc_id")


@query("feed_last_updated", DOC_PAGES_SQL + f"""SELECT section, greatest(max(CAST(updated AS VARCHAR)), max(CAST(published AS VARCHAR))) AS last_updated, count(*) AS n_pages
  FROM doc_pages WHERE {_FEED} GROUP BY section""")
def feed_last_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    # the text maximum, over all pages: the feed's limit comes later
    newest = F.max(F.col("published").cast("string"))
    return _feed(spark, sf_dir).groupBy("section").agg(F.greatest(F.max(F.col("updated").cast("string")), newest).alias("last_updated"), F.count("*").alias("n_pages"))


_NATURAL = "array_to_string(list_transform(regexp_extract_all(replace(lower(strip_accents(title)), 'ß', 'ss'), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(CAST(length(regexp_replace(x, '^0+([0-9])', '\\1')) AS VARCHAR), 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '')"


@query("sort_title_natural", DOC_PAGES_SQL + f"SELECT section, doc_id, CAST(row_number() OVER (PARTITION BY section ORDER BY {_NATURAL}, path) AS INT) AS rank FROM doc_pages WHERE title IS NOT NULL")
def sort_title_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = ordering.sort_pages(doc_pages(spark, sf_dir), "title", "section", "path", **_NAMES)
    return out.select("section", "doc_id", F.col("rank").cast("int").alias("rank"))


@query("sort_slug_natural", DOC_PAGES_SQL + "SELECT section, doc_id, CAST(row_number() OVER (PARTITION BY section ORDER BY doc_id) AS INT) AS rank FROM doc_pages")
def sort_slug_natural(spark: SparkSession, sf_dir: str) -> DataFrame:
    out, _ = ordering.sort_pages(doc_pages(spark, sf_dir), "slug", "section", "path", **_NAMES)
    return out.select("section", "doc_id", F.col("rank").cast("int").alias("rank"))


# pagers ---------------------------------------------------------------------------

_PAGERS = DOC_PAGES_SQL + """, ranked AS (SELECT section, doc_id, row_number() OVER (PARTITION BY section ORDER BY published DESC NULLS LAST, path) AS r, count(*) OVER (PARTITION BY section) AS t FROM doc_pages)
SELECT section, doc_id, CAST(floor(({place}) / 10) + 1 AS INT) AS pager, CAST(({place}) % 10 + 1 AS INT) AS place FROM ranked"""


def _sections(spark, sf_dir):
    return doc_pages(spark, sf_dir).select("section").distinct()


def _keys():
    return [F.desc_nulls_last("published"), F.col("path")]


@query("paginate_section", _PAGERS.format(place="r - 1"))
def paginate_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate.fill_pagers(_sections(spark, sf_dir), doc_pages(spark, sf_dir), 10, "section", _keys()).select("section", "doc_id", "pager", "place")


@query("paginate_reversed", _PAGERS.format(place="t - r"))
def paginate_reversed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paginate.fill_pagers(_sections(spark, sf_dir), doc_pages(spark, sf_dir), 10, "section", _keys(), reverse=True).select("section", "doc_id", "pager", "place")


@query("paginate_empty_owner", """SELECT n_nationkey, CAST(coalesce(floor((r - 1) / 5) + 1, 1) AS INT) AS pager, s_suppkey FROM nation LEFT JOIN (
  SELECT s_nationkey, s_suppkey, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS r FROM supplier) ON s_nationkey = n_nationkey""")
def paginate_empty_owner(spark: SparkSession, sf_dir: str) -> DataFrame:
    suppliers = table(spark, sf_dir, "supplier").withColumnRenamed("s_nationkey", "n_nationkey")
    return paginate.fill_pagers(table(spark, sf_dir, "nation"), suppliers, 5, "n_nationkey", [F.desc("s_acctbal"), F.col("s_suppkey")]).select("n_nationkey", "pager", "s_suppkey")


@query("pager_context", """WITH p AS (SELECT o_custkey, CAST(floor((row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey) - 1) / 5) + 1 AS INT) AS pager FROM orders),
g AS (SELECT o_custkey, pager, count(*) AS n, '/c/' || o_custkey || '/' || CASE WHEN pager = 1 THEN '' ELSE 'page/' || pager || '/' END AS url FROM p GROUP BY o_custkey, pager)
SELECT o_custkey, pager, url, first_value(url) OVER w AS first, last_value(url) OVER (PARTITION BY o_custkey ORDER BY pager ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS last,
  lag(url) OVER w AS previous, lead(url) OVER w AS next, CAST(count(*) OVER (PARTITION BY o_custkey) AS INT) AS number_pagers, CAST(sum(n) OVER (PARTITION BY o_custkey) AS BIGINT) AS total_pages
FROM g WINDOW w AS (PARTITION BY o_custkey ORDER BY pager)""")
def pager_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate")
    rows = paginate.fill_pagers(orders.select("o_custkey").distinct(), orders, 5, "o_custkey", [F.desc("o_orderdate"), F.col("o_orderkey")])
    pagers = rows.groupBy("o_custkey", "pager").agg(F.count("o_orderkey").alias("n"))
    pagers = pagers.withColumns({"path": F.concat(F.lit("/c/"), "o_custkey", F.lit("/")), "paginate_path": F.lit("page")})
    return paginate.pager_context(pagers, "o_custkey").select("o_custkey", "pager", "url", "first", "last", "previous", "next", "number_pagers", "total_pages")


@query("batch_chunks", "SELECT CAST(floor((r - 1) / 100) + 1 AS INT) AS chunk, count(*) AS n_urls, min(url) AS first_url, max(url) AS last_url FROM (SELECT url, row_number() OVER (ORDER BY url) AS r FROM (SELECT DISTINCT url FROM pages)) GROUP BY 1")
def batch_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ordering.global_rank(table(spark, sf_dir, "pages").select("url").distinct(), ["url"])
    return ranked.withColumn("chunk", paginate.chunk_number(F.col("rank"), 100)).groupBy("chunk").agg(F.count("*").alias("n_urls"), F.min("url").alias("first_url"), F.max("url").alias("last_url"))


@query("greedy_batches", """WITH RECURSIVE o AS (SELECT source, doc_id, strlen(text) AS size, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS r FROM documents),
f AS (SELECT source, doc_id, size, r, CAST(1 AS INT) AS batch, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS total FROM o WHERE r = 1
  UNION ALL SELECT o.source, o.doc_id, o.size, o.r, CASE WHEN f.n + 1 > 24 OR f.total + o.size > 8192 THEN f.batch + 1 ELSE f.batch END,
    CASE WHEN f.n + 1 > 24 OR f.total + o.size > 8192 THEN 1 ELSE f.n + 1 END, CASE WHEN f.n + 1 > 24 OR f.total + o.size > 8192 THEN o.size ELSE f.total + o.size END
  FROM f JOIN o ON o.source = f.source AND o.r = f.r + 1)
SELECT source, doc_id, batch FROM f""")
def greedy_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("source", "doc_id", F.octet_length("text").cast("long").alias("size"))
    return paginate.greedy_batches(docs, "source", ["doc_id"], "size", 24, 8192).select("source", "doc_id", F.col("batch").cast("int").alias("batch"))


@query("page_batches", """WITH RECURSIVE o AS (SELECT lang, doc_id, 'p' || doc_id // (doc_id % 3 + 1) AS page, strlen(text) // 8 AS size, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS r FROM documents),
f AS (SELECT lang, doc_id, r, CAST(1 AS BIGINT) AS batch, CAST(1 AS BIGINT) AS n, CAST(size AS BIGINT) AS total, [page] AS pages FROM o WHERE r = 1
  UNION ALL SELECT lang, doc_id, r, CASE WHEN over THEN batch + 1 ELSE batch END, CASE WHEN over THEN 1 ELSE n + 1 END, CASE WHEN over THEN size ELSE total + size END, CASE WHEN over THEN [page] ELSE list_distinct(pages || [page]) END
  FROM (SELECT o.lang, o.doc_id, o.r, o.page, o.size, f.batch, f.n, f.total, f.pages, f.n + 1 > 128 OR f.total + o.size > 16384 OR (NOT list_contains(f.pages, o.page) AND len(f.pages) + 1 > 4) AS over FROM f JOIN o ON o.lang = f.lang AND o.r = f.r + 1))
SELECT lang, doc_id, batch FROM f""")
def page_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Batches of texts that hold few distinct pages."""
    k = F.col("doc_id")
    docs = table(spark, sf_dir, "documents").select("lang", "doc_id", F.concat(F.lit("p"), F.floor(k / (k % 3 + 1)).cast("long")).alias("page"), F.floor(F.octet_length("text") / 8).cast("long").alias("size"))
    return paginate.greedy_batches(docs, "lang", ["doc_id"], "size", 128, 16384, "page", 4).select("lang", "doc_id", "batch")


# site map ---------------------------------------------------------------------------

_SITEMAP = DOC_PAGES_SQL + """, parts AS (
  SELECT 'https://example.org' || path AS permalink, CAST(coalesce(updated, published) AS VARCHAR) AS updated, 1 AS prio FROM doc_pages WHERE NOT hidden AND NOT draft
  UNION ALL SELECT 'https://example.org/' || section || '/', NULL, 2 FROM doc_pages GROUP BY section
  UNION ALL SELECT 'https://example.org/' || section || '/page/' || i || '/', NULL, 3 FROM (SELECT section, unnest(range(1, CAST(ceil(count(*) / 20) AS INT) + 1)) AS i FROM doc_pages WHERE NOT hidden AND NOT draft GROUP BY section)
  UNION ALL SELECT 'https://example.org/tags/' || lang || '/', NULL, 4 FROM doc_pages GROUP BY lang),
entries AS (SELECT permalink, updated FROM parts QUALIFY row_number() OVER (PARTITION BY permalink ORDER BY prio, updated) = 1)
"""


def _sitemap(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.publish import sitemap_entries

    pages = doc_pages(spark, sf_dir).where("NOT hidden AND NOT draft")
    every = doc_pages(spark, sf_dir)
    site = lambda c: make_permalink("https://example.org", c)
    counts = pages.groupBy("section").agg(F.ceil(F.count("*") / 20).cast("int").alias("n"))
    none = F.lit(None).cast("string").alias("updated")
    return sitemap_entries([
        pages.select(site(F.col("path")).alias("permalink"), F.coalesce("updated", "published").cast("string").alias("updated")),
        every.select("section").distinct().select(site(F.col("section")).alias("permalink"), none),
        counts.select("section", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i")).select(site(F.concat("section", F.lit("/page/"), F.col("i"))).alias("permalink"), none),
        every.select("lang").distinct().select(site(F.concat(F.lit("tags/"), "lang")).alias("permalink"), none),
    ])


@query("sitemap_entries", _SITEMAP + "SELECT permalink, updated FROM entries")
def sitemap_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sitemap(spark, sf_dir)


@query("sitemap_chunks", _SITEMAP + "SELECT CAST(floor((r - 1) / 300) + 1 AS INT) AS chunk, count(*) AS n, min(permalink) AS first, max(permalink) AS last FROM (SELECT permalink, row_number() OVER (ORDER BY permalink) AS r FROM entries) GROUP BY 1")
def sitemap_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = ordering.global_rank(_sitemap(spark, sf_dir), ["permalink"])
    return ranked.groupBy(paginate.chunk_number(F.col("rank"), 300).alias("chunk")).agg(F.count("*").alias("n"), F.min("permalink").alias("first"), F.max("permalink").alias("last"))
