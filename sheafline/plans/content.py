"""Texts, pages and links: counts, cleaning, addresses, hashes."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, text
from ..operators import links
from ..sources.adapters import table
from ..sources.shared import shared_dir
from .catalog import query

#: A word that both engines find alike.
_WORD = "[A-Za-zÀ-ÖØ-öø-ÿ0-9_]+"


def _docs(spark, sf_dir):
    return table(spark, sf_dir, "documents")


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "pages")


@query("word_count", f"SELECT doc_id, CAST(len(regexp_extract_all(text, '{_WORD}')) AS INT) AS n_words FROM documents")
def word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.word_count(F.col("text"), pattern=_WORD).alias("n_words"))


@query("reading_time", f"""SELECT doc_id, lang, CAST(ceil(len(regexp_extract_all(text, '{_WORD}')) / CAST(CASE lang WHEN 'en' THEN 238 WHEN 'ko' THEN 202 ELSE 200 END AS DOUBLE)) AS BIGINT) AS minutes FROM documents""")
def reading_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = text.word_count(F.col("text"), F.col("lang"), _WORD)
    return _docs(spark, sf_dir).select("doc_id", "lang", text.reading_minutes(n, F.col("lang")).alias("minutes"))


_GRAPH_COUNT = "len(list_filter(regexp_split_to_array(replace(regexp_replace(text, '<[^>]*(>|$)', '', 'g'), '>', ''), '[\\s]+'), lambda w: w <> ''))"


@query("graph_word_count", f"SELECT doc_id, CAST({_GRAPH_COUNT} AS INT) AS n_words FROM documents")
def graph_word_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.graph_word_count(F.col("text")).alias("n_words"))


@query("thin_pages", f"SELECT doc_id, CAST({_GRAPH_COUNT} AS INT) AS n_words FROM documents WHERE trim(text) <> '' AND {_GRAPH_COUNT} < 300")
def thin_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = _docs(spark, sf_dir).where(text.trim_all(F.col("text")) != "").select("doc_id", text.graph_word_count(F.col("text")).alias("n_words"))
    return counted.where("n_words < 300")


@query("stub_pages", "SELECT doc_id, title FROM (SELECT doc_id, CASE WHEN doc_id % 31 = 0 THEN '—' WHEN doc_id % 37 = 0 THEN '' ELSE substring(text, 1, 40) END AS title, text FROM documents) WHERE title IN ('', '—') OR trim(text) = ''")
def stub_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.graph import is_stub

    titled = _docs(spark, sf_dir).withColumn("title", F.when(F.col("doc_id") % 31 == 0, "—").when(F.col("doc_id") % 37 == 0, "").otherwise(F.substring("text", 1, 40)))
    return titled.where(is_stub(F.col("title"), F.col("text"), F.concat(F.lit("doc-"), "doc_id", F.lit(".md")))).select("doc_id", "title")


@query("page_summary", "SELECT doc_id, substring(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: trim(regexp_replace(trim(x), '^#+', ''))), lambda x: x <> ''), ' '), 1, 160) AS summary FROM documents")
def page_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.summarize(F.col("text")).alias("summary"))


@query("content_hash", "SELECT doc_id, sha256(regexp_replace(regexp_replace(text, '^\\s+', ''), '\\s+$', '')) AS content_hash FROM documents")
def content_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", text.content_hash(F.col("text")).alias("content_hash"))


@query("page_titles", "SELECT page_id, replace(replace(replace(replace(regexp_replace(regexp_replace(regexp_extract(html, '<title>([^<]*)</title>', 1), '^\\s+', ''), '\\s+$', ''), '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"') AS title FROM pages")
def page_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.html_title(F.col("html")).alias("title"))


@query("page_h1", "SELECT page_id, nullif(regexp_replace(regexp_replace(regexp_extract(html, '<h1[^>]*>([^<]*)</h1>', 1), '^\\s+', ''), '\\s+$', ''), '') AS h1 FROM pages")
def page_h1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.first_h1(F.col("html")).alias("h1"))


_BODY = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<script\\b.*?</script\\s*>', '', 'g'), '(?is)<style\\b.*?</style\\s*>', '', 'g'), '(?is)<pre\\b.*?</pre\\s*>', '', 'g'), '(?s)<!--.*?-->', '', 'g')"


@query("search_body", f"""SELECT page_id, array_to_string(list_filter(list_transform(string_split(replace(regexp_replace({_BODY}, '<[^>]*(>|$)', '', 'g'), '>', ''), chr(10)),
  lambda x: trim(regexp_replace(x, '\\s+', ' ', 'g'))), lambda x: x <> ''), chr(10)) AS body FROM pages""")
def search_body(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.search_body(F.col("html")).alias("body"))


def _html_text_sql() -> str:
    out = r"regexp_replace(regexp_replace(html, '(?is)<script\b.*?(</script>|$)', '', 'g'), '(?is)<style\b.*?(</style>|$)', '', 'g')"
    out = f"regexp_replace({out}, '[ \\t\\n\\x0b\\f\\r]+', ' ', 'g')"
    out = f"regexp_replace({out}, '(?i)</?({'|'.join(text.BLOCKS)})(\\s[^>]*)?/?>', chr(10) || chr(10), 'g')"
    out = f"regexp_replace({out}, '<[^>]*>', '', 'g')"
    for name, value in text.PAGE_ENTITIES.items():
        out = f"replace({out}, '{name}', '{value.replace(chr(39), chr(39) * 2)}')"
    out = f"regexp_replace(regexp_replace({out}, ' *\\n *', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    return f"SELECT page_id, regexp_replace(regexp_replace({out}, '^\\s+', ''), '\\s+$', '') AS text FROM pages"


@query("html_to_text", _html_text_sql())
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).select("page_id", text.html_to_text(F.col("html")).alias("text"))


_URL = "^[a-zA-Z][a-zA-Z0-9+.-]*://"
_HOST = f"nullif(lower(regexp_extract(url, '{_URL}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '')"
_PATH = f"CASE WHEN regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1) = '' THEN '/' ELSE regexp_extract(url, '{_URL}[^/?#]*([^?#]*)', 1) END"


@query("normalized_urls", f"""SELECT page_id, lower(regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*)://', 1)) || '://' || {_HOST} || CASE WHEN ends_with({_PATH}, '/') THEN {_PATH} ELSE {_PATH} || '/' END AS href, {_HOST} AS host,
  CASE WHEN trim({_PATH}, '/') = '' THEN 'home' ELSE trim({_PATH}, '/') END AS content_path FROM pages""")
def normalized_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    return _pages(spark, sf_dir).select("page_id", paths.norm_href(url).alias("href"), paths.url_host(url).alias("host"), paths.url_to_content_path(url).alias("content_path"))


@query("neutral_path", "SELECT page_id, regexp_replace(p, '([^/])\\.(?:de|es|fr)\\.md$', '\\1.md') AS neutral FROM (SELECT page_id, 'content/p' || page_id % 40 || '.' || (['en', 'de', 'es', 'fr'])[CAST(page_id % 4 AS INT) + 1] || '.md' AS p FROM pages)")
def neutral_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = F.element_at(F.array(*map(F.lit, ("en", "de", "es", "fr"))), (F.col("page_id") % 4 + 1).cast("int"))
    p = F.concat(F.lit("content/p"), F.col("page_id") % 40, F.lit("."), code, F.lit(".md"))
    return _pages(spark, sf_dir).select("page_id", paths.language_neutral_path(p, ["de", "es", "fr"]).alias("neutral"))


@query("asset_url_filter", "SELECT page_id, url FROM pages WHERE NOT regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '\\.(ico|png|jpg|jpeg|gif|webp|svg|avif|css|js|json|xml|pdf|zip|mp4|webm|woff|woff2|ttf)$')")
def asset_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pages(spark, sf_dir).where(~paths.is_asset_url(F.col("url"))).select("page_id", "url")


@query("host_filter", f"SELECT page_id, CASE WHEN regexp_matches(url, '^https?:') AND coalesce(ends_with({_HOST}, 'example.com'), false) THEN 'kept' ELSE 'skipped' END AS verdict FROM pages")
def host_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = paths.is_external_link(F.col("url")) & F.coalesce(paths.url_host(F.col("url")).endswith("example.com"), F.lit(False))
    return _pages(spark, sf_dir).select("page_id", F.when(own, "kept").otherwise("skipped").alias("verdict"))


# links ------------------------------------------------------------------------------

_LINKS = """WITH l AS (SELECT page_id, url, CAST(i - 1 AS INT) AS pos, a[i] AS link FROM (
  SELECT page_id, url, a, unnest(range(1, len(a) + 1)) AS i FROM (SELECT page_id, url, regexp_extract_all(html, '(?i)<a\\s[^>]*?href="([^"]*)"', 1) AS a FROM pages)))
"""
_CLASS = "CASE WHEN link = '' THEN 'empty' WHEN starts_with(link, '@/') THEN 'internal' WHEN starts_with(link, 'mailto:') THEN 'email' WHEN starts_with(link, '#') THEN 'anchor' WHEN regexp_matches(link, '^https?:') THEN 'external' WHEN starts_with(link, '/') THEN 'site' WHEN NOT (contains(link, '/') OR contains(link, '..') OR contains(link, '#') OR regexp_matches(link, '^[a-zA-Z][a-zA-Z0-9+.-]*:')) THEN 'colocated' ELSE 'other' END"
_ABSOLUTE = "CASE WHEN starts_with(link, '/') THEN regexp_extract(url, '^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)', 1) || link ELSE link END"


def _links(spark, sf_dir):
    pages = _pages(spark, sf_dir)
    return links.extract_links(pages.withColumn("key", F.struct("page_id", "url")), "key", "html").select("key.page_id", "key.url", "pos", "link")


@query("links_extracted", _LINKS + "SELECT page_id, pos, link FROM l")
def links_extracted(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).select("page_id", "pos", "link")


@query("links_classified", _LINKS + f"SELECT {_CLASS} AS class, count(*) AS n_links, count(DISTINCT link) AS n_distinct FROM l GROUP BY 1")
def links_classified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _links(spark, sf_dir).groupBy(links.link_class(F.col("link")).alias("class")).agg(F.count("*").alias("n_links"), F.countDistinct("link").alias("n_distinct"))


@query("backlinks", _LINKS + "SELECT link, page_id, count(*) OVER (PARTITION BY link) AS n_sources FROM (SELECT DISTINCT page_id, link FROM l)")
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.backlinks(_links(spark, sf_dir), "page_id", "link")


@query("external_by_domain", _LINKS + f", x AS (SELECT {_ABSOLUTE} AS u FROM l) SELECT nullif(lower(regexp_extract(u, '{_URL}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS domain, count(*) AS n_links, count(DISTINCT u) AS n_urls FROM x WHERE regexp_matches(u, '^https?:') GROUP BY 1")
def external_by_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _links(spark, sf_dir).withColumn("link", paths.join_url(F.col("url"), F.col("link")))
    return links.domain_groups(whole)


@query("external_check", _LINKS + f", x AS (SELECT DISTINCT {_ABSOLUTE} AS url FROM l) SELECT url, nullif(lower(regexp_extract(url, '{_URL}(?:[^/?#@]*@)?([^/?#:]*)', 1)), '') AS domain, true AS ok, 'not asked' AS message FROM x WHERE regexp_matches(url, '^https?:')")
def external_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    whole = _links(spark, sf_dir).withColumn("link", paths.join_url(F.col("url"), F.col("link")))
    return links.check_external(whole)


def _fetch(url: str, body: bool) -> tuple[int, str | None]:
    """A site whose answers depend on how long an address is; nothing leaves the machine."""
    n = len(url) % 7
    if n == 0:
        raise OSError("no answer")
    status = {1: 404, 2: 503, 3: 304, 4: 302}.get(n, 200)
    return status, "<p class=x id=there>" if body else None


_ASKED = "SELECT DISTINCT 'https://' || lang || '.example.org/' || source || '/' || doc_id || CASE doc_id % 4 WHEN 0 THEN '' WHEN 1 THEN '#there' WHEN 2 THEN '#gone' ELSE '#!gone' END AS url, lang || '.example.org' AS domain, lang = 'de' AS plain FROM documents"


@query("external_results", f"""WITH a AS ({_ASKED}), r AS (SELECT *, length(url) % 7 AS n, row_number() OVER (PARTITION BY domain ORDER BY url) AS turn FROM a)
SELECT url, domain, CASE WHEN turn > 60 THEN NULL ELSE n NOT IN (0, 1, 2, 4) AND (plain OR NOT contains(url, '#gone')) END AS ok,
  CASE WHEN turn > 60 THEN NULL WHEN n = 0 THEN 'no answer' WHEN n = 1 THEN 'client error status 404' WHEN n = 2 THEN 'server error status 503' WHEN n = 4 THEN 'redirection status 302'
    WHEN NOT plain AND contains(url, '#gone') THEN 'no anchor #gone on the page' WHEN n = 3 THEN '304' ELSE '200' END AS message, CASE WHEN turn > 60 THEN 0 ELSE 1 END AS calls FROM r""")
def external_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two runs of at most thirty addresses a domain over one cache: what they have asked, once each, and what is left."""
    k = F.col("doc_id")
    tail = F.when(k % 4 == 0, "").when(k % 4 == 1, "#there").when(k % 4 == 2, "#gone").otherwise("#!gone")
    found = table(spark, sf_dir, "documents").select(F.concat(F.lit("https://"), "lang", F.lit(".example.org/"), "source", F.lit("/"), k, tail).alias("link"))
    cache = f"{shared_dir(spark)}/link-answers-{uuid.uuid4().hex}"
    run = lambda: links.check_external(found, _fetch, cache=cache, per_domain=30, spacing=0.001, skip_anchor_prefixes=("https://de.example.org/",))
    run()
    results = run()
    calls = spark.read.parquet(cache).groupBy("url").agg(F.count("*").cast("int").alias("calls"))
    return results.join(calls, "url", "left").select("url", "domain", "ok", "message", F.coalesce("calls", F.lit(0)).alias("calls"))


@query("links_skipped_prefix", _LINKS + "SELECT page_id, pos, link FROM l WHERE NOT (starts_with(link, '/the') OR starts_with(link, '/of'))")
def links_skipped_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return links.skip_links(_links(spark, sf_dir), ["/the", "/of"]).select("page_id", "pos", "link")


@query("missing_targets", _LINKS + ", t AS (SELECT DISTINCT lower(trim(link, '/')) AS slug FROM l WHERE starts_with(link, '/')) SELECT slug FROM t WHERE slug NOT IN (SELECT lower(regexp_extract(text, '^([^ .,]*)', 1)) FROM documents)")
def missing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Site links whose slug opens no document: an anti join."""
    slug = F.lower(F.regexp_replace("link", "^/+|/+$", ""))
    asked = _links(spark, sf_dir).where(F.col("link").startswith("/")).select(slug.alias("slug")).distinct()
    known = _docs(spark, sf_dir).select(F.lower(F.regexp_extract("text", "^([^ .,]*)", 1)).alias("slug"))
    return asked.join(known, "slug", "left_anti")


@query("resize_geometry", """SELECT p_partkey, w, h, CAST(CASE WHEN w <= 300 AND h <= 200 THEN w WHEN w * 200 > h * 300 THEN 300 ELSE w * 200 // h END AS INT) AS width,
  CAST(CASE WHEN w <= 300 AND h <= 200 THEN h WHEN w * 200 > h * 300 THEN h * 300 // w ELSE 200 END AS INT) AS height,
  CAST(greatest(h * 320 // w, 1) AS INT) AS fit_width_height, CAST(greatest(w * 240 // h, 1) AS INT) AS fit_height_width
  FROM (SELECT p_partkey, CAST(p_size * 23 + 7 AS BIGINT) AS w, CAST(p_partkey % 500 + 20 AS BIGINT) AS h FROM part)""")
def resize_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    images = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 23 + 7).cast("long").alias("w"), (F.col("p_partkey") % 500 + 20).alias("h"))
    w, h = F.col("w"), F.col("h")
    return images.withColumns({"fit": text.resize_geometry("fit", w, h, 300, 200), "fw": text.resize_geometry("fit_width", w, h, 320, None), "fh": text.resize_geometry("fit_height", w, h, None, 240)}) \
        .select("p_partkey", "w", "h", "fit.width", "fit.height", F.col("fw.height").alias("fit_width_height"), F.col("fh.width").alias("fit_height_width"))


@query("json_props", "SELECT event_type, CAST(sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS BIGINT) AS sum_k, count(*) AS n FROM events GROUP BY event_type")
def json_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").withColumn("v", F.parse_json("props")).groupBy("event_type").agg(F.sum(F.try_variant_get("v", "$.k", "bigint")).alias("sum_k"), F.count("*").alias("n"))
