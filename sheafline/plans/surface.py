"""What templates and SQL call: addresses, words, encodings, numbers, lists and counters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths, register, text
from ..sources.adapters import table
from .catalog import query
from .files import _cat


@query("site_urls", """SELECT page_id, 'https://example.org/' || CASE WHEN page_id % 2 = 0 THEN 'fr/' ELSE '' END || 'p/' || page_id || '/' AS page, 'https://example.org/p' || page_id || '.css?h=' || substring(sha256(html), 1, 20) AS asset FROM pages""")
def site_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    page = paths.get_url("https://example.org/", _cat("/p/", k), F.when(k % 2 == 0, "fr").otherwise("en"), trailing_slash=True)
    return table(spark, sf_dir, "pages").select("page_id", page.alias("page"), paths.get_url("https://example.org", _cat("p", k, ".css"), content=F.col("html")).alias("asset"))


@query("configured_words", "SELECT doc_id, CASE lang WHEN 'en' THEN 'read on' WHEN 'fr' THEN 'lire la suite' WHEN 'de' THEN 'weiterlesen' END AS more, CASE WHEN lang = 'en' THEN 'home' END AS home, 'fallback' AS variable FROM documents")
def configured_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = {"en": {"more": "read on", "home": "home"}, "fr": {"more": "lire la suite"}, "de": {"more": "weiterlesen"}}
    word = lambda key: paths.translated(F.lit(key), F.col("lang"), words).alias(key)
    return table(spark, sf_dir, "documents").select("doc_id", word("more"), word("home"), paths.get_env("SHEAFLINE_NO_SUCH_VARIABLE", "fallback").alias("variable"))


@query("encodings", r"""SELECT page_id, base64(CAST(url AS BLOB)) AS b64, sha256(html) AS back, '"' || url || '"' AS json, sha256(regexp_replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '', 'g')) AS stripped FROM pages""")
def encodings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encoded and decoded again; JSON; texts without tags."""
    back = F.decode(F.unbase64(F.base64(F.encode("html", "UTF-8"))), "UTF-8")
    once = F.try_url_decode(F.url_encode(back))
    json = F.regexp_replace(F.regexp_extract(F.to_json(F.struct(F.col("url").alias("u"))), r"^\{\"u\":(.*)\}$", 1), r"\\/", "/")
    return table(spark, sf_dir, "pages").select("page_id", text.base64_line(F.encode("url", "UTF-8")).alias("b64"), F.sha2(once, 256).alias("back"), F.when(F.col("url").isNotNull(), json).alias("json"), F.sha2(text.strip_tags(F.col("html")), 256).alias("stripped"))


@query("rounded_prices", "SELECT o_orderkey, CAST(ceil(o_totalprice) AS BIGINT) AS up, CAST(floor(o_totalprice) AS BIGINT) AS down, CAST(floor(CAST(o_orderkey AS DOUBLE) / 4 + 0.5) AS BIGINT) AS nearest, CAST(trunc(o_totalprice) AS BIGINT) AS whole FROM orders")
def rounded_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("o_totalprice")
    return table(spark, sf_dir, "orders").select("o_orderkey", F.ceil(p).cast("long").alias("up"), F.floor(p).cast("long").alias("down"), F.round(F.col("o_orderkey").cast("double") / 4).cast("long").alias("nearest"), p.cast("long").alias("whole"))


@query("list_tools", """SELECT p_partkey, array_to_string(list_reverse(w), ' ') AS reversed, array_to_string(list_concat(w, [p_brand]), ' ') AS joined, CAST(len(w) AS INT) AS n, w[1] AS first, w[-1] AS last, array_to_string(w[2:3], ' ') AS part, array_to_string(list_sort(list_distinct(w)), ' ') AS distinct_sorted
FROM (SELECT p_partkey, p_brand, string_split(p_name || ' ' || p_type, ' ') AS w FROM part)""")
def list_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = F.col("w")
    rows = table(spark, sf_dir, "part").select("p_partkey", "p_brand", F.split(F.concat_ws(" ", "p_name", "p_type"), " ").alias("w"))
    joined = lambda a: F.array_join(a, " ")
    return rows.select("p_partkey", joined(F.reverse(w)).alias("reversed"), joined(F.concat(w, F.array("p_brand"))).alias("joined"), F.size(w).alias("n"), F.try_element_at(w, F.lit(1)).alias("first"), F.try_element_at(w, F.lit(-1)).alias("last"),
                       joined(F.slice(w, 2, 2)).alias("part"), joined(F.array_sort(F.array_distinct(w))).alias("distinct_sorted"))


@query("all_links", "SELECT url FROM pages UNION SELECT 'https://example.org/s/' || s_suppkey || '/' FROM supplier")
def all_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links of pages and of sections, each once."""
    sections = table(spark, sf_dir, "supplier").select(_cat("https://example.org/s/", F.col("s_suppkey"), "/").alias("url"))
    return table(spark, sf_dir, "pages").select("url").unionByName(sections).distinct()


@query("language_sets", "SELECT source, string_agg(DISTINCT lang, ',' ORDER BY lang) AS langs FROM (SELECT source, lang FROM documents UNION ALL SELECT source, 'en' FROM documents) GROUP BY source")
def language_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The languages of a section and the default one, sorted and without repeats."""
    by = table(spark, sf_dir, "documents").groupBy("source").agg(F.collect_set("lang").alias("l"))
    return by.select("source", F.array_join(F.array_sort(F.array_union("l", F.array(F.lit("en")))), ",").alias("langs"))


@query("run_counters", "SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 5 = 0) AS failures, count(*) FILTER (event_id % 5 <> 0 AND event_id % 3 = 0) AS written, count(*) FILTER (event_id % 5 <> 0 AND event_id % 3 <> 0) AS fresh FROM events GROUP BY event_type")
def run_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a run reports, one pass for all counters."""
    failed, due = F.col("event_id") % 5 == 0, F.col("event_id") % 3 == 0
    return table(spark, sf_dir, "events").groupBy("event_type").agg(F.count("*").alias("calls"), F.count_if(failed).alias("failures"), F.count_if(~failed & due).alias("written"), F.count_if(~failed & ~due).alias("fresh"))


@query("sql_functions", r"""SELECT page_id, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g') AS slug, regexp_matches(url, '^https?:') AS outside, sha256(replace(regexp_replace(html, '<[^>]*(>|$)', '', 'g'), '>', '')) AS stripped,
  regexp_replace(url, '/+$', '') || '/' AS base, CAST(ceil(CAST(page_id AS DOUBLE) / CASE WHEN page_id % 2 = 0 THEN 238 ELSE 439 END) AS BIGINT) AS minutes, contains(html, '{{') OR contains(html, '{%') AS templating FROM pages""")
def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Column functions called from SQL by their registered names."""
    register.register(spark)
    table(spark, sf_dir, "pages").createOrReplaceTempView("sheafline_pages")
    return spark.sql("""SELECT page_id, slug_ascii(url) AS slug, is_external_link(url) AS outside, sha2(strip_tags(html), 256) AS stripped, normalize_base_url(url) AS base,
        reading_minutes(page_id, CASE WHEN page_id % 2 = 0 THEN 'en-GB' ELSE 'zh' END) AS minutes, needs_templating(html) AS templating FROM sheafline_pages""")
