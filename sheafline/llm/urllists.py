"""URL filters whose lists change over time, in DataFrame functions only.

Dated entries of a list become validity intervals. A capture is met with the entries of
its URL, its path prefixes, its host and its parent domains that were active when it
was fetched, through an as-of join: per key, intervals and captures are put in order of
time, and each capture takes each list's latest interval before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: More captures of one key than this are dealt over several runs, each with the key's intervals.
RUN_ROWS = 4096
#: From the least to the most specific.
KINDS = ("domain", "host", "prefix", "url")

_SCHEME = "^[a-zA-Z][a-zA-Z0-9+.-]*://"


def url_parts(url: Column) -> tuple[Column, Column, Column]:
    """Lower-case host, path and query of an absolute URL; empty where there is none."""
    plain = F.regexp_replace(F.trim(F.coalesce(url, F.lit(""))), "#.*$", "")
    host = F.lower(F.regexp_extract(plain, _SCHEME + "(?:[^/?@]*@)?([^/?:]*)", 1))
    return host, F.regexp_extract(plain, _SCHEME + "[^/?]*([^?]*)", 1), F.regexp_extract(plain, r"\?(.*)$", 1)


def url_keys(url: Column) -> Column:
    """array<struct<kind, key>>: everything that an entry can name a URL by."""
    host, path, query = url_parts(url)
    labels, steps = F.split(host, r"\."), F.filter(F.split(path, "/"), lambda x: x != "")
    joined = F.array_join(F.concat(F.array(host), steps), "/")
    pair = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    domains = F.when(F.size(labels) > 1, F.transform(F.sequence(F.lit(1), F.size(labels) - 1), lambda i: pair("domain", F.array_join(F.slice(labels, i, F.size(labels)), "."))))
    prefixes = F.when(F.size(steps) > 0, F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: pair("prefix", F.array_join(F.concat(F.array(host), F.slice(steps, 1, i)), "/"))))
    none = F.array().cast("array<struct<kind:string,key:string>>")
    return F.when(host == "", none).otherwise(F.concat(
        F.coalesce(domains, none), F.coalesce(prefixes, none), F.array(pair("host", host)),
        F.array(pair("url", F.concat(joined, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))))))


def validity_intervals(entries: DataFrame) -> DataFrame:
    """list_name, kind, key, valid_from, valid_to of entries (list_name, kind, key, listed_on, action).

    An `add` holds until the next entry of the same list and key, or for good (null);
    a `remove` ends it. Of entries on one day, a removal wins. Entries with a null
    field and other actions are ignored; repeated ones count once.
    """
    c = F.col
    days = entries.where(c("action").isin("add", "remove")).na.drop(subset=["list_name", "kind", "key", "listed_on"]) \
        .groupBy("list_name", "kind", "key", "listed_on").agg(F.max("action").alias("action"))
    w = Window.partitionBy("list_name", "kind", "key").orderBy("listed_on")
    return days.withColumn("valid_to", F.lead("listed_on").over(w)).where("action = 'add'").select("list_name", "kind", "key", c("listed_on").alias("valid_from"), "valid_to")


def temporal_list_join(captures: DataFrame, entries: DataFrame, lists: dict[str, str], *, id_col: str = "page_id", url_col: str = "url",
                       time_col: str = "fetched_on") -> DataFrame:
    """Every capture with the entries that were active when it was fetched.

    lists names the lists to ask, each with `block` or `allow`; entries of others are
    not read. Returns id, url, time, verdict (`block`, `allow` or `none`), n_active (active entries), and the
    deciding entry: list_name, kind, matched_key, listed_on. The most specific entry
    decides: url, then the longest prefix, then host, then the longest domain; allow
    before block where both are as specific, then the first list by name. An entry
    counts from its day on, up to but without the day it ends. Null or relative URLs
    and null times match nothing; repeated captures are returned once each; only the
    named columns are read.

    Keys of more than RUN_ROWS captures are dealt over runs, to each of which the
    key's intervals are copied, so no task joins or sorts a whole hot host. Only keys
    that some entry names go on to the window.
    """
    c = F.col
    intervals = validity_intervals(entries.where(c("list_name").isin(*lists)))
    own = F.struct(F.lit("").alias("kind"), c("row").cast("string").alias("key"))  # keeps captures that match nothing
    asked = captures.select(F.monotonically_increasing_id().alias("row"), c(id_col).alias("id"), c(url_col).alias("url"), c(time_col).cast("date").alias("ts"))
    keys = asked.withColumn("k", F.explode(F.concat(F.array(own), url_keys(c("url"))))).select("row", "id", "url", "ts", "k.kind", "k.key")
    runs = keys.where("kind <> ''").groupBy("kind", "key").count().where(c("count") > RUN_ROWS) \
        .select("kind", "key", F.ceil(c("count") / RUN_ROWS).cast("int").alias("runs"))
    every_run = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("runs", F.lit(1)).cast("long") - 1))
    named = intervals.select("kind", "key").distinct().join(runs, ["kind", "key"], "left").select("kind", "key", every_run.alias("run"), F.lit(True).alias("named"))
    left = keys.join(runs, ["kind", "key"], "left").withColumn("run", F.pmod(F.xxhash64("row"), F.coalesce("runs", F.lit(1)).cast("long"))).drop("runs")
    left = left.join(named, ["kind", "key", "run"], "left").where("named OR kind = ''")
    right = intervals.join(runs, ["kind", "key"], "left").withColumn("run", every_run)
    line = left.select("kind", "key", "run", "ts", F.lit(1).alias("asks"), "row", "id", "url", F.lit(None).cast("string").alias("list_name"), F.lit(None).cast("date").alias("valid_to")) \
        .unionByName(right.select("kind", "key", "run", c("valid_from").alias("ts"), F.lit(0).alias("asks"), F.lit(None).cast("long").alias("row"), "list_name", "valid_to"), allowMissingColumns=True)
    w = Window.partitionBy("kind", "key", "run").orderBy("ts", "asks").rowsBetween(Window.unboundedPreceding, 0)
    kind_rank = F.array_position(F.array(*map(F.lit, KINDS)), c("kind"))
    latest = [
        F.last(F.when((c("list_name") == name) & (c("asks") == 0), F.struct(
            (-kind_rank).alias("rank"), (-F.length("key")).alias("size"), F.lit(action != "allow").alias("blocks"), F.lit(name).alias("list_name"),
            c("kind").alias("kind"), c("key").alias("matched_key"), c("ts").alias("listed_on"), c("valid_to").alias("valid_to"))), ignorenulls=True).over(w)
        for name, action in sorted(lists.items())
    ]
    met = line.withColumn("found", F.array(*latest)).where("asks = 1")
    active = F.filter("found", lambda x: x.isNotNull() & c("ts").isNotNull() & (x["valid_to"].isNull() | (c("ts") < x["valid_to"])))
    met = met.select("row", "id", "url", "ts", active.alias("active"))
    best = met.groupBy("row").agg(F.first("id").alias("id"), F.first("url").alias("url"), F.first("ts").alias("ts"),
                                  F.sum(F.size("active")).alias("n_active"), F.min(F.array_min("active")).alias("best"))
    verdict = F.when(c("best").isNull(), "none").when(c("best.blocks"), "block").otherwise("allow")
    return best.select(c("id").alias(id_col), c("url").alias(url_col), c("ts").alias(time_col), verdict.alias("verdict"), "n_active",
                       "best.list_name", "best.kind", "best.matched_key", "best.listed_on")


#: The lists of the registered query.
LISTS = {"malware": "block", "spam": "block", "trusted": "allow"}


def page_captures(pages: DataFrame) -> DataFrame:
    """The pages with a fetch day that their id gives, as the table has none."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 37 % 366).cast("int"))
    return pages.select("page_id", "url", day.alias("fetched_on"))


def page_entries(pages: DataFrame) -> DataFrame:
    """Dated list entries that every fifth page gives: of its URL, first path step, host or domain by turns."""
    host, path, query = url_parts(F.col("url"))
    n = F.floor(F.col("page_id") / 5)
    kind = F.element_at(F.array(*map(F.lit, KINDS)), (n % 4 + 1).cast("int"))
    key = F.element_at(F.filter(url_keys(F.col("url")), lambda k: k["kind"] == kind), 1)
    name = F.element_at(F.array(*map(F.lit, sorted(LISTS))), (F.floor(n / 4) % 3 + 1).cast("int"))
    return pages.where("page_id % 5 = 0").select(
        name.alias("list_name"), kind.alias("kind"), key["key"].alias("key"),
        F.date_add(F.lit("2024-01-01").cast("date"), (F.col("page_id") * 101 % 366).cast("int")).alias("listed_on"),
        F.when(F.floor(n / 12) % 4 == 3, "remove").otherwise("add").alias("action"))


def op5_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages against dated lists that the pages' own URLs make up."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return temporal_list_join(page_captures(pages), page_entries(pages), LISTS)


OP5_SQL = r"""
WITH plain AS (SELECT page_id, url, regexp_replace(trim(coalesce(url, '')), '#.*$', '') AS p FROM pages),
parts AS (SELECT page_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INT) AS DATE) AS fetched_on,
    lower(regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?@]*@)?([^/?:]*)', 1)) AS host,
    list_filter(string_split(regexp_extract(p, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?]*([^?]*)', 1), '/'), lambda x: x <> '') AS steps,
    regexp_extract(p, '\?(.*)$', 1) AS q FROM plain),
keyed AS (
  SELECT page_id, url, fetched_on, 1 AS rank, 'domain' AS kind, i AS pos, array_to_string(list_slice(string_split(host, '.'), i, 100), '.') AS key
    FROM parts, LATERAL (SELECT unnest(range(1, len(string_split(host, '.')))) AS i) WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, 2, 'host', 1, host FROM parts WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, 3, 'prefix', i, array_to_string(list_concat([host], list_slice(steps, 1, i)), '/')
    FROM parts, LATERAL (SELECT unnest(range(1, len(steps) + 1)) AS i) WHERE host <> ''
  UNION ALL SELECT page_id, url, fetched_on, 4, 'url', 1, array_to_string(list_concat([host], steps), '/') || CASE WHEN q <> '' THEN '?' || q ELSE '' END FROM parts WHERE host <> ''),
entries AS (
  SELECT (['malware', 'spam', 'trusted'])[(page_id // 20) % 3 + 1] AS list_name, kind, key, CAST(DATE '2024-01-01' + CAST(page_id * 101 % 366 AS INT) AS DATE) AS listed_on,
    max(CASE WHEN (page_id // 60) % 4 = 3 THEN 'remove' ELSE 'add' END) AS action
  FROM keyed WHERE page_id % 5 = 0 AND rank = (page_id // 5) % 4 + 1 AND pos = 1 GROUP BY 1, 2, 3, 4),
spans AS (SELECT *, lead(listed_on) OVER (PARTITION BY list_name, kind, key ORDER BY listed_on) AS valid_to FROM entries),
hits AS (
  SELECT k.page_id, k.rank, k.kind, k.key, s.list_name, s.listed_on FROM keyed k JOIN spans s ON s.kind = k.kind AND s.key = k.key
  WHERE s.action = 'add' AND s.listed_on <= k.fetched_on AND (s.valid_to IS NULL OR k.fetched_on < s.valid_to)),
best AS (
  SELECT *, count(*) OVER (PARTITION BY page_id) AS n,
    row_number() OVER (PARTITION BY page_id ORDER BY rank DESC, length(key) DESC, list_name = 'trusted' DESC, list_name) AS rn FROM hits)
SELECT p.page_id, p.url, p.fetched_on, CASE WHEN b.page_id IS NULL THEN 'none' WHEN b.list_name = 'trusted' THEN 'allow' ELSE 'block' END AS verdict,
  CAST(coalesce(b.n, 0) AS BIGINT) AS n_active, b.list_name, b.kind, b.key AS matched_key, b.listed_on
FROM parts p LEFT JOIN best b ON b.page_id = p.page_id AND b.rn = 1
"""
