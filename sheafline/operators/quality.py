"""Data-quality rules: each gives violations (code, page_id, message)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths
from ..functions.text import trim_all
from .graph import is_thin_exempt


def violations(rows: DataFrame, code: str, page: Column | str, message: Column) -> DataFrame:
    return rows.select(F.lit(code).alias("code"), (F.col(page) if isinstance(page, str) else page).cast("string").alias("page_id"), message.alias("message"))


def all_violations(*parts: DataFrame) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)


def path_ids(pages: DataFrame) -> DataFrame:
    """Ids and paths must name no host; canonical paths start with a slash."""
    c = F.col
    bad = c("id").rlike("^https?://") | c("canonical_path").rlike("^https?://") | ~c("canonical_path").startswith("/")
    return violations(pages.where(bad), "path_id", "id", F.lit("id and canonical_path must be hostless, canonical_path must start with /"))


def sitemap_flags(pages: DataFrame) -> DataFrame:
    """Stubs and noindex pages must not be in the site map."""
    return all_violations(violations(pages.where("stub AND sitemap"), "stub_in_sitemap", "id", F.lit("stub page must not be in the sitemap")),
                          violations(pages.where("noindex AND sitemap"), "noindex_in_sitemap", "id", F.lit("noindex page must not be in the sitemap")))


def thin_published(pages: DataFrame) -> DataFrame:
    return violations(pages.where(F.col("thin") & F.col("sitemap") & ~F.col("noindex") & ~is_thin_exempt(F.col("canonical_path"))), "thin_published", "id", F.lit("thin page is in the sitemap"))


def duplicate_hash(pages: DataFrame, canonical: DataFrame, order: str | None = None) -> DataFrame:
    """Site map pages of one content hash, but for the preferred one and those that point at another of them.

    canonical: (from, to). Preferred is the first page (by `order`, else by id) that
    another one of the group points at, else the smallest id. Empty pages don't
    count. Groups are aggregates by hash; nothing pairs up a group's pages: a pointer
    is inside a group when both its ends have the same hash.
    """
    live = pages.where(F.col("sitemap") & (F.coalesce("content_hash", F.lit("")) != "") & (F.col("word_count") > 0)).select("id", "content_hash", F.col(order or "id").alias("ord"))
    ends = canonical.select(F.col("from").alias("a"), F.col("to").alias("b")).where("a <> b").distinct()
    inside = ends.join(live.select(F.col("id").alias("a"), F.col("content_hash").alias("ha")), "a").join(live.select(F.col("id").alias("b"), F.col("content_hash").alias("hb"), F.col("ord").alias("ob")), "b").where("ha = hb")
    targets = inside.groupBy(F.col("ha").alias("content_hash")).agg(F.min_by("b", F.struct("ob", "b")).alias("target"))
    groups = live.groupBy("content_hash").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1").join(targets, "content_hash", "left").select("content_hash", F.coalesce("target", "least").alias("preferred"))
    rest = live.join(groups, "content_hash").where("id <> preferred").join(inside.select(F.col("a").alias("id")).distinct(), "id", "left_anti")
    return violations(rest, "duplicate_hash", "id", F.concat(F.lit("shares content_hash with "), F.col("preferred").cast("string"), F.lit(" but has no canonical edge")))


def reciprocal(edges: DataFrame, code: str = "translation_reciprocal") -> DataFrame:
    """Edges (from, to) without one back; an edge to the page itself is its own, one with a null end has none.

    Both directions of a pair meet in one grouping: no edge is sorted, and none is sent twice.
    """
    c = F.col
    a, b = c("from"), c("to")
    whole = edges.select("from", "to").where(a.isNotNull() & b.isNotNull() & (a != b))
    pairs = whole.groupBy(F.least(a, b).alias("low"), F.greatest(a, b).alias("high")).agg(F.max(a < b).alias("up"), F.max(a > b).alias("down")).where(c("up") != c("down"))
    single = pairs.select(F.when(c("up"), c("low")).otherwise(c("high")).alias("from"), F.when(c("up"), c("high")).otherwise(c("low")).alias("to"))
    alone = single.unionByName(edges.select("from", "to").where(a.isNull() | b.isNull()).distinct())
    return violations(alone, code, "from", F.concat(F.lit("edge to "), b.cast("string"), F.lit(" has no reverse edge")))


def missing_person(pages: DataFrame, persons: DataFrame) -> DataFrame:
    """Articles and blog postings (id, schema_types, author) without an author, or with one that is no person's id; other pages need none."""
    articles = pages.where(F.coalesce(F.arrays_overlap("schema_types", F.array(F.lit("Article"), F.lit("BlogPosting"))), F.lit(False)))
    known = persons.select(F.col("id").alias("author")).where(F.col("author").cast("string") != "").distinct()
    return violations(articles.join(known, "author", "left_anti"), "missing_person", "id", F.lit("an article needs the id of a known person as its author"))


def claim_collisions(claims: DataFrame, metric: str, value: str, order: str, key: str) -> DataFrame:
    """Claims whose value differs from the first claim of their metric. First values are an aggregate, so no metric is sorted in one task."""
    first = claims.groupBy(metric).agg(F.min_by(value, F.struct(order, key)).alias("__first"))
    hit = claims.join(first, metric).where(~F.col(value).eqNullSafe(F.col("__first")))
    return violations(hit, "claim_collision", key, F.concat(F.lit("differs from the first value of "), F.col(metric)))


def pillar_split(relations: DataFrame, pairs: DataFrame) -> DataFrame:
    """`related` edges between pairs (a, b) of pages that must not be, either way round."""
    low, high = F.least("from", "to"), F.greatest("from", "to")
    banned = pairs.select(F.least("a", "b").alias("__a"), F.greatest("a", "b").alias("__b")).distinct()
    hit = relations.where("kind = 'related'").withColumns({"__a": low, "__b": high}).join(banned, ["__a", "__b"], "left_semi")
    return violations(hit, "pillar_split", "from", F.concat(F.lit("related to "), F.col("to").cast("string")))


def redirects(lines: DataFrame) -> DataFrame:
    """(from, to) of a redirect file's lines: two words at least, no comments."""
    w = F.split(F.trim("value"), r"\s+")
    return lines.where((F.size(w) >= 2) & ~F.trim("value").startswith("#")).select(w[0].alias("from"), w[1].alias("to"))


def missing_redirects(required: DataFrame, graph: DataFrame, static: DataFrame) -> DataFrame:
    """Required redirects (from, to) that neither the graph nor the static file has, paths normalised."""
    norm = lambda df: df.select(paths.norm_path(F.col("from")).alias("from"), paths.norm_path(F.col("to")).alias("to"))
    rest = norm(required).join(norm(graph).unionByName(norm(static)).distinct(), ["from", "to"], "left_anti")
    return violations(rest, "redirect_about", "from", F.concat(F.lit("no redirect to "), F.col("to")))


def head_links(html: DataFrame, key: str = "path") -> DataFrame:
    """(key, rel, hreflang, href) of link elements, addresses normalised."""
    tags = html.select(key, F.explode(F.regexp_extract_all("html", F.lit(r"(?i)(<link\s[^>]*>)"), F.lit(1))).alias("tag"))
    return tags.select(key, F.lower(paths.attr_value(F.col("tag"), "rel")).alias("rel"), paths.attr_value(F.col("tag"), "hreflang").alias("hreflang"), paths.norm_href(paths.attr_value(F.col("tag"), "href")).alias("href"))


def hreflang_reciprocal(html: DataFrame) -> DataFrame:
    """Alternates (not to the page itself) whose target doesn't name the page back; a page is its canonical address."""
    links = head_links(html)
    own = links.where("rel = 'canonical'").groupBy("path").agg(F.min("href").alias("self"))
    alt = links.where("rel = 'alternate' AND hreflang IS NOT NULL").join(own, "path").where("href <> self").select(F.col("self").alias("from"), F.col("href").alias("to"))
    return reciprocal(alt)


def sitemap_host(outputs: DataFrame, path: str = "sitemap.xml") -> DataFrame:
    """(host) of the first address in the site map among outputs (path, html), in lower case; no row without one."""
    loc = F.regexp_extract("html", r"(?is)<loc>(.*?)</loc>", 1)
    host = F.nullif(F.lower(paths.url_host(trim_all(loc))), F.lit(""))
    return outputs.where(F.col("path") == path).agg(F.min(host).alias("host")).where("host IS NOT NULL")


def canonical_hosts(outputs: DataFrame, path: str = "sitemap.xml") -> DataFrame:
    """Canonical addresses on another host than the first one of the site map, which is among outputs (path, html); nothing without it."""
    host = sitemap_host(outputs, path).select("host")
    # the explode keeps the long expression of an address's host from being copied to each use
    links = head_links(outputs.where(F.col("path") != path)).where("rel = 'canonical'").select("path", F.explode(F.array(F.lower(paths.url_host(F.col("href"))))).alias("own")).where("own <> ''")
    bad = links.withColumn("host", host.scalar()).where("own <> host")
    return violations(bad, "canonical_host", "path", F.concat(F.lit("canonical host "), "own", F.lit(" is not the site map's "), "host"))


def rating_without_claim(outputs: DataFrame, claims: DataFrame) -> DataFrame:
    """One violation, of no page, where outputs (html) show an AggregateRating while no claim allows ratings and has an evidence address.

    claims: (allows_aggregate_rating, evidence_url); nulls allow nothing.
    """
    shown = outputs.agg(F.coalesce(F.bool_or(F.contains("html", F.lit("AggregateRating"))), F.lit(False)).alias("shown"))
    backed = claims.agg(F.coalesce(F.bool_or(F.col("allows_aggregate_rating") & (F.col("evidence_url") != "")), F.lit(False)).alias("backed"))
    bad = shown.withColumn("backed", backed.scalar()).where("shown AND NOT backed")
    return violations(bad, "rating_without_claim", F.lit(None).cast("string"), F.lit("pages show an AggregateRating that no claim with evidence allows"))


def first_wins(rows: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("__n = 1").drop("__n")


def raise_if_any(found: DataFrame, most: int = 20) -> None:
    """One error that lists the first violations, if there are any."""
    rows = found.orderBy("code", "page_id").limit(most).collect()
    if rows:
        raise ValueError("\n".join(f"{r.code}: {r.page_id}: {r.message}" for r in rows))
