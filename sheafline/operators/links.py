"""Links of pages: extraction, classes, resolution, anchors, backlinks, outside checks."""

from __future__ import annotations

import re
import time
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths, text
from ..sources.shared import materialize
from .ordering import group_rank

HREF = r'(?i)<a\s[^>]*?href="([^"]*)"'


def extract_links(pages: DataFrame, key: str, html: str) -> DataFrame:
    """(key, pos, link): every double-quoted href of an a element, in order from 0."""
    return pages.select(key, F.posexplode(F.regexp_extract_all(html, F.lit(HREF), F.lit(1))).alias("pos", "link"))


def link_class(link: Column) -> Column:
    """empty, internal (`@/`), email, anchor (`#`), external, site (`/`), colocated or other."""
    return (F.when(link == "", "empty").when(link.startswith("@/"), "internal").when(link.startswith("mailto:"), "email").when(link.startswith("#"), "anchor")
            .when(paths.is_external_link(link), "external").when(link.startswith("/"), "site").when(paths.is_colocated_link(link), "colocated").otherwise("other"))


def split_internal(link: Column) -> tuple[Column, Column]:
    """(file, anchor) of an `@/file.md#anchor` link; percent escapes of the file are decoded, a plus stays."""
    bare = F.substring_index(F.regexp_replace(link, "^@/", ""), "#", 1)
    file = F.try_url_decode(F.replace(bare, F.lit("+"), F.lit("%2B")))
    return F.coalesce(file, bare), F.nullif(F.regexp_extract(link, "#(.*)$", 1), F.lit(""))


def resolve_internal(links: DataFrame, permalinks: DataFrame) -> DataFrame:
    """links (link) with file, anchor, permalink and error; permalinks: (file, permalink). Unknown files are errors."""
    file, anchor = split_internal(F.col("link"))
    out = links.withColumns({"file": file, "anchor": anchor}).join(permalinks.select("file", "permalink"), "file", "left")
    full = F.when(F.col("anchor").isNull(), F.col("permalink")).otherwise(F.concat("permalink", F.lit("#"), "anchor"))
    return out.withColumn("error", F.when(F.col("permalink").isNull(), F.concat(F.lit("broken link to "), "link"))).withColumn("permalink", full)


def resolve_colocated(links: DataFrame, assets: DataFrame) -> DataFrame:
    """links (owner, owner_any, link) with the asset's address: of the owner in its language, else of the one without."""
    own = assets.select(F.col("owner").alias("owner"), F.col("rel").alias("link"), F.col("url").alias("__own"))
    any_ = assets.select(F.col("owner").alias("owner_any"), F.col("rel").alias("link"), F.col("url").alias("__any"))
    return links.join(own, ["owner", "link"], "left").join(any_, ["owner_any", "link"], "left").withColumn("url", F.coalesce("__own", "__any")).drop("__own", "__any")


def missing_anchors(links: DataFrame, anchors: DataFrame, html: DataFrame) -> DataFrame:
    """links (file, anchor) to headings that aren't there: neither in anchors (file, anchor) nor as an id or name in html (file, html)."""
    asked = links.where(F.col("anchor").isNotNull() & ~paths.is_special_anchor(F.col("anchor")))
    rest = asked.join(anchors.select("file", "anchor").distinct(), ["file", "anchor"], "left_anti")
    return rest.join(html.select("file", "html"), "file", "left").where(~F.coalesce(text.has_anchor(F.col("html"), F.col("anchor")), F.lit(False))).drop("html")


def backlinks(links: DataFrame, source: str, target: str) -> DataFrame:
    """(target, source, n_sources): distinct pages that link to each target, a row each, so that a target of the whole site stays spread."""
    edges = links.select(target, source).where(F.col(target).isNotNull()).distinct()
    return edges.join(edges.groupBy(target).agg(F.count("*").alias("n_sources")), target)


def domain_groups(links: DataFrame, url: str = "link") -> DataFrame:
    """(domain, n_links, n_urls) of external links."""
    return links.where(paths.is_external_link(F.col(url))).groupBy(paths.url_host(F.col(url)).alias("domain")).agg(F.count("*").alias("n_links"), F.countDistinct(url).alias("n_urls"))


def skip_links(links: DataFrame, prefixes, ignored_files: str | None = None) -> DataFrame:
    """links that no skip prefix and no ignored file pattern excludes."""
    out = links.where(~paths.starts_with_any(F.col("link"), prefixes))
    return out.where(~F.col("file").rlike(ignored_files)) if ignored_files else out


#: What a client gives of an address: (status, body), the body only where it was asked for one. What it raises is the address's message.
Fetch = Callable[[str, bool], tuple[int, str | None]]


def wants_anchor(url: str, skipped: tuple[str, ...] = ()) -> bool:
    """Whether an address has a fragment that names a place on a page: not one of a script (`#/`, `#!`), and under no skipped prefix."""
    fragment = url.partition("#")[2]
    return fragment != "" and fragment[0] not in "/!" and not url.startswith(skipped)


def judge(url: str, fetch: Fetch, skipped: tuple[str, ...] = ()) -> tuple[bool, str]:
    """(ok, message) of one address: its status has to be a success or `not modified`, and a fragment has to be an id or a name on the page."""
    anchored = wants_anchor(url, skipped)
    try:
        status, body = fetch(url, anchored)
    except Exception as failure:  # noqa: BLE001 - a client may raise anything; that is the address's result
        return False, str(failure) or type(failure).__name__
    if not (200 <= status < 300 or status == 304):
        kind = {1: "informational", 3: "redirection", 4: "client error", 5: "server error"}.get(status // 100, "non-success")
        return False, f"{kind} status {status}"
    anchor = url.partition("#")[2]
    if anchored and not re.search(rf"""(?i)\s(?:id|name)\s*=\s*["']?{re.escape(anchor)}["'\s>]""", body or ""):
        return False, f"no anchor #{anchor} on the page"
    return True, str(status)


def external_addresses(links: DataFrame, url: str = "link", skip_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """Distinct (url, domain) of external links; the domain is null where an address has no host."""
    found = links.where(paths.is_external_link(F.col(url))).select(F.col(url).alias("url"), paths.url_host(F.col(url)).alias("domain"))
    return found.where(~paths.starts_with_any(F.col("url"), list(skip_prefixes))).distinct() if skip_prefixes else found.distinct()


def ask_external(due: DataFrame, fetch: Fetch, *, per_domain: int = 1000, spacing: float = 0.5, skip_anchor_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(url, domain, ok, message, asked_at) of the first per_domain addresses of each domain.

    A domain is asked by one task, with `spacing` seconds between the starts of two calls;
    a task takes its domains in turns, so it waits only when nothing else is due. As a
    domain gives per_domain addresses at most, no task is held longer than they need.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: dict[str | None, float] = {}
        for b in batches:
            out = []
            for url, domain in zip(b.column("url").to_pylist(), b.column("domain").to_pylist(), strict=True):
                if domain is None:
                    out.append((False, "no host", None))
                    continue
                wait = last.get(domain, 0.0) + spacing - time.time()
                if wait > 0:
                    time.sleep(wait)
                last[domain] = time.time()
                out.append((*judge(url, fetch, skip_anchor_prefixes), last[domain]))
            ok, message, at = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([b.column("url"), b.column("domain"), pa.array(ok, pa.bool_()), pa.array(message, pa.string()), pa.array(at, pa.float64())], names=["url", "domain", "ok", "message", "asked_at"])

    turns = group_rank(due.select("url", "domain"), ["domain"], [F.col("url").asc()], "turn").where(F.col("turn") <= per_domain)
    dealt = turns.repartition("domain").sortWithinPartitions("turn", "domain")
    return dealt.select("url", "domain").mapInArrow(run, "url string, domain string, ok boolean, message string, asked_at double")


def check_external(links: DataFrame, fetch: Fetch | None = None, url: str = "link", *, cache: str | None = None, per_domain: int = 1000, spacing: float = 0.5,
                   skip_prefixes: tuple[str, ...] = (), skip_anchor_prefixes: tuple[str, ...] = ()) -> DataFrame:
    """(url, domain, ok, message) of each distinct external address; ok is null for those that are left for a later run.

    With a cache, a folder of earlier answers, only addresses that it lacks are asked, at
    most per_domain of a domain a run; the answers are added to it as one committed
    write, and later runs go on with the rest. So an address is asked once over all runs,
    and a domain of any size takes as many runs as its spacing needs. Without a cache the
    answers of this run are all there is. Without a client nothing is asked: addresses
    without a host fail, all others pass.
    """
    c = F.col
    asked = external_addresses(links, url, skip_prefixes)
    if fetch is None:
        return asked.select("url", "domain", c("domain").isNotNull().alias("ok"), F.when(c("domain").isNull(), "no host").otherwise("not asked").alias("message"))
    spark = links.sparkSession
    schema = "url string, domain string, ok boolean, message string, asked_at double"
    place = spark._jvm.org.apache.hadoop.fs.Path(cache) if cache else None
    there = place is not None and place.getFileSystem(spark._jsc.hadoopConfiguration()).exists(place)
    known = spark.read.schema(schema).parquet(cache) if there else spark.createDataFrame([], schema)
    known = materialize(known, "known-answers")  # as it was before this run adds to it
    new = materialize(ask_external(asked.join(known.select("url"), "url", "left_anti"), fetch, per_domain=per_domain, spacing=spacing, skip_anchor_prefixes=skip_anchor_prefixes), "answers")
    if cache:
        new.write.mode("append").parquet(cache)
    return asked.join(known.unionByName(new).select("url", "ok", "message"), "url", "left").select("url", "domain", "ok", "message")


def broken_links(links: DataFrame, results: DataFrame, file: str = "file", url: str = "link") -> DataFrame:
    """(file, url, message) of links whose address has failed."""
    bad = results.where("NOT ok").select("url", "message")
    return links.select(F.col(file).alias("file"), F.col(url).alias("url")).distinct().join(bad, "url").select("file", "url", "message")
