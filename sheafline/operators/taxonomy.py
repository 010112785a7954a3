"""Taxonomies: terms, their pages, merges by slug and look-ups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import slug_ascii
from .ordering import group_rank


def explode_terms(pages: DataFrame, taxonomies: Column | str, slug=slug_ascii) -> DataFrame:
    """One row for each (page, taxonomy, raw term): taxonomy_slug, term, term_slug, ord in the page's list; repeats stay.

    Configured names that share a slug become one taxonomy, as rows carry the slug.
    """
    c = F.col(taxonomies) if isinstance(taxonomies, str) else taxonomies
    by_name = pages.select("*", F.explode(c).alias("taxonomy", "__terms"))
    return by_name.select("*", F.posexplode("__terms").alias("ord", "term")).drop("__terms").withColumns({"taxonomy_slug": slug(F.col("taxonomy")), "term_slug": slug(F.col("term"))})


def drop_empty_terms(terms: DataFrame, hidden: str = "hidden") -> DataFrame:
    """Without hidden pages; a term all of whose pages are hidden is gone with them."""
    return terms.where(~F.col(hidden))


def merge_terms(terms: DataFrame, lang: str = "lang") -> DataFrame:
    """Terms of one slug as one: the first name in byte order stays, pages follow name by name.

    Adds name and rank: within a name dated pages come first, newest on top, undated
    ones last, ties by permalink; pages of later names are appended, not sorted in.
    """
    group = [lang, "taxonomy_slug", "term_slug"]
    names = terms.groupBy(*group).agg(F.min("term").alias("name"))
    return group_rank(terms, group, [F.col("term"), F.desc_nulls_last("date"), F.col("permalink"), F.col("ord")]).join(names, group)


def term_counts(terms: DataFrame, lang: str = "lang") -> DataFrame:
    """(lang, taxonomy_slug, term_slug, name, page_count), one aggregation with partial sums."""
    return terms.groupBy(lang, "taxonomy_slug", "term_slug").agg(F.min("term").alias("name"), F.count("*").alias("page_count"))


def lookup_terms(wanted: DataFrame, terms: DataFrame, required: bool = True) -> DataFrame:
    """wanted (lang, taxonomy_slug, term_slug) with the term's columns; not required ones stay with nulls."""
    return wanted.join(terms, ["lang", "taxonomy_slug", "term_slug"], "inner" if required else "left")


def unconfigured(terms: DataFrame, configured: DataFrame) -> DataFrame:
    """Rows whose taxonomy no (lang, taxonomy_slug) configures: errors."""
    return terms.join(configured.select("lang", "taxonomy_slug").distinct(), ["lang", "taxonomy_slug"], "left_anti")


def path_collisions(paths: DataFrame, url: str = "url", file: str = "file") -> DataFrame:
    """URLs that more than one file claims: n_files, first_file, last_file. colliding_files() has them all."""
    return paths.select(url, file).distinct().groupBy(url).agg(F.count("*").alias("n_files"), F.min(file).alias("first_file"), F.max(file).alias("last_file")).where("n_files > 1")


def colliding_files(paths: DataFrame, url: str = "url", file: str = "file") -> DataFrame:
    """(url, file) of every claim on such a URL."""
    return paths.select(url, file).distinct().join(path_collisions(paths, url, file).select(url), url, "left_semi")


def claimed_paths(pages: DataFrame, path: str = "path", aliases: str = "aliases", file: str = "file") -> DataFrame:
    """(url, file) for a page's own path and all its aliases, which start with a slash."""
    every = F.array_union(F.array(F.col(path)), F.transform(F.coalesce(F.col(aliases), F.array().cast("array<string>")), lambda a: F.when(a.startswith("/"), a).otherwise(F.concat(F.lit("/"), a))))
    return pages.select(F.explode(every).alias("url"), F.col(file).alias("file"))
