"""The tree of sections: ancestors, visibility, roll-up, orphans.

Trees are joined by path prefixes: every row is exploded into the prefixes of its own
path (as many as its depth), which meet sections in one equi-join. No recursion.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def with_prefixes(rows: DataFrame, components: str = "components", own: bool = True, first: int = 0) -> DataFrame:
    """One row for each prefix of an array of directory names from a depth on: prefix (joined by `/`, empty for the root) and depth."""
    last = F.size(components) if own else F.size(components) - 1
    depths = F.when(last >= first, F.sequence(F.lit(first), last))
    out = rows.withColumn("depth", F.explode(depths))
    return out.withColumn("prefix", F.array_join(F.slice(components, F.lit(1), F.col("depth")), "/"))


def section_keys(sections: DataFrame) -> DataFrame:
    """sections (components, lang, ...) with their prefix as `section_path`."""
    return sections.withColumn("section_path", F.array_join("components", "/"))


def ancestors(rows: DataFrame, sections: DataFrame, key: str, own: bool) -> DataFrame:
    """(key, section_path, depth) of existing sections on the path to each row, root first by depth; missing ones are skipped.

    own: with the section of the row's full path (pages) or only those above (sections).
    """
    s, rows = sections.select(F.col("section_path").alias("prefix"), "lang").distinct(), rows.select(key, "components", "lang")
    # all rows of a language share its root: one row for each language of a site, met without a shuffle
    root = F.broadcast(s.where("prefix = ''").select("lang"))
    top = (rows if own else rows.where(F.size("components") > 0)).join(root, "lang").select(key, F.lit("").alias("section_path"), F.lit(0).alias("depth"), "lang")
    deeper = with_prefixes(rows, own=own, first=1).join(s.where("prefix <> ''"), ["prefix", "lang"])
    return top.unionByName(deeper.select(key, F.col("prefix").alias("section_path"), "depth", "lang"))


def nearest_setting(rows: DataFrame, sections: DataFrame, key: str, setting: str, own: bool) -> DataFrame:
    """(key, setting) of the deepest section on each row's path that sets it; rows without one are absent."""
    set_ = sections.where(F.col(setting).isNotNull()).select(F.col("section_path").alias("prefix"), "lang", F.col(setting).alias("__set"))
    rows = rows.select(key, "components", "lang")
    # the root of a language would be one key for all its rows: it is met without a shuffle, a row for each language
    root = F.broadcast(set_.where("prefix = ''").groupBy("lang").agg(F.max("__set").alias("__set")))
    top = (rows if own else rows.where(F.size("components") > 0)).join(root, "lang").select(key, F.lit(0).alias("depth"), "__set")
    deeper = with_prefixes(rows, own=own, first=1).join(set_.where("prefix <> ''"), ["prefix", "lang"]).select(key, "depth", "__set")
    return top.unionByName(deeper).groupBy(key).agg(F.max_by("__set", "depth").alias(setting))


def resolve_hidden(sections: DataFrame) -> DataFrame:
    """sections with is_hidden: its own flag, else that of the nearest section above that has one, else false."""
    named = sections.withColumn("__key", F.concat_ws("\0", "lang", "section_path"))
    above = nearest_setting(named, sections, "__key", "hidden", own=False).withColumnRenamed("hidden", "__above")
    return named.join(above, "__key", "left").withColumn("is_hidden", F.coalesce("hidden", "__above", F.lit(False))).drop("__key", "__above")


def page_hidden(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """pages with is_hidden: their own flag, else the resolved one of the section they lie in, else false."""
    s = sections.select(F.col("section_path").alias("__path"), F.col("lang").alias("__lang"), F.col("is_hidden").alias("__hidden"))
    at = F.array_join("components", "/")
    return pages.join(s, (at == F.col("__path")) & (F.col("lang") == F.col("__lang")), "left") \
        .withColumn("is_hidden", F.coalesce("hidden", "__hidden", F.lit(False))).drop("__path", "__lang", "__hidden")


def roll_up(pages: DataFrame, sections: DataFrame, key: str) -> DataFrame:
    """(key, section_path, depth): sections that list a page: its own and, while these are transparent, the next directory up.

    The walk ends at the first directory without a section or with one that isn't
    transparent, so every prefix is kept whose deeper ones all exist and are transparent.
    """
    s = sections.select(F.col("section_path").alias("prefix"), "lang", F.coalesce("transparent", F.lit(False)).alias("transparent"), F.lit(True).alias("__there"))
    pages = pages.select(key, "components", "lang")
    # as in nearest_setting, roots are met without a shuffle
    root = F.broadcast(s.where("prefix = ''").groupBy("lang").agg(F.bool_or("transparent").alias("transparent"), F.first("__there").alias("__there")))
    top = pages.join(root, "lang", "left").select(key, "lang", F.lit(0).alias("depth"), F.lit("").alias("prefix"), "transparent", "__there")
    deep = with_prefixes(pages, first=1).join(s.where("prefix <> ''"), ["prefix", "lang"], "left").select(key, "lang", "depth", "prefix", "transparent", "__there")
    walk = top.unionByName(deep)
    deeper = Window.partitionBy(key).orderBy(F.desc("depth")).rowsBetween(Window.unboundedPreceding, -1)
    open_ = F.coalesce(F.min((F.coalesce("__there", F.lit(False)) & F.coalesce("transparent", F.lit(False))).cast("int")).over(deeper), F.lit(1)) == 1
    return walk.withColumn("__open", open_).where("__there AND __open").select(key, F.col("prefix").alias("section_path"), "depth", "lang")


def orphans(pages: DataFrame, sections: DataFrame) -> DataFrame:
    """Pages whose directory has no section in their language."""
    s = sections.select(F.col("section_path").alias("__path"), "lang")
    return pages.withColumn("__path", F.array_join("components", "/")).join(s, ["__path", "lang"], "left_anti").drop("__path")


def subsections(sections: DataFrame) -> DataFrame:
    """(section_path, lang, child_path) for each section and the sections right below it."""
    child = sections.where(F.size("components") > 0).select(
        F.array_join(F.slice("components", F.lit(1), F.size("components") - 1), "/").alias("section_path"), "lang", F.col("section_path").alias("child_path"))
    return child.join(sections.select("section_path", "lang"), ["section_path", "lang"])


def default_sections(sections: DataFrame, languages: DataFrame) -> DataFrame:
    """sections with a plain root section for each language (lang) that has none."""
    root = sections.where(F.size("components") == 0).select("lang")
    missing = languages.select("lang").distinct().join(root, "lang", "left_anti").select("lang", F.array().cast("array<string>").alias("components"), F.lit("").alias("section_path"))
    return sections.unionByName(missing, allowMissingColumns=True)


def prune_drafts(pages: DataFrame, draft_dirs: DataFrame) -> DataFrame:
    """pages without those under a draft directory (column dir), however deep."""
    keyed = pages.withColumn("__n", F.size("components"))
    hit = with_prefixes(keyed.select("file", "components")).join(draft_dirs.select(F.col("dir").alias("prefix")).distinct(), "prefix", "left_semi")
    return keyed.join(hit.select("file").distinct(), "file", "left_anti").drop("__n")


def translations(rows: DataFrame, key: str, canonical: str, lang: str = "lang") -> DataFrame:
    """(canonical, key, lang, other, other_lang) for the languages of one canonical path; alone, nothing."""
    a = rows.select(canonical, F.col(key), F.col(lang))
    b = rows.select(canonical, F.col(key).alias("other"), F.col(lang).alias("other_lang"))
    return a.join(b, canonical).where(F.col(key) != F.col("other"))
