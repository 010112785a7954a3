"""The topical graph: derived page fields, staleness, merges, pruning, upgrades."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths, text


def is_section_index(file_name: Column) -> Column:
    return (file_name == "_index.md") | file_name.startswith("_index.")


def is_stub(title: Column, body: Column, file_name: Column) -> Column:
    """Unfinished: no title or a dash for one, else an empty body, unless it is a section's index."""
    no_title = F.coalesce(title, F.lit("")).isin("", "—")
    return no_title | ((text.trim_all(F.coalesce(body, F.lit(""))) == "") & ~is_section_index(file_name))


def is_thin_exempt(path: Column) -> Column:
    return path.startswith("/privacy") | path.startswith("/terms") | path.startswith("/404")


def file_language(file_name: Column, languages, default: str) -> Column:
    return paths.stem_language(F.regexp_replace(file_name, r"\.md$", ""), languages, default)


def canonical_path(rel: Column, languages, default: str) -> Column:
    """`[/lang]/dir/name/` of a content file; index files stand for their directory."""
    name = F.element_at(F.split(rel, "/"), -1)
    lang = file_language(name, languages, default)
    stem = F.regexp_replace(F.regexp_replace(name, r"\.md$", ""), rf"\.{paths.one_of(sorted(languages))}$", "")
    dirs = F.regexp_replace(rel, "/?[^/]*$", "")
    own = F.when(stem.isin("_index", "index"), dirs).otherwise(F.concat_ws("/", F.nullif(dirs, F.lit("")), stem))
    return F.regexp_replace(F.concat(F.lit("/"), F.when(lang == default, "").otherwise(F.concat(lang, F.lit("/"))), own, F.lit("/")), "//+", "/")


def page_fields(files: DataFrame, languages, default: str = "en", thin_words: int = 300) -> DataFrame:
    """files (rel, title, body, noindex, sitemap_flag) with the derived columns of a graph page.

    The word count and the trimmed body are computed once, in a projection of their own.
    """
    c = F.col
    name = F.element_at(F.split("rel", "/"), -1)
    base = files.withColumns({"file_name": name, "body_trim": text.trim_all(F.coalesce("body", F.lit(""))), "word_count": text.graph_word_count(F.coalesce("body", F.lit("")))})
    base = base.withColumns({
        "id": paths.page_id(c("rel")), "canonical_path": canonical_path(c("rel"), languages, default), "lang": file_language(c("file_name"), languages, default),
        "stub": is_stub(c("title"), c("body"), c("file_name")), "noindex": F.coalesce("noindex", F.lit(False)), "h1": text.first_h1(c("body")),
        "summary": text.summarize(c("body_trim")), "content_hash": F.sha2("body_trim", 256)})
    return base.withColumns({
        "thin": ~c("stub") & (c("word_count") < thin_words) & ~is_thin_exempt(c("canonical_path")) & ~is_section_index(c("file_name")),
        "sitemap": ~(c("stub") | c("noindex") | ~F.coalesce("sitemap_flag", F.lit(True))),
        "translation_of": F.when(c("lang") != default, paths.language_neutral_path(c("id"), languages))}).drop("body_trim", "file_name")


def stale_pages(current: DataFrame, stored: DataFrame, default: str = "en") -> DataFrame:
    """Pages of the default language, no stubs and not empty, whose hash differs from the one that was last enriched.

    stored: (id, enriched_hash); it is kept apart from content_hash, so work that a
    limit put off is still stale on the next run.
    """
    old = stored.select("id", "enriched_hash")
    return current.join(old, "id", "left").where((F.col("lang") == default) & ~F.col("stub") & (F.col("word_count") > 0) & ~F.col("enriched_hash").eqNullSafe(F.col("content_hash"))).drop("enriched_hash")


def detach_topics(relations: DataFrame, stale: DataFrame) -> DataFrame:
    """relations (from, to, kind) without the topic edges of stale pages (id)."""
    about = F.col("kind") == "about"
    return relations.where(~about).unionByName(relations.where(about).join(stale.select(F.col("id").alias("from")), "from", "left_anti").select(*relations.columns))


def upsert_relations(relations: DataFrame, new: DataFrame) -> DataFrame:
    """A set of (from, to, kind)."""
    return relations.select("from", "to", "kind").unionByName(new.select("from", "to", "kind")).distinct()


def prune(pages: DataFrame, relations: DataFrame, seen: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages seen (id) in this walk; edges both of whose page ends were seen, other ends (topics) always hold."""
    ids = seen.select("id").distinct()
    kept = relations
    for end in ("from", "to"):
        page = F.col(end).startswith("content/")
        kept = kept.where(~page).unionByName(kept.where(page).join(ids.select(F.col("id").alias(end)), end, "left_semi").select(*kept.columns))
    return pages.join(ids, "id", "left_semi"), kept


def translation_edges(pages: DataFrame) -> DataFrame:
    """Both directions between a page and the one it translates, where that one exists."""
    a = pages.where("translation_of IS NOT NULL").select(F.col("id").alias("from"), F.col("translation_of").alias("to"))
    a = a.join(pages.select(F.col("id").alias("to")), "to", "left_semi").select("from", "to")
    return a.unionByName(a.select(F.col("to").alias("from"), F.col("from").alias("to"))).distinct().withColumn("kind", F.lit("translation"))


def hide_untranslated(pages: DataFrame, default: str = "en") -> DataFrame:
    """Siblings in other languages whose text is still the default one's: noindex, out of the site map."""
    family = Window.partitionBy(F.coalesce("translation_of", "id"), "content_hash")
    copy = (F.col("lang") != default) & (F.max((F.col("lang") == default).cast("int")).over(family) == 1)
    return pages.withColumn("__copy", copy).withColumns({"noindex": F.col("noindex") | F.col("__copy"), "sitemap": F.col("sitemap") & ~F.col("__copy")}).drop("__copy")


def lookup_topics(labels: DataFrame, topics: DataFrame) -> DataFrame:
    """labels (label) with the id of the topic of that label, ASCII case aside; null where there is none."""
    lower = lambda c: F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    known = topics.groupBy(lower(F.col("label")).alias("__l")).agg(F.min("id").alias("topic_id"))
    return labels.join(known, lower(F.col("label")) == F.col("__l"), "left").drop("__l")


def new_topic_ids(labels: DataFrame, topics: DataFrame) -> DataFrame:
    """(label, id) for labels without a topic: the slug where it is free, else slug-2, slug-3 and so on, the first number that is free; `topic` for empty slugs.

    Labels of one slug take their turns in the order of the labels. Free slugs are given out
    before numbers, so that a number never meets a new slug (`x-2` of a label "X 2"). Where
    numbers have gaps, they are filled: the k-th number that is free is 1 + k plus the
    used numbers below it, which a window over used and wanted numbers counts.
    """
    c = F.col
    fresh = lookup_topics(labels.select("label").distinct(), topics).where("topic_id IS NULL").select("label", paths.slug_ascii(c("label")).alias("slug"))
    taken = topics.select("id").distinct()
    free = fresh.select("slug").where("slug <> ''").distinct().join(taken.select(c("id").alias("slug")), "slug", "left_anti").withColumn("free", F.lit(1))
    turn = F.row_number().over(Window.partitionBy("slug").orderBy("label"))
    ranked = fresh.join(free, "slug", "left").select("label", "slug", (turn - F.coalesce("free", F.lit(0))).cast("long").alias("k"))
    number = F.try_to_number(F.regexp_extract("id", "-([1-9][0-9]{0,17})$", 1), F.lit("9" * 18)).cast("long")
    every = taken.unionByName(free.select(c("slug").alias("id")))
    used = every.select(F.regexp_replace("id", "-[0-9]+$", "").alias("slug"), number.alias("n")).where("n >= 2")
    # before the i-th used number u (from 0 on) stand u - 2 - i free ones
    gaps = used.select("slug", (c("n") - 1 - F.row_number().over(Window.partitionBy("slug").orderBy("n"))).alias("k"), F.lit(1).alias("used"), F.lit(None).cast("string").alias("label"))
    wanted = ranked.where("k > 0 AND slug <> ''").select("slug", "k", F.lit(0).alias("used"), "label")
    below = F.sum("used").over(Window.partitionBy("slug").orderBy("k", "used").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    numbered = gaps.unionByName(wanted).withColumn("n", c("k") + 1 + below).where("used = 0").select("label", "n")
    return ranked.join(numbered, "label", "left").select("label", F.when(c("slug") == "", "topic").when(c("n").isNull(), c("slug")).otherwise(F.concat("slug", F.lit("-"), "n")).alias("id"))


def seed_organization(organizations: DataFrame, name: str, id_: str = "", logo: str = "") -> DataFrame:
    """organizations (id, name, url, logo, same_as), with the site's own as the only one where there is none and the site has a name.

    Without an id, it is `org:` and the name's slug.
    """
    if not name:
        return organizations
    own = F.lit(id_) if id_ else F.concat(F.lit("org:"), paths.slug_ascii(F.lit(name)))
    none = organizations.agg(F.count("*").alias("n")).where("n = 0")
    seed = none.select(own.alias("id"), F.lit(name).alias("name"), F.lit("").alias("url"), F.lit(logo).alias("logo"), F.expr("cast(array() as array<string>)").alias("same_as"))
    return organizations.select("id", "name", "url", "logo", "same_as").unionByName(seed)


def merge_extracts(relations: DataFrame, topics: DataFrame, extracts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(topics, relations) after extracts (page, label, related array of labels): new topics, page edges, topic edges, no self edges."""
    labels = extracts.select("label").unionByName(extracts.select(F.explode("related").alias("label"))).where("label <> ''").distinct()
    made = new_topic_ids(labels, topics)
    every = topics.select("id", "label").unionByName(made.select("id", "label").dropDuplicates(["id"]))
    ids = lookup_topics(labels, every)
    about = extracts.join(ids, "label").select(F.col("page").alias("from"), F.col("topic_id").alias("to"), F.lit("about").alias("kind"))
    pairs = extracts.select("label", F.explode("related").alias("other")).join(ids.withColumnRenamed("topic_id", "from"), "label") \
        .join(ids.select(F.col("label").alias("other"), F.col("topic_id").alias("to")), "other").where(F.col("from") != F.col("to"))
    return every, upsert_relations(relations, about.unionByName(pairs.select("from", "to", F.lit("related").alias("kind"))))


def upgrade_v1(pages: DataFrame, relations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Pages (url, ...) of the first schema get path ids; edges that name a url are rewritten, others stay."""
    ids = pages.withColumns({"path": F.concat(F.lit("/"), F.regexp_replace(paths.norm_path(F.col("url")), "^/", ""))})
    ids = ids.withColumn("id", F.concat(F.lit("content"), F.regexp_replace(F.when(F.col("path") == "/", "/_index").otherwise(F.col("path")), "/$", ""), F.lit(".md")))
    m = ids.select(F.col("url").alias("__url"), F.col("id").alias("__id"))
    out = relations
    for end in ("from", "to"):
        out = out.join(m, F.col(end) == F.col("__url"), "left").withColumn(end, F.coalesce("__id", end)).drop("__url", "__id")
    return ids, out


def accept_overview(body: Column, low: int = 134, high: int = 167) -> Column:
    """Whether an overview has a fitting number of words."""
    return F.size(F.filter(F.split(body, text.SPACE + "+"), lambda w: w != "")).between(low, high)


def top_terms(docs: DataFrame, key: str, body: str, k: int = 5, min_length: int = 4) -> DataFrame:
    """(key, label, n, rank): the most frequent long words, an offline stand-in for a topic client."""
    words = docs.select(key, F.explode(F.regexp_extract_all(F.lower(body), F.lit(r"(\p{L}{" + str(min_length) + ",})"), F.lit(1))).alias("label"))
    counted = words.groupBy(key, "label").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("n"), "label"))
    return counted.withColumn("rank", rank).where(F.col("rank") <= k)
