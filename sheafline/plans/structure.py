"""Taxonomies and the tree of sections over the given tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import hierarchy, taxonomy
from ..sources.adapters import table
from .catalog import query

# taxonomies ---------------------------------------------------------------------------

_SLUG = "regexp_replace(regexp_replace(lower({}), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g')"
_TERMS = f"""WITH t AS (SELECT p_partkey, 'en' AS lang, 'brand' AS taxonomy_slug, p_brand AS term, {_SLUG.format('p_brand')} AS term_slug FROM part
  UNION ALL SELECT p_partkey, 'en', 'type', CASE WHEN p_partkey % 3 = 0 THEN upper(p_type) ELSE lower(p_type) END, {_SLUG.format('p_type')} FROM part),
h AS (SELECT *, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE DATE '2024-01-01' + CAST(p_partkey % 200 AS INT) END AS date, '/part/' || p_partkey || '/' AS permalink FROM t WHERE p_partkey % 13 <> 0)
"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = F.col
    spelled = F.when(c("p_partkey") % 3 == 0, F.upper("p_type")).otherwise(F.lower("p_type"))
    parts = table(spark, sf_dir, "part").select(
        "p_partkey", F.lit("en").alias("lang"), F.create_map(F.lit("Brand"), F.array("p_brand"), F.lit("Type"), F.array(spelled)).alias("taxonomies"),
        F.when(c("p_partkey") % 11 != 0, F.date_add(F.lit("2024-01-01").cast("date"), (c("p_partkey") % 200).cast("int"))).alias("date"),
        F.concat(F.lit("/part/"), "p_partkey", F.lit("/")).alias("permalink"), (c("p_partkey") % 13 == 0).alias("hidden"))
    return taxonomy.drop_empty_terms(taxonomy.explode_terms(parts, "taxonomies"))


@query("taxonomy_terms", _TERMS + "SELECT lang, taxonomy_slug, term_slug, min(term) AS name, count(*) AS page_count FROM h GROUP BY ALL")
def taxonomy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.term_counts(_terms(spark, sf_dir))


_MERGED = _TERMS + """, m AS (SELECT taxonomy_slug, term_slug, p_partkey, min(term) OVER (PARTITION BY taxonomy_slug, term_slug) AS name,
  CAST(row_number() OVER (PARTITION BY taxonomy_slug, term_slug ORDER BY term, date DESC NULLS LAST, permalink) AS INT) AS rank FROM h)
"""


@query("term_pages_ranked", _MERGED + "SELECT * FROM m")
def term_pages_ranked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.merge_terms(_terms(spark, sf_dir)).select("taxonomy_slug", "term_slug", "p_partkey", "name", "rank")


@query("taxonomy_merge_slug", _TERMS + "SELECT taxonomy_slug, term_slug, count(DISTINCT term) AS n_names, min(term) AS first_name, max(term) AS last_name FROM h GROUP BY ALL HAVING count(DISTINCT term) > 1")
def taxonomy_merge_slug(spark: SparkSession, sf_dir: str) -> DataFrame:
    by = _terms(spark, sf_dir).select("taxonomy_slug", "term_slug", "term").distinct().groupBy("taxonomy_slug", "term_slug")
    return by.agg(F.count("*").alias("n_names"), F.min("term").alias("first_name"), F.max("term").alias("last_name")).where("n_names > 1")


@query("term_lookup", _MERGED + "SELECT r_regionkey, 'brand' AS taxonomy_slug, 'brand-' || (r_regionkey + 11) AS term_slug, name, coalesce(n, 0) AS page_count FROM region LEFT JOIN (SELECT term_slug, min(name) AS name, count(*) AS n FROM m WHERE taxonomy_slug = 'brand' GROUP BY 1) ON term_slug = 'brand-' || (r_regionkey + 11)")
def term_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    wanted = table(spark, sf_dir, "region").select("r_regionkey", F.lit("en").alias("lang"), F.lit("brand").alias("taxonomy_slug"), F.concat(F.lit("brand-"), F.col("r_regionkey") + 11).alias("term_slug"))
    found = taxonomy.lookup_terms(wanted, taxonomy.term_counts(_terms(spark, sf_dir)), required=False)
    return found.select("r_regionkey", "taxonomy_slug", "term_slug", "name", F.coalesce("page_count", F.lit(0)).alias("page_count"))


@query("unconfigured_terms", _TERMS + "SELECT taxonomy_slug, count(*) AS n FROM h WHERE taxonomy_slug NOT IN (SELECT lower(substring(r_name, 1, 0)) || 'brand' FROM region) GROUP BY 1")
def unconfigured_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    known = table(spark, sf_dir, "region").select(F.lit("en").alias("lang"), F.lit("brand").alias("taxonomy_slug"))
    return taxonomy.unconfigured(_terms(spark, sf_dir), known).groupBy("taxonomy_slug").agg(F.count("*").alias("n"))


@query("archive_by_year", "SELECT CAST(year(o_orderdate) AS INT) AS year, count(*) AS n_orders, min(o_orderkey) AS first_key, CAST(max(o_orderdate) AS DATE) AS newest FROM orders GROUP BY 1")
def archive_by_year(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(
        F.count("*").alias("n_orders"), F.min("o_orderkey").alias("first_key"), F.max("o_orderdate").cast("date").alias("newest"))


_CLAIMED = """WITH p AS (SELECT page_id, regexp_replace(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)', 1), '\\.html$|/$', '') || '/' AS path FROM pages),
c AS (SELECT path AS url, page_id AS file FROM p UNION SELECT '/p' || page_id % 97 || '/' AS url, page_id FROM p WHERE page_id % 3 = 0)
"""


def _claimed(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.regexp_extract("url", "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    pages = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("file"), F.concat(F.regexp_replace(path, r"\.html$|/$", ""), F.lit("/")).alias("path"),
        F.when(F.col("page_id") % 3 == 0, F.array(F.concat(F.lit("p"), F.col("page_id") % 97, F.lit("/")))).alias("aliases"))
    return taxonomy.claimed_paths(pages)


@query("path_collisions", _CLAIMED + "SELECT url, count(*) AS n_files, min(file) AS first_file, max(file) AS last_file FROM c GROUP BY url HAVING count(*) > 1")
def path_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.path_collisions(_claimed(spark, sf_dir))


@query("colliding_files", _CLAIMED + "SELECT url, file FROM c QUALIFY count(*) OVER (PARTITION BY url) > 1")
def colliding_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return taxonomy.colliding_files(_claimed(spark, sf_dir))


@query("claimed_paths", _CLAIMED + "SELECT url, file FROM c")
def claimed_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _claimed(spark, sf_dir)


# the tree of sections ---------------------------------------------------------------------

#: Pages lie in lang/source/family directories; sections are their prefixes, some of which are missing.
_TREE = """WITH p AS (SELECT doc_id, 'en' AS lang, [lang, source, 'f' || doc_id % 3] AS components, CASE WHEN doc_id % 19 = 0 THEN true WHEN doc_id % 29 = 0 THEN false ELSE NULL END AS hidden FROM documents),
x AS (SELECT doc_id, lang, components, d AS depth, array_to_string(list_slice(components, 1, d), '/') AS prefix FROM p, LATERAL (SELECT unnest([0, 1, 2, 3]) AS d)),
s AS (SELECT section_path, n, depth, CASE WHEN n % 6 = 0 THEN true WHEN n % 6 = 1 THEN false ELSE NULL END AS hidden, n % 2 = 0 AS transparent, CASE WHEN n % 4 = 1 THEN 'tpl-' || n ELSE NULL END AS page_template
  FROM (SELECT prefix AS section_path, max(depth) AS depth, CAST(list_sum(list_transform(string_split(prefix, ''), lambda c: CASE WHEN c = '' THEN 0 ELSE ord(c) END)) AS BIGINT) AS n FROM x GROUP BY prefix) WHERE n % 7 <> 3),
sx AS (SELECT s.section_path, s.hidden, s.depth, a.section_path AS above, a.depth AS above_depth, a.hidden AS above_hidden FROM s LEFT JOIN s a ON a.depth < s.depth AND (a.section_path = '' OR starts_with(s.section_path, a.section_path || '/'))),
sh AS (SELECT section_path, coalesce(any_value(hidden), arg_max(above_hidden, above_depth) FILTER (WHERE above_hidden IS NOT NULL), false) AS is_hidden FROM sx GROUP BY section_path)
"""


def _tree(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(pages, sections)."""
    c = F.col
    pages = table(spark, sf_dir, "documents").select(
        "doc_id", F.array("lang", "source", F.concat(F.lit("f"), c("doc_id") % 3)).alias("components"), F.lit("en").alias("lang"),
        F.when(c("doc_id") % 19 == 0, True).when(c("doc_id") % 29 == 0, False).alias("hidden"))
    # the number of a section is the sum of its path's character codes
    prefixes = hierarchy.with_prefixes(pages.select("components").distinct()).select(F.slice("components", F.lit(1), c("depth")).alias("components"), c("prefix").alias("section_path")).distinct()
    n = F.aggregate(F.filter(F.split("section_path", ""), lambda x: x != ""), F.lit(0).cast("long"), lambda a, x: a + F.ascii(x))
    sections = prefixes.withColumn("n", n).where("n % 7 <> 3").select(
        "components", "section_path", F.lit("en").alias("lang"), F.when(c("n") % 6 == 0, True).when(c("n") % 6 == 1, False).alias("hidden"),
        (c("n") % 2 == 0).alias("transparent"), F.when(c("n") % 4 == 1, F.concat(F.lit("tpl-"), "n")).alias("page_template"))
    return pages, sections


@query("hierarchy_ancestors", _TREE + "SELECT doc_id, CAST(x.depth AS INT) AS depth, section_path FROM x JOIN s ON s.section_path = x.prefix")
def hierarchy_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    return hierarchy.ancestors(pages, sections, "doc_id", own=True).select("doc_id", "depth", "section_path")


@query("hidden_inherited", _TREE + "SELECT doc_id, coalesce(p.hidden, sh.is_hidden, false) AS is_hidden FROM p LEFT JOIN sh ON sh.section_path = array_to_string(components, '/')")
def hidden_inherited(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    return hierarchy.page_hidden(pages, hierarchy.resolve_hidden(sections)).select("doc_id", "is_hidden")


@query("section_hidden", _TREE + "SELECT * FROM sh")
def section_hidden(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections = _tree(spark, sf_dir)
    return hierarchy.resolve_hidden(sections).select("section_path", "is_hidden")


@query("page_templates", _TREE + "SELECT doc_id, arg_max(page_template, x.depth) AS page_template FROM x JOIN s ON s.section_path = x.prefix WHERE page_template IS NOT NULL GROUP BY doc_id")
def page_templates(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    return hierarchy.nearest_setting(pages, sections, "doc_id", "page_template", own=True)


@query("transparent_rollup", _TREE + """, w AS (SELECT doc_id, x.depth, s.section_path, coalesce(min(CASE WHEN s.transparent THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY x.depth DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS ok
  FROM x LEFT JOIN s ON s.section_path = x.prefix) SELECT doc_id, CAST(depth AS INT) AS depth, section_path FROM w WHERE ok = 1 AND section_path IS NOT NULL""")
def transparent_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    return hierarchy.roll_up(pages, sections, "doc_id").select("doc_id", "depth", "section_path")


@query("orphans", _TREE + "SELECT doc_id FROM p WHERE array_to_string(components, '/') NOT IN (SELECT section_path FROM s)")
def orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    return hierarchy.orphans(pages, sections).select("doc_id")


@query("subsections", _TREE + "SELECT a.section_path, c.section_path AS child_path FROM s a JOIN s c ON c.depth = a.depth + 1 AND (a.section_path = '' OR starts_with(c.section_path, a.section_path || '/'))")
def subsections(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, sections = _tree(spark, sf_dir)
    return hierarchy.subsections(sections).select("section_path", "child_path")


@query("site_totals", _TREE + "SELECT count(*) AS n_pages, count(*) FILTER (WHERE array_to_string(components, '/') NOT IN (SELECT section_path FROM s)) AS n_orphans, (SELECT count(*) FROM s) - 1 AS n_sections FROM p")
def site_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, sections = _tree(spark, sf_dir)
    kinds = pages.select(F.lit("page").alias("kind")).unionByName(hierarchy.orphans(pages, sections).select(F.lit("orphan").alias("kind"))).unionByName(sections.select(F.lit("section").alias("kind")))
    return kinds.agg(F.count_if(F.col("kind") == "page").alias("n_pages"), F.count_if(F.col("kind") == "orphan").alias("n_orphans"), (F.count_if(F.col("kind") == "section") - 1).alias("n_sections"))


@query("draft_pruning", _TREE + "SELECT doc_id FROM p WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.doc_id = p.doc_id AND x.prefix IN ('fr', 'en/src3', 'de/src1/f2'))")
def draft_pruning(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, _ = _tree(spark, sf_dir)
    drafts = hierarchy.with_prefixes(pages.select("components").distinct()).where(F.col("prefix").isin("fr", "en/src3", "de/src1/f2")).select(F.col("prefix").alias("dir"))
    return hierarchy.prune_drafts(pages.withColumn("file", F.col("doc_id")), drafts).select("doc_id")


@query("translations_by_canonical", "SELECT a.doc_id // 4 AS canonical, a.doc_id, a.lang, b.doc_id AS other, b.lang AS other_lang FROM documents a JOIN documents b ON a.doc_id // 4 = b.doc_id // 4 AND a.doc_id <> b.doc_id")
def translations_by_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.floor(F.col("doc_id") / 4).alias("canonical"), "doc_id", "lang")
    return hierarchy.translations(docs, "doc_id", "canonical")


@query("geo_ancestors", "SELECT c_custkey, '/' || lower(r_name) || '/' || lower(n_name) || '/' AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey")
def geo_ancestors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers under their nation and region: both sides of the joins are fixed lists of the world's regions."""
    c, n, r = (table(spark, sf_dir, t) for t in ("customer", "nation", "region"))
    joined = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return joined.select("c_custkey", F.concat(F.lit("/"), F.lower("r_name"), F.lit("/"), F.lower("n_name"), F.lit("/")).alias("path"))


@query("last_event_per_path", "SELECT user_id, event_id, event_type FROM events QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1")
def last_event_per_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = F.max_by(F.struct("event_id", "event_type"), F.struct("ts", "event_id")).alias("e")
    return table(spark, sf_dir, "events").groupBy("user_id").agg(last).select("user_id", "e.event_id", "e.event_type")


@query("toc_parents", """WITH h AS (SELECT conv_id, turn AS pos, CAST(1 + length(text) % 6 AS INT) AS level FROM conversations)
SELECT a.conv_id, a.pos, a.level, max(b.pos) AS parent_pos FROM h a LEFT JOIN h b ON b.conv_id = a.conv_id AND b.pos < a.pos AND b.level < a.level GROUP BY ALL""")
def toc_parents(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.headings import toc_parents as parents

    heads = table(spark, sf_dir, "conversations").select("conv_id", F.col("turn").alias("pos"), (1 + F.length("text") % 6).cast("int").alias("level"))
    return parents(heads, "conv_id")


