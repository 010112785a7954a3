"""Files, headers, data formats, outputs and changes over the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import dates, paths, text
from ..operators import hierarchy, images, ordering, publish
from ..sources import clients, data, documents
from ..sources.adapters import table
from ..streaming import changes
from .catalog import query


def _cat(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


# headers --------------------------------------------------------------------------------------------


def _headed(spark: SparkSession, sf_dir: str, kind: str) -> DataFrame:
    """documents as files: a header of this kind, then the text."""
    c = F.col
    draft = F.when(c("doc_id") % 29 == 0, "true").otherwise("false")
    if kind == "toml":
        head = _cat('+++\ntitle = "Doc ', c("doc_id"), '"\ndate = 2024-01-0', c("doc_id") % 9 + 1, "\nweight = ", c("doc_id") % 50, "\ndraft = ", draft, '\n[taxonomies]\ntags = ["', c("source"), '", "all"]\n[extra]\nn = ', c("doc_id"), "\n+++\n")
    else:
        head = _cat('---\ntitle: "Doc ', c("doc_id"), '"\ndate: 2024-01-0', c("doc_id") % 9 + 1, "\nweight: ", c("doc_id") % 50, "\ndraft: ", draft, "\ntaxonomies:\n  tags:\n    - ", c("source"), "\n    - all\nextra:\n  n: ", c("doc_id"), "\n---\n")
    file = _cat("content/", c("source"), "/doc-", c("doc_id"), ".md")
    return table(spark, sf_dir, "documents").select(file.alias("file"), F.concat(head, F.coalesce("text", F.lit(""))).alias("content"))


def _header_sql(kind: str) -> str:
    return f"""SELECT 'content/' || source || '/doc-' || doc_id || '.md' AS file, '{kind}' AS header_kind, 'Doc ' || doc_id AS title, '2024-01-0' || (doc_id % 9 + 1) AS date,
  CAST(doc_id % 50 AS BIGINT) AS weight, doc_id % 29 = 0 AS draft, source || ',all' AS tags, '{{"n": ' || doc_id || '}}' AS extra, sha256(coalesce(text, '')) AS body, CAST(NULL AS VARCHAR) AS error FROM documents"""


def _header_rows(files: DataFrame) -> DataFrame:
    return documents.parse_documents(files).select("file", "header_kind", "title", "date", "weight", "draft", F.array_join(F.col("taxonomies")["tags"], ",").alias("tags"), "extra", F.sha2("body", 256).alias("body"), "error")


@query("header_toml", _header_sql("toml"))
def header_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_rows(_headed(spark, sf_dir, "toml"))


@query("header_yaml", _header_sql("yaml"))
def header_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _header_rows(_headed(spark, sf_dir, "yaml"))


@query("header_errors", """SELECT 'd' || doc_id || '.md' AS file, 'd' || doc_id || '.md: ' || CASE doc_id % 6 WHEN 0 THEN 'no header between +++ or --- lines' WHEN 1 THEN 'slug is empty' WHEN 2 THEN 'path is empty'
  WHEN 3 THEN 'a taxonomy term is empty' WHEN 4 THEN 'weight must not be negative' ELSE 'title must be str' END AS error FROM documents""")
def header_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every file breaks one rule; all errors come out together."""
    c, n = F.col, F.col("doc_id") % 6
    line = F.when(n == 1, 'slug = ""').when(n == 2, 'path = ""').when(n == 3, 'taxonomies = {tags = ["a", ""]}').when(n == 4, "weight = -1").otherwise("title = 5")
    content = F.when(n == 0, c("text")).otherwise(F.concat(F.lit("+++\n"), line, F.lit("\n+++\n"), c("text")))
    files = table(spark, sf_dir, "documents").select(_cat("d", c("doc_id"), ".md").alias("file"), content.alias("content"))
    return documents.parse_documents(files).where("error IS NOT NULL").select("file", "error")


@query("document_keys", """SELECT file, lang, slug, CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END || source || '/' || slug || '/' AS url_path,
  'https://example.org' || CASE WHEN lang = 'en' THEN '/' ELSE '/' || lang || '/' END || source || '/' || slug || '/' AS permalink, date FROM (
  SELECT 'content/' || source || '/2024-02-0' || (doc_id % 9 + 1) || '-My Doc ' || doc_id || CASE WHEN lang = 'en' THEN '' ELSE '.' || lang END || '.md' AS file, lang, source, 'my-doc-' || doc_id AS slug, '2024-02-0' || (doc_id % 9 + 1) AS date FROM documents)""")
def document_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language, date, slug and address from names of files."""
    c = F.col
    file = _cat("content/", c("source"), "/2024-02-0", c("doc_id") % 9 + 1, "-My Doc ", c("doc_id"), F.when(c("lang") == "en", "").otherwise(F.concat(F.lit("."), "lang")), ".md")
    none = {k: F.lit(None).cast("string") for k in ("slug", "date", "path")}
    files = table(spark, sf_dir, "documents").select(file.alias("file"), F.lit(False).alias("is_section")).withColumns(none)
    return documents.with_keys(files, ["de", "en", "es", "fr"]).select("file", "lang", "slug", "url_path", "permalink", "date")


# data files ----------------------------------------------------------------------------------------------


def _customers(spark: SparkSession, sf_dir: str, ending: str, content: Column) -> DataFrame:
    files = table(spark, sf_dir, "customer").select(_cat("c", F.col("c_custkey"), "." + ending).alias("file"), content.alias("content"))
    return data.load_data(files)


def _two(loaded: DataFrame, key: str, segment: str) -> DataFrame:
    return loaded.select("file", data.leaf(F.col("data"), key, "long").alias("key"), data.leaf(F.col("data"), segment).alias("segment"), "error")


def _two_sql(ending: str) -> str:
    return f"SELECT 'c' || c_custkey || '.{ending}' AS file, CAST(c_custkey AS BIGINT) AS key, c_mktsegment AS segment, CAST(NULL AS VARCHAR) AS error FROM customer"


@query("data_json", _two_sql("json"))
def data_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(_customers(spark, sf_dir, "json", F.to_json(F.struct(F.struct(F.array("c_custkey").alias("keys")).alias("a"), F.col("c_mktsegment").alias("b")))), "a.keys[0]", "b")


@query("data_yaml", _two_sql("yaml"))
def data_yaml(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _two(_customers(spark, sf_dir, "yaml", _cat("# a file\na:\n  keys: [", F.col("c_custkey"), ", 2]\nb: '", F.col("c_mktsegment"), "'\n")), "a.keys[0]", "b")


@query("data_toml", "SELECT *, '2024-05-0' || (key % 9 + 1) AS day FROM (" + _two_sql("toml") + ")")
def data_toml(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates of TOML come out as text."""
    loaded = _customers(spark, sf_dir, "toml", _cat('b = "', F.col("c_mktsegment"), '"\nday = 2024-05-0', F.col("c_custkey") % 9 + 1, "\n[a]\nkeys = [", F.col("c_custkey"), "]\n"))
    return _two(loaded.withColumn("file", F.col("file")), "a.keys[0]", "b").join(loaded.select("file", data.leaf(F.col("data"), "day").alias("day")), "file")


@query("data_csv", _two_sql("csv") + " UNION ALL SELECT 'c' || c_custkey || 'x.csv', NULL, NULL, 'c' || c_custkey || 'x.csv: rows differ in their number of fields' FROM customer")
def data_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A blank line is no row; a row of another width is an error."""
    good = _customers(spark, sf_dir, "csv", _cat("key,segment\n\n", F.col("c_custkey"), ',"', F.col("c_mktsegment"), '"\n'))
    files = table(spark, sf_dir, "customer").select(_cat("c", F.col("c_custkey"), "x.csv").alias("file"), F.lit("a,b\n1\n").alias("content"))
    rows = lambda loaded: loaded.select("file", F.try_variant_get("data", "$.records[0][0]", "string").cast("long").alias("key"), F.try_variant_get("data", "$.records[0][1]", "string").alias("segment"), "error")
    return rows(good).unionByName(rows(data.load_data(files)))


@query("data_xml", _two_sql("xml"))
def data_xml(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _customers(spark, sf_dir, "xml", _cat('<r><c key="', F.col("c_custkey"), '">', F.col("c_mktsegment"), "</c></r>"))
    return loaded.select("file", F.try_variant_get("data", "$.r.c['@key']", "string").cast("long").alias("key"), F.try_variant_get("data", "$.r.c['$text']", "string").alias("segment"), "error")


@query("data_bibtex", _two_sql("bib"))
def data_bibtex(spark: SparkSession, sf_dir: str) -> DataFrame:
    loaded = _customers(spark, sf_dir, "bib", _cat("@book{k", F.col("c_custkey"), ",\n  Title = {", F.col("c_mktsegment"), "},\n  year = 2024\n}\n"))
    entry = "$.bibliographies[0]"
    return loaded.select("file", F.regexp_replace(F.try_variant_get("data", f"{entry}.citation_key", "string"), "^k", "").cast("long").alias("key"), F.try_variant_get("data", f"{entry}.tags.title", "string").alias("segment"), "error")


@query("data_plain", "SELECT 'p' || page_id || '.txt' AS file, sha256(html) AS content FROM pages UNION ALL SELECT 'p' || page_id || '.what', sha256(url) FROM pages")
def data_plain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain text, and what an unknown ending is taken for."""
    pages = table(spark, sf_dir, "pages")
    files = pages.select(_cat("p", F.col("page_id"), ".txt").alias("file"), F.col("html").alias("content")).unionByName(pages.select(_cat("p", F.col("page_id"), ".what").alias("file"), F.col("url").alias("content")))
    return data.load_data(files).select("file", F.sha2(F.try_variant_get("data", "$", "string"), 256).alias("content"))


@query("data_missing", "SELECT 'p' || page_id || '.json' AS file, required, CASE WHEN page_id % 5 <> 0 THEN CAST(page_id AS BIGINT) END AS id, CASE WHEN page_id % 5 = 0 AND required THEN 'p' || page_id || '.json is missing' END AS error FROM pages, (VALUES (true), (false)) r(required)")
def data_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = table(spark, sf_dir, "pages").select(_cat("p", F.col("page_id"), ".json").alias("file"), F.when(F.col("page_id") % 5 != 0, F.to_json(F.struct("page_id"))).alias("content"))
    rows = lambda required: data.load_data(files, required=required).select("file", F.lit(required).alias("required"), data.leaf(F.col("data"), "page_id", "long").alias("id"), "error")
    return rows(True).unionByName(rows(False))


@query("string_lists", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN event_type || ',x' WHEN 1 THEN event_type ELSE '' END AS list FROM events")
def string_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id") % 3
    one = F.to_json(F.struct(F.col("event_type").alias("a")))
    many = F.to_json(F.struct(F.array("event_type", F.lit("x")).alias("a")))
    events = table(spark, sf_dir, "events").select("event_id", F.parse_json(F.when(n == 0, many).when(n == 1, one).otherwise('{"a": 5.5, "b": 1}')).alias("v"))
    return events.select("event_id", F.when(F.col("event_id") % 3 == 2, "").otherwise(F.array_join(data.string_list(F.col("v"), "a"), ",")).alias("list"))


@query("deep_leaves", "SELECT p_partkey, repeat('n.', 11) || 'last' AS path, p_name AS text FROM part")
def deep_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Leaves twelve levels down; keys that never hold copy lead nowhere."""
    inner = F.struct(F.col("p_name").alias("last"), F.col("p_type").alias("slug"), F.col("p_type").alias("big_image"))
    for _ in range(11):
        inner = F.struct(inner.alias("n"))
    return data.leaves(table(spark, sf_dir, "part").select("p_partkey", F.to_json(inner).alias("extra")), "p_partkey", "extra")


@query("copy_strings", r"""SELECT p_partkey, kind, copy FROM (SELECT p_partkey, p_name, p_type, p_brand FROM part), LATERAL (VALUES ('name', regexp_matches(p_name, '[A-Za-z]') AND NOT (regexp_matches(p_name, '^[a-z0-9_./-]+$') AND regexp_matches(p_name, '[_./-]'))),
  ('number', false), ('path', false), ('mail', false), ('slug', false), ('tag', false), ('style', false), ('sentence', true), ('mixed', true)) t(kind, copy)""")
def copy_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    cases = {"name": F.col("p_name"), "number": _cat("$", k, " / 04"), "path": _cat("/parts/", k), "mail": _cat("mailto:p", k, "@example.org"), "slug": _cat("part_", k, "-big.jpg"), "tag": F.when(k % 2 == 0, "en-US").otherwise("por-BR"),
             "style": _cat("translateY(", k, "px) rotate(3deg)"), "sentence": _cat("Part ", k, " is new"), "mixed": _cat("Part-", k)}
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("kind"), v.alias("text")) for n, v in cases.items()]))
    return table(spark, sf_dir, "part").select("p_partkey", rows.alias("r")).select("p_partkey", "r.kind", data.is_copy(F.col("r.text")).alias("copy"))


@query("key_kinds", "SELECT event_id, event_type || suffix AS key, skipped, lookup FROM events, (VALUES ('', false, false), ('_url', true, false), ('_hash', true, false), ('_key', false, true), ('.id', true, false), ('.list_key[3]', false, true)) s(suffix, skipped, lookup)")
def key_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys that never hold copy, and keys that name other data."""
    suffix = F.explode(F.array(*map(F.lit, ["", "_url", "_hash", "_key", ".id", ".list_key[3]"])))
    rows = table(spark, sf_dir, "events").select("event_id", "event_type", suffix.alias("s")).select("event_id", F.concat("event_type", "s").alias("key"))
    return rows.select("event_id", "key", data.skipped_key(F.element_at(F.split("key", r"\."), -1)).alias("skipped"), data.data_key(F.col("key")).alias("lookup"))


# files of a site -----------------------------------------------------------------------------------------


@query("colocated_assets", """SELECT 'content/p' || p_partkey || '/index.md' AS owner, rel, 'content/p' || p_partkey || '/' || rel AS asset FROM part, (VALUES ('a.png'), ('sub/b.jpg')) f(rel)""")
def colocated_assets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files beside and below a page's index; Markdown, dot and temporary files are none, nor are files of other folders."""
    names = ["index.md", "note.md", "a.png", "sub/b.jpg", ".hidden", "c.png~", "d.swp"]
    own = F.explode(F.array(*[_cat("content/p", F.col("p_partkey"), "/", n) for n in names], _cat("content/q", F.col("p_partkey"), "/a.png")))
    return documents.colocated_assets(table(spark, sf_dir, "part").select(own.alias("file")))


@query("index_beside_section", "SELECT 'content/p' || p_partkey AS dir FROM part WHERE p_size % 2 = 0")
def index_beside_section(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _cat("content/p", F.col("p_partkey"), "/")
    both = F.when(F.col("p_size") % 2 == 0, F.array(F.concat(d, F.lit("index.md")), F.concat(d, F.lit("_index.md")))).otherwise(F.array(F.concat(d, F.lit("index.md")), F.concat(d, F.lit("x_index.md"))))
    return documents.index_beside_section(table(spark, sf_dir, "part").select(F.explode(both).alias("file")))


@query("first_existing", "SELECT path, file FROM (SELECT '@/' || p_partkey || '.json' AS path, CASE WHEN p_size % 2 = 0 THEN p_partkey || '.json' WHEN p_size % 3 = 0 THEN 'static/' || p_partkey || '.json' END AS file FROM part UNION ALL SELECT '../' || p_partkey || '.json', NULL FROM part)")
def first_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files in the first of three roots that has them; a path that leaves a root finds nothing."""
    part = table(spark, sf_dir, "part")
    name = _cat(F.col("p_partkey"), ".json")
    files = part.where("p_size % 2 = 0").select(name.alias("file")).unionByName(part.where("p_size % 3 = 0").select(F.concat(F.lit("static/"), name).alias("file")))
    wanted = part.select(F.explode(F.array(F.concat(F.lit("@/"), name), F.concat(F.lit("../"), name))).alias("path"))
    return documents.first_existing(wanted, files, ["", "content", "static"])


@query("changed_files", """SELECT coalesce(a.file, b.file) AS file, CASE WHEN a.h IS NULL THEN 'create' WHEN b.h IS NULL THEN 'remove' ELSE 'modify' END AS change
FROM (SELECT 'd' || doc_id AS file, sha256(text) AS h FROM documents WHERE doc_id % 10 <> 0) a FULL JOIN (SELECT 'd' || doc_id AS file, sha256(CASE WHEN doc_id % 3 = 0 THEN text || '!' ELSE text END) AS h FROM documents WHERE doc_id % 7 <> 0) b ON a.file = b.file
WHERE a.h IS DISTINCT FROM b.h""")
def changed_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two snapshots of a folder: what was created, modified and removed between them."""
    docs = table(spark, sf_dir, "documents").withColumn("file", _cat("d", F.col("doc_id")))
    before = docs.where("doc_id % 10 <> 0").select("file", F.col("text").alias("content"))
    after = docs.where("doc_id % 7 <> 0").select("file", F.when(F.col("doc_id") % 3 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")).alias("content"))
    return documents.changed_files(before, after)


@query("url_families", """SELECT DISTINCT 'https://example.org' || lang || '/p' || page_id || '/' AS url, NULL AS unmatched FROM pages, (VALUES ('/en'), ('/fr')) l(lang) WHERE page_id % 3 = 0
UNION ALL SELECT NULL, 'x/' || page_id || '.md' FROM pages WHERE page_id % 3 = 1""")
def url_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A change of one language asks for the addresses of all; changed files without a page are told apart."""
    c, pages = F.col, table(spark, sf_dir, "pages")
    own = F.explode(F.array(F.struct(_cat("p", c("page_id"), ".md").alias("file"), _cat("https://example.org/en/p", c("page_id"), "/").alias("permalink")),
                            F.struct(_cat("p", c("page_id"), ".fr.md").alias("file"), _cat("https://example.org/fr/p", c("page_id"), "/").alias("permalink"))))
    changed = pages.where("page_id % 3 < 2").select(F.when(c("page_id") % 3 == 0, _cat("p", c("page_id"), ".fr.md")).otherwise(_cat("x/", c("page_id"), ".md")).alias("file"))
    urls, rest = documents.url_family(changed, pages.select(own.alias("o")).select("o.*"), ["fr"])
    return urls.select("url", F.lit(None).cast("string").alias("unmatched")).unionByName(rest.select(F.lit(None).cast("string").alias("url"), F.col("file").alias("unmatched")))


@query("url_list", "SELECT url FROM pages WHERE page_id % 3 = 0")
def url_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of a list: addresses, comments and blanks."""
    n = F.col("page_id") % 3
    return documents.url_list(table(spark, sf_dir, "pages").select(F.when(n == 0, F.concat(F.lit("  "), "url", F.lit(" "))).when(n == 1, F.concat(F.lit("# "), "url")).otherwise("  ").alias("value")))


@query("sitemap_locations", "SELECT page_id, url || '?a=1&b=<' || page_id || '>' AS url FROM pages")
def sitemap_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of site maps, read again from their escaped form."""
    plain = _cat(F.col("url"), "?a=1&b=<", F.col("page_id"), ">")
    xml = F.concat(F.lit("<urlset>\n<url>\n<loc> "), text.escape_xml(plain), F.lit("\n</loc></url></urlset>"))
    return table(spark, sf_dir, "pages").select("page_id", F.explode(documents.sitemap_locations(xml)).alias("url"))


@query("pages_offline", "SELECT url, CAST(NULL AS VARCHAR) AS html, 'no client' AS error FROM pages")
def pages_offline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Without a client nothing is fetched and every row says so."""
    return documents.fetch_pages(table(spark, sf_dir, "pages"))


@query("submitted_urls", "SELECT CAST((r - 1) // 1000 + 1 AS INT) AS batch, count(*) AS n, CAST(NULL AS INT) AS status FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS r FROM orders) GROUP BY 1")
def submitted_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of one host in batches of a thousand; those of other hosts stay out."""
    both = F.explode(F.array(_cat("https://example.org/o/", F.col("o_orderkey")), _cat("https://other.org/o/", F.col("o_orderkey"))))
    return clients.submit_urls(table(spark, sf_dir, "orders").select(both.alias("url")), "example.org", size=1000)


# images -------------------------------------------------------------------------------------------------


@query("image_metadata", """SELECT p_partkey || k AS path, CASE k WHEN 'x' THEN NULL ELSE CASE k WHEN 'p' THEN 'png' WHEN 'g' THEN 'gif' ELSE 'svg' END END AS format, CASE k WHEN 'p' THEN 'image/png' WHEN 'g' THEN 'image/gif' WHEN 's' THEN 'image/svg+xml' END AS mime,
  CASE WHEN k <> 'x' THEN CAST(p_size * 7 + 1 AS INT) END AS width, CASE WHEN k <> 'x' THEN CAST(p_partkey % 200 + 1 AS INT) END AS height, CASE k WHEN 'x' THEN 'not a known image' END AS error FROM part, (VALUES ('p'), ('g'), ('s'), ('x')) f(k)""")
def image_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Formats and sizes from the first bytes of files."""
    w, h = (F.col("p_size") * 7 + 1).cast("int"), (F.col("p_partkey") % 200 + 1).cast("int")
    hexa = lambda n, digits: F.lpad(F.hex(n), digits, "0")
    turned = lambda n: F.concat(F.substring(hexa(n, 4), 3, 2), F.substring(hexa(n, 4), 1, 2))
    png = F.unhex(F.concat(F.lit("89504E470D0A1A0A0000000D49484452"), hexa(w, 8), hexa(h, 8)))
    gif = F.unhex(F.concat(F.lit("474946383961"), turned(w), turned(h)))
    svg = F.encode(_cat('<svg xmlns="x" width="', w, '" height="', h, '">'), "UTF-8")
    files = F.explode(F.array(*[F.struct(_cat(F.col("p_partkey"), k).alias("path"), v.alias("content")) for k, v in (("p", png), ("g", gif), ("s", svg), ("x", F.encode(F.lit("text"), "UTF-8")))]))
    return images.read_metadata(table(spark, sf_dir, "part").select(files.alias("f")).select("f.*"))


@query("image_requests", """SELECT * FROM (SELECT p_partkey, CASE WHEN format = 'bmp' THEN 'unknown format' WHEN format = 'jpeg' AND q NOT BETWEEN 1 AND 100 THEN 'quality of jpeg must be 1 to 100' WHEN format = 'webp' AND q NOT BETWEEN 0 AND 100 THEN 'quality of webp must be 0 to 100' WHEN filter = 'box' THEN 'unknown filter' END AS reason,
  CASE WHEN format = 'auto' THEN 'jpeg' ELSE format END AS output FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'bmp' WHEN 1 THEN 'jpeg' WHEN 2 THEN 'webp' WHEN 3 THEN 'png' ELSE 'auto' END AS format, CASE WHEN p_size % 3 = 0 THEN 'box' ELSE 'lanczos3' END AS filter, p_size * 3 AS q FROM part)) WHERE reason IS NOT NULL""")
def image_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_partkey") % 5
    kind = F.when(n == 0, "bmp").when(n == 1, "jpeg").when(n == 2, "webp").when(n == 3, "png").otherwise("auto")
    asked = table(spark, sf_dir, "part").select("p_partkey", kind.alias("format"), F.when(F.col("p_size") % 3 == 0, "box").otherwise("lanczos3").alias("filter"), (F.col("p_size") * 3).alias("quality"))
    return images.bad_requests(asked).select("p_partkey", "reason", images.output_format(F.col("format"), F.lit("jpeg")).alias("output"))


@query("rotated_sizes", "SELECT p_partkey, CAST(CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 THEN p_partkey % 77 ELSE p_size END AS INT) AS width, CAST(CASE WHEN p_partkey % 10 BETWEEN 5 AND 8 THEN p_size ELSE p_partkey % 77 END AS INT) AS height FROM part")
def rotated_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = text.rotated_size(F.col("p_size").cast("int"), (F.col("p_partkey") % 77).cast("int"), F.nullif(F.col("p_partkey") % 10, F.lit(0)))
    return table(spark, sf_dir, "part").select("p_partkey", size.alias("s")).select("p_partkey", "s.width", "s.height")


@query("fill_geometry", """SELECT p_partkey, CAST(CASE WHEN NOT near THEN floor((w - cw) / 2) END AS INT) AS crop_x, CAST(CASE WHEN NOT near THEN floor((h - ch) / 2) END AS INT) AS crop_y, CAST(CASE WHEN NOT near THEN cw END AS INT) AS crop_width, CAST(CASE WHEN NOT near THEN ch END AS INT) AS crop_height
FROM (SELECT *, abs(fw - fh) <= CAST(0.1 AS FLOAT) AS near, CASE WHEN fw < fh THEN w ELSE round(fh * CAST(30 AS FLOAT)) END AS cw, CASE WHEN fw < fh THEN round(fw * CAST(20 AS FLOAT)) ELSE h END AS ch
FROM (SELECT *, CAST(CAST(w AS DOUBLE) / 30 AS FLOAT) AS fw, CAST(CAST(h AS DOUBLE) / 20 AS FLOAT) AS fh FROM (SELECT p_partkey, CAST(p_size + 20 AS BIGINT) AS w, CAST(p_partkey % 60 + 10 AS BIGINT) AS h FROM part)))""")
def fill_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nothing is cut where both sides shrink by about the same factor."""
    g = text.resize_geometry("fill", F.col("p_size") + 20, F.col("p_partkey") % 60 + 10, 30, 20)
    return table(spark, sf_dir, "part").select("p_partkey", g.alias("g")).select("p_partkey", "g.crop_x", "g.crop_y", "g.crop_width", "g.crop_height")


# outputs --------------------------------------------------------------------------------------------------


@query("section_outputs", """SELECT CASE WHEN s_suppkey % 4 = 0 THEN 'redirect' ELSE 'section' END AS kind, 's/' || s_suppkey || '/index.html' AS path, s_suppkey % 4 = 0 AS leads_on FROM supplier WHERE s_suppkey % 5 <> 0""")
def section_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    sections = table(spark, sf_dir, "supplier").select(_cat("/s/", k, "/").alias("path"), (k % 5 != 0).alias("render"), F.when(k % 4 == 0, _cat("https://example.org/to/", k, "/")).alias("redirect_to"), F.col("s_name").alias("content"))
    return publish.section_outputs(sections).select("kind", "path", F.contains("content", F.lit("url=https://example.org/to/")).alias("leads_on"))


@query("redirect_pages", """SELECT page_id, url AS script, 'https://' || replace(regexp_extract(url, '^https?://(.*)$', 1), '&', '&amp;') AS link FROM (SELECT page_id, 'https://' || regexp_extract(url, '^https?://(.*)$', 1) || '?a=1&b=2' AS url FROM pages)""")
def redirect_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where a redirect page leads: its script (which adds the fragment asked for) and its link."""
    target = F.concat(F.regexp_replace("url", "^https?", "https"), F.lit("?a=1&b=2"))
    pages = table(spark, sf_dir, "pages").select("page_id", publish.redirect_html(target).alias("html"))
    return pages.select("page_id", F.regexp_replace(F.regexp_extract("html", r'location\.replace\("(.*?)" \+ location\.hash\)', 1), r"\\/", "/").alias("script"), F.regexp_extract("html", '<a href="([^"]*)"', 1).alias("link"))


@query("pager_outputs", """SELECT CASE WHEN pager = 1 THEN 'redirect' ELSE 'pager' END AS kind, 'b/' || s_suppkey || '/page/' || pager || '/index.html' AS path FROM supplier, range(1, 4) p(pager)
UNION ALL SELECT 'pager', 'b/' || s_suppkey || '/index.html' FROM supplier""")
def pager_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = _cat("b/", F.col("s_suppkey"), "/")
    pagers = table(spark, sf_dir, "supplier").select(base.alias("path"), F.explode(F.sequence(F.lit(1), F.lit(3))).alias("pager"), F.lit("page").alias("paginate_path"), F.concat(F.lit("https://example.org/"), base).alias("permalink"), F.col("s_name").alias("content"))
    # a pager's path below its owner's is paginate_path/number
    return publish.pager_outputs(pagers).select("kind", "path")


@query("output_plan", """SELECT 'page' AS kind, 'p/' || page_id || '/index.html' AS path FROM pages UNION ALL SELECT 'alias', 'old/' || page_id || '/index.html' FROM pages UNION ALL SELECT 'section', 's/' || s_suppkey || '/index.html' FROM supplier UNION ALL SELECT 'fixed', path FROM (VALUES ('404.html'), ('robots.txt')) f(path)""")
def output_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a build writes, kind by kind."""
    pages, suppliers = table(spark, sf_dir, "pages"), table(spark, sf_dir, "supplier")
    fixed = pages.agg(F.count("*")).select(F.explode(F.array(F.lit("404.html"), F.lit("robots.txt"))).alias("path"))
    return publish.output_plan({
        "page": pages.select(_cat("p/", F.col("page_id"), "/index.html").alias("path")), "alias": pages.select(_cat("old/", F.col("page_id"), "/index.html").alias("path")),
        "section": suppliers.select(_cat("s/", F.col("s_suppkey"), "/index.html").alias("path")), "fixed": fixed})


@query("static_manifest", """SELECT rel, src FROM (SELECT p_partkey || '.css' AS rel, 'site' AS src FROM part WHERE p_size % 2 = 0 UNION ALL SELECT p_partkey || '.css', 'theme' FROM part WHERE p_size % 3 = 0 AND p_size % 2 <> 0) WHERE NOT regexp_matches(rel, '7\\.css$')""")
def static_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The site's files, the theme's where the site has none, but for ignored names."""
    part, rel = table(spark, sf_dir, "part"), _cat(F.col("p_partkey"), ".css").alias("rel")
    return publish.static_manifest(part.where("p_size % 2 = 0").select(rel, F.lit("site").alias("src")), part.where("p_size % 3 = 0").select(rel, F.lit("theme").alias("src")), r"7\.css$")


@query("pruned_files", "SELECT p_partkey || '.png' AS rel FROM part WHERE p_size % 4 = 0")
def pruned_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, rel = table(spark, sf_dir, "part"), _cat(F.col("p_partkey"), ".png").alias("rel")
    return publish.pruned_files(part.select(rel), part.where("p_size % 4 <> 0").select(rel))


# changes --------------------------------------------------------------------------------------------------


@query("event_kinds", """SELECT event_id, CASE event_id % 6 WHEN 0 THEN 'create' WHEN 1 THEN 'modify' WHEN 2 THEN 'remove' WHEN 3 THEN 'modify' ELSE NULL END AS kind, event_id % 5 IN (1, 2, 3) AS temporary FROM events""")
def event_kinds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a watcher's events mean, and which files are temporary."""
    n, m = F.col("event_id") % 6, F.col("event_id") % 5
    raw = F.when(n == 0, "Create.File").when(n == 1, "Modify.Data").when(n == 2, "Remove.File").when(n == 3, "modify.name.to").when(n == 4, "access.open").otherwise("modify.name.from")
    path = F.when(m == 0, "/content/a.md").when(m == 1, "/content/.a.md").when(m == 2, "/content/a.md~").when(m == 3, "/content/a.swp").otherwise("/static/a.css")
    return table(spark, sf_dir, "events").select("event_id", changes.event_kind(raw).alias("kind"), changes.is_temporary(path).alias("temporary"))


@query("served_state", "SELECT 'k' || user_id AS key, max(event_id) AS event_id FROM events GROUP BY user_id HAVING max_by(event_type, event_id) <> 'error'")
def served_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is served after all changes: the state before them, upserts in, removals out."""
    last = table(spark, sf_dir, "events").groupBy(_cat("k", F.col("user_id")).alias("key")).agg(F.max("event_id").alias("event_id"), F.max_by("event_type", "event_id").alias("type"))
    before = table(spark, sf_dir, "events").groupBy(_cat("k", F.col("user_id")).alias("key")).agg(F.min("event_id").alias("event_id"))
    return changes.upsert(before, last.where("type <> 'error'").select("key", "event_id"), last.where("type = 'error'"), "key")


# sections and dates -----------------------------------------------------------------------------------------


@query("default_sections", "SELECT lang, section_path, made FROM (SELECT DISTINCT lang, source AS section_path, false AS made FROM documents UNION ALL SELECT DISTINCT lang, '', true FROM documents)")
def default_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every language has a root section, made where none is written."""
    docs = table(spark, sf_dir, "documents")
    written = docs.select("lang", F.array("source").alias("components"), F.col("source").alias("section_path")).distinct().withColumn("made", F.lit(False))
    return hierarchy.default_sections(written, docs.select("lang")).select("lang", "section_path", F.coalesce("made", F.lit(True)).alias("made"))


@query("sorted_sections", """SELECT r_name AS grp, n_name AS title, CAST(row_number() OVER (PARTITION BY r_name ORDER BY n_nationkey % 4, '/' || n_name || '/') AS INT) AS rank, lag('/' || n_name || '/') OVER (PARTITION BY r_name ORDER BY n_nationkey % 4, '/' || n_name || '/') AS lower,
  lead('/' || n_name || '/') OVER (PARTITION BY r_name ORDER BY n_nationkey % 4, '/' || n_name || '/') AS higher FROM nation JOIN region ON n_regionkey = r_regionkey""")
def sorted_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Subsections by weight, as any unknown mode sorts them, with the ones before and after."""
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    rows = n.select(F.col("r_name").alias("grp"), F.col("n_name").alias("title"), (F.col("n_nationkey") % 4).alias("weight"), _cat("/", F.col("n_name"), "/").alias("permalink"))
    ranked = ordering.sort_sections(rows, "none", "grp")[0].select("permalink", "rank")
    return ordering.siblings(rows, "weight", "grp").join(ranked, "permalink").select("grp", "title", F.col("rank").cast("int").alias("rank"), "lower", "higher")


@query("own_dates", "SELECT event_id, CAST(year(ts) AS INT) AS year, CAST(month(ts) AS INT) AS month, CAST(day(ts) AS INT) AS day, date_trunc('second', ts) + INTERVAL 150 MINUTE > TIMESTAMP '2024-01-05' AS late FROM events")
def own_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dates as written before their offset, and comparisons after it."""
    w = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'-02:30'")
    return table(spark, sf_dir, "events").select("event_id", dates.own_date(w).alias("d"), dates.after(w, F.lit("2024-01-05")).alias("late")).select("event_id", "d.*", "late")


@query("path_parts", """SELECT page_id, 'content/blog/p' || page_id || '.md' AS id, 'blog/p' || page_id || '.fr.md' AS sibling, coalesce(nullif(trim(regexp_extract(url, '^[a-zA-Z]+://[^/?#]*([^?#]*)', 1), '/'), ''), 'home') AS content_path, 'https://example.org/x' || page_id || '/' AS base FROM pages""")
def path_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("page_id")
    file = _cat("blog/p", k, ".md")
    return table(spark, sf_dir, "pages").select("page_id", paths.page_id(file).alias("id"), paths.path_with_language(file, "fr", "en").alias("sibling"), paths.url_to_content_path(F.col("url")).alias("content_path"), paths.normalize_base_url(_cat("https://example.org/x", k, "//")).alias("base"))
