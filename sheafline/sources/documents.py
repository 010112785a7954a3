"""Documents of a site: files with a header and a body."""

from __future__ import annotations

import re
import tomllib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths
from .data import parse_yaml, plain_value
from .trees import list_tree, read_tree

#: Header fields by kind of file, with their types and defaults.
PAGE_FIELDS = {"title": str, "description": str, "date": str, "updated": str, "draft": bool, "render": bool, "in_search_index": bool, "include_in_feeds": bool, "hidden": bool,
               "slug": str, "path": str, "template": str, "weight": int, "authors": list, "aliases": list, "taxonomies": dict, "extra": dict}
SECTION_FIELDS = {"title": str, "description": str, "sort_by": str, "weight": int, "draft": bool, "template": str, "paginate_by": int, "paginate_reversed": bool, "paginate_path": str,
                  "insert_anchor_links": str, "render": bool, "redirect_to": str, "in_search_index": bool, "transparent": bool, "page_template": str, "aliases": list, "generate_feeds": bool, "hidden": bool, "extra": dict}
SORT_MODES = ("date", "update_date", "title", "title_bytes", "weight", "slug", "permalink", "none")

MARKS = {"toml": "+++", "yaml": "---"}

HEADER_SCHEMA = """file string, is_section boolean, header_kind string, body string, error string,
  title string, description string, date string, updated string, draft boolean, render boolean, in_search_index boolean, include_in_feeds boolean, hidden boolean,
  slug string, path string, template string, weight bigint, authors array<string>, aliases array<string>, taxonomies map<string,array<string>>, extra string,
  sort_by string, paginate_by bigint, paginate_reversed boolean, paginate_path string, insert_anchor_links string, redirect_to string, transparent boolean, page_template string, generate_feeds boolean"""


def _relative(path: Column, root: str) -> Column:
    """A file's path below root, percent escapes decoded."""
    prefix = re.sub("^file:/+", "/", root.rstrip("/")).split("://")[-1]
    plain = F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))
    return F.regexp_replace(plain, "^.*?" + re.escape(prefix) + "/+", "")


def _underscored(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(file, content) of files with an underscore before their name or a folder's, which Spark's readers take for hidden; listed and read by tasks."""
    name = re.escape(pattern).replace(r"\*", "[^/]*").replace(r"\?", "[^/]")
    hidden = F.col("file").rlike("(^|/)_") & F.col("file").rlike(f"(^|/){name}$")
    return read_tree(list_tree(spark, root).where(hidden).select("file"), root)


def scan_files(spark: SparkSession, root: str, pattern: str = "*.md", ignored: str | None = None) -> DataFrame:
    """(file, content) of all files under root that match a pattern; dot files and ignored paths (a regular expression) are left out."""
    files = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).text(root, wholetext=True)
    plain = files.select(_relative(F.col("_metadata.file_path"), root).alias("file"), F.col("value").alias("content"))
    out = plain.unionByName(_underscored(spark, root, pattern)).where(~F.col("file").rlike(r"(^|/)\."))
    return out.where(~F.col("file").rlike(ignored)) if ignored else out


def split_header(content: str) -> tuple[str, str, str]:
    """(kind, header, body): what stands between the first two marks, and what follows; ValueError without a header."""
    text = content.lstrip()
    for kind, mark in MARKS.items():
        first, _, rest = text.partition("\n")
        if first.rstrip() == mark and mark in rest:
            header, _, tail = rest.partition(mark)
            line, _, body = tail.partition("\n")
            if not line.strip():
                return kind, header, body
    raise ValueError("no header between +++ or --- lines")


def parse_header(kind: str, header: str) -> dict:
    return plain_value(tomllib.loads(header)) if kind == "toml" else (parse_yaml(header) or {})


def _typed(fields: dict, name: str, value):
    want = fields[name]
    if want is list and isinstance(value, list):
        return [str(x) for x in value]
    if want is int and isinstance(value, bool) or not isinstance(value, want):
        if want is str and isinstance(value, (int, float)) and name in ("date", "updated"):
            return str(value)
        raise ValueError(f"{name} must be {want.__name__}")
    if want is int and value < 0:
        raise ValueError(f"{name} must not be negative")
    return value


def header_row(file: str, content: str) -> dict:
    """A row of HEADER_SCHEMA; parse faults are in `error`."""
    import json

    name = file.rsplit("/", 1)[-1]
    section = name.startswith("_index.")
    row: dict = {"file": file, "is_section": section, "error": None}
    try:
        row["header_kind"], header, row["body"] = split_header(content)
        values, fields = parse_header(row["header_kind"], header), SECTION_FIELDS if section else PAGE_FIELDS
        for key, value in values.items():
            if key not in fields:
                if section:
                    raise ValueError(f"unknown field {key}")
                continue
            row[key] = _typed(fields, key, value)
        for key in ("slug", "path"):
            if not section and row.get(key) == "":
                raise ValueError(f"{key} is empty")
        if any(t == "" for terms in (row.get("taxonomies") or {}).values() for t in terms):
            raise ValueError("a taxonomy term is empty")
        if section and row.get("sort_by", "none") not in SORT_MODES:
            raise ValueError(f"unknown sort_by {row['sort_by']}")
    except (ValueError, TypeError, AttributeError) as e:
        row["error"] = f"{file}: {e}"
    for key, default in (("draft", False), ("render", True), ("in_search_index", True)):
        row.setdefault(key, default)
    if section:
        for key, default in (("sort_by", "none"), ("weight", 0), ("transparent", False), ("paginate_reversed", False), ("paginate_path", "page"), ("generate_feeds", False)):
            row.setdefault(key, default)
    else:
        row.setdefault("include_in_feeds", True)
    row["extra"] = json.dumps(row.get("extra") or {}, ensure_ascii=False, sort_keys=True)
    return row


#: Bytes of text that a task has as Python objects at a time, but for one text that is larger.
HELD_BYTES = 2_000_000


def slices(batch, column: int) -> Iterator:
    """A batch's rows in their order, in slices of about HELD_BYTES of a column's text."""
    import pyarrow.compute as pc

    at, size = 0, 0
    for i, n in enumerate(pc.binary_length(batch.column(column)).to_pylist()):
        if i > at and size + (n or 0) > HELD_BYTES:
            yield batch.slice(at, i - at)
            at, size = i, 0
        size += n or 0
    if at < batch.num_rows:
        yield batch.slice(at)


def parse_documents(files: DataFrame) -> DataFrame:
    """files (file, content) as rows of HEADER_SCHEMA. Files that can't be parsed carry an error, so all errors of a scan can be shown together."""
    from pyspark.sql import types as T

    def run(batches: Iterator):
        import pyarrow as pa

        for b in (part for whole in batches for part in slices(whole, 1)):
            rows = [header_row(f, c or "") for f, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_pylist([{n: r.get(n) if n != "taxonomies" else list((r.get(n) or {}).items()) for n in arrow.names} for r in rows], schema=arrow)

    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(T.StructType.fromDDL(HEADER_SCHEMA))
    return files.select("file", "content").mapInArrow(run, HEADER_SCHEMA)


def raise_errors(parsed: DataFrame, most: int = 50) -> DataFrame:
    """The rows without an error; with any, one exception that lists the first of them in path order."""
    errors = [r.error for r in parsed.where("error IS NOT NULL").select("error", "file").orderBy("file").limit(most).collect()]
    if errors:
        raise ValueError("\n".join(errors))
    return parsed


def with_keys(parsed: DataFrame, languages=(), default: str = "en", base_url: str = "https://example.org", strategy: str = "on") -> DataFrame:
    """Parsed files with components, lang, canonical, slug, url path and permalink.

    A colocated page (`dir/index.md`) stands for its directory. A date before the name
    is the page's date where the header has none. A header's path wins over everything.
    """
    c = F.col
    stem = paths.file_stem(c("file"))
    lang = paths.stem_language(stem, languages, default)
    name = F.regexp_replace(stem, rf"\.{paths.one_of(sorted(languages))}$", "") if languages else stem
    dirs = paths.components(c("file"))
    colocated = (name == "index") & (F.size(dirs) > 0)
    dated = r"^([0-9]{4}-[0-9]{2}-[0-9]{2})(?:T[0-9:.Z+-]+?)?(?:_|-)(.+)$"
    own = F.when(colocated, F.element_at(dirs, -1)).otherwise(name)
    out = parsed.withColumns({"lang": lang, "components": F.when(colocated, F.slice(dirs, F.lit(1), F.size(dirs) - 1)).otherwise(dirs), "__own": own})
    rest = F.nullif(F.regexp_extract("__own", dated, 2), F.lit(""))
    out = out.withColumns({
        "date": F.coalesce("date", F.nullif(F.regexp_extract("__own", dated, 1), F.lit(""))),
        "slug": F.when(c("is_section"), F.lit("")).otherwise(F.coalesce("slug", paths.slugify_paths(F.coalesce(rest, "__own"), strategy))),
        "canonical": F.concat_ws("/", F.nullif(F.array_join("components", "/"), F.lit("")), "__own")})
    prefix = F.when(c("lang") == default, F.lit("/")).otherwise(F.concat(F.lit("/"), "lang", F.lit("/")))
    place = F.concat_ws("/", F.nullif(F.array_join("components", "/"), F.lit("")), F.nullif("slug", F.lit("")))
    built = F.concat(prefix, place, F.when(place == "", "").otherwise("/"))
    header = F.concat(F.lit("/"), F.regexp_replace(F.trim("path"), "^/+", ""))
    url = F.when(F.col("path").isNotNull() & ~c("is_section"), F.when(header.endswith("/"), header).otherwise(F.concat(header, F.lit("/")))).otherwise(built)
    return out.withColumn("url_path", url).withColumn("permalink", paths.make_permalink(base_url, c("url_path"))).drop("__own")


def index_beside_section(files: DataFrame) -> DataFrame:
    """Directories that hold both index.md and _index.md: errors."""
    d = files.withColumns({"dir": F.regexp_replace("file", "/?[^/]*$", ""), "name": F.element_at(F.split("file", "/"), -1)})
    return d.where("name = 'index.md'").select("dir").join(d.where("name = '_index.md'").select("dir"), "dir", "left_semi")


def colocated_assets(files: DataFrame) -> DataFrame:
    """(owner, rel, asset) for files (file) beside or below a colocated index page: no Markdown, no temporary or dot files."""
    d = files.select("file", F.regexp_replace("file", "/?[^/]*$", "").alias("dir"), F.element_at(F.split("file", "/"), -1).alias("name"))
    owners = d.where(F.col("name").rlike(r"^index(\.[^.]+)?\.md$")).select(F.col("file").alias("owner"), F.col("dir").alias("prefix"))
    assets = d.where(~F.col("name").rlike(r"\.md$|^\.|~$|\.(swp|swx|tmp|bck|bak)$"))
    steps = F.split("dir", "/")
    up = assets.withColumn("prefix", F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))))
    return up.join(owners, "prefix").select("owner", F.expr("substring(file, length(prefix) + 2)").alias("rel"), F.col("file").alias("asset"))


def first_existing(wanted: DataFrame, files: DataFrame, roots: list[str]) -> DataFrame:
    """wanted (path) with the file that the first of the roots has; paths that step out of a root find nothing."""
    safe = wanted.where(~F.col("path").rlike(r"(^|/)\.\.(/|$)"))
    tries = safe.select("path", F.posexplode(F.array(*[F.lit(r) for r in roots])).alias("prio", "root"))
    tries = tries.withColumn("file", F.concat(F.when(F.col("root") == "", "").otherwise(F.concat("root", F.lit("/"))), F.regexp_replace("path", "^@?/+", "")))
    hit = tries.join(files.select("file"), "file").groupBy("path").agg(F.min_by("file", "prio").alias("file"))
    return wanted.join(hit, "path", "left")


def changed_files(before: DataFrame, after: DataFrame) -> DataFrame:
    """(file, change) of two snapshots (file, content): create, modify or remove, by a full outer join on the path."""
    a = before.select("file", F.sha2("content", 256).alias("was"))
    b = after.select("file", F.sha2("content", 256).alias("now"))
    change = F.when(F.col("was").isNull(), "create").when(F.col("now").isNull(), "remove").otherwise("modify")
    return a.join(b, "file", "full_outer").where(~F.col("was").eqNullSafe(F.col("now"))).select("file", change.alias("change"))


def url_family(changed: DataFrame, pages: DataFrame, languages) -> tuple[DataFrame, DataFrame]:
    """(urls, unmatched): addresses of all languages of changed files, and the changed files no page belongs to."""
    key = lambda df: df.withColumn("neutral", F.coalesce(paths.language_neutral_path(F.col("file"), languages), "file"))
    c, p = key(changed.select("file")), key(pages.select("file", "permalink"))
    urls = p.join(c.select("neutral").distinct(), "neutral", "left_semi").select(F.col("permalink").alias("url")).distinct()
    return urls, c.join(p.select("neutral").distinct(), "neutral", "left_anti").select("file")


def url_list(lines: DataFrame) -> DataFrame:
    """Addresses of a list's lines (value): no blanks, no comments."""
    t = F.trim("value")
    return lines.where((t != "") & ~t.startswith("#")).select(t.alias("url"))


def sitemap_locations(xml: Column) -> Column:
    """Addresses between loc tags."""
    return F.transform(F.regexp_extract_all(xml, F.lit(r"(?is)<loc>\s*(.*?)\s*</loc>"), F.lit(1)), lambda x: F.replace(F.replace(F.replace(x, F.lit("&amp;"), F.lit("&")), F.lit("&lt;"), F.lit("<")), F.lit("&gt;"), F.lit(">")))


def discover_urls(spark: SparkSession, start: list[str], fetch) -> DataFrame:
    """All page addresses of site maps and the site maps they list. fetch(url) -> text is the caller's client.

    One round for each level of indexes, until one lists no new ones: addresses met before
    are not asked again, so loops end.
    """
    from .shared import materialize

    def load(batches):
        for pdf in batches:
            pdf["xml"] = [fetch(u) for u in pdf["url"]]
            yield pdf

    todo = spark.createDataFrame([(u,) for u in start], "url string")
    seen, found = todo, None
    while True:
        got = materialize(todo.mapInPandas(load, "url string, xml string").withColumn("index", F.contains(F.lower("xml"), F.lit("<sitemapindex"))), "sitemaps")
        if got.isEmpty():
            break
        locs = got.select("index", F.explode(sitemap_locations(F.col("xml"))).alias("url"))
        pages = locs.where("NOT index").select("url")
        found = pages if found is None else found.unionByName(pages)
        todo = materialize(locs.where("index").select("url").distinct().join(seen, "url", "left_anti"), "listed")
        seen = seen.unionByName(todo)
    return (found if found is not None else todo.limit(0)).distinct()


def fetch_pages(urls: DataFrame, fetch=None) -> DataFrame:
    """urls (url) with html and error through a caller's client; without one, every row has an error."""

    def run(batches):
        import pandas as pd

        for pdf in batches:
            html, error = [], []
            for u in pdf["url"]:
                try:
                    text = fetch(u) if fetch else None
                    html.append(text)
                    error.append(None if text and text.strip() else ("empty body" if fetch else "no client"))
                except Exception as e:  # noqa: BLE001  the client's own errors become rows
                    html.append(None)
                    error.append(str(e))
            yield pd.DataFrame({"url": pdf["url"], "html": html, "error": error})

    return urls.select("url").mapInPandas(run, "url string, html string, error string")
