"""What a site puts out: site map, feeds, redirects, output plan and files."""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import escape_xml
from ..sources.shared import join_shuffled, materialize
from ..sources.trees import list_tree, opened, remove_files


def sitemap_entries(parts: list[DataFrame]) -> DataFrame:
    """The union of parts (permalink, updated), distinct by permalink: the earlier part wins, then the earlier date.

    One aggregation with partial minima; nothing is sorted here.
    """
    every = reduce(DataFrame.unionByName, [p.select("permalink", "updated", F.lit(i).alias("prio")) for i, p in enumerate(parts)])
    first = F.min(F.struct("prio", F.col("updated").isNull().alias("none"), "updated"))
    return every.groupBy("permalink").agg(first.alias("first")).select("permalink", "first.updated")


def sitemap_xml(entries: DataFrame, base: str, size: int = 30_000) -> DataFrame:
    """(path, content): one file, or an index and numbered files of `size` entries in permalink order."""
    from .ordering import global_rank
    from .paginate import chunk_number

    item = F.concat(F.lit("<url><loc>"), escape_xml(F.col("permalink")), F.lit("</loc>"), F.coalesce(F.concat(F.lit("<lastmod>"), "updated", F.lit("</lastmod>")), F.lit("")), F.lit("</url>"))
    head = '<?xml version="1.0" encoding="UTF-8"?>\n'
    space = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    chunks = global_rank(entries, ["permalink"]).groupBy(chunk_number(F.col("rank"), size).alias("chunk")) \
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("permalink", item.alias("xml")))), lambda x: x["xml"]), "\n").alias("items"))
    chunks = chunks.withColumn("n", F.count("*").over(Window.partitionBy(F.lit(1))))
    files = chunks.select(F.when(F.col("n") == 1, "sitemap.xml").otherwise(F.concat(F.lit("sitemap"), "chunk", F.lit(".xml"))).alias("path"),
                          F.concat(F.lit(f"{head}<urlset {space}>\n"), "items", F.lit("\n</urlset>\n")).alias("content"))
    index = chunks.where("n > 1").groupBy().agg(F.array_sort(F.collect_list("chunk")).alias("all")).where(F.size("all") > 0).select(
        F.lit("sitemap.xml").alias("path"),
        F.concat(F.lit(f"{head}<sitemapindex {space}>\n"), F.array_join(F.transform("all", lambda c: F.concat(F.lit(f"<sitemap><loc>{base}/sitemap"), c, F.lit(".xml</loc></sitemap>"))), "\n"), F.lit("\n</sitemapindex>\n")).alias("content"))
    return files.unionByName(index)


def feed_xml(items: DataFrame, group: str, title: Column, url: Column, updated: Column, kind: str = "atom", *, name: Column | None = None, subtitle: Column | None = None,
             home: Column | None = None, lang: Column | None = None, author: Column | None = None, generator: str = "sheafline") -> DataFrame:
    """(group, content): an Atom or RSS file of each group's items (rank, title, permalink, date, updated, summary), by rank.

    title, url, updated and the others are the feed's own, as aggregates or literals: name
    is that of a section or term and follows the title, home is the page that the feed
    belongs to. Items may have authors (array), lang and content, which stands in where
    the summary is null or empty; without authors the feed's author counts, else `Unknown`.
    Items are expected to be limited before, so a group's file stays small.
    """
    c = F.col
    none = F.lit(None).cast("string")
    given = lambda x: none if x is None else x
    own = lambda column, kind_="string": c(column) if column in items.columns else F.lit(None).cast(kind_)
    e = lambda x: escape_xml(F.coalesce(x, F.lit("")))
    element = lambda tag, x, attrs="": F.coalesce(F.concat(F.lit(f"<{tag}{attrs}>"), escape_xml(x), F.lit(f"</{tag}>\n")), F.lit(""))
    attribute = lambda label, x: F.coalesce(F.concat(F.lit(f' {label}="'), escape_xml(x), F.lit('"')), F.lit(""))
    whole, place = F.concat_ws(" - ", title, given(name)), F.coalesce(given(home), url)
    short, authors = F.nullif(own("summary"), F.lit("")), own("authors", "array<string>")
    if kind == "atom":
        people = F.array_join(F.transform(F.when(F.size(authors) > 0, authors).otherwise(F.array("__author")), lambda a: element("name", a)), "</author>\n<author>")
        content = F.concat(F.lit("<content"), attribute("type", F.lit("html")), attribute("xml:base", c("permalink")), F.lit(">"), e(own("content")), F.lit("</content>\n"))
        item = F.concat(
            F.lit("<entry"), attribute("xml:lang", own("lang")), F.lit(">\n<title>"), e(c("title")), F.lit("</title>\n"), element("published", c("date").cast("string")), element("updated", F.coalesce(c("updated"), c("date")).cast("string")),
            F.lit("<author>"), people, F.lit('</author>\n<link rel="alternate" type="text/html"'), attribute("href", c("permalink")), F.lit("/>\n"), element("id", c("permalink")),
            F.when(short.isNotNull(), element("summary", short, ' type="html"')).otherwise(content), F.lit("</entry>"))
        head = F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<feed xmlns="http://www.w3.org/2005/Atom"'), attribute("xml:lang", given(lang)), F.lit(">\n<title>"), e(whole), F.lit("</title>\n"), element("subtitle", given(subtitle)),
            F.lit('<link rel="self" type="application/atom+xml"'), attribute("href", url), F.lit('/>\n<link rel="alternate" type="text/html"'), attribute("href", place), F.lit("/>\n"), element("generator", F.lit(generator)), element("updated", updated), element("id", url))
        foot = F.lit("\n</feed>\n")
    else:
        item = F.concat(
            F.lit("<item>\n<title>"), e(c("title")), F.lit("</title>\n"), element("pubDate", F.date_format("date", "EEE, dd MMM yyyy HH:mm:ss xx")), element("author", F.coalesce(F.get(authors, 0), c("__author"))), element("link", c("permalink")), element("guid", c("permalink")),
            F.lit("<description"), attribute("xml:base", c("permalink")), F.lit(">"), e(F.coalesce(short, own("content"))), F.lit("</description>\n</item>"))
        head = F.concat(
            F.lit('<?xml version="1.0" encoding="UTF-8"?>\n<rss xmlns:atom="http://www.w3.org/2005/Atom" version="2.0">\n<channel>\n<title>'), e(whole), F.lit("</title>\n"), element("link", place), F.lit("<description>"), e(given(subtitle)), F.lit("</description>\n"),
            element("generator", F.lit(generator)), element("language", given(lang)), F.lit("<atom:link"), attribute("href", url), F.lit(' rel="self" type="application/rss+xml"/>\n'), element("lastBuildDate", updated))
        foot = F.lit("\n</channel>\n</rss>\n")
    listed = items.withColumn("__author", F.coalesce(given(author), F.lit("Unknown")))
    body = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", item.alias("xml")))), lambda x: x["xml"]), "\n")
    return listed.groupBy(group).agg(F.concat(head, body, foot).alias("content"))


def redirect_html(url: Column) -> Column:
    """A page that sends its reader on to a URL, with the fragment of the address asked for; without scripts, to the URL alone."""
    u = escape_xml(url)
    quoted = F.replace(F.to_json(F.struct(url.alias("u"))), F.lit("<"), F.lit("\\u003c"))
    script = F.concat(F.lit("<script>location.replace("), F.substring(quoted, 6, F.length(quoted) - 6), F.lit(" + location.hash)</script>"))
    return F.concat(F.lit('<!doctype html><html><head><meta charset="utf-8"><link rel="canonical" href="'), u, F.lit('">'), script, F.lit('<noscript><meta http-equiv="refresh" content="0; url='), u,
                    F.lit('"></noscript><title>Moved</title></head><body><p>This page is now at <a href="'), u, F.lit('">'), u, F.lit("</a>.</p></body></html>"))


def alias_outputs(pages: DataFrame, aliases: str = "aliases", permalink: str = "permalink") -> DataFrame:
    """(kind, path, content) of a redirect for each alias; a file where the alias ends in .html, else an index in its folder."""
    a = pages.select(F.explode(aliases).alias("alias"), F.col(permalink).alias("to"))
    bare = F.regexp_replace("alias", "^/+|/+$", "")
    path = F.when(F.col("alias").endswith(".html"), bare).otherwise(F.concat(bare, F.lit("/index.html")))
    return a.select(F.lit("alias").alias("kind"), path.alias("path"), redirect_html(F.col("to")).alias("content"))


def section_outputs(sections: DataFrame) -> DataFrame:
    """(kind, path, content): a section's page, or a redirect where redirect_to (already a permalink) is set."""
    path = F.concat(F.regexp_replace("path", "^/+", ""), F.lit("index.html"))
    return sections.where("render").select(F.when(F.col("redirect_to").isNull(), "section").otherwise("redirect").alias("kind"), path.alias("path"),
                                           F.when(F.col("redirect_to").isNull(), F.col("content")).otherwise(redirect_html(F.col("redirect_to"))).alias("content"))


def pager_outputs(pagers: DataFrame) -> DataFrame:
    """(kind, path, content) of pagers (path, pager, paginate_path, permalink, content): the first one at its owner's path, with a redirect from its numbered one."""
    numbered = F.concat("path", "paginate_path", F.lit("/"), F.col("pager").cast("string"), F.lit("/index.html"))
    own = pagers.select(F.lit("pager").alias("kind"), F.when(F.col("pager") == 1, F.concat("path", F.lit("index.html"))).otherwise(numbered).alias("path"), "content")
    return own.unionByName(pagers.where("pager = 1").select(F.lit("redirect").alias("kind"), numbered.alias("path"), redirect_html(F.col("permalink")).alias("content")))


def output_plan(parts: dict[str, DataFrame]) -> DataFrame:
    """(kind, path) of everything that a build writes; parts have a column path."""
    return reduce(DataFrame.unionByName, [df.select(F.lit(kind).alias("kind"), "path") for kind, df in parts.items()])


def colliding_outputs(plan: DataFrame) -> DataFrame:
    """Paths that more than one output claims."""
    return plan.groupBy("path").agg(F.count("*").alias("n"), F.array_sort(F.collect_set("kind")).alias("kinds")).where("n > 1")


def static_manifest(site: DataFrame, theme: DataFrame, ignored: str | None = None) -> DataFrame:
    """Files (rel, src) to copy: the site's, and the theme's where the site has none of that name."""
    both = site.select("rel", "src").unionByName(theme.select("rel", "src").join(site.select("rel"), "rel", "left_anti"))
    return both.where(~F.col("rel").rlike(ignored)) if ignored else both


def stale_files(source: DataFrame, target: DataFrame) -> DataFrame:
    """source (rel, changed) rows that target lacks or has older."""
    t = target.select("rel", F.col("changed").alias("__had"))
    return source.join(t, "rel", "left").where("__had IS NULL OR changed > __had").drop("__had")


def pruned_files(existing: DataFrame, wanted: DataFrame, key: str = "rel") -> DataFrame:
    """Existing files that nothing wants any more."""
    return existing.join(wanted.select(key), key, "left_anti")


#: Folder of files that are written but not in place yet, below an output folder.
STAGING = ".staging"


def _staged(folder: str, job: str):
    """Writes contents to a folder of this attempt, and tells where each file lies and where it belongs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = opened(folder)
        attempt = f"{STAGING}/{job}/{uuid.uuid4().hex}"
        place.create_dir(posixpath.join(root, attempt), recursive=True)
        n = 0
        for b in batches:
            lies, belongs, sizes = [], [], []
            for path, content in zip(b.column("path").to_pylist(), b.column("content").to_pylist(), strict=True):
                target = posixpath.normpath(path.lstrip("/"))
                if target.split("/")[0] in ("..", ".", STAGING):
                    raise ValueError(f"{path} is outside of {folder}")
                data = (content or "").encode("utf-8")
                with place.open_output_stream(posixpath.join(root, attempt, str(n))) as f:
                    f.write(data)
                lies.append(f"{attempt}/{n}")
                belongs.append(target)
                sizes.append(len(data))
                n += 1
            yield pa.RecordBatch.from_arrays([b.column("kind"), pa.array(belongs, pa.string()), pa.array(lies, pa.string()), pa.array(sizes, pa.int64())], names=["kind", "path", "staged", "bytes"])

    return run


def _placed(folder: str):
    """Moves staged files to where they belong; one that an earlier attempt has moved is there already."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, root = opened(folder)
        for b in batches:
            for path, staged in zip(b.column("path").to_pylist(), b.column("staged").to_pylist(), strict=True):
                target = posixpath.join(root, path)
                place.create_dir(posixpath.dirname(target), recursive=True)
                try:
                    place.move(posixpath.join(root, staged), target)
                except FileNotFoundError:
                    if place.get_file_info(target).type.name == "NotFound":
                        raise
            yield b.select(["path"])

    return run


def write_outputs(outputs: DataFrame, folder: str, kinds: tuple[str, ...] = ()) -> dict[str, int]:
    """Writes (path, content) rows, or (kind, path, content), as files under folder, a URI of any store that executors reach.

    Every attempt of a task writes to a folder of its own; Spark commits the rows of one
    attempt of each task, and only their files are moved into place. So retries and
    speculative tasks leave no stray file, and a job that fails leaves the folder as it was.
    Paths that leave the folder are refused, one path twice is an error, and so is a plain
    local folder on a cluster, whose machines do not share it.

    Returned are counters that the writing pass itself has observed: files, bytes, and for
    each of the kinds its number of files.
    """
    master = outputs.sparkSession.sparkContext.master
    if not re.match(r"[A-Za-z][\w+.-]*:/", folder) and master.partition("[")[0] != "local":
        raise ValueError(f"{folder} is a folder of one machine only: give a URI that all machines of {master} share")
    job, seen = uuid.uuid4().hex, Observation()
    kind = F.col("kind") if "kind" in outputs.columns else F.lit("file")
    staged = outputs.select(kind.cast("string").alias("kind"), "path", "content").mapInArrow(_staged(folder, job), "kind string, path string, staged string, bytes long")
    counters = [F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"), *[F.count_if(F.col("kind") == k).alias(k) for k in kinds]]
    place, root = opened(folder)
    try:
        committed = materialize(staged.observe(seen, *counters), "staged-files")
        twice = committed.groupBy("path").count().where("count > 1").select("path").limit(1).collect()
        if twice:
            raise ValueError(f"{twice[0].path} is written twice")
        committed.select("path", "staged").mapInArrow(_placed(folder), "path string").count()
        return dict(seen.get)
    finally:
        rest = posixpath.join(root, STAGING, job)
        if place.get_file_info(rest).type.name != "NotFound":
            place.delete_dir(rest)


def clean_outputs(spark: SparkSession, folder: str, planned: DataFrame, keep_dot_files: bool = True) -> int:
    """Removes the files under folder that are not among planned (path); dot files, and all in dot folders, may stay. How many were removed."""
    there = list_tree(spark, folder)
    if keep_dot_files:
        there = there.where(~F.col("file").rlike(r"(^|/)\."))
    return remove_files(join_shuffled(there, planned.select(F.regexp_replace("path", "^/+", "").alias("file")).distinct(), "file", "left_anti"), folder)


#: Documents of one search file.
SEARCH_ROWS = 20_000


def search_index(docs: DataFrame, key: str = "url", lang: str = "lang", script: bool = False) -> DataFrame:
    """(lang, part, content): search documents of a language as JSON files of about SEARCH_ROWS documents, without null fields; script puts each into a variable.

    Parts are dealt by a hash of the key, as many as the whole table asks for, so no file gathers a language.
    """
    n = max(1, -(-docs.count() // SEARCH_ROWS))
    fields = [c for c in docs.columns if c != lang]
    body = F.to_json(F.array_sort(F.collect_list(F.struct(*fields))))
    parts = docs.groupBy(lang, F.pmod(F.xxhash64(key), F.lit(n)).alias("part"))
    return parts.agg((F.concat(F.lit("window.searchIndex = "), body, F.lit(";")) if script else body).alias("content"))
