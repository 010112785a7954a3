"""Markdown bodies taken apart in SQL: headings, links, summaries, footnotes. No HTML is rendered."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.paths import slugify_paths
from ..functions.text import trim_all
from .headings import toc_parents, unique_ids
from .i18n import split_segments

_HEADING = r"^\s{0,3}(#{1,6})\s+(.*?)\s*(?:\{([^}]*)\})?\s*#*\s*$"
_LINK = r"(?<!!)\[([^\]]*)\]\(\s*<?([^)\s>]*)>?[^)]*\)"


def plain_body(body: Column) -> Column:
    """A body without fenced code and code spans."""
    kept = F.filter(split_segments(body), lambda p: p["kind"] != "code")
    return F.regexp_replace(F.array_join(F.transform(kept, lambda p: p["text"]), ""), "`[^`\n]*`", "")


def headings(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, level, title, anchor, parent_pos) of headings outside of code; anchors are explicit ids or unique slugs."""
    marked = F.transform(F.filter(split_segments(F.col(body)), lambda p: p["kind"] == "heading"), lambda p: p["text"])
    g = lambda x, i: F.regexp_extract(x, "(?s)" + _HEADING, i)
    cols = pages.select(key, marked.alias("__h"))
    titles = F.transform("__h", lambda x: F.regexp_replace(g(x, 2), r"[*_`]", ""))
    own = F.transform("__h", lambda x: F.nullif(F.regexp_extract(g(x, 3), r"#([\w-]+)", 1), F.lit("")))
    cols = cols.withColumns({"t": titles, "e": own, "l": F.transform("__h", lambda x: F.length(g(x, 1)))})
    cols = cols.withColumn("i", unique_ids(F.transform("t", lambda x: slugify_paths(x)), F.col("e")))
    flat = cols.select(key, F.posexplode(F.arrays_zip("l", "t", "i")).alias("pos", "h")).select(key, "pos", F.col("h.l").alias("level"), F.col("h.t").alias("title"), F.col("h.i").alias("anchor"))
    return toc_parents(flat, key)


def inline_links(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, text, link) of inline links outside of code; images are none."""
    found = F.regexp_extract_all(plain_body(F.col(body)), F.lit(f"({_LINK})"), F.lit(1))
    part = lambda i: F.regexp_extract("l", _LINK, i)
    return pages.select(key, F.posexplode(found).alias("pos", "l")).select(key, "pos", part(1).alias("text"), part(2).alias("link"))


def no_address(link: Column) -> Column:
    """Whether a link is an error: it has no address."""
    return link == ""


def empty_links(pages: DataFrame, key: str, body: str) -> DataFrame:
    """Links without an address: errors."""
    return inline_links(pages, key, body).where(no_address(F.col("link")))


def summary(body: Column) -> Column:
    """What stands before the first `more` mark, without footnote references; null without a mark."""
    parts = F.split(body, r"(?i)<!--\s*more\s*-->", 2)
    return F.when(F.size(parts) > 1, trim_all(F.regexp_replace(parts[0], r"\[\^[^\]]+\]", "")))


def footnote_references(pages: DataFrame, key: str, body: str) -> DataFrame:
    """(key, pos, name) of references outside of code, in order; definitions at the start of a line are none."""
    plain = F.regexp_replace(plain_body(F.col(body)), r"(?m)^\[\^[^\]]+\]:", "")
    return pages.select(key, F.posexplode(F.regexp_extract_all(plain, F.lit(r"\[\^([^\]]+)\]"), F.lit(1))).alias("pos", "name"))


# boilerplate lines -----------------------------------------------------------------------

#: Marks of page chrome.
WIDGETS = ("Hit enter to search", "ESC to close", "Close Search")
FOOTERS = ("We use cookies to improve your experience", "RejectAccept", "[Close Menu]")
AVATAR = "wp-content/litespeed/avatar"


def _chrome(line: Column) -> Column:
    t = F.trim(line)
    widget = F.lit(False)
    for w in WIDGETS:
        widget = widget | F.contains(t, F.lit(w))
    only_links = F.trim(F.regexp_replace(t, r"\[[^\]]*\]\([^)]*\)", "")) == ""
    word = lambda x: (F.octet_length(x) <= 12) & ~x.rlike(r"[ \t\[!#.,:]|^[0-9]")
    rest = F.trim(F.regexp_replace(t, r"!\[[^\]]*\]\([^)]*\)", ""))
    image = F.contains(t, F.lit("![")) & ((rest == "") | word(rest))
    return (t == "") | (~t.startswith("#") & (widget | (t == "Search") | only_links | image | word(t)))


def _footer(line: Column) -> Column:
    t = F.trim(line)
    out = t.startswith("_Next Post_") | (t.startswith("#") & F.contains(t, F.lit("You May Also Like")))
    for w in FOOTERS:
        out = out | F.contains(t, F.lit(w))
    return out | F.regexp_extract(t, r"^- \[([^\]]*)\]\([^)]*\)", 1).rlike(r"\p{Ll}\p{Lu}")


def strip_boilerplate(body: Column) -> Column:
    """Without author lines, chrome before the first real line and everything from the first footer mark on; blank runs are one blank line."""
    lines = F.filter(F.split(body, "\r?\n"), lambda x: ~F.contains(x, F.lit(AVATAR)))
    numbered = lambda a: F.transform(a, lambda x, i: F.struct(i.alias("i"), x.alias("x")))
    real = F.get(F.filter(numbered(lines), lambda p: ~_chrome(p["x"])), F.lit(0))["i"]
    kept = F.slice(lines, F.coalesce(real, F.size(lines)) + 1, F.size(lines))
    foot = F.get(F.filter(numbered(kept), lambda p: _footer(p["x"])), F.lit(0))["i"]
    return F.regexp_replace(F.regexp_replace(F.array_join(F.slice(kept, 1, F.coalesce(foot, F.size(kept))), "\n"), r"\n{3,}", "\n\n"), r"\s+$", "")


