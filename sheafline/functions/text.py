"""Text, HTML and number functions as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Words (zh, ja: characters) read in a minute.
READING_RATES = {"en": 238, "ko": 202, "zh": 439, "ja": 653}
OTHER_RATE = 200
#: Characters that count as a word each.
CJK = (r"[\x{1100}-\x{11FF}\x{3040}-\x{309F}\x{30A0}-\x{30FF}\x{3130}-\x{318F}\x{31F0}-\x{31FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}"
       r"\x{A960}-\x{A97F}\x{AC00}-\x{D7FF}\x{F900}-\x{FAFF}\x{FF66}-\x{FF9D}]")
# Language codes written from right to left.
RIGHT_TO_LEFT = ("ar", "arc", "ckb", "dv", "fa", "he", "ks", "lrc", "mzn", "nqo", "pnb", "ps", "rhg", "sd", "syr", "ug", "ur", "uz-arab", "yi")

SPACE = r"[\s\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
#: A word: letters and digits, joined inside by an apostrophe or a dot.
WORD = r"[\p{L}\p{N}_]+(?:['’.][\p{L}\p{N}_]+)*"
FENCE = "```"


#: The characters of SPACE.
_BLANKS = "".join(map(chr, [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def trim_all(s: Column) -> Column:
    """Without any white space at the ends."""
    return F.trim(s, F.lit(_BLANKS))


def ltrim_all(s: Column) -> Column:
    """Without any white space at the start."""
    return F.ltrim(s, F.lit(_BLANKS))


def rtrim_all(s: Column) -> Column:
    """Without any white space at the end. A pattern would be tried at every character."""
    return F.rtrim(s, F.lit(_BLANKS))


def once(value: Column, then: Callable[[Column], Column]) -> Column:
    """then(value), with value computed once a row however often then names it."""
    return F.get(F.transform(F.array(value), then), 0)


def alternating(text: Column, pattern: str) -> Column:
    """What stands between the matches of a pattern and the matches themselves, in turn, from one pass over the text.

    Matches are set between marks, and the text is cut at these. A text that has the mark
    itself is escaped first, by characters that the patterns take as they take the mark.
    """
    mark, escape = "\x01", "\x02"
    apart = lambda t: F.split(F.regexp_replace(t, pattern, f"{mark}$0{mark}"), mark, -1)
    escaped = F.replace(F.replace(text, F.lit(escape), F.lit(escape + "\x03")), F.lit(mark), F.lit(escape + "\x04"))
    bare = lambda x: F.replace(F.replace(x, F.lit(escape + "\x04"), F.lit(mark)), F.lit(escape + "\x03"), F.lit(escape))
    return F.when(~F.contains(text, F.lit(mark)), apart(text)).otherwise(F.transform(apart(escaped), bare))


def between(parts: Column) -> Column:
    """Of alternating(): what stands between the matches, one more than these."""
    return F.filter(parts, lambda _, i: i % 2 == 0)


def matches(parts: Column) -> Column:
    """Of alternating(): the matches."""
    return F.filter(parts, lambda _, i: i % 2 == 1)


def outside_fences(text: Column) -> Column:
    """The parts of a text outside of fenced code, as an array."""
    return F.filter(F.split(text, FENCE), lambda x, i: i % 2 == 0)


def word_count(text: Column, lang: Column | None = None, pattern: str = WORD) -> Column:
    """Words outside fenced code; letters where the language is Chinese or Japanese."""
    plain = F.array_join(outside_fences(text), "\n")
    words = F.regexp_count(plain, F.lit(pattern))
    if lang is None:
        return words
    return F.when(primary(lang).isin("zh", "ja"), F.regexp_count(plain, F.lit(r"\p{L}"))).otherwise(words)


def primary(lang: Column) -> Column:
    """The part of a language code before the first dash."""
    return F.element_at(F.split(lang, "-"), 1)


def reading_minutes(count: Column, lang: Column) -> Column:
    """Count over the language's rate, rounded up."""
    rate = F.lit(OTHER_RATE)
    for code, n in READING_RATES.items():
        rate = F.when(primary(lang) == code, n).otherwise(rate)
    return F.ceil(count / rate)


def text_direction(lang: Column) -> Column:
    return F.when(F.lower(primary(lang)).isin(list(RIGHT_TO_LEFT)) | F.lower(lang).isin(list(RIGHT_TO_LEFT)), "rtl").otherwise("ltr")


def strip_tags(html: Column) -> Column:
    """Without tags; an unclosed tag takes the rest, a stray closing bracket goes."""
    return F.replace(F.regexp_replace(html, "<[^>]*(>|$)", ""), F.lit(">"), F.lit(""))


def graph_word_count(body: Column) -> Column:
    """Words between white space, tags left out, and one more for each CJK character."""
    text = strip_tags(body)
    return F.size(F.filter(F.split(text, SPACE + "+"), lambda w: w != "")) + F.regexp_count(text, F.lit(CJK))


def content_hash(body: Column) -> Column:
    return F.sha2(trim_all(body), 256)


def summarize(body: Column, n: int = 160) -> Column:
    """Lines without leading heading marks, joined by spaces; the first n characters."""
    lines = F.transform(F.split(body, "\n"), lambda x: F.trim(F.regexp_replace(F.trim(x), "^#+", "")))
    return F.substring(F.array_join(F.filter(lines, lambda x: x != ""), " "), 1, n)


def decode_entities(s: Column, names: dict[str, str] | None = None) -> Column:
    """The named entities in order: `&amp;` first, as its result may be decoded again."""
    for entity, value in (names or {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&apos;": "'", "&quot;": '"'}).items():
        s = F.replace(s, F.lit(entity), F.lit(value))
    return s


#: Of page texts: five more than decode_entities() has.
PAGE_ENTITIES = {"&amp;": "&", "&lt;": "<", "&gt;": ">", "&quot;": '"', "&#39;": "'", "&apos;": "'", "&nbsp;": " ", "&mdash;": "—", "&ndash;": "–"}


def escape_xml(s: Column) -> Column:
    for value, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        s = F.replace(s, F.lit(value), F.lit(entity))
    return s


def html_title(html: Column) -> Column:
    return decode_entities(trim_all(F.regexp_extract(html, r"(?is)<title>(.*?)</title>", 1)), PAGE_ENTITIES)


def first_h1(body: Column) -> Column:
    """The first Markdown heading of level one, else the first h1 element; null without either."""
    marked = F.trim(F.regexp_extract(body, r"(?m)^#[ \t]+(.*)$", 1))
    tagged = trim_all(strip_tags(F.regexp_extract(body, r"(?is)<h1[^>]*>(.*?)</h1>", 1)))
    return F.coalesce(F.nullif(marked, F.lit("")), F.nullif(tagged, F.lit("")))


def search_body(html: Column, limit: int | None = None) -> Column:
    """Text for search: no tags, nothing inside script, style or pre; runs of spaces and blank lines collapsed."""
    bare = html
    for name in ("script", "style", "pre"):
        bare = F.regexp_replace(bare, rf"(?is)<{name}\b.*?</{name}\s*>", "")
    bare = strip_tags(F.regexp_replace(bare, "(?s)<!--.*?-->", ""))
    lines = F.transform(F.split(bare, "\n"), lambda x: F.trim(F.regexp_replace(x, SPACE + "+", " ")))
    out = F.array_join(F.filter(lines, lambda x: x != ""), "\n")
    return F.substring(out, 1, limit) if limit is not None else out


#: Elements that stand on lines of their own.
BLOCKS = "h1 h2 h3 h4 h5 h6 p li ul ol div section article header footer br".split()


def html_to_text(html: Column) -> Column:
    """Readable text: no script or style, block elements on new paragraphs, other tags gone."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?(</\1>|$)", "")
    bare = F.regexp_replace(bare, SPACE + "+", " ")
    bare = F.regexp_replace(bare, rf"(?i)</?({'|'.join(BLOCKS)})(\s[^>]*)?/?>", "\n\n")
    text = decode_entities(F.regexp_replace(bare, "<[^>]*>", ""), PAGE_ENTITIES)
    return trim_all(F.regexp_replace(F.regexp_replace(text, r" *\n *", "\n"), r"\n{3,}", "\n\n"))


def path_tokens(path: Column) -> Column:
    return F.filter(F.split(F.lower(path), r"[\s/-]+"), lambda x: x != "")


def needs_templating(s: Column) -> Column:
    return F.contains(s, F.lit("{{")) | F.contains(s, F.lit("{%"))


def has_anchor(html: Column, anchor: Column) -> Column:
    """Whether an id or name attribute has this value, quoted or not."""
    quoted = F.regexp_replace(anchor, r"([\\.\[\]{}()*+?^$|-])", r"\\$1")
    return F.regexp_like(html, F.concat(F.lit(r"(?i)\s(id|name)\s*=\s*[\"']?"), quoted, F.lit(r"[\"'\s>]")))


def clip(s: Column, n: int) -> Column:
    return F.when(F.length(s) > n, F.concat(F.substring(s, 1, n), F.lit("…"))).otherwise(s)


def base64_line(data: Column) -> Column:
    """Base64 on one line: Spark breaks it after 76 characters where spark.sql.chunkBase64String.enabled says so."""
    return F.regexp_replace(F.base64(data), r"\r?\n", "")


def hash_of(s: Column, bits: int = 384, as_base64: bool = True) -> Column:
    """SHA-2 as base64 or hex; 384 bits too."""
    h = F.expr("NULL") if bits not in (256, 384, 512) else F.sha2(s, bits)
    return base64_line(F.unhex(h)) if as_base64 else h


def source_hash(title: Column, description: Column, body: Column, extra: Column) -> Column:
    """Of a translation's source: fields apart by NUL, extra pairs [(path, text)] by unit separators."""
    pairs = F.transform(extra, lambda x: F.concat(x["path"], F.lit("\x1f"), x["text"]))
    return F.sha2(F.concat_ws("\0", F.coalesce(title, F.lit("")), F.coalesce(description, F.lit("")), F.coalesce(body, F.lit("")), F.array_join(pairs, "\0")), 256)


def file_size(n: Column) -> Column:
    """Bytes with a binary unit."""
    units = ["B", "KiB", "MiB", "GiB", "TiB", "PiB"]
    out = F.format_string("%d B", n.cast("long"))
    for k, unit in enumerate(units[1:], 1):
        out = F.when(n >= 1024**k, F.concat(F.format_string("%.2f ", n / float(1024**k)), F.lit(unit))).otherwise(out)
    return out


# Locales whose groups are of two after the last three; the platform's data do not tell.
GROUPS_OF_TWO = ("as", "bn", "brx", "dz", "en-IN", "gu", "hi", "kok", "mai", "ml", "mr", "ne", "pa", "sat", "ta", "te", "ur-IN")


def _grouping(locale: str) -> tuple[str, bool]:
    """A locale's thousands mark, from the platform's locale data, and whether its groups are of two after the last three; ValueError for an unknown language."""
    java = SparkSession.active()._jvm.java
    if locale.split("-")[0] not in set(java.util.Locale.getISOLanguages()):
        raise ValueError(f"unknown locale {locale}")
    form = java.text.NumberFormat.getIntegerInstance(java.util.Locale.forLanguageTag(locale))
    return form.getDecimalFormatSymbols().getGroupingSeparator(), locale in GROUPS_OF_TWO or locale.split("-")[0] in GROUPS_OF_TWO


def num_format(n: Column, locale: str = "en") -> Column:
    """An integer with its locale's thousands marks; an unknown locale is an error."""
    digits = F.abs(n.cast("decimal(38,0)")).cast("string")
    sign = F.when(n < 0, "-").otherwise("")
    mark, by_two = _grouping(locale)
    if by_two:
        head, tail = F.regexp_replace(digits, r"\d{3}$", ""), F.substring(digits, -3, 3)
        grouped = F.concat(F.regexp_replace(head, r"(\d)(?=(\d{2})+$)", "$1" + mark), F.lit(mark), tail)
        return F.concat(sign, F.when(F.length(digits) > 3, grouped).otherwise(digits))
    return F.concat(sign, F.regexp_replace(digits, r"(\d)(?=(\d{3})+$)", "$1" + mark))


def resize_geometry(op: str, w: Column, h: Column, want_w: int | None, want_h: int | None) -> Column:
    """struct(width, height, crop_x, crop_y, crop_width, crop_height) of a planned resize; crop is null where none is made."""
    w, h = w.cast("long"), h.cast("long")
    whole = lambda ww, hh, crop=(None,) * 4: F.struct(
        ww.cast("int").alias("width"), hh.cast("int").alias("height"),
        *[(F.lit(None) if c is None else c).cast("int").alias(n) for c, n in zip(crop, ("crop_x", "crop_y", "crop_width", "crop_height"), strict=True)])
    if op == "scale":
        return whole(F.lit(want_w), F.lit(want_h))
    if op == "fit_width":
        return whole(F.lit(want_w), F.greatest(F.floor(h * want_w / w), F.lit(1)))
    if op == "fit_height":
        return whole(F.greatest(F.floor(w * want_h / h), F.lit(1)), F.lit(want_h))
    if op == "fit":
        small = (w <= want_w) & (h <= want_h)
        by_width = w * want_h > h * want_w
        ww = F.when(small, w).when(by_width, F.lit(want_w)).otherwise(F.floor(w * want_h / h))
        hh = F.when(small, h).when(by_width, F.floor(h * want_w / w)).otherwise(F.lit(want_h))
        return whole(ww, hh)
    if op == "fill":
        by_w, by_h = (w / want_w).cast("float"), (h / want_h).cast("float")
        tall = by_w < by_h
        cw = F.when(tall, w).otherwise(F.round(by_h * F.lit(want_w).cast("float")))
        ch = F.when(tall, F.round(by_w * F.lit(want_h).cast("float"))).otherwise(h)
        crop = (F.floor((w - cw) / 2), F.floor((h - ch) / 2), cw, ch)
        similar = F.abs(by_w - by_h) <= F.lit(0.1).cast("float")  # so close that nothing is cut
        return whole(F.lit(want_w), F.lit(want_h), tuple(F.when(~similar, c) for c in crop))
    raise ValueError(f"unknown operation {op}")


def rotated_size(w: Column, h: Column, orientation: Column) -> Column:
    """Width and height after an EXIF orientation: 5 to 8 swap them."""
    swap = F.coalesce(orientation.between(5, 8), F.lit(False))
    return F.struct(F.when(swap, h).otherwise(w).alias("width"), F.when(swap, w).otherwise(h).alias("height"))
