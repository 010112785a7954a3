"""Paths, slugs, links and URLs as column expressions."""

from __future__ import annotations

import os

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Endings of static assets.
ASSET_ENDINGS = (".ico", ".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".avif", ".css", ".js", ".json",
                 ".xml", ".pdf", ".zip", ".mp4", ".webm", ".woff", ".woff2", ".ttf")


def one_of(words) -> str:
    """A pattern that matches any of the words as they are."""
    return "(?:" + "|".join("".join("\\" + c if not c.isalnum() and c not in "_-/ " else c for c in w) for w in words) + ")"


# slugs --------------------------------------------------------------------------


def slug_ascii(s: Column) -> Column:
    """Lower-case ASCII letters and digits, everything else a single dash; none at the ends."""
    return F.regexp_replace(F.regexp_replace(F.translate(F.regexp_replace(s, "[^A-Za-z0-9]+", "-"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "^-+", ""), "-+$", "")


#: Letters that no decomposition gives, with their usual spelling.
SPELLED = {"ß": "ss", "æ": "ae", "Æ": "AE", "ø": "o", "Ø": "O", "đ": "d", "Đ": "D", "ł": "l", "Ł": "L", "œ": "oe", "Œ": "OE", "þ": "th", "Þ": "TH", "ð": "d", "ı": "i"}
_GREEK = ("αβγδεζηθικλμνξοπρσςτυφχψω", "a b g d e z e th i k l m n x o p r s s t y ph ch ps o".split())
_CYRILLIC = ("абвгдежзийклмнопрстуфхцчшщъыьэюя", "a b v g d e zh z i i k l m n o p r s t u f kh ts ch sh shch  y  e iu ia".split(" "))


def transliterate(s: Column) -> Column:
    """Latin letters for accented Latin, Greek and Cyrillic ones; other characters stay.

    Accents go by listing the accented letters of the Latin blocks under their base
    letter (from Unicode decompositions), so the whole is one translate() and a few replaces.
    """
    import unicodedata

    plain, base = [], []
    for code in [*range(0xC0, 0x250), *range(0x370, 0x400), *range(0x1E00, 0x2000)]:
        first = unicodedata.normalize("NFD", chr(code))[0]
        if first != chr(code) and (first.isascii() or first.lower() in _GREEK[0]):
            plain.append(chr(code))
            base.append(first)
    out = F.translate(s, "".join(plain), "".join(base))
    for letters, names in (_GREEK, _CYRILLIC):
        for letter, name in zip(letters, names, strict=True):
            out = F.replace(F.replace(out, F.lit(letter), F.lit(name)), F.lit(letter.upper()), F.lit(name.capitalize()))
    for letter, name in SPELLED.items():
        out = F.replace(out, F.lit(letter), F.lit(name))
    return F.regexp_replace(out, r"\p{M}", "")


def slugify_paths(s: Column, strategy: str = "on") -> Column:
    """`on`: a transliterated ASCII slug; `safe`: only characters that file systems refuse go; `off`: as it is."""
    if strategy == "on":
        return slug_ascii(transliterate(s))
    if strategy == "safe":
        return F.regexp_replace(F.regexp_replace(s, r"[ .]+$", ""), r'[<>:"/|?*\\]', "")
    return s


def slugify_anchors(s: Column, strategy: str = "on") -> Column:
    """As slugify_paths for `on`; else ASCII white space becomes an underscore."""
    return slugify_paths(s) if strategy == "on" else F.regexp_replace(s, r"[ \t\n\x0B\f\r]", "_")


# keys of a file -------------------------------------------------------------------


def components(path: Column) -> Column:
    """Directory names after the first `content` directory of a file path."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    at = F.array_position(dirs, "content")
    return F.when(at > 0, F.slice(dirs, at.cast("int") + 1, F.size(dirs))).otherwise(dirs)


def file_stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def stem_language(stem: Column, languages, default: str) -> Column:
    """The second dot part of a stem where it names a language, else the default."""
    part = F.regexp_extract(stem, r"^[^.]+\.([^.]+)$", 1)
    return F.when(part.isin(list(languages)), part).otherwise(F.lit(default))


def language_neutral_path(path: Column, languages) -> Column:
    """`a.fr.md` becomes `a.md` for the listed languages; null where it isn't a Markdown file."""
    return F.when(path.endswith(".md"), F.regexp_replace(path, rf"([^/])\.{one_of(sorted(languages))}\.md$", "$1.md"))


def page_id(rel: Column) -> Column:
    return F.concat(F.lit("content/"), F.regexp_replace(F.replace(rel, F.lit("\\"), F.lit("/")), "^/?(content/)?", ""))


def path_with_language(path: Column, lang: str, default: str) -> Column:
    return path if lang == default else F.regexp_replace(path, r"\.([^./]*)$", f".{lang}.$1")


def make_permalink(base: str, path: Column) -> Column:
    """The site's address of a path: one slash between, one at the end but for files of feeds, anchors and the root."""
    base = base.rstrip("/")
    tail = F.regexp_replace(path, "^/+", "")
    bare = (tail == "") | F.contains(tail, F.lit("#")) | tail.endswith("/") | tail.rlike(r"\.xml$")
    return F.concat(F.lit(base + "/"), tail, F.when(bare, "").otherwise("/"))


def taxonomy_path(lang: Column, default: str, slug: Column, term: Column | None = None, root: str = "") -> Column:
    parts = [F.when(lang != default, F.concat(F.lit("/"), lang)).otherwise(""), F.lit("/" + root if root else ""), F.lit("/"), slug, F.lit("/")]
    return F.concat(*parts, *([term, F.lit("/")] if term is not None else []))


def paginate_url(base: Column, paginate_path: Column, number: Column) -> Column:
    return F.concat(base, F.when(paginate_path == "", "").otherwise(F.concat(paginate_path, F.lit("/"))), number.cast("string"), F.lit("/"))


# URLs -----------------------------------------------------------------------------


def is_external_link(link: Column) -> Column:
    return link.rlike("^https?:")


def is_special_anchor(anchor: Column) -> Column:
    return F.lower(anchor).isin("", "top")


def is_asset_url(url: Column) -> Column:
    """Ends in an asset's ending, whatever the case, query and fragment."""
    return F.lower(F.regexp_replace(url, "[?#].*$", "")).rlike(one_of(ASSET_ENDINGS) + "$")


def is_colocated_link(link: Column) -> Column:
    """A bare file name: no slash, parent step, fragment or scheme."""
    return ~(F.contains(link, F.lit("/")) | F.contains(link, F.lit("..")) | F.contains(link, F.lit("#")) | link.rlike("^[a-zA-Z][a-zA-Z0-9+.-]*:")) & (link != "")


def starts_with_any(link: Column, prefixes) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | link.startswith(p)
    return out


def url_host(url: Column) -> Column:
    """Lower-case host, null where there is none."""
    return F.nullif(F.lower(F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    """Path of an absolute URL, `/` where it has none."""
    p = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*([^?#]*)", 1)
    return F.when(p == "", "/").otherwise(p)


def closed(path: Column) -> Column:
    """With one slash at the end."""
    return F.when(path.endswith("/"), path).otherwise(F.concat(path, F.lit("/")))


def norm_path(p: Column) -> Column:
    """The path of a URL or path, with a slash at both ends; empty stays empty."""
    t = F.trim(p)
    own = F.when(t.rlike("^https?://"), url_path(t)).otherwise(t)
    return F.when(t == "", "").otherwise(closed(F.when(own.startswith("/"), own).otherwise(F.concat(F.lit("/"), own))))


def norm_href(h: Column) -> Column:
    """scheme://host/path/ in one form: lower-case host, no query or fragment; paths as norm_path."""
    t = F.trim(h)
    scheme = F.lower(F.regexp_extract(t, "^([a-zA-Z][a-zA-Z0-9+.-]*)://", 1))
    return F.when(scheme == "", norm_path(t)).otherwise(F.concat(scheme, F.lit("://"), F.coalesce(url_host(t), F.lit("")), closed(url_path(t))))


def normalize_base_url(base: Column) -> Column:
    return F.concat(F.regexp_replace(base, "/+$", ""), F.lit("/"))


def url_to_content_path(url: Column) -> Column:
    """The path without slashes at its ends; `home` for the root."""
    p = F.regexp_replace(F.regexp_replace(url_path(url), "^/+", ""), "/+$", "")
    return F.when(p == "", "home").otherwise(p)


def attr_value(tag: Column, name: str) -> Column:
    """An attribute of a tag's text, quoted or not; null where it is missing."""
    lead = rf"(?i)[\s<]{name}\s*=\s*"
    quoted = F.regexp_extract(tag, lead + "(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", 1)
    single = F.regexp_extract(tag, lead + "(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", 2)
    bare = F.regexp_extract(tag, lead + "(?:\"([^\"]*)\"|'([^']*)'|([^\\s>\"']+))", 3)
    return F.when(tag.rlike(rf"(?i)[\s<]{name}\s*="), F.concat(quoted, single, bare))


def rel_is(tag: Column, want: str) -> Column:
    return F.coalesce(F.lower(attr_value(tag, "rel")) == want.lower(), F.lit(False))


def join_url(base: Column, rel: Column) -> Column:
    """A site-relative link on the host of base; absolute links stay."""
    origin = F.regexp_extract(base, "^([a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*)", 1)
    return F.when(rel.startswith("/"), F.concat(origin, rel)).otherwise(rel)


def get_url(base: str, path: Column, lang: Column | None = None, default: str = "en", trailing_slash: bool = False, content: Column | None = None) -> Column:
    """The address of a path of the site in a language; with the content of its file, the start of its hash is appended, so that caches notice a change."""
    bare = F.regexp_replace(path, "^/+", "")
    own = bare if lang is None else F.when(lang == default, bare).otherwise(F.concat(lang, F.lit("/"), bare))
    out = F.concat(F.lit(base.rstrip("/") + "/"), own)
    if trailing_slash:
        out = F.when(out.endswith("/"), out).otherwise(F.concat(out, F.lit("/")))
    return out if content is None else F.concat(out, F.lit("?h="), F.substring(F.sha2(content, 256), 1, 20))


def translated(key: Column, lang: Column, words: dict[str, dict[str, str]]) -> Column:
    """A configured word (language -> key -> text) in a language; null where it is missing."""
    flat = [x for code, own in sorted(words.items()) for k, v in sorted(own.items()) for x in (F.lit(f"{code}\0{k}"), F.lit(v))]
    return F.try_element_at(F.create_map(*flat), F.concat(lang, F.lit("\0"), key)) if flat else F.lit(None).cast("string")


def get_env(name: str, default: str | None = None) -> Column:
    """A variable of the driver's environment as it is when the plan is made; without it the default, and without that an error."""
    value = os.environ.get(name, default)
    if value is None:
        raise ValueError(f"{name} is not set")
    return F.lit(value)
