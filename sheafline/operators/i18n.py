"""Translation work: what is due, how texts are cut, and gates on results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import alternating, between, matches, once, outside_fences
from .ordering import top_k

#: Keys of extra data that hold no copy, and endings of such keys.
PLACEHOLDER = r"\{\{[^}]*\}\}|\{%[^%]*%\}|%[sd]|\$\{[^}]*\}"
TAG = r"</?[a-zA-Z][a-zA-Z0-9-]*[^>]*>"


#: Languages of a site are a configured list; more than this is taken for a mistake.
MAX_LANGUAGES = 1000


def pending(source: DataFrame, languages: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """(key, hash, lang) for each source page (key, hash) and language whose translation (key, lang, hash) is missing or of another hash.

    Languages are configured codes, at most MAX_LANGUAGES: each row is exploded by the list, so no join pairs them.
    """
    codes = sorted(r[0] for r in languages.select("lang").where("lang IS NOT NULL").distinct().limit(MAX_LANGUAGES + 1).collect())
    if len(codes) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    wanted = source.select(key, "hash", F.explode(F.array(*map(F.lit, codes)).cast("array<string>")).alias("lang"))
    return wanted.join(done.select(key, "lang", "hash"), [key, "lang", "hash"], "left_anti")


def capped(work: DataFrame, most: int, keys: list[str]) -> DataFrame:
    """The first `most` items in the order of these columns, with their rank."""
    return top_k(work, most, [F.col(k) for k in keys])


# segments --------------------------------------------------------------------------------


#: A line that opens or closes code, with its line end.
FENCE_LINE = r"(?md)^ *(?:```|~~~)[^\n]*\n?"
PIECES = "array<struct<kind:string,text:string>>"


def split_segments(text: Column) -> Column:
    """array<struct<kind, text>>: lines of a text with their line ends, as code, heading, table, list, quote, blank or prose.

    A line is code when it is a fence or when an odd number of fences stands before it.
    Joined again in order, the pieces are the text, byte for byte. The text is cut at its
    fences, so each second part is code, and each part into its lines: nothing is
    looked for once a line.
    """
    def piece(x, inside):
        bare = F.trim(x)
        kind = (F.when(inside, "code").when(~x.rlike(r"\S"), "blank").when(bare.rlike("^#{1,6}( |$)"), "heading").when(bare.startswith("|"), "table")
                .when(bare.rlike(r"^([-*+]|\d+[.)]) "), "list").when(bare.startswith(">"), "quote").otherwise("prose"))
        return F.struct(kind.alias("kind"), x.alias("text"))

    def lines(part, k):
        inside, last = k % 2 == 1, part["fence"].isNull()
        # cut at the line ends themselves, which needs no pattern; all lines but the last have theirs again
        whole = once(F.split(part["text"], "\n", -1), lambda ls: F.filter(F.transform(ls, lambda x, i: F.when(i < F.size(ls) - 1, F.concat(x, F.lit("\n"))).otherwise(x)), lambda x: x != ""))
        # what follows the last line end is a piece, empty or not
        ends = F.when(last & ((text == "") | text.endswith("\n")), F.array(piece(F.lit(""), inside))).otherwise(F.array().cast(PIECES))
        fence = F.when(last, ends).otherwise(F.array(F.struct(F.lit("code").alias("kind"), part["fence"].alias("text"))))
        return F.concat(F.transform(whole, lambda x: piece(x, inside)), fence)

    parts = once(alternating(text, FENCE_LINE), lambda p: F.zip_with(between(p), matches(p), lambda t, f: F.struct(t.alias("text"), f.alias("fence"))))
    return F.flatten(F.transform(parts, lines))


def join_segments(pieces: Column) -> Column:
    return F.array_join(F.transform(pieces, lambda p: p["text"]), "")


# gates -------------------------------------------------------------------------------------


def tag_counts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, name, closing, n) of a text's tags."""
    tags = rows.select(key, F.explode(F.regexp_extract_all(text, F.lit(f"({TAG})"), F.lit(1))).alias("tag"))
    return tags.groupBy(key, F.lower(F.regexp_extract("tag", "^</?([a-zA-Z][a-zA-Z0-9-]*)", 1)).alias("name"), F.col("tag").startswith("</").alias("closing")).agg(F.count("*").alias("n"))


def _found(text: Column, pattern: str) -> Column:
    return F.array_sort(F.regexp_extract_all(text, F.lit(f"({pattern})"), F.lit(1)))


def code_spans(text: Column) -> Column:
    """Code spans outside of fenced code, sorted."""
    return _found(F.array_join(outside_fences(text), "\n"), "`[^`\n]+`")


def gates(source: Column, translation: Column, glossary: list[str] = ()) -> dict[str, Column]:
    """One boolean column per gate: what a translation keeps of its source."""
    names = lambda t: F.array_sort(F.transform(_found(t, TAG), lambda x: F.lower(F.regexp_extract(x, "^(</?[a-zA-Z][a-zA-Z0-9-]*)", 1))))
    attrs = lambda t: _found(t, "(?i)(?:href|src|id|class)=\"[^\"]*\"")
    ids = lambda t: _found(F.array_join(outside_fences(t), "\n"), r"\{#[A-Za-z0-9_-]+[^}]*\}")
    bare = lambda t: F.regexp_count(F.regexp_replace(t, TAG, ""), F.lit("<"))
    kept = F.lit(True)
    for word in glossary:
        kept = kept & (~F.contains(source, F.lit(word)) | F.contains(translation, F.lit(word)))
    filled = (F.trim(source) == "") | (F.trim(translation) != "")
    return {
        "not_empty": filled, "glossary": kept, "tags": names(source) == names(translation), "bare_brackets": bare(source) == bare(translation),
        "placeholders": _found(source, PLACEHOLDER) == _found(translation, PLACEHOLDER), "attributes": attrs(source) == attrs(translation),
        "code_spans": code_spans(source) == code_spans(translation), "heading_ids": ids(source) == ids(translation),
        "translated": (source != translation) | ~source.rlike(r"\p{Ll}{2,}.*\s\p{Ll}{2,}"),
    }


def check_translations(pairs: DataFrame, source: str, translation: str, glossary: list[str] = ()) -> DataFrame:
    """pairs with a boolean for each gate and the list of failed ones."""
    found = gates(F.col(source), F.col(translation), glossary)
    failed = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in found.items()]), lambda x: x.isNotNull())
    return pairs.withColumns({f"gate_{k}": v for k, v in found.items()}).withColumn("failed", failed)


def adopt(pairs: DataFrame, source: str, translation: str, source_hash: str, glossary: list[str] = ()) -> DataFrame:
    """Existing translations get the source's hash where all gates hold, else a null one, so they are due again."""
    out = check_translations(pairs, source, translation, glossary)
    return out.withColumn("hash", F.when(F.size("failed") == 0, F.col(source_hash)))


def parse_batch_reply(reply: Column, sent: Column) -> Column:
    """struct(ok, error, texts, flags) of a service's JSON reply.

    A reply fails as a whole where `ok` is false, where its code is neither 0 nor 200, and
    where it is malformed: no texts, another number of them than was sent, or an `ok` array
    of another length or with anything but true and false in it. Without `ok`, and with true,
    all inputs count as translated; an array flags each input, and a false one marks that
    input alone.
    """
    body = F.from_json(reply, "ok string, code int, message string, translations array<string>")
    listed = F.from_json(body["ok"], "array<string>")
    is_list, texts = F.startswith(F.ltrim(body["ok"]), F.lit("[")), body["translations"]
    error = (F.when(body.isNull() | texts.isNull(), "not a reply").when(F.coalesce(body["ok"] == "false", F.lit(False)), F.coalesce(body["message"], F.lit("refused")))
             .when(~F.coalesce(body["code"], F.lit(0)).isin(0, 200), F.concat(F.lit("code "), body["code"].cast("string"))).when(F.size(texts) != sent, "another number of texts")
             .when(is_list & (listed.isNull() | (F.size(listed) != sent) | ~F.forall(listed, lambda x: F.coalesce(x.isin("true", "false"), F.lit(False)))), "malformed flags"))
    flags = F.when(is_list, F.transform(listed, lambda x: x == "true")).otherwise(F.transform(texts, lambda x: F.lit(True)))
    return F.struct(error.isNull().alias("ok"), error.alias("error"), F.when(error.isNull(), texts).alias("texts"), F.when(error.isNull(), flags).alias("flags"))
