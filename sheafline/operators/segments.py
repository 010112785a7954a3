"""Translation of texts by segments: structure never leaves, inline constructs travel as ordered tokens.

A text is cut at hard boundaries (line ends, comments, block elements, fenced code) into
pieces. What a piece holds of prose is its segment; inline constructs inside (code, links,
tags, emphasis, templates, entities, addresses) are masked by tokens with their number. An
answer is accepted when each token comes back once and in order, and every construct
returns byte for byte; otherwise the segment falls apart at its constructs, and the
fragments between them, which hold no token, are asked for instead.

A piece is a struct (head, texts, atoms, tail, sep): texts and atoms alternate, head and
tail are what stands around the segment, sep is the boundary after it. Joined again they are
the text, byte for byte. All of it is column expressions; only asking a client leaves them.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import SPACE, alternating, between, ltrim_all, matches, once, rtrim_all, trim_all
from ..sources.shared import join_shuffled, materialize

# Elements that stand for a break in the sentence, elements whose content is no prose, elements with code.
BLOCK_TAGS = (
    "address", "article", "aside", "blockquote", "body", "button", "canvas", "caption", "col", "colgroup", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hr", "html", "iframe", "img", "input",
    "label", "legend", "li", "link", "main", "map", "meta", "nav", "noscript", "ol", "optgroup", "option", "p", "picture", "section", "select", "source",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "track", "ul", "video",
)
RAW_TAGS = ("script", "style", "svg", "pre", "textarea", "template")
CODE_TAGS = ("code", "kbd", "samp", "tt")

#: What parts pieces. No look-around and no back references, so other engines can run these patterns too.
HARD = (
    r"(?is)<!--.*?-->|(?m:^[ \t]*```[^\n]*\n.*?^[ \t]*```[ \t]*$)|"
    + "|".join(rf"<{t}(?:\s[^<>]*)?>.*?</{t}\s*>" for t in RAW_TAGS)
    + rf"|</?(?:{'|'.join(BLOCK_TAGS)})(?:\s[^<>]*)?/?>|\r?\n"
)
#: What is carried as a token: escapes, code, templates, attributes of headings, tags, images, footnotes, links, entities, addresses, emphasis, bars of tables.
CONSTRUCT = (
    r"\\[!-/:-@\[-`{-~]|``[^`\n]+``|`[^`\n]+`|\{\{.*?\}\}|\{%.*?%\}|\{[ \t]*[#.][^{}\n]*\}|"
    + "|".join(rf"<{t}(?:\s[^<>]*)?>[^\n]*?</{t}\s*>" for t in CODE_TAGS)
    + r"|</?[A-Za-z][^<>\n]*>|!\[|\[\^[^\]\n]*\]|\[|\]\([^()\n]*\)|\]\[[^\]\n]*\]|\]|&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,31});|https?://[^\s<>()\[\]]+|\*+|__+|\|"
)
#: Marks at the start of a Markdown line.
PREFIX = r"^[ \t]*(?:>[ \t]*)*(?:(?:[-*+]|[0-9]{1,9}[.)])[ \t]+(?:\[[ xX]\][ \t]+)?)?(?:#{1,6}[ \t]+)?"
PROSE = r"\p{L}"
#: The same matches, sooner: the many branches are tried only where one of them can begin.
_HARD = rf"(?:(?=[<\r\n`])|(?m:^)(?=[ \t]))(?:{HARD})"
_CONSTRUCT = rf"(?=[\\`{{<!\[\]&*_|]|https?:)(?:{CONSTRUCT})"
# Fixed value: how a token reads.
TOKEN = r"(?i)XHTML([0-9]{4})X"
#: Texts and bytes of a request to a client.
BATCH_TEXTS, BATCH_BYTES = 24, 8192

PIECE = "struct<head:string,texts:array<string>,atoms:array<string>,tail:string,sep:string>"


def token(number: Column) -> Column:
    return F.concat(F.lit("XHTML"), F.lpad(number.cast("string"), 4, "0"), F.lit("X"))


def _lead(s: Column) -> Column:
    return F.substring(s, F.lit(1), F.length(s) - F.length(ltrim_all(s)))


def _trail(s: Column) -> Column:
    return F.substring(s, F.length(rtrim_all(s)) + 1, F.length(s))


def _joined(parts: Column) -> Column:
    return F.array_join(parts, "")


def cut(text: Column) -> Column:
    """array<PIECE> of a text; null for null.

    Each step is a transform of its own, so that what it finds is computed once a piece.
    """
    unit_of = lambda unit, sep: F.struct(unit.alias("unit"), F.coalesce(sep, F.lit("")).alias("sep"), F.regexp_extract(unit, PREFIX, 0).alias("prefix"))
    units = once(alternating(text, _HARD), lambda p: F.zip_with(between(p), matches(p), unit_of))
    bodies = F.transform(units, lambda u: u.withField("apart", alternating(F.substring(u["unit"], F.length(u["prefix"]) + 1, F.length(u["unit"])), _CONSTRUCT)))
    judged = F.transform(bodies, lambda u: F.struct(
        u["unit"].alias("unit"), u["sep"].alias("sep"), u["prefix"].alias("prefix"), between(u["apart"]).alias("texts"), matches(u["apart"]).alias("atoms"),
        F.transform(between(u["apart"]), lambda t: t.rlike(PROSE)).alias("prose")))
    placed = F.transform(judged, lambda u: u.withField("first", F.array_position(u["prose"], True).cast("int")).withField("last", (F.size(u["prose"]) + 1 - F.array_position(F.reverse(u["prose"]), True)).cast("int")))
    return F.transform(placed, _piece)


def _piece(u: Column) -> Column:
    first, last, n = u["first"], u["last"], F.size(u["texts"])
    inner = F.slice(u["texts"], first, F.greatest(last - first + 1, F.lit(0)))
    before = _joined(F.zip_with(F.slice(u["texts"], 1, first - 1), F.slice(u["atoms"], 1, first - 1), lambda t, a: F.concat(t, a)))
    after = _joined(F.zip_with(F.slice(u["atoms"], last, n - last), F.slice(u["texts"], last + 1, n - last), lambda a, t: F.concat(a, t)))
    led = F.transform(inner, lambda t, i: F.when(i == 0, ltrim_all(t)).otherwise(t))
    bare = F.transform(led, lambda t, i: F.when(i == last - first, rtrim_all(t)).otherwise(t))
    none = F.array().cast("array<string>")
    return F.when(
        first > 0,
        F.struct(F.concat(u["prefix"], before, _lead(F.get(u["texts"], first - 1))).alias("head"), bare.alias("texts"), F.slice(u["atoms"], first, last - first).alias("atoms"),
                 F.concat(_trail(F.get(u["texts"], last - 1)), after).alias("tail"), u["sep"].alias("sep")),
    ).otherwise(F.struct(u["unit"].alias("head"), none.alias("texts"), none.alias("atoms"), F.lit("").alias("tail"), u["sep"].alias("sep")))


def source(piece: Column) -> Column:
    """A segment as it was."""
    return _joined(F.transform(piece["texts"], lambda t, i: F.concat(t, F.coalesce(F.get(piece["atoms"], i), F.lit("")))))


def plain(piece: Column) -> Column:
    """A segment without its constructs."""
    return F.array_join(piece["texts"], " ")


def whole(piece: Column, text: Column) -> Column:
    """A piece with a text in its segment's place."""
    return F.concat(piece["head"], text, piece["tail"], piece["sep"])


def packed(piece: Column) -> Column:
    """What is sent of a segment: tokens, with a space on either side, in its constructs' places."""
    return _joined(F.transform(piece["texts"], lambda t, i: F.when(i == 0, t).otherwise(F.concat(F.lit(" "), token(i - 1), F.lit(" "), t))))


def _one_line(s: Column) -> Column:
    return trim_all(F.regexp_replace(s, r"\r\n?|\n", " "))


def _bars(piece: Column, text: Column) -> Column:
    """What a client wrote, without bars that would add a column to a table's row."""
    return F.when(F.ltrim(piece["head"]).startswith("|"), F.regexp_replace(text, r"(?<!\\)\|", r"\\|")).otherwise(text)


def _unmarked(piece: Column, text: Column) -> Column:
    """A translation that opens no list, heading or quote where its line starts."""
    marked = F.regexp_replace(F.regexp_replace(text, r"^([-*+]\s|#{1,6}(?:\s|$)|>)", r"\\$1"), r"^([0-9]{1,9})([.)]\s)", r"$1\\$2")
    return F.when(F.trim(piece["head"]) == "", marked).otherwise(text)


def restore(piece: Column, answer: Column) -> Column:
    """struct(text, error) of an answer to packed(): constructs in their tokens' places, with the white space that stood around them.

    The error is `tokens` where one is missing, repeated, reordered or left over, and
    `empty` where nothing remains; then the text is null.
    """
    k = F.size(piece["atoms"])
    found = lambda a: F.transform(F.regexp_extract_all(a, F.lit(TOKEN), F.lit(1)), lambda x: x.cast("int"))
    fine = lambda a: found(a) == F.transform(piece["atoms"], lambda _, i: i)
    blank = lambda t: trim_all(t) == ""

    def part(x, i):
        bare = F.when(i > 0, ltrim_all(x)).otherwise(x)
        bare = F.when(i < k, rtrim_all(bare)).otherwise(bare)
        own = F.get(piece["texts"], i)
        around = F.concat(F.when(blank(own), "").otherwise(_trail(own)), F.get(piece["atoms"], i), _lead(F.get(piece["texts"], i + 1)))
        return F.concat(_bars(piece, bare), F.when(i < k, around).otherwise(""))

    text = lambda a: _one_line(_joined(F.transform(F.split(a, TOKEN, -1), part)))
    read = once(answer, lambda a: F.struct(text(a).alias("text"), F.coalesce(fine(a), F.lit(False)).alias("fine")))
    error = lambda r: F.when(~r["fine"], "tokens").when(r["text"] == "", "empty")
    return once(read, lambda r: F.struct(F.when(error(r).isNull(), _unmarked(piece, r["text"])).alias("text"), error(r).alias("error")))


def fragments(piece: Column) -> Column:
    """The stretches of prose between a segment's constructs."""
    return F.transform(F.filter(piece["texts"], lambda t: t.rlike(PROSE)), trim_all)


def restore_fragments(piece: Column, answers: Column) -> Column:
    """A segment from one answer for each of its fragments; a null answer leaves the fragment as it was."""
    told = F.transform(piece["texts"], lambda t, i: F.struct(i.alias("i"), t.alias("t"), F.coalesce(F.get(piece["atoms"], i), F.lit("")).alias("atom"), t.rlike(PROSE).alias("prose")))
    filled = lambda p, a: F.concat(_lead(p["t"]), F.coalesce(_bars(piece, _one_line(a)), trim_all(p["t"])), _trail(p["t"]))
    put = lambda p, text: F.struct(p["i"].alias("i"), F.concat(text, p["atom"]).alias("text"))

    def parts(told):
        prose = F.filter(told, lambda p: p["prose"])
        given = F.slice(F.coalesce(answers, F.array().cast("array<string>")), 1, F.size(prose))
        # fragments meet their answers by their order; then all stand in their places again
        return F.concat(F.zip_with(prose, given, lambda p, a: put(p, filled(p, a))), F.transform(F.filter(told, lambda p: ~p["prose"]), lambda p: put(p, p["t"])))

    text = _joined(F.transform(F.array_sort(once(told, parts)), lambda p: p["text"]))
    return once(text, lambda t: _unmarked(piece, t))


def reads_as_prose(text: Column) -> Column:
    """At least two words of three or more lower-case letters, or five words of three or more letters."""
    low, any_ = F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])\p{Ll}{3,}(?![\p{L}\p{N}_])")), F.regexp_count(text, F.lit(r"(?<![\p{L}\p{N}_])\p{L}{3,}(?![\p{L}\p{N}_])"))
    return (low >= 2) | (any_ >= 5)


#: texts, language -> (translation, ok) of each text; what it raises fails the texts of that call.
Client = Callable[[list[str], str], list[tuple[str, bool]]]


def ask(rows: DataFrame, sent: str, client: Client, lang: str) -> DataFrame:
    """rows with answer, ok and error of the texts in a column; calls hold at most BATCH_TEXTS texts and BATCH_BYTES bytes, one text always fits.

    The answers are written before anything reads them: no text is asked for twice
    because a plan is run again.
    """
    schema = T.StructType([*rows.schema.fields, T.StructField("answer", T.StringType()), T.StructField("ok", T.BooleanType()), T.StructField("error", T.StringType())])

    def call(texts: list[str]) -> list[tuple[str | None, bool, str | None]]:
        try:
            got = client(texts, lang)
        except Exception as failure:  # noqa: BLE001 - a client may raise anything; its texts fail, not the job
            return [(None, False, str(failure) or type(failure).__name__)] * len(texts)
        if len(got) != len(texts):
            return [(None, False, f"{len(got)} answers to {len(texts)} texts")] * len(texts)
        return [(t, bool(ok), None) for t, ok in got]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            answers: list[tuple[str | None, bool, str | None]] = []
            held: list[str] = []
            size = 0
            for x in b.column(b.schema.get_field_index(sent)).to_pylist():
                n = len(x.encode())
                if held and (len(held) == BATCH_TEXTS or size + n > BATCH_BYTES):
                    answers += call(held)
                    held, size = [], 0
                held.append(x)
                size += n
            answers += call(held) if held else []
            answer, ok, error = zip(*answers, strict=True) if answers else ((), (), ())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(answer, pa.string()), pa.array(ok, pa.bool_()), pa.array(error, pa.string())], names=schema.fieldNames())

    return materialize(rows.mapInArrow(run, schema), "answers")


def translate(texts: DataFrame, key: str, text: str, client: Client, lang: str) -> DataFrame:
    """(key, text, errors) of texts with distinct keys, translated segment by segment.

    First each segment is asked for with its tokens. One that comes back as it was, marked
    as not translated, or with damaged tokens is asked for by its fragments; fragments
    of four or more words of prose that come back untranslated are asked for once more, they
    alone. A name, a number or up to three words may come back as they are. A segment
    that fails stays as it was, and its page has the reason in errors; a client's own error
    is not asked again. Null texts stay null. A page's pieces meet in one row at the end;
    all else is per segment.
    """
    c = F.col
    pieces = materialize(texts.select(key, F.posexplode_outer(cut(c(text))).alias("pos", "piece")), "pieces")
    piece = c("piece")
    segments = pieces.where(F.size("piece.texts") > 0)
    first = join_shuffled(ask(segments.select(key, "pos", packed(piece).alias("sent")), "sent", client, lang), segments, [key, "pos"])
    back = first.withColumn("back", restore(piece, c("answer"))).withColumn("prose", reads_as_prose(plain(piece)))
    echoed = c("prose") & (trim_all(c("back.text")) == trim_all(source(piece)))
    state = F.when(c("error").isNotNull(), "failed").when(~c("ok") & ~c("prose"), "kept").when(~c("ok") | c("back.error").isNotNull() | echoed, "again").otherwise("done")
    judged = materialize(back.withColumn("state", state).select(key, "pos", "piece", "state", "error", c("back.text").alias("done")), "first-answers")
    again = judged.where("state = 'again'")
    rows = again.select(key, "pos", F.posexplode(fragments(piece)).alias("k", "sent"))
    words = F.size(F.filter(F.split("sent", f"{SPACE}+"), lambda w: w != ""))
    untranslated = ~c("ok") | (trim_all(c("answer")) == "") | (trim_all(c("answer")) == trim_all(c("sent")))
    second = ask(rows, "sent", client, lang)
    failing = c("error").isNull() & untranslated & reads_as_prose(c("sent")) & (words > 3)
    third = ask(second.where(failing).select(*rows.columns), "sent", client, lang)
    told = second.where(~F.coalesce(failing, F.lit(False))).unionByName(third)
    usable = c("error").isNull() & c("ok") & (trim_all(c("answer")) != "") & ~(reads_as_prose(c("sent")) & (trim_all(c("answer")) == trim_all(c("sent"))))
    as_is = c("error").isNull() & (~reads_as_prose(c("sent")) | (words <= 3))
    judged_fragments = told.select(key, "pos", F.struct(
        "k", F.when(usable, c("answer")).when(as_is, c("sent")).alias("text"),
        F.when(c("error").isNotNull(), c("error")).when(~usable & ~as_is, F.concat(F.lit("untranslated: "), F.substring("sent", 1, 60))).alias("error")).alias("f"))
    joined = judged_fragments.groupBy(key, "pos").agg(F.array_sort(F.collect_list("f")).alias("f"))
    answers, wrong = F.transform("f", lambda f: f["text"]), F.get(F.filter("f", lambda f: f["error"].isNotNull()), 0)["error"]
    redone = join_shuffled(again, joined, [key, "pos"]).select(key, "pos", F.when(wrong.isNull(), restore_fragments(piece, answers)).alias("text"), wrong.alias("error"))
    others = judged.where("state <> 'again'").select(key, "pos", F.when(c("state") == "done", c("done")).alias("text"), F.when(c("state") == "failed", c("error")).alias("error"))
    results = others.unionByName(redone)
    filled = join_shuffled(pieces, results, [key, "pos"], "left").select(
        key, F.struct("pos", F.when(piece.isNotNull(), whole(piece, F.coalesce("text", source(piece)))).alias("text"), "error").alias("p"))
    out = filled.groupBy(key).agg(F.array_sort(F.collect_list("p")).alias("p"))
    return out.select(key, F.when(F.exists("p", lambda p: p["text"].isNotNull()), _joined(F.transform("p", lambda p: p["text"]))).alias("text"),
                      F.filter(F.transform("p", lambda p: p["error"]), lambda e: e.isNotNull()).alias("errors"))
