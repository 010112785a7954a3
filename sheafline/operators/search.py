"""Search documents and an inverted index."""

from __future__ import annotations

import string

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.stemming import stems
from ..functions.text import path_tokens, search_body
from ..sources.nested import put_together

#: Words that the English pipeline leaves out.
STOP_WORDS = "a an and are as at be by for from in is it of on or that the this to was with".split()


#: A word of lower-case text. Named one by one: Java looks such a class up in one table, while each range is a call of its own for every character.
WORD = f"[{string.ascii_lowercase}{string.digits}]+"
#: Characters of a term that are a level each in index_trees.
DEPTH = 12


def search_documents(pages: DataFrame, sections: DataFrame, limit: int | None = None, distinct: bool = True) -> DataFrame:
    """(lang, url, title, description, body): sections and listed pages that may be searched.

    pages: (lang, url, title, description, content, in_search_index, hidden); sections
    also redirect_to. A page that several sections list is one document, the first one by its columns, unless distinct is off.
    """
    shown = sections.where(F.col("in_search_index") & F.col("redirect_to").isNull() & ~F.col("hidden"))
    own = pages.where(F.col("in_search_index") & ~F.col("hidden"))
    cols = ["lang", "url", "title", "description", search_body(F.col("content"), limit).alias("body")]
    out = shown.select(*cols).unionByName(own.select(*cols))
    return out.groupBy("url").agg(F.min(F.struct("lang", "title", "description", "body", "url")).alias("first")).select("first.lang", "url", "first.title", "first.description", "first.body") if distinct else out


def tokens(docs: DataFrame, key: str, fields: list[str], stop_words=STOP_WORDS, paths: list[str] = (), lang: str | None = None) -> DataFrame:
    """(key, field, pos, term): lower-case words without stop words; path fields split at slashes, dashes and spaces.

    With a language column, words of English documents become stems after that. Each
    distinct word is stemmed once, however often it occurs; occurrences stream past the
    stems of their part, so no task sorts them.
    """
    parts = []
    for f in fields:
        words = path_tokens(F.col(f)) if f in paths else F.regexp_extract_all(F.lower(f), F.lit("([a-z0-9]+)"), F.lit(1))
        parts.append(docs.select(key, *([F.col(lang).alias("__lang")] if lang else []), F.lit(f).alias("field"), F.posexplode(F.coalesce(words, F.array().cast("array<string>"))).alias("pos", "term")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.where(~F.col("term").isin(list(stop_words)))
    if not lang:
        return out
    english = F.col("__lang") == "en"
    words = out.where(english).select("term").distinct().select("term", F.get(stems(F.array("term")), 0).alias("stem"))
    stemmed = out.where(english).join(words.hint("shuffle_hash"), "term").select(key, "field", "pos", F.col("stem").alias("term"))
    return stemmed.unionByName(out.where(~F.coalesce(english, F.lit(False))).select(key, "field", "pos", "term"))


def _counts(docs: DataFrame, key: str, fields: list[str], stop_words=STOP_WORDS, paths: list[str] = ()) -> DataFrame:
    """(key, field, term, tf) of each row: its words are sorted and their runs measured, so no table of terms is held."""
    c = F.col
    values = docs.select(key, F.explode(F.array(*(F.struct(F.lit(f).alias("field"), c(f).cast("string").alias("value")) for f in fields))).alias("f")).select(key, "f.*")
    words = F.regexp_extract_all(F.lower("value"), F.lit(WORD), F.lit(0))
    if paths:
        words = F.when(c("field").isin(list(paths)), path_tokens(c("value"))).otherwise(words)
    rows = values.select(key, "field", F.sort_array(words).alias("__w"))
    # the last place of each run, then its length: a column each, as both look at their neighbours
    ends = F.filter(F.transform("__w", lambda x, i: F.when(~F.equal_null(x, F.get("__w", i + 1)), F.struct(x.alias("term"), i.alias("i")))), lambda e: e.isNotNull())
    rows = rows.select(key, "field", ends.alias("__e"))
    runs = F.transform("__e", lambda e, j: F.struct(e["term"].alias("term"), (e["i"] - F.coalesce(F.get("__e", j - 1)["i"], F.lit(-1))).cast("long").alias("tf")))
    return rows.select(key, "field", F.inline_outer(runs)).where(c("term").isNotNull() & ~c("term").isin(list(stop_words)))


def inverted_index(docs: DataFrame, key: str, fields: list[str], lang: str | None = None, **how) -> DataFrame:
    """(field, term, key, tf). A document is counted where it stands.

    Only documents whose key stands in several rows are summed after that: a table of all
    terms and documents would grow past a task's memory. With a language column, words
    meet their stems first, and all are summed.
    """
    if lang:
        return tokens(docs, key, fields, lang=lang, **how).groupBy("field", "term", key).agg(F.count("*").alias("tf"))
    again = docs.groupBy(F.col(key).alias("__again")).count().where("count > 1").select("__again")
    meets = docs[key].eqNullSafe(again["__again"])
    parts = _counts(docs.join(again, meets, "left_semi"), key, fields, **how).groupBy("field", "term", key).agg(F.sum("tf").alias("tf"))
    return _counts(docs.join(again, meets, "left_anti"), key, fields, **how).select("field", "term", key, "tf").unionByName(parts)


def document_frequencies(index: DataFrame, key: str) -> DataFrame:
    return index.groupBy("field", "term").agg(F.count(key).alias("df"), F.sum("tf").alias("cf"))


def index_trees(index: DataFrame, key: str) -> DataFrame:
    """(field, letter, content): an index (field, term, key, tf) as JSON trees of prefixes, one for each first character.

    A node has its next characters one by one, down to DEPTH of them; the rest of a longer
    term is one step. Where a term ends, it has df and the documents with their
    tf. Trees are built from their leaves up, so each level costs one shuffle of what
    stands on it; a tree is one row, as it is one file.
    """
    c = F.col
    named = lambda at, name: F.struct(at.alias("pos"), name.alias("name"))
    single = F.transform(F.filter(F.split(F.substring("term", 1, DEPTH), ""), lambda x: x != ""), lambda x: named(F.ascii(x), x))
    rest = F.substring(c("term"), F.lit(DEPTH + 1), F.length("term"))
    path = F.concat(single, F.when(rest != "", F.array(named(F.lit(1 << 21), rest))).otherwise(F.array().cast("array<struct<pos:int,name:string>>")))
    late = lambda k, name: named(F.lit((1 << 22) + k), F.lit(name))
    node = F.struct("field", F.substring("term", 1, 1).alias("letter")).alias("node")
    # the place of a document among those of a term is its own, so that order is the key's
    doc = named(F.lit(0), c(key).cast("string"))
    tf = index.select(node, F.concat(path, F.array(late(1, "docs"), doc)).alias("steps"), F.to_json(F.struct(c("tf").alias("tf"))).alias("value"))
    df = document_frequencies(index, key).select(node, F.concat(path, F.array(late(0, "df"))).alias("steps"), c("df").cast("string").alias("value"))
    trees = put_together(tf.unionByName(df), "node", "content")
    return trees.select("node.field", "node.letter", "content")
