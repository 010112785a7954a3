"""Segments, fields and headers of translations over the given tables."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SPACE
from ..operators import headers, segments
from ..sources import nested
from ..sources.adapters import table
from .catalog import query
from .files import _cat
from .markup import _PLAIN_SQL, _docs

_TEXTS = "SELECT 'd' AS kind, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'p', page_id, html FROM pages WHERE html IS NOT NULL"


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.lit("d").alias("kind"), F.col("doc_id").alias("id"), "text")
    return docs.unionByName(table(spark, sf_dir, "pages").select(F.lit("p").alias("kind"), F.col("page_id").alias("id"), F.col("html").alias("text"))).where("text IS NOT NULL")


@query("masked_segments", f"""WITH t AS ({_TEXTS}),
u AS (SELECT kind, id, pos, units[pos] AS unit FROM (SELECT kind, id, units, unnest(range(1, len(units) + 1)) AS pos FROM (SELECT kind, id, string_split_regex(text, '{segments.HARD}') AS units FROM t))),
c AS (SELECT kind, id, pos, string_split_regex(body, '{segments.CONSTRUCT}') AS texts FROM (SELECT kind, id, pos, substr(unit, length(regexp_extract(unit, '{segments.PREFIX}')) + 1) AS body FROM u)),
d AS (SELECT kind, id, pos, texts, list_position(prose, true) AS a, len(prose) + 1 - list_position(list_reverse(prose), true) AS z
  FROM (SELECT *, [regexp_matches(x, '{segments.PROSE}') FOR x IN texts] AS prose FROM c) WHERE list_contains(prose, true)),
s AS (SELECT kind, id, pos, z - a AS k, array_to_string([CASE WHEN i = a THEN '' ELSE ' XHTML' || lpad(CAST(i - a - 1 AS VARCHAR), 4, '0') || 'X ' END || regexp_replace(CASE WHEN i = a THEN regexp_replace(texts[i], '^{SPACE}+', '') ELSE texts[i] END,
  CASE WHEN i = z THEN '{SPACE}+$' ELSE '$^' END, '') FOR i IN range(a, z + 1)], '') AS packed FROM d)
SELECT kind, id, true AS same, count(packed) AS n_segments, CAST(coalesce(sum(k), 0) AS BIGINT) AS n_tokens, md5(coalesce(string_agg(packed, chr(10) ORDER BY pos), '')) AS packed_md5 FROM t LEFT JOIN s USING (kind, id) GROUP BY kind, id""")
def masked_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text is its pieces again, byte for byte; what is sent of it has tokens for its constructs."""
    pieces = F.col("pieces")
    out = _texts(spark, sf_dir).withColumn("pieces", segments.cut(F.col("text"))).withColumn("segments", F.filter(pieces, lambda p: F.size(p["texts"]) > 0))
    return out.select(
        "kind", "id", (F.array_join(F.transform(pieces, lambda p: segments.whole(p, segments.source(p))), "") == F.col("text")).alias("same"), F.size("segments").cast("long").alias("n_segments"),
        F.aggregate("segments", F.lit(0).cast("long"), lambda n, p: n + F.size(p["atoms"])).alias("n_tokens"), F.md5(F.array_join(F.transform("segments", segments.packed), "\n")).alias("packed_md5"))


@query("restored_answers", f"""SELECT kind, id, true AS same, true AS same_by_fragments FROM ({_TEXTS})""")
def restored_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each segment of every text comes back from its own packed form, and from its own fragments, as it was but for line ends and marks at its start."""
    pieces = F.filter(segments.cut(F.col("text")), lambda p: F.size(p["texts"]) > 0)
    bare = lambda s: F.replace(s, F.lit("\\"), F.lit(""))
    back = F.transform(pieces, lambda p: F.struct(bare(segments.source(p)).alias("own"), segments.restore(p, segments.packed(p)).alias("r"), bare(segments.restore_fragments(p, segments.fragments(p))).alias("f")))
    # a column of its own: both answers read it
    told = _texts(spark, sf_dir).select("kind", "id", F.transform(back, lambda b: F.struct((b["r"]["error"].isNull() & (bare(b["r"]["text"]) == b["own"])).alias("same"), (b["f"] == b["own"]).alias("by_fragments"))).alias("back"))
    return told.select("kind", "id", F.forall("back", lambda b: b["same"]).alias("same"), F.forall("back", lambda b: b["by_fragments"]).alias("same_by_fragments"))


_T = "'XHTML000{}X'"


@query("damaged_answers", f"""SELECT doc_id, CASE WHEN n IN (1, 2, 3, 4, 7) THEN 'tokens' WHEN n = 5 THEN 'tokens' END AS error,
  CASE n WHEN 0 THEN 'See [' || p || '](/s/' || doc_id || '/) and `x y` in *' || source || '* end'
    WHEN 6 THEN 'Siehe [' || lead || trim(upper(p)) || trail || '](/s/' || doc_id || '/) und `x y` in einem *' || source || '* Ende' END AS text
FROM (SELECT doc_id, source, doc_id % 8 AS n, {_PLAIN_SQL} AS p, CASE WHEN trim({_PLAIN_SQL}) = '' THEN {_PLAIN_SQL} ELSE regexp_extract({_PLAIN_SQL}, '^ *') END AS lead, CASE WHEN trim({_PLAIN_SQL}) = '' THEN '' ELSE regexp_extract({_PLAIN_SQL}, ' *$') END AS trail FROM documents)""")
def damaged_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens lost, doubled, swapped, left over or all gone are refused; other case, other white space and line ends are not."""
    n, k = F.col("doc_id") % 8, F.col("doc_id")
    body = _cat("See [", F.col("plain"), "](/s/", k, "/) and `x y` in *", F.col("source"), "* end")
    t = [f"XHTML000{i}X" for i in range(6)]
    docs = _docs(spark, sf_dir).withColumn("piece", F.get(segments.cut(body), 0)).withColumn("sent", segments.packed(F.col("piece")))
    swap = F.replace(F.replace(F.replace(F.col("sent"), F.lit(t[0]), F.lit("<0>")), F.lit(t[1]), F.lit(t[0])), F.lit("<0>"), F.lit(t[1]))
    german = _cat("Siehe ", t[0].lower(), F.lit("  \n"), F.trim(F.upper("plain")), t[1], " und ", t[2], " in\neinem ", t[3], F.col("source"), F.lit(" \r\n"), t[4], "Ende\n")
    answer = (F.when(n == 0, F.col("sent")).when(n == 1, F.replace("sent", F.lit(t[1]), F.lit(""))).when(n == 2, F.concat(F.lit(t[0]), "sent")).when(n == 3, swap)
              .when(n == 4, F.concat("sent", F.lit(t[5]))).when(n == 5, F.lit("")).when(n == 6, german))
    back = docs.select("doc_id", segments.restore(F.col("piece"), answer).alias("r"))  # computed once: neither field of r repeats it
    return back.select("doc_id", "r.error", "r.text")


def _loud(texts: list[str], lang: str) -> list[tuple[str, bool]]:
    """A client that answers in capitals, loses the tokens of texts with QZAPQ, and gives back what has QNOQ, as not translated."""
    out = []
    for t in texts:
        if "QNOQ" in t:
            out.append((t, False))
        else:
            out.append((re.sub("XHTML[0-9]{4}X", "", t).upper() if "QZAPQ" in t else t.upper(), True))
    return out


@query("translated_segments", f"""WITH t AS (SELECT doc_id, source, doc_id % 4 AS n, {_PLAIN_SQL} AS p FROM documents)
SELECT doc_id, '# PLAIN WORDS OF ' || upper(p) || chr(10) || CASE n
    WHEN 0 THEN '| FIRST `cell a` OF MANY | ' || upper(source) || ' |' WHEN 1 THEN '- QZAPQ LOWER WORDS `code` MORE OF THEM *HERE* END'
    WHEN 2 THEN '> the whole line has QNOQ and **bold** words that fail' ELSE '[LINK](/d/' || doc_id || '/) WITH QZAPQ &amp; Q' || upper(source) END || chr(10) || '```' || chr(10) || 'code stays' || chr(10) || '```' || chr(10) || 'QNOQ name' AS text,
  CASE n WHEN 2 THEN 'untranslated: the whole line has QNOQ and' ELSE '' END AS errors FROM t""")
def translated_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens first, fragments where they are lost, prose that comes back untranslated as an error, names as they are."""
    n = F.col("doc_id") % 4
    line = (F.when(n == 0, _cat("| First `cell a` of many | ", F.col("source"), " |")).when(n == 1, "- QZAPQ lower words `code` more of them *here* end")
            .when(n == 2, "> the whole line has QNOQ and **bold** words that fail").otherwise(_cat("[link](/d/", F.col("doc_id"), "/) with QZAPQ &amp; q", F.col("source"))))
    body = _cat("# Plain words of ", F.col("plain"), "\n", line, "\n```\ncode stays\n```\nQNOQ name")
    out = segments.translate(_docs(spark, sf_dir).select("doc_id", body.alias("text")), "doc_id", "text", _loud, "xx")
    return out.select("doc_id", "text", F.array_join("errors", ",").alias("errors"))


# fields --------------------------------------------------------------------------------------------


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """customers with their orders as one JSON: an object of a name, an array of objects, an empty one of each kind, and one whose keys are in no order."""
    c = F.col
    one = F.struct(c("o_orderkey").alias("key"), c("o_orderstatus").alias("status"), F.struct(c("o_orderdate").cast("string").alias("text"), F.array(c("o_orderpriority"), F.lit("x")).alias("tags")).alias("note"), (c("o_orderkey") % 2 == 0).alias("even"))
    own = table(spark, sf_dir, "orders").groupBy(c("o_custkey").alias("k")).agg(F.array_sort(F.collect_list(one)).alias("orders"))
    rows = table(spark, sf_dir, "customer").join(own, c("c_custkey") == c("k"), "left")
    empty = F.expr("cast(array() as array<string>)")
    return rows.select(c("c_custkey").alias("k"), F.to_json(F.struct(c("c_name").alias("name"), F.struct(F.lit("z").alias("z"), F.lit(1).alias("a"), empty.alias("none")).alias("more"), "orders", c("c_mktsegment").alias("comment")), {"ignoreNullFields": "false"}).alias("data"))


_ORDER = """CASE WHEN o_orderkey IS NULL THEN NULL ELSE '{"key":' || o_orderkey || ',"status":' || to_json(CASE WHEN k % 3 = 0 AND r = 1 THEN 'new "' || o_orderkey || '"' ELSE o_orderstatus END) || ',"note":{"text":' || to_json(CAST(o_orderdate AS VARCHAR))
  || ',"tags":[' || to_json(o_orderpriority) || ',' || to_json(CASE WHEN r = 2 THEN 'tag' ELSE 'x' END) || ']},"even":' || (o_orderkey % 2 = 0) || '}' END"""


@query("changed_leaves", f"""WITH o AS (SELECT c_custkey AS k, c_name, c_mktsegment, o_orderkey, o_orderstatus, o_orderdate, o_orderpriority, row_number() OVER (PARTITION BY c_custkey ORDER BY o_orderkey) AS r FROM customer LEFT JOIN orders ON o_custkey = c_custkey),
g AS (SELECT k, any_value(c_name) AS name, any_value(c_mktsegment) AS comment, string_agg({_ORDER}, ',' ORDER BY r) AS list FROM o GROUP BY k)
SELECT k, '{{"name":' || to_json(CASE WHEN k % 2 = 0 THEN 'N' || k ELSE name END) || ',"more":{{"z":"z","a":1,"none":[]}},"orders":' || coalesce('[' || list || ']', 'null') || ',"comment":' || to_json(comment) || '}}' AS data,
  array_to_string(list_sort(list_filter(['gone.x', 'more.a', 'more.none', CASE WHEN k % 3 = 0 AND list IS NULL THEN 'orders[0].status' END, CASE WHEN (SELECT count(*) FROM orders WHERE o_custkey = k) < 2 THEN 'orders[1].note.tags[1]' END], lambda x: x IS NOT NULL)), ',') AS missing FROM g""")
def changed_leaves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings set at their paths in nested customers; numbers, empty containers and paths that lead nowhere change nothing."""
    c = F.col
    rows = _orders(spark, sf_dir)
    first = F.get(F.from_json("data", "orders array<struct<key:long>>")["orders"], 0)["key"]
    edit = lambda path, text: F.struct(F.lit(path).alias("path"), text.alias("text"))
    wanted = F.array(
        edit("gone.x", F.lit("a")), edit("more.a", F.lit("b")), edit("more.none", F.lit("c")), edit("orders[1].note.tags[1]", F.lit("tag")),
        F.when(c("k") % 2 == 0, edit("name", _cat("N", c("k")))), F.when(c("k") % 3 == 0, edit("orders[0].status", F.coalesce(_cat('new "', first, '"'), F.lit("none")))))
    edits = rows.select("k", F.explode(F.array_compact(wanted)).alias("e")).select("k", "e.*")
    out = nested.set_leaves(rows, "k", "data", edits)
    return out.select("k", "data", F.array_join("missing", ",").alias("missing"))


@query("translated_pages", f"""WITH t AS (SELECT doc_id, doc_id % 3 AS n, source, {_PLAIN_SQL} AS p, regexp_extract({_PLAIN_SQL}, '^ *') AS l, regexp_extract({_PLAIN_SQL}, ' *$') AS r FROM documents)
SELECT doc_id, 'TITLE OF *' || upper(source) || '*' AS title, CASE WHEN n > 0 THEN 'SOME WORDS OF IT' END AS description,
  CASE n WHEN 2 THEN 'no JSON' ELSE '{{"lead":"WORDS IN IT {{{{ v }}}} ' || upper(source) || ' END","slug":"some words","items":[{{"label_key":"Some Key Words","text":"First Things ' || doc_id || '"}},{{"text":"MORE WORDS HERE"}}],"n":' || doc_id || ',"url":"Words Of It"}}' END AS extra,
  CASE WHEN n = 1 THEN '# HEAD' || chr(10) || chr(10) || 'QNOQ these words are not translated' ELSE 'BODY ' || upper(p) END AS body, CASE n WHEN 1 THEN 'untranslated: QNOQ these words are not translated' ELSE '' END AS errors FROM t""".replace("First Things", "FIRST THINGS"))
def translated_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All fields of pages, with copy inside of nested data; keys and values that are no copy stay, as does data that is none."""
    c = F.col
    n = c("doc_id") % 3
    items = F.array(F.struct(F.lit("Some Key Words").alias("label_key"), _cat("First things ", c("doc_id")).alias("text")), F.struct(F.lit(None).cast("string").alias("label_key"), F.lit("More words here").alias("text")))
    extra = F.to_json(F.struct(_cat("Words in it {{ v }} ", c("source"), " end").alias("lead"), F.lit("some words").alias("slug"), items.alias("items"), c("doc_id").alias("n"), F.lit("Words Of It").alias("url")))
    pages = _docs(spark, sf_dir).select(
        "doc_id", _cat("Title of *", c("source"), "*").alias("title"), F.when(n > 0, "Some words of it").alias("description"), F.when(n == 2, "no JSON").otherwise(extra).alias("extra"),
        F.when(n == 1, "# Head\n\nQNOQ these words are not translated").otherwise(_cat("Body ", c("plain"))).alias("body"))
    out = headers.translate_pages(pages, "doc_id", _loud, "xx")
    return out.select("doc_id", "title", "description", "extra", "body", F.array_join("errors", ",").alias("errors"))


# headers ---------------------------------------------------------------------------------------------------


@query("hash_lines", """WITH t AS (SELECT doc_id, doc_id % 7 AS n, 'h' || doc_id AS h, coalesce(text, '') AS b, chr(10) AS e, chr(13) || chr(10) AS w FROM documents)
SELECT doc_id, CASE n WHEN 0 THEN '+++' || e || 'title = "A"' || e || '[extra]' || e || 'source_hash = "' || h || '"' || e || '+++' || e || b
  WHEN 1 THEN '+++' || e || '[extra]' || e || 'a = 1' || e || 'source_hash = "' || h || '"' || e || 'b = 2' || e || '+++' || e || b || e || 'source_hash = "body"'
  WHEN 2 THEN ' +++ ' || e || '[ extra ]' || e || 'source_hash = "' || h || '"' || e || 'a = 1' || e || '[extra.deep]' || e || 'source_hash = "deep"' || e || '+++' || e || b
  WHEN 3 THEN '+++' || w || '[extra]' || w || 'source_hash = "' || h || '"' || w || 'a = 1' || w || '+++' || w || b
  WHEN 4 THEN '+++' || e || '[extra]' || e || 'a = 1' || e || '+++' || e || b
  WHEN 5 THEN '+++' || e || 'title = "source_hash"' || e || '+++' || e || b END AS text FROM t""")
def hash_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hash replaced, added or removed in headers of several kinds; the body and line ends stay as they are."""
    n, body = F.col("doc_id") % 7, F.coalesce("text", F.lit(""))
    old = (F.when(n == 0, _cat('+++\ntitle = "A"\n+++\n', body)).when(n == 1, _cat('+++\n[extra]\na = 1\nsource_hash="old"\nb = 2\n+++\n', body, '\nsource_hash = "body"'))
           .when(n == 2, _cat(' +++ \n[ extra ]\na = 1\n[extra.deep]\nsource_hash = "deep"\n+++\n', body)).when(n == 3, _cat("+++\r\n[extra]\r\na = 1\r\n+++\r\n", body))
           .when(n == 4, _cat('+++\n[extra]\nsource_hash = "old"\na = 1\n+++\n', body)).when(n == 5, _cat('+++\ntitle = "source_hash"\n+++\n', body)).otherwise(_cat("+++\nno end\n", F.regexp_replace(body, r"\+", " "))))
    hash_ = F.when((n < 4) | (n == 6), _cat("h", F.col("doc_id")))
    return table(spark, sf_dir, "documents").select("doc_id", headers.rewrite_hash(old, hash_).alias("text"))


@query("written_siblings", f"""WITH t AS (SELECT doc_id, lang, 'h' || doc_id AS h, doc_id % 4 AS n, regexp_replace(coalesce(text, ''), '[ \t\r\n]+$', '') AS b, chr(10) AS e FROM documents)
SELECT doc_id, lang, CASE WHEN n <> 3 THEN '+++' || e || CASE WHEN n = 1 THEN '' ELSE 'title = "Titel \\"' || doc_id || '\\""' || e END || 'path = "/' || lang || '/p/' || doc_id || '"' || e || 'weight = ' || doc_id || e
  || CASE WHEN n = 1 THEN 'title = "Titel \\"' || doc_id || '\\""' || e ELSE '' END || CASE WHEN n = 2 THEN 'description = "neu"' || e ELSE '' END
  || e || '[extra]' || e || 'lead = "vorne"' || e || 'list = ["eins", "two"]' || e || CASE WHEN n = 0 THEN 'noindex = true' || e ELSE '' END || 'source_hash = "' || h || '"' || e || e || '[extra.deep]' || e || '"a b" = "tief"' || e || 'n = 1.5' || e || '+++' || e || e || b || e END AS text,
  CASE WHEN n = 3 THEN 'extra.gone' ELSE '' END AS missing FROM t""")
def written_siblings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of translations: the page's header with what is translated, the sibling's own entries and the page's hash."""
    c = F.col
    k, n = c("doc_id"), c("doc_id") % 4
    docs = table(spark, sf_dir, "documents")
    head = F.to_json(F.struct(
        F.when(n != 1, "Title").alias("title"), _cat("/p/", k).alias("path"), F.array(F.lit("/old/"), F.lit("/older/")).alias("aliases"), k.alias("weight"),
        F.struct(F.lit("front").alias("lead"), F.struct(F.lit("deep").alias("a b"), F.lit(1.5).alias("n")).alias("deep"), F.array(F.lit("one"), F.lit("two")).alias("list"), F.lit("old").alias("source_hash")).alias("extra")))
    edit = lambda path, text: F.struct(F.lit(path).alias("path"), F.lit(text).alias("text"))
    edits = F.array_compact(F.array(edit("lead", "vorne"), edit("deep.a b", "tief"), edit("list[0]", "eins"), F.when(n == 3, edit("gone", "weg"))))
    done = docs.select("doc_id", "lang", _cat('Titel "', k, '"').alias("title"), F.when(n == 2, "neu").otherwise("").alias("description"), c("text").alias("body"), edits.alias("extra"))
    there = docs.where("doc_id % 4 = 0").select("doc_id", "lang", F.lit('{"title":"alt","draft":true,"extra":{"lead":"alt","noindex":true,"source_hash":"older"}}').alias("header"))
    out = headers.write_siblings(docs.select("doc_id", head.alias("header"), _cat("h", k).alias("hash")), done, there, "doc_id")
    return out.select("doc_id", "lang", "text", F.array_join("missing", ",").alias("missing"))


@query("sibling_texts", """SELECT doc_id, lang, CASE doc_id % 5 WHEN 1 THEN 'missing extra.items[1].text' WHEN 2 THEN 'missing extra.z_lead' WHEN 3 THEN 'missing extra.z_lead' END AS error,
  CASE WHEN doc_id % 5 IN (0, 4) THEN 'z_lead=Vorn ' || source || ';items[0].text=Eins;items[1].text=Zwei;a.deep=Tief' END AS texts FROM documents UNION ALL SELECT doc_id, 'xx', NULL, '' FROM documents WHERE doc_id < 0""")
def sibling_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sibling's strings at its page's paths, in the page's order; the first one that it lacks is the error."""
    n = F.col("doc_id") % 5
    docs = table(spark, sf_dir, "documents")
    page = docs.select("doc_id", F.lit('{"z_lead":"Front words","slug":"x-y","items":[{"text":"One"},{"text":"Two","n":3}],"a":{"deep":"Deep down"}}').alias("extra"))
    own = (F.when(n == 1, _cat('{"z_lead":"Vorn","items":[{"text":"Eins"}],"a":{}}')).when(n == 2, '{"items":[{"text":"Eins"},{"text":"Zwei"}]}').when(n == 3, "no JSON")
           .otherwise(_cat('{"items":[{"text":"Eins"},{"text":"Zwei"}],"a":{"deep":"Tief"},"more":"own","z_lead":"Vorn ', F.col("source"), '"}')))
    out = headers.sibling_texts(page, docs.select("doc_id", "lang", own.alias("extra")), "doc_id")
    return out.select("doc_id", "lang", "error", F.array_join(F.transform("texts", lambda t: F.concat(t["path"], F.lit("="), t["text"])), ";").alias("texts"))


# configurations ---------------------------------------------------------------------------------------------


@query("merged_configs", """SELECT c_custkey AS k, CASE c_custkey % 5 WHEN 3 THEN NULL WHEN 4 THEN NULL ELSE '{"base":"https://' || c_custkey || '.org","extra":{"color":"own","deep":{"a":1,"b":[3],"c":"' || c_mktsegment || '"}' || CASE WHEN c_custkey % 5 = 1 THEN ',"menu":{"home":"/"}' ELSE '' END
    || '},"list":["own"]' || CASE WHEN c_custkey % 5 = 2 THEN ',"menu":{"home":"/"}' ELSE '' END || ',"title":"T"}' END AS data,
  CASE c_custkey % 5 WHEN 3 THEN 'extra.deep' WHEN 4 THEN 'menu' ELSE '' END AS clashes FROM customer UNION ALL SELECT -s_suppkey - 1, '{"only":' || s_suppkey || '}', '' FROM supplier""")
def merged_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A site's own settings over its theme's: the first one wins entry by entry, and a table against a value is a clash."""
    c = F.col
    n, rows = c("c_custkey") % 5, table(spark, sf_dir, "customer")
    own = _cat('{"title":"T","base":"https://', c("c_custkey"), '.org","list":["own"],"extra":{"color":"own","deep":', F.when(n == 3, "1").otherwise('{"a":1}'), F.when(n == 1, ',"menu":{}').otherwise(""), "}", F.when(n == 2, ',"menu":{}').when(n == 4, ',"menu":"home"').otherwise(""), "}")
    theme = _cat('{"extra":{"deep":{"c":"', c("c_mktsegment"), '","b":[3],"a":2},"color":"theme"', F.when(n == 1, ',"menu":{"home":"/"}').otherwise(""), '},"list":["theme"],"title":"no"', F.when((n == 2) | (n == 4), ',"menu":{"home":"/"}').otherwise(""), "}")
    alone = table(spark, sf_dir, "supplier").select((-c("s_suppkey") - 1).alias("k"), _cat('{"only":', c("s_suppkey"), "}").alias("data"))
    merged = nested.merge(rows.select(c("c_custkey").alias("k"), own.alias("data")).unionByName(alone), rows.select(c("c_custkey").alias("k"), theme.alias("data")), "k", "data")
    return merged.select("k", "data", F.array_join("clashes", ",").alias("clashes"))
