"""Headers of translated pages: the hash line edited in place, and whole siblings written from the page they translate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import SPACE, trim_all
from ..sources import nested
from ..sources.data import data_key, is_copy, skipped_key
from ..sources.shared import join_shuffled, materialize
from . import segments

FENCE = "+++"
#: The key that holds a sibling's source hash, in the table `extra`.
HASH = "source_hash"
#: Places of what is added, after everything that is there.
LATE = 1 << 30


def rewrite_hash(text: Column, hash_: Column) -> Column:
    """A file's text whose header has this source hash under [extra], or none where it is null; every other byte stays.

    The line is replaced where it is there, added below [extra] where that is there, else
    [extra] is added at the header's end. A table below extra is another table. Null
    without a header between two fences.
    """
    lines = F.split(text, "(?<=\n)")
    state = "struct<own:boolean,head:int,line:int,i:int>"

    def step(acc, x):
        bare = trim_all(x)
        table = bare.startswith("[")
        own = F.when(table, trim_all(F.regexp_replace(bare, r"^\[+|\]+$", "")) == "extra").otherwise(acc["own"])
        named = trim_all(F.get(F.split(bare, "="), 0)) == HASH
        return F.struct(
            own.alias("own"), F.when(table & own, acc["i"]).otherwise(acc["head"]).alias("head"),
            F.when(~table & acc["own"] & named, acc["i"]).otherwise(acc["line"]).alias("line"), (acc["i"] + 1).alias("i")).cast(state)

    start = F.struct(F.lit(False).alias("own"), F.lit(None).cast("int").alias("head"), F.lit(None).cast("int").alias("line"), F.lit(1).alias("i")).cast(state)
    close = lambda x: F.when(trim_all(F.get(x, 0)) == FENCE, F.array_position(F.transform(F.slice(x, 2, F.size(x)), lambda y: trim_all(y) == FENCE), True).cast("int"))
    # each step of this chain finds something once a text
    found = F.transform(F.array(lines), lambda x: F.struct(x.alias("x"), close(x).alias("close"), F.when(F.get(x, 0).endswith("\r\n"), "\r\n").otherwise("\n").alias("eol")))
    read = F.transform(found, lambda f: f.withField("s", F.when(f["close"] > 0, F.aggregate(F.slice(f["x"], 2, f["close"] - 1), start, step))))

    def written(f):
        x, s, n = f["x"], f["s"], F.size(f["x"])
        line = F.concat(F.lit(f'{HASH} = "'), hash_, F.lit('"'), f["eol"])
        after = lambda k, *more: F.concat(F.slice(x, 1, k), F.array(*more), F.slice(x, k + 1, n))
        out = (F.when(s["line"].isNotNull() & hash_.isNotNull(), F.transform(x, lambda y, i: F.when(i == s["line"], line).otherwise(y)))
               .when(s["line"].isNotNull(), F.filter(x, lambda y, i: i != s["line"])).when(hash_.isNull(), x)
               .when(s["head"].isNotNull(), after(s["head"] + 1, line)).otherwise(after(f["close"], F.concat(F.lit("[extra]"), f["eol"], line))))
        return F.when(f["close"] > 0, F.array_join(out, ""))

    return F.get(F.transform(read, written), 0)


def _toml_name(name: Column) -> Column:
    return F.when(name.rlike("^[A-Za-z0-9_-]+$"), name).otherwise(nested.quoted(name))


def toml_text(leaves: DataFrame, key: str, out: str = "toml") -> DataFrame:
    """(key, out): leaves (steps, kind, value) as TOML, values of a table before the tables inside it; arrays in line. Nulls, which TOML has not, are left out."""
    c = F.col
    live = leaves.where("value <> 'null'")
    listed = F.exists("steps", lambda s: s["name"].isNull())
    first = F.array_position(F.transform("steps", lambda s: s["name"].isNull()), True).cast("int")
    arrays = live.where(listed).select(F.struct(c(key).alias("key"), F.slice("steps", 1, first - 1).alias("steps")).alias("node"), F.slice("steps", first, F.size("steps")).alias("steps"), "value")
    inline = nested.put_together(arrays, "node", "value", name=_toml_name, colon=" = ", comma=", ").select(c("node.key").alias(key), c("node.steps").alias("steps"), "value")
    flat = live.where(~listed & (c("kind") != "object")).select(key, "steps", "value").unionByName(inline)
    line = F.concat(_toml_name(F.element_at("steps", -1)["name"]), F.lit(" = "), c("value"), F.lit("\n"))
    above = F.slice("steps", 1, F.size("steps") - 1)
    lines = flat.select(key, above.alias("above"), F.struct(F.element_at("steps", -1)["pos"].alias("pos"), line.alias("line")).alias("l"))
    empty = live.where(~listed & (c("kind") == "object")).select(key, c("steps").alias("above"), F.lit(None).cast("struct<pos:int,line:string>").alias("l"))
    names = F.transform("above", lambda s: s["name"])
    tables = lines.unionByName(empty).groupBy(c(key), names.alias("names")).agg(F.min(F.transform("above", lambda s: s["pos"])).alias("at"), F.array_sort(F.collect_list("l")).alias("l"))
    head = F.when(F.size("names") > 0, F.concat(F.lit("\n["), F.array_join(F.transform("names", _toml_name), "."), F.lit("]\n"))).otherwise("")
    texts = tables.select(key, F.struct("at", "names", F.concat(head, F.array_join(F.transform("l", lambda x: x["line"]), "")).alias("text")).alias("t"))
    return texts.groupBy(key).agg(F.ltrim(F.array_join(F.transform(F.array_sort(F.collect_list("t")), lambda t: t["text"]), ""), F.lit("\n")).alias(out))


def localized_path(path: Column, lang: Column) -> Column:
    rest = F.regexp_replace(path, "^/+", "")
    return F.concat(F.when(path.startswith("/"), "/").otherwise(""), lang, F.lit("/"), rest)


def write_siblings(pages: DataFrame, translations: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """(key, lang, text, missing): the file of each translation (key, lang, title, description, body, extra: array of (path, text)).

    pages: (key, header as JSON, hash), one row a key. A sibling has its page's header
    with the translated title, description and strings of `extra`, the path in its
    language, no aliases and the page's hash. Entries of extra at the top that only the
    existing sibling (key, lang, header as JSON) has are kept. A path of extra that has no
    string leaves text null and is named in missing. A title or description that the header
    lacks is added where it is not empty.
    """
    c = F.col
    node = F.to_json(F.struct(c(key).alias("k"), c("lang").alias("l"))).alias("node")
    work = materialize(translations.select(key, "lang", node, "title", "description", "body", "extra").join(pages.select(key, "hash"), key), "siblings")
    own = nested.take_apart(pages.select(key, "header"), key, "header")
    leaves = work.select(key, "lang", "node", "title", "description", "hash").join(own, key).where(F.get("steps", 0)["name"] != "aliases").where(c("path") != f"extra.{HASH}")
    edits = work.select("node", F.explode("extra").alias("e")).select("node", F.concat(F.lit("extra."), "e.path").alias("path"), c("e.text").alias("new"))
    edits = edits.groupBy("node", "path").agg(F.max("new").alias("new"))
    told = leaves.join(edits, ["node", "path"], "left")
    string = c("kind") == "string"
    text = (F.when((c("path") == "path") & string, localized_path(nested.unquoted(c("value")), c("lang"))).when(c("path") == "title", F.coalesce("title", F.lit(""))).when(c("path") == "description", F.coalesce("description", F.lit("")))
            .when(string, c("new")))
    set_ = told.select("node", "steps", "kind", F.coalesce(nested.quoted(text), c("value")).alias("value"))
    missing = edits.join(leaves.where(string).select("node", "path"), ["node", "path"], "left_anti").groupBy("node").agg(F.array_sort(F.collect_list("path")).alias("missing"))
    # what only the sibling has, and what is new
    second = F.get("steps", 1)["name"]
    old = nested.take_apart(existing.select(node, "header"), "node", "header").where((F.get("steps", 0)["name"] == "extra") & second.isNotNull()).withColumn("name", second).where(c("name") != HASH)
    known = leaves.where(F.get("steps", 0)["name"] == "extra").select("node", second.alias("name")).distinct()
    extra = lambda steps: F.concat(F.array(F.struct(F.lit(LATE).alias("pos"), F.lit("extra").alias("name"))), steps)
    later = F.transform(F.slice("steps", 2, F.size("steps")), lambda s, i: F.when(i == 0, s.withField("pos", s["pos"] + LATE)).otherwise(s))
    kept = old.join(known, ["node", "name"], "left_anti").join(work.select("node"), "node", "left_semi").select("node", extra(later).alias("steps"), "kind", "value")
    top = lambda k, name: F.array(F.struct(F.lit(LATE + k).alias("pos"), F.lit(name).alias("name")))
    new = lambda name, k: work.where(F.coalesce(c(name), F.lit("")) != "").join(leaves.where(c("path") == name).select("node"), "node", "left_anti").select("node", top(k, name).alias("steps"), F.lit("string").alias("kind"), nested.quoted(c(name)).alias("value"))
    stamp = work.select("node", extra(F.array(F.struct(F.lit(2**31 - 1).alias("pos"), F.lit(HASH).alias("name")))).alias("steps"), F.lit("string").alias("kind"), nested.quoted(c("hash")).alias("value"))
    # an empty table of extra is one no more
    rows = set_.where("NOT (kind = 'object' AND size(steps) = 1 AND steps[0].name = 'extra')").unionByName(kept).unionByName(new("title", 0)).unionByName(new("description", 1)).unionByName(stamp)
    toml = toml_text(materialize(rows, "sibling-headers"), "node")
    body = F.regexp_replace(F.coalesce("body", F.lit("")), f"{SPACE}+$", "")
    file = F.concat(F.lit(f"{FENCE}\n"), "toml", F.lit(f"{FENCE}\n\n"), body, F.lit("\n"))
    out = work.join(toml, "node").join(missing, "node", "left")
    return out.select(key, "lang", F.when(c("missing").isNull(), file).alias("text"), F.coalesce("missing", F.expr("cast(array() as array<string>)")).alias("missing"))


# fields ----------------------------------------------------------------------------------------------------


def fields(pages: DataFrame, key: str, extra: str = "extra") -> DataFrame:
    """(key, field, path, text, verbatim) of what is translated of a page: 0 title, 1 description, 2 copy inside extra by path, 3 body.

    extra is JSON; strings under keys that hold no copy, and strings that read as none, are
    no fields. A look-up key into other data is a field that stays as it is.
    """
    c = F.col
    plain = F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.lit(name).alias("path"), c(name).alias("text")) for n, name in ((0, "title"), (1, "description"), (3, "body"))])).alias("f")
    whole = pages.select(key, plain).select(key, "f.*").where("text IS NOT NULL").withColumn("verbatim", F.lit(False))
    inside = nested.take_apart(pages.select(key, extra), key, extra).where("kind = 'string'").where(~F.exists("steps", lambda s: skipped_key(s["name"])))
    copy = inside.select(key, F.lit(2).alias("field"), "path", nested.unquoted(c("value")).alias("text")).where(is_copy(c("text")))
    return whole.unionByName(copy.withColumn("verbatim", data_key(c("path"))))


def translate_pages(pages: DataFrame, key: str, client: segments.Client, lang: str, extra: str = "extra") -> DataFrame:
    """(key, title, description, extra, body, errors) of pages with all their fields translated and put back in their places.

    Fields travel segment by segment (segments.translate). A null field stays null; an
    extra that is no JSON stays as it is. errors holds what failed, fields in order.
    """
    c = F.col
    found = fields(pages.select(key, "title", "description", "body", extra), key, extra).withColumn("id", F.to_json(F.struct(c(key).alias("k"), c("field").alias("f"), c("path").alias("p"))))
    found = materialize(found, "fields")
    done = segments.translate(found.where("NOT verbatim").select("id", "text"), "id", "text", client, lang).select("id", c("text").alias("new"), "errors")
    told = materialize(join_shuffled(found, done, "id", "left").select(key, "field", "path", F.coalesce("new", "text").alias("text"), "errors"), "translated-fields")
    one = lambda n, name: F.max(F.when(c("field") == n, c("text"))).alias(name)
    wrong = F.flatten(F.transform(F.array_sort(F.collect_list(F.when(F.size("errors") > 0, F.struct("field", "path", "errors")))), lambda x: x["errors"])).alias("errors")
    rows = told.groupBy(key).agg(one(0, "title"), one(1, "description"), one(3, "body"), wrong)
    inside = nested.set_leaves(pages.select(key, extra), key, extra, told.where("field = 2").select(key, "path", "text")).select(key, extra)
    return join_shuffled(join_shuffled(pages.select(key), rows, key, "left"), inside, key).select(key, "title", "description", extra, "body", F.coalesce("errors", F.expr("cast(array() as array<string>)")).alias("errors"))


def sibling_texts(pages: DataFrame, siblings: DataFrame, key: str) -> DataFrame:
    """(key, lang, texts, error): what each sibling (key, lang, extra as JSON) has at the paths of its page's copy (key, extra as JSON), as array of (path, text) in the page's order.

    The first path that the sibling lacks, or where it has no string, is the error, and texts is null then.
    """
    c = F.col
    node = F.to_json(F.struct(c(key).alias("k"), c("lang").alias("l"))).alias("node")
    want = nested.take_apart(pages, key, "extra").where("kind = 'string'").where(~F.exists("steps", lambda s: skipped_key(s["name"]))).where(is_copy(nested.unquoted(c("value"))))
    want = siblings.select(key, "lang", node).join(want.select(key, "path", F.transform("steps", lambda s: s["pos"]).alias("at")), key)
    have = nested.take_apart(siblings.select(node, "extra"), "node", "extra").where("kind = 'string'").select("node", "path", nested.unquoted(c("value")).alias("text"))
    told = want.join(have, ["node", "path"], "left").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("at", "path", "text"))).alias("t"))
    first = F.get(F.filter("t", lambda t: t["text"].isNull()), 0)["path"]
    texts = F.transform("t", lambda t: F.struct(t["path"].alias("path"), t["text"].alias("text")))
    none = F.expr("cast(array() as array<struct<path:string,text:string>>)")
    out = siblings.select(key, "lang", node).join(told.select("node", F.concat(F.lit("missing extra."), first).alias("error"), texts.alias("texts")), "node", "left")
    return out.select(key, "lang", F.when(c("error").isNull(), F.coalesce("texts", none)).alias("texts"), "error")
