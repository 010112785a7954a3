"""Nested data as rows: JSON texts taken apart level by level, changed at their leaves, and put together again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import once
from .shared import join_shuffled, materialize

STEP = "struct<pos:int,name:string>"
#: Levels of nested data that are opened in one pass.
LEVELS = 8
#: Into so many maps a row's edits are dealt, as a map is searched entry by entry.
SLOTS = 256


def quoted(text: Column) -> Column:
    """A string as JSON; null for null."""
    # the quote before the last brace ends what is trimmed
    return F.when(text.isNotNull(), F.substring(F.rtrim(F.to_json(F.struct(text.alias("v"))), F.lit("}")), 6, 2**31 - 1))


def unquoted(value: Column) -> Column:
    """The string of a JSON string."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]


def path_text(steps: Column) -> Column:
    """`a.b[2].c` of steps; entries of arrays have no name."""
    part = F.transform(steps, lambda s, i: F.when(s["name"].isNull(), F.concat(F.lit("["), s["pos"].cast("string"), F.lit("]"))).otherwise(F.concat(F.when(i > 0, ".").otherwise(""), s["name"])))
    return F.array_join(part, "")


def _kind(value: Column) -> Column:
    return F.when(value.startswith("{"), "object").when(value.startswith("["), "array").when(value.startswith('"'), "string").otherwise("other")


def _root(data: str) -> Column:
    """The JSON of a row; null where it is null or none."""
    return F.when(F.try_parse_json(data).isNotNull(), F.trim(data))


def _may_open(value: Column) -> Column:
    """Whether there may be something in a value; cheap, for every leaf is asked on every level."""
    return (value.startswith("{") & (value != "{}")) | (value.startswith("[") & (value != "[]"))


def _entries(value: Column, into_arrays: bool = True) -> Column:
    """(name, value) of what stands in an object or array, in the order of the text; null for a leaf, which what is empty is too."""
    inside = lambda v, kind: F.try_variant_get(v, "$", kind).isNotNull()
    # texts inside, and beside each what it is: the texts alone do not tell a string from a number
    container = lambda text, v: F.when(text.startswith("{"), inside(v, "map<string,variant>")).when(text.startswith("["), inside(v, "array<variant>")).otherwise(False)
    json = lambda text, v: F.when(container(text, v), text).otherwise(F.coalesce(F.to_json(v), F.lit("null")))
    entry = lambda name, text, v: F.struct(name.alias("name"), json(text, v).alias("value"))
    named = F.zip_with(F.map_entries(F.from_json(value, "map<string,string>")), F.map_values(F.from_json(value, "map<string,variant>")), lambda e, v: entry(e["key"], e["value"], v))
    found = F.when(value.startswith("{"), named)
    if into_arrays:
        found = found.otherwise(F.zip_with(F.from_json(value, "array<string>"), F.from_json(value, "array<variant>"), lambda e, v: entry(F.lit(None).cast("string"), e, v)))
    return F.when(_may_open(value), F.get(F.filter(F.array(found), lambda e: F.size(e) > 0), 0))


def take_apart(rows: DataFrame, key: str, data: str, into_arrays: bool = True) -> DataFrame:
    """(key, steps, path, kind, value) of every leaf of a JSON column: scalars, and objects and arrays without entries; whole arrays where these are not taken apart.

    steps: array of (pos, name) from the root, pos from 0 in the order of the text, name
    null in arrays. kind: string, other, object or array; value: the leaf as JSON. Objects
    keep their order: each level is read as a map of the texts inside. Rows whose data are
    null or no JSON have no leaf.

    A level is one explode, through which leaves pass as they are. LEVELS of them run in one
    pass over the rows, dealt by their keys; only what is deeper is written and goes on.
    """
    c = F.col
    level = rows.select(c(key), F.expr(f"cast(array() as array<{STEP}>)").alias("steps"), c(data).alias("value")).where("value IS NOT NULL")
    # a fixed number of parts: these rows are small, but not what comes out of them
    level = level.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), c(key))
    level = level.withColumn("value", _root(data="value")).where("value IS NOT NULL")
    below = F.transform(_entries(c("value"), into_arrays), lambda e, i: F.struct(F.array_append("steps", F.struct(i.alias("pos"), e["name"].alias("name"))).alias("steps"), e["value"].alias("value")))
    opens = _may_open(c("value")) if into_arrays else _may_open(c("value")) & c("value").startswith("{")
    found: DataFrame | None = None
    while True:
        for _ in range(LEVELS):
            entries = F.when(opens, below)
            level = level.select(key, F.explode(F.coalesce(entries, F.array(F.struct("steps", "value")))).alias("e")).select(key, "e.steps", "e.value")
        level = level.withColumn("open", F.when(opens, _entries(c("value"), into_arrays).isNotNull()).otherwise(False))
        level = materialize(level.select(key, "steps", F.when(~c("open"), path_text(c("steps"))).alias("path"), F.when(~c("open"), _kind(c("value"))).alias("kind"), "value"), "leaves")
        done = level.where("kind IS NOT NULL")
        found = done if found is None else found.unionByName(done)
        level = level.where("kind IS NULL").select(key, "steps", "value")
        if level.isEmpty():
            return found


def put_together(leaves: DataFrame, key: str, out: str = "data", *, name: Callable[[Column], Column] = quoted, colon: str = ":", comma: str = ",") -> DataFrame:
    """(key, out): the JSON of each key's leaves (steps, value), in the order of their places; other formats by how they write names and marks.

    From the deepest level up, the entries of each object or array meet in one row. So a
    level costs a shuffle of what stands on it, and nothing is larger than a row's own JSON.
    """
    c = F.col
    rows = leaves.select(key, "steps", "value")
    depth = rows.agg(F.max(F.size("steps"))).first()[0] or 0
    above = rows.where(F.size("steps") == depth)
    for n in range(depth, 0, -1):
        last = F.element_at("steps", -1)
        entry = F.struct(last["pos"].alias("pos"), last["name"].alias("name"), c("value").alias("value"))
        groups = above.groupBy(c(key), F.slice("steps", 1, n - 1).alias("steps")).agg(F.array_sort(F.collect_list(entry)).alias("e"))
        listed = F.concat(F.lit("["), F.array_join(F.transform("e", lambda x: x["value"]), comma), F.lit("]"))
        named = F.concat(F.lit("{"), F.array_join(F.transform("e", lambda x: F.concat(name(x["name"]), F.lit(colon), x["value"])), comma), F.lit("}"))
        built = groups.select(key, "steps", F.when(F.get("e", 0)["name"].isNull(), listed).otherwise(named).alias("value"))
        above = built.unionByName(rows.where(F.size("steps") == n - 1))
    return above.select(key, c("value").alias(out))


def _opened(piece: Column) -> Column:
    """The pieces of what stands in a piece's object or array; null for a leaf."""

    def one(e, i, last):
        named, above = e["name"].isNotNull(), piece["path"]
        start = F.when(i > 0, ",").otherwise(F.concat(piece["before"], F.when(named, "{").otherwise("[")))
        end = F.when(i == last, F.concat(F.when(named, "}").otherwise("]"), piece["after"])).otherwise("")
        step = F.when(named, F.concat(F.when(above.isNull(), "").otherwise("."), e["name"])).otherwise(F.concat(F.lit("["), i.cast("string"), F.lit("]")))
        name = F.when(named, F.concat(quoted(e["name"]), F.lit(":"))).otherwise("")
        return F.struct(F.concat(start, name).alias("before"), F.concat(F.coalesce(above, F.lit("")), step).alias("path"), e["value"].alias("value"), end.alias("after"))

    return once(_entries(piece["value"]), lambda list_: F.transform(list_, lambda e, i: one(e, i, F.size(list_) - 1)))


def set_leaves(rows: DataFrame, key: str, data: str, edits: DataFrame) -> DataFrame:
    """(key, data, missing) of rows with distinct keys: data with the strings at edits' paths (key, path, text) replaced.

    Only what is a string is replaced: a path that leads nowhere or to something else changes
    nothing and is listed in missing, sorted. Everything else, the order of objects and
    arrays included, stays. Data that are null or no JSON stay, and all their paths are missing.

    A row meets its edits once and is changed where it stands, so no leaf is shuffled. In it, a
    list of pieces is opened level by level: each has the text before it and after it, its
    path and its value. Only what edits lead into is opened, LEVELS in one pass; rows in which
    they lead deeper go on.
    """
    c = F.col
    slot = lambda path: F.pmod(F.hash(path), F.lit(SLOTS))
    parts = F.split("path", r"(?=[.\[])")
    told = F.array_append(F.transform(parts, lambda _, i: F.struct(F.array_join(F.slice(parts, 1, i), "").alias("path"), F.lit(None).alias("text"), F.lit(False).alias("own"))), F.struct("path", "text", F.lit(True).alias("own")))
    told = edits.where("path IS NOT NULL").select(key, F.explode(told).alias("e")).groupBy(key, c("e.path").alias("path")).agg(F.max("e.text").alias("text"), F.max("e.own").alias("own"), F.min("e.own").alias("last"))
    lists = told.groupBy(key).agg(F.collect_list(F.struct(slot(c("path")).alias("slot"), "path", F.struct("text", "own", (~c("last")).alias("above")).alias("told"))).alias("list"))
    of = lambda n: F.map_from_entries(F.transform(F.filter("list", lambda e: e["slot"] == n), lambda e: F.struct(e["path"], e["told"])))
    dealt = F.map_from_entries(F.transform(F.array_distinct(F.transform("list", lambda e: e["slot"])), lambda n: F.struct(n, of(n))))
    own = F.transform(F.filter("list", lambda e: e["told"]["own"]), lambda e: e["path"])
    nothing = F.expr("cast(array() as array<string>)")
    # the path of the root is null, as that of an entry without a name is empty
    root = F.struct(F.lit("").alias("before"), F.lit(None).cast("string").alias("path"), c("value").alias("value"), F.lit("").alias("after"))
    level = join_shuffled(rows.select(key, data), lists.select(key, dealt.alias("edits"), own.alias("own")), key, "left").select(key, data, "edits", "own", _root(data).alias("value"))
    level = level.select(key, data, "edits", "own", F.when(c("value").isNotNull(), F.array(root)).alias("pieces"))
    at = lambda p: F.coalesce(p["path"], F.lit(""))
    of_piece = lambda p: F.element_at(F.element_at("edits", slot(at(p))), at(p))
    string = lambda p: p["value"].startswith('"')
    leads_in = lambda p: F.when(_may_open(p["value"]), of_piece(p)["above"])
    whole = F.array_join(F.transform("pieces", lambda p: F.concat(p["before"], F.coalesce(F.when(string(p), once(of_piece(p)["text"], quoted)), p["value"]), p["after"])), "")
    there = F.coalesce(F.transform(F.filter("pieces", string), at), nothing)
    found: DataFrame | None = None
    while True:
        for _ in range(LEVELS):
            level = level.withColumn("pieces", F.flatten(F.transform("pieces", lambda p: F.when(leads_in(p), F.coalesce(_opened(p), F.array(p))).otherwise(F.array(p)))))
        level = level.withColumn("open", F.coalesce(F.exists("pieces", lambda p: F.when(leads_in(p), _entries(p["value"]).isNotNull())), F.lit(False)))
        ready = lambda x: F.when(~c("open"), x)
        missing = F.array_sort(F.array_except("own", there))
        level = materialize(level.select(key, "open", ready(F.coalesce(whole, data)).alias("new"), ready(F.coalesce(missing, nothing)).alias("missing"), *[F.when(c("open"), c(x)).alias(x) for x in (data, "edits", "own", "pieces")]), "set-leaves")
        done = level.where("NOT open").select(key, c("new").alias(data), "missing")
        found = done if found is None else found.unionByName(done)
        level = level.where("open").select(key, data, "edits", "own", "pieces")
        if level.isEmpty():
            return found


def merge(first: DataFrame, second: DataFrame, key: str, data: str) -> DataFrame:
    """(key, data, clashes) of two tables of JSON objects: entries of both at any depth, the first one's where both have one; names are sorted.

    Arrays are values. Where one side has an object and the other a value, the path is named
    in clashes, and data is null. A key of one side alone keeps its object. Data that are no
    object have no entries.

    Both sides are taken apart together, and what stands at a path meets in one grouping:
    no side is small, so none is ever sent to the driver for a join.
    """
    c = F.col
    sided = lambda rows, n: rows.select(F.struct(F.lit(n).alias("side"), c(key).alias("key")).alias("of"), data)
    apart = take_apart(sided(first, 0).unionByName(sided(second, 1)), "of", data, into_arrays=False).where(F.size("steps") > 0)
    names = F.transform("steps", lambda s: s["name"])
    leaves = apart.select("of", names.alias("names"), (c("kind") == "object").alias("empty"), "value")
    inner = leaves.where(F.size("names") > 1).select("of", F.explode(F.transform(F.sequence(F.lit(1), F.size("names") - 1), lambda n: F.slice("names", 1, n))).alias("names")).distinct()
    rows = leaves.unionByName(inner, allowMissingColumns=True)  # a table that has entries has no value of its own
    of = lambda n, x: F.max(F.when(c("of.side") == n, x))
    met = rows.groupBy(c("of.key").alias("key"), "names").agg(*[a for n in (0, 1) for a in (of(n, c("value")).alias(f"value{n}"), of(n, c("empty")).alias(f"empty{n}"), of(n, c("value").isNull()).alias(f"inner{n}"))])
    has = lambda x: F.coalesce(c(x), F.lit(False))
    table = [has(f"empty{n}") | has(f"inner{n}") for n in (0, 1)]
    plain = [~F.coalesce(c(f"empty{n}"), F.lit(True)) for n in (0, 1)]
    clash = (plain[0] & table[1]) | (plain[1] & table[0])
    # an object without entries is one no more where the other side has some
    value = F.coalesce(*[F.when(~(has(f"empty{n}") & has(f"inner{1 - n}")), c(f"value{n}")) for n in (0, 1)])
    met = materialize(met.select("key", "names", value.alias("value"), clash.alias("clash")), "merged")
    steps = F.transform("names", lambda n: F.struct(F.lit(0).alias("pos"), n.alias("name")))
    built = put_together(met.where("value IS NOT NULL").select("key", steps.alias("steps"), "value"), "key")
    paths = met.where("clash").groupBy("key").agg(F.array_sort(F.collect_set(F.array_join("names", "."))).alias("clashes"))
    every = first.select(c(key).alias("key")).unionByName(second.select(c(key).alias("key")))
    whole = built.unionByName(paths, allowMissingColumns=True).unionByName(every, allowMissingColumns=True).groupBy("key").agg(F.max("data").alias("data"), F.max("clashes").alias("clashes"))
    return whole.select(c("key").alias(key), F.when(c("clashes").isNull(), F.coalesce("data", F.lit("{}"))).alias(data), F.coalesce("clashes", F.expr("cast(array() as array<string>)")).alias("clashes"))
