"""Data files: JSON, YAML, TOML, CSV, XML, BibTeX and plain text."""

from __future__ import annotations

import json
import re
import tomllib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .nested import quoted

FORMATS = ("json", "yaml", "toml", "csv", "xml", "bibtex", "plain")
ENDINGS = {"json": "json", "yaml": "yaml", "yml": "yaml", "toml": "toml", "csv": "csv", "xml": "xml", "bib": "bibtex"}
ACCEPT = {"json": "application/json", "yaml": "application/x-yaml", "toml": "application/toml", "csv": "text/csv", "xml": "text/xml", "bibtex": "application/x-bibtex", "plain": "text/plain"}


# YAML: the part of it that headers and data files use ------------------------------------------------


def _scalar(s: str):
    s = s.strip()
    if s in ("", "~", "null", "Null", "NULL"):
        return None
    if s in ("true", "True", "TRUE"):
        return True
    if s in ("false", "False", "FALSE"):
        return False
    if s[0] in "\"'" and s[-1] == s[0] and len(s) > 1:
        return json.loads(s) if s[0] == '"' else s[1:-1].replace("''", "'")
    if s[0] == "[" and s[-1] == "]":
        return [_scalar(x) for x in _flow(s[1:-1])]
    if s[0] == "{" and s[-1] == "}":
        return {str(_scalar(k)): _scalar(v) for k, _, v in (x.partition(":") for x in _flow(s[1:-1]))}
    if re.fullmatch(r"[-+]?\d+", s):
        return int(s)
    if re.fullmatch(r"[-+]?(\d+\.\d*|\.\d+|\d+)([eE][-+]?\d+)?", s):
        return float(s)
    return s


def _flow(s: str) -> list[str]:
    """Parts of a flow sequence, split at its own commas."""
    out, depth, quote, part = [], 0, "", ""
    for ch in s:
        if quote:
            quote = "" if ch == quote else quote
        elif ch in "\"'":
            quote = ch
        elif ch in "[{":
            depth += 1
        elif ch in "]}":
            depth -= 1
        if ch == "," and not depth and not quote:
            out.append(part)
            part = ""
        else:
            part += ch
    return out + [part] if part.strip() else out


def _uncommented(line: str) -> str:
    m = re.match(r"((?:[^\"'#]|\"(?:[^\"\\]|\\.)*\"|'[^']*'|(?<!\s)#|[\"'])*?)(?:(?:^|\s+)#.*)?$", line)
    return m[1].rstrip() if m else line.rstrip()


def parse_yaml(text: str):
    """Block and flow mappings and sequences, quoted and plain scalars, literal and folded blocks. Anchors, tags and several documents are refused."""
    lines = [x for x in text.splitlines() if x.strip() != "---"]
    value, at = _block(lines, 0, -1)
    if any(_uncommented(x).strip() for x in lines[at:]):
        raise ValueError(f"can't read YAML line {lines[at]!r}")
    return value


def _depth(line: str) -> int:
    return len(line) - len(line.lstrip(" "))


def _skip(lines: list[str], at: int) -> int:
    while at < len(lines) and not _uncommented(lines[at]).strip():
        at += 1
    return at


_KEY = re.compile(r"(\"(?:[^\"\\]|\\.)*\"|'[^']*'|[^\s#:\"'\[\]{}&*!|>-][^:]*?|[^\s:]+?)\s*:(?:\s+(.*))?$")


def _block(lines: list[str], at: int, above: int):
    at = _skip(lines, at)
    if at >= len(lines) or _depth(lines[at]) <= above:
        return None, at
    depth = _depth(lines[at])
    first = _uncommented(lines[at]).strip()
    if first == "-" or first.startswith("- "):
        out = []
        while (at := _skip(lines, at)) < len(lines) and _depth(lines[at]) == depth and re.match(r"-( |$)", lines[at].strip()):
            rest = _uncommented(lines[at]).strip()[1:].strip()
            if not rest:
                value, at = _block(lines, at + 1, depth)
            elif _KEY.match(rest) and rest[0] not in "\"'[{" or re.match(r"-( |$)", rest):
                inner = lines[at].replace("-", " ", 1)
                value, at = _block([*lines[:at], inner, *lines[at + 1 :]], at, depth)
            else:
                value, at = _scalar(rest), at + 1
            out.append(value)
        return out, at
    m = _KEY.match(first)
    if not m:
        return _scalar(first), at + 1
    out = {}
    while (at := _skip(lines, at)) < len(lines) and _depth(lines[at]) == depth:
        m = _KEY.match(_uncommented(lines[at]).strip())
        if not m:
            raise ValueError(f"can't read YAML line {lines[at]!r}")
        key, rest = str(_scalar(m[1])), (m[2] or "").strip()
        if rest[:1] in ("&", "*", "!"):
            raise ValueError(f"YAML anchors and tags are not read: {rest!r}")
        if re.fullmatch(r"[|>][-+]?", rest):
            part, at = [], at + 1
            while at < len(lines) and (not lines[at].strip() or _depth(lines[at]) > depth):
                part.append(lines[at])
                at += 1
            cut = min((_depth(x) for x in part if x.strip()), default=0)
            part = [x[cut:] for x in part]
            while part and not part[-1].strip():
                part.pop()
            out[key] = ("\n" if rest[0] == "|" else " ").join(part) + ("" if "-" in rest else "\n")
        elif rest:
            out[key], at = _scalar(rest), at + 1
        else:
            nxt = _skip(lines, at + 1)
            flat = nxt < len(lines) and _depth(lines[nxt]) == depth and re.match(r"-( |$)", lines[nxt].strip())
            out[key], at = _block(lines, at + 1, depth - 1 if flat else depth)
    return out, at


# BibTeX ---------------------------------------------------------------------------------------------


def _balanced(s: str, at: int) -> int:
    """The place after the brace that closes the one at `at`."""
    depth = 0
    for i in range(at, len(s)):
        depth += (s[i] == "{") - (s[i] == "}")
        if not depth:
            return i + 1
    raise ValueError("a brace is not closed")


def parse_bibtex(text: str) -> dict:
    """preambles, comments, variables and bibliographies (entry_type, citation_key, tags with lower-case names)."""
    out: dict = {"preambles": [], "comments": [], "variables": {}, "bibliographies": []}
    at = 0
    while (m := re.compile(r"@(\w+)\s*\{").search(text, at)) is not None:
        end = _balanced(text, m.end() - 1)
        kind, body, at = m[1].lower(), text[m.end() : end - 1], end
        if kind == "comment":
            out["comments"].append(body.strip())
        elif kind == "preamble":
            out["preambles"].append(body.strip().strip('"'))
        elif kind == "string":
            name, _, value = body.partition("=")
            out["variables"][name.strip()] = _bib_value(value, out["variables"])
        else:
            key, _, rest = body.partition(",")
            tags = {}
            while (t := re.compile(r"\s*([\w:-]+)\s*=\s*").match(rest)) is not None:
                rest, value = rest[t.end() :], ""
                while True:
                    if rest[:1] == "{":
                        stop = _balanced(rest, 0)
                    elif rest[:1] == '"':
                        stop = re.compile(r'"(?:[^"\\]|\\.)*"').match(rest).end()
                    else:
                        stop = re.compile(r"[^\s,#]*").match(rest).end()
                    value += _bib_value(rest[:stop], out["variables"])
                    rest = rest[stop:].lstrip()
                    if rest[:1] != "#":
                        break
                    rest = rest[1:].lstrip()
                tags[t[1].lower()] = value
                rest = rest.lstrip()[1:] if rest.lstrip()[:1] == "," else ""
            out["bibliographies"].append({"entry_type": m[1], "citation_key": key.strip(), "tags": tags})
    return out


def _bib_value(s: str, variables: dict) -> str:
    s = s.strip()
    if s[:1] in "{\"" and s[-1:] in "}\"":
        return re.sub(r"[{}]", "", s[1:-1])
    return variables.get(s, s)


def plain_value(v):
    """TOML dates and times as text, also inside."""
    if isinstance(v, dict):
        return {k: plain_value(x) for k, x in v.items()}
    if isinstance(v, list):
        return [plain_value(x) for x in v]
    return v.isoformat() if hasattr(v, "isoformat") else v


# the readers -------------------------------------------------------------------------------------------


def parse_xml(text: str):
    """Elements as a map; repeated ones as a list, text under $text where there is more than text."""
    from xml.etree import ElementTree

    def value(e):
        out: dict = {f"@{k}": v for k, v in e.attrib.items()}
        for child in e:
            v = value(child)
            if child.tag in out:
                out[child.tag] = [*(out[child.tag] if isinstance(out[child.tag], list) else [out[child.tag]]), v]
            else:
                out[child.tag] = v
        own = (e.text or "").strip()
        if not out:
            return own
        return out | ({"$text": own} if own else {})

    root = ElementTree.fromstring(text)
    return {root.tag: value(root)}


def to_json(kind: str, text: str) -> str:
    if kind == "toml":
        value = plain_value(tomllib.loads(text))
    else:
        value = {"yaml": parse_yaml, "xml": parse_xml, "bibtex": parse_bibtex}[kind](text)
    return json.dumps(value, ensure_ascii=False)


#: A record of a CSV text, with line ends inside of quotes only, and a field of a record.
RECORD, FIELD = r'(?:[^"\n]++|"[^"]*+(?:""[^"]*+)*+")+', r'(?:^|,)("[^"]*+(?:""[^"]*+)*+"|[^",]*+)'


def csv_columns(content: Column) -> tuple[Column, Column]:
    """(headers, records) of a CSV text as arrays of strings; blank lines are no rows, quotes are doubled inside of quotes."""
    bare = lambda f: F.when(f.startswith('"'), F.replace(F.substring(f, F.lit(2), F.length(f) - 2), F.lit('""'), F.lit('"'))).otherwise(f)
    lines = F.filter(F.transform(F.regexp_extract_all(content, F.lit(f"({RECORD})"), F.lit(1)), lambda x: F.regexp_replace(x, "\r$", "")), lambda x: x != "")
    rows = F.transform(lines, lambda x: F.transform(F.regexp_extract_all(x, F.lit(FIELD), F.lit(1)), bare))
    return F.coalesce(F.get(rows, 0), F.array().cast("array<string>")), F.slice(rows, 2, F.greatest(F.size(rows), F.lit(1)))


def load_data(files: DataFrame, format: str | None = None, required: bool = True) -> DataFrame:  # noqa: A002
    """files (file, content) with data (variant) and error, by each file's format. Null contents are errors where required, else null data.

    JSON, CSV and plain text are column expressions; only the formats that Spark has no
    reader for as data of any shape (YAML, TOML, XML, BibTeX) go through a parser in Python,
    dealt by their names: a table of many small contents may be one part of one file.
    """

    def run(batches):
        import pandas as pd

        for pdf in batches:
            data, error = [], []
            for f, kind, c in zip(pdf["file"], pdf["kind"], pdf["content"], strict=True):
                try:
                    data.append(to_json(kind, c))
                    error.append(None)
                except Exception as e:  # noqa: BLE001  any parser's complaint becomes the row's error
                    data.append(None)
                    error.append(f"{f}: {e}")
            yield pd.DataFrame({"file": pdf["file"], "json": data, "error": error})

    if format and format not in FORMATS:
        raise ValueError(f"unknown format {format}")
    c = F.col
    kind = F.lit(format) if format else F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in ENDINGS.items() for x in pair]), F.lower(F.regexp_extract("file", r"\.([^./]+)$", 1))), F.lit("plain"))
    rows = files.select("file", "content", kind.alias("kind"))
    own = rows.where(c("content").isNull() | c("kind").isin("json", "csv", "plain"))
    headers, records = csv_columns(c("content"))
    table = own.withColumns({"headers": F.when(c("kind") == "csv", headers), "records": F.when(c("kind") == "csv", records)})
    uneven = F.exists("records", lambda r: F.size(r) != F.size("headers"))
    value = (F.when(c("kind") == "json", F.try_parse_json("content")).when(c("kind") == "plain", F.parse_json(quoted(c("content"))))
             .when(~uneven, F.parse_json(F.to_json(F.struct("headers", "records")))))
    fault = (F.when(c("content").isNull(), F.concat("file", F.lit(" is missing")) if required else F.lit(None).cast("string")).when((c("kind") == "json") & F.try_parse_json("content").isNull(), F.concat("file", F.lit(": not valid JSON")))
             .when(uneven, F.concat("file", F.lit(": rows differ in their number of fields"))))
    loaded = table.select("file", F.when(c("content").isNotNull(), value).alias("data"), fault.alias("error"))
    parsed = rows.where(c("content").isNotNull() & ~c("kind").isin("json", "csv", "plain")).repartition(c("file")).mapInPandas(run, "file string, json string, error string")
    return loaded.unionByName(parsed.select("file", F.parse_json("json").alias("data"), "error"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file as strings; rows of another width are an error."""
    return spark.read.csv(path, header=True, mode="FAILFAST", enforceSchema=False)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path, multiLine=True)


def read_xml(spark: SparkSession, path: str, row_tag: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).load(path)


# values inside -------------------------------------------------------------------------------------------


def leaf(data: Column, path: str, kind: str = "string") -> Column:
    """A leaf of a variant by its path (`a.b[0]`); null where it isn't there."""
    return F.try_variant_get(data, "$." + path if not path.startswith("[") else "$" + path, kind)


def string_list(data: Column, path: str) -> Column:
    """A list of strings, or one string as a list of one; else an empty list."""
    one = leaf(data, path)
    many = leaf(data, path, "array<string>")
    return F.coalesce(many, F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))


# Keys, and endings of keys, that never hold copy; the ending of keys that name other data.
SKIP_KEYS = ("source_hash", "content_hash", "canonical", "source_url", "template", "slug", "id", "app", "author", "date", "updated", "path", "url", "href", "src", "image", "img", "shot", "icon", "glyph", "class", "lang", "jsonld", "noindex")
SKIP_ENDINGS = ("_url", "_href", "_src", "_path", "_id", "_icon", "_class", "_image", "_img", "_hash")
DATA_KEY_ENDING = "_key"
MACHINE_PREFIXES = ("/", "./", "../", "#", "{", "[", "http://", "https://", "mailto:", "tel:")


def skipped_key(name: Column) -> Column:
    """Whether a key never holds copy; false for the entries of arrays, which have no name."""
    ends = F.lit(False)
    for end in SKIP_ENDINGS:
        ends = ends | name.endswith(end)
    return F.coalesce(name.isin(*SKIP_KEYS) | ends, F.lit(False))


def data_key(path: Column) -> Column:
    """Whether the leaf at a path (`a.b[2].c`) is a look-up key into other data: it is copied as it is."""
    return F.coalesce(F.regexp_replace(path, r"(\[\d+\])+$", "").endswith(DATA_KEY_ENDING), F.lit(False))


def is_copy(text: Column) -> Column:
    """Whether a string reads as copy: it has letters and is no address, slug, file name, language tag or style value."""
    t = F.regexp_replace(text, r"^\p{IsWhite_Space}+|\p{IsWhite_Space}+$", "")
    machine = F.lit(False)
    for start in MACHINE_PREFIXES:
        machine = machine | t.startswith(start)
    slug = t.rlike(r"^[a-z0-9_./-]+$") & t.rlike(r"[_./-]")
    tag = t.rlike(r"^[a-z]{2,3}-(?=[a-zA-Z0-9]*[A-Z])[a-zA-Z0-9]{2,4}$")
    style = t.rlike(r"[A-Za-z]\([0-9-]")
    return F.coalesce(t.rlike(r"\p{IsAlphabetic}") & ~machine & ~slug & ~tag & ~style, F.lit(False))


#: Levels of nested data that leaves() takes in one pass.
LEVELS = 16


def leaves(rows: DataFrame, key: str, data: str) -> DataFrame:
    """(key, path, text) of all string leaves of a JSON text column, however deep: arrays as [i], keys that hold no copy left out.

    A level is one explode of the entries, through which leaves pass as they are. LEVELS of
    them run in one pass over the rows, dealt by their keys; only what is deeper is written
    and goes on, so deep data are parsed and written once for all these levels.
    """
    from .shared import materialize

    c = F.col
    inside = lambda kind: F.try_variant_get("v", "$", kind)
    opened = lambda: inside("map<string,variant>").isNotNull() | inside("array<variant>").isNotNull()
    entry = lambda path, v: F.struct(path.alias("path"), v.alias("v"))
    named = F.filter(F.map_entries(inside("map<string,variant>")), lambda e: ~skipped_key(e["key"]))
    named = F.transform(named, lambda e: entry(F.when(c("path") == "", e["key"]).otherwise(F.concat("path", F.lit("."), e["key"])), e["value"]))
    listed = F.transform(inside("array<variant>"), lambda v, i: entry(F.concat("path", F.lit("["), i.cast("string"), F.lit("]")), v))
    level = rows.select(key, F.lit("").alias("path"), c(data).alias("rest")).repartition(c(key))
    found = None
    while True:
        level = level.select(key, "path", F.parse_json("rest").alias("v"))
        for _ in range(LEVELS):
            level = level.select(key, F.explode(F.coalesce(named, listed, F.array(entry(c("path"), c("v"))))).alias("e")).select(key, "e.path", "e.v")
        text = F.when(F.schema_of_variant("v") == "STRING", F.try_variant_get("v", "$", "string"))
        done = level.select(key, "path", F.when(~opened(), text).alias("text"), F.when(opened(), F.to_json("v")).alias("rest")).where("text IS NOT NULL OR rest IS NOT NULL")
        done = materialize(done, "leaves")
        text = done.where("text IS NOT NULL").select(key, "path", "text")
        found = text if found is None else found.unionByName(text)
        level = done.where("rest IS NOT NULL").select(key, "path", "rest")
        if level.isEmpty():
            return found


def merge_tables(first: dict, second: dict, where: str = "") -> dict:
    """Deep merge of two tables, the first one wins; a table against a value is an error."""
    out = dict(first)
    for k, v in second.items():
        if k not in out:
            out[k] = v
        elif isinstance(out[k], dict) and isinstance(v, dict):
            out[k] = merge_tables(out[k], v, f"{where}{k}.")
        elif isinstance(out[k], dict) != isinstance(v, dict):
            raise ValueError(f"{where}{k} is a table on one side only")
    return out
