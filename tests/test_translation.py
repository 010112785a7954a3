"""Segments, nested data and headers on small cases; the registered queries hold the rest over whole tables."""
import json
import random

import pytest
from pyspark.sql import functions as F

from sheafline.operators import headers, segments
from sheafline.sources import nested


def cut(spark, *texts):
    return [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).select(segments.cut(F.col("t"))).collect()]


def test_pieces_of_marks_and_blocks(spark):
    text = "# Head *one* two {#own}\n\n- [ ] item `a|b` end\n> quote\n```py\ncode # no\n```\n| a | b |\n<div class='x'>Text <b>bold</b> end</div><script>if (a < b) {}</script> tail &amp; more\n"
    found = [p for p in cut(spark, text)[0] if p.texts]
    assert [(p.texts, p.atoms) for p in found] == [
        (["Head ", "one", " two"], ["*", "*"]), (["item ", " end"], ["`a|b`"]), (["quote"], []), (["a ", " b"], ["|"]),
        (["Text ", "bold", " end"], ["<b>", "</b>"]), (["tail ", " more"], ["&amp;"])]
    assert found[0].head == "# " and found[1].head == "- [ ] " and found[0].tail == " {#own}"


@pytest.mark.parametrize("seed", range(4))
def test_any_text_is_its_pieces_again(spark, seed):
    rng = random.Random(seed)
    parts = ["word ", "Größe", " ", "\n", "\r\n", "*", "__", "`x`", "`", "[", "](a)", "]", "<b>", "</b>", "<div>", "<!--", "-->", "{{ v }}", "{%", "%}", "\\*", "&amp;", "|", "# ", "- ", "```", "> ", "https://e.org/a ", "\xa0", "XHTML0000X", "<", "\\"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 30))) for _ in range(200)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").coalesce(1).withColumn("p", segments.cut(F.col("t")))
    got = df.select(F.array_join(F.transform("p", lambda p: segments.whole(p, segments.source(p))), "")).collect()
    assert [r[0] for r in got] == texts


def test_nulls_and_empty_texts(spark):
    assert cut(spark, None)[0] is None
    assert [p.head for p in cut(spark, "")[0]] == [""]


def test_restored_answers_keep_structure_out(spark):
    """Bars and marks that a client adds are escaped; a token in any case is one."""
    rows = [("| a *b* | c |", "x | y XHTML0000X b xhtml0001x XHTML0002X c", "| x \\| y *b* | c |"), ("one two", "- one", "\\- one"), ("one two", "1. one", "1\\. one"), ("one two", "# one\ntwo", "\\# one two"), ("- one", "# two", "- # two")]
    df = spark.createDataFrame(rows, "t string, a string, want string").coalesce(1).withColumn("p", F.get(segments.cut(F.col("t")), 0))
    back = df.select(segments.whole(F.col("p"), segments.restore(F.col("p"), F.col("a"))["text"]).alias("got"), "want").collect()
    assert [r.got for r in back] == [r.want for r in back]


def test_only_what_failed_is_asked_again(spark, tmp_path, monkeypatch):
    """A client that logs what it is asked: an echo is asked by fragments, an untranslated fragment once more, an error never."""
    log = tmp_path / "log"

    def client(texts, lang):
        with open(log, "a") as f:
            f.write("".join(json.dumps(t) + "\n" for t in texts))
        if any("boom" in t for t in texts):
            raise ValueError("no luck")
        again = log.read_text().count(json.dumps("echo this one here")) > 1
        return [(t if "echo" in t and not again else t.upper(), True) for t in texts]

    rows = [(1, "echo this one here"), (2, "fine words *here*"), (3, None), (4, ""), (5, "boom goes all of it")]
    monkeypatch.setattr(segments, "BATCH_TEXTS", 1)
    out = segments.translate(spark.createDataFrame(rows, "id int, t string").coalesce(1), "id", "t", client, "xx").orderBy("id").collect()
    assert [(r.id, r.text, r.errors) for r in out] == [(1, "ECHO THIS ONE HERE", []), (2, "FINE WORDS *HERE*", []), (3, None, []), (4, "", []), (5, "boom goes all of it", ["no luck"])]
    asked = [json.loads(x) for x in log.read_text().splitlines()]
    assert sorted(asked) == sorted(["echo this one here"] * 2 + ["fine words  XHTML0000X here", "boom goes all of it"])


DATA = ['{"b":1,"a":{"z":"x","y":[1,"1",true,null,[],{}]},"c d":"q\\"\\\\\\n"}', "[]", "{}", '"s"', "3", None, "no json", '[{"a":"b"},["c"]]', '{"a":1.50,"b":"1.50","é":"ü"}']


def test_nested_data_are_their_leaves_again(spark):
    df = spark.createDataFrame(list(enumerate(DATA)), "k int, data string").coalesce(1)
    leaves = nested.take_apart(df, "k", "data")
    got = {r.k: r.data for r in nested.put_together(leaves, "k").collect()}
    assert {k: json.loads(v, object_pairs_hook=list) for k, v in got.items()} == {k: json.loads(v, object_pairs_hook=list) for k, v in enumerate(DATA) if v and v != "no json"}
    paths = {(r.k, r.path): r.kind for r in leaves.collect()}
    assert paths[0, "a.y[1]"] == "string" and paths[0, "a.y[0]"] == paths[0, "a.y[3]"] == "other" and paths[0, "a.y[4]"] == "array" and paths[7, "[0].a"] == "string" and paths[3, ""] == "string"


def test_leaves_are_set_where_strings_are(spark):
    df = spark.createDataFrame(list(enumerate(DATA)), "k int, data string").coalesce(1)
    edits = [(0, "a.z", 'n"ew'), (0, "b", "no"), (0, "a.y[1]", "one"), (0, "a.y[9]", "no"), (1, "x", "no"), (3, "", "t"), (5, "a", "no"), (6, "a", "no"), (7, "[1][0]", "d"), (99, "a", "no")]
    out = {r.k: (r.data, r.missing) for r in nested.set_leaves(df, "k", "data", spark.createDataFrame(edits, "k int, path string, text string").coalesce(1)).collect()}
    assert json.loads(out[0][0]) == {"b": 1, "a": {"z": 'n"ew', "y": [1, "one", True, None, [], {}]}, "c d": 'q"\\\n'} and out[0][1] == ["a.y[9]", "b"]
    assert out[1] == ("[]", ["x"]) and out[3] == ('"t"', []) and out[5] == (None, ["a"]) and out[6] == ("no json", ["a"]) and json.loads(out[7][0]) == [{"a": "b"}, ["d"]]
    assert len(out) == len(DATA)
    assert nested.set_leaves(df.limit(0), "k", "data", spark.createDataFrame(edits, "k int, path string, text string")).count() == 0


def test_hash_lines(spark):
    cases = [("+++\n[extra]\nsource_hash = \"a\"\n+++\nb", None, "+++\n[extra]\n+++\nb"), ("+++\n+++\n", "h", '+++\n[extra]\nsource_hash = "h"\n+++\n'), ("+++\n", "h", None), ("", "h", None), (None, "h", None), ("text +++\n+++", "h", None),
             ("+++\n[extra]\n[other]\nsource_hash = 1\n+++", "h", '+++\n[extra]\nsource_hash = "h"\n[other]\nsource_hash = 1\n+++')]
    df = spark.createDataFrame([c[:2] for c in cases], "t string, h string").coalesce(1)
    assert [r[0] for r in df.select(headers.rewrite_hash(F.col("t"), F.col("h"))).collect()] == [c[2] for c in cases]


def test_toml(spark):
    import tomllib

    data = ['{"t":{"a":1,"d":{"e":{"f":"g"}}},"s":"x\\ty","list":[{"a":1,"b c":["d",null]},{}],"n":null,"e":{}}', "{}"]
    df = spark.createDataFrame(list(enumerate(data)), "k int, data string").coalesce(1)
    got = {r.k: r.toml for r in headers.toml_text(nested.take_apart(df, "k", "data"), "k").collect()}
    assert got[1] == "" and tomllib.loads(got[0]) == {"t": {"a": 1, "d": {"e": {"f": "g"}}}, "s": "x\ty", "list": [{"a": 1, "b c": ["d"]}, {}], "e": {}}


def test_merge_meets_in_groupings(spark):
    """Clashes, empty objects, data that are no object, keys of one side and a null key, without a broadcast through the driver."""
    first = spark.createDataFrame([(1, '{"a":{"x":1},"b":{}}'), (2, '{"a":1,"c":{"d":{}}}'), (3, None), (4, "[1]"), (None, '{"n":null}')], "k int, data string")
    second = spark.createDataFrame([(1, '{"a":{"x":2,"y":[1]},"b":{"z":0}}'), (2, '{"a":{"x":1},"c":{"d":5}}'), (4, '{"q":1}'), (5, '{}')], "k int, data string")
    merged = nested.merge(first, second, "k", "data")
    assert {r.k: (r.data, r.clashes) for r in merged.collect()} == {
        1: ('{"a":{"x":1,"y":[1]},"b":{"z":0}}', []), 2: (None, ["a", "c.d"]), 3: ("{}", []), 4: ('{"q":1}', []), 5: ("{}", []), None: ('{"n":null}', [])}
    assert "Broadcast" not in merged._jdf.queryExecution().toString()
