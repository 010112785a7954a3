"""What a query computes does not grow faster than its input: steps run once, and over each part of a text once."""

import json
import re
import time

from pyspark.sql import functions as F

from __spark_entry__ import queries
from sheafline.functions.text import alternating, once
from sheafline.operators import headers, headings, i18n, markdown, quality, search, segments
from sheafline.plans import markup
from sheafline.sources import data, nested, shared

ODD = ["", "\n", "a", "a\r\nb\n", "x <b>y</b> `c` *d* http://e.f/g h|i", "```\nno end\nof it", "  ```py\ncode *x*\n  ```\nafter [a](b) &amp; &no; \\* __u__", "<script >x\n</SCRIPT>z<!-- c\n -->t \t```q\n```\nr", "  word 　<img src=x> tail ", "- [x] ## a {# b} {{ c }} {% d %}", "1) >> `` a ` b `` ![i](u) [^n] [r][s] https://x.y htt h"]


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_text_is_cut_once_for_both_answers(spark, sf):
    assert plan(queries()["restored_answers"](spark, sf)).count("<!--") == 2 * 2  # documents and pages: cut apart, and what stands between


def test_cut_finds_what_the_plain_patterns_find(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "i int, t string")
    quick = df.select("i", segments.cut(F.col("t")).alias("p")).collect()
    hard, construct = F.split("t", segments.HARD, -1), segments.CONSTRUCT
    want = {r["i"]: r for r in df.select("i", F.size(hard).alias("n"), F.transform(hard, lambda u: F.size(F.split(F.regexp_replace(u, segments.PREFIX, ""), construct, -1))).alias("k"), F.transform(hard, lambda u: F.regexp_replace(u, segments.PREFIX, "")).alias("b")).collect()}
    for r in quick:
        assert "".join(p["head"] + "".join(t + (p["atoms"][i] if i < len(p["atoms"]) else "") for i, t in enumerate(p["texts"])) + p["tail"] + p["sep"] for p in r["p"]) == ODD[r["i"]]
        assert len(r["p"]) == want[r["i"]]["n"]
        for p, k, b in zip(r["p"], want[r["i"]]["k"], want[r["i"]]["b"], strict=True):
            assert len(p["texts"]) <= k and (not p["texts"] or len(p["atoms"]) == len(p["texts"]) - 1)
            assert all(t == t.strip() for t in p["texts"][:1] if len(p["texts"]) == 1), b


def test_an_answer_is_read_once(spark):
    df = spark.createDataFrame([("a *b* c", "X XHTML0000X y XHTML0001X z")], "t string, a string").withColumn("p", F.get(segments.cut(F.col("t")), 0))
    out = df.select(segments.restore(F.col("p"), F.col("a")).alias("r")).select("r.text", "r.error")
    assert plan(out).count("split(") == 1 + plan(df).count("split(")
    assert out.first() == ("X *y* z", None)


def test_fragments_of_many_constructs_return_in_order(spark):
    text = " ".join(f"w{i} *" for i in range(3000)) + " end"
    df = spark.createDataFrame([(text,)], "t string").select(F.get(segments.cut(F.col("t")), 0).alias("p"))
    began = time.time()
    back = df.select(segments.restore_fragments(F.col("p"), F.transform(segments.fragments(F.col("p")), F.upper)).alias("x")).first()[0]
    assert back == text.upper() and time.time() - began < 10


def _lines(text):
    out, inside = [], False
    for x in re.split("(?<=\n)", text):
        fence = x.lstrip(" ").startswith(("```", "~~~"))
        out.append((fence or inside, x))
        inside ^= fence
    return out


def test_lines_and_their_code_on_odd_texts(spark):
    odd = [*ODD, "```", "a\n```", "~~~\nb\n ```\nc", "```\n\n~~~\n", "\t```\nno fence\n", "# h\n```\n# c\n```\n", "\r```\nx"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for i, pieces in df.select("i", i18n.split_segments(F.col("t"))).collect():
        assert [(p["kind"] == "code", p["text"]) for p in pieces] == _lines(odd[i])


def test_lines_of_a_long_text_are_split_once(spark):
    df = spark.createDataFrame([("[a](b)\n" * 20000,)], "t string")
    began = time.time()
    assert markdown.inline_links(df.withColumn("k", F.lit(1)), "k", "t").count() == 20000
    assert time.time() - began < 15


def test_links_are_found_without_a_join(spark, sf):
    assert "Join" not in plan(queries()["md_links"](spark, sf))


def test_classes_tried_at_every_character_hold_no_range():
    assert not re.search(r"[A-Za-z0-9]-[A-Za-z0-9]", markup._PLAIN)


def test_once_keeps_nulls(spark):
    assert spark.range(1).select(once(F.lit(None).cast("string"), lambda x: F.coalesce(x, F.lit("n")))).first()[0] == "n"


def test_leaves_deeper_than_a_pass_with_nulls_lists_and_skipped_keys(spark):
    deep = '"x"'
    for i in range(2 * data.LEVELS + 3):
        deep = '{"n":%s}' % deep if i % 2 else "[%s]" % deep
    texts = [deep, '{"a":null,"slug":{"b":"no"},"e":{},"f":[],"g":[["y"],1,true,"{}"]}', '"alone"', None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, extra string")
    got = sorted(tuple(r) for r in data.leaves(df, "id", "extra").collect())
    path = "".join(".n" if i % 2 else "[0]" for i in reversed(range(2 * data.LEVELS + 3)))
    assert got == [(0, path, "x"), (1, "g[0][0]", "y"), (1, "g[3]", "{}"), (2, "", "alone")]


def test_deep_leaves_are_written_once(spark, sf, monkeypatch):
    names = []
    real = shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df, name: names.append(name) or real(df, name))
    assert queries()["deep_leaves"](spark, sf).count() == spark.read.parquet(sf + "/part.parquet").count() and names == ["leaves"]


def test_edges_meet_their_reverse_in_one_grouping(spark):
    edges = spark.createDataFrame([(1, 2), (2, 1), (1, 2), (3, 1), (3, 1), (1, 4), (5, 5), (None, 1), (2, None)], "`from` int, `to` int")
    out = quality.reciprocal(edges)
    assert sorted(r["message"] or "" for r in out.collect()) == ["", "edge to 1 has no reverse edge", "edge to 1 has no reverse edge", "edge to 4 has no reverse edge"]
    assert "Join" not in plan(out)


def test_leaves_are_set_in_one_pass_at_any_depth(spark, monkeypatch):
    names = []
    real = nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, name: names.append(name) or real(df, name))
    deep = '"x"'
    for i in range(2 * nested.LEVELS + 3):
        deep = '{"n":%s}' % deep if i % 2 else "[%s, {}]" % deep
    path = "".join(".n" if i % 2 else "[0]" for i in reversed(range(2 * nested.LEVELS + 3)))
    wide = {f"k{i}": str(i) for i in range(2000)}
    texts = [deep, '{"a.b":"c","a":{"b":"c"},"":{"":"e"},"s":"{\\"a\\":1}","z":[ 1, "1", {"u":null}]}', json.dumps(wide), "{ }"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, data string")
    edits = [(0, path, "y"), (1, "a.b", "d"), (1, ".", "f"), (1, "s", "t"), (1, "s.a", "no"), (1, "z[0]", "no"), (1, None, "no"), (3, "", "no"), *[(2, k, "n" + v) for k, v in wide.items()]]
    rows = lambda n, kept: {r.k: (r.data, r.missing) for r in nested.set_leaves(df.where(n), "k", "data", spark.createDataFrame([e for e in edits if kept(e)], "k int, path string, text string")).collect()}
    got = rows("k > 0", lambda e: e[0] > 0)
    assert names == ["set-leaves"]
    assert got[1] == ('{"a.b":"d","a":{"b":"d"},"":{"":"f"},"s":"t","z":[1,"1",{"u":null}]}', ["s.a", "z[0]"])
    assert json.loads(got[2][0]) == {k: "n" + v for k, v in wide.items()} and got[2][1] == [] and got[3] == ("{ }", [""])
    assert rows("k = 0", lambda e: e[0] == 0)[0] == (deep.replace('"x"', '"y"').replace(", ", ","), [])


def test_no_side_of_a_translation_is_sent_to_the_driver(spark, sf, monkeypatch):
    plans = []
    for place in (nested, headers, segments):
        monkeypatch.setattr(place, "materialize", lambda df, name, real=place.materialize: plans.append(df) or real(df, name))
    plans.append(queries()["translated_pages"](spark, sf))
    assert len(plans) == 10 and not any("Broadcast" in p._jdf.queryExecution().sparkPlan().toString() for p in plans)


def test_files_of_one_part_are_parsed_by_many_tasks(spark, sf):
    assert re.search("MapInPandas.*\n.*RepartitionByExpression", plan(queries()["data_yaml"](spark, sf)))


def test_no_task_sorts_words_to_stem_them(spark, sf):
    physical = queries()["stemmed_index"](spark, sf)._jdf.queryExecution().sparkPlan().toString()
    assert "ShuffledHashJoin" in physical and "SortMergeJoin" not in physical


def test_nested_data_are_taken_apart_in_one_pass_at_any_depth(spark, monkeypatch):
    names = []
    real = nested.materialize
    monkeypatch.setattr(nested, "materialize", lambda df, name: names.append(name) or real(df, name))
    deep = '"x"'
    for i in range(2 * nested.LEVELS + 3):
        deep = '{"n":%s}' % deep if i % 2 else "[%s,{}]" % deep
    path = "".join(".n" if i % 2 else "[0]" for i in reversed(range(2 * nested.LEVELS + 3)))
    df = spark.createDataFrame([(0, deep), (1, '{"a":[],"b":[1,"{}",null],"c":{"d":"[1]"}}'), (2, "[ ]"), (None, "1")], "k int, data string")
    got = {(r.k, r.path): (r.kind, r.value, [s.pos for s in r.steps]) for r in nested.take_apart(df, "k", "data").where("k IS NULL OR k > 0").collect()}
    assert len(names) == 3 and got == {
        (1, "a"): ("array", "[]", [0]), (1, "b[0]"): ("other", "1", [1, 0]), (1, "b[1]"): ("string", '"{}"', [1, 1]), (1, "b[2]"): ("other", "null", [1, 2]), (1, "c.d"): ("string", '"[1]"', [2, 0]), (2, ""): ("array", "[ ]", []), (None, ""): ("other", "1", [])}
    names.clear()
    whole = nested.take_apart(df.where("k = 1"), "k", "data", into_arrays=False).collect()
    assert names == ["leaves"] and sorted((r.path, r.kind, r.value) for r in whole) == [("a", "array", "[]"), ("b", "array", '[1,"{}",null]'), ("c.d", "string", '"[1]"')]
    assert (path, '"x"') in {(r.path, r.value) for r in nested.take_apart(df.where("k = 0"), "k", "data").collect()}


def test_an_index_holds_no_table_of_all_terms(spark, sf):
    alone, again = re.split(r"\n\+- (?=Aggregate \[field)", plan(queries()["inverted_index"](spark, sf)))
    assert alone.startswith("Union") and "inline(" in alone and not re.search(r"Aggregate \[field|Aggregate \[term", alone)
    assert "LeftSemi" in again


def test_an_index_sums_documents_of_several_rows(spark):
    docs = spark.createDataFrame([(1, "b a B", "x"), (1, "a 7\u00e9c a", None), (None, "a", "The"), (None, "a-a", "x"), (2, None, "Q q"), (3, "", "the")], "id int, body string, tag string")
    got = sorted(tuple(r) for r in search.inverted_index(docs.repartition(3), "id", ["body", "tag"]).fillna(0, "id").collect())
    assert got == [("body", "7", 1, 1), ("body", "b", 1, 2), ("body", "c", 1, 1), ("tag", "q", 2, 2), ("tag", "x", 0, 1), ("tag", "x", 1, 1)]
    kept = sorted(tuple(r) for r in search.inverted_index(docs, "id", ["body"], stop_words=[]).fillna(0, "id").collect())
    assert kept == [("body", "7", 1, 1), ("body", "a", 0, 3), ("body", "a", 1, 3), ("body", "b", 1, 2), ("body", "c", 1, 1)]


def test_a_text_is_cut_in_one_pass(spark, sf):
    shown = plan(queries()["masked_segments"](spark, sf))
    assert "regexp_extract_all(" not in shown and shown.count("<!--") == 2 * 2  # documents and pages: a pass, and the one of texts that have the mark


def test_pieces_of_texts_that_have_the_mark(spark):
    odd = [*ODD, *(t.replace(" ", m).replace("x", "x" + m) for t in ODD for m in ("\x01", "\x02", "\x02\x04", "\x01\x03", "\x02\x03\x01"))]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string").repartition(4)
    for pattern in (segments._HARD, segments._CONSTRUCT, i18n.FENCE_LINE):
        got = df.select("t", alternating(F.col("t"), pattern).alias("p"), F.split("t", pattern, -1).alias("u"), F.regexp_extract_all("t", F.lit(f"({pattern})"), F.lit(1)).alias("s")).collect()
        for r in got:
            assert r["p"][::2] == r["u"] and r["p"][1::2] == r["s"] and "".join(r["p"]) == r["t"]
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(segments.cut(F.col("t")).alias("p")).first()["p"] is None


def test_lines_are_cut_in_one_pass(spark, sf):
    shown = plan(queries()["md_headings"](spark, sf))
    assert "(?<=" not in shown and "regexp_extract_all(" not in shown
    odd = ["\n\n", "a\n\nb", "\x01# a\n```\x01\n# b\x02\n```\n# c\x01", "```", "~~~\n~~~\n~~~\n", "a\r\n# b\r", "\u2028# x\n", *ODD]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(odd)], "i int, t string")
    for i, pieces in df.select("i", i18n.split_segments(F.col("t"))).collect():
        assert [(p["kind"] == "code", p["text"]) for p in pieces] == _lines(odd[i])


def test_ids_of_many_equal_headings(spark):
    df = spark.createDataFrame([(["a"] * 2000 + ["a-1", "b", "a"], [None] * 2001 + ["a-2", None])], "s array<string>, e array<string>")
    began = time.time()
    got = df.select(headings.unique_ids(F.col("s"), F.col("e"))).first()[0]
    want, taken = [], {"a-2"}
    for s, e in zip(*df.first(), strict=True):
        own = e or next(x for i in range(len(taken) + 1) if (x := f"{s}-{i}" if i else s) not in taken)
        taken |= set() if e else {own}
        want.append(own)
    assert got == want and time.time() - began < 20
