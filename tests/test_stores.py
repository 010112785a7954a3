"""Files written, listed, watched and kept as state: what a failure, a retry or a restart leaves."""
import json
import tracemalloc

import pytest
from pyspark.sql import functions as F

from sheafline.functions import stemming
from sheafline.operators import publish, search
from sheafline.sources import documents, shared, trees
from sheafline.streaming import watch


def files(root):
    return sorted(str(p.relative_to(root)) for p in root.rglob("*") if p.is_file())


def outputs(spark, n, content="x", bad=None):
    rows = spark.range(n).select(F.concat(F.lit("a/b"), F.col("id") % 3, F.lit("/p"), "id", F.lit(".html")).alias("path"), F.lit(content).alias("content"))
    return rows.withColumn("path", F.when(F.col("path").endswith(f"p{bad}.html"), "../out").otherwise(F.col("path"))) if bad is not None else rows


def test_a_failed_job_leaves_the_folder_as_it_was(spark, tmp_path):
    publish.write_outputs(outputs(spark, 10), str(tmp_path))
    before = files(tmp_path)
    with pytest.raises(Exception, match="outside of"):
        publish.write_outputs(outputs(spark, 40, "new", bad=33), str(tmp_path))
    with pytest.raises(ValueError, match="written twice"):
        publish.write_outputs(outputs(spark, 4, "new").union(outputs(spark, 2, "new")), str(tmp_path))
    assert files(tmp_path) == before and {p.read_text() for p in tmp_path.rglob("*.html")} == {"x"}


def test_attempts_beside_the_committed_one_leave_no_file(spark, tmp_path):
    """Two attempts of a task have written; only the rows of one are committed, and moving again changes nothing."""
    rows = outputs(spark, 5).coalesce(1).withColumn("kind", F.lit("page")).select("kind", "path", "content").toArrow().to_batches()
    first, second = (list(publish._staged(str(tmp_path), "job")(iter(rows))) for _ in range(2))
    partly = publish._staged(str(tmp_path), "job")(iter(rows))
    next(partly)  # a third one that dies half-way
    for _ in range(2):
        list(publish._placed(str(tmp_path))(iter([b.select(["path", "staged"]) for b in second])))
    assert [f for f in files(tmp_path) if not f.startswith(".staging")] == sorted(x for b in first for x in b.column("path").to_pylist())
    assert publish.write_outputs(outputs(spark, 7, "y").withColumn("kind", F.lit("page")), str(tmp_path), ("page", "alias")) == {"files": 7, "bytes": 7, "page": 7, "alias": 0}


def test_clean_up(spark, tmp_path):
    publish.write_outputs(outputs(spark, 6), str(tmp_path))
    for name in (".git/x", "a/.keep", "stray.txt", "_u/_v.txt"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("")
    assert publish.clean_outputs(spark, str(tmp_path), outputs(spark, 3)) == 5
    assert files(tmp_path) == sorted([".git/x", "a/.keep", "a/b0/p0.html", "a/b1/p1.html", "a/b2/p2.html"])
    publish.clean_outputs(spark, str(tmp_path), outputs(spark, 3).limit(0), keep_dot_files=False)
    assert [f for f in files(tmp_path) if not f.endswith(".crc")] == [] and trees.list_tree(spark, str(tmp_path / "none")).count() == 0


def test_scan_of_deep_and_underscored_files(spark, tmp_path):
    names = ["x.md", "_index.md", "_a/b.md", "1/2/3/4/5/6/_c.md", "1/_2/3 4+5%.md", "1/é.md", ".h/x.md", "1/.x.md", "a.txt", "_x.txt"]
    for n in names:
        (tmp_path / n).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / n).write_text(n)
    got = {r.file: r.content for r in documents.scan_files(spark, str(tmp_path)).collect()}
    assert got == {n: n for n in names if n.endswith(".md") and "/." not in f"/{n}"}


def test_watch_goes_on_after_a_restart(spark, tmp_path):
    """Batches over two runs are those of one run without a break; nothing is told twice."""
    site, seen = tmp_path / "site", []
    (site / "content").mkdir(parents=True)
    (site / "content/a.md").write_text("1")
    (site / "config.toml").write_text("1")
    (site / "other").mkdir()
    (site / "other/x").write_text("1")

    def look():
        stream = watch.watch(spark, str(site), str(tmp_path / "state"))
        watch.wait(stream.writeStream.foreachBatch(lambda df, n: seen.extend((n, r.path, r.raw) for r in df.collect())).option("checkpointLocation", str(tmp_path / "check")).start())

    look()
    look()
    (site / "content/a.md").write_text("22")
    (site / "content/b.md").write_text("1")
    (site / "config.toml").unlink()
    look()
    assert sorted(seen) == [(0, "/config.toml", "create"), (0, "/content/a.md", "create"), (1, "/config.toml", "remove"), (1, "/content/a.md", "modify"), (1, "/content/b.md", "create")]


def test_a_watched_folder_is_never_held_whole(tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "SORTED", 3000, raising=False)
    site = tmp_path / "site"
    for n in range(20_000):
        if n % 1000 == 0:
            (site / f"content/d{n % 7}/e {n}").mkdir(parents=True)
        (site / f"content/d{n // 1000 * 1000 % 7}/e {n // 1000 * 1000}/p{n}.md").touch()
    reader = watch._Changes(str(site), str(tmp_path / "state"), [".", "content", "gone"])
    tracemalloc.start()
    assert reader.latestOffset() == {"version": 1} == reader.latestOffset()
    told = sum(1 for k in range(watch.SHARDS) for _ in reader.read(watch._Shard(0, 1, k)))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert told == 20_000 and peak < 4e6


def test_changes_of_any_names_and_after_a_snapshot_of_an_earlier_release(tmp_path, monkeypatch):
    monkeypatch.setattr(watch, "SORTED", 2, raising=False)
    (site := tmp_path / "site").mkdir()
    names = ["a", "a b", 'a"', "a\\", "a\u00e9", "a\U0001f600", "b", "b.md", "c"]
    for n in names:
        (site / n).write_text("1")
    (site / "link").symlink_to("nowhere")
    reader = watch._Changes(str(site), str(tmp_path / "state"), [".", "."])
    changes = lambda start, end: sorted(x[1:] for k in range(watch.SHARDS) for x in reader.read(watch._Shard(start, end, k)))
    assert reader.latestOffset() == {"version": 1} == reader.latestOffset()
    assert changes(0, 1) == sorted(("/" + n, "create", 1) for n in names)
    at = lambda n: [(site / n).stat().st_size, (site / n).stat().st_mtime_ns]
    (tmp_path / "state/snapshot-000000000002.json").write_text(json.dumps({"/" + n: at(n) for n in reversed(names)}))
    assert reader.latestOffset() == {"version": 2} and changes(1, 2) == []
    (site / "a b").unlink()
    (site / 'a"').write_text("22")
    (site / "aa").write_text("")
    assert reader.latestOffset() == {"version": 3}
    assert changes(2, 3) == [("/a b", "remove", None), ('/a"', "modify", 2), ("/aa", "create", 0)]
    for n in site.iterdir():
        n.unlink()
    assert reader.latestOffset() == {"version": 4} == reader.latestOffset() and {x[1] for x in changes(3, 4)} == {"remove"}


def test_state_of_a_batch_that_is_run_again(spark, tmp_path):
    state = watch.StateTable(spark, str(tmp_path / "s"), "k int, v string", "k")
    rows = lambda *x: spark.createDataFrame(list(x), "k int, v string")
    none = rows((0, "")).limit(0)
    state.apply(rows((1, "a"), (2, "b")), none, 0)
    state.apply(rows((1, "c")), rows((2, "")), 1)
    state.apply(rows((3, "d")), none, 2)
    (tmp_path / "s/version=2/_SUCCESS").unlink()  # as a run leaves it that is stopped while it writes
    assert sorted(tuple(r) for r in state.read().collect()) == [(1, "c")]
    for _ in range(2):
        state.apply(rows((3, "d")), none, 2)
    assert sorted(tuple(r) for r in state.read().collect()) == [(1, "c"), (3, "d")] and state.versions() == [1, 2]


def test_stems(spark):
    known = {"caresses": "caress", "ponies": "poni", "ties": "ti", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "bled": "bled", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl", "sized": "size",
             "hopping": "hop", "tanned": "tan", "falling": "fall", "hissing": "hiss", "fizzed": "fizz", "failing": "fail", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "rational": "ration", "valenci": "valenc",
             "digitizer": "digit", "operator": "oper", "feudalism": "feudal", "decisiveness": "decis", "hopefulness": "hope", "formaliti": "formal", "sensibiliti": "sensibl", "triplicate": "triplic", "formative": "form", "electriciti": "electr", "electrical": "electr",
             "goodness": "good", "revival": "reviv", "allowance": "allow", "inference": "infer", "airliner": "airlin", "adjustable": "adjust", "replacement": "replac", "adoption": "adopt", "communism": "commun", "effective": "effect", "probate": "probat", "rate": "rate",
             "cease": "ceas", "controll": "control", "roll": "roll", "toy": "toi", "syzygy": "syzygi", "is": "is", "a1s": "a1s", "": ""}
    df = spark.createDataFrame([(list(known),)], "w array<string>")
    assert dict(zip(known, df.select(stemming.stems(F.col("w"))).first()[0], strict=True)) == known


def test_index_trees(spark):
    import json

    docs = spark.createDataFrame([(1, "go going gopher"), (2, "go " + "x" * 40)], "id int, t string")
    got = {r.letter: json.loads(r.content) for r in search.index_trees(search.inverted_index(docs, "id", ["t"]), "id").collect()}
    assert got["g"]["g"]["o"]["df"] == 2 and got["g"]["g"]["o"]["docs"] == {"1": {"tf": 1}, "2": {"tf": 1}}
    assert got["g"]["g"]["o"]["p"]["h"]["e"]["r"]["docs"] == {"1": {"tf": 1}} and "i" in got["g"]["g"]["o"]
    node = got["x"]
    for _ in range(search.DEPTH):
        node = node["x"]
    assert node["x" * 28]["df"] == 1


def test_shared_folder_is_a_uri_however_it_is_named(spark, tmp_path, monkeypatch):
    """A plain checkpoint path, or one with a single slash, is no folder of one machine."""
    forms = (f"{tmp_path}/a b/", f"file:{tmp_path}/a b", f"file://{tmp_path}/a b")
    with monkeypatch.context() as m:
        for form in forms:
            m.setattr(type(spark.conf), "get", lambda self, key, *default, form=form: form)
            assert shared.shared_dir(spark) == f"file://{tmp_path}/a b"
    for form in forms[1:]:
        publish.write_outputs(outputs(spark, 3), form)
        assert sorted(r.file for r in trees.list_tree(spark, form).collect()) == sorted(r.file for r in documents.scan_files(spark, form, "*.html").collect()) == files(tmp_path / "a b")
