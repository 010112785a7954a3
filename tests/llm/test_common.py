import pytest
from pyspark.sql import functions as F

from sheafline.llm import common as C
from sheafline.llm import langid


def test_every_group_has_its_rows(spark):
    rows = [(i, f"l{i % 260}") for i in range(2600)] + [(9999, None)]
    df = spark.createDataFrame(rows, "id long, g string")
    got = C.hash_sample(df, 3, by=["id"], group="g")
    assert got.columns == ["id", "g"]
    sizes = {r.g: r["count"] for r in got.groupBy("g").count().collect()}
    assert len(sizes) == 260 and set(sizes.values()) == {3}
    again = C.hash_sample(df.repartition(5), 3, by=["id"], group="g")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, again.collect()))


def test_copies_crowd_nothing_out(spark):
    """Rows equal in the key count once; copies under other ids leave the other groups alone."""
    en = spark.range(6000).select(F.col("id"), F.lit("the same text").alias("t"), F.lit("en").alias("g"))
    fr = spark.range(100).select(F.col("id") + 10000, F.concat(F.lit("t"), "id"), F.lit("fr"))
    one = spark.range(5000).select(F.lit(7).cast("long"), F.lit("x"), F.lit("de"))
    got = C.hash_sample(en.union(fr).union(one), 50, by=["id", "t"], group="g")
    assert {r.g: r["count"] for r in got.groupBy("g").count().collect()} == {"en": 50, "fr": 50, "de": 1}


def test_all_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "EPOCHS", 1)
    rows = [(i, f"word{i % 260} " * 5, f"l{i % 260:03}") for i in range(520)] + [(1000 + i, "the same text", "many") for i in range(3000)]
    net = langid.fit(spark.createDataFrame(rows, "doc_id long, text string, lang string"), n_docs=2)
    assert len(net.languages) == 261


@pytest.mark.parametrize("asked", [None, "5"])
def test_tables_are_dealt_as_the_session_asks(spark, asked):
    df = spark.range(10).coalesce(1)
    try:
        if asked:
            spark.conf.set(C.PARTITIONS, asked)
        assert C.dealt(df).rdd.getNumPartitions() == int(asked or 1)
    finally:
        spark.conf.unset(C.PARTITIONS)


def test_renamed_columns(spark):
    inner, names = C.renamed(spark.createDataFrame([(1, 2)], "`a``b` int, text int"))
    assert inner.columns == ["c0", "c1"] and names["text"] == "c1"
