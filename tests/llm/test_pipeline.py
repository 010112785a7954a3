import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline as P
from sheafline.llm import linequality, rules
from tests.llm.test_similar import plain_groups


def test_stages_against_plain_versions(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = {r.doc_id: r for r in docs.collect()}

    one = P.quality_rules(spark, docs, sf)
    assert one.columns == docs.columns
    field = linequality.fit(docs, labels)

    def stays(text):
        m = linequality.measure(text)
        return not m.base_failed and m.words[field.viterbi(m.x) == 0].sum() >= 0.5 * m.n_words

    want = {k for k, r in rows.items() if stays(r.text)}
    assert {r.doc_id for r in one.collect()} == want and 0 < len(want) < len(rows)

    two = P.quality_classifier(spark, one, sf)
    model = rules.fit(docs, labels)
    x = {r.doc_id: [r[f"__q_{f}"] for f in rules.FEATURES] for r in rules.with_features(one, "text").collect()}
    want = {k for k, v in x.items() if model.scores(np.array([v]))[0] >= 0.3}
    assert {r.doc_id for r in two.collect()} == want

    three = P.near_dedup(spark, two, sf)
    ids = sorted(want)
    want = {ids[i] for i in plain_groups([rows[k].text for k in ids])}
    left = three.collect()
    assert three.columns == docs.columns and {r.doc_id for r in left} == want and len(left) == len(want)
    assert all(r == rows[r.doc_id] for r in left)

    four = P.pack(spark, three, sf).collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for r in left:
        ids = b"".join(bytes(p.ids) for p in sorted((p for p in four if p.doc_id == r.doc_id), key=lambda p: p.start))
        assert np.frombuffer(ids, "<u4").tolist() == [*library.encode(r.text, add_special_tokens=False).ids, 1]

    whole = P.run(spark, sf).collect()
    key = lambda p: (p.doc_id, p.start, p.length, p.ids_crc32)
    assert {p.doc_id for p in whole} == want and sum(p.length for p in whole) == sum(p.length for p in four)
    assert len(set(map(key, whole))) == len(whole)


def test_labelled_clean_documents_stay(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    open_ = {r.doc_id for r in docs.collect() if r.doc_id in good and not linequality.measure(r.text).base_failed}
    one = P.quality_rules(spark, docs, sf)
    two = {r.doc_id for r in P.quality_classifier(spark, one, sf).collect()}
    assert len(open_ & two) >= 0.98 * len(open_)


def test_classifier_learns_from_the_whole_table_and_removes_planted_bad_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    assert rules.fit(docs, labels).rules
    one = P.quality_rules(spark, docs, sf)
    bad = docs.join(labels.where("quality = 0").select("doc_id"), "doc_id").withColumn("doc_id", F.col("doc_id") + 10**9).select(*docs.columns)
    n_bad, n_one = bad.count(), one.count()
    left = [r.doc_id for r in P.quality_classifier(spark, one.unionByName(bad), sf).collect()]
    assert n_bad > 20 and sum(k >= 10**9 for k in left) <= 0.1 * n_bad
    assert sum(k < 10**9 for k in left) >= 0.98 * n_one


def test_stages_keep_columns_of_any_name(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = ["kept", "score", "predicted", "n_words", "line_labels", "content_share", "__q_words", "prefix", "bits", "c0", "row", "a`b"]
    wide = docs.select("*", *[F.concat(F.lit(n), "doc_id").alias(n) for n in names])
    for stage in (P.quality_rules, P.quality_classifier, P.near_dedup):
        out = stage(spark, wide, sf)
        assert out.columns == wide.columns
        r = out.orderBy("doc_id").first()
        assert [v for v in r[len(docs.columns):]] == [n + str(r.doc_id) for n in names]
        assert stage(spark, wide.limit(0), sf).count() == 0
