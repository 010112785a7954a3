import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from sheafline.llm import sharding as H


def check(rows, texts, n=8):
    """Slots without gaps, groups together; returns the bytes of each shard."""
    slots, shards, load = defaultdict(list), defaultdict(set), [0] * n
    for r in rows:
        text = texts[r.doc_id] or ""
        assert r["size"] == len(text.encode()) + 1 and r.text_crc32 == zlib.crc32(text.encode())
        slots[r.shard].append(r.slot)
        shards[text].add(r.shard)
        load[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert all(len(s) == 1 for s in shards.values())
    return load


def test_schedule_is_longest_processing_time():
    rng = random.Random(0)
    items = [(i, rng.randint(1, 1000)) for i in range(500)]
    load = [0] * 8
    want = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        want[item] = load.index(min(load))
        load[want[item]] += size
    assert H.schedule(items, 8) == want and H.schedule([], 8) == {}


def test_given_documents(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    rows = H.op4_shard_documents(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == len(texts) and {r.law for r in rows} == {"bytes"} and {r.grown_shard for r in rows} == {None}
    load = check(rows, texts)
    assert max(load) - min(load) <= 0.002 * sum(load) / 8


def test_driver_sees_bounded_items(spark, monkeypatch):
    monkeypatch.setattr(H, "BUNDLES", 40)
    monkeypatch.setattr(H, "LARGE", 20)
    rng = random.Random(3)
    texts = {i: ("hot " * 30 if i % 3 == 0 else "w" * rng.randint(1, 200) + str(i)) for i in range(900)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(5)
    seen = []
    plain = H.schedule
    monkeypatch.setattr(H, "schedule", lambda items, n: seen.append(len(items)) or plain(items, n))
    rows = H.shard_documents(df).collect()
    load = check(rows, texts)
    hot = next(r.shard for r in rows if r.doc_id == 0)
    rest = [x for s, x in enumerate(load) if s != hot]
    assert seen[0] <= 60 and max(rest) - min(rest) <= 0.5 * max(rest)


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, 1), (2, "", 2), (None, "a", 3), (5, "a", 4), (5, "a", 4), (6, "ü" * 20000, 5)], "doc_id long, text string, shard int")
    rows = H.shard_documents(df, 3).collect()
    assert len(rows) == 6 and len({r.shard for r in rows if r["size"] == 1}) == 1 and len({r.shard for r in rows if r["size"] == 2}) == 1
    assert sorted(r["size"] for r in rows) == [1, 1, 2, 2, 2, 40001]
    assert all(sorted(r.slot for r in rows if r.shard == s) == list(range(sum(r.shard == s for r in rows))) for s in range(3))
    assert H.shard_documents(df.limit(0), 3).count() == 0


def test_groups_by_a_key(spark):
    df = spark.range(300).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"), (F.col("id") % 20).alias("site"))
    where = defaultdict(set)
    for r in H.shard_documents(df, 4, group=F.col("site")).collect():
        where[r.doc_id % 20].add(r.shard)
    assert all(len(s) == 1 for s in where.values())
