"""Shards of near equal bytes by longest-processing-time scheduling."""

from __future__ import annotations

import heapq

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize

#: Groups under a LARGE-th of all bytes travel in one of BUNDLES hashed bundles.
LARGE, BUNDLES = 4096, 16384
#: Slots of a shard are dealt in so many independent runs.
RUNS = 1024


def schedule(sizes: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """Longest processing time first: (item, size), largest first, each to the least-loaded shard.

    Equal sizes go in the order of their items, equal loads to the lower shard.
    """
    heap = [(0, s) for s in range(n_shards)]
    placed = {}
    for item, size in sorted(sizes, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        placed[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return placed


def shard_documents(docs: DataFrame, n_shards: int = 8, *, id_col: str = "doc_id", text_col: str = "text",
                    group: Column | None = None) -> DataFrame:
    """Puts every row into a shard: doc_id, size, text_crc32, shard, slot.

    Rows of one group stay together; by default rows of equal text are a group. The
    size of a row is its UTF-8 bytes plus one. Groups of at least a LARGE-th of all
    bytes (at most LARGE of them, whatever the input) are scheduled one by one, all
    smaller ones in BUNDLES hashed bundles, so that the heap on the driver holds at
    most LARGE + BUNDLES items at any scale and shards differ by about the smallest
    bundle, unless one group alone outweighs a shard. Slots count from 0 without
    gaps: each shard's rows are dealt into RUNS runs by hash, run totals give the
    offsets, so no task numbers a whole shard.

    A null text counts as empty (one group of size 1 each); repeated rows get a slot
    each, in no fixed order among themselves; an empty table gives an empty result.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    slim = materialize(
        docs.select(
            F.col(id_col).alias("doc_id"),
            (F.octet_length(text) + 1).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            F.unhex(F.sha2(text, 256) if group is None else F.sha2(group.cast("string"), 256)).alias("grp"),
        ),
        "sizes",
    )
    groups = slim.groupBy("grp").agg(F.sum("size").alias("bytes"))
    total = slim.agg(F.sum("size")).first()[0] or 0
    large = [bytes(r[0]) for r in groups.where(F.col("bytes") * LARGE >= total).select("grp").orderBy("grp").collect()] if total else []
    number = slim.sparkSession.createDataFrame([(g, BUNDLES + i) for i, g in enumerate(large)], "grp binary, own int")
    items = slim.join(F.broadcast(number), "grp", "left").withColumn(
        "item", F.coalesce("own", F.pmod(F.xxhash64("grp"), F.lit(BUNDLES)).cast("int"))
    )
    placed = schedule([(r[0], r[1]) for r in items.groupBy("item").agg(F.sum("size")).collect()], n_shards)
    where = slim.sparkSession.createDataFrame(sorted(placed.items()), "item int, shard int")
    dealt = items.join(F.broadcast(where), "item").select(
        "doc_id", "size", "text_crc32", "shard",
        F.pmod(F.xxhash64("doc_id", "text_crc32", F.monotonically_increasing_id()), F.lit(RUNS)).cast("int").alias("run"),
    )
    dealt = materialize(dealt, "dealt")
    return with_slots(dealt)


def with_slots(dealt: DataFrame) -> DataFrame:
    """Numbers the rows of each shard from 0, run after run; at most shards x RUNS offsets are broadcast."""
    from pyspark.sql import Window

    runs = dealt.groupBy("shard", "run").agg(F.count("*").alias("n"))
    offsets = runs.select(
        "shard", "run",
        (F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n")).alias("base"),
    )
    within = Window.partitionBy("shard", "run").orderBy("doc_id", "text_crc32", "size")
    return (
        dealt.withColumn("rn", F.row_number().over(within))
        .join(F.broadcast(offsets), ["shard", "run"])
        .select("doc_id", "size", "text_crc32", "shard", (F.col("base") + F.col("rn") - 1).alias("slot"))
    )


def op4_shard_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in shards 0 to 7 of near equal bytes, equal texts together."""
    out = shard_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"), 8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                      F.lit(None).cast("int").alias("grown_shard"))
