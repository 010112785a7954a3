"""SimHash fingerprints and near-duplicate classes through a byte-position index.

A 64-bit fingerprint is eight bytes at fixed positions. Fingerprints that differ in
at most four bits agree in at least four of their eight positional bytes, and so in
at least three of the first seven. Three agreeing positions are one posting list of
the index; in a list, the shared positional bytes of each pair are tallied, pairs
below the guaranteed minimum go, and the rest is verified bit by bit.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, materialize
from .components import connected_components

SHINGLE, MAX_BITS, SEED = 4, 4, 42
#: Longer posting lists are met block by block, every pair of blocks in a task of its own.
LIST_LIMIT = 4096

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]+")


def shingle_hashes(text: str | None, width: int = SHINGLE) -> np.ndarray:
    """Hashes of a text's word shingles, repeats included; of the whole sequence where it has fewer words, none without words."""
    # One space between words makes each shingle a slice of the same bytes.
    joined = _SPACE.sub(b" ", (text or "").encode("utf-8").translate(_LOWER)).strip(b" ")
    if not joined:
        return np.zeros(0, np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    n = len(gaps) + 1
    if n <= width:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], np.uint64)
    starts = [0, *(gaps[: n - width] + 1).tolist()]
    ends = [*gaps[width - 1 :].tolist(), len(joined)]
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)), np.uint64, len(starts))


def majority(hashes: np.ndarray) -> int:
    """The SimHash of hashes as an unsigned 64-bit number: bits that over half of them have; zero without hashes."""
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 8192):  # all of them, in pieces that stay small
        h = hashes[at : at + 8192].astype(">u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(hashes)).tobytes(), "big")


def fingerprint(text: str | None, width: int = SHINGLE) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit number; zero without words."""
    return majority(shingle_hashes(text, width))


def with_fingerprints(docs: DataFrame, text_col: str = "text", out: str = "fingerprint", width: int = SHINGLE) -> DataFrame:
    """docs with the fingerprint as a signed long in column `out`, which replaces one of that name."""
    docs = docs.drop(out) if out in docs.columns else docs
    schema = T.StructType([*docs.schema.fields, T.StructField(out, T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            values = np.array([fingerprint(x.as_py(), width) for x in b.column(text_col)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(values, pa.int64())], names=[*b.schema.names, out])

    return docs.mapInArrow(run, schema)


def _first_shared(equal: np.ndarray) -> np.ndarray:
    """Bit set of the first three of the seven leading positions that are equal; equal is [..., 8]."""
    lead = equal[..., :7]
    return ((lead & (lead.cumsum(-1) <= 3)) * (1 << np.arange(7))).sum(-1)


def _linked(one: np.ndarray, many: np.ndarray, combo: int, max_bits: int) -> np.ndarray:
    """Which of many link with one and have combo as their first shared positions."""
    diff = np.bitwise_xor(one, many)
    equal = diff.view(np.uint8).reshape(*diff.shape, 8) == 0
    near = equal.sum(-1) >= 8 - max_bits  # the count filter
    near &= np.bitwise_count(diff) <= max_bits  # verification
    if near.any():
        near &= _first_shared(equal) == combo
    return near


def forest(fps: np.ndarray, combo: int, max_bits: int) -> list[tuple[int, int]]:
    """Edges that span the links of one posting list: a search that meets every member once."""
    left, edges = fps, []
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            one = queue.pop()
            near = _linked(one, left, combo, max_bits)
            if near.any():
                found, left = left[near], left[~near]
                edges += [(int(one), int(x)) for x in found]
                queue += list(found)
    return edges


def _list_edges(max_bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            edges: list[tuple[int, int]] = []
            lists = b.column("fps")
            sizes = np.diff(lists.offsets.to_numpy())
            values = lists.values.to_numpy(zero_copy_only=False).view(np.uint64)
            at = lists.offsets.to_numpy()[:-1]
            combos = b.column("combo").to_numpy(zero_copy_only=False)
            two = np.flatnonzero(sizes == 2)  # nearly all lists: met together
            if len(two):
                x, y = values[at[two]], values[at[two] + 1]
                diff = x ^ y
                equal = diff.view(np.uint8).reshape(-1, 8) == 0
                near = (equal.sum(1) >= 8 - max_bits) & (np.bitwise_count(diff) <= max_bits) & (_first_shared(equal) == combos[two])
                edges += list(zip(x[near].tolist(), y[near].tolist(), strict=True))
            for i in np.flatnonzero(sizes > 2):
                edges += forest(np.unique(values[at[i] : at[i] + sizes[i]]), int(combos[i]), max_bits)
            e = np.array(edges, np.uint64).reshape(-1, 2).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], names=["a", "b"])

    return run


def fingerprint_links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints that span all links of at most max_bits differing bits.

    fps: one row per distinct fingerprint, a long column fp. Every fingerprint goes
    into 35 posting lists (three of the first seven positions and their bytes). A
    link belongs to the list of its first three shared positions only. Lists over
    LIST_LIMIT are cut into hashed blocks and every pair of blocks is met, so that
    no task holds more than LIST_LIMIT fingerprints and no link is lost. Of a list,
    only a spanning forest of its links leaves the task, never all pairs.
    """
    if max_bits > 4:
        raise ValueError("the index guarantees links of at most 4 bits")
    c = F.col
    # numpy views a number's bytes from the lowest on: position p is bits 8p to 8p + 7
    byte = [F.shiftrightunsigned("fp", 8 * p).bitwiseAND(F.lit(255)) for p in range(7)]
    combos = list(combinations(range(7), 3))
    keys = F.array(*[
        F.lit(sum(1 << p for p in t) << 24).cast("long")
        + F.shiftleft(byte[t[0]], 16) + F.shiftleft(byte[t[1]], 8) + byte[t[2]]
        for t in combos
    ])
    keyed = fps.select("fp", F.explode(keys).alias("key"))
    hot = materialize(
        keyed.groupBy("key").count().where(c("count") > LIST_LIMIT)
        .select("key", F.ceil(c("count") / (LIST_LIMIT // 4)).cast("int").alias("n")), "hot-lists")
    pair = F.struct(F.least("x", "own").alias("i"), F.greatest("x", "own").alias("j"))
    cold = keyed.join(hot, "key", "left_anti").select("fp", "key", F.lit(0).alias("i"), F.lit(0).alias("j"))
    warm = (
        keyed.join(hot, "key").withColumn("own", F.pmod(F.xxhash64("fp"), c("n")).cast("int"))
        .withColumn("x", F.explode(F.sequence(F.lit(0), c("n") - 1))).select("fp", "key", pair.alias("p"))
        .select("fp", "key", "p.i", "p.j")
    )
    every = cold if hot.isEmpty() else cold.unionByName(warm)
    lists = every.groupBy("key", "i", "j").agg(F.collect_list("fp").alias("fps")).where(F.size("fps") > 1)
    return lists.select(F.shiftright("key", 24).cast("int").alias("combo"), "fps").mapInArrow(_list_edges(max_bits), "a long, b long")


def near_duplicate_classes(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                           keep: tuple[str, ...] = (), max_bits: int = MAX_BITS, width: int = SHINGLE) -> DataFrame:
    """Every row's id, fingerprint (signed long) and component_id, with the columns in keep.

    component_id is the smallest id reachable over links. Null, empty and blank texts
    have fingerprint zero and link like any other; rows with equal fingerprints are
    one class from the start, so copies are never paired. Null ids are ignored when
    the smallest is sought (a component of null ids alone has null). An empty table
    gives an empty one. Columns of docs that are not named are not read.
    """
    c = F.col
    cols = [c(id_col).alias("__id"), c(text_col).alias("__text"), *[c(k).alias(f"__k_{k}") for k in keep if k != text_col]]
    marked = with_fingerprints(docs.select(*cols), "__text", "__fp", width)
    marked = materialize(marked if text_col in keep else marked.drop("__text"), "fingerprints")
    fps = materialize(marked.groupBy(c("__fp").alias("fp")).agg(F.min("__id").alias("first_id")), "distinct-fingerprints")
    parts = connected_components(fingerprint_links(fps.select("fp"), max_bits))
    named = fps.join(parts, fps["fp"] == parts["node"], "left").select("fp", "first_id", F.coalesce("component", "fp").alias("part"))
    least = named.groupBy("part").agg(F.min("first_id").alias("component_id"))
    classes = named.join(least, "part").select(c("fp").alias("__fp"), "component_id")
    back = [c("__text" if k == text_col else f"__k_{k}").alias(k) for k in keep]
    return marked.join(classes, "__fp").select(c("__id").alias(id_col), c("__fp").alias("fingerprint"), "component_id",
                                               *[x for x, k in zip(back, keep, strict=True) if k != id_col])


def op6_simhash_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    out = near_duplicate_classes(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
    return out.select("doc_id", F.lower(F.lpad(F.hex("fingerprint"), 16, "0")).alias("fingerprint"), "component_id")
