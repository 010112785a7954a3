"""Benchmark decontamination through winnowed fingerprints.

Texts are sequences of words. Of a window of m words, the smallest of its hashed
k-grams (the leftmost of equal ones) is kept with its place. What is kept depends on
the window's own words only, so a window that two texts share has the same
fingerprint in both: no shared window is missed. A text keeps about one k-gram in three.

Fingerprints of documents are joined with those of the benchmark; where one is shared,
the hit is extended to all windows of the document that it was kept for, and these are
held against the benchmark's windows by a 128-bit digest of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, join_hot, materialize

#: Words of a window; an item of fewer is one window of its own length.
WINDOW = 10
#: Bits of the bitmap that lets fingerprints of documents through; 2 MB, whatever the benchmark's size.
BITMAP_BITS = 24
#: Bytes of text that are taken apart at once, and that are hashed at once.
PORTION, CHUNK = 16 << 20, 2 << 20

_WORD = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
_RNG = np.random.default_rng(11)
_BYTE, _PLACE, _GRAM = (_RNG.integers(1, 2**63, n, dtype=np.uint64) | np.uint64(1) for n in (256, 1024, WINDOW))

_RECORD = pa.struct([("fp", pa.int64()), ("m", pa.int32()), ("start", pa.int32()), ("digests", pa.list_(pa.binary()))])
_SPARK_RECORD = "struct<fp:long,m:int,start:int,digests:array<binary>>"


def gram_words(m: int) -> int:
    """Words of a k-gram where windows have m words."""
    return m // 2 + 1


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return x ^ (x >> np.uint64(29))


class Words:
    """The words of some texts: where each begins and ends in `data`, its hash, and the first word of each text."""

    def __init__(self, texts: list[bytes | None]):
        self.data = b" " + b" ".join([x or b"" for x in texts]).translate(_WORD) + b" "
        starts, ends, hashes = [], [], []
        at = 0
        while at < len(self.data) - 1:  # cut between words; both ends of a piece are spaces
            to = self.data.find(b" ", min(at + CHUNK, len(self.data) - 1))
            x = np.frombuffer(self.data, np.uint8, to + 1 - at, at)
            inside = x != 32
            edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
            s, e = edges[::2], edges[1::2]
            if len(s):
                chars = np.flatnonzero(inside)
                lengths = e - s
                begins = np.cumsum(lengths) - lengths
                place = np.arange(len(chars)) - np.repeat(begins, lengths)
                hashes.append(_mixed(np.add.reduceat(_BYTE[x[chars]] * _PLACE[place % len(_PLACE)], begins)))
                starts.append(s + at)
                ends.append(e + at)
            at = to
        none = np.zeros(0, np.int64)
        self.starts, self.ends = np.concatenate([none, *starts]), np.concatenate([none, *ends])
        self.hashes = np.concatenate([none.astype(np.uint64), *hashes])
        sizes = np.array([len(x or b"") + 1 for x in texts], np.int64)
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(sizes)]) + 1)

    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def digest(self, i: int, m: int) -> bytes:
        """Of m words from word i on, joined by spaces."""
        gap = b" ".join(self.data[s:e] for s, e in zip(self.starts[i : i + m].tolist(), self.ends[i : i + m].tolist(), strict=True))
        return hashlib.blake2b(gap, digest_size=16).digest()

    def records(self, m: int, texts: np.ndarray, bitmap: np.ndarray | None) -> list[tuple[int, dict]]:
        """(text, record) of the fingerprints of windows of m words in the texts marked; a record has its hash and the windows that it was kept for.

        With a bitmap, only fingerprints whose bit is set.
        """
        if len(self.hashes) < m:
            return []
        k = gram_words(m)
        grams = len(self.hashes) - k + 1
        g = _mixed(reduce(np.add, (self.hashes[j : j + grams] * _GRAM[j] for j in range(k))) + np.uint64(m))
        low = np.lib.stride_tricks.sliding_window_view(g, m - k + 1).argmin(1)
        n = len(low)
        text_of = np.repeat(np.arange(len(texts)), self.counts())[:n]
        fine = texts[text_of] & (np.arange(n) + m <= self.first[1:][text_of])
        kept = np.arange(n) + low
        if bitmap is not None:
            bit = g[kept] >> np.uint64(64 - BITMAP_BITS)
            fine &= (bitmap[bit >> np.uint64(6)] >> (bit & np.uint64(63))) & np.uint64(1) == 1
        at = np.flatnonzero(fine)
        out: list[tuple[int, dict]] = []
        last = -1
        for i, p in zip(at.tolist(), kept[at].tolist(), strict=True):
            if p != last:
                t = int(text_of[i])
                out.append((t, {"fp": int(g[p].view(np.int64)), "m": m, "start": i - int(self.first[t]), "digests": []}))
                last = p
            out[-1][1]["digests"].append(self.digest(i, m))
        return out


def _portions(texts: list[bytes | None]) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about PORTION bytes together."""
    at = size = 0
    for i, x in enumerate(texts):
        size += len(x or b"")
        if size >= PORTION:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)


def _with_records(df: DataFrame, text_col: str, lengths: list[int], bitmap: np.ndarray | None) -> DataFrame:
    """df's other columns with a row number, n_words and the text's records; without a bitmap, every text has windows of its own length at most."""
    others = [x for x in df.columns if x != text_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 40
        for b in batches:
            texts = b.column(text_col).cast(pa.large_binary()).to_pylist()
            for lo, hi in _portions(texts):
                words = Words(texts[lo:hi])
                counts = words.counts()
                found: list[list[dict]] = [[] for _ in range(hi - lo)]
                for m in lengths:
                    for t, record in words.records(m, np.minimum(counts, WINDOW) == m if bitmap is None else counts >= m, bitmap):
                        found[t].append(record)
                part = b.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(x) for x in others], pa.array(range(row, row + hi - lo), pa.int64()), pa.array(counts, pa.int64()), pa.array(found, pa.list_(_RECORD))],
                    names=[*others, "__row", "__words", "__records"],
                )
                row += hi - lo

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields if f.name in others]
    return df.mapInArrow(run, ", ".join([*kinds, "__row long", "__words long", f"__records array<{_SPARK_RECORD}>"]))


def _bitmap(fps: DataFrame) -> np.ndarray:
    """The bitmap of fingerprints: of 2^24 bits at most, gathered as words of 64."""
    bit = F.shiftrightunsigned("fp", 64 - BITMAP_BITS)
    words = fps.groupBy(F.shiftright(bit, 6).alias("i")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(shiftrightunsigned(fp, {64 - BITMAP_BITS}) & 63 as int))")).alias("w"))
    out = np.zeros(1 << (BITMAP_BITS - 6), np.uint64)
    for i, w in words.collect():
        out[i] = w % 2**64
    return out


def _with_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Windows (start, m) of each row, joined where they overlap or touch to spans [start, end)."""
    for b in batches:
        spans = []
        for hits in b.column("hits").to_pylist():
            own: list[dict] = []
            for start, m in sorted((x["start"], x["m"]) for x in hits):
                if own and own[-1]["end"] >= start:
                    own[-1]["end"] = max(own[-1]["end"], start + m)
                else:
                    own.append({"start": start, "end": start + m})
            spans.append(own)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
        yield pa.RecordBatch.from_arrays([b.column("__row"), pa.array(spans, kind), b.column("set"), b.column("digests")], names=["__row", "spans", "set", "digests"])


def contamination(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
                  item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """Every row's id, its number of words (n_words), the spans of words that lie in a window of the benchmark, and the items of these windows.

    spans: array of struct(start, end), ends not included, disjoint, ascending. items:
    ids as strings, sorted, each once. Words are runs of letters, digits and non-ASCII
    characters, A-Z lower-cased. Null, empty and wordless texts have no words: they hit
    nothing, and an item of that kind has no window. Items without an id are passed
    over; rows with one item id are one item. Rows of docs are judged one by one, so
    repeated rows and ids come out as often as they come in, null ids too; empty tables
    give no rows or no hits. Columns that are not named are not read.

    The benchmark may be large: only a bitmap of 2 MB of its fingerprints is held in
    tasks, whatever passes it is joined. On the benchmark's side of every join keys are
    distinct; keys of documents with over a 4096th of the rows are dealt over salts, so
    that a passage that a third of all documents holds makes no large task. Documents
    that hit the same windows find their items once together.
    """
    c = F.col
    items = benchmark.select(c(item_col).cast("string").alias("item"), c(item_text_col).alias("text")).where(c("item").isNotNull() & c("text").isNotNull())
    windows = materialize(
        _with_records(items, "text", list(range(1, WINDOW + 1)), None)
        .select("item", F.explode("__records").alias("r"))
        .select("item", "r.fp", "r.m", F.explode("r.digests").alias("digest")).distinct(),
        "benchmark-windows",
    )
    lengths = sorted(r.m for r in windows.select("m").distinct().collect())  # ten at most
    marked = materialize(
        _with_records(docs.select(c(id_col).alias("__id"), c(text_col).alias("__text")), "__text", lengths, _bitmap(windows)),
        "document-fingerprints",
    )
    records = marked.select("__row", F.explode("__records").alias("r")).select("__row", "r.*")
    shared = join_hot(records, windows.select("fp").distinct(), "fp", by="__row")
    extended = shared.select("__row", "m", "start", F.posexplode("digests").alias("k", "digest")).select("__row", "m", (c("start") + c("k")).alias("start"), "digest")
    hits = join_hot(extended, windows.select("digest").distinct(), "digest", by="__row")
    found = materialize(
        hits.groupBy("__row").agg(F.collect_list(F.struct("start", "m")).alias("hits"), F.array_sort(F.collect_set("digest")).alias("digests"))
        .select("__row", "hits", F.sha2(F.array_join(F.transform("digests", F.hex), ""), 256).alias("set"), "digests")
        .mapInArrow(_with_spans, "__row long, spans array<struct<start:int,end:int>>, set string, digests array<binary>"),
        "hit-documents",
    )
    sets = found.groupBy("set").agg(F.first("digests").alias("digests")).select("set", F.explode("digests").alias("digest"))
    owned = sets.join(windows.select("digest", "item").distinct(), "digest").groupBy("set").agg(F.array_sort(F.collect_set("item")).alias("items"))
    named = join_hot(found.select("__row", "spans", "set"), owned, "set", by="__row").select("__row", "spans", "items")
    return marked.select("__row", "__id", "__words").join(named, "__row", "left").select(
        c("__id").alias(id_col),
        c("__words").alias("n_words"),
        F.coalesce("spans", F.expr("cast(array() as array<struct<start:int,end:int>>)")).alias("spans"),
        F.coalesce("items", F.expr("cast(array() as array<string>)")).alias("items"),
    )


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contamination of every document by the benchmark; the list of no items has the digest of the empty string."""
    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    found = contamination(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda acc, x: acc + (x["end"] - x["start"]))
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FOUND = "regexp_extract_all({}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP11_SQL = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {_FOUND.format(_LOWER.format("coalesce(text, '')"))} AS w FROM documents),
item AS (SELECT item_id, {_FOUND.format(_LOWER.format("text"))} AS w FROM benchmark WHERE text IS NOT NULL AND item_id IS NOT NULL),
item_window AS (
  SELECT DISTINCT item_id, least(len(w), {WINDOW}) AS m, array_to_string(w[i:i + least(len(w), {WINDOW}) - 1], ' ') AS t
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), {WINDOW}) + 2)) AS i FROM item WHERE len(w) > 0)),
found_window AS (SELECT DISTINCT m, t FROM item_window),
doc_window AS (
  SELECT r, i, m, array_to_string(w[i:i + m - 1], ' ') AS t
  FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM doc, (SELECT DISTINCT m FROM item_window) WHERE len(w) >= m)),
hit AS (SELECT r, i, m, t FROM doc_window SEMI JOIN found_window USING (m, t)),
word AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(range(i, i + m)) AS k FROM hit) GROUP BY r),
owner AS (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS item FROM hit JOIN item_window USING (m, t)),
list AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM owner GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc LEFT JOIN word USING (r) LEFT JOIN list USING (r)
"""
