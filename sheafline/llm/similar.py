"""Near-duplicates at a similarity of word shingles: SimHash candidates first, then what a fingerprint cannot promise.

Fingerprints of the shingles go through the byte-position index of simhash.py; what it
proposes is compared by exact shingle sets, and verified links give classes their labels.
At a similarity of 0.8 two fingerprints differ in some ten of 64 bits, so that index alone
would lose most of the weaker links. The rest meet through shingles themselves: two sets
at the threshold share a member of their prefixes, the first n - ceil(threshold * n) + 1 of
n shingles in any order that is the same for all. Every such shingle has a posting list,
rare ones come first. In a list, pairs go that have one label already, and those whose
sizes or parity bitmaps rule the threshold out: the bits in which two bitmaps differ are
at most as many as the shingles that only one text holds, so no pair is lost. What is left
is compared by exact shingle sets again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, hash_sample, materialize, renamed
from .components import connected_components
from .simhash import fingerprint_links, majority, shingle_hashes

#: Five words and a similarity of 0.8.
WIDTH, THRESHOLD = 5, 0.8
#: Bytes of a parity bitmap in a posting list; bytes of the widest bitmap of a text.
BYTES, WIDEST = 32, 8192
#: Shingles from which a posting list's bitmap tells little: pairs with such a text are met once more with wider bitmaps.
LONG = 384
#: Texts sampled for the order of shingles; shingles that come last, at most; sampled texts that hold one, at least.
SAMPLE, FREQUENT, SEEN = 4096, 65536, 3
#: Members that meet in a task: of a posting list, and of a group whose shingles are compared. Lists of up to so many members give all their pairs, longer ones what spans them.
LIST_LIMIT, GROUP_LIMIT, PAIRED = 4096, 1000, 64
#: Edges of a hub that meet it in one place.
HUB_LIMIT = 256


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct hashes of word shingles; a shorter text is one shingle."""
    return np.unique(shingle_hashes(text, width)).view(np.int64)


def search(members: np.ndarray, label: np.ndarray, near) -> list[tuple[int, int]]:
    """Edges that span all links among members of different labels; near(i, rest) tells which of rest link with i. Every member is met once, smaller ones first."""
    left, edges = members, []
    while len(left) > 1:
        one = label[left] == label[left[0]]
        queue, left = left[one].tolist(), left[~one]
        while queue and len(left):
            i = queue.pop()
            hit = near(i, left)
            if hit.any():
                found = left[hit]
                first = np.unique(label[found], return_index=True)[1]
                edges += [(i, int(x)) for x in found[first]]
                joined = np.isin(label[left], label[found])
                queue += left[joined].tolist()
                left = left[~joined]
    return edges


def prefix(shingles: np.ndarray, frequent: np.ndarray, seen: np.ndarray, threshold: float) -> np.ndarray:
    """Shingles of which any set at the threshold holds one in its own prefix: rare ones first, then those in frequent (sorted) by how often they were seen."""
    n = len(shingles)
    if not n:
        return shingles
    rank = np.zeros(n, np.int64)
    if len(frequent):
        at = np.minimum(np.searchsorted(frequent, shingles), len(frequent) - 1)
        rank = np.where(frequent[at] == shingles, seen[at], 0)
    return shingles[np.argsort(rank, kind="stable")][: n - int(np.ceil(threshold * n - 1e-6)) + 1]


def parity(shingles: np.ndarray) -> bytes:
    """A bitmap of two to four bits a shingle, within bounds: for each remainder of shingles, whether an odd number has it."""
    bits = 8 * min(max(BYTES, 1 << (len(shingles) // 4).bit_length()), WIDEST)
    return np.packbits((np.bincount(shingles & (bits - 1), minlength=bits) & 1).astype(bool)).tobytes()


def fold(bitmap: bytes, size: int = BYTES) -> np.ndarray:
    """A bitmap cut down to fewer remainders: what it would be with so many bytes."""
    return np.bitwise_xor.reduce(np.frombuffer(bitmap, np.uint8).reshape(-1, size), axis=0)


def _shingles(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in b.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(shingle_set(x.as_py(), width))], names=["shingle"])

    return run


def _frequent(docs: DataFrame, text: str, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingles, sorted, that several of SAMPLE texts hold, and how many do: FREQUENT at most. They only order prefixes, so any sample gives the same result."""
    c = F.col
    some = hash_sample(docs.select(c(text).alias("text")), SAMPLE, by=["text"])
    rows = some.select("text").mapInArrow(_shingles(width), "shingle long").groupBy("shingle").count().where(c("count") >= SEEN).orderBy(F.desc("count"), "shingle").limit(FREQUENT).collect()
    found = np.array(sorted(tuple(r) for r in rows), np.int64).reshape(-1, 2)
    return found[:, 0].copy(), found[:, 1].copy()


def _marks(text: str, out: T.StructType, frequent: np.ndarray, seen: np.ndarray, width: int, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            firsts, sizes, bits, sums, fps = [], [], [], [], []
            for x in b.column(b.schema.get_field_index(text)):
                hashes = shingle_hashes(x.as_py(), width)
                shingles = np.unique(hashes).view(np.int64)
                firsts.append(prefix(shingles, frequent, seen, threshold))
                sizes.append(len(shingles))
                bits.append(parity(shingles))
                sums.append(xxhash.xxh3_128_digest(hashes.tobytes()))  # equal shingles in equal order: equal words
                fps.append(majority(hashes))
            added = [pa.array(firsts, pa.list_(pa.int64())), pa.array(sizes, pa.int32()), pa.array(bits, pa.binary()), pa.array(sums, pa.binary()), pa.array(np.array(fps, np.uint64).view(np.int64))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=out.fieldNames())

    return run


def _members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What a posting list holds of a class: its number, label, size and bitmap, folded in small lists and whole in large ones."""
    for b in batches:
        if b.num_rows:
            numbers = np.stack([b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy().astype(np.int64)], 1)
            heads, bits = [m.tobytes() for m in numbers], b.column(3).to_pylist()
            small = [h + fold(x).tobytes() for h, x in zip(heads, bits, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(small, pa.binary()), pa.array([h + x for h, x in zip(heads, bits, strict=True)], pa.binary())], names=["cls", "member", "wide"])


def _most(size_a, size_b, threshold: float):
    """Shingles that only one of two texts at the threshold holds, at most."""
    return (1 - threshold) / (1 + threshold) * (size_a + size_b) + 1e-6


def _pairs_of_small(members: pa.Array, lengths: np.ndarray, threshold: float) -> np.ndarray:
    """All candidate pairs of lists (each of so many members, one after the other) that the folded bitmaps leave."""
    m = np.frombuffer(b"".join(members.to_pylist()), np.uint8).reshape(-1, 24 + BYTES)
    cls, label, size = m[:, :24].copy().view(np.int64).T
    bits, first = m[:, 24:].copy().view(np.uint64), np.concatenate([[0], lengths.cumsum()])[:-1]
    pairs = [np.zeros((0, 2), np.int64)]
    for n in np.unique(lengths[lengths > 1]):  # lists of one length are met together
        x, y = np.triu_indices(n, 1)
        own = first[lengths == n]
        step = max(1, (1 << 18) // len(x))
        for k in range(0, len(own), step):
            i, j = (own[k : k + step, None] + x).ravel(), (own[k : k + step, None] + y).ravel()
            limit = _most(size[j], size[i], threshold)
            hit = (label[i] != label[j]) & (np.abs(size[j] - size[i]) <= limit)
            i, j, limit = i[hit], j[hit], limit[hit]
            hit = np.bitwise_count(bits[j] ^ bits[i]).sum(1) <= limit
            pairs.append(np.stack([cls[i[hit]], cls[j[hit]]], 1))
    return np.concatenate(pairs)


def _pairs_of_large(members: list[bytes], threshold: float) -> np.ndarray:
    """Candidate pairs that span those of one list, as its whole bitmaps leave them: (a, b, 1 where they stand for themselves alone)."""
    cls, label, size = np.frombuffer(b"".join([m[:24] for m in members]), np.int64).reshape(-1, 3).T
    order = np.argsort(cls)
    if (label == label[0]).all():
        return np.zeros((0, 3), np.int64)
    bits = np.stack([fold(m[24:]) for m in members]).view(np.uint64)

    def near(i, rest):
        limit = _most(size[rest], size[i], threshold)
        out = np.abs(size[rest] - size[i]) <= limit
        out[out] = np.bitwise_count(bits[rest[out]] ^ bits[i]).sum(1) <= limit[out]
        for k in np.flatnonzero(out & (np.maximum(size[rest], size[i]) >= LONG)):
            x, y = members[i][24:], members[rest[k]][24:]
            out[k] = np.bitwise_count(fold(x, min(len(x), len(y))) ^ fold(y, min(len(x), len(y)))).sum() <= limit[k]
        return out

    found = np.array(search(order, label, near), np.int64).reshape(-1, 2)
    met = np.bincount(found.ravel(), minlength=len(cls))
    alone = (met[found] == 1).all(1) if len(found) else np.zeros(0, bool)
    return np.concatenate([cls[found], alone[:, None]], 1)


def _list_edges(threshold: float):
    """Candidate pairs (a, b) of posting lists. whole: a pair stands for itself alone, and not for others that it connects."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            large = b.column(1).to_numpy(zero_copy_only=False).astype(bool)
            small = b.column(0).filter(pa.array(~large))
            pairs = _pairs_of_small(small.flatten(), np.diff(small.offsets.to_numpy()), threshold)
            parts = [np.concatenate([pairs, np.ones((len(pairs), 1), np.int64)], 1)]
            parts += [_pairs_of_large(members, threshold) for members in b.column(0).filter(pa.array(large)).to_pylist()]
            e = np.concatenate(parts)
            e = np.unique(np.concatenate([np.sort(e[:, :2], axis=1), e[:, 2:]], 1), axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1]), pa.array(e[:, 2] == 1)], names=["a", "b", "whole"])

    return run


def _bits_alike(threshold: float):
    """Whether the whole bitmaps of two texts leave them a chance."""

    def test(n: int, x: bytes, m: int, y: bytes) -> bool:
        size = min(len(x), len(y))
        return bool(np.bitwise_count(fold(x, size) ^ fold(y, size)).sum() <= _most(n, m, threshold))

    return test


def _sets_alike(threshold: float):
    def test(_n: int, x: bytes, _m: int, y: bytes) -> bool:
        return _alike(np.frombuffer(x, np.int64), np.frombuffer(y, np.int64), threshold)

    return test


def _met(test):
    """Of rows sorted by hub and block, the hub's own before all others: edges and whether the test holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, data = 0, b""
        for b in batches:
            hubs, others, wholes, same = [], [], [], []
            for hub, other, whole, n, x in zip(*[b.column(k).to_pylist() for k in ("hub", "other", "whole", "size", "data")], strict=True):
                if other is None:
                    size, data = n, x
                else:
                    hubs.append(hub)
                    others.append(other)
                    wholes.append(whole)
                    same.append(test(size, data, n, x))
            yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(others, pa.int64()), pa.array(wholes, pa.bool_()), pa.array(same, pa.bool_())], names=["hub", "other", "whole", "same"])

    return run


def compare(edges: DataFrame, data: DataFrame, test) -> DataFrame:
    """edges (a, b, whole) with a column same: what the test says of the data (cls, size, data) of a and b.

    The end with more edges is the hub. Its data travel once for each block of HUB_LIMIT
    edges, and the other end's once an edge, so a text with very many neighbours is
    neither one task nor copied for each of them.
    """
    c = F.col
    ends = edges.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").count()
    degree = lambda k: ends.select(c("cls").alias(k), c("count").alias(f"n_{k}"))
    first = c("n_a") >= c("n_b")
    aimed = edges.join(degree("a"), "a").join(degree("b"), "b").select(
        F.when(first, c("a")).otherwise(c("b")).alias("hub"), F.when(first, c("b")).otherwise(c("a")).alias("other"), "whole",
        F.ceil(F.greatest("n_a", "n_b") / HUB_LIMIT).cast("int").alias("n")).withColumn("block", F.pmod(F.xxhash64("other"), c("n")).cast("int"))
    aimed = materialize(aimed.select("hub", "block", "other", "whole"), "aimed-edges")
    others = aimed.join(data.withColumnRenamed("cls", "other"), "other").select("hub", "block", "other", "whole", "size", "data")
    hubs = aimed.select("hub", "block").distinct().join(data.withColumnRenamed("cls", "hub"), "hub").selectExpr("hub", "block", "CAST(NULL AS BIGINT) AS other", "CAST(NULL AS BOOLEAN) AS whole", "size", "data")
    sorted_ = others.unionByName(hubs).repartition("hub", "block").sortWithinPartitions("hub", "block", c("other").asc_nulls_first())
    met = sorted_.select("hub", "other", "whole", "size", "data").mapInArrow(_met(test), "hub long, other long, whole boolean, same boolean")
    return met.select(F.least("hub", "other").alias("a"), F.greatest("hub", "other").alias("b"), "whole", "same")


def unruled(edges: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """Of edges (a, b, whole), those that whole bitmaps do not rule out. Edges that only span a list have been through that."""
    alone = compare(edges.where("whole"), classes.select("cls", "size", F.col("bits").alias("data")), _bits_alike(threshold)).where("same")
    return alone.select("a", "b", "whole").unionByName(edges.where("NOT whole").select("a", "b", "whole"))


def _sets(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.list_(pa.int64()))], names=["cls", "shingles"])

    return run


def _set_bytes(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py(), width) for x in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(x) for x in sets], pa.int32()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["cls", "size", "data"])

    return run


def _alike(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether two sets without repeats reach the threshold."""
    shared = len(a) + len(b) - len(np.union1d(a, b))
    return shared >= threshold * (len(a) + len(b) - shared) - 1e-9


def verify(edges: DataFrame, texts: DataFrame, threshold: float, width: int = WIDTH) -> DataFrame:
    """edges (a, b, whole) with a column same, written: whether the shingle sets of the texts (cls, text) of a and b reach the threshold."""
    ends = edges.select(F.explode(F.array("a", "b")).alias("cls")).distinct()
    sets = materialize(ends.join(texts, "cls").select("cls", "text").mapInArrow(_set_bytes(width), "cls long, size int, data binary"), "set-bytes")
    out = materialize(compare(edges, sets, _sets_alike(threshold)), "verified")
    discard(sets)
    return out


def _group_edges(threshold: float):
    """Edges that span the links between labels of one task: a block of a group, or two."""

    def run(t: pa.Table) -> pa.Table:
        t = t.sort_by("cls")
        cls, lists = t["cls"].to_numpy(), t["shingles"].combine_chunks()
        label = np.unique(t["label"].to_numpy(), return_inverse=True)[1]
        offsets = lists.offsets.to_numpy()
        _, column = np.unique(lists.values.to_numpy()[offsets[0] : offsets[-1]], return_inverse=True)
        at = offsets - offsets[0]
        size = np.diff(at)
        own = np.zeros(int(column.max()) + 1 if len(column) else 1, bool)

        def near(i, rest):
            own[column[at[i] : at[i + 1]]] = True
            hits = np.concatenate([[0], own[column].cumsum()])
            shared = hits[at[rest + 1]] - hits[at[rest]]
            own[column[at[i] : at[i + 1]]] = False
            return shared >= threshold * (size[i] + size[rest] - shared) - 1e-9

        e = np.array([(cls[i], cls[j]) for i, j in search(np.arange(len(cls)), label, near)], np.int64).reshape(-1, 2)
        return pa.table({"a": e[:, 0], "b": e[:, 1]})

    return run


def fingerprint_edges(classes: DataFrame) -> DataFrame:
    """Candidates (a, b, whole) of the SimHash index: edges that span the links of fingerprints, and classes of one fingerprint with the first of them."""
    c = F.col
    fps = materialize(classes.groupBy("fp").agg(F.min("cls").alias("first")), "distinct-fingerprints")
    name = lambda k: fps.select(c("fp").alias(k), c("first").alias(f"cls_{k}"))
    linked = fingerprint_links(fps.select("fp")).join(name("a"), "a").join(name("b"), "b").select(c("cls_a").alias("a"), c("cls_b").alias("b"))
    equal = classes.select("cls", "fp").join(fps, "fp").where("cls <> first").select(c("first").alias("a"), c("cls").alias("b"))
    return linked.unionByName(equal).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.lit(True).alias("whole")).distinct()


def list_edges(classes: DataFrame, labels: DataFrame, threshold: float) -> DataFrame:
    """Candidates (a, b, whole) of the posting lists, between classes of different labels (cls, label).

    Lists over LIST_LIMIT are met block by block, every pair of blocks in a task of its own.
    """
    c = F.col
    keyed = classes.select("cls", F.explode("prefix").alias("key"))
    blocks = F.when(c("count") > LIST_LIMIT, F.ceil(c("count") / (LIST_LIMIT // 2))).otherwise(1).cast("int")
    shared = materialize(keyed.groupBy("key").count().where("count > 1").select("key", blocks.alias("n"), (c("count") > PAIRED).alias("large")), "shared-keys")
    cut = keyed.join(shared, "key").withColumn("own", F.pmod(F.xxhash64("cls"), c("n")).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), c("n") - 1)))
    member = classes.join(labels, "cls", "left").select("cls", F.coalesce("label", "cls").alias("label"), "size", "bits").mapInArrow(_members, "cls long, member binary, wide binary")
    met = cut.select("key", "large", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), "cls").join(member, "cls").withColumn("member", F.when(c("large"), c("wide")).otherwise(c("member")))
    lists = met.groupBy("key", "i", "j", "large").agg(F.collect_list("member").alias("members")).where(F.size("members") > 1)
    return lists.select("members", "large").mapInArrow(_list_edges(threshold), "a long, b long, whole boolean").groupBy("a", "b").agg(F.min("whole").alias("whole"))


def rest_edges(groups: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """Edges (a, b) that span the verified links between labels of each group; groups: (cls, grp, label).

    Groups over GROUP_LIMIT are cut into blocks: a label that fills one has blocks of its
    own, all others share theirs. Pairs of blocks are met but for those of one label, so the
    work of a group grows with what has no label in common with its largest part.
    """
    c = F.col
    half = GROUP_LIMIT // 2
    sizes = groups.groupBy("grp", "label").count()
    own = c("count") >= half
    total = sizes.groupBy("grp").agg(F.sum("count").alias("all"), F.sum(F.when(own, 0).otherwise(c("count"))).alias("small"))
    parts = sizes.join(total, "grp").select(
        "grp", "label", F.when((c("all") > GROUP_LIMIT) & own, c("label")).alias("pure"),
        F.when(c("all") <= GROUP_LIMIT, 1).when(own, F.ceil(c("count") / half)).otherwise(F.ceil(c("small") / half)).cast("int").alias("n"))
    placed = materialize(groups.join(parts, ["grp", "label"]).withColumn("block", F.struct("pure", F.pmod(F.xxhash64("cls"), c("n")).cast("int").alias("k"))).drop("n"), "placed")
    others = placed.select("grp", "block").distinct().groupBy("grp").agg(F.collect_list("block").alias("blocks"))
    other = F.explode(F.filter("blocks", lambda x: c("pure").isNull() | x["pure"].isNull() | (x["pure"] != c("pure"))))
    met = placed.join(others, "grp").select("grp", "cls", "label", "block", other.alias("x"))
    tasks = met.select("grp", F.least("block", "x").alias("i"), F.greatest("block", "x").alias("j"), "cls", "label").join(sets, "cls")
    return tasks.groupBy("grp", "i", "j").applyInArrow(_group_edges(threshold), "a long, b long")


def similar_classes(classes: DataFrame, texts: DataFrame, *, width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """(node, component) of all classes (cls, fp, prefix, size, bits) that have a verified link; texts: (cls, text) of one row of each."""
    c = F.col
    near = materialize(unruled(materialize(fingerprint_edges(classes), "fingerprint-edges"), classes, threshold), "near-fingerprints")
    sure = verify(near, texts, threshold, width).where("same").select("a", "b")
    labels = sure.groupBy(c("b").alias("cls")).agg(F.min("a").alias("label"))  # whoever links with the same one is of one class
    found = materialize(unruled(materialize(list_edges(classes, labels, threshold), "list-edges"), classes, threshold), "near-lists")
    checked = verify(found, texts, threshold, width)
    links = sure.unionByName(checked.where("same").select("a", "b"))
    parts = materialize(connected_components(links), "labels")
    # pairs that only span a list and failed stand for others that were not compared
    label = lambda k: parts.select(c("node").alias(k), c("component").alias(f"label_{k}"))
    open_ = checked.where("NOT same AND NOT whole").join(label("a"), "a", "left").join(label("b"), "b", "left")
    open_ = materialize(open_.select(F.coalesce("label_a", "a").alias("a"), F.coalesce("label_b", "b").alias("b")).where("a <> b"), "open-labels")
    if open_.isEmpty():
        return parts
    groups = materialize(connected_components(open_).toDF("label", "grp"), "open-groups")
    every = parts.select(c("node").alias("cls"), c("component").alias("label"))
    every = every.unionByName(groups.select(c("label").alias("cls"), "label").join(every, "cls", "left_anti"))
    members = every.join(groups, "label").select("cls", "grp", "label")
    sets = members.select("cls").join(texts, "cls").select("cls", "text").mapInArrow(_sets(width), "cls long, shingles array<long>")
    return connected_components(links.unionByName(materialize(rest_edges(members, sets, threshold), "rest-links")))


def keep_one(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, threshold: float = THRESHOLD) -> DataFrame:
    """docs with one row of each class of near-duplicates: the one with the smallest id; of rows of one id, any one.

    Texts are near-duplicates when the Jaccard similarity of their word shingles is at
    least the threshold, or when their words are the same; classes are what such
    links reach. Null, empty and blank texts are one class. Rows with null ids stay
    only where a class has no other. All columns are kept as they are, whatever their
    names; an empty table gives an empty one. The index proposes every pair at the
    threshold, so nothing is missed; the tests hold it against brute force.
    """
    c = F.col
    inner, names = renamed(docs)
    own, text = names[id_col], names[text_col]
    out = T.StructType([*inner.schema.fields, T.StructField("prefix", T.ArrayType(T.LongType())), T.StructField("size", T.IntegerType()),
                        T.StructField("bits", T.BinaryType()), T.StructField("same", T.BinaryType()), T.StructField("fp", T.LongType())])
    marked = materialize(inner.mapInArrow(_marks(text, out, *_frequent(inner, text, width), width, threshold), out).withColumn("row", F.monotonically_increasing_id()), "marked")
    least = F.struct(c(own).isNull().alias("none"), c(own).alias("id"), c("row").alias("row"))
    classes = materialize(marked.groupBy("same").agg(F.min("row").alias("cls"), *[F.first(k).alias(k) for k in ("fp", "prefix", "size", "bits")], F.min(least).alias("least")), "classes")
    texts = marked.select(c("row").alias("cls"), c(text).alias("text"))
    parts = similar_classes(classes, texts, width=width, threshold=threshold)
    named = classes.select("cls", "least").join(parts, c("cls") == c("node"), "left").select(F.coalesce("component", "cls").alias("part"), "least")
    stays = named.groupBy("part").agg(F.min("least").alias("least")).select(c("least.row").alias("row"))
    return marked.join(stays, "row", "left_semi").select(*inner.columns).toDF(*docs.columns)
