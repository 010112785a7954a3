"""Vector codes from codebooks that are fitted over anchors-hierarchy metric trees.

Vectors become integers and are cut into equal parts. Of each block of vectors, the parts
at one position are kept in a metric tree that is built from the middle out: about the
square root of the points become anchors, each anchor owns the points that are nearer to
it than to others (a new anchor takes points only from anchors that reach beyond half the
distance between the two), anchors are joined upwards into balls two by two, and each is
taken apart downwards in the same way. Every ball caches the sum and the count of its points.

A round hands each ball the list of entries that may own one of its points, shortened by
those that another entry beats everywhere in the ball. When one entry is left, it owns
the ball, and the cached sum and count are all that is needed; else the children inherit
the list. Points of a leaf are compared with the entries left, in integers. So codes are
those of a full search, ties included.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, materialize

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Components of a block, so that a task's memory does not depend on the table; points of a leaf.
BLOCK, LEAF = 1 << 20, 16
_PAIRS = 1 << 18


class Tree:
    """Points in tree order and balls over ranges of them; children follow their parents, leaves have no left child."""

    def __init__(self, points: np.ndarray):
        self._x = points.astype(np.float64)
        self._nodes: list[tuple[np.ndarray, np.ndarray, float, int, int]] = []
        root = self._grown(np.arange(len(points))) if len(points) else -1
        self._settle(points, root)

    def _ball(self, members: np.ndarray, left: int = -1, right: int = -1) -> int:
        x = self._x[members]
        centre = x.mean(0)
        self._nodes.append((members, centre, float(np.sqrt(((x - centre) ** 2).sum(1).max())), left, right))
        return len(self._nodes) - 1

    def _owners(self, x: np.ndarray, most: int) -> np.ndarray:
        """The anchor of each point: anchors are added at the point that is farthest from its own, until there are enough or no two points differ."""
        pivots = [0]
        owner = np.zeros(len(x), np.int64)
        dist = np.sqrt(((x - x[0]) ** 2).sum(1))
        while len(pivots) < most:
            far = int(dist.argmax())
            if dist[far] == 0:
                break
            half = np.sqrt(((x[pivots] - x[far]) ** 2).sum(1)) / 2
            reach = np.flatnonzero(dist > half[owner])  # of all other points, the old anchor is the nearer one
            d = np.sqrt(((x[reach] - x[far]) ** 2).sum(1))
            taken = d < dist[reach]
            owner[reach[taken]], dist[reach[taken]] = len(pivots), d[taken]
            pivots.append(far)
        return owner

    def _grown(self, members: np.ndarray) -> int:
        if len(members) <= LEAF:
            return self._ball(members)
        owner = self._owners(self._x[members], max(2, int(len(members) ** 0.5)))
        order = np.argsort(owner, kind="stable")
        cuts = np.flatnonzero(np.diff(owner[order])) + 1
        if not len(cuts):  # equal points
            return self._ball(members)
        return self._joined([self._grown(members[own]) for own in np.split(order, cuts)])

    def _joined(self, balls: list[int]) -> int:
        """Balls joined two by two, always those that make the smallest ball, until one is left."""
        n = len(balls)
        centre = np.stack([self._nodes[b][1] for b in balls])
        radius = np.array([self._nodes[b][2] for b in balls])
        cost = np.sqrt(((centre[:, None] - centre[None]) ** 2).sum(2)) + radius[:, None] + radius[None]
        np.fill_diagonal(cost, np.inf)
        for _ in range(n - 1):
            i, j = divmod(int(cost.argmin()), n)
            left, right = balls[i], balls[j]
            balls[i] = self._ball(np.concatenate([self._nodes[left][0], self._nodes[right][0]]), left, right)
            _, centre[i], radius[i], _, _ = self._nodes[balls[i]]
            cost[j], cost[:, j] = np.inf, np.inf
            met = np.isfinite(cost[i])
            cost[i, met] = np.sqrt(((centre[met] - centre[i]) ** 2).sum(1)) + radius[met] + radius[i]
            cost[met, i] = cost[i, met]
            last = i
        return balls[last]

    def _settle(self, points: np.ndarray, root: int) -> None:
        order: list[np.ndarray] = []
        start, size, left, right, centre, radius, total = [], [], [], [], [], [], []
        at, stack = 0, [(root, None)] if root >= 0 else []
        while stack:
            b, parent = stack.pop()
            members, c, r, x, y = self._nodes[b]
            if parent is not None:
                (left if left[parent] == 0 else right)[parent] = len(start)
            start.append(at)
            size.append(len(members))
            left.append(-1 if x < 0 else 0)
            right.append(-1 if x < 0 else 0)
            centre.append(c)
            radius.append(r)
            total.append(points[members].sum(0, dtype=np.int64))
            if x < 0:
                order.append(members)
                at += len(members)
            else:
                stack += [(y, len(start) - 1), (x, len(start) - 1)]
        d = points.shape[1]
        self.order = np.concatenate([np.zeros(0, np.int64), *order]).astype(np.int32)
        self.points = points[self.order]
        self.start, self.size, self.left, self.right = (np.array(v, np.int32) for v in (start, size, left, right))
        self.centre, self.total = np.array(centre).reshape(-1, d), np.array(total, np.int64).reshape(-1, d)
        self.radius = np.array(radius)
        del self._x, self._nodes

    def packed(self) -> bytes:
        return pickle.dumps(vars(self))

    @classmethod
    def unpacked(cls, data: bytes) -> Tree:
        tree = object.__new__(cls)
        vars(tree).update(pickle.loads(data))
        return tree


def _ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All numbers of the ranges, one range after the other."""
    return np.arange(int(size.sum())) + np.repeat(start - np.cumsum(size) + size, size)


def owners(tree: Tree, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner of each point in tree order, points of each entry, their sums): the nearest entry, the lowest of equally near ones."""
    k = len(entries)
    e = entries.astype(np.float64)
    ee = (e**2).sum(1)
    apart = np.sqrt(((e[:, None] - e[None]) ** 2).sum(2))
    owner = np.zeros(len(tree.points), np.int32)
    counts, sums = np.zeros(k, np.int64), np.zeros((k, tree.points.shape[1]), np.int64)
    balls = np.zeros(1 if len(tree.start) else 0, np.int64)
    open_ = np.zeros((len(balls), k), bool)
    open_[:, np.unique(entries, axis=0, return_index=True)[1] if k else []] = True  # an entry equal to a lower one never wins
    while len(balls):
        c, r = tree.centre[balls], tree.radius[balls]
        cc = (c**2).sum(1)
        d2 = cc[:, None] + ee[None] - 2 * (c @ e.T)
        rows = np.arange(len(balls))
        best = np.where(open_, d2, np.inf).argmin(1)
        # the least of |x - f|^2 - |x - best|^2 over a ball is its value at the centre less 2 r |f - best|; the slack covers rounding
        slack = 1e-6 + 1e-9 * (cc.max() + ee.max())
        beaten = d2 - d2[rows, best][:, None] > 2 * r[:, None] * apart[best] * (1 + 1e-9) + slack
        open_ &= ~beaten
        left = open_.sum(1)
        whole = left == 1
        if whole.any():
            who, b = open_[whole].argmax(1), balls[whole]
            np.add.at(counts, who, tree.size[b])
            np.add.at(sums, who, tree.total[b])
            owner[_ranges(tree.start[b], tree.size[b])] = np.repeat(who, tree.size[b])
        leaf = ~whole & (tree.left[balls] < 0)
        if leaf.any():
            b, lists = balls[leaf], open_[leaf]
            step = max(1, _PAIRS // (k * int(tree.size[b].max())))
            for at in range(0, len(b), step):
                own = b[at : at + step]
                points = _ranges(tree.start[own], tree.size[own])
                at_, entry = np.nonzero(np.repeat(lists[at : at + step], tree.size[own], 0))
                x = tree.points[points].astype(np.int64)
                d = ((x[at_] - entries[entry]) ** 2).sum(1) * k + entry  # the lower index wins a tie
                firsts = np.flatnonzero(np.concatenate([[True], at_[1:] != at_[:-1]]))
                who = np.minimum.reduceat(d, firsts) % k
                owner[points] = who
                np.add.at(counts, who, 1)
                np.add.at(sums, who, x)
        split = balls[~whole & ~leaf]
        lists = open_[~whole & ~leaf]
        balls = np.concatenate([tree.left[split], tree.right[split]]).astype(np.int64)
        open_ = np.concatenate([lists, lists])
    return owner, counts, sums


def _fine(vec: Column) -> Column:
    """Vectors whose components are all finite numbers, as many as PARTS or a multiple."""
    odd = F.exists(vec, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vec.isNotNull() & ~odd & (F.size(vec) > 0) & (F.size(vec) % PARTS == 0)


def _integers(vec: pa.ListArray, dim: int) -> np.ndarray:
    x = np.floor(vec.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim) * SCALE)
    # squared distances times the number of entries must stay whole in 64 bits
    if len(x) and np.abs(x).max() >= (most := int((2**60 / (ENTRIES * (dim // PARTS))) ** 0.5 / 2)):
        raise ValueError(f"components must lie between -{most / SCALE} and {most / SCALE}")
    return x.astype(np.int32)


def forests(vectors: DataFrame, dim: int) -> DataFrame:
    """Blocks of (id, label, vec): ids, labels, and a tree for each part position, pickled. A block has BLOCK components at most; what a task reads last is a smaller one."""
    kinds = dict(vectors.dtypes)
    rows = max(1, BLOCK // dim)

    def block(pieces: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(pieces).combine_chunks().to_batches()[0]
        x = _integers(t.column("vec"), dim).reshape(t.num_rows, PARTS, dim // PARTS)
        trees = [Tree(x[:, p]).packed() for p in range(PARTS)]
        lists = [pa.ListArray.from_arrays(pa.array([0, t.num_rows], pa.int32()), t.column(name)) for name in ("id", "label")]
        return pa.RecordBatch.from_arrays([*lists, pa.array([trees], pa.list_(pa.binary()))], names=["id", "label", "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        n = 0
        for b in batches:
            while b.num_rows:
                head = b.slice(0, rows - n)
                held.append(head)
                n += head.num_rows
                b = b.slice(head.num_rows)
                if n == rows:
                    yield block(held)
                    held, n = [], 0
        if n:
            yield block(held)

    return vectors.select("id", "label", "vec").mapInArrow(run, f"id array<{kinds['id']}>, label array<{kinds['label']}>, trees array<binary>")


def _next(blocks: DataFrame, books: np.ndarray) -> np.ndarray:
    """The codebooks [part, entry, component] after one round: means of what each entry owns, rounded down; entries that own nothing stay."""
    _, k, d = books.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sums = np.zeros((PARTS, k), np.int64), np.zeros((PARTS, k, d), np.int64)
        for b in batches:
            for p, data in ((p, data) for trees in b.column("trees") for p, data in enumerate(trees)):
                _, n, s = owners(Tree.unpacked(data.as_py()), books[p])
                counts[p] += n
                sums[p] += s
        p, e = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(counts[p, e]), pa.array(list(sums[p, e]), pa.list_(pa.int64()))],
            names=["part", "entry", "n", "sums"],
        )

    stats = blocks.select("trees").mapInArrow(run, "part int, entry int, n long, sums array<long>")
    each = stats.select("part", "entry", "n", F.posexplode("sums").alias("j", "s")).groupBy("part", "entry", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
    out = books.copy()
    for part, entry, j, n, s in each.collect():  # a number for each component of a codebook at most
        out[part, entry, j] = s // n
    return out


def fit(kept: DataFrame, blocks: DataFrame, dim: int) -> np.ndarray:
    """Codebooks [part, entry, component], started from the vectors with the ENTRIES smallest ids; fewer vectors give fewer entries."""
    first = kept.orderBy(F.col("id").asc_nulls_last(), "vec").limit(ENTRIES).select("vec").collect()
    start = _integers(pa.array([r.vec for r in first], pa.list_(pa.float64())), dim).reshape(-1, PARTS, dim // PARTS)
    books = start.transpose(1, 0, 2).astype(np.int64)
    for _ in range(ROUNDS):
        books = _next(blocks, books)
    return books


def coded(blocks: DataFrame, books: np.ndarray) -> DataFrame:
    """(id, label, code, error) of all vectors in blocks; a code is the entries of all parts, two hex digits each."""
    kinds = {f.name: f.dataType.elementType for f in blocks.schema.fields if f.name != "trees"}
    schema = T.StructType([T.StructField("id", kinds["id"]), T.StructField("label", kinds["label"]), T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                ids, labels, trees = (b.column(name)[i].values for name in ("id", "label", "trees"))
                code, error = np.zeros((len(ids), PARTS), np.uint8), np.zeros(len(ids), np.int64)
                for p, data in enumerate(trees):
                    tree = Tree.unpacked(data.as_py())
                    owner, _, _ = owners(tree, books[p])
                    code[tree.order, p] = owner
                    error[tree.order] += ((tree.points.astype(np.int64) - books[p][owner]) ** 2).sum(1)
                yield pa.RecordBatch.from_arrays([ids, labels, pa.array([x.tobytes().hex() for x in code], pa.string()), pa.array(error)], names=["id", "label", "code", "error"])

    return blocks.mapInArrow(run, schema)


def compress(vectors: DataFrame, *, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> tuple[DataFrame, np.ndarray]:
    """((id_col, label_col, code, error) of every vector kept, codebooks [part, entry, component]).

    Dropped are vectors that are null, empty or hold null, NaN or infinite components.
    The length of the vector with the smallest id holds; vectors of other lengths, and
    lengths that PARTS does not divide, cannot be coded and are dropped too. Components
    so large that squared distances leave 64 bits are an error. Repeated rows and ids
    are kept as often as they come; rows of one id start codebooks in the order of their
    components, null ids come last. Null labels stay null. No vectors give no rows and
    empty codebooks. Columns that are not named are not read.

    Blocks with their trees are written once and read by every round, so lost executors
    cost their blocks only. Sums meet as one row per task, part and entry; codebooks are
    all that passes through the driver.
    """
    c = F.col
    kept = vectors.select(c(id_col).alias("id"), c(label_col).alias("label"), c(vec_col).cast("array<double>").alias("vec")).where(_fine(c("vec")))
    smallest = kept.orderBy(c("id").asc_nulls_last(), "vec").select(F.size("vec").alias("n")).first()
    dim = smallest.n if smallest else PARTS
    kept = kept.where(F.size("vec") == dim)
    blocks = materialize(forests(kept, dim), "vector-blocks")
    books = fit(kept, blocks, dim) if smallest else np.zeros((PARTS, 0, dim // PARTS), np.int64)
    return coded(blocks, books).select(c("id").alias(id_col), c("label").alias(label_col), "code", "error"), books


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Code and error of every vector, the error of its label, and the digest of the codebooks."""
    rows, books = compress(dealt(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label")))
    rows = materialize(rows, "vector-codes")
    totals = rows.groupBy(F.col("label").alias("own")).agg(F.sum("error").alias("label_error"))
    digest = hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()
    return rows.join(totals, F.col("label").eqNullSafe(F.col("own"))).select("vec_id", "code", "error", "label_error", F.lit(digest).alias("codebooks_sha256"))


def _round_sql(n: int) -> str:
    return f"""
near{n} AS MATERIALIZED (
  SELECT r, p, min(list_sum([(t[1] - t[2]) * (t[1] - t[2]) FOR t IN list_zip(part.x, book{n}.x)])::BIGINT * {ENTRIES} + e) AS best
  FROM part JOIN book{n} USING (p) GROUP BY r, p)"""


def _book_sql(n: int) -> str:
    return f"""
mean{n} AS (
  SELECT p, e, list((s - ((s % c) + c) % c) // c ORDER BY j) AS x
  FROM (SELECT p, e, j, sum(x[j])::BIGINT AS s, count(*) AS c
        FROM (SELECT p, best % {ENTRIES} AS e, x, unnest(range(1, len(x) + 1)) AS j FROM near{n} JOIN part USING (r, p)) GROUP BY p, e, j) GROUP BY p, e),
book{n + 1} AS MATERIALIZED (SELECT p, e, coalesce(mean{n}.x, book{n}.x) AS x FROM book{n} LEFT JOIN mean{n} USING (p, e))"""


OP13_SQL = f"""
WITH vec AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, [floor({SCALE} * x::DOUBLE)::BIGINT FOR x IN embedding] AS q
  FROM embeddings WHERE embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
part AS MATERIALIZED (SELECT r, p, q[p * (len(q) // {PARTS}) + 1 : (p + 1) * (len(q) // {PARTS})] AS x FROM (SELECT r, q, unnest(range({PARTS})) AS p FROM vec)),
book0 AS (SELECT p, r - 1 AS e, x FROM part WHERE r <= {ENTRIES}),{",".join(_round_sql(n) + "," + _book_sql(n) for n in range(ROUNDS))},{_round_sql(ROUNDS)},
code AS (SELECT r, string_agg(lower(printf('%02x', best % {ENTRIES})), '' ORDER BY p) AS code, sum(best // {ENTRIES})::BIGINT AS error FROM near{ROUNDS} GROUP BY r)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
  (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) FROM book{ROUNDS}) AS codebooks_sha256
FROM vec JOIN code USING (r)
"""
