"""Embedding near-duplicates through randomised-rotation binary codes.

A unit vector o is rotated by one random rotation and kept as the signs of its
coordinates, a code x = signs / sqrt(D), with the correction factor f = <x, o>. For
any unit vector q, <x, q> / f estimates <o, q> without bias, because the part of x
that is orthogonal to o points in a random direction e: <x, q> = f <o, q> +
sqrt(1 - f^2) <e, q>. The other side of a pair is kept as LEVELS bit planes of its
rotated coordinates, so that an estimate is a few ANDs and bit counts over packed words.

A pair is recomputed in double precision when, with the confidence asked for, it may
reach the threshold: first by the bits in which two codes differ, then by the estimate
and its interval. All other pairs are ruled out by their codes alone. Which pairs meet
at all is decided by cells: every vector goes to its nearest pivots, all those that,
with the same confidence, a partner may have as its nearest one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from statistics import NormalDist

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import hash_sample, materialize
from .components import connected_components

#: Vectors of a cell that meet in a task: two blocks of so many. Pivots: the square root of the rows, so many at most. Bit planes of a coordinate.
BLOCK, PIVOTS, LEVELS = 4096, 16384, 4
#: One-sided confidence of every bound; with 1, the bounds always hold.
CONFIDENCE = 0.9999
#: Vectors of the sample that are compared with all rows to measure how wide probes must be, steps of the width, share of partners that may be missed.
QUERIES, STEPS, MISSED = 256, 64, 0.001
_ROWS, _PAIRS = 512, 65536


def rotation(dim: int, seed: int = 7) -> np.ndarray:
    """A random rotation, the same on every executor."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def unit(x: np.ndarray) -> np.ndarray:
    """Rows of x, none of them zero, at length one; scaled first, so that no square overflows or vanishes."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _words(bits: np.ndarray) -> np.ndarray:
    """Bits [n, d] packed into 64-bit words [n, w]."""
    packed = np.packbits(bits, axis=-1)
    return np.pad(packed, [(0, 0)] * (packed.ndim - 1) + [(0, -packed.shape[-1] % 8)]).view(np.uint64)


def deviations(confidence: float) -> float:
    """Standard deviations of the one-sided bound; infinite at confidence 1."""
    return np.inf if confidence >= 1 else NormalDist().inv_cdf(confidence)


def slack(factors: np.ndarray, steps: np.ndarray, threshold: float, dim: int, confidence: float) -> np.ndarray:
    """How far below the threshold the estimate of a pair at or above it can fall: by the code's direction, and by rounding to bit planes (steps apart)."""
    z, f = deviations(confidence), np.clip(factors, 1e-6, 1.0)
    code = min(1.0, z / np.sqrt(max(dim - 1, 1))) * np.sqrt(1 - f * f) * np.sqrt(max(0.0, 1 - threshold * threshold))
    return (code[:, None] + min(np.sqrt(dim) / 2, z / np.sqrt(12)) * steps[None, :]) / f[:, None] + 1e-6


@dataclass
class Codes:
    """Codes of vectors of one length: sign words [n, w], bit planes [n, levels, w], and four numbers [n, 4]: factor, lowest coordinate, step, sum of a vector's levels."""

    dim: int
    signs: np.ndarray
    planes: np.ndarray
    numbers: np.ndarray

    @classmethod
    def of(cls, o: np.ndarray, seed: int = 7) -> Codes:
        """Codes of unit vectors."""
        n, dim = o.shape
        q = o @ rotation(dim, seed).T
        low = q.min(1)
        step = np.maximum((q.max(1) - low) / (2**LEVELS - 1), 1e-12)
        noise = np.random.default_rng(seed).random(dim)  # rounding up or down at random keeps estimates unbiased
        u = np.clip(np.floor((q - low[:, None]) / step[:, None] + noise), 0, 2**LEVELS - 1).astype(np.uint8)
        planes = np.stack([_words((u >> k) & 1) for k in range(LEVELS)], 1)
        return cls(dim, _words(q >= 0), planes, np.stack([np.abs(q).sum(1) / np.sqrt(dim), low, step, u.sum(1)], 1))

    def pack(self) -> list[bytes]:
        return [a.tobytes() + b.tobytes() + c.tobytes() for a, b, c in zip(self.signs, self.planes, self.numbers, strict=True)]

    @classmethod
    def unpack(cls, packed: list[bytes], dim: int) -> Codes:
        w = -(-dim // 64)
        rows = np.frombuffer(b"".join(packed), np.uint64).reshape(-1, w * (1 + LEVELS) + 4)
        return cls(dim, rows[:, :w].copy(), rows[:, w : w * (1 + LEVELS)].reshape(-1, LEVELS, w).copy(), rows[:, w * (1 + LEVELS) :].copy().view(np.float64))

    def estimates(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Unbiased estimates of the inner products of vectors i, by their signs, with vectors j, by their bit planes."""
        signs, total = self.signs[i], np.zeros(len(i))
        for k in range(LEVELS):
            total += np.bitwise_count(signs & self.planes[j, k]).sum(1, dtype=np.int64) << k
        f, (low, step, levels) = self.numbers[i, 0], self.numbers[j, 1:].T
        ones = np.bitwise_count(signs).sum(1, dtype=np.int64)
        return (2 * (low * ones + step * total) - (self.dim * low + step * levels)) / (np.sqrt(self.dim) * f)

    def most_bits(self, threshold: float, confidence: float) -> float:
        """Bits in which the codes of a pair at the threshold differ, at most."""
        p, z = np.arccos(np.clip(threshold, -1, 1)) / np.pi, deviations(confidence)
        return min(float(self.dim), self.dim * p + (z * np.sqrt(self.dim * p * (1 - p)) + 1 if np.isfinite(z) else self.dim))

    def candidates(self, left: np.ndarray, right: np.ndarray, threshold: float, confidence: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Pairs (i of left, j of right) that may reach the threshold, in portions; where both are the same, i < j."""
        most, same = self.most_bits(threshold, confidence), left is right
        for at in range(0, len(left), _ROWS):
            a = left[at : at + _ROWS]
            differ = np.zeros((len(a), len(right)), np.uint16)
            for k in range(self.signs.shape[1]):
                differ += np.bitwise_count(self.signs[a, k, None] ^ self.signs[None, right, k])
            i, j = np.nonzero(differ <= most)
            i, j = a[i], right[j]
            if same:
                i, j = i[i < j], j[i < j]
            for k in range(0, len(i), _PAIRS):
                x, y = i[k : k + _PAIRS], j[k : k + _PAIRS]
                loss = slack(self.numbers[x, 0], np.zeros(1), threshold, self.dim, confidence)[:, 0]
                loss += min(np.sqrt(self.dim) / 2, deviations(confidence) / np.sqrt(12)) * self.numbers[y, 2] / np.clip(self.numbers[x, 0], 1e-6, 1)
                near = self.estimates(x, y) >= threshold - loss
                yield x[near], y[near]


def usual_width(dim: int, confidence: float) -> float:
    """How far a direction of its own leans towards another one, where directions are random."""
    return min(1.0, deviations(confidence) / np.sqrt(max(dim - 1, 1)))


def probes(o: np.ndarray, pivots: np.ndarray, threshold: float, width: float) -> list[np.ndarray]:
    """For each unit vector, its cells: sorted numbers of the nearest pivot and of all that a partner may have as its nearest.

    Say that a partner at the threshold's angle is nearer to its pivot than this vector,
    at the angle b, is to its own. Then this vector lies from that pivot at most at the
    angle whose cosine is below. The width is the cosine between the direction of the
    pivot and that of the partner, as seen from here; with width 1 the angle is b plus the
    threshold's, which always holds. See needed_width.
    """
    if not len(pivots):
        return [np.zeros(1, np.int32)] * len(o)
    z, out = width, []
    sine = np.sqrt(max(0.0, 1 - threshold * threshold))
    for at in range(0, len(o), 1024):
        cos = np.clip(o[at : at + 1024] @ pivots.T, -1, 1)
        best = cos.max(1)
        reach = threshold * best - z * sine * np.sqrt(1 - best * best) - 1e-9
        out += [np.flatnonzero(row >= low).astype(np.int32) for row, low in zip(cos, reach, strict=True)]
    return out


def needed_width(o: np.ndarray, other: np.ndarray, pivots: np.ndarray, threshold: float) -> np.ndarray:
    """The smallest width of probes with which unit vectors o and other, row by row, are sure to share a cell."""
    cos = [np.clip(x @ pivots.T, -1, 1) for x in (o, other)]
    best = [c.argmax(1) for c in cos]
    rows, sine, needs = np.arange(len(o)), np.sqrt(max(1e-18, 1 - threshold * threshold)), []
    for one, two in ((0, 1), (1, 0)):
        top = cos[one][rows, best[one]]
        lean = (threshold * top - cos[one][rows, best[two]]) / (sine * np.sqrt(np.maximum(1e-12, 1 - top * top)))
        needs.append(np.where(best[0] == best[1], 0.0, lean))
    return np.clip(np.minimum(*needs), 0.0, 1.0)


def _widths(queries: list[tuple[object, np.ndarray]], pivots: dict[int, np.ndarray], threshold: float):
    """Counts of true partners of the queries (label, unit vector), by query and needed width in STEPS steps."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((len(queries), STEPS + 1), np.int64)
        for b in batches:
            labels, vectors = b.column("label").to_pylist(), b.column("embedding")
            sizes = np.array([n or 0 for n in pc.list_value_length(vectors).to_pylist()], np.int64)
            for dim in set(pivots) & set(sizes.tolist()):
                at = np.flatnonzero(sizes == dim)
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                o, own = unit(x[good]), [labels[i] for i in at[good]]
                mine = [k for k, (_, q) in enumerate(queries) if len(q) == dim]
                if not len(o) or not mine:
                    continue
                q = np.stack([queries[k][1] for k in mine])
                for from_ in range(0, len(o), 4096):
                    cos = o[from_ : from_ + 4096] @ q.T
                    i, k = np.nonzero((cos >= threshold) & (cos < 1 - 1e-12))
                    same = [own[from_ + a] is not None and own[from_ + a] == queries[mine[c]][0] for a, c in zip(i.tolist(), k.tolist(), strict=True)]
                    i, k = i[same], k[same]
                    for part in range(0, len(i), 1024):
                        rows, cols = i[part : part + 1024], k[part : part + 1024]
                        need = needed_width(o[from_ + rows], q[cols], pivots[dim], threshold)
                        np.add.at(counts, (np.array(mine)[cols], np.ceil(need * STEPS - 1e-9).astype(int)), 1)
        query, step = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(query.astype(np.int32)), pa.array(step.astype(np.int32)), pa.array(counts[query, step])], names=["query", "step", "n"])

    return run


def measured_width(vectors: DataFrame, pivots: dict[int, np.ndarray], queries: list[tuple[object, np.ndarray]], threshold: float, usual: float) -> float:
    """The width at which at most MISSED of the true partners of each of the queries, on average, and of all of them together can be missed; the usual one at least.

    The queries are compared with all rows in one pass without a shuffle; what comes back
    is a count for each query and step of the width.
    """
    if usual >= 1 or not queries:
        return usual
    rows = vectors.select("label", "embedding").mapInArrow(_widths(queries, pivots, threshold), "query int, step int, n long").groupBy("query", "step").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros((len(queries), STEPS + 1))
    for query, step, n in rows:
        counts[query, step] = n
    counts = counts[counts.any(1)]
    if not len(counts):
        return usual
    beyond = np.concatenate([counts[:, ::-1].cumsum(1)[:, ::-1][:, 1:], np.zeros((len(counts), 1))], 1)  # partners that need more than a step
    missed = np.maximum((beyond / counts.sum(1, keepdims=True)).mean(0), beyond.sum(0) / counts.sum())
    return max(usual, float(np.flatnonzero(missed <= MISSED)[0]) / STEPS)


def _prepare(pivots: dict[int, np.ndarray], threshold: float, widths: dict[int, float]):
    """Adds dim, same (a digest of the vector), code and cells; all null for vectors that link with nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            vectors, n = b.column("embedding"), b.num_rows
            dims, same, codes, cells = [None] * n, [None] * n, [None] * n, [None] * n
            by_dim: dict[int, list[int]] = {}
            for i, size in enumerate(pc.list_value_length(vectors).to_pylist()):
                if size:
                    by_dim.setdefault(size, []).append(i)
            for dim, at in by_dim.items():
                x = vectors.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                good = np.isfinite(x).all(1) & (x != 0).any(1)  # a null component has become NaN
                if good.any():
                    x = x[good] + 0.0  # one zero only
                    o = unit(x)
                    packed, own = Codes.of(o).pack(), probes(o, pivots.get(dim, np.zeros((0, dim))), threshold, widths.get(dim, 1.0))
                    for k, i in enumerate(np.array(at)[good]):
                        dims[i], same[i], codes[i], cells[i] = dim, xxhash.xxh3_128_digest(x[k].tobytes()), packed[k], own[k]
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(dims, pa.int32()), pa.array(same, pa.binary()), pa.array(codes, pa.binary()), pa.array(cells, pa.list_(pa.int32()))],
                names=[*b.schema.names, "dim", "same", "code", "cells"])

    return run


class _Meeting:
    """The vectors of one task: one block of a cell, or two."""

    def __init__(self, t: pa.Table):
        self.cell, dim = t["cell"][0].as_py(), t["dim"][0].as_py()
        self.codes = Codes.unpack(t["code"].to_pylist(), dim)
        side = t["side"].to_numpy()
        if t["i"][0].as_py() == t["j"][0].as_py():
            self.left = self.right = np.arange(len(side))
        else:
            self.left, self.right = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        earlier = [[k for k in c if k < self.cell] for c in t["cells"].to_pylist()]
        names = {k: i for i, k in enumerate(sorted(set().union(*earlier)))}
        bits = np.zeros((len(side), len(names)), bool)
        for i, c in enumerate(earlier):
            bits[i, [names[k] for k in c]] = True
        self.earlier = _words(bits)

    def pairs(self, threshold: float, confidence: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Candidates that meet in no earlier cell, so that every pair counts once."""
        most = max(1, (1 << 22) // max(1, self.earlier.shape[1]))
        for i, j in self.codes.candidates(self.left, self.right, threshold, confidence):
            for k in range(0, len(i), most):
                x, y = i[k : k + most], j[k : k + most]
                first = ~(self.earlier[x] & self.earlier[y]).any(1)
                yield x[first], y[first]


def _survivors(threshold: float, confidence: float):
    """Of the vectors of a task, those with a candidate partner."""

    def run(t: pa.Table) -> pa.Table:
        hit = np.zeros(t.num_rows, bool)
        for i, j in _Meeting(t).pairs(threshold, confidence):
            hit[i] = hit[j] = True
        return t.filter(pa.array(hit))

    return run


def _verified(threshold: float, confidence: float):
    """For each vector of a task, how many others link with it, counting equal vectors, and an edge to the first of its part."""

    def run(t: pa.Table) -> pa.Table:
        rows, w = t["row"].to_numpy(), t["w"].to_numpy()
        x = unit(t["embedding"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(rows), -1))
        count, label = np.zeros(len(rows), np.int64), np.arange(len(rows))
        for i, j in _Meeting(t).pairs(threshold, confidence):
            near = np.concatenate([np.einsum("ij,ij->i", x[i[k : k + 8192]], x[j[k : k + 8192]]) for k in range(0, len(i), 8192)] or [np.zeros(0)]) >= threshold
            i, j = i[near], j[near]
            count += np.bincount(i, w[j], len(rows)).astype(np.int64) + np.bincount(j, w[i], len(rows)).astype(np.int64)
            cut = np.flatnonzero(np.diff(i)) + 1
            for one, others in zip(i[np.r_[0, cut]] if len(i) else [], np.split(j, cut), strict=True if len(i) else False):
                names = np.unique(label[np.r_[one, others]])
                if len(names) > 1:
                    label[np.isin(label, names)] = names[0]
        out = np.flatnonzero(count)
        return pa.table({"row": rows[out], "n": count[out], "other": rows[label[out]]})

    return run


def _fit_pivots(vectors: DataFrame) -> tuple[dict[int, np.ndarray], list[tuple[object, np.ndarray]]]:
    """Pivots of each length: unit vectors of a hashed sample, of the square root of the rows and at most PIVOTS; lengths that it does not hold have one cell. And (label, unit vector) of QUERIES of them."""
    n = max(1, min(PIVOTS, int(np.ceil(np.sqrt(vectors.count())))))
    usable = vectors.where("embedding IS NOT NULL AND size(embedding) > 0").select("label", "embedding", F.xxhash64("vec_id", "embedding").alias("h"))
    found: dict[int, list] = {}
    queries: list[tuple[object, np.ndarray]] = []
    for k, r in enumerate(sorted(hash_sample(usable, max(QUERIES, n), by=["h"]).collect(), key=lambda r: r.h)):
        v = np.array(r.embedding, float)
        if np.isfinite(v).all() and v.any():
            if k < n:
                found.setdefault(len(v), []).append(v)
            if r.label is not None and len(queries) < QUERIES:
                queries.append((r.label, unit(v[None])[0]))
    return {dim: unit(np.unique(np.array(x), axis=0)) for dim, x in sorted(found.items())}, queries


def embedding_classes(vectors: DataFrame, threshold: float = 0.98, *, id_col: str = "vec_id", vector_col: str = "embedding",
                      label_col: str = "label", confidence: float = CONFIDENCE) -> DataFrame:
    """One row per vector: id, n_links, component_id and kept.

    Vectors of equal, non-null label and equal length link at a cosine of at least
    the threshold, in double precision. Null vectors, zero vectors and those with a
    null or non-finite component link with nothing. Repeated rows are vectors of
    their own that link with each other; component_id is the smallest id reachable.
    An empty table gives an empty one; only the three named columns are read.

    Equal vectors of a label are one with a count. Every other vector goes, as a code,
    to a few cells; cells over BLOCK are met block by block. Whole vectors follow only
    where a code has found a candidate, and only link counts and spanning edges leave
    a task.

    Two things can lose a link. Codes do so with a chance of about 1 - confidence for
    each of their bounds, as the rotation is random. Cells do where vectors lie in few
    dimensions, as partners then lie in the direction of other pivots: so 256 hashed
    vectors are compared with all rows, and cells are widened until at most a
    thousandth of their true partners share none. Measured on 200 to 4,000 vectors in 2, 3
    and 4 dimensions of 64, 384 and 1,536: see tests/llm/test_embeddings.py, which
    demands 0.99 of the links. Confidence 1 misses none, but sends a vector to more
    cells and recomputes more pairs. A cosine counts as the double precision product of
    the vectors at length one gives it, so a pair at exactly the threshold is on the
    side that this product's last bit takes.
    """
    c = F.col
    vectors = vectors.select(F.monotonically_increasing_id().alias("row"), c(id_col).cast("long").alias("vec_id"),
                             c(label_col).alias("label"), c(vector_col).cast("array<double>").alias("embedding"))
    schema = T.StructType([*vectors.schema.fields, T.StructField("dim", T.IntegerType()), T.StructField("same", T.BinaryType()), T.StructField("code", T.BinaryType()), T.StructField("cells", T.ArrayType(T.IntegerType()))])
    pivots, queries = _fit_pivots(vectors)
    widths = {dim: measured_width(vectors, {dim: p}, [q for q in queries if len(q[1]) == dim], threshold, usual_width(dim, confidence)) for dim, p in pivots.items()}
    ready = materialize(vectors.mapInArrow(_prepare(pivots, threshold, widths), schema), "codes")
    live = ready.where("dim IS NOT NULL AND label IS NOT NULL")
    equal = materialize(live.groupBy("label", "dim", "same").agg(F.min("row").alias("first"), F.min("vec_id").alias("least"), F.count("*").alias("w")), "equal-vectors")
    firsts = live.select("row", "label", "dim", "code", "cells").join(equal.select(c("first").alias("row"), "w"), "row")
    placed = materialize(firsts.withColumn("cell", F.explode("cells")), "placed")
    sizes = placed.groupBy("label", "dim", "cell").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks")).where("blocks > 1")
    blocks = F.coalesce("blocks", F.lit(1))
    cut = placed.join(sizes, ["label", "dim", "cell"], "left").withColumn("own", F.pmod(F.xxhash64("row"), blocks).cast("int")).withColumn("x", F.explode(F.sequence(F.lit(0), blocks - 1)))
    task = ["label", "dim", "cell", "i", "j"]
    dealt = cut.select("label", "dim", "cell", F.least("own", "x").alias("i"), F.greatest("own", "x").alias("j"), (c("own") > c("x")).cast("int").alias("side"), "row", "w", "code", "cells")
    hits = dealt.groupBy(*task).applyInArrow(_survivors(threshold, confidence), dealt.schema)
    whole = hits.join(ready.select("row", "embedding"), "row")
    found = materialize(whole.groupBy(*task).applyInArrow(_verified(threshold, confidence), "row long, n long, other long"), "links")
    links = found.groupBy("row").agg(F.sum("n").alias("n"))
    parts = connected_components(found.select(c("row").alias("a"), c("other").alias("b")))
    per = equal.join(links, c("first") == c("row"), "left").drop("row").join(parts, c("first") == c("node"), "left")
    per = per.select("label", "dim", "same", "least", (F.coalesce("n", F.lit(0)) + c("w") - 1).alias("n_links"), F.coalesce("component", "first").alias("part"))
    named = per.join(per.groupBy("part").agg(F.min("least").alias("component_id")), "part").select("label", "dim", "same", "n_links", "component_id")
    out = ready.select("vec_id", "label", "dim", "same").join(named, ["label", "dim", "same"], "left")
    return out.select(
        c("vec_id").alias(id_col), F.coalesce("n_links", F.lit(0)).alias("n_links"),
        F.when(c("n_links").isNull(), c("vec_id")).otherwise(c("component_id")).alias("component_id"),
    ).withColumn("kept", F.coalesce(c(id_col) == c("component_id"), F.lit(False)))


def op10_embedding_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all embeddings at a cosine of 0.98."""
    return embedding_classes(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), 0.98)
