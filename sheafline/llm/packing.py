"""Hierarchical multi-length packing of tokenised documents.

Each task packs the documents it reads, so nothing is shuffled and no token ever
leaves the task that made it. Whole windows of the longest size are cut off long
documents; what remains of a document is routed to the smallest context size that
holds it. Tiers are packed from the longest down: a window is opened with its tier's
largest piece, gaps are filled with the largest fitting piece of that tier or a shorter
one, and a gap that nothing fits takes the head of a short piece, whose rest returns to
the pool. So every window is full except the last tokens of a task, which go into
windows of falling powers of two. Windows are then dealt into step groups of equal
tokens and near equal attention cost.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt

TIERS = (256, 512, 1024, 2048)
#: Windows of the longest size that one training step takes.
STEP_WINDOWS = 16
#: A pool of documents is packed when it holds so many tokens or documents.
POOL_TOKENS, POOL_DOCS = 4_000_000, 8192
#: Window numbers of a task start at its partition's number times this.
STRIDE = 1 << 40

SCHEMA = ("doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, "
          "window int, step_id long")


def _byte_characters() -> dict[str, int]:
    """The printable stand-ins that byte-level vocabularies use for the 256 bytes."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Encoder:
    """Ids of a byte-level BPE tokenizer file, as the tokenizers library gives them.

    The library's own encoder spends most of its time on offsets; the same
    vocabulary and merges run several times faster through tiktoken, and the tests
    hold both against each other. Texts that tiktoken refuses go to the library.
    """

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        byte = _byte_characters()
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        ranks = {bytes(byte[c] for c in token): i for token, i in spec["model"]["vocab"].items() if token not in self.special}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        self.fast = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens=self.special)
        self.full = Tokenizer.from_file(path)

    def __call__(self, text: str | None) -> list[int]:
        if not text:
            return []
        try:
            return self.fast.encode(text, allowed_special="all")
        except BaseException as e:  # a panic in the extension is no Exception
            if isinstance(e, (KeyboardInterrupt, SystemExit)):
                raise
            return self.full.encode(text, add_special_tokens=False).ids


class Pool:
    """Pieces by length: the largest of at most so many tokens is found through a bit mask."""

    def __init__(self):
        self.by_length: dict[int, list] = {}
        self.mask = 0

    def add(self, doc: int, start: int, length: int) -> None:
        self.by_length.setdefault(length, []).append((doc, start, length))
        self.mask |= 1 << length

    def _take(self, length: int):
        pieces = self.by_length[length]
        piece = pieces.pop()
        if not pieces:
            del self.by_length[length]
            self.mask ^= 1 << length
        return piece

    def largest(self, most: int):
        below = self.mask & ((1 << (most + 1)) - 1)
        return self._take(below.bit_length() - 1) if below else None

    def shortest(self):
        return self._take((self.mask & -self.mask).bit_length() - 1) if self.mask else None


def pack_pool(lengths: list[int], tiers: tuple[int, ...], last: bool) -> tuple[list[tuple[int, list]], list[tuple[int, int, int]]]:
    """(windows, rest) for documents of these lengths: a window is (size, [(doc, start, length)]).

    Every window is full. The rest, less than the longest tier, is what could not
    fill one; with last it is cut into windows of falling powers of two and is empty.
    """
    top, windows, pool = tiers[-1], [], Pool()
    for doc, n in enumerate(lengths):
        full = n // top * top
        windows += [(top, [(doc, at, top)]) for at in range(0, full, top)]
        if n > full:
            pool.add(doc, full, n - full)
    rest: list[tuple[int, int, int]] = []
    for tier, shorter in zip(reversed(tiers), [*reversed(tiers[:-1]), 0], strict=True):
        # a tier is open while it has pieces that no shorter window holds
        while pool.mask >> (shorter + 1):
            pieces, gap = [], tier
            while gap:
                piece = pool.largest(gap)
                if piece is None:
                    piece = pool.shortest()
                    if piece is None:
                        break
                    doc, start, length = piece
                    pool.add(doc, start + gap, length - gap)
                    piece = (doc, start, gap)
                pieces.append(piece)
                gap -= piece[2]
            if gap:  # nothing is left for this window
                rest += pieces
            else:
                windows.append((tier, pieces))
    if last:
        left = sum(x[2] for x in rest)
        queue = list(reversed(rest))
        while left:
            size = 1 << (left.bit_length() - 1)
            pieces, gap, left = [], size, left - size
            while gap:
                doc, start, length = queue.pop()
                if length > gap:
                    queue.append((doc, start + gap, length - gap))
                pieces.append((doc, start, min(gap, length)))
                gap -= pieces[-1][2]
            windows.append((size, pieces))
        rest = []
    return windows, rest


def step_groups(windows: list[tuple[int, list]], step_tokens: int) -> list[int]:
    """The step group of each window: longest first, to the group with the fewest tokens, then the least attention cost."""
    total = sum(size for size, _ in windows)
    heap = [(0, 0, g) for g in range(max(1, -(-total // step_tokens)))]
    cost = [sum(p[2] * p[2] for p in pieces) for _, pieces in windows]
    group = [0] * len(windows)
    for k in sorted(range(len(windows)), key=lambda k: (-windows[k][0], -cost[k], k)):
        tokens, spent, g = heapq.heappop(heap)
        group[k] = g
        heapq.heappush(heap, (tokens + windows[k][0], spent + cost[k], g))
    return group


def pack_documents(docs: DataFrame, tokenizer_path: str | Column, *, eos_id: int = 1, tiers: tuple[int, ...] = TIERS,
                   step_windows: int = STEP_WINDOWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All documents cut into pieces that fill windows: one row per piece.

    A document is its ids followed by eos_id; null and empty texts are eos_id alone.
    A piece is `length` ids from `start` on; its ids are in `ids`, as unsigned
    little-endian 32-bit numbers. sequence_id names the window, offset the place
    there, window its size, step_id its step group. tiers are powers of two in
    rising order. Repeated rows are packed once each, also under one id, and may have
    null ids; an empty table gives an empty result. Only the two named columns are read. A
    task holds one pool of documents, at most POOL_TOKENS tokens and one more
    document, and gives the same windows when it runs again.
    """
    if any(t & (t - 1) for t in tiers) or list(tiers) != sorted(set(tiers)):
        raise ValueError("tiers must be rising powers of two")
    step_tokens = step_windows * tiers[-1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, base = Encoder(tokenizer_path), TaskContext.get().partitionId() * STRIDE
        window_no = step_no = 0
        # documents of the pool: id, tokens before the part that is held, ids, tokens of the whole
        held: list[tuple[int | None, int, np.ndarray, int]] = []
        tokens = 0

        def flush(last: bool) -> pa.RecordBatch:
            nonlocal held, tokens, window_no, step_no
            windows, rest = pack_pool([len(x[2]) for x in held], tiers, last)
            groups = step_groups(windows, step_tokens)
            out: list[tuple] = []
            for w, (size, pieces) in enumerate(windows):
                offset = 0
                for doc, start, length in pieces:
                    key, before, ids, total = held[doc]
                    out.append((key, before + start, length, ids[start : start + length].tobytes(), total, base + window_no + w, offset, size, base + step_no + groups[w]))
                    offset += length
            window_no += len(windows)
            step_no += max(groups, default=-1) + 1
            held = [(held[d][0], held[d][1] + s, held[d][2][s : s + n].copy(), held[d][3]) for d, s, n in rest]
            tokens = sum(len(x[2]) for x in held)
            names = [x.split()[0] for x in SCHEMA.split(", ")]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            columns = list(zip(*out, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        for b in batches:
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                ids = encode(text.as_py())
                ids.append(eos_id)
                held.append((key, 0, np.array(ids, "<u4"), len(ids)))
                tokens += len(ids)
                if tokens >= POOL_TOKENS or len(held) >= POOL_DOCS:
                    yield flush(False)
        if held:
            yield flush(True)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def packed_digests(pieces: DataFrame) -> DataFrame:
    """Pieces with the checksum of their ids in place of the ids."""
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "window", "step_id")


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    import public_tokenizers

    docs = dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return packed_digests(pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")))
