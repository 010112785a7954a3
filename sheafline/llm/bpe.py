"""BPE encoding through an index of pair occurrences, and decoding.

The distinct pre-tokens of a batch lie in one row of symbols. An index maps every
pair of neighbours to all its positions; the active ranks are applied in ascending
order, each to all its positions at once, and the lists of the pairs that a merge
makes are extended. A merge only makes pairs of higher ranks (checked when the
vocabulary is read), so one pass over the ranks is the usual greedy encoding.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt

#: Distinct words whose ids a task remembers, and bytes of result that it holds back.
REMEMBERED, HELD_BYTES = 400_000, 16_000_000

#: Below this, Unicode versions agree on letters, cases and compositions.
_SETTLED = re.compile("^[\x00-ԯ]*$")
_SPACE = re.compile("[\t\n\x0b\x0c\r \x85\xa0]+")


def _byte_characters() -> list[str]:
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


class WordBpe:
    """A word-level BPE tokenizer file: lower case, byte symbols, a suffix on each word's last symbol."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.library = Tokenizer.from_file(path)  # for its normalizer and word splitter on unsettled characters
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.tokens = [""] * (max([*vocab.values(), *self.specials.values()]) + 1)
        for token, i in [*vocab.items(), *self.specials.items()]:
            self.tokens[i] = token
        self.special = re.compile("(" + "|".join(map(re.escape, self.specials)) + ")") if self.specials else None
        chars = _byte_characters()
        self.inner = [vocab[c] for c in chars]
        self.final = [vocab[c + suffix] for c in chars]
        self.merges: dict[int, tuple[int, int]] = {}
        made: dict[int, int] = {}
        for rank, (a, b) in enumerate(model["merges"]):
            whole = vocab[a + b]
            if max(made.get(vocab[a], -1), made.get(vocab[b], -1)) >= rank:
                raise ValueError("a merge uses a symbol that a later merge makes")
            made.setdefault(whole, rank)
            self.merges[vocab[a] << 32 | vocab[b]] = (rank, whole)
        import regex

        self.splitter = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.known: dict[str, bytes] = {}

    # encoding -----------------------------------------------------------------

    def words(self, text: str) -> list[str]:
        """Words of a stretch without special tokens: normalised, split at white space."""
        if _SETTLED.match(text):
            text = _SPACE.sub(" ", unicodedata.normalize("NFC", text)).replace("Σ", "σ").lower()
        else:
            text = self.library.normalizer.normalize_str(text)
        return [w for w in text.split(" ") if w]

    def pre_tokens(self, word: str) -> list[bytes]:
        """The pre-tokens of a normalised word, as bytes."""
        if _SETTLED.match(word):
            return [p.encode() for p in self.splitter.findall(word)]
        byte = {c: b for b, c in enumerate(_byte_characters())}
        return [bytes(byte[c] for c in p) for p, _ in self.library.pre_tokenizer.pre_tokenize_str(word)]

    def merge(self, pieces: list[bytes]) -> list[list[int]]:
        """Ids of each piece, through the pair occurrence index over all of them."""
        symbols: list[int] = []
        for p in pieces:
            symbols += [self.inner[b] for b in p[:-1]]
            symbols.append(self.final[p[-1]])
            symbols.append(-1)  # a wall between pieces
        size = len(symbols)
        after = list(range(1, size + 1))
        before = list(range(-1, size - 1))
        row = np.array(symbols, np.int64)
        keys = row[:-1] << 32 | row[1:]
        place = np.flatnonzero((row[:-1] >= 0) & (row[1:] >= 0))
        order = place[np.argsort(keys[place], kind="stable")]
        cuts = np.flatnonzero(np.diff(keys[order])) + 1
        index: dict[int, list[int]] = {}
        ranks: list[tuple[int, int]] = []
        merges = self.merges
        for at in np.split(order, cuts) if len(order) else []:
            key = int(keys[at[0]])
            if key in merges:
                index[key] = at.tolist()
                ranks.append((merges[key][0], key))
        heapq.heapify(ranks)
        while ranks:
            _, key = heapq.heappop(ranks)
            a, b, whole = key >> 32, key & 0xFFFFFFFF, merges[key][1]
            for p in sorted(index.pop(key)):
                if symbols[p] != a:
                    continue  # taken by another merge meanwhile
                q = after[p]
                if symbols[q] != b:
                    continue
                symbols[p], symbols[q] = whole, -2
                after[p] = r = after[q]
                before[r] = p
                if p and (left := symbols[before[p]]) >= 0 and (new := left << 32 | whole) in merges:
                    if new in index:
                        index[new].append(before[p])
                    else:
                        index[new] = [before[p]]
                        heapq.heappush(ranks, (merges[new][0], new))
                if (right := symbols[r]) >= 0 and (new := whole << 32 | right) in merges:
                    if new in index:
                        index[new].append(p)
                    else:
                        index[new] = [p]
                        heapq.heappush(ranks, (merges[new][0], new))
        out: list[list[int]] = [[]]
        for s in symbols:
            if s >= 0:
                out[-1].append(s)
            elif s == -1:
                out.append([])
        return out[:-1]

    def learn(self, words: set[str]) -> None:
        """Remembers the ids of these words; the room is for words that are new, not for those that are known already."""
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > REMEMBERED:
            self.known.clear()
            new = list(words)
        split = [self.pre_tokens(w) for w in new]
        distinct = list({p for pieces in split for p in pieces})
        ids = {p: struct.pack(f"<{len(i)}I", *i) for p, i in zip(distinct, self.merge(distinct), strict=True)} if distinct else {}
        for w, pieces in zip(new, split, strict=True):
            self.known[w] = ids[pieces[0]] if len(pieces) == 1 else b"".join([ids[p] for p in pieces])

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        stretches = []
        for text in texts:
            parts = self.special.split(text) if text and self.special else [text or ""]
            stretches.append([self.words(s) if k % 2 == 0 else s for k, s in enumerate(parts)])
        self.learn({w for parts in stretches for s in parts[::2] for w in s})
        ids = self.known
        return [b"".join([np.array([self.specials[s]], "<u4").tobytes() if isinstance(s, str) else b"".join([ids[w] for w in s]) for s in parts]) for parts in stretches]

    # decoding -----------------------------------------------------------------

    def decode(self, ids: bytes) -> str:
        """The tokens of the ids with a space between them: the file names no decoder."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def bpe_round(docs: DataFrame, tokenizer_path: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, its ids (binary, little-endian unsigned 32-bit) and the text decoded from them.

    Whole texts are encoded as the tokenizers library does without adding special
    tokens; special strings inside a text are special tokens. Null and empty texts
    have no ids and decode to the empty text. Rows are independent of each other, so
    repeated rows, null ids and an empty table need no rule. Nothing is shuffled; only
    the two named columns are read. A task holds one batch of rows and at most
    REMEMBERED words.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = WordBpe(tokenizer_path)

        def out(keys, codes):
            return pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(codes, pa.binary()), pa.array([bpe.decode(c) for c in codes], pa.string())], names=["doc_id", "ids", "decoded"])

        for b in batches:
            at = 0
            sizes = np.cumsum([len(x) for x in b.column(1).cast(pa.binary()).fill_null(b"").to_pylist()])
            while at < b.num_rows:  # rows of about HELD_BYTES / 4 of text together
                to = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + HELD_BYTES // 4)))
                part = b.slice(at, to - at)
                yield out(part.column(0).to_pylist(), bpe.encode_batch(part.column(1).to_pylist()))
                at = to

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, ids binary, decoded string")


def op8_bpe_round(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded, as counts and digests."""
    import public_tokenizers

    coded = bpe_round(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), public_tokenizers.path("word_bpe_49k.json"))
    return coded.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"),
                        F.sha2("decoded", 256).alias("decoded_sha256"))
