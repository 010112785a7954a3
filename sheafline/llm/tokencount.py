"""Token counts from distinct pre-tokens.

A pre-token is a piece of text across whose ends no merge of the vocabulary reaches.
Its token count therefore never depends on its neighbours, so it is found once for
the whole corpus, and a document's count is the sum over its pre-tokens of frequency
times count. No ids are made for documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, materialize

_SPACE, _NL = " ▁", "\n"
#: Latin, Greek and Cyrillic letters. Other scripts count as other characters, which only makes their pre-tokens longer.
_LETTER = "[A-Za-zÀ-ÖØ-öø-ʯͰ-ͳΆΈ-ԯ]"
#: Spaces, then other characters, then letters; a line feed stands alone.
UNIT = re.compile(rf"\n|[{_SPACE}]*(?:(?!{_LETTER})[^{_SPACE}\n])*{_LETTER}+|[{_SPACE}]*(?:(?!{_LETTER})[^{_SPACE}\n])+|[{_SPACE}]+")
#: Pre-tokens with at least a HEAD-th of all occurrences are looked up in the task; there are at most HEAD.
HEAD = 1 << 20
#: Distinct pre-tokens a task holds before it hands on their counts.
HELD = 400_000


def pieces_model(path: str):
    """The tokenizer of a .model file, after a check that its vocabulary keeps to the pre-tokens' ends."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    for i in range(sp.get_piece_size()):
        if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or UNIT.fullmatch(sp.id_to_piece(i))):
            raise ValueError(f"piece {sp.id_to_piece(i)!r} reaches across pre-tokens; this vocabulary can't be counted by pre-tokens")
    if len(sp.encode(_NL)) != 2 or sp.encode(""):
        raise ValueError("the tokenizer doesn't put one space before a text")
    return sp


def pre_tokens(text: str | None) -> list[str]:
    """Pre-tokens of a text with the space that the tokenizer puts before it; none for null or empty."""
    return UNIT.findall(" " + text) if text else []


def pre_token_table(docs: DataFrame, model_path: str, text_col: str = "text") -> DataFrame:
    """unit, freq, n_pieces: every distinct pre-token of all texts, counted once."""

    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()

        def out():
            return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], names=["unit", "n"])

        for b in batches:
            for text in b.column(0):
                seen.update(pre_tokens(text.as_py()))
                if len(seen) > HELD:
                    yield out()
                    seen.clear()
        yield out()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sp = pieces_model(model_path)
        for b in batches:
            # a line feed joins with nothing, so what follows it is split as inside a text
            n = [len(x) - 2 for x in sp.encode([_NL + u for u in b.column(0).to_pylist()], num_threads=1)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(n, pa.int32())], names=["unit", "freq", "n_pieces"])

    distinct = docs.select(text_col).mapInArrow(units, "unit string, n long").groupBy("unit").agg(F.sum("n").alias("freq"))
    return distinct.mapInArrow(count, "unit string, freq long, n_pieces int")


def count_tokens(docs: DataFrame, model_path: str, *, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row's id, n_bytes (UTF-8), n_tokens and over_limit (n_tokens > limit).

    Null and empty texts have no bytes and no tokens. Repeated rows, also under one
    id or a null id, are counted each on their own. An empty table gives an empty
    one; only the two named columns are read. Pre-tokens with at least a HEAD-th of
    all occurrences are at most HEAD in number at any scale: these are broadcast and
    summed where the text is read. All others are rarer than that, so the join on
    them has no hot key.
    """
    c = F.col
    spark = docs.sparkSession
    docs = docs.select(c(id_col).cast("long").alias("doc_id"), c(text_col).alias("text"))
    table = materialize(pre_token_table(docs, model_path), "pre-tokens")
    total = table.agg(F.sum("freq")).first()[0] or 0
    frequent = c("freq") * HEAD >= total
    head = spark.sparkContext.broadcast({r[0]: r[1] for r in table.where(frequent).select("unit", "n_pieces").toLocalIterator()})

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, row = head.value, TaskContext.get().partitionId() << 40
        for b in batches:
            units: list[str] = []
            counts: list[int] = []
            rows: list[int] = []
            ids: list[int | None] = []
            sizes: list[int | None] = []
            for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                text, own = text.as_py(), 0
                for unit, n in Counter(pre_tokens(text)).items():
                    if unit in known:
                        own += known[unit] * n
                    else:
                        units.append(unit)
                        counts.append(n)
                extra = len(units) - len(rows)
                # the row's own record: no pre-token starts like this, so it meets none
                units.append(f"\n{row}")
                counts.append(own)
                rows += [row] * (extra + 1)
                ids += [None] * extra + [key]
                sizes += [None] * extra + [len(text.encode()) if text else 0]
                row += 1
                if len(units) > 100_000:
                    yield _records(units, rows, counts, ids, sizes)
                    units, counts, rows, ids, sizes = [], [], [], [], []
            yield _records(units, rows, counts, ids, sizes)

    parts = docs.mapInArrow(split, "unit string, row long, n long, doc_id long, n_bytes long")
    met = parts.join(table.where(~frequent).select("unit", "n_pieces"), "unit", "left")
    sums = met.groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"),
                                  F.sum(c("n") * F.coalesce("n_pieces", F.lit(1))).alias("n_tokens"))
    return sums.select(c("doc_id").alias(id_col), "n_bytes", "n_tokens", (c("n_tokens") > limit).alias("over_limit"))


def _records(units, rows, counts, ids, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(units, pa.string()), *(pa.array(x, pa.int64()) for x in (rows, counts, ids, sizes))],
        names=["unit", "row", "n", "doc_id", "n_bytes"])


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token counts of all documents."""
    import public_tokenizers

    return count_tokens(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")), public_tokenizers.path("piece_bpe_32k.model"))
