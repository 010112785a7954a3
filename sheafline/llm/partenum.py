"""Spelling variants of a vocabulary through PartEnum signatures of letter multisets.

A word's letters are a binary vector: one dimension for the j-th occurrence of a letter.
A replaced letter changes two dimensions at most and keeps the length, an inserted or
deleted one changes one dimension and the length by one. Dimensions are dealt into PARTS
parts, so that a pair that differs in two dimensions agrees outside two of the parts, and
one that differs in one agrees outside one. All ways of leaving out two parts (words of one
length) or one part (words whose lengths differ by one) are enumerated as signatures;
near words share one exactly. An equi-join on signatures and a test of the words follow.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, discard, materialize

#: Letters of a word, occurrences that make a word, what divides the hash of a damaged run.
MIN_LETTERS, MIN_COUNT, DAMAGE = 5, 3, 97
#: Parts that the dimensions are dealt into: 28 signatures for pairs of one length, 16 for the others.
PARTS = 8
#: Words of a signature that meet in one task; those of larger ones go on by their deletion variants.
BUCKET = 2048

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SEED = np.uint64(0x9E3779B97F4A7C15)


def word_counts(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of runs of letters, A-Z lower-cased; where DAMAGE divides crc32(id:run), the run has lost the code point that the hash points at.

    Null texts have no runs; a null id is written as nothing before the colon. Counts
    are summed before the shuffle, so frequent words are no hot keys.
    """
    c = F.col
    runs = F.explode(F.regexp_extract_all(c(text_col), F.lit("[A-Za-zÀ-ÿ]+"), F.lit(0)))
    low = docs.select(F.coalesce(c(id_col).cast("string"), F.lit("")).alias("id"), runs.alias("run")).select("id", F.translate("run", _UPPER, _LOWER).alias("run"))
    hashed = low.withColumn("h", F.crc32(F.concat("id", F.lit(":"), "run")))
    at = (c("h") % F.char_length("run")).cast("int")
    damaged = F.concat(F.substring(c("run"), F.lit(1), at), F.substring(c("run"), at + 2, F.char_length("run")))
    words = hashed.select(F.when(c("h") % DAMAGE == 0, damaged).otherwise(c("run")).alias("word"))
    return words.where(F.char_length("word") >= MIN_LETTERS).groupBy("word").agg(F.count("*").alias("n")).where(c("n") >= MIN_COUNT)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def signatures(words: list[str]) -> np.ndarray:
    """Of each word, its signatures: first those for words of its length, then those for one letter more, then for one less."""
    lengths = np.array([len(w) for w in words], np.uint64)
    of = np.repeat(np.arange(len(words)), lengths.astype(np.int64))
    letters = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    order = np.lexsort((letters, of))  # equal letters of a word stand together
    of, letters = of[order], letters[order]
    first = np.ones(len(of), bool)
    first[1:] = (of[1:] != of[:-1]) | (letters[1:] != letters[:-1])
    nth = np.arange(len(of)) - np.maximum.accumulate(np.where(first, np.arange(len(of)), 0))
    element = _mixed(((letters << 24) + nth).astype(np.uint64) + _SEED)
    parts = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(parts, (of, (element >> np.uint64(40)) % np.uint64(PARTS)), element)
    total = parts.sum(1, dtype=np.uint64)
    out = []
    for kind, (tag, left_out) in enumerate([(lengths, 2), (lengths, 1), (lengths - np.uint64(1), 1)]):
        for k, drop in enumerate(combinations(range(PARTS), left_out)):
            rest = total - parts[:, list(drop)].sum(1, dtype=np.uint64)
            # a longer word meets the shorter one under the shorter one's length
            out.append(_mixed(rest * _SEED + _mixed(tag * np.uint64(1 << 16) + np.uint64((min(kind, 1) << 8) + k))))
    return np.stack(out, 1)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    pairs = len(list(combinations(range(PARTS), 2)))
    for b in batches:
        for at in range(0, b.num_rows, 4096):
            words = b.column("word").slice(at, 4096)
            sigs = signatures(words.to_pylist())
            n = sigs.shape[1]
            role = np.repeat(np.array([[0] * pairs + [1] * PARTS + [2] * PARTS], np.int8), len(words), 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array(sigs.view(np.int64).ravel()), pa.array(role.ravel()), words.take(pa.array(np.repeat(np.arange(len(words)), n)))], names=["sig", "role", "word"])


def near(a: str, b: str) -> bool:
    """Whether exactly one code point is inserted, deleted or replaced between a and b."""
    if len(a) > len(b):
        a, b = b, a
    if a == b or len(b) - len(a) > 1:
        return False
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + (len(a) == len(b)) :] == b[i + 1 :]


def bucket_pairs(words: list[str]) -> Iterator[tuple[str, str]]:
    """Near pairs, in time linear in the words: they share what is left without one letter."""
    if len(words) < 6:
        for a, b in combinations(words, 2):
            if near(a, b):
                yield (a, b) if a < b else (b, a)
        return
    one, shorter = defaultdict(list), set(words)
    for w in words:
        rests = {}
        for i in range(len(w)):
            rest = w[:i] + w[i + 1 :]
            one[i, rest].append(w)
            rests[rest] = None
        for rest in rests:
            if rest in shorter:
                yield (w, rest) if w < rest else (rest, w)
    for group in one.values():
        for a, b in combinations(group, 2):
            yield (a, b) if a < b else (b, a)


def _alike_halves(keys: np.ndarray) -> Iterator[np.ndarray]:
    """Groups of places with equal keys, as arrays [groups, members], for each size from two on."""
    order = np.argsort(keys, kind="stable")
    begins = np.flatnonzero(np.r_[True, np.diff(keys[order]) != 0]) if len(keys) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[begins, len(keys)])
    for n in np.unique(sizes[sizes > 1]):
        yield order[begins[sizes == n][:, None] + np.arange(n)]


def list_pairs(words: pa.Array, sizes: np.ndarray) -> set[tuple[str, str]]:
    """Near pairs of lists of words, one after the other.

    In a list, words have one length, or two that differ by one. One edit leaves the first
    or the second half of the shorter word as it is, so only words that share a half are
    compared; groups that share one and are large are met by their deletion variants.
    """
    begins = np.cumsum(sizes) - sizes
    lengths = pc.utf8_length(words).to_numpy(zero_copy_only=False).astype(np.int64)
    shortest = np.repeat(np.minimum.reduceat(lengths, begins), sizes) if len(sizes) else lengths
    one_length = np.repeat(np.maximum.reduceat(lengths, begins), sizes) == shortest if len(sizes) else lengths == 0
    of = np.repeat(np.arange(len(sizes)), sizes)
    found: set[tuple[str, str]] = set()
    for n in np.unique(shortest):
        at = np.flatnonzero(shortest == n)
        own = words.take(pa.array(at))
        half = int(n) // 2
        for part in (pc.utf8_slice_codeunits(own, 0, half), pc.utf8_slice_codeunits(own, -(int(n) - half))):
            names = pc.dictionary_encode(part).indices.to_numpy(zero_copy_only=False).astype(np.int64)
            for groups in _alike_halves(of[at] * (int(names.max()) + 1) + names):
                if groups.shape[1] > 32:
                    for g in groups:
                        found.update(bucket_pairs(own.take(pa.array(g)).to_pylist()))
                    continue
                x, y = np.triu_indices(groups.shape[1], 1)
                i, j = at[groups[:, x].ravel()], at[groups[:, y].ravel()]
                fit = one_length[i] | (lengths[i] != lengths[j])
                for a, b in zip(words.take(pa.array(i[fit])).to_pylist(), words.take(pa.array(j[fit])).to_pylist(), strict=True):
                    if near(a, b):
                        found.add((a, b) if a < b else (b, a))
    return found


def _verified(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        lists = b.column("words")
        pairs = list_pairs(lists.flatten(), np.diff(lists.offsets.to_numpy()))
        a, z = zip(*pairs, strict=True) if pairs else ((), ())
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(z, pa.string())], names=["a", "b"])


def _by_deletion(hot: DataFrame) -> DataFrame:
    """Near pairs of (sig, role, word): words of one length that are equal without their i-th letter, and words that are another one without a letter.

    A key of this join is held by as many words as one letter allows, whatever the bucket's size.
    """
    c = F.col
    place = F.explode(F.sequence(F.lit(1), F.char_length("word"))).alias("i")
    rest = F.concat(F.substring(c("word"), F.lit(1), c("i") - 1), F.substring(c("word"), c("i") + 1, F.char_length("word")))
    cut = hot.where("role != 1").select("sig", "role", "word", place).select("sig", "role", "word", "i", rest.alias("rest"))
    same = cut.where("role = 0")
    other = same.select("sig", "i", "rest", c("word").alias("b"))
    replaced = same.withColumnRenamed("word", "a").join(other, ["sig", "i", "rest"]).where("a < b").select("a", "b")
    longer = cut.where("role = 2").select("sig", c("word").alias("w"), "rest").distinct()
    inserted = longer.join(hot.where("role = 1").select("sig", c("word").alias("rest")), ["sig", "rest"]).select(F.least("w", "rest").alias("a"), F.greatest("w", "rest").alias("b"))
    return replaced.union(inserted)


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, b), a < b, of all near pairs of the distinct words in column word.

    Signatures of more than BUCKET words go on by deletion variants, so no task gathers
    a larger bucket and no pair is lost.
    """
    c = F.col
    signed = materialize(words.select("word").mapInArrow(_signed, "sig long, role byte, word string"), "signatures")
    sizes = materialize(signed.groupBy("sig").agg(F.count("*").alias("k")).where("k > 1"), "signature-sizes")
    hot = sizes.where(c("k") > BUCKET).select("sig")
    shared = signed.join(sizes.where(c("k") <= BUCKET).select("sig"), "sig")
    cold = shared.groupBy("sig").agg(F.collect_list("word").alias("words")).where(F.size("words") > 1).select("words").mapInArrow(_verified, "a string, b string")
    every = cold if hot.isEmpty() else cold.union(_by_deletion(signed.join(hot, "sig", "left_semi")))
    pairs = materialize(every.distinct(), "near-words")
    for done in (signed, sizes):
        discard(done)
    return pairs


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of (word, form): the last form that can be reached. Pointers are doubled, so rounds grow with the logarithm of the longest chain."""
    c = F.col
    at = materialize(forms.select("word", c("form").alias("root")), "roots")
    while True:
        onward = at.select(c("word").alias("root"), c("root").alias("next"))
        if at.join(onward, "root", "left_semi").isEmpty():
            return at
        after = materialize(at.join(onward, "root", "left").select("word", F.coalesce("next", "root").alias("root")), "roots")
        discard(at)
        at = after


def variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words with their counts n.

    A word's form is its near word of largest n (ties: smallest in code-point order) where
    that is at least twice its own, so counts grow along forms and chains end. No words
    give no rows.
    """
    c = F.col
    pairs = near_pairs(words)
    both = pairs.union(pairs.select("b", "a")).toDF("word", "other")
    counted = both.join(words.select(c("word").alias("other"), c("n").alias("other_n")), "other")
    best = counted.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-c("other_n")).alias("less"), c("other").alias("form"))).alias("best"))
    judged = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), c("best.form").alias("form"), (-c("best.less")).alias("form_n"))
    fine = c("form_n") >= 2 * c("n")
    judged = materialize(judged.select("word", "n", "n_near", F.when(fine, c("form")).alias("form"), F.when(fine, c("form_n")).alias("form_n")), "forms")
    ends = roots(judged.where("form IS NOT NULL").select("word", "form"))
    return judged.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Variants of the words of docs; see word_counts and variants.

    Null, empty and letterless texts have no words, an empty table gives no rows.
    Repeated rows are counted as often as they come. Columns that are not named are not
    read. Texts of any length are read whole.
    """
    return variants(materialize(word_counts(docs, id_col=id_col, text_col=text_col), "word-counts"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of the documents with its form and root."""
    return spelling_variants(dealt(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
