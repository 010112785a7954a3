"""Quality rules from line labels: a linear-chain conditional random field.

Every line with a word is content or boilerplate. The field scores a line by a few
statistics and neighbouring labels by a transition weight; Viterbi decoding finds the
best labels of a whole text. The share of words in content lines, after two plain base
rules, decides whether a document stays.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import dealt, hash_sample, held_out, materialize, renamed

SYMBOLS = "#*$%&|<>"
#: Base rules, and the share of words in content lines that a kept document has.
MIN_WORDS, MAX_REPEAT_PERCENT, MIN_CONTENT = 10, 20, 0.5
#: Training: labelled documents of each class, lines of a sequence and sequences of a document, at most; rounds of relabelling, and how sure the field must be of a line to change its label.
TRAIN_DOCS, TRAIN_LINES, TRAIN_CUTS, ROUNDS, SURE = 600, 64, 4, 3, 0.8

CONTENT, BOILERPLATE = 0, 1
FEATURES = ("bias", "log_words", "mean_word", "symbols", "upper", "digits", "marks", "ends", "distinct", "repeats", "duplicate", "edge", "starts_upper", "bars")
_UPPER, _DIGIT, _MARK = re.compile(r"[A-ZÀ-ÖØ-Þ]"), re.compile(r"[0-9]"), re.compile(r"[!?;:=_~@^/\\{}\[\]]")
_SPACES = " \t\n\x0b\x0c\r"


@dataclass
class Measured:
    """Base numbers of a text, and one row of features for each of its lines with a word."""

    n_words: int
    word_chars: int
    n_symbols: int
    n_dup_lines: int
    n_repeat_words: int
    words: np.ndarray
    x: np.ndarray

    @property
    def base_failed(self) -> bool:
        return self.n_words < MIN_WORDS or 100 * self.n_repeat_words > MAX_REPEAT_PERCENT * self.n_words


def repeated(words: list[bytes], width: int = 5) -> np.ndarray:
    """Which words lie in a window of `width` words that the text holds twice or more."""
    n = len(words)
    covered = np.zeros(n, bool)
    if n <= width:
        return covered
    number: dict[bytes, int] = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    # windows by doubling: equal numbers mean equal windows, so nothing rests on hashes
    have = 1
    while have < width:
        step = min(have, width - have)
        _, ids = np.unique(ids[: len(ids) - step] * (int(ids.max()) + 1) + ids[step:], return_inverse=True)
        have += step
    twice = np.flatnonzero((np.bincount(ids) > 1)[ids])
    edge = np.zeros(n + 1, np.int64)
    np.add.at(edge, twice, 1)
    np.add.at(edge, twice + width, -1)
    return edge[:n].cumsum() > 0


def measure(text: str | None) -> Measured:
    """Statistics of a whole text; a null text has no words."""
    text = text or ""
    lines, words, owner, seen, dup = [], [], [], set(), []
    for line in text.split("\n"):
        own = line.encode("utf-8", "surrogatepass").split()
        if own:
            dup.append(line in seen)
            seen.add(line)
            words += own
            owner.append(len(own))
            lines.append(line)
    again = repeated(words)
    n, counts = len(lines), np.array(owner, np.int64)
    x = np.zeros((n, len(FEATURES)))
    if n:
        at = np.concatenate([[0], counts.cumsum()[:-1]])
        share = np.add.reduceat(again.astype(np.int64), at) / counts
        for i, line in enumerate(lines):
            own = words[at[i] : at[i] + counts[i]]
            size = len(line)
            symbols = sum(map(line.count, SYMBOLS))
            tail = own[-1][-1:]
            x[i] = (1, np.log1p(counts[i]), min(size / counts[i], 30) / 10, min(1, 5 * symbols / size), len(_UPPER.findall(line)) / size,
                    len(_DIGIT.findall(line)) / size, min(1, 5 * len(_MARK.findall(line)) / size), tail in b".!?", len(set(own)) / counts[i],
                    share[i], dup[i], i == 0 or i == n - 1, line.lstrip()[:1].isupper(), line.count("|") / counts[i])
    return Measured(len(words), len(text) - sum(map(text.count, _SPACES)), sum(map(text.count, SYMBOLS)), sum(dup), int(again.sum()), counts, x)


@dataclass
class Field:
    """Weights of line features by label [feature, label] and of label pairs [before, after]."""

    weights: np.ndarray
    moves: np.ndarray

    @classmethod
    def empty(cls) -> Field:
        """Without learning, every line is content."""
        w = np.zeros((len(FEATURES), 2))
        w[0, CONTENT] = 1
        return cls(w, np.zeros((2, 2)))

    def viterbi(self, x: np.ndarray) -> np.ndarray:
        """The best labels of one text's lines; ties go to content."""
        score = (x @ self.weights).tolist()
        if not score:
            return np.zeros(0, np.int8)
        (cc, cb), (bc, bb) = self.moves.tolist()
        c, b = score[0]
        back = []
        for ec, eb in score[1:]:
            from_c, from_b = (CONTENT if c + cc >= b + bc else BOILERPLATE), (CONTENT if c + cb >= b + bb else BOILERPLATE)
            back.append((from_c, from_b))
            c, b = max(c + cc, b + bc) + ec, max(c + cb, b + bb) + eb
        out = [CONTENT if c >= b else BOILERPLATE]
        for step in reversed(back):
            out.append(step[out[-1]])
        return np.array(out[::-1], np.int8)

    def _messages(self, e: np.ndarray, live: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward messages and the log of the sum over all labellings, of line scores e [n, t, 2]."""
        n, t, _ = e.shape
        (cc, cb), (bc, bb) = self.moves
        ec, eb, on = np.ascontiguousarray(e[..., 0].T), np.ascontiguousarray(e[..., 1].T), np.ascontiguousarray(live.T)
        ac, ab, zc, zb = (np.zeros((t, n)) for _ in range(4))
        ac[0], ab[0] = ec[0], eb[0]
        for k in range(1, t):
            ac[k] = np.where(on[k], np.logaddexp(ac[k - 1] + cc, ab[k - 1] + bc) + ec[k], ac[k - 1])
            ab[k] = np.where(on[k], np.logaddexp(ac[k - 1] + cb, ab[k - 1] + bb) + eb[k], ab[k - 1])
        for k in range(t - 2, -1, -1):
            c, b = ec[k + 1] + zc[k + 1], eb[k + 1] + zb[k + 1]
            zc[k] = np.where(on[k + 1], np.logaddexp(cc + c, cb + b), 0)
            zb[k] = np.where(on[k + 1], np.logaddexp(bc + c, bb + b), 0)
        return np.stack([ac.T, ab.T], 2), np.stack([zc.T, zb.T], 2), np.logaddexp(ac[-1], ab[-1])

    def marginals(self, x: np.ndarray, live: np.ndarray) -> np.ndarray:
        """Probabilities [n, t, label] of each line of padded sequences."""
        ahead, behind, z = self._messages(x @ self.weights, live)
        return np.exp(ahead + behind - z[:, None, None]) * live[..., None]

    def loss(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean negative log-likelihood of padded sequences x [n, t, f], y, live [n, t], and its gradients."""
        e = x @ self.weights
        ahead, behind, z = self._messages(e, live)
        norm = weight / weight.sum()
        p = np.exp(ahead + behind - z[:, None, None]) * live[..., None]
        truth = np.eye(2)[y] * live[..., None]
        g_w = x.reshape(-1, x.shape[2]).T @ ((p - truth) * norm[:, None, None]).reshape(-1, 2)
        both = live[:, 1:]
        pair = np.exp(ahead[:, :-1, :, None] + self.moves + (e[:, 1:] + behind[:, 1:])[:, :, None, :] - z[:, None, None, None])
        seen = np.einsum("nta,ntb->ntab", truth[:, :-1], truth[:, 1:])
        g_m = ((pair - seen) * (both * norm[:, None])[..., None, None]).sum((0, 1))
        score = (e * truth).sum((1, 2)) + np.einsum("ntab,ab->n", seen, self.moves)
        return float(((z - score) * norm).sum()), g_w, g_m

    def _descend(self, x: np.ndarray, y: np.ndarray, live: np.ndarray, weight: np.ndarray, steps: int, rate: float, l2: float) -> None:
        """Adam on all sequences at once; sequences of like lengths are padded together."""
        values, length = (self.weights, self.moves), live.sum(1)
        groups = []
        for t in (1 << k for k in range(int(length.max()).bit_length() + 1)):
            own = np.flatnonzero((length <= t) & (length > t // 2))
            if len(own):
                groups.append((x[own, :t], y[own, :t], live[own, :t], weight[own], weight[own].sum() / weight.sum()))
        m, v = [np.zeros_like(a) for a in values], [np.zeros_like(a) for a in values]
        for step in range(1, steps + 1):
            grads = [np.zeros_like(a) for a in values]
            for *group, share in groups:
                for g, part in zip(grads, self.loss(*group)[1:], strict=True):
                    g += share * part
            for i, (value, g) in enumerate(zip(values, grads, strict=True)):
                g = g + l2 * value
                m[i] += 0.1 * (g - m[i])
                v[i] += 0.01 * (g * g - v[i])
                value -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)

    @classmethod
    def train(cls, texts: list[np.ndarray], labels: list[int], steps: int = 100, rate: float = 0.1, l2: float = 1e-3, seed: int = 0) -> Field:
        """A field from sequences of line features, each with its document's label.

        The label of a document tells little about a single line, so it is a start only:
        a content document has content lines, of a boilerplate document at least one line
        is boilerplate. In ROUNDS rounds, lines of boilerplate documents that the field is
        SURE are content become content, all but the likeliest boilerplate line. Beside
        every sequence stands one spliced from a content and a boilerplate document, in
        the manner of prose between a page's head and foot, so that both labels and the
        moves between them are seen. Each class weighs the same.
        """
        if len(set(labels)) < 2:
            return cls.empty()
        cut = [(x[k : k + TRAIN_LINES], l) for x, l in zip(texts, labels, strict=True) for k in range(0, len(x), TRAIN_LINES)]
        rng, half = np.random.default_rng(seed), TRAIN_LINES // 2
        own = {k: [i for i, (_, l) in enumerate(cut) if l == k] for k in (CONTENT, BOILERPLATE)}
        parts: list[list[tuple[int, int, int]]] = [[(i, 0, len(x))] for i, (x, _) in enumerate(cut)]  # sequences as ranges of rows of cut
        for i, (x, l) in enumerate(cut):
            j = int(rng.choice(own[1 - l]))
            mine, other = (i, 0, min(len(x), half)), (j, 0, min(len(cut[j][0]), half))
            parts.append([mine, other] if rng.random() < 0.5 else [other, mine])
        t = max(sum(b - a for _, a, b in seq) for seq in parts)
        x, live = np.zeros((len(parts), t, len(FEATURES))), np.zeros((len(parts), t), bool)
        y = [np.full(len(rows), l) for rows, l in cut]
        for n, seq in enumerate(parts):
            rows = np.concatenate([cut[i][0][a:b] for i, a, b in seq])
            x[n, : len(rows)], live[n, : len(rows)] = rows, True
        share = np.bincount([l for _, l in cut], minlength=2)
        weight = np.array([np.mean([1.0 / share[cut[i][1]] for i, _, _ in seq]) for seq in parts])
        field = cls(np.zeros((len(FEATURES), 2)), np.zeros((2, 2)))
        for step in range(ROUNDS):
            target = np.zeros((len(parts), t), int)
            for n, seq in enumerate(parts):
                truth = np.concatenate([y[i][a:b] for i, a, b in seq])
                target[n, : len(truth)] = truth
            field._descend(x, target, live, weight, steps, rate / (1 + step), l2)
            sure = field.marginals(x[: len(cut)], live[: len(cut)])
            for i in own[BOILERPLATE]:
                p = sure[i, : len(cut[i][0])]
                y[i] = np.where(p[:, CONTENT] > SURE, CONTENT, BOILERPLATE)
                y[i][p[:, BOILERPLATE].argmax()] = BOILERPLATE
        return field


def _line_features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Features of a text's lines: at most TRAIN_CUTS runs of TRAIN_LINES lines, at even distances over the whole text."""
    for b in batches:
        out = []
        for text in b.column(1):
            x = measure(text.as_py()).x
            starts = np.unique(np.linspace(0, max(0, len(x) - TRAIN_LINES), TRAIN_CUTS).astype(int)) if len(x) > TRAIN_CUTS * TRAIN_LINES else [0]
            out.append(np.concatenate([x[k : k + TRAIN_LINES] for k in starts]).ravel() if len(starts) > 1 else x.ravel())
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.list_(pa.float64()))], names=["quality", "x"])


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        n_docs: int = TRAIN_DOCS) -> Field:
    """A field from n_docs labelled documents of each class, picked by hash among those not held out.

    Only documents carry labels; train() says what they mean for lines. Features are
    made in tasks: the driver gets at most TRAIN_CUTS * TRAIN_LINES lines of numbers for
    each picked id, however long its text is and however many rows repeat the id (one of
    them is learned from). Rows with a null id, label or text are not; with one class
    or none, every line is content.
    """
    c = F.col
    marked = labels.select(c(id_col).alias("doc_id"), c(quality_col).alias("quality")).where(c("quality").isin(0, 1) & ~held_out(c("doc_id")))
    picked = materialize(hash_sample(marked, n_docs, by=["doc_id"], group="quality"), "picked-labels")
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text")).where("text IS NOT NULL").join(picked, "doc_id")
    rows = rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text"))
    found = rows.select("quality", "text").mapInArrow(_line_features, "quality int, x array<double>").collect()
    texts, y = [], []
    for q, x in sorted((r.quality, r.x) for r in found):
        if len(x):
            texts.append(np.array(x).reshape(-1, len(FEATURES)))
            y.append(BOILERPLATE if q == 0 else CONTENT)
    return Field.train(texts, y)


ADDED = T.StructType([
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()), T.StructField("line_labels", T.StringType()),
    T.StructField("content_share", T.DoubleType()), T.StructField("kept", T.BooleanType())])


def with_line_quality(docs: DataFrame, field: Field, *, text_col: str = "text", min_content: float = MIN_CONTENT, keep_text: bool = True) -> DataFrame:
    """docs with the base numbers, a letter for each line with a word (C or B), content_share and kept.

    Added columns replace those of the same name; other columns may have any name. kept is false where a base rule
    fails, else whether content lines hold at least min_content of the words. Null,
    empty and blank texts have no words and fail. Rows are independent of each other,
    so repeated rows and empty tables need no rule; nothing is shuffled.
    """
    new = [f.name for f in ADDED]
    inner, names = renamed(docs)
    own = names[text_col]
    rest = [i for i, c in enumerate(docs.columns) if c not in new and (keep_text or c != text_col)]
    inner = inner.select(*dict.fromkeys([own, *[f"c{i}" for i in rest]]))
    fields = [inner.schema[f"c{i}"] for i in rest]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column(b.schema.get_field_index(own)):
                m = measure(text.as_py())
                path = field.viterbi(m.x)
                share = float(m.words[path == CONTENT].sum() / m.n_words) if m.n_words else 0.0
                out.append((m.n_words, m.word_chars, m.n_symbols, m.n_dup_lines, m.n_repeat_words, m.base_failed,
                            "".join("CB"[k] for k in path), share, not m.base_failed and share >= min_content))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.string(), pa.float64(), pa.bool_()]
            added = [pa.array(col, kind) for col, kind in zip(list(zip(*out, strict=True)) or [()] * len(new), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([*[b.column(b.schema.get_field_index(f.name)) for f in fields], *added], names=[*[f.name for f in fields], *new])

    return inner.mapInArrow(run, T.StructType([*fields, *ADDED.fields])).toDF(*[docs.columns[i] for i in rest], *new)


def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base numbers and the field's verdict for all documents."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    field = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_line_quality(dealt(docs.select("doc_id", "text")), field, keep_text=False).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share", "line_labels")
