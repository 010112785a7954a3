"""Quality scores from a sparse ensemble of rules.

Small boosted trees over plain text statistics are taken apart: every path from a root
is a rule, a conjunction of comparisons. A logistic model with a lasso penalty gives
most rules no weight; what is left is compiled into one Spark column expression, so
scoring reads the text once and runs no Python.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import dealt, hash_sample, held_out, materialize, renamed

#: Training: labelled documents of each class, at most; trees, their depth, cut points of a statistic.
TRAIN_DOCS, TREES, DEPTH, CUTS = 2000, 24, 3, 24
PENALTY, CUTOFF = 0.002, 0.3


def statistics(text: Column) -> dict[str, Column]:
    """Numbers of a whole text that rules compare; all zero without words."""
    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    count = lambda pattern: F.regexp_count(text, F.lit(pattern))
    return {
        "words": F.size(words), "distinct_words": F.size(F.array_distinct(words)),
        "lines": F.size(lines), "distinct_lines": F.size(F.array_distinct(lines)),
        "chars": F.length(text), "blanks": count(r"[\x20\x09-\x0D]"), "upper": count("[A-ZÀ-ÖØ-Þ]"), "digits": count("[0-9]"),
        "symbols": count("[#*$%&<>]"), "bars": count(r"\|"), "shouts": count("[!?]"), "stops": count("[.,;:]"),
    }


#: Of the counts above: what the trees see.
RATIOS: dict[str, tuple[str, str]] = {
    "word_length": ("solid", "words"), "distinct_word_share": ("distinct_words", "words"), "distinct_line_share": ("distinct_lines", "lines"),
    "words_per_line": ("words", "lines"), "upper_share": ("upper", "solid"), "digit_share": ("digits", "solid"),
    "symbols_per_word": ("symbols", "words"), "bars_per_word": ("bars", "words"), "shouts_per_word": ("shouts", "words"), "stops_per_word": ("stops", "words"),
}
FEATURES = ["words", *RATIOS]


def with_features(docs: DataFrame, text_col: str, prefix: str = "__q_") -> DataFrame:
    """docs with one double column for each of FEATURES, each computed once."""
    counts = statistics(F.col(text_col))
    docs = docs.withColumns({f"{prefix}n_{k}": v for k, v in counts.items()})
    n = lambda k: (F.col(f"{prefix}n_chars") - F.col(f"{prefix}n_blanks") if k == "solid" else F.col(f"{prefix}n_{k}")).cast("double")
    features = {f"{prefix}words": n("words")} | {f"{prefix}{k}": F.coalesce(F.try_divide(n(a), n(b)), F.lit(0.0)) for k, (a, b) in RATIOS.items()}
    return docs.withColumns(features).drop(*[f"{prefix}n_{k}" for k in counts])


#: A rule: (feature number, True for "greater than" or False for "at most", cut) and so on.
Rule = tuple[tuple[int, bool, float], ...]


def grow(x: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int, path: Rule, rules: set[Rule], out: np.ndarray) -> None:
    """One boosted tree: adds every path to rules and the leaf values to out."""
    if path:
        rules.add(path)
    total_g, total_h, best = g[rows].sum(), h[rows].sum(), (1e-6, -1, 0.0)
    if depth:
        for f, points in enumerate(cuts):
            if not len(points):
                continue
            at = np.searchsorted(points, x[rows, f], side="left")  # how many cuts a value is greater than
            sg = np.bincount(at, g[rows], len(points) + 1).cumsum()[:-1]
            sh = np.bincount(at, h[rows], len(points) + 1).cumsum()[:-1]
            n = np.bincount(at, minlength=len(points) + 1).cumsum()[:-1]
            gain = sg**2 / (sh + 1) + (total_g - sg) ** 2 / (total_h - sh + 1) - total_g**2 / (total_h + 1)
            gain[(n < 5) | (len(rows) - n < 5)] = 0
            k = int(gain.argmax())
            if gain[k] > best[0]:
                best = (float(gain[k]), f, float(points[k]))
    _, f, cut = best
    if f < 0:
        out[rows] = -total_g / (total_h + 1)
        return
    more = x[rows, f] > cut
    grow(x, cuts, g, h, rows[~more], depth - 1, (*path, (f, False, cut)), rules, out)
    grow(x, cuts, g, h, rows[more], depth - 1, (*path, (f, True, cut)), rules, out)


def tree_rules(x: np.ndarray, y: np.ndarray, weight: np.ndarray, seed: int = 0) -> list[Rule]:
    """Distinct paths of boosted trees, each grown on half of the rows and half of the statistics."""
    rng, rules, margin = np.random.default_rng(seed), set(), np.zeros(len(y))
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0.02, 0.98, CUTS))) for f in range(x.shape[1])]
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        step = np.zeros(len(y))
        rows = np.flatnonzero(rng.random(len(y)) < 0.5)
        seen = rng.random(x.shape[1]) < 0.5
        inner: set[Rule] = set()
        own = [c if seen[f] else c[:0] for f, c in enumerate(cuts)]
        grow(x, own, weight * (p - y), weight * p * (1 - p), rows, DEPTH, (), inner, step)
        rules |= inner
        margin += 0.3 * step
    return sorted(rules, key=lambda r: (len(r), r))


def holds(rule: Rule, x: np.ndarray) -> np.ndarray:
    out = np.ones(len(x), bool)
    for f, more, cut in rule:
        out &= (x[:, f] > cut) == more
    return out


def lasso(r: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and intercept of a logistic model with an l1 penalty, by accelerated proximal gradient steps."""
    weight = weight / weight.sum()
    rate = 4.0 / (np.linalg.eigvalsh((r * weight[:, None]).T @ r)[-1] + 1.0)
    w, b, t = np.zeros(r.shape[1]), 0.0, 1.0
    vw, vb = w, b
    for _ in range(steps):
        d = weight * (1 / (1 + np.exp(-(r @ vw + vb))) - y)
        new = vw - rate * (r.T @ d)
        new = np.sign(new) * np.maximum(np.abs(new) - rate * penalty, 0)
        new_b, new_t = vb - rate * d.sum(), (1 + np.sqrt(1 + 4 * t * t)) / 2
        vw, vb = new + (t - 1) / new_t * (new - w), new_b + (t - 1) / new_t * (new_b - b)
        w, b, t = new, new_b, new_t
    return w, b


@dataclass
class RuleModel:
    """Weighted rules and an intercept; without rules, every text scores 1."""

    rules: list[tuple[Rule, float]] = field(default_factory=list)
    intercept: float = 20.0

    @classmethod
    def train(cls, x: np.ndarray, y: np.ndarray, penalty: float = PENALTY) -> RuleModel:
        """Weights of distinct rules; with one class or none, every text scores 1, and where no rule is found, as with a few or constant rows, every text scores a half."""
        if len(np.unique(y)) < 2:
            return cls()
        share = np.bincount(y.astype(int), minlength=2) / len(y)
        weight = 0.5 / share[y.astype(int)]  # the sample's class shares are its own making
        found, columns = [], []
        known = set()
        for rule in tree_rules(x, y, weight):
            column = holds(rule, x)
            if 0 < column.sum() < len(y) and column.tobytes() not in known:
                known.add(column.tobytes())
                found.append(rule)
                columns.append(column)
        if not found:  # too few rows, or rows that no statistic tells apart: the weighted share of label 1
            return cls([], 0.0)
        r = np.array(columns, float).T
        middle, scale = r.mean(0), r.std(0)
        w, b = lasso((r - middle) / scale, y, weight, penalty)
        w = w / scale
        return cls([(rule, float(k)) for rule, k in zip(found, w, strict=True) if k], float(b - w @ middle))

    def scores(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.intercept)
        for rule, k in self.rules:
            total += k * holds(rule, x)
        return 1 / (1 + np.exp(-total))

    def column(self, prefix: str = "__q_") -> Column:
        """The score as an expression over the columns of with_features()."""
        total = F.lit(self.intercept)
        for rule, k in self.rules:
            test = F.lit(True)
            for f, more, cut in rule:
                c = F.col(prefix + FEATURES[f])
                test = test & ((c > cut) if more else (c <= cut))
            total = total + F.when(test, F.lit(k)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))

    def describe(self) -> list[str]:
        """The rules as text, heaviest first."""
        return [f"{k:+.3f} if " + " and ".join(f"{FEATURES[f]} {'>' if more else '<='} {cut:.4g}" for f, more, cut in rule)
                for rule, k in sorted(self.rules, key=lambda x: -abs(x[1]))]


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", quality_col: str = "quality",
        n_docs: int = TRAIN_DOCS) -> RuleModel:
    """A model from n_docs labelled documents of each class, picked by hash among those not held out.

    Statistics are made in tasks; the driver gets one row of numbers for each picked id,
    also where rows repeat the id. Rows with a null id or label are not learned from;
    train() says what few, constant and one-class rows give.
    """
    c = F.col
    marked = labels.select(c(id_col).alias("doc_id"), c(quality_col).alias("quality")).where(c("quality").isin(0, 1) & ~held_out(c("doc_id")))
    picked = materialize(hash_sample(marked, n_docs, by=["doc_id"], group="quality"), "picked-labels")
    rows = docs.select(c(id_col).alias("doc_id"), c(text_col).alias("text")).join(picked, "doc_id")
    rows = with_features(rows.groupBy("doc_id", "quality").agg(F.min_by("text", F.xxhash64("text")).alias("text")), "text")
    data = np.array(sorted(tuple(r) for r in rows.select("quality", *[f"__q_{f}" for f in FEATURES]).collect()), float).reshape(-1, len(FEATURES) + 1)
    return RuleModel.train(data[:, 1:], data[:, 0])


def with_scores(docs: DataFrame, model: RuleModel, *, text_col: str = "text", cutoff: float = CUTOFF) -> DataFrame:
    """docs with score (0 to 1) and predicted (1 from the cutoff on), which replace columns of those names; other columns may have any name.

    Null and empty texts have zero statistics and are scored like any other. Rows are
    independent, so repeated rows and empty tables need no rule; nothing is shuffled.
    """
    keep = [i for i, c in enumerate(docs.columns) if c not in ("score", "predicted")]
    inner, names = renamed(docs)
    marked = with_features(inner, names[text_col])
    out = marked.select(*[f"c{i}" for i in keep], model.column().alias("score")).withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
    return out.toDF(*[docs.columns[i] for i in keep], "score", "predicted")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality scores of all documents; a fifth of them is held out of learning."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return with_scores(dealt(docs.select("doc_id", "text")), model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
