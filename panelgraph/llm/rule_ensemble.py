"""Quality by a sparse rule ensemble over text statistics, compiled to Spark columns.

1. Statistics of the whole text are Spark column expressions, so fitting and scoring see the same.
2. Small regression trees are boosted on the statistics of a bounded sample of labelled documents
   (see labelled.py). Every path from a root to a node is a rule: a conjunction of thresholds.
3. A logistic regression with an L1 penalty on the rules (proximal gradient) leaves few of them.
   Its intercept is moved from the sample's share of label 1 to that of all labels.
4. The rules left become one column expression: 1 / (1 + exp(-(bias + sum of weights))).

Scoring is one narrow projection. Defined cases: null and empty texts have statistics of 0 and get
a score like any other; if there is no label to learn from, the score is 0.5, and if all labels
are equal it is that label's. Rules that hold for the same rows of the sample are one; ties in strength go to
the earlier rule. Rows that repeat an id are scored each by its text, and the least of them is learnt from;
an empty table gives an empty result; very long texts are measured whole. Other columns of the input
are not read, whatever their names.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from panelgraph.llm.common import is_held_out
from panelgraph.llm.labelled import chosen, share_of_ones

TREES = 40
DEPTH = 3
SHRINK = 0.3
LEAF = 8
PENALTY = 2e-3
STEPS = 400
MAX_RULES = 400
SYMBOLS = "#*$%&<>"


def _count(text: Column, part: str) -> Column:
    return F.when(text.contains(part), (F.length(text) - F.length(F.replace(text, F.lit(part), F.lit("")))) / len(part)).otherwise(0.0)


def with_statistics(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, list[str]]:
    """id and the statistics of the text; shares have 0 where there is nothing to share."""
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b), F.lit(0.0))
    rows = docs.select(id_col, F.coalesce(F.col(text_col), F.lit("")).alias("t_"))
    rows = rows.withColumn("w_", F.array_remove(F.split("t_", r"[\x20\x09-\x0D]+"), ""))
    rows = rows.withColumn("l_", F.filter(F.split("t_", "\n"), lambda x: F.length(F.trim(x)) > 0))
    n_words, n_chars, n_lines = F.size("w_").cast("double"), F.length("t_").cast("double"), F.size("l_").cast("double")
    symbols = F.lit(0.0)
    for c in SYMBOLS:
        symbols = symbols + _count(F.col("t_"), c)
    doubled = F.size(F.filter(F.zip_with("w_", F.slice("w_", 2, F.greatest(F.size("w_") - 1, F.lit(0))), lambda a, b: a == b), lambda x: x))
    stats = {
        "n_words": n_words,
        "word_length": share(n_chars, n_words),
        "distinct_words": share(F.size(F.array_distinct("w_")), n_words),
        "doubled_words": share(doubled, n_words),
        "symbols": share(symbols, n_words),
        "pipes": share(_count(F.col("t_"), "|"), n_words),
        "bangs": share(_count(F.col("t_"), "!!"), n_words),
        "stops": share(_count(F.col("t_"), "."), n_words),
        "commas": share(_count(F.col("t_"), ","), n_words),
        "capitals": share(F.length(F.regexp_replace("t_", r"[^\p{Lu}]+", "")), n_chars),
        "digits": share(F.length(F.regexp_replace("t_", r"[^0-9]+", "")), n_chars),
        "words_per_line": share(n_words, n_lines),
        "repeated_lines": share(F.size("l_") - F.size(F.array_distinct("l_")), n_lines),
    }
    return rows.select(F.col(id_col), *[x.cast("double").alias(f"s_{k}") for k, x in stats.items()]), [f"s_{k}" for k in stats]


@dataclass(frozen=True)
class Rule:
    """All of: statistic `at` is above (or at most) a threshold."""

    tests: tuple[tuple[int, bool, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for at, above, cut in self.tests:
            out &= (x[:, at] > cut) == above
        return out

    def column(self, names: list[str]) -> Column:
        out = F.lit(True)
        for at, above, cut in self.tests:
            out = out & (F.col(names[at]) > cut if above else F.col(names[at]) <= cut)
        return out


def _split(x: np.ndarray, g: np.ndarray, rows: np.ndarray) -> tuple[int, float] | None:
    """The (statistic, threshold) that best splits the residuals g of the rows."""
    best, out = 1e-9, None
    total, n = g[rows].sum(), len(rows)
    for at in range(x.shape[1]):
        v = x[rows, at]
        order = np.argsort(v, kind="stable")
        v, left = v[order], np.cumsum(g[rows][order])[:-1]
        k = np.arange(1, n)
        gain = left**2 / k + (total - left) ** 2 / (n - k) - total**2 / n
        gain[(v[1:] <= v[:-1]) | (k < LEAF) | (n - k < LEAF)] = -1
        if n > 1 and gain.max() > best:
            j = int(gain.argmax())
            best, out = gain[j], (at, float((v[j] + v[j + 1]) / 2))
    return out


def grow_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """Rules from boosted trees, each grown on a seeded half of the rows."""
    rng, f, rules = np.random.default_rng(seed), np.zeros(len(y)), {}

    def grow(rows: np.ndarray, g: np.ndarray, tests: tuple) -> None:
        if tests:
            rules[Rule(tests)] = None
        cut = _split(x, g, rows) if len(tests) < DEPTH and len(rows) >= 2 * LEAF else None
        if cut is None:
            leaf = Rule(tests).holds(x)
            p = 1 / (1 + np.exp(-f[leaf]))
            step[leaf] = (y[leaf] - p).sum() / max((p * (1 - p)).sum(), 1e-3)
            return
        above = x[rows, cut[0]] > cut[1]
        grow(rows[above], g, (*tests, (cut[0], True, cut[1])))
        grow(rows[~above], g, (*tests, (cut[0], False, cut[1])))

    for _ in range(TREES):
        step = np.zeros(len(y))
        half = np.sort(rng.permutation(len(y))[: max(len(y) // 2, min(len(y), 200))])
        grow(half, y - 1 / (1 + np.exp(-f)), ())
        f += SHRINK * np.clip(step, -4, 4)
    return list(rules)


def lasso_logistic(z: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and intercept of an L1-penalised logistic regression, by accelerated proximal gradient."""
    n, k = z.shape
    a = np.hstack([z, np.ones((n, 1))])
    v = np.ones(k + 1)
    for _ in range(20):
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    size = 4 * n / np.linalg.norm(a @ v) ** 2
    w = u = np.zeros(k + 1)
    t = 1.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(a @ u, -50, 50)))
        new = u - size * (a.T @ (p - y)) / n
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - size * PENALTY, 0)
        t2 = (1 + (1 + 4 * t * t) ** 0.5) / 2
        u, w, t = new + (t - 1) / t2 * (new - w), new, t2
    return w[:-1], float(w[-1])


@dataclass(frozen=True)
class RuleModel:
    rules: tuple[Rule, ...]
    weights: tuple[float, ...]
    bias: float

    def column(self, names: list[str]) -> Column:
        z = F.lit(self.bias)
        for r, w in zip(self.rules, self.weights, strict=True):
            z = z + F.when(r.column(names), F.lit(w)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-z))

    def score(self, x: np.ndarray) -> np.ndarray:
        z = self.bias + sum((w * r.holds(x) for r, w in zip(self.rules, self.weights, strict=True)), np.zeros(len(x)))
        return 1 / (1 + np.exp(-z))


def fit(x: np.ndarray, y: np.ndarray, share: float | None) -> RuleModel:
    """share: that of label 1 where the scores are to hold."""
    if len(y) == 0 or y.min() == y.max():
        return RuleModel((), (), 0.0 if len(y) == 0 else 30.0 if y[0] else -30.0)
    rules = grow_rules(x, y)
    if not rules:  # too few rows, or statistics that do not differ
        p = min(max(share if share is not None else y.mean(), 1e-4), 1 - 1e-4)
        return RuleModel((), (), float(np.log(p / (1 - p))))
    z = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    support = z.mean(axis=0)
    uses = np.flatnonzero((support > 0) & (support < 1))
    uses = uses[np.sort(np.unique(z[:, uses], axis=1, return_index=True)[1])]
    spread = np.sqrt(support[uses] * (1 - support[uses]))
    strength = np.abs((z[:, uses] / spread).T @ (y - y.mean()))
    uses = uses[np.sort(np.argsort(-strength, kind="stable")[:MAX_RULES])]
    w, bias = lasso_logistic(z[:, uses], y)
    here, there = y.mean(), min(max(share if share is not None else y.mean(), 1e-4), 1 - 1e-4)
    bias += np.log(there / (1 - there)) - np.log(here / (1 - here))
    kept = [(rules[k], float(v)) for k, v in zip(uses, w, strict=True) if v]
    return RuleModel(tuple(r for r, _ in kept), tuple(v for _, v in kept), float(bias))


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> RuleModel:
    base = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where("id is not null")
    picked = base.join(F.broadcast(chosen(labels, "quality", id_col=id_col)), "id")  # 2 * PER_CLASS ids at most
    picked = picked.groupBy("id", "y", "h").agg(F.min("text").alias("text"))  # one row an id, whatever repeats it
    stats, names = with_statistics(picked.withColumn("row_", F.struct("id", "y", "h")), "row_", "text")
    rows = stats.select("row_.*", *names).toPandas().sort_values(["h", "id"])
    return fit(rows[names].to_numpy(float), rows.y.to_numpy(float), share_of_ones(labels, "quality", id_col))


def quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", cut: float = 0.3) -> DataFrame:
    """One row per document: id, held_out, score, predicted."""
    model = learn(docs, labels, id_col, text_col)
    stats, names = with_statistics(docs, id_col, text_col)
    rows = stats.select(id_col, model.column(names).alias("score"))
    return rows.select(id_col, is_held_out(F.col(id_col)).alias("held_out"), "score", (F.col("score") >= cut).cast("int").alias("predicted"))
