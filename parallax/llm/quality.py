"""Quality classifier: a sparse ensemble of rules (tree paths, lasso logistic weights).

1. Statistics of each text (``textstats``), on the executors.
2. On a bounded labelled sample: shallow trees on bootstrap samples; every path
   from a root to a node is a rule, a conjunction of ``statistic <= cut`` and
   ``statistic > cut`` terms.
3. Logistic regression with an L1 penalty over the rules' 0/1 values (proximal
   gradient); most weights become zero.
4. The rules left over become one Spark column expression:
   ``sigmoid(bias + sum(weight * rule))``.

The sample holds at most about ``training.MAX_LABELLED`` rows of 16 numbers; the
model is a list of at most a few hundred rules. Scoring reads every whole text.

Defined cases: a null or empty text has all statistics zero and gets the score
of that point; without any usable label the score is 1 everywhere (nothing is
rejected); with labels of one class only, the score is that class's smoothed
share. An empty table gives no rows; very long texts are read whole; repeated rows
get equal scores; other columns pass unchanged.
"""

from __future__ import annotations

import json
from dataclasses import dataclass, field
from functools import partial

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parallax.llm.textstats import STATS, stats_batches
from parallax.llm.training import held_out, training_texts

THRESHOLD = 0.3  # fixed by the query's contract
PREFIX = "_stat_"

Term = tuple[str, bool, float]  # statistic, greater than the cut?, cut


@dataclass
class RuleModel:
    """sigmoid(bias + sum of the weights of the rules that hold)."""

    rules: list[tuple[Term, ...]] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)
    bias: float = 0.0

    def to_json(self) -> str:
        return json.dumps({"bias": self.bias, "rules": [{"weight": w, "if": [list(t) for t in r]}
                                                        for r, w in zip(self.rules, self.weights, strict=True)]})

    def holds(self, x: np.ndarray) -> np.ndarray:
        """0/1 of every rule for every row of statistics (in the order of STATS)."""
        return np.stack([_rule_values(r, x) for r in self.rules], axis=1) if self.rules else np.zeros((len(x), 0))

    def score_numpy(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.bias + self.holds(x) @ np.array(self.weights, float))))

    def column(self, prefix: str = PREFIX) -> Column:
        """The score as a column expression over the statistics' columns."""
        z = F.lit(float(self.bias))
        for rule, weight in zip(self.rules, self.weights, strict=True):
            cond = None
            for stat, greater, cut in rule:
                c = F.col(prefix + stat)
                term = (c > F.lit(float(cut))) if greater else (c <= F.lit(float(cut)))
                cond = term if cond is None else cond & term
            z = z + F.when(cond, F.lit(float(weight))).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _rule_values(rule: tuple[Term, ...], x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for stat, greater, cut in rule:
        v = x[:, STATS.index(stat)]
        ok &= (v > cut) if greater else (v <= cut)
    return ok.astype(float)


def _cuts(v: np.ndarray, most: int = 24) -> np.ndarray:
    u = np.unique(v)
    if len(u) < 2:
        return np.empty(0)
    mid = (u[1:] + u[:-1]) / 2
    return mid if len(mid) <= most else np.unique(np.quantile(mid, np.linspace(0, 1, most)))


def _grow(x, y, w, rows, feats_of, depth, path, out, least):
    """Adds the path to every node below; splits by the largest fall of the weighted Gini impurity."""
    if path:
        out.add(path)
    yy, ww = y[rows], w[rows]
    p = (yy * ww).sum() / ww.sum()
    if depth == 0 or p in (0.0, 1.0) or len(rows) < 2 * least:
        return
    best = (1e-9, None)
    base = ww.sum() * p * (1 - p)
    for j in feats_of():
        v = x[rows, j]
        for cut in _cuts(v):
            left = v <= cut
            n_left = left.sum()
            if n_left < least or len(rows) - n_left < least:
                continue
            wl, wr = ww[left].sum(), ww[~left].sum()
            pl, pr = (yy[left] * ww[left]).sum() / wl, (yy[~left] * ww[~left]).sum() / wr
            gain = base - wl * pl * (1 - pl) - wr * pr * (1 - pr)
            if gain > best[0]:
                best = (gain, (j, float(cut), left))
    if best[1] is None:
        return
    j, cut, left = best[1]
    _grow(x, y, w, rows[left], feats_of, depth - 1, path + ((STATS[j], False, cut),), out, least)
    _grow(x, y, w, rows[~left], feats_of, depth - 1, path + ((STATS[j], True, cut),), out, least)


def tree_rules(x: np.ndarray, y: np.ndarray, n_trees: int = 24, depth: int = 3, seed: int = 0) -> list[tuple[Term, ...]]:
    """The paths of shallow trees, each grown on a bootstrap sample of at most 4,000 rows with classes balanced
    and half of the statistics open at a split."""
    rng = np.random.default_rng(seed)
    out: set[tuple[Term, ...]] = set()
    pos, neg = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    half = min(2000, max(len(pos), len(neg)))
    least = max(2, min(20, min(len(pos), len(neg)) // 10))
    for _ in range(n_trees):
        rows = np.concatenate([rng.choice(pos, min(half, 2 * len(pos))), rng.choice(neg, min(half, 2 * len(neg)))])
        w = np.where(y == 1, 0.5 / max(1, (y[rows] == 1).sum()), 0.5 / max(1, (y[rows] == 0).sum()))
        feats = lambda: rng.permutation(x.shape[1])[: max(2, x.shape[1] // 2)]
        _grow(x, y, w, rows, feats, depth, (), out, least)
    return sorted(out)


def lasso_logistic(z: np.ndarray, y: np.ndarray, penalty: float = 1e-3, steps: int = 600) -> tuple[np.ndarray, float]:
    """Weights and bias by accelerated proximal gradient; ``penalty`` is the L1 weight per row."""
    n, k = z.shape
    p = min(max(y.mean(), 1e-4), 1 - 1e-4)
    beta, bias = np.zeros(k), float(np.log(p / (1 - p)))
    # Lipschitz bound of the gradient of the mean loss: largest eigenvalue of Z'Z / (4 n), by power iteration
    aug = np.concatenate([z, np.ones((n, 1))], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):
        v = aug.T @ (aug @ v)
        v /= np.linalg.norm(v)
    rate = 1 / max(1e-9, 0.25 * np.linalg.norm(aug @ v) ** 2 / n * 1.05)
    prev_b, prev_c, t = beta.copy(), bias, 1.0
    yb, yc = beta.copy(), bias
    for _ in range(steps):
        err = 1 / (1 + np.exp(-(z @ yb + yc))) - y
        nb = yb - rate * (z.T @ err / n)
        nb = np.sign(nb) * np.maximum(np.abs(nb) - rate * penalty, 0)
        nc = yc - rate * err.mean()
        t2 = (1 + np.sqrt(1 + 4 * t * t)) / 2
        yb, yc = nb + (t - 1) / t2 * (nb - prev_b), nc + (t - 1) / t2 * (nc - prev_c)
        prev_b, prev_c, t = nb, nc, t2
    return prev_b, float(prev_c)


def fit_rules(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> RuleModel:
    if len(y) == 0:
        return RuleModel(bias=30.0)
    if len(np.unique(y)) < 2:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(bias=float(np.log(p / (1 - p))))
    rules = tree_rules(x, y)
    # rules with equal values on the sample are one rule (the shortest)
    seen, kept, cols = set(), [], []
    for r in sorted(rules, key=lambda r: (len(r), r)):
        v = _rule_values(r, x)
        key = v.tobytes()
        if key not in seen and 0 < v.sum() < len(v):
            seen.add(key)
            kept.append(r)
            cols.append(v)
    if not kept:
        p = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(bias=float(np.log(p / (1 - p))))
    w, bias = lasso_logistic(np.stack(cols, axis=1), y.astype(float), penalty)
    on = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleModel([kept[i] for i in on], [float(w[i]) for i in on], bias)


def with_statistics(docs: DataFrame, text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """``keep`` columns and the statistics (prefixed) of every whole text."""
    keep = keep or []
    # positions instead of names while in Python, so that any column name is safe; the text goes once
    at = keep.index(text_col) if text_col in keep else len(keep)
    src = docs.select(*[F.col(c).alias(f"_k{i}") for i, c in enumerate([*keep, *([] if text_col in keep else [text_col])])])
    schema = T.StructType([T.StructField(f"_k{i}", docs.schema[c].dataType) for i, c in enumerate(keep)]
                          + [T.StructField(s, T.DoubleType()) for s in STATS])
    out = src.mapInArrow(partial(stats_batches, text_at=at, keep=len(keep)), schema)
    return out.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(keep)],
                      *[F.col(s).alias(PREFIX + s) for s in STATS])


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality") -> RuleModel:
    """Fits the rules on the labelled documents outside the held-out fold (a bounded sample)."""
    sample = training_texts(docs, labels, label)
    rows = with_statistics(sample, "text", ["doc_id", "label"]).toPandas()  # bounded by training.MAX_LABELLED
    rows = rows.sort_values(["doc_id", *[PREFIX + s for s in STATS]], kind="stable")
    return fit_rules(rows[[PREFIX + s for s in STATS]].to_numpy(float), rows["label"].to_numpy(int))


def score_quality(docs: DataFrame, model: RuleModel, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """(doc_id, held_out, score, predicted) of every document."""
    stats = with_statistics(docs, text_col, [id_col])
    score = model.column()
    return (stats.select(F.col(id_col).alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), score.alias("score"))
            .withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int")))


def quality_filter(docs: DataFrame, model: RuleModel, text_col: str = "text") -> DataFrame:
    """The documents that the model does not reject, all columns kept, in one pass over the texts."""
    names = docs.columns
    kept = with_statistics(docs, text_col, names)
    return kept.filter(model.column() >= THRESHOLD).select(*names)
