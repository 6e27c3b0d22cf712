"""Quality of texts: a sparse ensemble of rules.

Boosted small trees over text statistics propose rules, the conjunctions along their paths. A logistic regression with an
L1 penalty keeps a few of them and gives each a weight, and the result is a Spark column: a sum of weights of the
rules that hold, put through the logistic function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from workforce_signals.llm.statistics import STATISTICS, with_statistics

# Labelled rows that a model is fitted on: a bounded sample, those with the smallest hashes of their ids.
SAMPLE_ROWS = 20_000
TREES, DEPTH, BINS, LEAST_ROWS, RATE = 24, 3, 24, 8, 0.3
PENALTY, STEPS = 0.002, 400
# Scores from here on count as good.
THRESHOLD = 0.3

Condition = tuple[str, bool, float]  # statistic, whether it must be above, bound


@dataclass(frozen=True)
class RuleModel:
    """Rules with their weights. Printed, it is the whole classifier."""

    bias: float
    rules: tuple[tuple[float, tuple[Condition, ...]], ...]

    def column(self) -> Column:
        """The score, 0 to 1, over columns named like the STATISTICS."""
        total = F.lit(self.bias)
        for weight, conditions in self.rules:
            holds = None
            for name, above, bound in conditions:
                one = F.col(name) > bound if above else F.col(name) <= bound
                holds = one if holds is None else holds & one
            total = total + F.when(holds, weight).otherwise(0.0)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def _tree(bins: np.ndarray, edges: list[np.ndarray], goal: np.ndarray, weight: np.ndarray) -> tuple[list, np.ndarray]:
    """Paths of one tree fitted to ``goal`` and its predictions; splits maximise the gain in squared error."""
    paths, out = [], np.zeros(len(goal))

    def grow(rows: np.ndarray, path: tuple) -> None:
        g, w = goal[rows], weight[rows]
        if path:
            paths.append(path)
        best, at = 1e-6, None
        whole, mass = g.sum(), w.sum() + 1e-9
        if len(path) < DEPTH and len(rows) >= 2 * LEAST_ROWS:
            for f in range(bins.shape[1]):
                k = len(edges[f]) + 1
                if k < 2:
                    continue
                left = np.cumsum(np.bincount(bins[rows, f], g, k))[:-1]
                left_w = np.cumsum(np.bincount(bins[rows, f], w, k))[:-1]
                left_n = np.cumsum(np.bincount(bins[rows, f], minlength=k))[:-1]
                gain = left**2 / (left_w + 1e-3) + (whole - left) ** 2 / (mass - left_w + 1e-3) - whole**2 / mass
                gain[(left_n < LEAST_ROWS) | (len(rows) - left_n < LEAST_ROWS)] = 0
                i = int(gain.argmax())
                if gain[i] > best:
                    best, at = gain[i], (f, i)
        if at is None:
            out[rows] = whole / mass
            return
        f, i = at
        above = bins[rows, f] > i
        bound = float(edges[f][i])
        grow(rows[~above], (*path, (STATISTICS[f], False, bound)))
        grow(rows[above], (*path, (STATISTICS[f], True, bound)))

    grow(np.arange(len(goal)), ())
    return paths, out


def _simplified(path: tuple) -> tuple[Condition, ...]:
    """A path with one bound per statistic and side, in a fixed order."""
    bounds: dict[tuple[str, bool], float] = {}
    for name, above, bound in path:
        old = bounds.get((name, above), bound)
        bounds[name, above] = max(old, bound) if above else min(old, bound)
    return tuple(sorted((name, above, bound) for (name, above), bound in bounds.items()))


def _holds(x: np.ndarray, rule: tuple[Condition, ...]) -> np.ndarray:
    out = np.ones(len(x), bool)
    for name, above, bound in rule:
        column = x[:, STATISTICS.index(name)]
        out &= column > bound if above else column <= bound
    return out


def _lasso(x: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray]:
    """Logistic regression with an L1 penalty by accelerated proximal gradient steps."""
    n, k = x.shape
    mean = x.mean(axis=0)
    centred = x - mean
    limit = 0.25 * (np.linalg.norm(centred, 2) ** 2 / n + 1)
    w, bias = np.zeros(k), math.log((y.sum() + 1) / (n - y.sum() + 1))
    v, c, t = w.copy(), bias, 1.0
    for _ in range(STEPS):
        miss = 1 / (1 + np.exp(-(centred @ v + c))) - y
        new = v - centred.T @ miss / n / limit
        new = np.sign(new) * np.maximum(np.abs(new) - PENALTY / limit, 0)
        new_bias, new_t = c - miss.mean() / limit, (1 + math.sqrt(1 + 4 * t * t)) / 2
        v, c = new + (t - 1) / new_t * (new - w), new_bias + (t - 1) / new_t * (new_bias - bias)
        w, bias, t = new, new_bias, new_t
    return bias - float(mean @ w), w


def fit_rules(x: np.ndarray, y: np.ndarray) -> RuleModel:
    """A model from rows of STATISTICS and labels 0 or 1. Without both labels it is their smoothed share."""
    n, good = len(y), float(y.sum()) if len(y) else 0.0
    if good == 0 or good == n:
        return RuleModel(math.log((good + 1) / (n - good + 1)), ())
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    # A bound between two values of the sample, not on one of them.
    edges = [np.unique([(e + v[v > e].min()) / 2 if (v > e).any() else e for e in es]) for es, v in zip(edges, x.T, strict=True)]
    bins = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], axis=1)
    raw, rules = np.full(n, math.log(good / (n - good))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        paths, out = _tree(bins, edges, y - p, p * (1 - p))
        raw += RATE * np.clip(out, -4, 4)
        for path in paths:
            rules.setdefault(_simplified(path))
    kept, columns, seen = [], [], set()
    for rule in rules:
        column = _holds(x, rule)
        mark = column.tobytes()
        if 0 < column.sum() < n and mark not in seen and (~column).tobytes() not in seen:
            seen.add(mark)
            kept.append(rule)
            columns.append(column)
    if not kept:
        return RuleModel(math.log((good + 1) / (n - good + 1)), ())
    bias, weights = _lasso(np.stack(columns, axis=1).astype(np.float64), y)
    found = tuple((float(w), rule) for w, rule in zip(weights, kept, strict=True) if abs(w) > 1e-9)
    return RuleModel(float(bias), found)


def held_out(key: str = "doc_id", folds: int = 5, fold: int = 0) -> Column:
    """Whether crc32 of the id as text leaves ``fold`` modulo ``folds``; not so without an id."""
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality") -> RuleModel:
    """Fits a model on labelled texts that are not held out: of SAMPLE_ROWS ids at most, those of least hash, one text each.

    Rows with a NULL id or label teach nothing; an id with several labels counts with the smallest, an id with several texts
    with the one of least hash, so that no id weighs more than another.
    """
    narrow = labels.select(F.col(key).alias("_id"), F.col(label).cast("int").alias("_label"))
    narrow = narrow.where("_id IS NOT NULL AND _label IN (0, 1)").where(~held_out("_id"))
    chosen = narrow.groupBy("_id").agg(F.min("_label").alias("_label")).orderBy(F.xxhash64("_id"), "_id").limit(SAMPLE_ROWS)
    texts = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")).join(F.broadcast(chosen), "_id")
    least = F.min(F.struct(F.xxhash64("_text"), "_text")).alias("least")
    texts = texts.groupBy("_id", "_label").agg(least).select("_id", "_label", "least._text")
    found = with_statistics(texts, "_text", ("_id", "_label"))
    rows = found.orderBy("_id").toPandas()  # SAMPLE_ROWS at most
    return fit_rules(rows[list(STATISTICS)].to_numpy(np.float64), rows["_label"].to_numpy(np.float64))


def score(docs: DataFrame, model: RuleModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Rows (key, held_out, score, predicted) of every text, the empty and NULL ones too.

    Rows are neither merged nor dropped; other columns are left out, whatever their names.
    """
    found = with_statistics(docs.select(F.col(key).alias("_id"), F.col(text).alias("_text")), "_text", ("_id",))
    scored = found.select(F.col("_id").alias(key), model.column().alias("score"))
    return scored.select(key, held_out(key).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score THRESHOLD or more, with all their columns."""
    names = {c: f"_c{i}" for i, c in enumerate(docs.columns)}
    renamed = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in names.items()))
    found = with_statistics(renamed, names[text], tuple(names.values()))
    return found.where(model.column() >= THRESHOLD).select(*(F.col(n).alias(c) for c, n in names.items()))
