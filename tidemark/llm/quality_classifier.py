"""Quality classifier: a sparse ensemble of conjunctive rules over text statistics (operator 2).

Small boosted trees are grown in numpy on a bounded, hash-chosen sample of labelled documents. Every path from a root to
a node becomes a rule, a conjunction of bounds on statistics; a lasso logistic regression keeps few of them. The kept rules and
weights compile to one Spark column, so scoring is a projection over the statistics of each whole text.

Defined results: null and empty texts have statistics of zero and get a score like any other; rows without a doc_id are
not held out and never train; with labels of one class only, or none, every score is the (smoothed) share of label 1.
Repeated label rows of a document are averaged; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import hashing
from tidemark.llm.common import give_back, text_rows
from tidemark.llm.quality_rules import text_stats

PREFIX = "qc_"
FEATURES = ("words", "mean_word", "symbols", "repeats", "dup_lines", "distinct", "top_word", "upper", "digits", "marks", "short_words", "line_words", "runs")
#: The fit reads at most this many labelled documents, those with the smallest hashes of their ids.
MAX_TRAIN = 12_000
THRESHOLD = 0.3
#: The share of distinct words is taken in blocks of so many words, so that it does not fall with a text's length.
DISTINCT_BLOCK = 200
TREES, DEPTH, BINS, RATE = 40, 3, 32, 0.3
PENALTY = 5e-4


def features(data: np.ndarray) -> np.ndarray:
    """The statistics of one text in UTF-8, in the order of FEATURES; zeros without words."""
    out = np.zeros(len(FEATURES))
    n, word_chars, n_symbols, n_dup, n_repeat, n_lines = text_stats(data)
    if not n:
        return out
    words = hashing.word_hashes(data, fold=True)
    _, counts = np.unique(words, return_counts=True)
    start, end = hashing.word_bounds(data)
    upper = int(((data >= 65) & (data <= 90)).sum())
    lower = int(((data >= 97) & (data <= 122)).sum())
    digits = int(((data >= 48) & (data <= 57)).sum())
    marks = int(((data > 32) & (data < 127)).sum()) - upper - lower - digits
    out[:] = (
        n, word_chars / n, n_symbols / n, n_repeat / n, n_dup / max(n_lines, 1), _distinct(words), counts.max() / n,
        upper / max(upper + lower, 1), digits / len(data), marks / n, ((end - start) <= 3).mean(), n / max(n_lines, 1),
        (words[1:] == words[:-1]).sum() / n,
    )
    return out


def _distinct(words: np.ndarray) -> float:
    """The mean share of distinct words in blocks of a text, the last one from its end, or in all of a shorter one."""
    size = min(DISTINCT_BLOCK, len(words))
    whole = words[: len(words) // size * size].reshape(-1, size)
    blocks = np.sort(whole if len(words) % size == 0 else np.concatenate([whole, words[None, -size:]]), axis=1)
    return float(1 - (blocks[:, 1:] == blocks[:, :-1]).sum() / blocks.size)


def with_features(documents: DataFrame) -> DataFrame:
    """``documents`` with one double column for each of FEATURES, prefixed; the other columns pass through."""
    names = documents.columns
    schema = T.StructType([*documents.schema.fields, *(T.StructField(PREFIX + f, T.DoubleType()) for f in FEATURES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = np.array([np.zeros(len(FEATURES)) if x is None else features(x) for x in text_rows(batch.column("text"))]).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(made[:, i]) for i in range(len(FEATURES)))], schema=pa.schema([*batch.schema, *((PREFIX + f, pa.float64()) for f in FEATURES)]))

    return documents.select(*names).mapInArrow(run, schema)


@dataclass(frozen=True)
class Rule:
    """A conjunction: ``low < feature <= high`` for some features, as (feature, low, high)."""

    bounds: tuple[tuple[int, float, float], ...]

    def holds(self, x: np.ndarray) -> np.ndarray:
        out = np.ones(len(x), bool)
        for f, low, high in self.bounds:
            out &= (x[:, f] > low) & (x[:, f] <= high)
        return out

    def column(self) -> Column:
        out = F.lit(True)
        for f, low, high in self.bounds:
            c = F.col(PREFIX + FEATURES[f])
            if low > -np.inf:
                out &= c > F.lit(float(low))
            if high < np.inf:
                out &= c <= F.lit(float(high))
        return out


@dataclass(frozen=True)
class RuleModel:
    intercept: float
    rules: tuple[tuple[Rule, float], ...]

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.intercept)
        for rule, weight in self.rules:
            z += weight * rule.holds(x)
        return 1 / (1 + np.exp(-z))

    def column(self) -> Column:
        z = F.lit(self.intercept)
        for rule, weight in self.rules:
            z = z + F.when(rule.column(), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-z))


def _tree_rules(x: np.ndarray, binned: np.ndarray, edges: list[np.ndarray], grad: np.ndarray, hess: np.ndarray, rows: np.ndarray) -> tuple[list[Rule], np.ndarray]:
    """Grow one tree on ``rows``: the rules of its nodes, and its step for every row of ``x``."""
    rules: list[Rule] = []
    step = np.zeros(len(x))

    def grow(mine: np.ndarray, every: np.ndarray, bounds: dict[int, tuple[float, float]], depth: int) -> None:
        if bounds:
            rules.append(Rule(tuple((f, *b) for f, b in sorted(bounds.items()))))
        g, h = grad[mine].sum(), hess[mine].sum()
        best = (1e-6, -1, -1)
        if depth < DEPTH and len(mine) >= 20:
            for f in range(x.shape[1]):
                left_g = np.cumsum(np.bincount(binned[mine, f], grad[mine], BINS))[:-1]
                left_h = np.cumsum(np.bincount(binned[mine, f], hess[mine], BINS))[:-1]
                gain = left_g**2 / (left_h + 1) + (g - left_g) ** 2 / (h - left_h + 1) - g**2 / (h + 1)
                gain[(left_h < 0.5) | (h - left_h < 0.5)] = -1
                at = int(gain[: len(edges[f])].argmax()) if len(edges[f]) else 0
                if len(edges[f]) and gain[at] > best[0]:
                    best = (gain[at], f, at)
        if best[1] < 0:
            step[every] = -g / (h + 1)
            return
        _, f, at = best
        cut = float(edges[f][at])
        low, high = bounds.get(f, (-np.inf, np.inf))
        grow(mine[binned[mine, f] <= at], every[binned[every, f] <= at], bounds | {f: (low, min(high, cut))}, depth + 1)
        grow(mine[binned[mine, f] > at], every[binned[every, f] > at], bounds | {f: (max(low, cut), high)}, depth + 1)

    grow(rows, np.arange(len(x)), {}, 0)
    return rules, step


def candidate_rules(x: np.ndarray, y: np.ndarray, seed: int = 7) -> list[Rule]:
    """The paths of boosted trees, each grown on a random half; rules that hold nearly always or never are left out."""
    rng = np.random.default_rng(seed)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    edges = [e[: BINS - 1] for e in edges]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    z = np.full(len(x), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    rules: dict[Rule, None] = {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-z))
        rows = rng.permutation(len(x))[: max(len(x) // 2, min(len(x), 50))]
        found, step = _tree_rules(x, binned, edges, p - y, np.maximum(p * (1 - p), 1e-6), rows)
        z += RATE * step
        rules |= dict.fromkeys(found)
    told_apart: dict[bytes, Rule] = {}
    for r in rules:
        rows = r.holds(x)
        if 0.001 <= rows.mean() <= 0.999:
            told_apart.setdefault(rows.tobytes(), r)
    return list(told_apart.values())


def lasso_logistic(m: np.ndarray, y: np.ndarray, penalty: float = PENALTY, steps: int = 500) -> tuple[float, np.ndarray]:
    """Intercept and weights of a logistic regression with an L1 penalty, by accelerated proximal gradient."""
    n, k = m.shape
    a = np.concatenate([np.ones((n, 1)), m], axis=1)
    v = np.ones(k + 1)
    for _ in range(30):  # the largest eigenvalue gives the step
        v = a.T @ (a @ v)
        v /= np.linalg.norm(v)
    rate = 4 * n / float(v @ (a.T @ (a @ v)))
    w = np.zeros(k + 1)
    w[0] = np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    ahead, t = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a @ ahead)))
        new = ahead - rate * (a.T @ (p - y)) / n
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - rate * penalty, 0)
        after = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead = new + (t - 1) / after * (new - w)
        if np.abs(new - w).max() < 1e-7:
            w = new
            break
        w, t = new, after
    return float(w[0]), w[1:]


def fit(x: np.ndarray, y: np.ndarray) -> RuleModel:
    if not len(y) or y.min() == y.max():
        share = (y.sum() + 1) / (len(y) + 2)
        return RuleModel(float(np.log(share / (1 - share))), ())
    rules = candidate_rules(x, y)
    if not rules:
        return RuleModel(float(np.log(y.mean() / (1 - y.mean()))), ())
    m = np.stack([r.holds(x) for r in rules], axis=1).astype(float)
    intercept, weights = lasso_logistic(m, y)
    return RuleModel(intercept, tuple((r, float(w)) for r, w in zip(rules, weights) if w))


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(documents: DataFrame, labels: DataFrame, max_train: int = MAX_TRAIN, blocked: Callable[[Column], Column] = held_out) -> RuleModel:
    """Fit on the labelled documents outside the held-out fold, at most ``max_train`` of them."""
    marked = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("double").alias("quality")).where("doc_id is not null and quality is not null")
    marked = marked.where(~blocked(F.col("doc_id"))).groupBy("doc_id").agg(F.avg("quality").alias("quality"))
    chosen = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    # At most max_train rows of two numbers, so the broadcast has a fixed bound.
    texts = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).join(F.broadcast(chosen), "doc_id")
    values = F.struct(*(PREFIX + f for f in FEATURES))
    rows = with_features(texts).groupBy("doc_id", "quality").agg(F.min(values).alias("x")).select("doc_id", "quality", "x.*")  # one row an id, however often it stands there
    table = rows.toArrow().to_pandas().sort_values("doc_id", kind="stable")
    x = table[[PREFIX + f for f in FEATURES]].to_numpy(float)
    model = fit(x, (table["quality"].to_numpy() >= 0.5).astype(float))
    give_back()
    return model


def score_documents(documents: DataFrame, model: RuleModel, keep: list[str], threshold: float = THRESHOLD) -> DataFrame:
    """The columns ``keep`` of ``documents`` with ``score`` and ``predicted``."""
    base = documents.select(*dict.fromkeys([*keep, "text"]))
    scored = with_features(base).select(*keep, model.column().alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def quality_classifier(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = train(documents, labels)
    d = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return score_documents(d, model, ["doc_id"]).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")
