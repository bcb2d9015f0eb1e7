"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled rows of quality 1; the unlabelled set is web text as it comes, all
documents eligible. The class prior among the unlabelled is estimated, not taken from labels: no
region can hold a larger share of the positives than prior * that share allows, so the least ratio
of unlabelled to positive mass over score regions bounds the prior (Scott 2015). The classifier
minimises the non-negative risk estimator (Kiryo et al. 2017), prior * R_p(+) + max(0, R_u(-) -
prior * R_p(-)), by gradient steps on shape features of whole texts.

Only the fit uses samples: at most ``sample_rows`` positives and as many unlabelled rows, those of
least hash. Every document is scored.

Defined cases: null text counts as empty; empty texts get a score like any other; labels, lang,
source and doc_id are no inputs of a score; with no positives the score is 0.5 everywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out
from .text_features import SHAPE, batches_with, shape, squared

HOLD = (3, 1)


class Model:
    def __init__(self, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray, bias: float, prior: float):
        self.mean, self.scale, self.weights, self.bias, self.prior = mean, scale, weights, bias, prior

    def score(self, rows: np.ndarray) -> np.ndarray:
        z = (squared(rows) - self.mean) / self.scale
        return 1 / (1 + np.exp(-np.clip(np.clip(z, -8, 8) @ self.weights + self.bias, -30, 30)))


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def risk_gradient(p: np.ndarray, u: np.ndarray, prior: float, w: np.ndarray, b: float) -> np.ndarray:
    """The gradient to follow at (w, b), logistic loss: of the whole risk while its negative part
    is not below zero, else of that part's removal."""
    sp, su = _sigmoid(p @ w + b), _sigmoid(u @ w + b)
    negative = -np.log1p(-np.clip(su, 0, 1 - 1e-12)).mean() + prior * np.log1p(-np.clip(sp, 0, 1 - 1e-12)).mean()
    minus = np.append(u.T @ su / len(u) - prior * (p.T @ sp) / len(p), su.mean() - prior * sp.mean())
    plus = prior * np.append(p.T @ (sp - 1) / len(p), (sp - 1).mean())
    return plus + minus if negative >= 0 else -minus


def _nn_pu(p: np.ndarray, u: np.ndarray, prior: float, steps: int = 800, rate: float = 0.02, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Adam on the non-negative risk."""
    w, m, v = np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1), np.zeros(p.shape[1] + 1)
    for t in range(1, steps + 1):
        g = risk_gradient(p, u, prior, w[:-1], w[-1]) + decay * np.append(w[:-1], 0)
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        w = w - rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
    return w[:-1], float(w[-1])


def estimate_prior(p: np.ndarray, u: np.ndarray, least: float = 0.5, steps: int = 300) -> float:
    """The least ratio of unlabelled to positive mass above a score, over cuts that keep ``least``
    of the positives. Scores come from a fit on the other half of the rows, and the halves' ratios
    are averaged, so that neither the fit nor the choice of the cut pulls the estimate down."""
    grid = np.linspace(0.02, 1 - least, 20)
    ratios = np.zeros(len(grid))
    for half in (0, 1):
        w, _ = _nn_pu(p[half::2], u[half::2], 0.5, steps)
        ps, us = p[1 - half :: 2] @ w, u[1 - half :: 2] @ w
        ratios += [(us >= c).mean() / max((ps >= c).mean(), 1e-9) / 2 for c in np.quantile(ps, grid)]
    return float(np.clip(ratios.min(), 0.05, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray) -> Model:
    every = squared(np.concatenate([positive, unlabelled]))
    mean, scale = every.mean(0), every.std(0) + 1e-6
    p, u = (np.clip((squared(x) - mean) / scale, -8, 8) for x in (positive, unlabelled))
    prior = estimate_prior(p, u) if min(len(p), len(u)) > 1 else 0.5
    w, b = _nn_pu(p, u, prior)
    return Model(mean, scale, w, b, prior)


def _sample(docs: DataFrame, ids: DataFrame, n: int) -> np.ndarray:
    """Shape rows of the ``n`` documents among ``ids`` whose hash is least."""
    schema = ", ".join(["doc_id long", *[f"{k} double" for k in SHAPE]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c) for c in shape(batch.column(1)).T]], names=["doc_id", *SHAPE])

    # the ids are chosen first and are at most n, so no text is shuffled; an id may repeat, so the
    # rows are limited again
    chosen = ids.select("doc_id").distinct().orderBy(F.xxhash64(F.lit(3), "doc_id"), "doc_id").limit(n)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id", "left_semi").mapInArrow(run, schema)
    got = rows.orderBy(F.xxhash64(F.lit(3), *rows.columns), *rows.columns).limit(n).toArrow()
    got = got.take(pa.array(np.argsort(got.column("doc_id").to_numpy(), kind="stable")))
    return np.stack([got.column(k).to_numpy() for k in SHAPE], 1) if got.num_rows else np.empty((0, len(SHAPE)))


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> Model | None:
    trusted = labels.filter((F.col("quality") == 1) & ~held_out(*HOLD)).select("doc_id").distinct()
    every = docs.select("doc_id").filter("doc_id is not null")
    positive = _sample(docs, every.join(trusted, "doc_id", "left_semi"), sample_rows)
    unlabelled = _sample(docs, every, sample_rows)
    return fit(positive, unlabelled) if len(positive) and len(unlabelled) else None


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from batches_with(batches, lambda texts: model.score(shape(texts)) if model else np.full(len(texts), 0.5), "score")

    out = docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", held_out(*HOLD).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000) -> DataFrame:
    return score(docs, train(docs, labels, sample_rows))
