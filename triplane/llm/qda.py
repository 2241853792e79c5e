"""Quality classifier: regularised quadratic discriminant over transformed document statistics."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, utf8
from .textstats import IS_CODE, IS_DIGIT, IS_LETTER, IS_LINE, IS_SHOUT, IS_STOP, IS_UPPER, Statistics, squeezed, statistics


def features(s: Statistics) -> np.ndarray:
    """Rows of transformed statistics: logarithms of sizes, square roots of shares."""
    size, n = np.maximum(s.n_bytes, 1), np.maximum(s.n_words, 1)
    share = lambda table: np.sqrt(s.count(table) / size)
    distinct = np.array([len(np.unique(s.words.hash[a:b])) for a, b in s.spans], float)
    ratio = np.array([len(x) / squeezed(x) if x else 1.0 for x in s.texts])
    lines = s.count(IS_LINE) + 1
    return np.column_stack([
        np.log1p(s.n_words),
        np.log1p(s.word_chars / n),
        np.sqrt(s.count(IS_UPPER) / np.maximum(s.count(IS_LETTER), 1)),
        share(IS_DIGIT),
        np.sqrt(s.n_symbols / size),
        share(IS_STOP),
        share(IS_SHOUT),
        share(IS_CODE),
        np.sqrt(s.n_repeat_words / n),
        np.sqrt(s.n_dup_lines / lines),
        np.log1p(distinct) / np.log1p(n),
        np.log(ratio),
        np.log1p(n / lines),
    ])


def text_features(column: pa.Array) -> np.ndarray:
    return np.concatenate([features(s) for s in statistics(*utf8(column))])


@dataclass(frozen=True)
class Model:
    """Per class: label, log prior, mean, inverse Cholesky factor and half log determinant of its covariance."""

    labels: tuple[int, ...]
    priors: np.ndarray
    means: np.ndarray
    whitening: np.ndarray
    half_logdet: np.ndarray

    def score(self, x: np.ndarray, positive: int = 1) -> np.ndarray:
        """Posterior of ``positive``; without training rows 0.5."""
        if not self.labels:
            return np.full(len(x), 0.5)
        logs = []
        for prior, mean, white, half in zip(self.priors, self.means, self.whitening, self.half_logdet, strict=True):
            z = (x - mean) @ white.T
            logs.append(prior - half - 0.5 * np.einsum("ij,ij->i", z, z))
        logs = np.array(logs)
        weights = np.exp(logs - logs.max(0))
        return sum((w for w, k in zip(weights, self.labels, strict=True) if k == positive), np.zeros(len(x))) / weights.sum(0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = 20_000, shrink: float = 0.3, ridge: float = 0.02, key: str = "doc_id", text: str = "text") -> Model:
    """Class moments of at most ``sample`` labelled documents, those with the least hash of the key.

    The sample's keys are so few that they are broadcast; class sums, not rows, reach the driver.
    A class covariance is ``1-shrink`` its own and ``shrink`` the pooled one, plus ``ridge`` of the mean
    variance on the diagonal; the Cholesky factors are computed once and kept in the model.
    Null keys or labels are left out; a repeated (key, label) counts once; no labels give an empty model.
    """
    few = labels.select(key, F.col(label).cast("int").alias("_label")).where(f"{key} IS NOT NULL AND _label IS NOT NULL").distinct()
    few = few.orderBy(F.xxhash64(key), "_label").limit(sample)
    rows = docs.select(key, text).join(F.broadcast(few), key)

    def moments(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, y = text_features(batch.column(0)), batch.column(1).to_numpy()
        x1 = np.column_stack([np.ones(len(x)), x])
        kinds = np.unique(y)
        sums = np.array([(x1[y == k].T @ x1[y == k]).ravel() for k in kinds])
        width = sums.shape[1]
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(kinds, width), pa.int32()), pa.array(np.tile(np.arange(width), len(kinds)), pa.int32()), pa.array(sums.ravel())],
            ["label", "place", "value"],
        )

    sums = arrow_map(rows.select(text, "_label"), moments, "label int, place int, value double")
    cells = sums.groupBy("label", "place").agg(F.sum("value").alias("value")).orderBy("label", "place").collect()
    by_label: dict[int, list[float]] = {}
    for r in cells:
        by_label.setdefault(r.label, []).append(r.value)
    return _model({k: np.array(v).reshape(int(len(v) ** 0.5), -1) for k, v in by_label.items()}, shrink, ridge)


def _model(sums: dict[int, np.ndarray], shrink: float, ridge: float) -> Model:
    if not sums:
        return Model((), *(np.zeros(0),) * 4)
    n = np.array([m[0, 0] for m in sums.values()])
    means = np.array([m[0, 1:] / m[0, 0] for m in sums.values()])
    scatter = np.array([m[1:, 1:] - m[0, 0] * np.outer(mu, mu) for m, mu in zip(sums.values(), means, strict=True)])
    pooled = scatter.sum(0) / n.sum()
    scale = np.diag(np.diag(pooled) + 1e-6)
    white, half = [], []
    for s, k in zip(scatter, n, strict=True):
        cholesky = np.linalg.cholesky((1 - shrink) * s / k + shrink * pooled + ridge * scale)
        white.append(np.linalg.inv(cholesky))
        half.append(np.log(np.diag(cholesky)).sum())
    return Model(tuple(sums), np.log(n / n.sum()), means, np.array(white), np.array(half))


def quality_score(model: Model, text: str = "text") -> Column:
    """Posterior of label 1 for a text column; a null or empty text has the score of a text without words."""

    @F.arrow_udf("double")
    def score(column: pa.Array) -> pa.Array:
        return pa.array(model.score(text_features(column)) if len(column) else np.zeros(0))

    return score(F.col(text))


def classify(docs: DataFrame, labels: DataFrame, cutoff: float = 0.3, key: str = "doc_id", text: str = "text", **fit_options) -> DataFrame:
    """Fit on ``labels`` and score every row of ``docs``: ``key, score, predicted``."""
    model = fit(docs, labels, key=key, text=text, **fit_options)
    scored = docs.select(key, quality_score(model, text).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= cutoff).cast("int"))
