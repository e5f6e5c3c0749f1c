"""Quality classifier: regularised quadratic discriminant analysis.

Each text becomes a short vector of transformed statistics. One distributed
aggregation gathers, for either class, the count, sums and cross products of
the labelled rows; from these the driver builds shrunken covariances (a few
hundred numbers whatever the corpus) and their Cholesky factors once. A text's
score is the logistic of the difference of the two Gaussian log-densities.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from operator import eq

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from .common import keep, learns, one_label

#: Names of the statistics, in order.
FEATURES = ("log_words", "adjacent_repeats", "upper_words", "odd_chars", "exclamations", "bars", "log_word_chars", "digits", "spread", "repeat_runs")
_ODD = re.compile(r"[^\w\s.,;:!?'\"()|-]")
_DIGIT = re.compile(r"[0-9]")
THRESHOLD = 0.3


def statistics(text: str | None) -> list[float]:
    """The statistics of one whole text; null counts as empty. Shares enter by
    their square root, sizes by their logarithm, which draws in long tails."""
    text = text or ""
    words = text.split()
    n, chars = len(words), max(1, len(text))
    d = max(1, n)
    same = sum(map(eq, words, words[1:]))
    loud = sum(1 for w in words if len(w) > 1 and w.isupper())
    triples = sum(map(eq, words[2:], words)) if n > 2 else 0
    share = (same / d, loud / d, len(_ODD.findall(text)) / chars, text.count("!") / d, text.count("|") / d, len(_DIGIT.findall(text)) / chars, len(set(words)) / d, triples / d)
    a, b, c, e, f, g, h, i = (min(1.0, x) ** 0.5 for x in share)
    return [np.log1p(n), a, b, c, e, f, np.log1p(len(text) / d), g, h if n else 1.0, i]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def statistics_udf(text: pd.Series) -> pd.Series:
    return pd.Series([statistics(t) for t in text])


@dataclass(frozen=True)
class Discriminant:
    """Means, inverse Cholesky factors, log-determinants and log-prior of classes 0 and 1; mean is None if a class had no rows."""

    mean: np.ndarray | None
    factor: np.ndarray | None
    log_det: np.ndarray | None
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), 1 / (1 + np.exp(-self.log_odds)))
        z = [((x - self.mean[c]) @ self.factor[c].T) for c in (0, 1)]
        gap = 0.5 * ((z[0] ** 2).sum(1) - (z[1] ** 2).sum(1) + self.log_det[0] - self.log_det[1]) + self.log_odds
        return 1 / (1 + np.exp(-np.clip(gap, -60, 60)))


def fit(rows: DataFrame, x: str = "x", label: str = "label", shrinkage: float = 0.1, floor: float = 1e-3) -> Discriminant:
    """Fit on rows with a vector column and a 0/1 label.

    Covariances are drawn by ``shrinkage`` towards the pooled diagonal and get
    ``floor`` on it, so constant columns and classes of a few rows stay
    invertible. With no rows of a class the score is the (smoothed) prior.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    v = [F.col(x)[i] for i in range(d)]
    got = {r["label"]: r for r in rows.groupBy(F.col(label).alias("label")).agg(F.count("*").alias("n"), *[F.sum(v[i]).alias(f"s{i}") for i in range(d)], *[F.sum(v[i] * v[j]).alias(f"p{i}_{j}") for i, j in pairs]).collect()}
    n = [got[c]["n"] if c in got else 0 for c in (0, 1)]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if not all(n):
        return Discriminant(None, None, None, log_odds)
    mean, cov = [], []
    for c in (0, 1):
        m = np.array([got[c][f"s{i}"] for i in range(d)]) / n[c]
        s = np.zeros((d, d))
        for i, j in pairs:
            s[i, j] = s[j, i] = got[c][f"p{i}_{j}"] / n[c] - m[i] * m[j]
        mean.append(m)
        cov.append(s)
    pooled = np.diag(np.clip((n[0] * np.diag(cov[0]) + n[1] * np.diag(cov[1])) / sum(n), 0, None))
    factor = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled + floor * np.eye(d)) for s in cov]
    log_det = np.array([2 * np.log(np.diag(f)).sum() for f in factor])
    return Discriminant(np.array(mean), np.array([np.linalg.inv(f) for f in factor]), log_det, log_odds)


def score_vectors(model: Discriminant, x: Column) -> Column:
    """Score of a column of statistics."""

    @F.pandas_udf(T.DoubleType())
    def run(v: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.array(v.tolist(), float).reshape(-1, len(FEATURES))))

    return run(x)


def train(vectors: DataFrame, labels: DataFrame) -> Discriminant:
    """The model learned from the labelled training rows of (doc_id, x)."""
    return fit(vectors.select("doc_id", "x").where(learns()).join(one_label(labels, "quality"), "doc_id"))


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every document (one row for each
    row; repeated rows repeat). Null or empty texts are scored like any other;
    a null doc_id is not held out and never learned from. Without labels every
    score is the prior, 0.5."""
    vectors = keep(docs.select("doc_id", statistics_udf(F.col("text").cast("string")).alias("x")), "quality")
    model = train(vectors, labels)
    scored = vectors.select("doc_id", (~F.coalesce(learns(), F.lit(True))).alias("held_out"), score_vectors(model, F.col("x")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def filter_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose score reaches the threshold, all columns as they are.
    The statistics are computed once and stand beside the rows until they are scored."""
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = keep(docs.select("doc_id", statistics_udf(F.col("text").cast("string")).alias("x"), own), "quality")
    return rows.where(score_vectors(train(rows, labels), F.col("x")) >= THRESHOLD).select("row.*")
