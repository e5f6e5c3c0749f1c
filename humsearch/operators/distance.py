"""Pairwise distances by the usual names: of rows of matrices, and of vectors in DataFrames."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import written


def _ratio(top: np.ndarray, bottom: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return top / bottom


def _canberra(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    size = np.abs(a) + np.abs(b)
    return np.where(size > 0, _ratio(np.abs(a - b), size), 0).sum(-1)


def _cosine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return 1 - _ratio((a * b).sum(-1), np.sqrt((a * a).sum(-1) * (b * b).sum(-1)))


def _centred(x: np.ndarray) -> np.ndarray:
    return x - x.mean(-1, keepdims=True)


#: Distances along the last axis; those of the last three are between rows that ``prepared`` has centred or whitened.
_ALONG = {
    "euclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "sqeuclidean": lambda a, b: ((a - b) ** 2).sum(-1),
    "cityblock": lambda a, b: np.abs(a - b).sum(-1),
    "chebyshev": lambda a, b: np.abs(a - b).max(-1),
    "minkowski": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "canberra": _canberra,
    "braycurtis": lambda a, b: _ratio(np.abs(a - b).sum(-1), np.abs(a + b).sum(-1)),
    "hamming": lambda a, b: (a != b).mean(-1),
    "cosine": _cosine,
    "correlation": _cosine,
    "seuclidean": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
    "mahalanobis": lambda a, b: np.sqrt(((a - b) ** 2).sum(-1)),
}
#: Metrics that depend on how all rows spread.
SPREAD = ("seuclidean", "mahalanobis")


def rowwise(metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """The distance of rows that stand at the same place, of ``prepared`` arrays."""
    if metric not in _ALONG:
        raise ValueError(f"unknown metric {metric!r}")
    return _ALONG[metric]


def whitened(metric: str, covariance: np.ndarray) -> Callable[[np.ndarray], np.ndarray]:
    """What makes rows so that their euclidean distance is the metric's: divided by the
    standard deviations, or by the covariance's Cholesky factor, which a singular one hasn't."""
    if metric == "seuclidean":
        deviation = np.sqrt(np.diag(covariance))
        return lambda rows: _ratio(rows, deviation)
    inverse = np.linalg.inv(np.linalg.cholesky(covariance))
    return lambda rows: rows @ inverse.T


def prepared(x: np.ndarray, y: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """Rows as ``rowwise`` wants them; the spread is that of both sides' rows together."""
    if metric == "correlation":
        return _centred(x), _centred(y)
    if metric in SPREAD:
        of = whitened(metric, np.atleast_2d(np.cov(np.concatenate([x, y]), rowvar=False)))
        return of(x), of(y)
    return x, y


METRICS = tuple(_ALONG)


def pairwise(x: np.ndarray, y: np.ndarray, metric: str = "euclidean") -> np.ndarray:
    """Distances of all rows of x to all of y."""
    of = rowwise(metric)
    x, y = prepared(np.asarray(x, float), np.asarray(y, float), metric)
    return of(x[:, None, :], y[None, :, :])


def covariance(vectors: DataFrame, size: int) -> np.ndarray:
    """The sample covariance of the arrays ``v`` of ``size`` numbers in ``vectors``: means first,
    then sums of centred products, a matrix for each task that are added up by entry."""
    same = vectors.select(F.col("v").cast("array<double>").alias("v")).where((F.size("v") == size) & ~F.exists("v", lambda x: x.isNull()))
    n, *means = same.agg(F.count("*"), *[F.avg(F.get("v", F.lit(k))) for k in range(size)]).first()
    if n < 2:
        raise ValueError("a covariance needs two vectors or more")
    mean = np.array(means)
    row, column = np.triu_indices(size)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((size, size))
        for batch in batches:
            x = np.asarray(batch.column(0).flatten()).reshape(-1, size) - mean
            total += x.T @ x
        yield pa.record_batch([pa.array(row, pa.int32()), pa.array(column, pa.int32()), pa.array(total[row, column])], ["i", "j", "s"])

    # entries, not rows: their number is that of a matrix, whichever the table
    sums = same.mapInArrow(run, "i int, j int, s double").groupBy("i", "j").agg(F.sum("s")).collect()
    out = np.zeros((size, size))
    for i, j, s in sums:
        out[i, j] = out[j, i] = s / (n - 1)
    return out


def distances(vectors: DataFrame, queries: DataFrame, metrics: Sequence[str] = METRICS, wide: bool = False) -> DataFrame:
    """(query_id, vec_id, metric, distance), or if ``wide`` a column for each metric, of all vectors (vec_id, v) to all queries (query_id, v).

    A block of queries goes with the function and meets every vector in place;
    nothing is shuffled. Vectors of another length than a query have no distance to it.
    ``seuclidean`` and ``mahalanobis`` go by the spread of all vectors and queries of a length.
    """
    from .matching import blocks

    names = tuple(metrics)
    for name in names:
        if name not in METRICS:
            raise ValueError(f"unknown metric {name!r}")
    columns = ["query_id", "vec_id", *(names if wide else ("metric", "distance"))]
    schema = "query_id long, vec_id long, " + (", ".join(f"{name} double" for name in names) if wide else "metric string, distance double")
    narrow = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("v").cast("array<double>").alias("v")).where("v is not null")

    spread: dict[int, dict[str, Callable[[np.ndarray], np.ndarray]]] = {}

    def of(ids: np.ndarray, x: np.ndarray) -> DataFrame:
        size = x.shape[1]
        if size not in spread:
            some = [name for name in names if name in SPREAD]
            matrix = covariance(narrow.select("v").union(asked.select("v")), size) if some else None
            spread[size] = {name: whitened(name, matrix) for name in some}
        white = spread[size]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                long_enough = batch.filter(pa.array(np.asarray(batch.column(1).value_lengths()) == x.shape[1]))
                for at in range(0, long_enough.num_rows, 256):
                    piece = long_enough.slice(at, 256)
                    y = np.asarray(piece.column(1).flatten()).reshape(-1, x.shape[1])
                    who = [pa.array(np.repeat(ids, len(y))), pa.array(np.tile(np.asarray(piece.column(0)), len(x)))]
                    found = (pa.array((pairwise(white[name](x), white[name](y)) if name in white else pairwise(x, y, name)).ravel()) for name in names)
                    if wide:
                        yield pa.record_batch([*who, *found], columns)
                    else:
                        for name, d in zip(names, found, strict=True):
                            yield pa.record_batch([*who, pa.array([name] * len(d)), d], columns)

        return narrow.mapInArrow(run, schema)

    found = vectors.sparkSession.createDataFrame([], schema)
    # what stands behind the queries is computed once, whichever the number of blocks
    asked = written(queries.select(F.col("query_id").cast("long").alias("query_id"), F.col("v").cast("array<double>").alias("v")).where("query_id is not null and size(v) > 0"), "queries")
    for rows in blocks(asked, "query_id"):
        for size in {len(r["v"]) for r in rows}:
            same = [r for r in rows if len(r["v"]) == size]
            found = found.union(of(np.array([r["query_id"] for r in same], np.int64), np.array([r["v"] for r in same], float)))
    return found
