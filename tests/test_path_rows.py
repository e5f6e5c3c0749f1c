"""Paths as rows, costs given frame by frame, and steps counted for the pairs of a batch at once."""

import numpy as np
import pytest

from humsearch.operators import diagonals, dtw


@pytest.mark.parametrize("w", [dtw.Warping(), dtw.Warping(subsequence=True), dtw.Warping(subsequence=True, weights_add=(0.0, 5.0, 10.0), weights_mul=(2.0, 0.5, 1.0))])
def test_rows_are_the_paths(spark, w):
    rng = np.random.default_rng(7)
    rows = [(k, rng.integers(0, 5, n).astype(float).tolist()) for k, n in enumerate(rng.integers(1, 12, 14).tolist())]
    tracks = spark.createDataFrame(rows, "track_id long, y array<double>")
    queries = spark.createDataFrame(rows[:3], "query_id long, x array<double>")
    given = lambda x, y: np.abs(x - y.T)
    for kwargs in ({}, {"cost": given}, {"cost": given, "framewise": True}):
        got: dict = {}
        for r in sorted(dtw.path_rows(queries, tracks, w, **kwargs).collect()):
            got.setdefault((r["query_id"], r["track_id"]), []).append((r["k"], r["i"], r["j"]))
        assert len(got) == 42
        for (q, t), way in got.items():
            x, y = np.array([rows[q][1]]), np.array([rows[t][1]])
            full = dtw.align(cost=given(x.T, y.T), warping=w) if kwargs else dtw.align(x, y, warping=w)
            assert way == [(k, *p) for k, p in enumerate(full.path.tolist())]


def test_many_tracks_in_one_call():
    rng, calls = np.random.default_rng(8), []
    x, ys = rng.integers(0, 9, (7, 1)).astype(float), [rng.integers(0, 9, (n, 1)).astype(float) for n in (3, 7, 9, 4)]
    given = diagonals.Framewise(lambda a, b: calls.append(1) or np.abs(a - b.T), x, ys)
    w = dtw.Warping(subsequence=True)
    costs, way, lengths = diagonals.solved_flat(costs=given, warping=w)
    # those that are taller than wide and the others
    assert len(calls) == 2
    ways = np.split(np.stack([way >> 32, way & 0xFFFFFFFF], 1), np.cumsum(lengths)[:-1])
    for y, cost, path in zip(ys, costs, ways, strict=True):
        full = dtw.align(cost=np.abs(x - y.T), warping=w)
        assert cost == full.cost[-1].min() and path.tolist() == full.path.tolist()
