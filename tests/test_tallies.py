"""Kernels of alignments that hold some diagonals only."""

import numpy as np
import pytest

from humsearch.operators import diagonals, dtw


@pytest.mark.parametrize("w", [dtw.Warping(), dtw.Warping(subsequence=True), dtw.Warping(steps=((1, 1), (1, 2), (2, 1))), dtw.Warping(band_radius=0.3)])
def test_steps_as_in_full_matrices(w):
    rng = np.random.default_rng(0)
    sides = [tuple(rng.integers(0, 9, (n, 1)).astype(float) for n in rng.integers(1, 14, 2)) for _ in range(30)]
    n, places = diagonals.tallied(sides, w)
    for k, (x, y) in enumerate(sides):
        cost = np.abs(x - y.T)
        steps = np.maximum(dtw.accumulate(dtw.band(cost, w.band_radius) if w.band_radius else cost, w)[1], 0)
        weights = np.outer(np.arange(1, len(x) + 1), np.arange(1, len(y) + 1))
        assert [(np.sum(steps == s), weights[steps == s].sum()) for s in range(len(w.moves()))] == list(zip(n[k], places[k]))


def test_precision_follows_the_numbers():
    """Whole numbers whose sums single precision holds are summed in it, with the very costs and paths of the full matrices; others in double."""
    rng, w = np.random.default_rng(1), dtw.Warping(subsequence=True)
    for scale, kind in ((1.0, np.float32), (0.1, np.float64), (1e6, np.float64)):
        x = np.rint(rng.normal(0, 30, (9, 1))) * scale
        sides = [(x, np.rint(rng.normal(0, 30, (n, 1))) * scale) for n in (4, 9, 9, 20)]
        assert diagonals._Problem(sides, None, w).kind == kind and diagonals._Problem(sides, None, w).x.shape[1] == 1
        costs, ways = diagonals.solve(sides, warping=w)
        for (a, b), cost, way in zip(sides, costs, ways, strict=True):
            full = dtw.align(a.T, b.T, warping=w)
            assert cost == full.cost[-1].min() and way.tolist() == full.path.tolist()


def test_distances_side_by_side_without_a_shuffle(spark, sf_dir):
    from humsearch.plans import queries

    plan = queries.vector_distances(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "MapInArrow" in plan
