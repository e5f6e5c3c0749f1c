"""Pairs dealt by work, and alignments in linear space against full matrices."""

import resource
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from humsearch.functions import pitch as P
from humsearch.operators import diagonals, dtw, pairing

STEPS = (None, ((1, 1), (1, 2), (2, 1)), ((0, 2), (1, 1), (1, 0)), ((1, 0), (0, 1), (1, 1)))


@pytest.mark.parametrize("steps", STEPS)
@pytest.mark.parametrize("subsequence", [False, True])
@pytest.mark.parametrize("radius", [None, 0.25, 0.6])
@pytest.mark.parametrize("codes", [8_000_000, 10])
def test_same_as_full_matrices(steps, subsequence, radius, codes, monkeypatch):
    """Costs and paths, ties included, whether all steps fit in memory or are computed again."""
    monkeypatch.setattr(diagonals, "MOST_CODES", codes)
    rng = np.random.default_rng(len(steps or ()) + 2 * subsequence)
    k = len(steps or dtw.DEFAULT_STEPS)
    for weights in ({}, {"weights_add": tuple(rng.integers(0, 3, k).astype(float)), "weights_mul": tuple(rng.choice([0.0, 0.5, 1, 2], k))}):
        w = dtw.Warping(steps=steps, subsequence=subsequence, band_radius=radius, **weights)
        sides = [tuple(rng.integers(0, 4, (n, 2)).astype(float) for n in rng.integers(1, 14, 2)) for _ in range(12)]
        full = [dtw.align(x.T, y.T, warping=w, backtrack=False).cost for x, y in sides]
        want = [c[-1].min() if subsequence else c[-1, -1] for c in full]
        assert diagonals.solve(sides, warping=w, paths=False)[0].tolist() == want
        given = [np.abs(x[:, :1] - y[:, 0]) for x, y in sides]
        ends = [dtw.align(cost=c, warping=w, backtrack=False).cost for c in given]
        assert diagonals.solve(costs=given, warping=w, paths=False)[0].tolist() == [c[-1].min() if subsequence else c[-1, -1] for c in ends]
        for (x, y), c, total in zip(sides, given, want, strict=True):
            for args, kwargs in (((x.T, y.T), {"sides": [(x, y)]}), ((), {"costs": [c]})):
                try:
                    path = dtw.align(*args, warping=w, **({"cost": c} if not args else {})).path.tolist()
                except ValueError as e:
                    with pytest.raises(ValueError, match=str(e)):
                        diagonals.solve(**kwargs, warping=w)
                else:
                    cost, (got,) = diagonals.solve(**kwargs, warping=w)
                    assert got.tolist() == path and (not args or cost[0] == total)
        fine = [s for s, c in zip(sides, want, strict=True) if np.isfinite(c)]
        if fine and not weights:
            assert [p.tolist() for p in diagonals.solve(fine, warping=w)[1]] == [dtw.align(x.T, y.T, warping=w).path.tolist() for x, y in fine]


def test_long_pair_in_little_memory():
    rng = np.random.default_rng(1)
    x, y = (np.cumsum(rng.integers(-3, 4, 20_000)).astype(float) for _ in range(2))
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    (cost,), (path,) = diagonals.solve([(x, y)])
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 300 * 1024
    i, j = path.T
    # a true path of that very cost
    assert np.abs(x[i] - y[j]).sum() == cost and path[-1].tolist() == [0, 0] and path[0].tolist() == [19_999, 19_999]
    assert {tuple(d) for d in (path[:-1] - path[1:]).tolist()} <= {(1, 1), (0, 1), (1, 0)}


def test_band_does_the_band_only(monkeypatch):
    done = []
    real = diagonals._Problem.cost
    monkeypatch.setattr(diagonals._Problem, "cost", lambda self, d, lo, hi: done.append(hi - lo + 1) or real(self, d, lo, hi))
    x = np.arange(2000.0)
    cells = []
    for n in (1000, 2000):
        done.clear()
        diagonals.solve([(x[:n], x[:n])], warping=dtw.Warping(band_radius=20 / n), paths=False)
        cells.append(sum(done))
    # 39 cells a row, whichever the length
    assert cells[1] < 2.01 * cells[0] < 2.01 * 39 * 1000


def test_errors():
    with pytest.raises(ValueError, match="NaN"):
        diagonals.solve([(np.array([np.nan]), np.array([1.0]))])
    with pytest.raises(ValueError, match="give either"):
        diagonals.solve()
    with pytest.raises(ValueError, match="unknown metric"):
        diagonals.solve([(np.ones(2), np.ones(2))], warping=dtw.Warping(metric="none"))


def contours(spark, lengths, name, value):
    rows = [(k, [float(v) for v in np.random.default_rng(k + 9).integers(0, 9, n)]) for k, n in lengths.items()]
    return spark.createDataFrame(rows, f"{name} long, {value} array<double>"), dict(rows)


@pytest.mark.parametrize("parts, block", [(None, 256), (7, 2)])
def test_every_pair_once(spark, parts, block):
    rng = np.random.default_rng(3)
    qs, q = contours(spark, {k: int(n) for k, n in enumerate(rng.integers(0, 9, 9))} | {-1: 5}, "query_id", "x")
    ts, t = contours(spark, {k: int(n) for k, n in enumerate(rng.integers(0, 30, 40))} | {99: 400}, "track_id", "y")

    def work(tiles):
        import pyarrow as pa

        for tile in tiles:
            for a, b in zip(*np.nonzero(tile.due), strict=True):
                yield pa.record_batch([pa.array([tile.query_ids[a]]), pa.array([tile.track_ids[b]]), pa.array([float(tile.xs[a].sum() * 1000 + tile.ys[b].sum())])], ["q", "t", "s"])

    got = Counter(tuple(r) for r in pairing.paired(qs, ts, work, "q long, t long, s double", parts, block).collect())
    assert got == Counter((a, b, sum(x) * 1000 + sum(y)) for a, x in q.items() for b, y in t.items() if x and y)
    assert pairing.pairs(qs, ts, parts).where(F.size("x") * F.size("y") > 0).count() == len(got)
    assert pairing.pairs(qs.limit(0), ts).count() == pairing.pairs(qs, ts.limit(0)).count() == 0


def test_work_is_even(spark):
    """1,500 tracks, 15 queries and one track of 10,000 frames: no partition has over twice the mean work."""
    rng = np.random.default_rng(4)
    tracks = {k: int(n) for k, n in enumerate(rng.integers(34, 86, 1500))} | {777: 10_000}
    qs, _ = contours(spark, {k: tracks[k] for k in range(0, 1500, 100)}, "query_id", "x")
    ts, _ = contours(spark, tracks, "track_id", "y")
    done = pairing.pairs(qs, ts).select(F.spark_partition_id().alias("part"), (F.size("x").cast("long") * F.size("y")).alias("work")).groupBy("part").agg(F.sum("work").alias("work"))
    work = [r["work"] for r in done.collect()]
    assert len(work) >= spark.sparkContext.defaultParallelism and max(work) <= 2 * sum(work) / len(work)
    assert sum(work) == sum(tracks[k] for k in range(0, 1500, 100)) * sum(tracks.values())


def test_align_all(spark):
    qs, q = contours(spark, {1: 5, 2: 8}, "query_id", "x")
    ts, t = contours(spark, {1: 3, 2: 9, 3: 8}, "track_id", "y")
    for w in (dtw.Warping(), dtw.Warping(subsequence=True), dtw.Warping(band_radius=0.1)):
        got = {(r[0], r[1]): r[2] for r in dtw.align_all(qs, ts, w).collect()}
        for (a, b), cost in got.items():
            full = dtw.align(np.array([q[a]]), np.array([t[b]]), warping=w, backtrack=False).cost
            end = full[-1].min() if w.subsequence else full[-1, -1]
            assert cost == (end if np.isfinite(end) else None)
        assert len(got) == 6
    for r in dtw.align_all(qs, ts, paths=True).collect():
        assert [tuple(p) for p in r["path"]] == [tuple(p) for p in dtw.align(np.array([q[r[0]]]), np.array([t[r[1]]])).path.tolist()]


def test_costs_of_many_references():
    rng, table, turns = np.random.default_rng(5), P.distance_table(), np.arange(0, 24, 2)
    for size in (50, 200_000):
        dtw._MOST_COLUMNS, kept = size, dtw._MOST_COLUMNS
        for _ in range(20):
            q, refs = rng.integers(0, 25, rng.integers(1, 30)), [rng.integers(0, 25, n) for n in rng.integers(1, 40, 20)]
            np.testing.assert_allclose(dtw.subsequence_costs(q, refs, table, turns), [dtw.subsequence_cost(q, r, table, turns) for r in refs], atol=1e-12)
        dtw._MOST_COLUMNS = kept
