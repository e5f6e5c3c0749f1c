"""align_tracks against a plain loop over whole voiced contours."""

import math

import pytest

from humsearch.plans.queries import align_tracks

ROWS = {0: [110, 220.5, None, 130, 140, 99, 71, 333, 250, 180, 175], 1: [100, 210], 2: [None, None], 3: [55 * 2 ** (k / 7) for k in range(25)], 4: [110, 220.5, 130, 140, 99, 71, 333, 250, 180, 175]}


def naive(x, y):
    d = {(-1, -1): 0.0}
    for i, a in enumerate(x):
        for j, b in enumerate(y):
            d[i, j] = abs(a - b) + min(d.get(k, math.inf) for k in ((i - 1, j - 1), (i, j - 1), (i - 1, j)))
    return d[len(x) - 1, len(y) - 1]


def events(spark, tmp_path, rows):
    made = [(n, n, t, "error" if v is None else "view", float(v or 1)) for n, (t, v) in enumerate((t, v) for t, r in rows.items() for v in r)]
    spark.createDataFrame(made, "event_id long, ts long, user_id long, event_type string, value double").write.parquet(f"{tmp_path}/events.parquet")
    return str(tmp_path)


def test_whole_contours(spark, tmp_path):
    got = {r["track_id"]: r["cost"] for r in align_tracks(spark, events(spark, tmp_path, ROWS)).collect()}
    cents = {t: [1200 * math.log2(v / 55) for v in r if v is not None] for t, r in ROWS.items()}
    assert got.keys() == ROWS.keys() and got[2] is None and got[4] == 0
    for t in (0, 1, 3, 4):
        assert got[t] == pytest.approx(naive(cents[t], cents[0]), abs=1e-5)


def test_without_a_voiced_query(spark, tmp_path):
    rows = {0: [None], 1: [100, 200]}
    assert {tuple(r) for r in align_tracks(spark, events(spark, tmp_path, rows)).collect()} == {(0, 0, None), (0, 1, None)}
