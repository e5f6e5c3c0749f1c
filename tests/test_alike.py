"""Rows of the very same array go as one and come out as themselves."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from humsearch.functions.pitch import distance_table
from humsearch.operators import dtw, matching, pairing
from humsearch.plans.queries import ORACLE_SQL, QUERIES

FORMS = [[1.0, 5.0, 2.0], [1.0, 5.0], [9.0], [4.0, 4.0, 4.0, 8.0], [3.0, 1.0]]


@pytest.fixture(scope="module")
def sides(spark):
    """60 tracks of five contours, one of which is usual, a row twice, and a track and a query without any."""
    rows = [(k, FORMS[0 if k % 2 else k % 5]) for k in range(60)] + [(7, FORMS[0]), (60, [])]
    tracks = spark.createDataFrame(rows, "track_id long, y array<double>")
    queries = tracks.where("track_id % 10 in (0, 4, 7)").select(F.col("track_id").alias("query_id"), F.col("y").alias("x"))
    return queries, tracks, Counter((q, t, tuple(x), tuple(y)) for q, x in rows if q % 10 in (0, 4, 7) for t, y in rows if x and y)


def test_an_array_is_dealt_once(spark, sides):
    queries, tracks, _ = sides
    once = pairing.dealt(queries, tracks, parts=1, alike=True)[0].groupBy("kind").count().collect()
    assert dict(map(tuple, once)) == {0: 2, 1: 5}
    assert dict(map(tuple, pairing.dealt(queries, tracks, parts=1)[0].groupBy("kind").count().collect())) == {0: 19, 1: 61}


@pytest.mark.parametrize("alike, batch", [(512, 200_000), (3, 2)])
def test_every_pair_of_rows(spark, sides, alike, batch, monkeypatch):
    monkeypatch.setattr(pairing, "ALIKE", alike)
    queries, tracks, want = sides
    costs = Counter((r["query_id"], r["track_id"], r["cost"]) for r in dtw.align_all(queries, tracks).collect())
    whole = lambda x, y: dtw.align(np.array([x]), np.array([y]), backtrack=False).cost[-1, -1]
    assert costs == sum((Counter({(q, t, whole(x, y)): n}) for (q, t, x, y), n in want.items()), Counter())
    ways = Counter((r["query_id"], r["track_id"], tuple(map(tuple, r["path"]))) for r in dtw.align_all(queries, tracks, paths=True).collect())
    way = lambda x, y: tuple(map(tuple, dtw.align(np.array([x]), np.array([y])).path.tolist()))
    assert ways == sum((Counter({(q, t, way(x, y)): n}) for (q, t, x, y), n in want.items()), Counter())
    pairs = pairing.each_row(pairing.pairs(queries, tracks, alike=True)).collect()
    assert Counter((q, t, tuple(x), tuple(y)) for q, t, x, y in pairs) == want
    monkeypatch.setattr(pairing, "BATCH", batch)
    made = [b.to_pydict() for b in pairing.for_all(np.array([1, 2]), [np.array([5, 6, 7]), np.array([8])], [pa.array([0.5, None])], ["q", "t", "c"])]
    assert Counter(r for b in made for r in zip(b["q"], b["t"], b["c"])) == Counter((q, t, 0.5 if t < 8 else None) for q in (1, 2) for t in (5, 6, 7, 8))


def test_best_of_many_alike(spark, sides):
    bins = sides[1].select("track_id", F.col("y").cast("array<tinyint>").alias("bins"))
    top = matching.match_many(bins, bins.withColumnRenamed("track_id", "query_id").where("query_id in (0, 2, 12)"), k=4).collect()
    table, turns = distance_table(), np.arange(0, 24, 2)
    rows = [(r["track_id"], np.array(r["bins"])) for r in bins.where("size(bins) > 0").collect()]
    for q in (0, 2, 12):
        want = sorted((round(dtw.subsequence_cost(dict(rows)[q], b, table, turns), 9), t) for t, b in rows)[:4]
        assert [(round(r["cost"], 9), r["track_id"]) for r in sorted(top, key=lambda r: r["rank"]) if r["query_id"] == q] == want


@pytest.mark.parametrize("name", ["sql_functions", "match_costs_by_columns", "dtw_steps", "dtw_subsequence_paths"])
def test_copies_as_in_sql(spark, sf_dir, tmp_path, name):
    """Three copies of the tables' first tracks, one of which differs: as many rows as SQL has."""
    import duckdb

    events = spark.read.parquet(f"{sf_dir}/events.parquet").where("user_id < 6")
    copies = [events.withColumns({"user_id": F.col("user_id") + 100 * k, "value": F.col("value") * (2 if k == 2 else 1)}) for k in range(3)]
    copies[0].union(copies[1]).union(copies[2]).write.parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet/*.parquet'")
    want = con.sql(ORACLE_SQL[name])
    got = QUERIES[name](spark, str(tmp_path))
    assert Counter(map(tuple, got.select(*want.columns).collect())) == Counter(want.fetchall())
