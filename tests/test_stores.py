"""The catalogue over JDBC, the table of bins, and counters of scans."""

import subprocess
import sys
import threading
import uuid
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from humsearch.plans import stores
from humsearch.plans.progress import observed
from humsearch.sources import bins, catalog, packed


def catalogue(spark, n=40):
    rows = [(k, bytearray(packed.encode([100.0 * k, None, 50.0])), f"t{k}", None if k % 2 else "r", "x") for k in range(n)]
    return spark.createDataFrame(rows, "id long, pitch_track binary, title string, raga string, tala string")


@pytest.fixture(scope="module")
def database(spark):
    options = stores.embedded(spark, f"t{uuid.uuid4().hex}")
    catalog.to_jdbc(catalogue(spark), "tracks", options)
    return options


def test_jdbc_ranges_and_filters(spark, database):
    table = catalog.from_jdbc(spark, "tracks", database, partitions=5)
    assert table.rdd.getNumPartitions() == 5 and table.count() == 40
    assert {len(p) for p in table.select("id").rdd.glom().collect()} == {8}
    found = catalog.metadata(table, [3, 39, 77])
    assert {(r["id"], r["title"], r["raga"]) for r in found.collect()} == {(3, "t3", None), (39, "t39", None)}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "In(id, [3,39,77])" in plan and "pitch_track" not in plan.split("ReadSchema")[1]
    scan = catalog.contours(table)._jdf.queryExecution().executedPlan().toString()
    assert "title" not in scan.split("ReadSchema")[1]
    assert packed.decode_tracks(catalog.contours(table)).where("id = 7").first()["contour"] == [700.0, None, 50.0]
    with pytest.raises(Exception, match="already exists"):
        catalog.to_jdbc(catalogue(spark), "tracks", database)


def test_jdbc_empty_table(spark):
    options = stores.embedded(spark, f"t{uuid.uuid4().hex}")
    catalog.to_jdbc(catalogue(spark).limit(0), "tracks", options)
    assert catalog.from_jdbc(spark, "tracks", options).count() == 0


def test_stopped_server_is_tried_again(spark, monkeypatch):
    """Nothing listens there: five attempts, then the last error. A missing table is no matter of the connection: one attempt."""
    waits = []
    monkeypatch.setattr(catalog, "time", SimpleNamespace(sleep=waits.append))
    stopped = {"url": "jdbc:hive2://127.0.0.1:9/x", "driver": "org.apache.hive.jdbc.HiveDriver"}
    with pytest.raises(Exception, match="(?i)refused|could not open"):
        catalog.from_jdbc(spark, "tracks", stopped, wait=0.5)
    assert waits == [0.5] * (catalog.ATTEMPTS - 1)
    waits.clear()
    with pytest.raises(Exception, match="(?i)does not exist"):
        catalog.from_jdbc(spark, "nowhere", stores.embedded(spark, f"t{uuid.uuid4().hex}"))
    assert not waits


def test_bins_without_shuffle_of_the_table(spark, tmp_path):
    store = bins.BinsTable(spark, str(tmp_path), buckets=4)
    tracks = catalogue(spark)
    assert store.bins(tracks.where("id < 10")).count() == 10
    for df in (store.missing(tracks), store.lookup(tracks)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        stored = [line for line in plan.splitlines() if "Bucketed: true" in line or "SelectedBucketsCount: 4 out of 4" in line]
        assert stored and plan.count("Exchange") == 1
    got = {r["track_id"]: r["bins"] for r in store.bins(tracks).collect()}
    assert got == {k: [2 * k % 24, None, 1] for k in range(40)}
    # the same blob under another id is there already; a changed one is not
    again = spark.createDataFrame([(99, bytearray(packed.encode([0.0, None, 50.0]))), (0, bytearray(packed.encode([100.0]))), (5, None)], "id long, pitch_track binary")
    assert store.missing(again).count() == 1
    assert {r["track_id"]: r["bins"] for r in store.bins(again).collect()} == {99: [0, None, 1], 0: [2]}


def test_two_writers_and_compaction(spark, tmp_path):
    tracks, errors = catalogue(spark), []
    stores_ = [bins.BinsTable(spark, str(tmp_path), buckets=4) for _ in range(2)]

    def write(store):
        try:
            store.add(tracks)
        except Exception as e:  # noqa: BLE001
            errors.append(e)

    stores_[0].add(tracks.limit(0))
    threads = [threading.Thread(target=write, args=(s,)) for s in stores_]
    for t in threads:
        t.start()
    for t in threads:
        t.join(120)
    assert not errors
    one, other = stores_
    assert one.rows().count() == other.rows().count() == 40 and one.lookup(tracks).count() == 40
    raw = spark.read.parquet(one._generation()).count()
    assert 40 <= raw <= 80
    assert one.compact() and one.generations() == [0, 1]
    assert spark.read.parquet(one._generation()).count() == 40 == other.rows().count()
    # a generation that another compaction published first stays
    other._generation = lambda: f"{other.folder}/v=000000"
    assert not other.compact() and one.generations() == [0, 1]
    one.vacuum()
    assert one._names(one.folder) == ["v=000001"] and one.lookup(tracks).count() == 40


def test_a_bad_track_leaves_nothing(spark, tmp_path):
    store = bins.BinsTable(spark, str(tmp_path), buckets=2)
    bad = catalogue(spark, 3).unionByName(spark.createDataFrame([(9, bytearray(b"junk"))], "id long, pitch_track binary"), allowMissingColumns=True)
    with pytest.raises(Exception, match="short header"):
        store.add(bad)
    assert store.rows().count() == 0
    assert store.bins(bad, "PERMISSIVE").count() == 3


def test_counters(spark):
    rows = [(1, bytearray(packed.encode([1.0, None]))), (2, bytearray(packed.encode([]))), (3, bytearray(b"junk")), (4, None), (5, bytearray(packed.encode([5.0])))]
    df, seen = observed(packed.decode_tracks(spark.createDataFrame(rows, "id long, pitch_track binary"), "PERMISSIVE"))
    assert df.count() == 5 and seen.get == {"scanned": 5, "failed": 2, "skipped": 1, "frames": 3}
    df, seen = observed(packed.decode_tracks(spark.createDataFrame([], "id long, pitch_track binary")))
    assert df.count() == 0 and seen.get == {"scanned": 0, "failed": 0, "skipped": 0, "frames": 0}


RETRIED = """
from pyspark import TaskContext
from pyspark.sql import SparkSession
from humsearch.plans.progress import observed
from humsearch.sources import packed

spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "5").getOrCreate()
rows = [(k, bytearray(packed.encode([1.0] * (k % 3)))) for k in range(100)]
df, seen = observed(packed.decode_tracks(spark.createDataFrame(rows, "id long, pitch_track binary").repartition(4), "PERMISSIVE"))

def once(batches):
    for k, batch in enumerate(batches):
        if k == 2 and TaskContext.get().attemptNumber() == 0:
            raise RuntimeError("lost")
        yield batch

print("ROWS", df.mapInArrow(once, df.schema).count(), sorted(seen.get.items()))
"""


def test_counters_after_retried_tasks():
    """Every task fails once, after some batches; its counts enter once."""
    done = subprocess.run([sys.executable, "-c", RETRIED], capture_output=True, text=True, timeout=180)
    assert "ROWS 100 [('failed', 0), ('frames', 99), ('scanned', 100), ('skipped', 34)]" in done.stdout, done.stderr[-2000:]


def test_embedded_database_is_local(spark, sf_dir):
    assert stores.catalogue_over_jdbc(spark, sf_dir).select(F.sum("frames")).first()[0] > 0
