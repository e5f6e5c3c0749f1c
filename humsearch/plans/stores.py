"""Queries of the catalogue's stores, and the same in DuckDB SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import pitch as P
from ..shared import shared_dir
from ..sources import bins, catalog, packed, ranges
from .progress import observed

#: Packed tracks whose track_id leaves this remainder by 9 are spoiled, by kind.
SPOILED = {2: "cut", 5: "empty", 7: "missing"}


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, pitch_track) of all tracks."""
    cents = P.hz_to_cents(F.when(F.col("event_type") != "error", F.col("value")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").cast("long").alias("id"), F.struct("ts", "event_id", cents.alias("cents")).alias("x"))
    return packed.encode_tracks(rows.groupBy("id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cents"]).alias("contour")))


def _named(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, title, raga, tala) of all customers."""
    nation = F.broadcast(spark.read.parquet(f"{sf_dir}/nation.parquet"))  # a fixed list of countries
    rows = spark.read.parquet(f"{sf_dir}/customer.parquet").join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
    return rows.select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("raga"), F.col("n_name").alias("tala"))


def embedded(spark: SparkSession, name: str) -> dict[str, str]:
    """Options of a database in the driver's memory, which only local executors can reach."""
    ranges.quiet(spark)
    return {"url": f"jdbc:derby:memory:{name};create=true", "driver": ranges.DRIVER}


def catalogue_over_jdbc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames and metadata of all tracks, by scans of databases, one for each range of ids."""
    table = ranges.scan(spark, ranges.publish(_named(spark, sf_dir).join(_packed(spark, sf_dir), "id", "left")))
    decoded = packed.decode_tracks(catalog.contours(table).where("pitch_track is not null"))
    return decoded.select("id", F.size("contour").cast("long").alias("frames")).join(catalog.metadata(table), "id")


def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a scan of tracks, some of which are spoiled, has met: one row of counters that the scan's own tasks fill."""
    kind = F.col("id") % 9
    blob = F.when(kind == 2, F.expr("substring(pitch_track, 1, length(pitch_track) - 3)")).when(kind == 5, F.lit(packed.encode([]))).when(kind != 7, F.col("pitch_track"))
    tracks = _packed(spark, sf_dir).select("id", blob.alias("pitch_track"))
    decoded, seen = observed(packed.decode_tracks(tracks, "PERMISSIVE"))
    decoded.write.format("noop").mode("overwrite").save()
    got = seen.get
    return spark.createDataFrame([tuple(got[k] for k in ("scanned", "failed", "skipped", "frames"))], "scanned long, failed long, skipped long, frames long")


def stored_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames, voiced frames and summed pitch classes of all tracks, from a table of bins
    that first takes every second track, then the rest, and is compacted."""
    tracks = _packed(spark, sf_dir)
    store = bins.BinsTable(spark, f"{shared_dir(spark)}/bins-{uuid.uuid4().hex}", buckets=8)
    store.add(tracks.where("id % 2 = 0"))
    store.add(tracks)
    store.compact()
    voiced = F.filter("bins", lambda b: b.isNotNull())
    return store.lookup(tracks).select("track_id", F.size("bins").cast("long").alias("frames"), F.size(voiced).cast("long").alias("voiced"), F.aggregate(voiced, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


QUERIES = {f.__name__: f for f in (catalogue_over_jdbc, scan_counts, stored_bins)}

ORACLE_SQL = {
    "catalogue_over_jdbc": "SELECT CAST(c_custkey AS BIGINT) AS id, count(*) AS frames, c_name AS title, c_mktsegment AS raga, n_name AS tala FROM events JOIN customer ON c_custkey = user_id JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL",
    "scan_counts": "WITH t AS (SELECT user_id % 9 AS kind, count(*) AS n FROM events GROUP BY user_id) SELECT count(*) AS scanned, count(*) FILTER (kind IN (2, 7)) AS failed, count(*) FILTER (kind = 5) AS skipped, CAST(coalesce(sum(n) FILTER (kind NOT IN (2, 5, 7)), 0) AS BIGINT) AS frames FROM t",
    "stored_bins": "WITH c AS (SELECT user_id AS track_id, CASE WHEN event_type <> 'error' AND value > 0 THEN round_even(1200 * log2(value / 55), 0) END AS cents FROM events), b AS (SELECT track_id, CAST(round_even((cents - 1200 * floor(cents / 1200)) / 50, 0) AS INT) % 24 AS bin FROM c) SELECT CAST(track_id AS BIGINT) AS track_id, count(*) AS frames, count(bin) AS voiced, CAST(coalesce(sum(bin), 0) AS BIGINT) AS total FROM b GROUP BY track_id",
}
