"""Queries over the driver's tables, and the same in DuckDB SQL.

Events stand in for pitch tracks: a user is a track, ordered by (ts, event_id),
the value is the frequency and an error event an unvoiced frame. Customers and
nations are the metadata. Embeddings stand in for short pieces of audio.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import pitch as P
from ..operators import matching
from ..operators.distance import distances
from ..operators.dtw import align_all
from ..operators.pairing import ALIKE, each_row, pairs as dealt_pairs
from ..operators.pyin import PitchSettings, differences, minima, padded, pitch
from ..shared import spread, written
from ..sources import packed
from . import stores, tracking, warping
from .search import catalogue_bins, register, search_many

#: Tracks and vectors whose id is divisible by this are the queries, whole.
EVERY = 100


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _f0(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, frame_idx, f0)"""
    order = Window.partitionBy("track_id").orderBy("ts", "event_id")
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), "ts", "event_id", F.when(F.col("event_type") != "error", F.col("value")).alias("f0"))
    return rows.select("track_id", (F.row_number().over(order) - 1).alias("frame_idx"), "f0")


def _contours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(track_id, contour): one array of cents for each track, gathered without a second shuffle."""
    cents = P.hz_to_cents(F.when(F.col("event_type") != "error", F.col("value")))
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("track_id"), F.struct("ts", "event_id", cents.alias("cents")).alias("x"))
    return rows.groupBy("track_id").agg(F.transform(F.array_sort(F.collect_list("x")), lambda x: x["cents"]).alias("contour"))


def _bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _contours(spark, sf_dir).select("track_id", matching.contour_bins(F.col("contour")).alias("bins"))


def _asked(rows: DataFrame, key: str = "track_id") -> DataFrame:
    """The rows that serve as queries, their id as query_id."""
    return rows.where(F.col(key) % EVERY == 0).withColumnRenamed(key, "query_id")


def pitch_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f0(spark, sf_dir).select("track_id", "frame_idx", F.round(P.hz_to_cents(F.col("f0")), 6).alias("cents"))


def pitch_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _f0(spark, sf_dir).select("track_id", "frame_idx", P.pitch_bin(P.hz_to_cents(F.col("f0"))).alias("bin"))


def quantised(spark: SparkSession, sf_dir: str) -> DataFrame:
    sample = P.quantise(P.hz_to_cents(F.col("f0")))
    return _f0(spark, sf_dir).select("track_id", "frame_idx", sample.cast("int").alias("sample"), P.dequantise(sample).alias("cents"))


def delta_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = Window.partitionBy("track_id").orderBy("frame_idx")
    rows = _f0(spark, sf_dir).select("track_id", "frame_idx", P.quantise(P.hz_to_cents(F.col("f0"))).cast("int").alias("sample"))
    rows = rows.withColumn("difference", (F.col("sample") - F.coalesce(F.lag("sample").over(order), F.lit(0))).bitwiseAND(F.lit(65535)))
    return rows.withColumn("restored", packed.undelta(F.sum("difference").over(order)).cast("int"))


def zigzag_coded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signed differences of samples, folded to numbers without sign as in packed tracks, and back to 16 bits."""
    order = Window.partitionBy("track_id").orderBy("frame_idx")
    rows = _f0(spark, sf_dir).select("track_id", "frame_idx", P.quantise(P.hz_to_cents(F.col("f0"))).cast("int").alias("sample"))
    gap = (F.col("sample") - F.coalesce(F.lag("sample").over(order), F.lit(0))).alias("gap")
    folded = F.shiftleft("gap", 1).bitwiseXOR(F.shiftright("gap", 31)).alias("folded")
    return rows.select("track_id", "frame_idx", gap).select("track_id", "frame_idx", folded).withColumn("unfolded", packed.unzigzag(F.col("folded")))


def sql_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all tracks against all queries, by registered SQL functions alone. Tracks and queries
    are dealt to tasks explicitly, as a few bytes of either make long work; those of the very same bins go as one."""
    register(spark)
    parts = 4 * spark.sparkContext.defaultParallelism
    _f0(spark, sf_dir).createOrReplaceTempView("humsearch_f0")
    packed.encode_tracks(_contours(spark, sf_dir)).createOrReplaceTempView("humsearch_packed")
    return spark.sql(f"""
        WITH frames AS (SELECT track_id, frame_idx, pitch_bin(hz_to_cents(f0, 55D), 24) AS bin FROM humsearch_f0),
        tracks AS (SELECT track_id, transform(array_sort(collect_list(struct(frame_idx, bin))), x -> x.bin) AS bins FROM frames GROUP BY track_id),
        stored AS (SELECT track_id, bins, CAST(size(decode_contour(pitch_track)) AS BIGINT) AS frames FROM tracks JOIN humsearch_packed USING (track_id)),
        placed AS (SELECT *, (row_number() OVER (PARTITION BY bins ORDER BY track_id) - 1) DIV {ALIKE} AS some FROM stored),
        alike AS (SELECT bins, some, collect_list(struct(track_id, frames)) AS tracks, collect_list(track_id) FILTER (WHERE track_id % {EVERY} = 0) AS queries FROM placed GROUP BY bins, some),
        met AS (SELECT /*+ REPARTITION({parts}) */ bins, tracks FROM alike),
        asked AS (SELECT /*+ REPARTITION(2) */ bins, queries FROM alike WHERE size(queries) > 0),
        costs AS (SELECT /*+ SHUFFLE_REPLICATE_NL(q) */ queries, tracks, round(dtw_cost(q.bins, t.bins), 6) AS cost FROM met t CROSS JOIN asked q)
        SELECT query_id, t.track_id, cost, t.frames FROM costs LATERAL VIEW explode(queries) AS query_id LATERAL VIEW explode(tracks) AS t""")


def pitch_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pitch_bins(spark, sf_dir).groupBy("track_id", "bin").agg(F.count("*").alias("n"))


def profile_salience(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed profile columns of each track, by class."""
    rows = pitch_bins(spark, sf_dir).groupBy("track_id", "bin").agg(F.count("*").alias("n"))
    each = rows.select("track_id", "n", F.posexplode(P.profile(F.col("bin"))).alias("class", "weight"))
    return each.groupBy("track_id", "class").agg(F.round(F.sum(F.col("weight") * F.col("n")), 6).alias("salience"))


def local_minima(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local minima of the voiced frequencies of each track, but for the first and last frame."""
    voiced = _f0(spark, sf_dir).where("f0 is not null").groupBy("track_id").agg(F.array_sort(F.collect_list(F.struct("frame_idx", "f0"))).alias("frames")).withColumn("values", F.col("frames.f0"))
    found = minima(voiced.select(F.col("track_id").alias("series_id"), "values"))
    joined = found.join(voiced, found.series_id == voiced.track_id).where((F.col("at") > 0) & (F.col("at") < F.size("frames") - 1))
    return joined.select("track_id", F.get("frames", "at").alias("x")).select("track_id", "x.frame_idx", "x.f0")


def period_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Squared differences of each piece of audio and itself, shifted by 1 to 8 samples; past its end it is 0."""
    framed = _table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("audio_id"), F.lit(0).alias("frame_idx"), F.col("embedding").alias("frame"))
    each = differences(framed, 8).select(F.col("audio_id").alias("vec_id"), F.posexplode("differences").alias("lag", "difference"))
    return each.where("lag > 0").select("vec_id", "lag", F.round("difference", 6).alias("difference"))


def vector_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four distances of all vectors to all queries, side by side."""
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("v"))
    names = ("euclidean", "sqeuclidean", "cityblock", "chebyshev")
    found = distances(rows, _asked(rows, "vec_id"), names, wide=True)
    return found.select("query_id", "vec_id", *[F.round(m, 5).alias(m) for m in names])


def match_costs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Costs of all tracks against all queries, whole contours each."""
    bins = _bins(spark, sf_dir)
    return matching.pair_costs(bins, _asked(bins)).select("query_id", "track_id", F.round("cost", 6).alias("cost"))


def match_costs_by_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``match_costs`` with pairs of a query and a track as rows, whose two columns of bins are gone through
    together; those of the very same bins are told apart afterwards."""
    bins, none = _bins(spark, sf_dir), F.lit(-1).cast("tinyint")
    sides = (_asked(bins).select("query_id", F.transform("bins", lambda b: F.coalesce(b, none)).alias("x")), bins.select("track_id", F.transform("bins", lambda b: F.coalesce(b, none)).alias("y")))
    back = lambda side: F.transform(side, lambda b: F.when(b >= 0, b.cast("tinyint")))
    pairs = dealt_pairs(*sides, alike=True).select("query_id", back("x").alias("query"), "track_id", back("y").alias("bins"))
    return each_row(matching.cost_by_columns(pairs).select("query_id", "track_id", F.round("cost", 6).alias("cost")))


def _catalogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = F.broadcast(_table(spark, sf_dir, "nation"))  # a fixed list of countries
    return _table(spark, sf_dir, "customer").join(nation, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").cast("long").alias("id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("raga"), F.col("n_name").alias("tala"))


def search_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole search over packed tracks: blobs read and folded, costs of all queries, their three best, metadata."""
    names = _catalogue(spark, sf_dir)
    blobs = packed.encode_tracks(_contours(spark, sf_dir)).select(F.col("track_id").alias("id"), "pitch_track")
    catalogue = names.join(blobs, "id")
    bins = catalogue_bins(catalogue)
    return search_many(_asked(bins), bins, names).withColumn("cost", F.round("cost", 6))


def search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three best tracks, with metadata, for the whole contour of every track whose track_id is divisible by 100."""
    bins = _bins(spark, sf_dir)
    top = matching.match_many(bins, _asked(bins))
    return matching.with_metadata(top, _catalogue(spark, sf_dir)).withColumn("cost", F.round("cost", 6))


def search_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``search_all`` where every seventh contour is empty, so neither found nor asked for, and some titles and talas are null."""
    bins = _bins(spark, sf_dir).withColumn("bins", F.when(F.col("track_id") % 7 == 3, F.array().cast("array<tinyint>")).otherwise(F.col("bins")))
    top = matching.match_many(bins, _asked(bins))
    some = _catalogue(spark, sf_dir).withColumns({"title": F.when(F.col("id") % 2 == 1, F.col("title")), "tala": F.when(F.col("id") % 3 > 0, F.col("tala"))})
    return matching.with_metadata(top, some.where("id % 11 <> 5")).withColumn("cost", F.round("cost", 6))


def packed_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours packed, then read back: header and samples."""
    blobs = packed.encode_tracks(_contours(spark, sf_dir))
    head = packed.header(F.col("pitch_track"))
    decoded = packed.decode_tracks(blobs.withColumns({"version": head["version"], "frames": head["frames"], "hop_microseconds": head["hop_microseconds"]}))
    return decoded.select("track_id", "version", "frames", "hop_microseconds", F.aggregate("contour", F.lit(0.0), lambda a, c: a + F.coalesce(c, F.lit(0.0))).cast("long").alias("sum_cents"), F.size(F.filter("contour", lambda c: c.isNull())).cast("long").alias("unvoiced"))


def packed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contours packed in words of 16 bits (version 1), then read back."""
    decoded = packed.decode_tracks(packed.encode_tracks(_contours(spark, sf_dir), version=1))
    return decoded.select("track_id", F.posexplode("contour").alias("frame_idx", "cents")).select("track_id", F.col("frame_idx").cast("long").alias("frame_idx"), "cents")


def packed_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What PERMISSIVE reading says of blobs that are spoiled in one of nine ways, by track_id, and what it still reads."""
    blob = F.col("pitch_track")
    part = lambda start, n: F.substring(blob, start, n)
    cut = F.expr("substring(pitch_track, 1, length(pitch_track) - 3)")
    rest = F.expr("substring(pitch_track, 14, length(pitch_track) - 13)")
    ways = [blob, F.concat(F.lit(b"XFPT"), F.expr("substring(pitch_track, 5, length(pitch_track) - 4)")), F.concat(part(1, 4), F.lit(b"\x03"), F.expr("substring(pitch_track, 6, length(pitch_track) - 5)")), cut, F.concat(part(1, 5), F.lit(b"\xff\xff\x00\x00"), part(10, 4), rest), F.concat(part(1, 5), F.lit(b"\x00\x00\x00\x00"), part(10, 4), rest), part(1, 5), F.lit(None).cast("binary"), F.concat(blob, F.lit(b"more"))]
    spoiled = packed.encode_tracks(_contours(spark, sf_dir)).select("track_id", F.get(F.array(*ways), (F.col("track_id") % 9).cast("int")).alias("pitch_track"))
    return packed.decode_tracks(spoiled, "PERMISSIVE").select("track_id", "error", F.size("contour").cast("long").alias("frames"))


def align_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole alignments of all voiced frames of each track with those of each query.
    The cost is null where either has no voiced frames."""
    voiced = written(_contours(spark, sf_dir).select("track_id", F.filter("contour", lambda c: c.isNotNull()).alias("c")), "voiced")
    costs = align_all(_asked(voiced).withColumnRenamed("c", "x"), voiced.withColumnRenamed("c", "y")).withColumn("cost", F.round("cost", 6))
    none = F.size("c") == 0
    without = lambda tracks, queries: tracks.select("track_id").crossJoin(queries.select("query_id")).select("query_id", "track_id", F.lit(None).cast("double").alias("cost"))
    return costs.union(without(voiced.where(none), _asked(voiced))).union(without(voiced.where(~none), _asked(voiced.where(none))))


def hummed_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pitch tracking of a tone for each supplier: the semitone above 110 Hz that is nearest to the median."""
    sr = 4000
    tone = 110.0 * F.pow(F.lit(2.0), (F.col("s_suppkey") % 30) / 12.0)
    samples = F.transform(F.sequence(F.lit(0), F.lit(int(0.6 * sr) - 1)), lambda k: F.sin(2 * 3.141592653589793 * tone * k / sr))
    # a few bytes of a key make a recording, so keys are dealt to tasks explicitly
    suppliers = spread(_table(spark, sf_dir, "supplier").select("s_suppkey"), "s_suppkey")
    audio = suppliers.select(F.col("s_suppkey").cast("long").alias("audio_id"), F.lit(sr).alias("sr"), samples.alias("samples"))
    found = pitch(audio, PitchSettings(fmin=80.0, fmax=800.0, frame_length=256, hop_length=128)).where("voiced").groupBy("audio_id").agg(F.percentile("f0", F.lit(0.5)).alias("median"))
    return found.select("audio_id", F.rint(12 * F.log2(F.col("median") / 110.0)).cast("long").alias("note"))


def padded_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of audio padded by 4 samples, by mode."""
    x = F.col("embedding").cast("array<double>")
    rows = _table(spark, sf_dir, "embeddings").select("vec_id", x.alias("x"))
    total = lambda c: F.round(F.aggregate(c, F.lit(0.0), lambda a, b: a + b), 5)
    return rows.select("vec_id", *[total(padded(F.col("x"), 4, m)).alias(m) for m in ("constant", "edge", "reflect")])


QUERIES = {f.__name__: f for f in (pitch_cents, pitch_bins, quantised, delta_coded, zigzag_coded, sql_functions, pitch_histogram, profile_salience, local_minima, period_differences, vector_distances, match_costs, match_costs_by_columns, search_matches, search_all, search_gaps, packed_tracks, packed_words, packed_errors, align_tracks, hummed_pitch, padded_audio)} | warping.QUERIES | tracking.QUERIES | stores.QUERIES

_F0 = "f0 AS (SELECT user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame_idx, CASE WHEN event_type <> 'error' THEN value END AS f0 FROM events)"
_CENTS = "cents AS (SELECT track_id, frame_idx, CASE WHEN f0 > 0 THEN 1200 * log2(f0 / 55) END AS cents FROM f0)"
_BINS = "bins AS (SELECT track_id, frame_idx, CAST(round_even((cents - 1200 * floor(cents / 1200)) / 50, 0) AS INT) % 24 AS bin FROM cents)"
_SAMPLES = "samples AS (SELECT track_id, frame_idx, CAST(CASE WHEN cents IS NULL THEN -32768 ELSE greatest(-32767, least(32767, round_even(cents, 0))) END AS INT) AS sample FROM cents)"


def _align_sql() -> str:
    """Whole alignments by a recursion over the queries' frames."""
    return f"""
WITH RECURSIVE {_F0}, {_CENTS},
tracks AS (SELECT track_id, coalesce(list(cents ORDER BY frame_idx) FILTER (cents IS NOT NULL), []) AS c FROM cents GROUP BY track_id),
hum AS (SELECT track_id AS query_id, unnest(range(len(c))) AS n, unnest(c) AS q, len(c) AS size FROM tracks WHERE track_id % {EVERY} = 0),
cells AS (SELECT query_id, track_id, n, list_transform(c, lambda v: abs(q - v)) AS c FROM tracks, hum WHERE len(c) > 0),
acc(query_id, track_id, n, d) AS (
  SELECT query_id, track_id, n, list_reduce(list_transform(c, lambda v: [v]), lambda row, v: list_append(row, row[-1] + v[1])) FROM cells WHERE n = 0
  UNION ALL
  SELECT o.query_id, o.track_id, k.n, list_reduce(
    list_concat([[o.d[1] + k.c[1]]], list_transform(range(2, len(k.c) + 1), lambda m: [k.c[m], least(o.d[m - 1], o.d[m])])),
    lambda row, x: list_append(row, x[1] + least(row[-1], x[2])))
  FROM acc o JOIN cells k ON k.query_id = o.query_id AND k.track_id = o.track_id AND k.n = o.n + 1)
SELECT q.track_id AS query_id, t.track_id, round(d[-1], 6) AS cost FROM tracks t JOIN tracks q ON q.track_id % {EVERY} = 0 LEFT JOIN acc ON acc.track_id = t.track_id AND acc.query_id = q.track_id AND acc.n = len(q.c) - 1"""


def _pair_costs_sql(some: str = "true", whole: bool = False) -> str:
    """WITH clause up to costs(query_id, track_id, cost) of whole contours: the longer of two is run
    through by the shorter one. With ``whole`` bins are those of whole cents, as packed."""
    table = P.distance_table()
    lut = "[" + ", ".join(repr(float(x)) for x in table[:24, 0]) + "]"
    away = repr(float(table[0, 24]))
    cell = f"CASE WHEN a[n + 1] IS NULL AND v IS NULL THEN 0.0 WHEN a[n + 1] IS NULL OR v IS NULL THEN {away} ELSE {lut}[((a[n + 1] + turn - v) % 24 + 24) % 24 + 1] END"
    return f"""
WITH RECURSIVE {_F0}, {_CENTS.replace("1200 * log2(f0 / 55)", "round_even(1200 * log2(f0 / 55), 0)") if whole else _CENTS}, {_BINS},
tracks AS (SELECT track_id, list(bin ORDER BY frame_idx) AS refs FROM bins WHERE {some} GROUP BY track_id),
sides AS (SELECT q.track_id AS query_id, t.track_id, shift, CASE WHEN len(q.refs) > len(t.refs) THEN t.refs ELSE q.refs END AS a, CASE WHEN len(q.refs) > len(t.refs) THEN q.refs ELSE t.refs END AS b, CASE WHEN len(q.refs) > len(t.refs) THEN -shift ELSE shift END AS turn
  FROM tracks q JOIN tracks t ON q.track_id % 100 = 0, (SELECT unnest(range(0, 24, 2)) AS shift)),
cells AS (SELECT query_id, track_id, shift, n, list_transform(b, lambda v: CAST({cell} AS DOUBLE)) AS c FROM (SELECT *, unnest(range(len(a))) AS n FROM sides)),
acc(query_id, track_id, shift, n, d) AS (
  SELECT query_id, track_id, shift, n, c FROM cells WHERE n = 0
  UNION ALL
  SELECT o.query_id, o.track_id, o.shift, k.n, list_reduce(
    list_concat([[o.d[1] + k.c[1]]], list_transform(range(2, len(k.c) + 1), lambda m: [k.c[m], least(o.d[m - 1], o.d[m])])),
    lambda row, x: list_append(row, x[1] + least(row[-1], x[2])))
  FROM acc o JOIN cells k ON k.query_id = o.query_id AND k.track_id = o.track_id AND k.shift = o.shift AND k.n = o.n + 1),
costs AS (SELECT query_id, track_id, min(list_min(d) / len(a)) AS cost FROM acc JOIN sides USING (query_id, track_id, shift) WHERE n = len(a) - 1 GROUP BY ALL)"""


def _search_all_sql(some: str = "true", title: str = "c_name", tala: str = "n_name", named: str = "true", whole: bool = False) -> str:
    return _pair_costs_sql(some, whole) + f""",
top AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY round(cost, 9), track_id) AS INT) AS rank FROM costs)
SELECT query_id, rank, round(cost, 6) AS cost, CAST(c_custkey AS BIGINT) AS id, {title} AS title, c_mktsegment AS raga, {tala} AS tala FROM top JOIN customer ON c_custkey = track_id JOIN nation ON n_nationkey = c_nationkey WHERE rank <= 3 AND {named}"""


ORACLE_SQL = {
    "pitch_cents": f"WITH {_F0}, {_CENTS} SELECT track_id, frame_idx, round(cents, 6) AS cents FROM cents",
    "pitch_bins": f"WITH {_F0}, {_CENTS}, {_BINS} SELECT track_id, frame_idx, bin FROM bins",
    "quantised": f"WITH {_F0}, {_CENTS}, {_SAMPLES} SELECT track_id, frame_idx, sample, CAST(nullif(sample, -32768) AS DOUBLE) AS cents FROM samples",
    "delta_coded": f"WITH {_F0}, {_CENTS}, {_SAMPLES} SELECT track_id, frame_idx, sample, (sample - coalesce(lag(sample) OVER (PARTITION BY track_id ORDER BY frame_idx), 0)) & 65535 AS difference, sample AS restored FROM samples",
    "zigzag_coded": f"WITH {_F0}, {_CENTS}, {_SAMPLES}, gaps AS (SELECT track_id, frame_idx, sample - coalesce(lag(sample) OVER (PARTITION BY track_id ORDER BY frame_idx), 0) AS gap FROM samples) SELECT track_id, frame_idx, CAST(CASE WHEN gap >= 0 THEN 2 * gap ELSE -2 * gap - 1 END AS INT) AS folded, CAST(gap & 65535 AS INT) AS unfolded FROM gaps",
    "sql_functions": _pair_costs_sql() + " SELECT query_id, track_id, round(cost, 6) AS cost, CAST(len(refs) AS BIGINT) AS frames FROM costs JOIN tracks USING (track_id)",
    "pitch_histogram": f"WITH {_F0}, {_CENTS}, {_BINS} SELECT track_id, bin, count(*) AS n FROM bins GROUP BY ALL",
    "profile_salience": f"WITH {_F0}, {_CENTS}, {_BINS}, n AS (SELECT track_id, bin, count(*) AS n FROM bins GROUP BY ALL) SELECT track_id, class, round(sum(CASE WHEN bin IS NULL THEN 0 ELSE n * {[float(x) for x in P.kernel()]}[(class - bin + 24) % 24 + 1] END), 6) AS salience FROM n, (SELECT CAST(unnest(range(24)) AS INT) AS class) GROUP BY ALL",
    "local_minima": f"WITH {_F0}, s AS (SELECT *, lag(f0) OVER w AS before, lead(f0) OVER w AS after FROM f0 WHERE f0 IS NOT NULL WINDOW w AS (PARTITION BY track_id ORDER BY frame_idx)) SELECT track_id, frame_idx, f0 FROM s WHERE f0 < before AND f0 <= after",
    "period_differences": "SELECT vec_id, CAST(lag AS INT) AS lag, round(list_sum(list_transform(range(1, len(embedding) + 1), lambda i: (CAST(embedding[i] AS DOUBLE) - coalesce(CAST(embedding[i + lag] AS DOUBLE), 0)) ** 2)), 6) AS difference FROM embeddings, (SELECT unnest(range(1, 9)) AS lag)",
    "vector_distances": f"WITH p AS (SELECT b.vec_id AS query_id, a.vec_id, list_transform(range(1, 65), lambda i: abs(CAST(a.embedding[i] AS DOUBLE) - CAST(b.embedding[i] AS DOUBLE))) AS g FROM embeddings a, embeddings b WHERE b.vec_id % {EVERY} = 0) SELECT query_id, vec_id, round(sqrt(list_sum(list_transform(g, lambda x: x * x))), 5) AS euclidean, round(list_sum(list_transform(g, lambda x: x * x)), 5) AS sqeuclidean, round(list_sum(g), 5) AS cityblock, round(list_max(g), 5) AS chebyshev FROM p",
    "match_costs": _pair_costs_sql() + " SELECT query_id, track_id, round(cost, 6) AS cost FROM costs",
    "match_costs_by_columns": _pair_costs_sql() + " SELECT query_id, track_id, round(cost, 6) AS cost FROM costs",
    "search_matches": _search_all_sql(whole=True),
    "search_all": _search_all_sql(),
    "search_gaps": _search_all_sql("track_id % 7 <> 3", "CASE WHEN c_custkey % 2 = 1 THEN c_name ELSE '' END", "CASE WHEN c_custkey % 3 > 0 THEN n_name ELSE '' END", "c_custkey % 11 <> 5"),
    "packed_words": f"WITH {_F0}, {_CENTS}, {_SAMPLES} SELECT track_id, frame_idx, CAST(nullif(sample, -32768) AS DOUBLE) AS cents FROM samples",
    "packed_errors": "SELECT user_id AS track_id, CASE user_id % 9 WHEN 1 THEN 'bad magic' WHEN 2 THEN 'unknown version' WHEN 3 THEN 'bad deflate stream' WHEN 4 THEN 'truncated' WHEN 5 THEN 'trailing bytes' WHEN 6 THEN 'short header' WHEN 7 THEN 'missing' END AS error, CASE WHEN user_id % 9 IN (0, 8) THEN count(*) END AS frames FROM events GROUP BY user_id",
    "align_tracks": _align_sql(),
    "packed_tracks": f"WITH {_F0}, {_CENTS}, {_SAMPLES} SELECT track_id, 2 AS version, count(*) AS frames, CAST(100000 AS BIGINT) AS hop_microseconds, CAST(sum(CASE WHEN sample = -32768 THEN 0 ELSE sample END) AS BIGINT) AS sum_cents, count(*) FILTER (sample = -32768) AS unvoiced FROM samples GROUP BY track_id",
    "hummed_pitch": "SELECT CAST(s_suppkey AS BIGINT) AS audio_id, CAST(s_suppkey % 30 AS BIGINT) AS note FROM supplier",
    "padded_audio": "WITH e AS (SELECT vec_id, list_transform(embedding, lambda v: CAST(v AS DOUBLE)) AS x FROM embeddings) SELECT vec_id, round(list_sum(x), 5) AS constant, round(list_sum(x) + 4 * x[1] + 4 * x[-1], 5) AS edge, round(list_sum(x) + list_sum(x[2:5]) + list_sum(x[-5:-2]), 5) AS reflect FROM e",
} | warping.ORACLE_SQL | tracking.ORACLE_SQL | stores.ORACLE_SQL
