"""Queries of pitch tracking, and the same in DuckDB SQL.

An embedding of 64 numbers is a frame of noise; fifty successive vec_ids are a
recording, in which the first forty frames also hold a tone that steps upwards. The
settings give lags 2 to 31, 48 pitch bins and 96 states, with
transitions of an even width.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..functions import pitch as P
from ..operators.decoding import likeliest
from ..operators.pyin import PitchSettings, analysed, decoded, decoded_in_blocks, frames, local_transition, loop_transition

RATE, RECORDING, NOISE = 8000, 50, 0.2
SETTINGS = PitchSettings(fmin=260.0, fmax=4000.0, frame_length=64, hop_length=64, resolution=1.0)
#: Settings of transition matrices: window, width, whether it wraps around.
WINDOWS = tuple((shape, width, wrap) for shape in ("triangle", "boxcar", "hann", "hamming") for width in (4, 5) for wrap in (False, True))
STATES = 12
#: Frames of a long recording, those of a block of it, and those before a block.
LONG, BLOCK, AHEAD = 250, 64, 32
#: The least probability of a transition that is possible.
LEAST = 0.15


def _frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    frame_idx = F.col("vec_id") % RECORDING
    tone = 500.0 * F.pow(F.lit(2.0), F.floor(frame_idx / 8) / 6.0)
    wave = lambda e, i: e.cast("double") * NOISE + F.when(frame_idx < 40, F.sin(i * tone * (2 * math.pi / RATE))).otherwise(0.0)
    return rows.select(F.expr(f"vec_id div {RECORDING}").alias("audio_id"), F.lit(RATE).alias("sr"), frame_idx.alias("frame_idx"), F.transform("embedding", wave).alias("frame"))


def _analysed(spark: SparkSession, sf_dir: str) -> DataFrame:
    vec_id = (F.col("audio_id") * RECORDING + F.col("frame_idx")).alias("vec_id")
    return analysed(_frames(spark, sf_dir), SETTINGS, detail=True).select(vec_id, "*")


def audio_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Energy of overlapping frames of 16 samples, 8 apart."""
    audio = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("audio_id"), F.lit(RATE).alias("sr"), F.col("embedding").cast("array<double>").alias("samples"))
    each = frames(audio, PitchSettings(frame_length=16, hop_length=8, center=False))
    return each.select(F.col("audio_id").alias("vec_id"), "frame_idx", F.round(F.aggregate("frame", F.lit(0.0), lambda a, b: a + b * b), 6).alias("energy"))


def normalised_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative-mean-normalised difference of every frame by lag, and its parabolic shift."""
    pairs = F.arrays_zip("differences", "shifts")
    each = _analysed(spark, sf_dir).select("vec_id", F.posexplode(pairs).alias("k", "x"))
    return each.select("vec_id", "k", F.round("x.differences", 6).alias("difference"), F.round("x.shifts", 6).alias("shift"))


def trough_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Local minima of the normalised difference and their probabilities."""
    each = _analysed(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("troughs", "weights")).alias("x"))
    return each.select("vec_id", F.col("x.troughs").alias("k"), F.round("x.weights", 6).alias("weight"))


def observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability of each voiced state of each frame, but for vanishing ones."""
    each = _analysed(spark, sf_dir).select("vec_id", F.explode(F.arrays_zip("states", "probs")).alias("x")).where("x.probs > 1e-6")
    return each.select("vec_id", F.col("x.states").alias("state"), F.round("x.probs", 6).alias("prob"))


def voiced_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _analysed(spark, sf_dir).select("vec_id", F.round("voiced_prob", 6).alias("voiced_prob"))


def tracked_pitch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f0 of every frame, decoded over each recording."""
    return decoded(analysed(_frames(spark, sf_dir), SETTINGS), SETTINGS).select("audio_id", "frame_idx", F.round("f0", 4).alias("f0"), "voiced", F.round("voiced_prob", 6).alias("voiced_prob"))


def _long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames of ``_frames`` as recordings of LONG of them each."""
    number = F.col("audio_id") * RECORDING + F.col("frame_idx")
    return _frames(spark, sf_dir).withColumns({"audio_id": F.call_function("div", number, F.lit(LONG)), "frame_idx": (number % LONG).cast("int")})


def tracked_pitch_in_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """f0 of every frame of long recordings, decoded in blocks of time."""
    found = decoded_in_blocks(analysed(_long(spark, sf_dir), SETTINGS), SETTINGS, block=BLOCK, ahead=AHEAD)
    return found.select("audio_id", "frame_idx", F.round("f0", 4).alias("f0"), "voiced")


def viterbi_pruned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Likeliest states of vectors as observations, fifty a series, where rare transitions are impossible."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    size = lambda e: F.abs(e.cast("double")) + 0.01
    some = F.transform(F.slice("embedding", 1, STATES), size)
    probs = F.transform(some, lambda v: v / F.aggregate(some, F.lit(0.0), lambda a, b: a + b))
    series = rows.select(F.expr(f"vec_id div {RECORDING}").alias("series_id"), (F.col("vec_id") % RECORDING).alias("step"), probs.alias("probs"))
    found = likeliest(series, local_transition(STATES, 5), LEAST)
    return found.select("series_id", "step", "state", F.round("log_prob", 6).alias("log_prob"))


def _weights(spark: SparkSession, sf_dir: str, states: int) -> DataFrame:
    """(vec_id, i, w): the first numbers of each vector, without sign, as weights of states."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return rows.select("vec_id", F.posexplode(F.transform(F.slice("embedding", 1, states), lambda e: F.abs(e.cast("double")))).alias("i", "w"))


def transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of states after a step of local transition matrices, times their number, by window, width and wrapping; width 0: a width for each state."""
    made = [(shape, width, wrap, local_transition(STATES, width, shape, wrap)) for shape, width, wrap in WINDOWS]
    made.append(("triangle", 0, False, local_transition(STATES, [1 + k % 5 for k in range(STATES)])))
    rows = [(shape, width, wrap, i, float(m[i] @ np.arange(STATES))) for shape, width, wrap, m in made for i in range(STATES)]
    where = F.broadcast(spark.createDataFrame(rows, "shape string, width int, wrap boolean, i int, mean double"))  # STATES rows a matrix
    met = _weights(spark, sf_dir, STATES).join(where, "i")
    return met.groupBy("vec_id", "shape", "width", "wrap").agg(F.round(F.sum(F.col("w") * F.col("mean")), 6).alias("moved"))


def loop_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights of states after a step of a loop transition matrix with a probability to stay for each state, as voiced and unvoiced copies of a local one."""
    m = np.kron(loop_transition(2, [0.75, 0.5]), loop_transition(4, 0.25))
    rows = [(i, j, float(m[i, j])) for i in range(8) for j in range(8)]
    met = _weights(spark, sf_dir, 8).join(F.broadcast(spark.createDataFrame(rows, "i int, j int, p double")), "i")  # 64 rows
    return met.groupBy("vec_id", "j").agg(F.round(F.sum(F.col("w") * F.col("p")), 6).alias("w"))


def half_precision_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed distances of each frame's profile column to the one before it, whose stored side is rounded to 16 bits."""
    table = P.distance_table(half_precision=True)
    flat = F.array(*[F.lit(float(v)) for v in table.ravel()])
    order = Window.partitionBy("track_id").orderBy("ts", "event_id")
    cents = P.hz_to_cents(F.when(F.col("event_type") != "error", F.col("value")))
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("user_id").alias("track_id"), "ts", "event_id", F.coalesce(P.pitch_bin(cents), F.lit(24)).alias("bin"))
    pairs = rows.withColumn("before", F.lag("bin").over(order)).where("before is not null")
    return pairs.groupBy("track_id").agg(F.round(F.sum(F.get(flat, F.col("bin") * 25 + F.col("before"))), 6).alias("distance"))


QUERIES = {f.__name__: f for f in (audio_frames, normalised_differences, trough_weights, observations, voiced_probability, tracked_pitch, tracked_pitch_in_blocks, viterbi_pruned, transitions, loop_transitions, half_precision_distances)}

_LOW, _HIGH = SETTINGS.periods(RATE)
_BINS = 48
_DIFFERENCES = f"""x AS (SELECT vec_id, list_transform(range(1, len(embedding) + 1), lambda i: CAST(embedding[i] AS DOUBLE) * {NOISE} + CASE WHEN vec_id % {RECORDING} < 40 THEN sin((i - 1) * (500 * 2.0::DOUBLE ** (floor((vec_id % {RECORDING}) / 8) / 6)) * (2 * pi() / {RATE})) ELSE 0 END) AS x FROM embeddings),
raw AS (SELECT vec_id, lag, list_sum(list_transform(range(1, len(x) + 1), lambda i: (x[i] - coalesce(x[i + lag], 0)) ** 2)) AS d FROM x, (SELECT unnest(range(1, {_HIGH + 1})) AS lag)),
mean AS (SELECT vec_id, lag, d, sum(d) OVER (PARTITION BY vec_id ORDER BY lag) / lag AS mean FROM raw),
y AS (SELECT vec_id, CAST(lag - {_LOW} AS INT) AS k, d / CASE WHEN mean = 0 THEN 1e-12 ELSE mean END AS y FROM mean WHERE lag >= {_LOW}),
around AS (SELECT *, lag(y) OVER w AS b, lead(y) OVER w AS a FROM y WINDOW w AS (PARTITION BY vec_id ORDER BY k)),
shifted AS (SELECT *, CASE WHEN a IS NULL OR b IS NULL THEN 0.0 WHEN abs((a - b) / 2) < abs(a + b - 2 * y) THEN -((a - b) / 2) / (a + b - 2 * y) ELSE 0.0 END AS shift FROM around)"""
_TROUGHS = """trough AS (SELECT * FROM shifted WHERE CASE WHEN b IS NULL THEN y < a WHEN a IS NULL THEN y < b ELSE y < b AND y <= a END),
threshold AS (SELECT j / 100.0::DOUBLE AS t, ((1 - (1 - j / 100.0::DOUBLE) ** 18 * (1 + 18 * j / 100.0::DOUBLE)) - (1 - (1 - (j - 1) / 100.0::DOUBLE) ** 18 * (1 + 18 * (j - 1) / 100.0::DOUBLE))) AS beta FROM (SELECT unnest(range(1, 101)) AS j)),
below AS (SELECT vec_id, k, beta, row_number() OVER (PARTITION BY vec_id, t ORDER BY k) - 1 AS rank, count(*) OVER (PARTITION BY vec_id, t) AS n FROM trough, threshold WHERE y < t),
ranked AS (SELECT vec_id, k, sum((1 - exp(-2)) * exp(-2 * rank) / (1 - exp(-2 * n)) * beta) AS p FROM below GROUP BY ALL),
lowest AS (SELECT vec_id, k, 0.01 * (SELECT coalesce(sum(beta), 0) FROM threshold WHERE t <= y) AS p FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY y, k) AS o FROM trough) WHERE o = 1),
weighed AS (SELECT trough.vec_id, trough.k, trough.shift, coalesce(ranked.p, 0) + coalesce(lowest.p, 0) AS p FROM trough LEFT JOIN ranked USING (vec_id, k) LEFT JOIN lowest USING (vec_id, k))"""
_OBSERVED = f"""binned AS (SELECT vec_id, k, p, greatest(0, least({_BINS}, round_even(12 * log2({RATE} / ({_LOW} + k + shift) / 260), 0))) AS bin FROM weighed WHERE p <> 0),
seen AS (SELECT vec_id, CAST(bin AS INT) AS state, arg_max(p, k) AS prob FROM binned WHERE bin < {_BINS} GROUP BY vec_id, bin),
voiced AS (SELECT vec_id, least(1, coalesce(sum(prob), 0)) AS voiced_prob FROM embeddings LEFT JOIN seen USING (vec_id) GROUP BY vec_id)"""
_TINY = "2.2250738585072014e-308"
# an even window of width 4 goes from one state below to two above
_MOVES = f"""local AS (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS p FROM (SELECT i, i - 1 + m AS j, [0.25, 0.75, 0.75, 0.25][m + 1] AS p FROM (SELECT unnest(range({_BINS})) AS i), (SELECT unnest(range(4)) AS m)) WHERE j >= 0 AND j < {_BINS}),
pairs AS (SELECT a AS i, b AS j FROM (SELECT unnest(range({2 * _BINS})) AS a), (SELECT unnest(range({2 * _BINS})) AS b)),
moves AS (SELECT list(row ORDER BY j) AS into_ FROM (SELECT pairs.j, list(ln(coalesce(CASE WHEN pairs.i // {_BINS} = pairs.j // {_BINS} THEN 0.99 ELSE 0.01 END * local.p, 0) + {_TINY}) ORDER BY pairs.i) AS row FROM pairs LEFT JOIN local ON local.i = pairs.i % {_BINS} AND local.j = pairs.j % {_BINS} GROUP BY pairs.j)),
dense AS (SELECT v.vec_id // {RECORDING} AS audio_id, CAST(v.vec_id % {RECORDING} AS INT) AS t, list(ln(CASE WHEN s.s < {_BINS} THEN least(1, coalesce(seen.prob, 0)) ELSE (1 - v.voiced_prob) / {_BINS} END + {_TINY}) ORDER BY s.s) AS o FROM voiced v CROSS JOIN (SELECT CAST(unnest(range({2 * _BINS})) AS INT) AS s) s LEFT JOIN seen ON seen.vec_id = v.vec_id AND seen.state = s.s GROUP BY ALL)"""
_DECODED = f"""walk(audio_id, t, v, back) AS (
  SELECT audio_id, t, list_transform(o, lambda x: x + ln(1.0::DOUBLE / {2 * _BINS} + {_TINY})), NULL::INT[] FROM dense WHERE t = 0
  UNION ALL
  SELECT audio_id, t, list_transform(range(1, {2 * _BINS} + 1), lambda j: o[j] + list_max(came[j])), list_transform(came, lambda c: CAST(list_position(c, list_max(c)) AS INT))
  FROM (SELECT d.audio_id, d.t, d.o, list_transform(moves.into_, lambda row: list_transform(range(1, {2 * _BINS} + 1), lambda i: w.v[i] + row[i])) AS came FROM walk w JOIN dense d ON d.audio_id = w.audio_id AND d.t = w.t + 1, moves)),
back_(audio_id, t, s) AS (
  SELECT w.audio_id, w.t, CAST(list_position(w.v, list_max(w.v)) AS INT) FROM walk w JOIN (SELECT audio_id, max(t) AS t FROM dense GROUP BY audio_id) USING (audio_id, t)
  UNION ALL
  SELECT b.audio_id, b.t - 1, w.back[b.s] FROM back_ b JOIN walk w ON w.audio_id = b.audio_id AND w.t = b.t WHERE b.t > 0)"""
_F = {
    "triangle": "CASE WHEN w % 2 = 1 THEN least(m + 1, w - m) / ((w + 1) / 2.0) ELSE (2 * least(m + 1, w - m) - 1) / (w * 1.0) END",
    "boxcar": "1.0",
    "hann": "0.5 - 0.5 * cos(2 * pi() * m / w)",
    "hamming": "0.54 - 0.46 * cos(2 * pi() * m / w)",
}
_G = """w AS (SELECT CAST(o AS INT) AS o, exp(-o * o / 18.0) AS w FROM (SELECT unnest(range(-12, 13)) AS o)),
g AS (SELECT k, sum(w) / (SELECT sum(w) FROM w) AS g FROM (SELECT (o + 24) % 24 AS k, w FROM w) GROUP BY k),
g2 AS (SELECT k, g, 2.0 ** (floor(log2(g)) - 10) AS unit FROM g),
bins AS (SELECT CAST(unnest(range(25)) AS INT) AS b)"""

#: Triangles of width 5, cut at the ends; of their entries those of LEAST or more.
_PRUNED = f"""
WITH RECURSIVE w AS (SELECT vec_id // {RECORDING} AS series_id, CAST(vec_id % {RECORDING} AS INT) AS step, list_transform(embedding[1:{STATES}], lambda e: abs(CAST(e AS DOUBLE)) + 0.01) AS w FROM embeddings),
seen AS (SELECT series_id, step, list_transform(w, lambda v: ln(v / list_sum(w) + {_TINY})) AS o FROM w),
raw AS (SELECT i, i - 2 + m AS j, [1.0, 2.0, 3.0, 2.0, 1.0][m + 1] AS p FROM (SELECT unnest(range({STATES})) AS i), (SELECT unnest(range(5)) AS m)),
moves AS (SELECT i, j, p FROM (SELECT i, j, p / sum(p) OVER (PARTITION BY i) AS p FROM raw WHERE j BETWEEN 0 AND {STATES - 1})),
into_ AS (SELECT list(row ORDER BY j) AS into_ FROM (SELECT b.s AS j, list(CASE WHEN coalesce(p, 0) >= {LEAST} THEN ln(p + {_TINY}) ELSE '-infinity'::DOUBLE END ORDER BY a.s) AS row FROM (SELECT unnest(range({STATES})) AS s) a CROSS JOIN (SELECT unnest(range({STATES})) AS s) b LEFT JOIN moves ON i = a.s AND j = b.s GROUP BY b.s)),
walk(series_id, step, v, back) AS (
  SELECT series_id, step, list_transform(o, lambda x: x + ln(1.0::DOUBLE / {STATES} + {_TINY})), NULL::INT[] FROM seen WHERE step = 0
  UNION ALL
  SELECT series_id, step, list_transform(range(1, {STATES} + 1), lambda j: o[j] + list_max(came[j])), list_transform(came, lambda c: CAST(list_position(c, list_max(c)) AS INT))
  FROM (SELECT d.series_id, d.step, d.o, list_transform(into_, lambda row: list_transform(range(1, {STATES} + 1), lambda i: w.v[i] + row[i])) AS came FROM walk w JOIN seen d ON d.series_id = w.series_id AND d.step = w.step + 1, into_)),
ends AS (SELECT series_id, max(step) AS step FROM seen GROUP BY series_id),
back_(series_id, step, s, log_prob) AS (
  SELECT w.series_id, w.step, CAST(list_position(w.v, list_max(w.v)) AS INT), list_max(w.v) FROM walk w JOIN ends USING (series_id, step)
  UNION ALL
  SELECT b.series_id, b.step - 1, w.back[b.s], b.log_prob FROM back_ b JOIN walk w ON w.series_id = b.series_id AND w.step = b.step WHERE b.step > 0)
SELECT series_id, step, CAST(s - 1 AS INT) AS state, round(log_prob, 6) AS log_prob FROM back_"""

ORACLE_SQL = {
    "audio_frames": "SELECT vec_id, CAST(s / 8 AS INT) AS frame_idx, round(list_sum(list_transform(embedding[s + 1 : s + 16], lambda v: CAST(v AS DOUBLE) * CAST(v AS DOUBLE))), 6) AS energy FROM embeddings, (SELECT unnest(range(0, 49, 8)) AS s)",
    "normalised_differences": f"WITH {_DIFFERENCES} SELECT vec_id, k, round(y, 6) AS difference, round(shift, 6) AS shift FROM shifted",
    "trough_weights": f"WITH {_DIFFERENCES}, {_TROUGHS} SELECT vec_id, k, round(p, 6) AS weight FROM weighed",
    "observations": f"WITH {_DIFFERENCES}, {_TROUGHS}, {_OBSERVED} SELECT vec_id, state, round(prob, 6) AS prob FROM seen WHERE prob > 1e-6",
    "voiced_probability": f"WITH {_DIFFERENCES}, {_TROUGHS}, {_OBSERVED} SELECT vec_id, round(voiced_prob, 6) AS voiced_prob FROM voiced",
    "tracked_pitch": f"WITH RECURSIVE {_DIFFERENCES}, {_TROUGHS}, {_OBSERVED}, {_MOVES}, {_DECODED} SELECT b.audio_id, b.t AS frame_idx, CASE WHEN s <= {_BINS} THEN round(260 * 2 ** ((s - 1) / 12.0), 4) END AS f0, s <= {_BINS} AS voiced, round(voiced_prob, 6) AS voiced_prob FROM back_ b JOIN voiced ON vec_id = b.audio_id * {RECORDING} + b.t",
    "transitions": f"WITH s AS ({' UNION ALL '.join(f'''SELECT '{shape}' AS shape, {width} AS width, {str(wrap).lower()} AS wrap, i, {width} AS w FROM (SELECT unnest(range({STATES})) AS i)''' for shape, width, wrap in WINDOWS)} UNION ALL SELECT 'triangle', 0, false, i, CAST(1 + i % 5 AS INT) FROM (SELECT unnest(range({STATES})) AS i)), c AS (SELECT shape, width, wrap, i, w, unnest(range(w)) AS m FROM s), e AS (SELECT *, (({STATES} - w) // 2 + m + {STATES} // 2 + i + 1) % {STATES} AS j, CASE shape {' '.join(f'''WHEN '{k}' THEN {v}''' for k, v in _F.items())} END AS p FROM c), k AS (SELECT * FROM e WHERE wrap OR (j < i + w // 2 + 1 AND j >= i - w // 2)), m AS (SELECT shape, width, wrap, i, sum(j * p) / sum(p) AS mean FROM k GROUP BY ALL), v AS (SELECT vec_id, unnest(range({STATES})) AS i, unnest(list_transform(embedding[1:{STATES}], lambda e: abs(CAST(e AS DOUBLE)))) AS w FROM embeddings) SELECT vec_id, shape, CAST(width AS INT) AS width, wrap, round(sum(v.w * mean), 6) AS moved FROM v JOIN m USING (i) GROUP BY ALL",
    "loop_transitions": "WITH n AS (SELECT CAST(unnest(range(8)) AS INT) AS i), m AS (SELECT a.i, b.i AS j, CAST(CASE WHEN a.i // 4 = b.i // 4 THEN CASE a.i // 4 WHEN 0 THEN 0.75 ELSE 0.5 END ELSE CASE a.i // 4 WHEN 0 THEN 0.25 ELSE 0.5 END END * CASE WHEN a.i % 4 = b.i % 4 THEN 0.25 ELSE 0.75 / 3 END AS DOUBLE) AS p FROM n a, n b), v AS (SELECT vec_id, unnest(range(8)) AS i, unnest(list_transform(embedding[1:8], lambda e: abs(CAST(e AS DOUBLE)))) AS w FROM embeddings) SELECT vec_id, j, round(sum(v.w * p), 6) AS w FROM v JOIN m USING (i) GROUP BY ALL",
    "half_precision_distances": f"WITH {_G}, cells AS (SELECT q.b AS query_bin, r.b AS track_bin, c.c, CASE WHEN q.b < 24 THEN x.g ELSE 0 END AS u, CASE WHEN r.b < 24 THEN round_even(z.g / z.unit, 0) * z.unit ELSE 0 END AS v FROM bins q, bins r, (SELECT unnest(range(24)) AS c) c JOIN g2 x ON x.k = (c.c - q.b + 24) % 24 JOIN g2 z ON z.k = (c.c - r.b + 24) % 24), d AS (SELECT query_bin, track_bin, sqrt(sum((u - v) ** 2)) AS d FROM cells GROUP BY ALL), e AS (SELECT user_id AS track_id, ts, event_id, CASE WHEN event_type <> 'error' AND value > 0 THEN 1200 * log2(value / 55) END AS cents FROM events), n AS (SELECT track_id, ts, event_id, coalesce(CAST(round_even((cents - 1200 * floor(cents / 1200)) / 50, 0) AS INT) % 24, 24) AS bin FROM e), s AS (SELECT track_id, bin, lag(bin) OVER (PARTITION BY track_id ORDER BY ts, event_id) AS before FROM n) SELECT track_id, round(sum(d), 6) AS distance FROM s JOIN d ON query_bin = bin AND track_bin = before GROUP BY track_id",
    "tracked_pitch_in_blocks": f"WITH RECURSIVE {_DIFFERENCES}, {_TROUGHS}, {_OBSERVED}, {_MOVES.replace(f'// {RECORDING} AS audio_id', f'// {LONG} AS audio_id').replace(f'% {RECORDING} AS INT', f'% {LONG} AS INT')}, {_DECODED} SELECT audio_id, t AS frame_idx, CASE WHEN s <= {_BINS} THEN round(260 * 2 ** ((s - 1) / 12.0), 4) END AS f0, s <= {_BINS} AS voiced FROM back_",
    "viterbi_pruned": _PRUNED,
}
