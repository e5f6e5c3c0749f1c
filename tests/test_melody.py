"""Kernels against naive versions, the packed format's edge cases, and whole searches."""

import math
import struct
import wave
import zlib
from itertools import product

import numpy as np
import pytest
from pyspark.sql import functions as F

from humsearch.config import EngineConfig, jdbc_options
from humsearch.functions import pitch as P
from humsearch.operators import diagonals, distance, dtw, matching, pyin
from humsearch.operators.distance import METRICS, pairwise
from humsearch.plans import search
from humsearch.sources import audio, catalog, packed


def naive_dtw(cost, moves, subsequence):
    n, m = cost.shape
    total = np.full((n, m), np.inf)
    for i in range(n):
        for j in range(m):
            best = cost[i, j] if (i, j) == (0, 0) or (subsequence and i == 0) else np.inf
            for di, dj, add, mul in moves:
                if i >= di and j >= dj and np.isfinite(mul):
                    best = min(best, total[i - di, j - dj] + mul * cost[i, j] + add)
            total[i, j] = best
    return total


@pytest.mark.parametrize("shape", [(5, 9), (7, 7), (9, 5), (1, 4), (4, 1)])
@pytest.mark.parametrize("subsequence", [False, True])
@pytest.mark.parametrize("steps", [None, ((1, 1), (1, 2), (2, 1)), ((0, 2), (1, 1), (1, 0))])
def test_accumulation(shape, subsequence, steps):
    w = dtw.Warping(steps=steps, subsequence=subsequence)
    cost = np.random.default_rng(1).random(shape)
    total, _ = dtw.accumulate(cost, w)
    np.testing.assert_allclose(total, naive_dtw(cost, w.moves(), subsequence))


def test_weights_along_the_first_row():
    w = dtw.Warping(weights_mul=(1, 0.1, 1), subsequence=True)
    assert dtw.accumulate(np.array([[0.2, 1, 1]]), w)[0][0] == pytest.approx([0.2, 0.3, 0.4])


def test_alignment_path_and_errors():
    x = np.array([[0.0, 5, 7, 5]])
    y = np.array([[3.0, 0, 5, 5, 7, 5, 2, 2]])
    got = dtw.align(x, y, warping=dtw.Warping(subsequence=True))
    assert got.cost[-1].min() == 0
    assert got.path[0].tolist() == [3, 5] and got.path[-1].tolist() == [0, 1]
    turned = dtw.align(y, x, warping=dtw.Warping(subsequence=True))
    assert turned.path[0].tolist() == [5, 3]
    with pytest.raises(ValueError):
        dtw.align(x, y, cost=np.zeros((2, 2)))
    with pytest.raises(ValueError):
        dtw.align(cost=np.array([[np.nan]]))
    with pytest.raises(ValueError):
        dtw.Warping(steps=((1, -1),))
    with pytest.raises(ValueError):
        dtw.Warping(weights_add=(1.0,))


def test_band():
    assert np.isfinite(dtw.band(np.zeros((4, 4)), 0.5)).sum() == 10
    wide = np.isfinite(dtw.band(np.zeros((4, 8)), 0.25))
    assert wide[0, 0] and not wide[1, 0] and wide[0, 4] and not wide[0, 5]


def test_subsequence_cost_is_dense_dtw():
    rng = np.random.default_rng(3)
    table = P.distance_table()
    for n, m in ((6, 11), (11, 6), (5, 5)):
        q, r = rng.integers(0, 25, n), rng.integers(0, 25, m)
        shifts = np.arange(0, 24, 2)
        want = np.inf
        for s in shifts:
            turned = np.where(q < 24, (q + s) % 24, 24)
            cost = table[turned][:, r]
            cost = cost if n <= m else cost.T
            want = min(want, naive_dtw(cost, dtw.Warping().moves(), True)[-1].min() / min(n, m))
        assert dtw.subsequence_cost(q, r, table, shifts) == pytest.approx(want)


def test_kernel_values():
    # published constants of the default profile
    assert P.kernel()[:3] == pytest.approx([0.13298454, 0.12579798, 0.10648569], abs=1e-8)
    table = P.distance_table()
    assert table[1, 0] == pytest.approx(0.07177996, abs=1e-8)
    assert table[0, 24] == pytest.approx(0.30665444, abs=1e-8) and table[24, 24] == 0
    flat = P.distance_table(sigma_cents=0)
    assert flat[0, 1] == pytest.approx(math.sqrt(2)) and flat[0, 24] == 1
    assert P.distance_table(half_precision=True)[0, 0] == pytest.approx(1.11e-4, abs=1e-5)


def test_metrics():
    x, y = np.random.default_rng(0).random((2, 3, 4))
    for name in METRICS:
        d = pairwise(x, y, name)
        assert d.shape == (3, 3) and np.isfinite(d).all()
    assert pairwise([[1, 0]], [[0, 1]], "cosine")[0, 0] == pytest.approx(1)
    with pytest.raises(ValueError):
        pairwise(x, y, "none")


def test_spread_metrics(spark):
    """By definition, with the inverse covariance and the variances of both sides' rows."""
    rng = np.random.default_rng(6)
    x, y = rng.random((4, 3)) @ rng.random((3, 3)), rng.random((6, 3)) * 5
    both = np.concatenate([x, y])
    inverse, variance = np.linalg.inv(np.cov(both.T)), both.var(0, ddof=1)
    for i, j in product(range(4), range(6)):
        gap = x[i] - y[j]
        assert pairwise(x, y, "mahalanobis")[i, j] == pytest.approx(math.sqrt(gap @ inverse @ gap))
        assert pairwise(x, y, "seuclidean")[i, j] == pytest.approx(math.sqrt((gap**2 / variance).sum()))
    frame = lambda rows, key: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(rows)], f"{key} long, v array<double>").repartition(3)
    vectors = frame(y, "vec_id").union(spark.createDataFrame([(77, [1.0]), (78, None)], "vec_id long, v array<double>"))
    got = {(r["metric"], r["query_id"], r["vec_id"]): r["distance"] for r in distance.distances(vectors, frame(x, "query_id"), distance.SPREAD).collect()}
    assert len(got) == 2 * 24
    for (name, i, j), d in got.items():
        assert d == pytest.approx(pairwise(x, y, name)[i, j])
    with pytest.raises(ValueError):
        pairwise(np.ones((2, 3)), np.ones((2, 3)), "mahalanobis")
    got, _ = diagonals.solve([(x, y)], warping=dtw.Warping(metric="mahalanobis"), paths=False)
    assert got[0] == pytest.approx(dtw.align(x.T, y.T, warping=dtw.Warping(metric="mahalanobis"), backtrack=False).cost[-1, -1])


def test_column_functions(spark):
    rows = spark.createDataFrame([(0.5,), (1.5,), (-0.5,), (40000.0,), (-40000.0,), (None,), (math.inf,), (math.nan,)], "c double")
    assert [r[0] for r in rows.select(P.quantise(F.col("c"))).collect()] == [0, 2, 0, 32767, -32767, -32768, -32768, -32768]
    hz = spark.createDataFrame([(55.0,), (110.0,), (27.5,), (0.0,), (-1.0,), (None,), (math.nan,)], "f double")
    assert [r[0] for r in hz.select(P.hz_to_cents(F.col("f"))).collect()] == [0, 1200, -1200, None, None, None, None]
    cents = spark.createDataFrame([(0.0,), (25.0,), (75.0,), (1175.0,), (-50.0,), (2400.0,)], "c double")
    assert [r[0] for r in cents.select(P.pitch_bin(F.col("c"))).collect()] == [0, 0, 2, 0, 23, 0]
    one = spark.range(1).select(P.one_hot(F.lit(2), 4), P.one_hot(F.lit(None).cast("int"), 4), P.transpose(F.lit(23), 2), P.dequantise(F.lit(-1).cast("smallint"))).first()
    assert list(one) == [[0, 0, 1, 0], [0] * 4, 1, -1.0]


CENTS = [None, 0.0, -1.0, 32767.0, -32767.0, 700.4, None, 5.0]


@pytest.mark.parametrize("version", [1, 2])
def test_packed_round_trip(version):
    got, hop = packed.decode(packed.encode(CENTS, 0.1, version))
    assert got == [None if c is None else float(round(c)) for c in CENTS] and hop == 0.1
    assert packed.decode(packed.encode([], 0.1, version))[0] == []


def blob(payload, version=2, frames=1, magic=b"SFPT"):
    return struct.pack("<4sBII", magic, version, frames, 100000) + zlib.compress(payload)


@pytest.mark.parametrize("bad, kind", [(blob(b"\0", magic=b"XXXX"), "bad magic"), (blob(b"\0", 3), "unknown version"), (blob(b"\0")[:-3], "bad deflate stream"), (blob(b"\0", frames=2), "truncated"), (blob(b"\x80" * 11 + b"\0"), "varint too long"), (blob(b"\0\0"), "trailing bytes"), (blob(b"\0", 1), "odd length"), (blob(b"\0\0", 1, 2), "frame count"), (b"SFPT", "short header")])
def test_packed_errors(bad, kind):
    with pytest.raises(packed.PackedError) as e:
        packed.decode(bad)
    assert e.value.kind == kind


def test_decode_modes(spark):
    rows = spark.createDataFrame([(1, bytearray(packed.encode(CENTS))), (2, bytearray(b"junk")), (3, None)], "id long, pitch_track binary")
    got = {r["id"]: r for r in packed.decode_tracks(rows, "PERMISSIVE").collect()}
    assert got[1]["error"] is None and got[1]["contour"][0] is None and got[2]["error"] == "short header" and got[3]["contour"] is None and got[3]["error"] == "missing"
    with pytest.raises(Exception, match="short header"):
        packed.decode_tracks(rows).collect()
    with pytest.raises(Exception, match="missing"):
        packed.decode_tracks(rows.where("id = 3")).collect()
    head = rows.where("id = 1").select(packed.header(F.col("pitch_track")).alias("h")).first()["h"]
    assert bytes(head["magic"]) == b"SFPT" and head["frames"] == len(CENTS) and head["hop_microseconds"] == 100000


def test_database_options_and_retry():
    assert EngineConfig().hop_samples(44100) == 4410
    assert "sslmode=require" in jdbc_options({"DATABASE_URL": "postgres://u:p@h/d"})["url"]
    assert "&sslmode=disable" in jdbc_options({"DATABASE_URL": "postgres://h/d?x=1", "DB_SSLMODE": "disable"})["url"]
    assert "sslmode" not in jdbc_options({"DB_HOST": "h"})["url"]
    calls = []

    def fails():
        calls.append(1)
        if len(calls) < 3:
            raise OSError
        return "ok"

    assert catalog.retry(fails) == "ok" and len(calls) == 3


def tone(f, sr, seconds):
    return np.sin(2 * np.pi * f * np.arange(int(sr * seconds)) / sr)


def save(path, y, sr, channels=1):
    with wave.open(str(path), "wb") as w:
        w.setnchannels(channels)
        w.setsampwidth(2)
        w.setframerate(sr)
        w.writeframes((np.repeat(y, channels) * 32000).astype("<i2").tobytes())


def test_pitch_of_a_tone_and_silence(spark):
    rows = [(1, 8000, tone(220, 8000, 1.2).tolist()), (2, 8000, [0.0] * 9600)]
    got = pyin.pitch(spark.createDataFrame(rows, "audio_id long, sr int, samples array<double>"), pyin.PitchSettings(frame_length=1024, hop_length=512)).toPandas()
    heard = got[got.audio_id == 1].sort_values("frame_idx").f0.to_numpy()[3:-3]
    assert np.abs(1200 * np.log2(heard / 220)).max() <= 10
    assert not got[got.audio_id == 2].voiced.any()


def test_pyin_parts():
    x = np.random.default_rng(2).standard_normal((2, 64))
    d = pyin.normalised_difference(x, 2, 20)
    for k in range(2):
        raw = [sum((x[k, j] - (x[k, j + t] if j + t < 64 else 0)) ** 2 for j in range(64)) for t in range(21)]
        want = [raw[t] / (sum(raw[1 : t + 1]) / t) for t in range(2, 21)]
        np.testing.assert_allclose(d[k], want, rtol=1e-6)
    for shape in ("triangle", "boxcar", "hann", "hamming"):
        np.testing.assert_allclose(pyin.local_transition(12, 5, shape).sum(1), 1)
    states, _ = pyin.viterbi(np.array([[0.9, 0.8, 0.1], [0.1, 0.2, 0.9]]), pyin.loop_transition(2, 0.7))
    assert states.tolist() == [0, 0, 1]
    with pytest.raises(ValueError):
        pyin.PitchSettings().check(1000)
    assert pyin.PitchSettings(hop_length=0).hop() == 0 and pyin.PitchSettings().hop() == 512


def naive_viterbi(prob, moves, start, least):
    """The likeliest path of all, and its log-probability; impossible moves are left out."""
    n, steps = prob.shape
    best = (-np.inf, None)
    for path in product(range(n), repeat=steps):
        if least is not None and any(moves[a, b] < least for a, b in zip(path, path[1:], strict=False)):
            continue
        p = math.log(start[path[0]]) + sum(math.log(prob[s, t]) for t, s in enumerate(path)) + sum(math.log(moves[a, b]) for a, b in zip(path, path[1:], strict=False))
        best = max(best, (p, path), key=lambda x: x[0])
    return best


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(4)
    for least in (None, 0.15):
        prob, moves, start = rng.random((3, 6)), rng.dirichlet(np.ones(3), 3), rng.dirichlet(np.ones(3))
        p, path = naive_viterbi(prob, moves, start, least)
        states, got = pyin.viterbi(prob, moves, start, least)
        assert states.tolist() == list(path) and got == pytest.approx(p)
    for bad in ({"start": np.array([0.5, 0.2, 0.2])}, {"start": np.ones(2) / 2}, {"least_transition": 1.1}):
        with pytest.raises(ValueError):
            pyin.viterbi(prob, moves, **bad)
    with pytest.raises(ValueError):
        pyin.viterbi(prob * 3, moves)
    with pytest.raises(ValueError):
        pyin.viterbi(prob, moves * 2)


def test_transitions_and_beta():
    widths = [1, 3, 5, 3, 1]
    own = pyin.local_transition(5, widths)
    for k, w in enumerate(widths):
        np.testing.assert_allclose(own[k], pyin.local_transition(5, w)[k])
    np.testing.assert_allclose(pyin.loop_transition(3, [0.2, 0.5, 1.0])[2], [0, 0, 1])
    for bad in (0, 6, [1, 2], [0, 1, 1, 1, 1]):
        with pytest.raises(ValueError):
            pyin.local_transition(5, bad)
    with pytest.raises(ValueError):
        pyin.loop_transition(3, [0.2, 0.5])
    x = np.linspace(0, 1, 101)
    np.testing.assert_allclose(pyin.beta_steps(100), np.diff(1 - (1 - x) ** 18 * (1 + 18 * x)), atol=1e-15)
    # other parameters: whole ones by the power series too, and a density summed by hand
    np.testing.assert_allclose(pyin.beta_steps(50, (3, 7)), pyin.beta_steps(50, (3 + 1e-9, 7)), atol=1e-7)
    fine = np.linspace(0, 1, 200_001)
    middle = (fine[1:] + fine[:-1]) / 2
    density = middle**1.5 * (1 - middle) ** 3.5
    np.testing.assert_allclose(pyin.beta_steps(10, (2.5, 4.5)), (density / density.sum()).reshape(10, -1).sum(1), atol=1e-6)


def test_audio_that_cannot_be_framed(spark):
    s = pyin.PitchSettings(frame_length=64, hop_length=16, center=False)
    fine, nan, short = [0.1] * 80, [0.1] * 79 + [math.nan], [0.1] * 63
    for bad in (nan, short, [None] * 80, None):
        rows = spark.createDataFrame([(1, 8000, fine), (2, 8000, bad)], "audio_id long, sr int, samples array<double>")
        with pytest.raises(Exception, match="too short or not finite: 2"):
            pyin.frames(rows, s).collect()
        assert [tuple(r) for r in pyin.frames(rows, s, "PERMISSIVE").groupBy("audio_id").count().collect()] == [(1, 2)]
    with pytest.raises(ValueError):
        pyin.frames(rows, pyin.PitchSettings(hop_length=0))


def test_config(tmp_path):
    (tmp_path / "c.yaml").write_text("app:\n  fmin: 70.0\n  other: 1\nnotebook:\n  fmin: 1\n")
    assert EngineConfig.load(str(tmp_path / "c.yaml")) == EngineConfig(fmin=70.0)
    (tmp_path / "empty.yaml").write_text("")
    assert EngineConfig.load(str(tmp_path / "empty.yaml")) == EngineConfig()
    assert [EngineConfig(hop_seconds=h).hop_samples(5) for h in (0.1, 0.3, 0.5)] == [0, 2, 2]


def test_whole_search(spark, tmp_path):
    sr, rng = 8000, np.random.default_rng(5)
    tunes = {k: 1200 + 100.0 * rng.integers(0, 12, 8).repeat(3) for k in range(1, 6)}
    rows = [(k, bytearray(packed.encode(t.tolist())), f"title {k}", None, "adi") for k, t in tunes.items()] + [(9, bytearray(packed.encode([])), "none", "r", "t")]
    catalogue = spark.createDataFrame(rows, "id long, pitch_track binary, title string, raga string, tala string")
    phase = np.cumsum(2 * np.pi * 55 * 2 ** ((tunes[3] + 200).repeat(800) / 1200) / sr)
    save(tmp_path / "hum.wav", np.sin(phase), sr, channels=2)
    save(tmp_path / "short.wav", tone(220, sr, 0.5), sr)
    (tmp_path / "junk.wav").write_bytes(b"no audio")
    sound = audio.read_audio(spark, str(tmp_path))
    assert sound.count() == 1
    (tmp_path / "huge.wav").write_bytes(b"x" * 100)
    small = EngineConfig(max_upload_bytes=99)
    said = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in audio.read_audio(spark, str(tmp_path), small, errors=True).collect()}
    assert said["huge.wav"] == said["hum.wav"] == "too large" and said["junk.wav"].startswith("cannot be decoded")
    said = {r["path"].rsplit("/", 1)[-1]: r["error"] for r in audio.read_audio(spark, str(tmp_path), errors=True).collect()}
    assert said["hum.wav"] is None and said["short.wav"] == "too short"
    own = audio.read_audio(spark, str(tmp_path), decode=lambda content: (np.zeros(len(content)), 2))
    assert own.count() == 4 and own.first()["sr"] == 2
    got = search.search(sound, catalogue).orderBy("rank").collect()
    assert [r["rank"] for r in got] == [1, 2, 3] and got[0]["id"] == 3 and got[0]["raga"] == ""
    assert search.search(sound.limit(0), catalogue).count() == 0
    assert matching.as_table(search.search_bins([None], search.catalogue_bins(catalogue), catalogue)).count() <= 3
    search.register(spark)
    assert spark.sql("SELECT pitch_bin(hz_to_cents(110D, 55D), 24)").first()[0] == 0
    catalogue.createOrReplaceTempView("catalogue")
    assert [r[0] for r in spark.sql("SELECT decode_contour(pitch_track) FROM catalogue ORDER BY id").collect()] == [t.tolist() for t in tunes.values()] + [[]]
    assert spark.sql("SELECT dtw_cost(array(1, 2), array(3, 4, 9))").first()[0] == 0
    assert spark.sql("SELECT dtw_cost(array(1, NULL, 5), array(1, 5))").first()[0] > 0
    # two recordings at once: the same hum twice under two ids, each with its own ranks
    both = sound.unionByName(sound.withColumn("audio_id", F.lit(7).cast("long")))
    many = search.search(both, catalogue).collect()
    assert len(many) == 6 and {r["audio_id"] for r in many if r["rank"] == 1 and r["id"] == 3} == {sound.first()["audio_id"], 7}
    # bins by content: nothing is decoded again, a changed blob is
    path = str(tmp_path / "bins")
    want = {r["track_id"]: r["bins"] for r in search.catalogue_bins(catalogue).collect()}
    assert {r["track_id"]: r["bins"] for r in search.stored_bins(catalogue, path).collect()} == want
    changed = catalogue.withColumn("pitch_track", F.when(F.col("id") == 1, F.lit(bytearray(packed.encode([0.0, 100.0])))).otherwise(F.col("pitch_track")))
    again = {r["track_id"]: r["bins"] for r in search.stored_bins(changed, path).collect()}
    assert again == want | {1: [0, 2]}
    assert search.BinsTable(spark, path).rows().count() == len(rows) + 1


def test_costs_by_columns(spark):
    rng = np.random.default_rng(8)
    rows = [(k, [None if b == 24 else int(b) for b in rng.integers(0, 25, n)]) for k, n in enumerate((3, 8, 12))]
    tracks = spark.createDataFrame(rows, "track_id long, bins array<tinyint>")
    query = [1, None, 5, 7, 20]
    want = {r[0]: r[1] for r in matching.match_costs(tracks, query).collect()}
    pairs = tracks.select(F.lit(0).alias("query_id"), F.array(*[F.lit(q) for q in query]).cast("array<tinyint>").alias("query"), "track_id", "bins")
    got = {r["track_id"]: r["cost"] for r in matching.cost_by_columns(pairs).collect()}
    assert got == pytest.approx(want)


def test_stream(spark, tmp_path):
    from humsearch.streaming.search import AUDIO_SCHEMA, search_stream

    catalogue = spark.createDataFrame([(1, bytearray(packed.encode([0.0, 100.0] * 10)), "a", "b", "c")], "id long, pitch_track binary, title string, raga string, tala string")
    spark.createDataFrame([(7, 8000, tone(220, 8000, 1.1).tolist())], AUDIO_SCHEMA).write.parquet(str(tmp_path / "in"))
    q = search_stream(spark, str(tmp_path / "in"), search.catalogue_bins(catalogue), catalogue, str(tmp_path / "out"), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).first()["audio_id"] == 7
