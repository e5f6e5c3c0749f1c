"""Frames of chunks against those of whole recordings."""

import math
import time

import numpy as np
import pytest

from humsearch.operators import pyin
from humsearch.streaming import frames as stream


@pytest.fixture(scope="module")
def session(spark):
    for k, v in stream.STATE_STORE.items():
        spark.conf.set(k, v)
    return spark


def run(spark, batches, settings, tmp_path, idle_ms=None, until=0):
    """Rows of the frames of micro-batches of chunks, and those that its state still has.
    With ``idle_ms`` batches go on without data, so that ``until`` rows are waited for."""
    source, sink = tmp_path / "in", f"frames{abs(hash(str(tmp_path)))}"
    source.mkdir()
    query = stream.stream_frames(spark.readStream.schema(stream.CHUNKS).parquet(str(source)), settings, idle_ms)
    started = query.writeStream.format("memory").queryName(sink).outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        for rows in batches:
            spark.createDataFrame(rows, stream.CHUNKS).coalesce(1).write.mode("append").parquet(str(source))
            if idle_ms is None:
                started.processAllAvailable()
        end = time.time() + 90
        while time.time() < end and started.exception() is None and spark.table(sink).count() < until:
            time.sleep(1)
        time.sleep(5 if idle_ms else 0)
        left = started.lastProgress["stateOperators"][0]["numRowsTotal"]
    finally:
        started.stop()
    return spark.table(sink).collect(), left


def chunked(audio_id, samples, cuts, sr=8000):
    pieces = np.split(np.array(samples), cuts)
    return [(audio_id, sr, k, p.tolist(), k == len(pieces) - 1) for k, p in enumerate(pieces)]


@pytest.mark.parametrize("center, hop", [(False, 5), (True, 40)])
def test_any_chunks(session, tmp_path, center, hop):
    rng = np.random.default_rng(hop)
    settings = pyin.PitchSettings(frame_length=16, hop_length=hop, center=center)
    whole = {k: rng.standard_normal(int(n)).tolist() for k, n in enumerate((200, 16, 95, 333))}
    chunks = [c for k, x in whole.items() for c in chunked(k, x, np.sort(rng.integers(0, len(x) + 1, int(rng.integers(0, 9)))))]
    # any order, over three batches, some twice
    order = rng.permutation(len(chunks)).tolist()
    batches = [[chunks[i] for i in part.tolist()] for part in np.array_split(order, 3)]
    batches[2] = batches[2] + batches[2][:1]
    got, left = run(session, batches, settings, tmp_path)
    audio = session.createDataFrame([(k, 8000, x) for k, x in whole.items()], "audio_id long, sr int, samples array<double>")
    want = {(r["audio_id"], r["frame_idx"]): r["frame"] for r in pyin.frames(audio, settings).collect()}
    assert {(r["audio_id"], r["frame_idx"]): r["frame"] for r in got} == want and len(got) == len(want)
    assert all(r["error"] is None and r["sr"] == 8000 for r in got)


def test_state_goes(session, tmp_path):
    settings = pyin.PitchSettings(frame_length=8, hop_length=8, center=False)
    samples = [float(k) for k in range(40)]
    done = chunked(1, samples, [3, 17])
    open_ = chunked(2, samples, [20])[:1]
    broken = [(3, 8000, 0, [0.0] * 7 + [math.nan] + [1.0] * 8, True)]
    got, left = run(session, [done + open_ + broken], settings, tmp_path, idle_ms=2000, until=10)
    by = {k: [r for r in got if r["audio_id"] == k] for k in (1, 2, 3)}
    assert sorted(r["frame_idx"] for r in by[1]) == [0, 1, 2, 3, 4]
    assert [r["error"] for r in sorted(by[3], key=lambda r: r["frame_idx"])] == ["not finite", None]
    assert [r["error"] for r in by[2] if r["frame"] is None] == ["ended without a last chunk"] and len(by[2]) == 3
    assert left == 0


def test_settings_that_need_the_whole(session):
    chunks = session.createDataFrame([], stream.CHUNKS)
    for bad in ({"pad_mode": "reflect"}, {"hop_length": 0, "center": False}):
        with pytest.raises(ValueError):
            stream.stream_frames(chunks, pyin.PitchSettings(**bad))
