"""Frames of recordings that arrive in chunks, with the samples between chunks as state."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.pyin import PitchSettings

CHUNKS = "audio_id long, sr int, chunk long, samples array<double>, last boolean"
FRAMES = "audio_id long, sr int, frame_idx int, frame array<double>, error string"
#: The store that ``transformWithState`` needs.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


class Framing(StatefulProcessor):
    """Carries what the next frame still needs of a recording, at most a frame's length, and the chunks that came too early."""

    def __init__(self, settings: PitchSettings, idle_ms: int | None):
        self.size, self.hop, self.center = settings.frame_length, settings.hop(), settings.center
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # tail of the samples, number of the next chunk and frame, samples to skip, and whether any frame's length has come
        self.state = handle.getValueState("tail", "sr int, samples array<double>, chunk long, frame int, skip long")
        self.early = handle.getMapState("early", "chunk long", "samples array<double>, last boolean")

    def _wait(self, timers, more: bool) -> None:
        """The recording ends if nothing comes for a while; without a limit there are no timers."""
        if self.idle_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if more:
                self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.idle_ms)

    def _forget(self) -> None:
        self.state.clear()
        self.early.clear()

    def _cut(self, samples: np.ndarray, skip: int, first: int) -> tuple[list, np.ndarray, int, int]:
        """(frames, rest, samples to skip, number of the next frame)."""
        frames = []
        gone = min(skip, len(samples))
        samples, skip = samples[gone:], skip - gone
        while len(samples) >= self.size:
            frames.append((first + len(frames), samples[: self.size]))
            gone = min(self.hop, len(samples))
            samples, skip = samples[gone:], self.hop - gone
        return frames, samples, skip, first + len(frames)

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        (audio_id,) = key
        pad = np.zeros(self.size // 2 if self.center else 0)
        for piece in rows:
            for row in piece.itertuples(index=False):
                self.early.updateValue((int(row.chunk),), ([float(x) for x in row.samples], bool(row.last)))
                sr = int(row.sr)
        held = self.state.get() if self.state.exists() else None
        sr, samples, chunk, frame, skip = (held[0], np.array(held[1], float), held[2], held[3], held[4]) if held else (sr, pad, 0, 0, 0)
        out, done = [], False
        while not done and self.early.containsKey((chunk,)):
            more, done = self.early.getValue((chunk,))
            self.early.removeKey((chunk,))
            parts = [samples, np.array(more, float)] + ([pad] if done else [])
            frames, samples, skip, frame = self._cut(np.concatenate(parts), skip, frame)
            out += frames
            chunk += 1
        wrong = [not np.isfinite(f).all() for _, f in out]
        if out:
            yield pd.DataFrame({"audio_id": audio_id, "sr": sr, "frame_idx": [k for k, _ in out], "frame": [None if w else f.tolist() for w, (_, f) in zip(wrong, out, strict=True)], "error": ["not finite" if w else None for w in wrong]})
        if done:
            self._forget()
        else:
            self.state.update((sr, samples.tolist(), chunk, frame, skip))
        self._wait(timerValues, not done)

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        sr, *_, frame, _ = self.state.get()
        self._forget()
        yield pd.DataFrame({"audio_id": [key[0]], "sr": [sr], "frame_idx": [frame], "frame": [None], "error": ["ended without a last chunk"]})


def stream_frames(chunks: DataFrame, settings: PitchSettings, idle_ms: int | None = 60_000) -> DataFrame:
    """(audio_id, sr, frame_idx, frame, error) of a stream of chunks (audio_id, sr, chunk,
    samples, last), whichever way recordings are cut into them: the frames that
    ``pyin.frames`` makes of whole recordings, each as soon as its samples are there.

    Chunks of a recording are numbered from 0; one that comes too early waits for those
    before it, one that comes again is taken once. With ``last`` the recording's state goes; so
    it does if nothing comes for ``idle_ms``, which gives a row with an error and no frame.
    A frame whose samples aren't all finite is null and has an error. Only ``constant`` padding
    can be done without the whole. The session needs ``STATE_STORE``.
    """
    if settings.center and settings.pad_mode != "constant":
        raise ValueError("chunks can be padded with zeros only")
    if settings.hop() < 1:
        raise ValueError("the hop must be positive")
    narrow = chunks.selectExpr("cast(audio_id as long) audio_id", "cast(sr as int) sr", "cast(chunk as long) chunk", "cast(samples as array<double>) samples", "coalesce(last, false) last").where("audio_id is not null and samples is not null")
    mode = "None" if idle_ms is None else "ProcessingTime"
    return narrow.groupBy("audio_id").transformWithStateInPandas(Framing(settings, idle_ms), outputStructType=FRAMES, outputMode="Append", timeMode=mode)
