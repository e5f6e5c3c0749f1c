"""Fundamental frequency by probabilistic YIN, over frames as rows.

Frames are made by array functions and processed in parallel, whichever file
they are from; only the decoding of the most likely state sequence needs a
file's frames together, in order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..shared import spread

_TINY = np.finfo(float).tiny


@dataclass(frozen=True)
class PitchSettings:
    fmin: float = 65.0
    fmax: float = 1046.0
    frame_length: int = 2048
    hop_length: int | None = None
    n_thresholds: int = 100
    beta_parameters: tuple[float, float] = (2, 18)
    boltzmann: float = 2.0
    resolution: float = 0.1
    max_transition_rate: float = 35.92
    switch_prob: float = 0.01
    no_trough_prob: float = 0.01
    center: bool = True
    pad_mode: str = "constant"

    def hop(self) -> int:
        return self.frame_length // 4 if self.hop_length is None else self.hop_length

    def check(self, sr: int) -> None:
        if None in (self.fmin, self.fmax):
            raise ValueError("fmin and fmax are needed")
        if self.fmax > sr / 2:
            raise ValueError("fmax lies above half the rate")
        if self.fmin <= 0 or self.fmin >= self.fmax:
            raise ValueError("fmin must lie between 0 and fmax")
        if sr / self.fmin >= self.frame_length - 1:
            raise ValueError("the frame is too short for fmin")

    def periods(self, sr: int) -> tuple[int, int]:
        return int(np.floor(sr / self.fmax)), min(int(np.ceil(sr / self.fmin)), self.frame_length - 1)

    def bins_per_semitone(self) -> int:
        return int(np.ceil(1.0 / self.resolution))

    def n_bins(self) -> int:
        return int(np.floor(12 * self.bins_per_semitone() * np.log2(self.fmax / self.fmin))) + 1

    def width(self, sr: int) -> int:
        return round(self.max_transition_rate * 12 * self.hop() / sr) * self.bins_per_semitone() + 1


def valid(samples: Column) -> Column:
    """True for samples that are all there and finite."""
    return F.forall(samples, lambda s: s.isNotNull() & ~F.isnan(s) & (F.abs(s) < F.lit(float("inf"))))


def padded(samples: Column, size: int, mode: str = "constant") -> Column:
    """Samples with ``size`` more on either side: zeros, the end values, or a reflection."""
    n = F.size(samples)
    if mode == "constant":
        side = F.array_repeat(F.lit(0.0), size)
        return F.concat(side, samples, side)
    if mode == "edge":
        return F.concat(F.array_repeat(F.get(samples, F.lit(0)), size), samples, F.array_repeat(F.get(samples, n - 1), size))
    if mode == "reflect":
        around = lambda k: F.get(samples, (n - 1) - F.abs(F.pmod(k, 2 * (n - 1)) - (n - 1)))
        return F.transform(F.sequence(F.lit(-size), n + size - 1), lambda k: around(k.cast("int")))
    raise ValueError(f"unknown pad mode {mode!r}")


def frames(audio: DataFrame, settings: PitchSettings, mode: str = "FAILFAST") -> DataFrame:
    """(audio_id, sr, frame_idx, frame): overlapping frames of audio (audio_id, sr, samples).

    Samples that are missing or not finite, and audio shorter than a frame, are an
    error; with ``mode`` PERMISSIVE such audio has no frames.
    """
    if mode not in ("FAILFAST", "PERMISSIVE"):
        raise ValueError(f"unknown mode {mode!r}")
    size, hop = settings.frame_length, settings.hop()
    if hop < 1:
        raise ValueError("the hop must be positive")
    fine = F.coalesce(valid(F.col("samples")), F.lit(False))
    samples = padded(F.col("samples"), size // 2, settings.pad_mode) if settings.center else F.col("samples")
    long_ = audio.select("audio_id", "sr", F.when(fine & (F.size(samples) >= size), samples).alias("samples"))
    if mode == "PERMISSIVE":
        long_ = long_.where("samples is not null")
    else:
        wrong = F.raise_error(F.concat(F.lit("audio is too short or not finite: "), F.coalesce(F.col("audio_id").cast("string"), F.lit("null"))))
        long_ = long_.withColumn("samples", F.coalesce("samples", wrong.cast("array<double>")))
    starts = F.sequence(F.lit(0), F.size("samples") - size, F.lit(hop))
    return long_.select("audio_id", "sr", F.posexplode(F.transform(starts, lambda s: F.slice("samples", s + 1, size))).alias("frame_idx", "frame"))


def difference(x: np.ndarray, high: int) -> np.ndarray:
    """Squared difference of frames (rows) and themselves for lags 0 to high.

    d(lag) = energy + energy of the part from lag on - 2 * autocorrelation, where
    the frame is followed by zeros.
    """
    n = x.shape[1]
    size = 1 << int(np.ceil(np.log2(n + high + 1)))
    f = np.fft.rfft(x, size, axis=1)
    auto = np.fft.irfft(f * np.conj(f), size, axis=1)[:, : high + 1]
    energy = np.cumsum((x * x)[:, ::-1], axis=1)[:, ::-1]
    tail = np.concatenate([energy, np.zeros((len(x), max(1, high + 1 - n)))], axis=1)[:, : high + 1]
    d = np.maximum(energy[:, :1] + tail - 2 * auto, 0)
    d[d < 1e-12 * np.maximum(energy[:, :1], _TINY)] = 0
    return d


def normalised_difference(x: np.ndarray, low: int, high: int) -> np.ndarray:
    """Cumulative-mean-normalised difference of frames (rows) for lags low to high."""
    d = difference(x, high)
    mean = np.cumsum(d[:, 1:], axis=1) / np.arange(1, high + 1)
    return d[:, low : high + 1] / np.where(mean[:, low - 1 :] == 0, 1e-12, mean[:, low - 1 :])


def parabola_shifts(y: np.ndarray) -> np.ndarray:
    """Offset of the vertex through each point and its neighbours; 0 at the ends or beyond one step."""
    out = np.zeros_like(y)
    a = y[2:] + y[:-2] - 2 * y[1:-1]
    b = (y[2:] - y[:-2]) / 2
    inner = np.abs(b) < np.abs(a)
    out[1:-1] = np.where(inner, -b / np.where(inner, a, 1), 0)
    return out


def troughs(y: np.ndarray) -> np.ndarray:
    """Indices of local minima."""
    if len(y) < 2:
        return np.zeros(0, int)
    down = np.concatenate([[True], y[1:] < y[:-1]])
    up = np.concatenate([y[:-1] <= y[1:], [True]])
    low = down & up
    low[0] = y[0] < y[1]
    return np.flatnonzero(low)


def beta_steps(n: int, parameters: tuple[float, float] = (2, 18)) -> np.ndarray:
    """Probability of each of n thresholds: steps of a Beta distribution function.

    For whole parameters the distribution function is a binomial tail; otherwise
    the density, a power series in x below the mean and in 1 - x above, is summed.
    """
    a, b = parameters
    if a <= 0 or b <= 0:
        raise ValueError("the beta parameters must be positive")
    x = np.linspace(0, 1, n + 1)
    if float(a).is_integer() and float(b).is_integer():
        a, b = int(a), int(b)
        part = lambda ks: sum(math.comb(a + b - 1, k) * x**k * (1 - x) ** (a + b - 1 - k) for k in ks)
        # the smaller of both tails, so that nothing is left of rounding errors near 1
        return np.diff(np.maximum.accumulate(np.where(x < a / (a + b), part(range(a, a + b)), 1 - part(range(a)))))

    def lower(z: np.ndarray, p: float, q: float) -> np.ndarray:
        # z^p (1 - z)^q / (p B(p, q)) * sum_k prod_j (p + q + j) / (p + 1 + j) z^k
        total = term = np.ones_like(z)
        for k in range(10_000):
            term = term * z * (p + q + k) / (p + 1 + k)
            total = total + term
            if term.max() < 1e-17 * total.max():
                break
        scale = math.lgamma(p + q) - math.lgamma(p + 1) - math.lgamma(q)
        with np.errstate(divide="ignore"):
            return np.exp(scale + p * np.log(z) + q * np.log1p(-z)) * total

    below = x < (a + 1) / (a + b + 2)
    out = np.ones_like(x)
    out[below] = lower(x[below], a, b)
    out[~below] = 1 - lower(1 - x[~below], b, a)
    return np.diff(out)


@lru_cache(16)
def _thresholds(n: int, parameters: tuple[float, float]) -> tuple[np.ndarray, np.ndarray]:
    """The thresholds and their probabilities, which all frames share."""
    return np.linspace(0, 1, n + 1)[None, 1:], beta_steps(n, parameters)


def trough_weights(heights: np.ndarray, s: PitchSettings) -> np.ndarray:
    """Probability of each trough over all thresholds: those below a threshold are
    weighed by a truncated exponential of their rank among them; the lowest one
    also gets a share of the thresholds that none is below."""
    steps, beta = _thresholds(s.n_thresholds, tuple(s.beta_parameters))
    below = heights[:, None] < steps
    rank, count = np.cumsum(below, axis=0) - 1, below.sum(0)
    lam = s.boltzmann
    pmf = (1 - np.exp(-lam)) * np.exp(-lam * rank) / (1 - np.exp(-lam * np.maximum(count, 1)))
    out = (np.where(below, pmf, 0) * beta).sum(1)
    lowest = int(heights.argmin())
    out[lowest] += s.no_trough_prob * beta[~below[lowest]].sum()
    return out


def observe(y: np.ndarray, sr: int, low: int, s: PitchSettings) -> tuple[np.ndarray, np.ndarray, float]:
    """(state, probability, voiced probability) of a frame's candidates. Of several
    in one bin the last counts. A candidate at the very top falls on the first
    unvoiced state, which is then overwritten, so it is left out."""
    at = troughs(y)
    if not len(at):
        return np.zeros(0, int), np.zeros(0), 0.0
    p = trough_weights(y[at], s)
    at, p = at[p != 0], p[p != 0]
    f0 = sr / (low + at + parabola_shifts(y)[at])
    n = s.n_bins()
    bins = np.clip(np.rint(12 * s.bins_per_semitone() * np.log2(f0 / s.fmin)), 0, n).astype(int)
    dense = np.zeros(n + 1)
    dense[bins] = p
    some = np.flatnonzero(dense[:n])
    return some, dense[some], float(np.clip(dense[:n].sum(), 0, 1))


def observe_all(y: np.ndarray, sr: int, low: int, s: PitchSettings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``observe`` of many frames (rows) at once, with the same operations for each: number of
    candidates of every frame, their states and probabilities end to end, voiced probabilities."""
    n, lam = s.n_bins(), s.boltzmann
    steps, beta = _thresholds(s.n_thresholds, tuple(s.beta_parameters))
    dense = np.zeros((len(y), n + 1))
    here = np.zeros(y.shape, bool)
    if y.shape[1] >= 2:
        here[:, 1:] = y[:, 1:] < y[:, :-1]
        here[:, 1:-1] &= y[:, 1:-1] <= y[:, 2:]
        here[:, 0] = y[:, 0] < y[:, 1]
    of, at = np.nonzero(here)
    if len(of):
        heights = y[of, at]
        first = np.flatnonzero(np.diff(of, prepend=-1))
        each = np.diff(first, append=len(of))
        below = heights[:, None] < steps
        upto = np.cumsum(below, axis=0)
        # troughs of earlier frames don't count
        rank = upto - np.repeat(upto[first] - below[first], each, axis=0) - 1
        count = np.repeat(np.add.reduceat(below, first, axis=0, dtype=int), each, axis=0)
        pmf = (1 - np.exp(-lam)) * np.exp(-lam * rank) / (1 - np.exp(-lam * np.maximum(count, 1)))
        p = (np.where(below, pmf, 0) * beta).sum(1)
        least = np.minimum.reduceat(heights, first)
        lowest = np.minimum.reduceat(np.where(heights == np.repeat(least, each), np.arange(len(of)), len(of)), first)
        # thresholds ascend, so those that the lowest is not below come first
        above = np.array([beta[:k].sum() for k in range(len(beta) + 1)])
        p[lowest] += s.no_trough_prob * above[(~below[lowest]).sum(1)]
        a, b, c = y[of, np.maximum(at - 1, 0)], y[of, at], y[of, np.minimum(at + 1, y.shape[1] - 1)]
        bend, slope = c + a - 2 * b, (c - a) / 2
        inner = (at > 0) & (at < y.shape[1] - 1) & (np.abs(slope) < np.abs(bend))
        f0 = sr / (low + at + np.where(inner, -slope / np.where(inner, bend, 1), 0))
        bins = np.clip(np.rint(12 * s.bins_per_semitone() * np.log2(f0 / s.fmin)), 0, n).astype(int)
        some = p != 0
        dense[of[some], bins[some]] = p[some]
    rows, states = np.nonzero(dense[:, :n])
    return np.bincount(rows, minlength=len(y)), states, dense[rows, states], np.clip(dense[:, :n].sum(1), 0, 1)


def window(shape: str, width: int) -> np.ndarray:
    """The usual periodic window functions."""
    m = np.arange(width)
    if shape == "triangle":
        half = (width + 1) // 2
        ramp = np.arange(1, half + 1)
        return np.concatenate([ramp, ramp[::-1][1:]]) / half if width % 2 else np.concatenate([2 * ramp - 1, (2 * ramp - 1)[::-1]]) / width
    if shape == "boxcar":
        return np.ones(width)
    if shape in ("hann", "hamming"):
        base = 0.5 if shape == "hann" else 0.54
        return base - (1 - base) * np.cos(2 * np.pi * m / width)
    raise ValueError(f"unknown window {shape!r}")


def local_transition(n: int, width: int | Sequence[int], shape: str = "triangle", wrap: bool = False) -> np.ndarray:
    """Row-stochastic matrix that moves at most half a width, which may differ by
    state; a window of the given shape around each state."""
    widths = np.broadcast_to(np.asarray(width), (n,)) if np.ndim(width) == 0 else np.asarray(width)
    if n < 2 or widths.shape != (n,):
        raise ValueError("two states or more, and one width or a width for each, are needed")
    if (widths < 1).any() or (widths > n).any():
        raise ValueError("widths must lie between 1 and the number of states")
    out = np.zeros((n, n))
    for i, w in enumerate(widths.tolist()):
        out[i, ((n - w) // 2 + np.arange(w) + n // 2 + i + 1) % n] = window(shape, w)
        if not wrap:
            out[i, i + w // 2 + 1 :] = 0
            out[i, : max(0, i - w // 2)] = 0
    return out / out.sum(1, keepdims=True)


def loop_transition(n: int, stay: float | Sequence[float]) -> np.ndarray:
    """Row-stochastic matrix that stays with a probability, which may differ by state, and else goes anywhere alike."""
    keep = np.broadcast_to(np.asarray(stay, float), (n,)) if np.ndim(stay) == 0 else np.asarray(stay, float)
    if n < 2 or keep.shape != (n,) or (keep < 0).any() or (keep > 1).any():
        raise ValueError("two states or more, and one probability or one for each, are needed")
    out = np.repeat(((1 - keep) / (n - 1))[:, None], n, axis=1)
    np.fill_diagonal(out, keep)
    return out


def viterbi(prob: np.ndarray, transition: np.ndarray, start: np.ndarray | None = None, least_transition: float | None = None) -> tuple[np.ndarray, float]:
    """(states, log-probability) of the likeliest path for observations (states x steps).
    Ties go to the lower state. Transitions under ``least_transition`` are impossible."""
    n, steps = prob.shape
    if transition.shape != (n, n) or not np.allclose(transition.sum(1), 1) or (transition < 0).any():
        raise ValueError("the transition matrix must be stochastic")
    if (prob < 0).any() or (prob > 1).any():
        raise ValueError("observations must be probabilities")
    if start is not None and (start.shape != (n,) or (start < 0).any() or not np.allclose(start.sum(), 1)):
        raise ValueError("the start must be a distribution over the states")
    move = np.log(transition + _TINY)
    if least_transition is not None:
        move = np.where(transition >= least_transition, move, -np.inf)
        if np.isinf(move).all(0).any():
            raise ValueError("a state cannot be reached")
    return _likeliest(np.log(prob.T + _TINY), move, np.log((np.full(n, 1 / n) if start is None else start) + _TINY))


def _likeliest(seen: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, float]:
    """``viterbi`` of log-probabilities, observations being steps x states."""
    steps, n = seen.shape
    value = seen[0] + start
    back = np.zeros((steps, n), np.uint16 if n <= 65536 else np.int32)
    # a row for each state that is reached, so that its ways lie together
    into = np.ascontiguousarray(move.T)
    for t in range(1, steps):
        came = value[None, :] + into
        back[t] = came.argmax(1)
        value = seen[t] + came[np.arange(n), back[t]]
    states = np.zeros(steps, int)
    states[-1] = value.argmax()
    for t in range(steps - 1, 0, -1):
        states[t - 1] = back[t, states[t]]
    return states, float(value.max())


def differences(framed: DataFrame, high: int) -> DataFrame:
    """(audio_id, frame_idx, differences): squared differences of frames (audio_id, frame_idx, frame) for lags 0 to high."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                d = difference(np.asarray(piece.column(2).flatten(), float).reshape(piece.num_rows, -1), high)
                yield pa.record_batch([piece.column(0), piece.column(1), pa.ListArray.from_arrays(np.arange(0, d.size + 1, d.shape[1], dtype=np.int32), d.ravel())], ["audio_id", "frame_idx", "differences"])

    narrow = framed.select(F.col("audio_id").cast("long").alias("audio_id"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("frame").cast("array<double>").alias("frame"))
    return narrow.mapInArrow(run, "audio_id long, frame_idx int, differences array<double>")


def minima(series: DataFrame) -> DataFrame:
    """(series_id, at): places of the local minima of series (series_id, values), from 0."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [troughs(np.asarray(v.values, float)).tolist() for v in batch.column(1)]
            yield pa.record_batch([batch.column(0), pa.array(found, pa.list_(pa.int32()))], ["series_id", "at"])

    narrow = series.select(F.col("series_id").cast("long").alias("series_id"), F.col("values").cast("array<double>").alias("values")).where("values is not null")
    return narrow.mapInArrow(run, "series_id long, at array<int>").select("series_id", F.explode("at").alias("at"))


def analysed(framed: DataFrame, settings: PitchSettings, detail: bool = False) -> DataFrame:
    """(audio_id, sr, frame_idx, states, probs, voiced_prob) of frames (audio_id, sr,
    frame_idx, frame): the voiced states that a frame may be in. With ``detail``
    also the normalised differences by lag, their parabolic shifts, and the places
    and weights of their troughs.
    """
    s = settings

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                piece = batch.slice(at, 64)
                rates = np.asarray(piece.column("sr"))
                x = np.asarray(piece.column("frame").flatten(), float).reshape(len(rates), -1)
                rows: list = [None] * len(rates)
                for sr in np.unique(rates).tolist():
                    s.check(sr)
                    low, high = s.periods(sr)
                    same = np.flatnonzero(rates == sr)
                    all_y = normalised_difference(x[same], low, high)
                    counts, states, probs, voiced = observe_all(all_y, sr, low, s)
                    ends = np.cumsum(counts)[:-1]
                    for k, y, *seen in zip(same.tolist(), all_y, np.split(states, ends), np.split(probs, ends), voiced.tolist(), strict=True):
                        rows[k] = tuple(seen)
                        if detail:
                            places = troughs(y)
                            rows[k] += (y, parabola_shifts(y), places, trough_weights(y[places], s) if len(places) else np.zeros(0))
                kinds = [pa.list_(pa.int32()), pa.list_(pa.float64()), pa.float64(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.list_(pa.int32()), pa.list_(pa.float64())]
                made = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=False)]
                yield pa.record_batch([piece.column(c) for c in ("audio_id", "sr", "frame_idx")] + made, names)

    schema = "audio_id long, sr int, frame_idx int, states array<int>, probs array<double>, voiced_prob double"
    if detail:
        schema += ", differences array<double>, shifts array<double>, troughs array<int>, weights array<double>"
    names = [c.split()[0] for c in schema.split(", ")]
    narrow = framed.select(F.col("audio_id").cast("long").alias("audio_id"), F.col("sr").cast("int").alias("sr"), F.col("frame_idx").cast("int").alias("frame_idx"), F.col("frame").cast("array<double>").alias("frame"))
    return narrow.mapInArrow(run, schema)


def decoded(seen: DataFrame, settings: PitchSettings, fill: float | None = None) -> DataFrame:
    """(audio_id, frame_idx, f0, voiced, voiced_prob) of analysed frames: the
    likeliest sequence of states of each recording, decoded in one task."""
    from .decoding import Banded, pruned_viterbi

    s, n = settings, settings.n_bins()
    moves: dict[int, tuple[np.ndarray, Banded]] = {}

    def decode(group: pa.Table) -> pa.Table:
        group = group.sort_by("frame_idx")
        steps, sr = group.num_rows, group.column("sr")[0].as_py()
        if sr not in moves:
            matrix = np.kron(loop_transition(2, 1 - s.switch_prob), local_transition(n, s.width(sr)))
            moves[sr] = matrix, Banded(matrix)
        voiced = group.column("voiced_prob").to_numpy()
        some, weights = (group.column(c).combine_chunks() for c in ("states", "probs"))
        ends = np.cumsum(np.asarray(some.value_lengths()))[:-1]
        at, p = np.split(np.asarray(some.flatten()).astype(int), ends), np.split(np.minimum(np.asarray(weights.flatten()), 1), ends)
        # all give the same states: the band's where they are certain, else lists of predecessors where there are few of them
        matrix, band = moves[sr]
        states = band.path(at, p, (1 - voiced) / n)
        if states is None:
            prob = np.zeros((2 * n, steps))
            prob[n:] = (1 - voiced) / n
            for t in range(steps):
                prob[at[t], t] = p[t]
            few = np.count_nonzero(matrix) < matrix.size / 8
            states, _ = pruned_viterbi(prob, matrix) if few else _likeliest(np.log(prob.T + _TINY), band.out, np.log(np.full(2 * n, 1 / (2 * n)) + _TINY))
        f0 = s.fmin * 2.0 ** ((states % n) / (12 * s.bins_per_semitone()))
        on = states < n
        return pa.table({"audio_id": group.column("audio_id"), "frame_idx": group.column("frame_idx"), "f0": pa.array([float(f) if v else fill for f, v in zip(f0, on, strict=True)], pa.float64()), "voiced": pa.array(on), "voiced_prob": pa.array(voiced)})

    rows = spread(seen.select("audio_id", "sr", "frame_idx", "states", "probs", "voiced_prob"), "audio_id")
    return rows.groupBy("audio_id").applyInArrow(decode, "audio_id long, frame_idx int, f0 double, voiced boolean, voiced_prob double")


def decoded_in_blocks(seen: DataFrame, settings: PitchSettings, fill: float | None = None, block: int | None = None, ahead: int | None = None) -> DataFrame:
    """``decoded`` for long recordings: blocks of ``block`` frames are decoded in parallel,
    each from ``ahead`` frames before it, and joined where that is exact (see ``decoding``)."""
    from . import decoding

    s, n = settings, settings.n_bins()
    moves = lambda sr: np.kron(loop_transition(2, 1 - s.switch_prob), local_transition(n, s.width(sr)))
    states = decoding.decoded_states(seen, n, moves, block or decoding.BLOCK, ahead or decoding.AHEAD)
    voiced = F.col("state") < n
    f0 = s.fmin * F.pow(F.lit(2.0), (F.col("state") % n) / (12.0 * s.bins_per_semitone()))
    return states.select("audio_id", "frame_idx", F.when(voiced, f0).otherwise(F.lit(fill).cast("double")).alias("f0"), voiced.alias("voiced"), "voiced_prob")


def pitch(audio: DataFrame, settings: PitchSettings = PitchSettings(), fill: float | None = None, mode: str = "FAILFAST", block: int | None = None) -> DataFrame:
    """(audio_id, frame_idx, f0, voiced, voiced_prob) of audio (audio_id, sr, samples).

    f0 is ``fill`` where unvoiced. Rates that the settings don't allow raise an
    error, and so does audio that cannot be framed, unless ``mode`` is PERMISSIVE.
    With ``block`` recordings are decoded in blocks of so many frames at once.
    """
    seen = analysed(frames(audio, settings, mode), settings)
    return decoded_in_blocks(seen, settings, fill, block) if block else decoded(seen, settings, fill)
