"""The likeliest states of long sequences: sparse predecessors, and blocks of time in parallel.

``Predecessors`` are a matrix's transitions by the state that they lead to, end to
end, so that a step costs as many operations as there are transitions. Where no
transition is impossible, as all have a least probability, the states beyond them come
in through one more candidate, the best of all states at the least probability; so the
result is that of the whole matrix, ties included.

Blocks of time are decoded apart, each from some frames before its beginning with
nothing known. If the best ways to all states at its beginning have come together in
these frames, its values differ from the true ones by one number, so its choices are
the true ones. That is checked, not assumed: a block's values at its beginning against
those at the end of the block before. Log-probabilities are whole multiples of
``QUANTUM``, so sums of them are exact in whatever order, and so is the check. Where
blocks don't come together, the recording is decoded from its beginning. In either
case a task holds the back pointers of one block.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from ..shared import spread, written

TINY = np.finfo(float).tiny
#: Log-probabilities are multiples of this; a sum stays exact up to 2^27, some 190,000 impossible steps or millions of likely ones.
QUANTUM = 2.0**-26
#: Frames of a block, and those before it that are to bring its survivors together.
BLOCK, AHEAD = 2048, 64


def logs(p: np.ndarray, exact: bool = False) -> np.ndarray:
    out = np.log(p + TINY)
    return np.rint(out / QUANTUM) * QUANTUM if exact else out


@dataclass
class Predecessors:
    """For each state the states before it, their log-probabilities, and that of all others (-inf: none)."""

    n: int
    offsets: np.ndarray
    states: np.ndarray
    weights: np.ndarray
    rest: float

    @classmethod
    def of(cls, transition: np.ndarray, least: float | None = None, exact: bool = False) -> Predecessors:
        """Transitions of ``least`` or more and no others; without it all, those of probability 0 as the rest."""
        keep = transition > 0 if least is None else transition >= least
        if least is not None and not keep.any(0).all():
            raise ValueError("a state cannot be reached")
        to, states = np.nonzero(keep.T)
        offsets = np.concatenate([[0], np.cumsum(np.bincount(to, minlength=len(transition)))])
        weights = logs(transition.T[keep.T], exact)
        return cls(len(transition), offsets, states, weights, float(logs(np.zeros(1), exact)[0]) if least is None else -np.inf)

    def step(self, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(best value, first state that gives it) of the ways into each state."""
        counts = np.diff(self.offsets)
        some = np.flatnonzero(counts)
        best, back = np.full(self.n, -np.inf), np.zeros(self.n, np.int64)
        if len(some):
            came = value[self.states] + self.weights
            top = np.maximum.reduceat(came, self.offsets[some])
            first = np.where(came == np.repeat(top, counts[some]), np.arange(len(came)), len(came))
            best[some], back[some] = top, self.states[np.minimum.reduceat(first, self.offsets[some])]
        if self.rest > -np.inf:
            # the best of all at the least probability: if it is one of the listed ones, that has more
            others = value + self.rest
            one = int(others.argmax())
            better = (others[one] > best) | ((others[one] == best) & (one < back))
            best, back = np.where(better, others[one], best), np.where(better, one, back)
        return best, back


def advance(moves: Predecessors, value: np.ndarray, seen: np.ndarray, back: np.ndarray | None = None) -> np.ndarray:
    """``value`` after the log-probabilities ``seen`` (steps x states), a step each; ``back`` takes the states before."""
    for t, now in enumerate(seen):
        best, came = moves.step(value)
        if back is not None:
            back[t] = came
        value = now + best
    return value


def pruned_viterbi(prob: np.ndarray, transition: np.ndarray, start: np.ndarray | None = None, least: float | None = None, exact: bool = False) -> tuple[np.ndarray, float]:
    """(states, log-probability) of the likeliest path for observations (states x steps),
    by lists of predecessors; without ``least`` that of all transitions."""
    moves, seen, n = Predecessors.of(transition, least, exact), logs(prob.T, exact), len(transition)
    value = seen[0] + logs(np.full(n, 1 / n) if start is None else start, exact)
    back = np.zeros((len(seen) - 1, n), np.uint16 if n <= 65536 else np.int32)
    value = advance(moves, value, seen[1:], back)
    states = np.zeros(len(seen), int)
    states[-1] = value.argmax()
    for t in range(len(seen) - 1, 0, -1):
        states[t - 1] = back[t - 1, states[t]]
    return states, float(value.max())


class Banded:
    """Transitions of n voiced states and n unvoiced copies of them that move within a band.

    Only states that an observation speaks for are followed: a frame's few voiced ones, and the
    unvoiced ones, whose ways from each other lie in the band. What is left out is bounded: a
    state not followed, or a step out of the band, comes to no more than ``most``. A state whose
    best way is above that has its true value and predecessor, ties included; any other is
    not followed either. If the end lies above the bound, so does its whole path, which
    then is that of the whole matrix, bit by bit; else there is no answer.
    """

    def __init__(self, transition: np.ndarray):
        n = self.n = len(transition) // 2
        # row i: the ways out of i, or into i
        self.out = logs(transition)
        self.into = np.ascontiguousarray(self.out.T)
        i, j = np.nonzero(transition[n:, n:])
        h = self.half = int(np.abs(i - j).max(initial=0))
        near = np.arange(n) + np.arange(-h, h + 1)[:, None]
        # a row for each distance, so that one operation is for all states
        self.band = np.where((near >= 0) & (near < n), self.into[n + np.arange(n), n + near.clip(0, n - 1)], -np.inf)
        self.least = float(logs(np.zeros(1))[0])
        self.start = float(logs(np.array([1 / (2 * n)]))[0])

    def path(self, states: list[np.ndarray], probs: list[np.ndarray], unvoiced: np.ndarray) -> np.ndarray | None:
        """The likeliest states of frames with the voiced ``states`` (ascending) of ``probs``, and
        the probability ``unvoiced`` of each unvoiced one; None where that is not certain."""
        n, h = self.n, self.half
        seen, silent = [logs(p) for p in probs], logs(unvoiced)
        on, value = states[0], seen[0] + self.start
        padded = np.full(n + 2 * h, -np.inf)
        off, window = padded[h : h + n], np.lib.stride_tricks.sliding_window_view(padded, n)
        off[:] = silent[0] + self.start
        rest, came, ways = self.least + self.start, np.empty_like(self.band), []
        for t in range(1, len(seen)):
            top = max(value.max(initial=-np.inf), off.max())
            most = max(rest, top + self.least)
            ways.append((on, value, off.copy()))
            best = np.add(window, self.band, out=came).max(0)
            if len(on):
                best = np.maximum(best, (value[:, None] + self.out[on, n:]).max(0))
            to = states[t]
            value = np.concatenate([value + self.into[np.ix_(to, on)], off + self.into[to, n:]], 1).max(1)
            sure, fine = value > most, best > most
            rest = max(self.least + max(top, rest), -np.inf if fine.all() else silent[t] + most, (seen[t][~sure] + most).max(initial=-np.inf))
            on, value = to[sure], (seen[t] + value)[sure]
            off[:] = np.where(fine, silent[t] + best, -np.inf)
        if max(value.max(initial=-np.inf), off.max()) <= rest:
            return None
        out = np.zeros(len(seen), int)
        out[-1] = on[value.argmax()] if value.max(initial=-np.inf) >= off.max() else n + off.argmax()
        for t in range(len(seen) - 1, 0, -1):
            on, value, off = ways[t - 1]
            one = int(np.concatenate([value + self.into[out[t], on], off + self.into[out[t], n:]]).argmax())
            out[t - 1] = on[one] if one < len(on) else n + one - len(on)
        return out


# --- blocks of time


def _dense(rows: pa.Table, n: int) -> np.ndarray:
    """Log-probabilities (steps x 2n states) of analysed frames, in order."""
    voiced = rows.column("voiced_prob").to_numpy()
    prob = np.zeros((rows.num_rows, 2 * n))
    prob[:, n:] = ((1 - voiced) / n)[:, None]
    states, probs = (rows.column(c).combine_chunks() for c in ("states", "probs"))
    at = np.repeat(np.arange(rows.num_rows), np.asarray(states.value_lengths()))
    prob[at, np.asarray(states.flatten())] = np.minimum(np.asarray(probs.flatten()), 1)
    return logs(prob, True)


def _bytes(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x, "<f8").tobytes()


_PART = "audio_id long, sr int, block long, first binary, last binary, before binary"


def _start(n: int) -> np.ndarray:
    return np.repeat(logs(np.array([1 / (2 * n)]), True), 2 * n)


def _block_rows(group: pa.Table, size: int) -> tuple[int, pa.Table, pa.Table]:
    """(block, the frames before it, its own frames), in order."""
    group = group.sort_by("frame_idx")
    block = group.column("block")[0].as_py()
    own = np.asarray(group.column("frame_idx")) >= block * size
    return block, group.filter(pa.array(~own)), group.filter(pa.array(own))


def _survivors(back: np.ndarray) -> np.ndarray:
    """For each state at the end the state before the first step."""
    at = np.arange(back.shape[1])
    for came in back[::-1]:
        at = came[at].astype(np.int64)
    return at


def _chained() -> Callable[[pa.Table], pa.Table]:
    """Whether the blocks of a recording fit together, and if so each block's last state."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("block")
        first, last, before = ([None if v is None else np.frombuffer(v, kind) for v in group.column(c).to_pylist()] for c, kind in (("first", "<f8"), ("last", "<f8"), ("before", "<i8")))
        fits = all(len(np.unique(first[k] - last[k - 1])) == 1 for k in range(1, len(first)))
        ends = [0] * len(first)
        ends[-1] = int(last[-1].argmax())
        for k in range(len(first) - 1, 0, -1):
            ends[k - 1] = int(before[k][ends[k]])
        return pa.table({"audio_id": group.column("audio_id"), "block": group.column("block"), "fits": pa.array([fits] * len(first)), "end": pa.array(ends if fits else [None] * len(first), pa.int32())})

    return run


def decoded_states(seen: DataFrame, n: int, transition_of: Callable[[int], np.ndarray], block: int = BLOCK, ahead: int = AHEAD) -> DataFrame:
    """(audio_id, frame_idx, state, voiced_prob) of analysed frames (audio_id, sr, frame_idx,
    states, probs, voiced_prob; frame_idx from 0 without gaps): the likeliest sequence of
    the 2n states of each recording, decoded in blocks of time. ``transition_of`` gives
    the matrix for a rate.
    """
    moves: dict[int, Predecessors] = {}

    def of(sr: int) -> Predecessors:
        if sr not in moves:
            moves[sr] = Predecessors.of(transition_of(sr), exact=True)
        return moves[sr]

    columns = ("audio_id", "sr", "frame_idx", "states", "probs", "voiced_prob")
    seen = written(seen.select(*columns), "analysed")
    own = F.expr(f"frame_idx div {block}").alias("block")
    late = (F.col("frame_idx") % block >= block - ahead) if ahead < block else F.lit(True)
    # the last frames of a block go before the next one as well; beyond the recording's end nothing follows them
    again = seen.where(late).select(*columns, (F.expr(f"frame_idx div {block}") + 1).alias("block"))
    dealt = spread(seen.select(*columns, own).union(again), "audio_id", "block")

    def forward(group: pa.Table) -> pa.Table:
        k, early, rows = _block_rows(group, block)
        if not rows.num_rows:
            return pa.table({"audio_id": pa.array([], pa.int64()), "sr": pa.array([], pa.int32()), "block": pa.array([], pa.int64()), "first": pa.array([], pa.binary()), "last": pa.array([], pa.binary()), "before": pa.array([], pa.binary())})
        sr = rows.column("sr")[0].as_py()
        chain, here = of(sr), _dense(rows, n)
        back = np.zeros((len(here), 2 * n), np.int32)
        if k == 0:
            first, before = None, None
            value = here[0] + _start(n)
            last = advance(chain, value, here[1:])
        else:
            warm = _dense(early, n)
            first = advance(chain, warm[0] + _start(n), warm[1:])
            last = advance(chain, first, here, back)
            before = _survivors(back).astype("<i8").tobytes()
        return pa.table({"audio_id": rows.column("audio_id")[:1], "sr": rows.column("sr")[:1], "block": pa.array([k], pa.int64()), "first": pa.array([None if first is None else _bytes(first)], pa.binary()), "last": pa.array([_bytes(last)], pa.binary()), "before": pa.array([before], pa.binary())})

    parts = written(dealt.groupBy("audio_id", "block").applyInArrow(forward, _PART), "blocks")
    chained = written(parts.select("audio_id", "block", "first", "last", "before").groupBy("audio_id").applyInArrow(_chained(), "audio_id long, block long, fits boolean, end int"), "chained")

    def traced(key: tuple, frames: pa.Table, ends: pa.Table) -> pa.Table:
        if not frames.num_rows or not ends.num_rows:
            return pa.table({"audio_id": pa.array([], pa.int64()), "frame_idx": pa.array([], pa.int32()), "state": pa.array([], pa.int32()), "voiced_prob": pa.array([], pa.float64())})
        k, early, rows = _block_rows(frames, block)
        if not rows.num_rows:
            return traced(key, rows, ends)
        chain, here = of(rows.column("sr")[0].as_py()), _dense(rows, n)
        back = np.zeros((len(here), 2 * n), np.uint16 if 2 * n <= 65536 else np.int32)
        if k == 0:
            value = here[0] + _start(n)
        else:
            warm = _dense(early, n)
            value = advance(chain, warm[0] + _start(n), warm[1:])
            value = here[0] + chain.step(value)[0]
        advance(chain, value, here[1:], back[1:])
        states = np.zeros(len(here), np.int32)
        states[-1] = ends.column("end")[0].as_py()
        for t in range(len(here) - 1, 0, -1):
            states[t - 1] = back[t, states[t]]
        return pa.table({"audio_id": rows.column("audio_id"), "frame_idx": rows.column("frame_idx"), "state": pa.array(states), "voiced_prob": rows.column("voiced_prob")})

    schema = "audio_id long, frame_idx int, state int, voiced_prob double"
    fine = chained.where("fits").select("audio_id", "block", "end")
    found = dealt.groupBy("audio_id", "block").cogroup(fine.groupBy("audio_id", "block")).applyInArrow(traced, schema)
    apart = chained.where("not fits").select("audio_id").distinct()
    whole = seen.join(apart, "audio_id", "left_semi").groupBy("audio_id").applyInArrow(lambda group: _from_the_beginning(group, n, of, block), schema)
    return found.union(whole)


def _from_the_beginning(group: pa.Table, n: int, of: Callable[[int], Predecessors], block: int) -> pa.Table:
    """A whole recording in one task: values at blocks' beginnings are put aside, and back pointers made block by block from the end."""
    group = group.sort_by("frame_idx")
    chain, steps = of(group.column("sr")[0].as_py()), group.num_rows
    starts, value = [], None
    for at in range(0, steps, block):
        here = _dense(group.slice(at, block), n)
        starts.append(value)
        value = advance(chain, here[0] + _start(n), here[1:]) if value is None else advance(chain, value, here)
    states = np.zeros(steps, np.int32)
    state = int(value.argmax())
    for at in reversed(range(0, steps, block)):
        here = _dense(group.slice(at, block), n)
        back = np.zeros((len(here), 2 * n), np.uint16 if 2 * n <= 65536 else np.int32)
        begin = starts[at // block]
        if begin is None:
            advance(chain, here[0] + _start(n), here[1:], back[1:])
        else:
            advance(chain, begin, here, back)
        for t in reversed(range(len(here))):
            states[at + t] = state
            state = int(back[t, state])
    return pa.table({"audio_id": group.column("audio_id"), "frame_idx": group.column("frame_idx"), "state": pa.array(states), "voiced_prob": group.column("voiced_prob")})


def likeliest(sequences: DataFrame, transition: np.ndarray, least: float | None = None) -> DataFrame:
    """(series_id, step, state, log_prob) of rows (series_id, step, probs), probs being the
    probabilities of all states at a step: each series' likeliest states by lists of
    predecessors, and that path's log-probability. Transitions under ``least`` are impossible."""

    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by("step")
        prob = np.asarray(group.column("probs").combine_chunks().flatten()).reshape(group.num_rows, -1).T
        states, log_prob = pruned_viterbi(prob, transition, least=least)
        return pa.table({"series_id": group.column("series_id"), "step": group.column("step"), "state": pa.array(states, pa.int32()), "log_prob": pa.array(np.full(group.num_rows, log_prob))})

    narrow = sequences.select(F.col("series_id").cast("long").alias("series_id"), F.col("step").cast("int").alias("step"), F.col("probs").cast("array<double>").alias("probs"))
    return spread(narrow, "series_id").groupBy("series_id").applyInArrow(run, "series_id long, step int, state int, log_prob double")

