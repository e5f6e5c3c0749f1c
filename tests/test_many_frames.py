"""Many frames at once and decoding within a band: the same, bit by bit, as a frame and a whole matrix."""

import numpy as np
import pytest

from humsearch.operators import pyin
from humsearch.operators.decoding import Banded
from humsearch.plans.queries import hummed_pitch


@pytest.mark.parametrize("settings", [pyin.PitchSettings(fmin=80.0, fmax=800.0, frame_length=256, hop_length=128), pyin.PitchSettings(fmin=260.0, fmax=1900.0, frame_length=64, resolution=1.0, boltzmann=1.0, no_trough_prob=0.2)])
def test_frames_together(settings):
    rng, sr, size = np.random.default_rng(5), 4000, settings.frame_length
    low, high = settings.periods(sr)
    x = np.concatenate([rng.normal(size=(60, size)), np.sin(np.arange(size) * rng.uniform(0.1, 1.5, 60)[:, None]), np.zeros((3, size)), np.ones((3, size)), np.round(rng.normal(size=(20, size)))])
    y = pyin.normalised_difference(x, low, high)
    counts, states, probs, voiced = pyin.observe_all(y, sr, low, settings)
    ends = np.cumsum(counts)[:-1]
    for k, (a, b) in enumerate(zip(np.split(states, ends), np.split(probs, ends), strict=True)):
        want = pyin.observe(y[k], sr, low, settings)
        assert a.tolist() == want[0].tolist() and b.tolist() == want[1].tolist() and voiced[k] == want[2]


def test_band_is_the_whole_matrix():
    rng, certain = np.random.default_rng(2), 0
    for _ in range(300):
        n, steps = int(rng.integers(4, 40)), int(rng.integers(1, 20))
        matrix = np.kron(pyin.loop_transition(2, 1 - rng.choice([0.01, 0.3, 1.0])), pyin.local_transition(n, int(rng.integers(1, n + 1))))
        prob, states, probs, unvoiced = np.zeros((2 * n, steps)), [], [], np.zeros(steps)
        for t in range(steps):
            k = int(rng.integers(0, 5))
            at, p = np.sort(rng.choice(n, min(k, n), replace=False)), rng.choice([0.25, 0.5, 1e-20, 1 / max(k, 1)], min(k, n))
            unvoiced[t] = (1 - np.clip(p.sum(), 0, 1)) / n
            prob[n:, t], prob[at, t] = unvoiced[t], p
            states.append(at), probs.append(p)
        got = Banded(matrix).path(states, probs, unvoiced)
        if got is not None:
            certain += 1
            assert got.tolist() == pyin.viterbi(prob, matrix)[0].tolist()
    assert certain > 100


def test_recordings_are_dealt_out(spark, sf_dir):
    """Keys of recordings fill a single small file; recordings are made in all tasks."""
    plan = hummed_pitch(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning(s_suppkey" in plan
