"""Decoding by lists of predecessors and in blocks of time, against the dense one and a naive one."""

import numpy as np
import pytest

from humsearch.operators import decoding, pyin


def naive(prob, transition, least):
    """Every cell by a loop; the first of equal ways."""
    n, steps = prob.shape
    value = [np.log(prob[s, 0] + decoding.TINY) + np.log(1 / n + decoding.TINY) for s in range(n)]
    back = []
    for t in range(1, steps):
        now, came = [], []
        for j in range(n):
            ways = [(value[i] + np.log(transition[i, j] + decoding.TINY), -i) for i in range(n) if least is None or transition[i, j] >= least]
            best = max(ways)
            now.append(np.log(prob[j, t] + decoding.TINY) + best[0])
            came.append(-best[1])
        value, back = now, [*back, came]
    states = [int(np.argmax(value))]
    for came in reversed(back):
        states.append(came[states[-1]])
    return states[::-1], max(value)


@pytest.mark.parametrize("least", [None, 0.1, 0.2])
@pytest.mark.parametrize("kind", ["local", "loop", "random", "zeros"])
def test_predecessors(kind, least):
    rng = np.random.default_rng(1)
    for _ in range(15):
        n = 7
        # values of few sizes, so that ways are often equal
        prob = rng.choice([0, 0.25, 0.5, 1], (n, 12))
        transition = {"local": pyin.local_transition(n, 3), "loop": pyin.loop_transition(n, 0.4), "random": rng.dirichlet(np.ones(n), n), "zeros": np.roll(np.eye(n), int(rng.integers(0, n)), axis=1)}[kind]
        if least is not None and not (transition >= least).any(0).all():
            with pytest.raises(ValueError, match="reached"):
                decoding.pruned_viterbi(prob, transition, least=least)
            continue
        states, p = decoding.pruned_viterbi(prob, transition, least=least)
        want, q = pyin.viterbi(prob, transition, least_transition=least)
        assert states.tolist() == want.tolist() and p == q
        slow, r = naive(prob, transition, least)
        assert states.tolist() == slow and p == pytest.approx(r)


def test_fewer_operations():
    moves = decoding.Predecessors.of(pyin.local_transition(400, 5))
    assert len(moves.states) < 2000 and moves.rest < -700
    pruned = decoding.Predecessors.of(pyin.local_transition(400, 5), 0.2)
    assert len(pruned.states) < len(moves.states) and pruned.rest == -np.inf


SETTINGS = pyin.PitchSettings(fmin=200.0, fmax=400.0, frame_length=256, hop_length=128, resolution=1.0)


def analysed(spark, lengths, sure=True):
    """Frames as ``analysed`` gives them: a melody with some noise, voiced in stretches."""
    n, rows = SETTINGS.n_bins(), []
    for audio_id, steps in lengths.items():
        rng = np.random.default_rng(audio_id)
        tune = np.clip(np.cumsum(rng.integers(-1, 2, steps)) % n, 0, n - 1)
        for t in range(steps):
            some = np.unique([int(tune[t]), int(rng.integers(0, n))])
            p = rng.random(len(some)) * (0.5 if sure and (t // 40) % 3 else 0.02)
            rows.append((audio_id, 8000, t, some.tolist(), p.tolist(), float(min(1, p.sum()))))
    return rows, spark.createDataFrame(rows, "audio_id long, sr int, frame_idx int, states array<int>, probs array<double>, voiced_prob double")


def dense(rows, audio_id):
    n, mine = SETTINGS.n_bins(), sorted(r for r in rows if r[0] == audio_id)
    prob = np.zeros((2 * n, len(mine)))
    for t, (*_, states, p, voiced) in enumerate(mine):
        prob[n:, t] = (1 - voiced) / n
        prob[states, t] = p
    return prob


def moves(sr):
    return np.kron(pyin.loop_transition(2, 1 - SETTINGS.switch_prob), pyin.local_transition(SETTINGS.n_bins(), SETTINGS.width(sr)))


@pytest.mark.parametrize("block, ahead", [(64, 32), (50, 49), (1000, 10), (8, 1)])
def test_blocks_give_the_same_states(spark, block, ahead):
    """Also where blocks don't come together, as one frame ahead is too few, and for lengths around a block's."""
    rows, seen = analysed(spark, {1: 300, 2: 1, 3: block, 4: block + 1, 5: 2 * block - ahead})
    matrix = moves(8000)
    got = decoding.decoded_states(seen, SETTINGS.n_bins(), lambda sr: matrix, block, ahead).toPandas()
    for audio_id in (1, 2, 3, 4, 5):
        want, _ = decoding.pruned_viterbi(dense(rows, audio_id), matrix, exact=True)
        mine = got[got.audio_id == audio_id].sort_values("frame_idx")
        assert mine.frame_idx.tolist() == list(range(len(want))) and mine.state.tolist() == want.tolist()


def test_as_decoded_by_recordings(spark):
    rows, seen = analysed(spark, {7: 400})
    a = pyin.decoded(seen, SETTINGS).orderBy("frame_idx").toPandas()
    b = pyin.decoded_in_blocks(seen, SETTINGS, block=100, ahead=50).orderBy("frame_idx").toPandas()
    assert (a.voiced == b.voiced).all() and np.allclose(a.f0.fillna(0), b.f0.fillna(0)) and a.voiced.any() and not a.voiced.all()


def test_long_recording(spark):
    """50,000 frames: the same states as decoded whole, by blocks that came together."""
    rows, seen = analysed(spark, {9: 50_000})
    seen = seen.repartition(8)
    matrix = moves(8000)
    got = decoding.decoded_states(seen, SETTINGS.n_bins(), lambda sr: matrix).orderBy("frame_idx").toPandas()
    want, _ = decoding.pruned_viterbi(dense(rows, 9), matrix, exact=True)
    assert got.state.tolist() == want.tolist()
    plain, _ = pyin.viterbi(np.minimum(dense(rows, 9), 1), matrix)
    assert (got.state.to_numpy() == plain).mean() > 0.999
