"""Many references at once, and SQL functions over batches of a join."""

import numpy as np
import pandas as pd
import pytest

from humsearch.functions import pitch as P
from humsearch.operators import dtw
from humsearch.plans import queries, search


@pytest.mark.parametrize("longest, kind", [(40, np.uint16), (700, np.uint32)])
def test_rounded_costs_tell_the_shifts(monkeypatch, longest, kind):
    """Exact costs though few shifts are summed in double precision, for queries shorter and longer than references."""
    rng, table, turns, kinds = np.random.default_rng(1), P.distance_table(), np.arange(0, 24, 2), []
    kept = dtw._last_total

    def seen(cost, n, m, shape, of, down):
        kinds.append((of, int(np.prod(shape))))
        return kept(cost, n, m, shape, of, down)

    monkeypatch.setattr(dtw, "_last_total", seen)
    refs = [rng.integers(0, 25, n) for n in rng.integers(longest // 2, longest, 20)]
    made = dtw.References(refs, table)
    for _ in range(3):
        q = rng.integers(0, 25, rng.integers(longest // 2, longest))
        assert made.costs(q, turns).tolist() == [dtw.References([r], table).costs(q, turns)[0] for r in refs]
        np.testing.assert_allclose(made.costs(q, turns), [dtw.subsequence_cost(q, r, table, turns) for r in refs], atol=1e-12)
    assert {k for k, _ in kinds} == {kind, np.float64}
    assert sum(n for k, n in kinds if k == np.float64) < sum(n for k, n in kinds if k != np.float64) / 3


def test_batches_of_a_join():
    """Nulls, empty arrays and rows in any order; of repeated arrays either side may be the one with fewer."""
    rng, table, turns = np.random.default_rng(2), P.distance_table(), np.arange(0, 24, 2)
    some = lambda n: [np.where(x < 24, x, np.nan) for x in (rng.integers(0, 25, rng.integers(1, 12)) for _ in range(n))]
    for a, b in ((2, 9), (9, 2), (5, 5)):
        pairs = [(q, t) for q in [*some(a), None] for t in [*some(b), np.array([])]]
        pairs = [pairs[k] for k in rng.permutation(len(pairs))]
        got = search._batch_costs(*map(pd.Series, zip(*pairs)), table, turns)
        whole = lambda v: np.nan_to_num(v, nan=24).astype(int)
        want = [np.nan if q is None or not len(t) else dtw.subsequence_cost(whole(q), whole(t), table, turns) for q, t in pairs]
        np.testing.assert_allclose(got, want, atol=1e-12)


def test_join_of_sql_functions_is_spread(spark, sf_dir):
    assert queries.sql_functions(spark, sf_dir).rdd.getNumPartitions() >= 4 * spark.sparkContext.defaultParallelism
