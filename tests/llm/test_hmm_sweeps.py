"""op8's sweeps, within their CPU seconds: groups alike, counts by state side by side, each token's states add to 1 without a pass that makes them."""

import numpy as np
import pytest
from test_models import plain_sweep, tiny

from lumbre.llm import hmm


def test_groups_are_alike_in_tokens():
    rng = np.random.default_rng(3)
    sizes = rng.integers(1, 60, 1000)
    chosen = np.flatnonzero(rng.random(1000) < 0.8)
    groups = list(hmm.groups_of(sizes, chosen, int(sizes[chosen].sum()) // 2 - 100))
    of = [int(sizes[g].sum()) for g in groups]
    assert len(groups) == 3 and max(of) - min(of) < 120  # no remnant of a few tokens, which would cost tables and steps of its own
    np.testing.assert_array_equal(np.sort(np.concatenate(groups)), chosen)
    assert all(sizes[a].min() >= sizes[b].max() for a, b in zip(groups, groups[1:]))
    assert list(hmm.groups_of(sizes, chosen[:0])) == []
    assert [g.tolist() for g in hmm.groups_of(np.array([90, 9000, 95]), np.arange(3), 200)] == [[1], [2, 0]]  # a longer document stands alone


@pytest.mark.parametrize("lengths", [[1], [1, 1, 1], [16, 17, 15, 33, 1], [40] * 5, [3000, 1, 64, 65, 64, 2]])
def test_sweeps_equal_the_plain_recursion(lengths):
    model, rng = tiny(4, 6), np.random.default_rng(len(lengths))
    sequences = [rng.integers(0, 6, n) for n in lengths]
    sizes = np.array(lengths)
    batch = hmm.Batch.of(sizes)
    laid = batch.laid(np.concatenate(sequences).astype(np.int32), np.cumsum(sizes) - sizes)
    start, moves, states, logs = hmm.expected(model.start, model.move, model.emit[laid], batch)
    assert all(states[:, s].flags.c_contiguous for s in range(4))  # counting takes them as they lie
    np.testing.assert_allclose(states.sum(axis=1), 1, rtol=1e-12)
    alone = [plain_sweep(model, s) for s in sequences]
    np.testing.assert_allclose(logs, [alone[i][0] for i in batch.order], rtol=1e-12)
    np.testing.assert_allclose(start, sum(g[0] for _, g, _ in alone), rtol=1e-10)
    np.testing.assert_allclose(moves, sum(m for _, _, m in alone), rtol=1e-9, atol=1e-12)
    for place, i in enumerate(batch.order):
        at = batch.at[: sizes[i]] + place
        np.testing.assert_array_equal(laid[at], sequences[i])
        np.testing.assert_allclose(states[at], alone[i][1], rtol=1e-9)
