"""The budget's fit against all sums that there are, and its memory."""

import tracemalloc

import numpy as np
import pytest

from lodestack.llm import mixing


def nearest(lengths, counts, budget):
    """How near the budget any choice comes: all sums as bits of one number."""
    reach = 1
    for n, c in zip(lengths.tolist(), counts.tolist(), strict=True):
        part = 1
        while c > 0:
            k = min(part, c)
            reach |= reach << n * k
            c -= k
            part *= 2
    return next(d for d in range(budget + 1) if reach >> budget - d & 1 or reach >> budget + d & 1)


@pytest.mark.parametrize("seed", range(4))
def test_fit_is_the_best_there_is(seed):
    rng = np.random.default_rng(seed)
    for _ in range(100):
        lengths = np.sort(rng.choice(np.arange(400, 6001), rng.integers(1, 5), replace=False))
        if rng.random() < 0.3:
            lengths = lengths * 7
        counts = rng.integers(1, 120, len(lengths))
        budget = int(rng.integers(0, int((lengths * counts).sum()) + 1))
        take = mixing.fit_counts(lengths, counts, budget)
        assert ((take >= 0) & (take <= counts)).all()
        assert abs(int((lengths * take).sum()) - budget) == nearest(lengths, counts, budget)


def test_fit_of_many_documents():
    # A million documents of two lengths: thousands have to be exchanged to meet the budget.
    lengths, counts = np.array([5999, 6000]), np.array([500_000, 500_000])
    for budget in (3_000_000_017, 2_999_123_457):
        assert int((lengths * mixing.fit_counts(lengths, counts, budget)).sum()) == budget


def test_fit_remembers_little():
    lengths = np.r_[np.arange(2, 3000, 2), 2_000_000]
    counts = np.full(len(lengths), 9)
    tracemalloc.start()
    budget = int((lengths * counts).sum()) // 2 | 1
    take = mixing.fit_counts(lengths, counts, budget)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert abs(int((lengths * take).sum()) - budget) == 1 and peak < 200 << 20
