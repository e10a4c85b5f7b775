"""Packed runs of operator 4's count: what is unpacked is what was packed."""

import numpy as np
import pytest

from recordweave.llm import ngram_join


@pytest.mark.parametrize("seed", range(5))
def test_runs_of_any_gaps_come_back(seed):
    rng = np.random.default_rng(seed)
    kinds = [(48, 0), (48, 1), (48, 3), (48, 50_000), (20, 500), (33, 4), (48, 0)]
    runs = [np.unique(rng.integers(0, 1 << bits, n, dtype=np.uint64)) for bits, n in kinds]
    runs += [np.array(x, np.uint64) for x in ([0], [(1 << 48) - 1], [0, (1 << 48) - 1], [5, 5 + (1 << 32) - 1, 5 + (1 << 33)], [1 << 32])]
    rng.shuffle(order := list(range(len(runs))))
    packed = [ngram_join._pack(runs[i]) for i in order]
    tokens, sizes = ngram_join._unpack([p[0] for p in packed], [p[1] for p in packed])
    assert tokens.tolist() == np.concatenate([runs[i] for i in order]).tolist()
    assert sizes.tolist() == [len(runs[i]) for i in order]


def test_no_runs():
    tokens, sizes = ngram_join._unpack([], [])
    assert not len(tokens) and not len(sizes)
