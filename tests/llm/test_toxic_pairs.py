from __future__ import annotations

import numpy as np

from doclathe.llm.toxicity import FactorizationMachine


def pairs(seed, n):
    """Toxic where two terms meet that tell nothing alone, among terms that tell nothing at all."""
    rng = np.random.default_rng(seed)
    x = rng.integers(0, 2, (n, 2))
    rows = [np.array(sorted({2 + a, 4 + b} | {int(t) for t in rng.integers(10, 3000, 10)}), np.int64) for a, b in x]
    return rows, (x[:, 0] == x[:, 1]).astype(float)


def test_pairs_are_learned_through_the_selection_of_terms():
    rows, y = pairs(0, 4000)
    m = FactorizationMachine.fit(rows, y, np.ones(len(y)), features=500)
    place = {int(b): i for i, b in enumerate(m.buckets)}
    rows, y = pairs(1, 1000)
    right = [(m.score(np.array([place[int(b)] for b in r if int(b) in place], np.int64)) >= 0.5) == bool(t) for r, t in zip(rows, y)]
    assert np.mean(right) > 0.9
