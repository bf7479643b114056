"""A search with a number of documents for each query keeps no more than that of each."""

import random

import numpy as np
import pyarrow as pa
import pytest

from codestrata.operators import scoring as S


@pytest.mark.parametrize("cached", [S.CACHED, 4])
def test_best_of_each(monkeypatch, cached):
    """With and without a first block that bounds the others; ties by key, queries without a place get nothing."""
    monkeypatch.setattr(S, "CACHED", cached)
    rng, k = random.Random(7), np.array([0, 1, 3, 20, 2, 60])
    scores = np.array([[rng.choice([0, 0.5, 1, 1.25, 3, rng.random()]) for _ in range(400)] for _ in k])
    best = S.Best(len(k), k, True)
    best.room = 50
    for a in range(0, 400, 100):
        best.add(scores[:, a : a + 100], None, pa.array(range(a, a + 100), pa.int64()))
    got = [(r["query"], r["doc"]) for x in best.batches(np.arange(len(k))) for r in x.to_pylist()]
    want = [(q, d) for q in range(len(k)) for d in sorted((d for d in range(400) if scores[q, d] > 0), key=lambda d: (-round(scores[q, d], 6), d))[: k[q]]]
    assert sorted(got) == sorted(want)
