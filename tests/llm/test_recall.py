"""Recall of the vector hashing at each width that larger tables take."""

import numpy as np
import pytest

pytest.importorskip("sluice.llm")

from sluice.llm.embeddings import CrossPolytope  # noqa: E402


@pytest.mark.parametrize(("width", "least"), [(1, 0.999), (2, 0.999), (3, 0.995), (4, 0.99)])
def test_pairs_at_the_limit_share_a_bucket(width, least):
    rng, n, dim, cosine = np.random.default_rng(width), 2000, 64, 0.95
    unit = lambda v: v / np.linalg.norm(v, axis=1)[:, None]
    x, y = unit(rng.normal(size=(n, dim))), rng.normal(size=(n, dim))
    y = unit(y - (x * y).sum(1)[:, None] * x)
    lsh = CrossPolytope(dim, 8, width)
    met = [bool(set(map(int, a)) & set(map(int, b))) for a, b in zip(lsh.names(x, dim, 2), lsh.names(cosine * x + np.sqrt(1 - cosine**2) * y, dim, 2))]
    assert np.mean(met) >= least
