"""Recall of lattice cells on vectors of few dimensions."""

import numpy as np
import pytest

from sieveline.llm import lattice_dedup


@pytest.mark.parametrize("dims", [2, 4, 8, 15, 16, 64])
def test_recall_of_few_dimensions(dims):
    rng = np.random.default_rng(5)
    a, g = rng.standard_normal((2, 2000, dims))
    a /= np.linalg.norm(a, axis=1)[:, None]
    g -= (g * a).sum(1)[:, None] * a
    b = 0.9 * a + np.sqrt(1 - 0.81) * g / np.linalg.norm(g, axis=1)[:, None]
    planes = lattice_dedup.projections(dims)
    x, y = (lattice_dedup.cell_keys(v, planes) for v in (a, b))
    recall = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3)).mean()
    print(dims, recall)
    assert recall >= 0.94
