"""Ranks of numbers by one plain sort."""

from __future__ import annotations

import numpy as np
import pytest

from triplane.llm.common import from_varints, ranked, varints


@pytest.mark.parametrize("values", [[], [5], [3, 1, 3, 0, 1], [2**62, 1, 2**62, 0], [0] * 300, list(range(999, -1, -1))])
def test_ranked(values):
    values = np.array(values, np.int64)
    for got, want in zip(ranked(values), np.unique(values, return_index=True, return_inverse=True), strict=True):
        assert got.tolist() == want.tolist() and got.dtype == want.dtype
    data, size = varints(values)
    assert from_varints(data).tolist() == values.tolist() and int(size.sum()) == len(data)
