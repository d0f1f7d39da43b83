"""Anchors of a block are looked for part by part."""

from __future__ import annotations

import numpy as np

from quire.llm import suffix_dedup


def test_anchors_by_parts():
    """Parts give the runs of the whole block, and no array of a part's size grows with the block."""
    r = np.random.default_rng(5)
    sizes = np.array([0, 400, 3, 70, 0, 2_000, 50, 49, 900, 0])
    data = r.integers(97, 100, sizes.sum()).astype(np.uint8)
    whole = suffix_dedup.anchor_runs(data, sizes, part=1 << 30)
    for part in (1, 60, 1_000):
        for x, y in zip(suffix_dedup.anchor_runs(data, sizes, part=part), whole, strict=True):
            assert x.dtype == y.dtype and x.tolist() == y.tolist()
    empty = np.zeros(0, np.int64)
    assert [len(x) for x in suffix_dedup.anchor_runs(empty.astype(np.uint8), empty)] == [0, 0, 0, 0]
