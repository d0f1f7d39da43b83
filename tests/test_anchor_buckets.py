"""Anchors of a block go to buckets of like size, though an anchor is a least hash."""

import numpy as np

from quire.llm import suffix_dedup as sd


def test_buckets_of_anchors_are_even():
    data = np.random.default_rng(6).integers(97, 123, 400_000).astype(np.uint8)
    anchors = np.unique(sd.anchor_runs(data, np.full(40, 10_000))[0])
    for bits in (4, 5, 9):
        bucket = sd._short(anchors, bits) >> np.uint64(8 * sd.KEPT_BYTES)
        sizes = np.bincount(bucket.astype(np.int64), minlength=1 << bits)
        assert len(sizes) == 1 << bits and sizes.max() < 2 * len(anchors) / len(sizes) and sizes.min() > 0
        assert len(np.unique(sd._short(anchors, bits))) == len(anchors)
