"""The expansion begins where the sort has parted the suffixes; windows are marked by arrays, not one by one."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quire.llm import suffix_dedup as sd


def test_expansion_begins_at_the_sorted_depth():
    """Ranks part suffixes by their first symbols, and the expansion from there finds the least document of each window."""
    r = np.random.default_rng(4)
    for length in (8, 15, 22, 50):
        strings = [r.integers(97, 100, n).astype(np.uint8).tobytes() for n in (length, 70, 90, 120)]
        strings += [strings[1][3:68], strings[2][:length] + b"x", b"a" * 100, b"a" * (length + 1)]
        strings = [s for s in strings if len(s) >= length]
        text = np.frombuffer(b"\0" + b"\0".join(strings) + b"\0", np.uint8).astype(np.int16)
        order, depth, rank = sd.ranked_suffixes(text, length)
        assert 0 < depth < length and order.tolist() == sd.sorted_suffixes(text, length).tolist()
        first = [tuple(text[p : p + depth]) for p in order]
        assert [x != y for x, y in zip(first, first[1:])] == (np.diff(rank[order]) > 0).tolist()
        ids = r.permutation(len(strings)).astype(np.int64)
        want = [[min(d for t, d in zip(strings, ids) if s[i : i + length] in t) for i in range(len(s) - length + 1)] for s in strings]
        assert [x.tolist() for x in sd.least_documents(strings, ids, length)] == want


def test_places_are_marked_together(monkeypatch):
    """What arrays mark is what a loop over windows marks; runs end where texts do, also beside empty ones."""
    r, length = np.random.default_rng(8), 6
    sizes = np.array([0, 40, 0, 30, 6, 5, 90, 0])
    raw = r.integers(97, 123, sizes.sum()).astype(np.uint8)
    at, many, doc = np.array([0, 20, 40, 70, 85, 120]), np.array([15, 15, 25, 1, 30, 9]), np.array([4, 4, 6, 7, 9, 9])
    least = [np.array([3]), r.integers(0, 9, 15), r.integers(0, 9, 25), np.array([1]), None, r.integers(0, 12, 9)]
    rows = [(sd.string_key(raw[p : p + k + length - 1].tobytes()), x.astype("<i8").tobytes()) for p, k, x in zip(at, many, least) if x is not None][::-1]
    answers = pa.table({"key": pa.array([x[0] for x in rows], pa.binary()), "least": pa.array([x[1] for x in rows], pa.binary())})
    want = np.zeros(len(raw), bool)
    for p, k, x, d in zip(at, many, least, doc):
        for j in range(k):
            if x is not None and x[j if len(x) > 1 else 0] < d:
                want[p + j : p + j + length] = True
    for windows in (1, 20, 1 << 20):
        monkeypatch.setattr(sd, "MARK_WINDOWS", windows)
        bad = np.zeros(len(raw), bool)
        sd.mark_repeats(bad, raw, answers, doc, at, many, length)
        assert bad.tolist() == want.tolist()
    ends = np.cumsum(sizes)
    first, last = sd._removed_runs(want, ends)
    covered = np.zeros(len(raw), int)
    for s, e in zip(first, last):
        covered[s:e] += 1
        assert not any(s < x < e for x in ends)
    assert covered.tolist() == want.astype(int).tolist()
    assert [x.tolist() for x in sd._removed_runs(np.ones(4, bool), np.array([0, 2, 2, 4]))] == [[0, 2], [2, 4]]
    assert [x.tolist() for x in sd._removed_runs(np.zeros(0, bool), np.array([0]))] == [[], []]
