"""Normalising a date takes memory for a chunk of its columns, not for all of them."""

import tracemalloc

import numpy as np

from panelwright.operators import normalize as N


def columns(rows, count, seed=1):
    draw = np.random.default_rng(seed)
    out = []
    for _ in range(count):
        x = draw.standard_normal(rows).astype(np.float32)
        x[draw.random(rows) < 0.05] = np.nan
        out.append(x)
    return out


def test_chunks_give_the_block():
    values = columns(700, 37)
    edges = [0, 40, 41, 300, 700]
    want = np.empty((700, 37), np.float32)
    for a, b in zip(edges, edges[1:]):
        want[a:b] = N.mad_zscore_block(np.stack(values, 1)[a:b])
    for cells in (1, 700 * 5, 10**9):
        got = list(N.normalised_columns(values, edges, cells=cells))
        np.testing.assert_array_equal(np.stack(got, 1), want)
    assert list(N.normalised_columns([], [0, 5])) == []


def test_peak_does_not_follow_the_number_of_columns():
    peaks = []
    for count in (60, 600):
        values = columns(4_000, count)
        tracemalloc.start()
        for made in N.normalised_columns(values, [0, 4_000], cells=200_000):
            assert made.shape == (4_000,)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert peaks[1] < 1.2 * peaks[0] and peaks[1] < 30_000_000
