"""Distances and codes of many series at once, against those of one series after the other."""

import time

import numpy as np
import pytest

from shapeloom.operators import learning, series


@pytest.mark.parametrize("znorm", [True, False])
@pytest.mark.parametrize("q", [5, 16])
def test_distances_equal_those_by_differences(q, znorm):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 40))
    x[3], x[4, 5], x[5, 7] = 1.0, np.nan, np.inf  # all places tie; no numbers
    x[6], x[7], x[8] = x[6] * 1e150, x[7] * 1e6, x[8] * 1e-200
    x[9] = np.tile(x[9, :10], 4)
    bank = np.concatenate([x[8:20, 3 : 3 + q], x[7:8, :q], x[3:4, :q]])  # pieces of series: distances of 0
    bank = series._normalised(bank) if znorm else bank
    with np.errstate(all="ignore"):
        want = np.array([series._plain_distances(v, bank, znorm) for v in x])
        got = series.least_distances(x, bank, znorm)
    assert np.array_equal(got, want, equal_nan=True) or np.allclose(got, want, rtol=1e-12, atol=0, equal_nan=True)
    assert (got[np.arange(8, 20), np.arange(12)] < 1e-12).all()


def test_distances_take_less_than_a_loop():
    """One series and atom after the other took 3 to 9 times as long."""
    rng = np.random.default_rng(2)
    x, bank = rng.standard_normal((series.LOT * 4, 64)), rng.standard_normal((30, 16))
    took = []
    for run in (lambda: [series.least_distances(x[k : k + series.LOT], bank, True) for k in range(0, len(x), series.LOT)], lambda: [series._plain_distances(v, bank, True) for v in x]):
        times = []
        for _ in range(3):
            t = time.perf_counter()
            run()
            times.append(time.perf_counter() - t)
        took.append(min(times))
    assert took[0] < 0.6 * took[1]


@pytest.mark.parametrize("signed", [True, False])
def test_codes_do_not_depend_on_lots(monkeypatch, signed):
    rng = np.random.default_rng(3)
    x, s = rng.standard_normal((50, 30)), rng.standard_normal((4, 7))
    s[2] = 0  # an atom without values is left out
    a, off = rng.standard_normal((50, 4)), rng.integers(0, 24, (50, 4))

    def coded(eps=-1.0):
        return learning.code(x, s, a, off, 0.3, 4, eps, signed, np.random.default_rng(5))

    want, early = coded(), coded(0.5)
    monkeypatch.setattr(learning, "LOT", 7)
    for (got_a, got_off), (want_a, want_off) in ((coded(), want), (coded(0.5), early)):
        assert np.allclose(got_a, want_a) and (got_off == want_off).all()
    monkeypatch.setattr(learning, "BANDED", 0)  # long series: no table of an atom at its places
    got_a, got_off = coded()
    assert np.allclose(got_a, want[0]) and (got_off == want[1]).all()
