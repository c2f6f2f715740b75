"""Bounds and searches under warping against the whole table."""

import numpy as np
import pytest

from shapeloom.functions import dtw as D
from shapeloom.operators import series


def some(rng, n):
    return np.cumsum(rng.standard_normal(n))


def test_bounds_are_below_the_distance():
    rng = np.random.default_rng(0)
    for _ in range(200):
        a, b, band = some(rng, rng.integers(1, 20)), some(rng, rng.integers(1, 20)), rng.choice([0.0, 0.1, 0.3, 0.9])
        d2 = D.dtw(a, b, band) ** 2
        reach = D.reach_of(len(a), len(b), band)
        assert D.outside(a, *D.envelope(b, len(a), reach)) <= d2 + 1e-9 and D.outside(b, *D.envelope(a, len(b), reach)) <= d2 + 1e-9
        assert D.dtw_many(np.stack([a, a + 1]), b, band) == pytest.approx([D.dtw(a, b, band), D.dtw(a + 1, b, band)])


@pytest.mark.parametrize("band", [0.05, 0.9])
def test_nearest_is_the_least_of_all_tables(band):
    rng = np.random.default_rng(1)
    base = [some(rng, n) * 2 for n in (30, 30, 24, 30, 9)]
    atoms = [b + 0.2 * rng.standard_normal(len(b)) for b in base for _ in range(6)] + [base[0], base[0]]
    search, tables = D.NearestByDtw(atoms, band), 0
    queries = [base[k % 4] + 0.3 * rng.standard_normal(len(base[k % 4])) for k in range(40)] + [base[0], np.array([]), np.array([1.0])]
    for v in queries:
        at, d, full = search.find(v)
        every = [D.dtw(v, s, band) for s in atoms]
        assert d == pytest.approx(min(every)) and every[at] == pytest.approx(min(every)) and (min(every) > 0 or at == int(np.argmin(every)))
        tables += full
    assert tables < 0.6 * len(queries) * len(atoms)


def test_metrics_of_features_and_matches(spark):
    rng = np.random.default_rng(2)
    x = [some(rng, n).tolist() for n in (12, 12, 5, 30)]
    rows = spark.createDataFrame([*enumerate(x), (4, None), (5, [])], "vec_id long, x array<double>")
    atoms = [some(rng, n).tolist() for n in (6, 6, 8)]
    d = spark.createDataFrame([(10 + k, "ab"[k % 2], s) for k, s in enumerate(atoms)], "pos long, label string, s array<double>")
    got = {r.vec_id: r.features for r in series.feature_matrix(rows, d, metric="dtw").collect()}
    assert all(got[k] == pytest.approx([D.dtw(v, s) for s in atoms]) for k, v in enumerate(x)) and got[4] == [np.inf] * 3 and got[5] == [np.inf] * 3
    near = {r.vec_id: r for r in series.nearest_atom(rows, d, "dtw").collect()}
    assert [(near[k].pos, near[k].shapelet_label) for k in range(4)] == [(10 + k, "ab"[k % 2]) for k in (int(np.argmin(got[i])) for i in range(4))] and near[4].pos is None
    flat = {r.vec_id: r for r in series.nearest_atom(rows, d).collect()}
    plain = {r.vec_id: r.features for r in series.feature_matrix(rows, d, znorm=False).collect()}
    assert all(flat[k].dist == pytest.approx(min(plain[k])) and flat[k].pos == 10 + int(np.argmin(plain[k])) for k in (0, 1, 3)) and flat[2].pos is None and flat[4].dist is None
    assert series.nearest_atom(rows.filter("false"), d, "dtw").count() == 0 and series.nearest_atom(rows, d.filter("false"), "dtw").filter("pos is not null").count() == 0
    with pytest.raises(ValueError, match="unknown metric"):
        series.feature_matrix(rows, d, metric="other")


@pytest.mark.parametrize("band", [0.05, 0.9])
def test_nearest_of_many_is_that_of_each(band):
    rng = np.random.default_rng(3)
    base = [some(rng, n) * 2 for n in (30, 30, 24, 30, 9)]
    atoms = [b + 0.2 * rng.standard_normal(len(b)) for b in base for _ in range(6)] + [base[0], base[0]]
    x = np.stack([base[0], *[base[k] + 0.3 * rng.standard_normal(30) for k in (0, 1, 3) for _ in range(20)]])
    at, d, tables = D.nearest_of_many(x, atoms, band)
    each = [D.NearestByDtw(atoms, band).find(v) for v in x]
    assert at.tolist() == [e[0] for e in each] and d == pytest.approx([e[1] for e in each])
    assert tables.sum() < 0.6 * x.shape[0] * len(atoms)
    assert D.nearest_of_many(np.zeros((2, 0)), atoms, band)[0].tolist() == [0, 0]
