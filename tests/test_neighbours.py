"""The pivot join against all pairs."""

import numpy as np
import pytest

from shapeloom.operators import neighbours


def frame(spark, x, first=0):
    return spark.createDataFrame([(first + k, None if v is None else [float(e) for e in v]) for k, v in enumerate(x)], "id long, x array<double>").repartition(4)


def plain(a, b, k, first=0):
    out = {}
    for i, u in enumerate(a):
        d = sorted((round(float(np.sqrt(((np.array(u) - np.array(v)) ** 2).sum())), 9), first + j) for j, v in enumerate(b))
        out[i] = d[:k]
    return out


def result(df):
    out = {}
    for r in sorted(df.collect(), key=lambda r: (r.id, r.rank)):
        out.setdefault(r.id, []).append((pytest.approx(r.dist, abs=2e-9), r.other))
    return out


@pytest.mark.parametrize("k, pivots, block", [(1, 512, 1024), (4, 512, 7), (3, 1, 50)])
def test_equal_to_all_pairs(spark, k, pivots, block):
    rng = np.random.default_rng(k)
    centres = rng.random((9, 3)) * 50
    make = lambda n: np.round(centres[rng.integers(0, 9, n)] + rng.standard_normal((n, 3)), 1)  # noqa: E731  rounded: there are ties
    a, b = make(150), np.concatenate([make(200), np.full((40, 3), 7.0)])
    a[:20] = b[200]  # one place holds a part of both sides
    got, plan = neighbours.knn_join(frame(spark, a), frame(spark, b, 1000), k, pivots=pivots, block=block)
    assert result(got) == plain(a, b, k, 1000) and 0 < plan.share <= 1
    assert pivots > 1 or plan.share == 1


def test_share_falls_with_the_number_of_points(spark):
    rng = np.random.default_rng(0)
    shares = []
    for n in (100, 1600):
        x = rng.random((n, 2))
        shares.append(neighbours.knn_join(frame(spark, x[: n // 2]), frame(spark, x[n // 2 :]), 3)[1].share)
    assert shares[1] < 0.5 * shares[0]


def test_edges(spark):
    a = frame(spark, [[0, 0], None, [1, float("nan")], [5, 5]])
    b = frame(spark, [[0, 1], None, [4, 4]], 10)
    assert result(neighbours.knn_join(a, b, 5)[0]) == {0: [(1.0, 10), (pytest.approx(32**0.5, abs=1e-8), 12)], 3: [(pytest.approx(2**0.5, abs=1e-8), 12), (pytest.approx(41**0.5, abs=1e-8), 10)]}
    assert neighbours.knn_join(a, b.filter("false"), 2)[0].count() == 0 and neighbours.knn_join(a.filter("false"), b, 2)[0].count() == 0
    same = frame(spark, [[2, 2]] * 30)
    assert {r.other for r in neighbours.knn_join(same, same, 2, block=4)[0].collect()} == {0, 1}


@pytest.mark.parametrize("scale", [1e-7, 1.0, 1e6, 1e200])
def test_best_pairs_are_those_of_all_distances(scale):
    rng = np.random.default_rng(9)
    v = rng.standard_normal((300, 12))
    v[50:120], v[200] = v[0], v[1] + 1e-13
    u = np.concatenate([v[::7], rng.standard_normal((20, 12))])
    u, v, order = u * scale, v * scale, rng.permutation(300)
    with np.errstate(all="ignore"):
        d = np.sqrt(neighbours.squared(u, v)).round(neighbours.DIGITS)
    want = [(r, int(c), d[r, c]) for r in range(len(u)) for c in order[np.argsort(d[r, order], kind="stable")[:5]]]
    assert list(zip(*(x.tolist() for x in neighbours.best_pairs(u, v, order, 5)))) == want
    assert len(neighbours.best_pairs(u, v[:2], np.arange(2), 5)[0]) == 2 * len(u)
