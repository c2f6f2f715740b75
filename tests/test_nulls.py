"""Null labels, null and short series, empty tables and ties: rows in are rows out, as docstrings say."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import drift, evaluation, learning, series

ROWS = [(k, None if k % 2 else "ab"[k % 3 % 2], float(k % 7), k % 4) for k in range(60)]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame(ROWS, "seq long, label string, value double, n2 int").repartition(3)


def by_label(k):
    return [r for r in ROWS if r[1] == k]


def test_numbers_within_labels(spark, rows):
    got = {r.seq: (r.rn, r.n) for r in series.numbered(rows, bucket=7).collect()}
    assert got == {r[0]: (k, len(by_label(c))) for c in ("a", "b", None) for k, r in enumerate(by_label(c))}
    assert series.numbered(rows.filter("false")).count() == 0


@pytest.mark.parametrize("op", [series.half_split, lambda r: series.stratified_split(r, 0.3, "seq"), series.label_encode, series.numbered, lambda r: series.label_decode(series.label_encode(r).drop("label"), r)])
def test_rows_in_are_rows_out(spark, rows, op):
    assert op(rows).count() == len(ROWS) and op(rows.filter("label is null")).count() == len(by_label(None)) and op(rows.filter("false")).count() == 0


def test_splits_and_codes_of_null_labels(spark, rows):
    train = {r.seq for r in series.half_split(rows).filter("is_train").collect()}
    assert train == {r[0] for c in ("a", "b", None) for r in by_label(c)[: len(by_label(c)) // 2]}
    tests = series.stratified_split(rows, 0.3, "seq").filter("is_test").groupBy("label").count().collect()
    assert {r.label: r["count"] for r in tests} == {c: math.ceil(0.3 * len(by_label(c))) for c in ("a", "b", None)}
    coded = series.label_encode(rows)
    assert {(r.label, r.code) for r in coded.collect()} == {("a", 0), ("b", 1), (None, None)}
    back = series.label_decode(coded.withColumnRenamed("label", "was"), rows)
    assert back.filter(~F.col("was").eqNullSafe(F.col("label"))).count() == 0


def test_windows_of_null_labels(spark, rows):
    want = {(c, s): [r[2] for r in by_label(c)[s : s + 4]] for c in ("a", "b", None) for s in range(0, len(by_label(c)) - 4, 3)}
    assert {(r.label, r.start): r.x for r in series.sliding_windows(rows, 4, 3).collect()} == want
    trailing = series.trailing_windows(rows, 4)
    assert trailing.count() == sum(len(by_label(c)) - 3 for c in ("a", "b", None))
    assert {r.label: r["count"] for r in series.random_windows(rows, 4, 5).groupBy("label").count().collect()} == {"a": 5, "b": 5, None: 5}
    boot = series.bootstrapped_windows(rows, 4, 2, 50).collect()
    for c in ("a", "b", None):
        own = sorted((r for r in boot if r.label == c), key=lambda r: r.k)
        assert [r.k for r in own] == list(range(1, 51)) and [r.start for r in own][:3] == [0, 2, 4]
        assert all(r.x == [v[2] for v in by_label(c)[r.start : r.start + 4]] for r in own)
    z = series.train_stat_znorm(rows).collect()
    assert len(z) == sum(len(by_label(c)) - len(by_label(c)) // 2 for c in ("a", "b", None))


def test_places_with_null_times_and_ties(spark):
    e = spark.createDataFrame([(2, 1.0), (1, 1.0), (3, None), (4, 0.5)], "event_id long, t double")
    got = {r.event_id: r.seq for r in series.ranked(e, "t", "event_id").collect()}
    assert got == {3: 0, 4: 1, 1: 2, 2: 3}


def test_scaling(spark):
    r = spark.createDataFrame([([1.0, 5.0],), ([3.0, 5.0],), (None,), ([2.0],), ([2.0, 5.0, 1.0],)], "x array<double>")
    got = [v.z for v in series.standard_scaled(r, r.limit(2) if False else r.filter("x[0] <> 2 and size(x) = 2")).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [[-1.0, 0.0], [1.0, 0.0], None, [0.0], [0.0, 0.0, None]]))


def test_encode_of_any_series(spark):
    rng = np.random.default_rng(0)
    x = [rng.standard_normal(12).tolist() for _ in range(9)]
    rows = spark.createDataFrame([*[(k, "a", v) for k, v in enumerate(x)], (90, None, None), (91, "a", [1.0, 2.0]), (92, "a", []), (93, "b", rng.standard_normal(20).tolist())], "vec_id long, label string, x array<double>")
    d = spark.createDataFrame([(k, rng.standard_normal(4).tolist()) for k in range(3)], "pos long, s array<double>")
    got = {r.vec_id: r for r in learning.encode(rows, d, lam=0.1).collect()}
    assert len(got) == 13 and got[90].squared_error is None and got[91].squared_error == 5 and got[92].squared_error == 0 and got[91].a == [0, 0, 0] and got[93].squared_error > 0
    alone = {r.vec_id: r for r in learning.encode(rows.repartition(13), d, lam=0.1).collect()}
    assert all(alone[k].a == got[k].a and alone[k].off == got[k].off for k in got)  # no series depends on those beside it
    s, arr = np.array([r.s for r in d.orderBy("pos").collect()]), np.array(x)
    for k in range(9):  # another sweep changes nothing any more
        a, off = np.array([got[k].a]), np.array([got[k].off])
        f = learning.objective(arr[k : k + 1], s, a, off, 0.1)
        a, off = learning.code(arr[k : k + 1], s, a, off, 0.1, 1, -1.0, False, np.random.default_rng(5))
        assert learning.objective(arr[k : k + 1], s, a, off, 0.1) == pytest.approx(f, rel=1e-3)
    none = learning.encode(rows, d.filter("false")).collect()
    assert len(none) == 13 and all(r.a == [] for r in none) and learning.encode(rows.filter("false"), d).count() == 0


def test_running_scores_against_plain_counts(spark):
    rng = random.Random(1)
    pred = [(10 * k, rng.choice(["a", "b", None]), rng.choice(["a", "b", "c"])) for k in range(300)]
    got = {r.id: r for r in evaluation.running_scores(spark.createDataFrame(pred, "id long, y string, p string").repartition(5)).collect()}
    assert len(got) == 300
    for n in (1, 2, 7, 150, 300):
        own = pred[:n]
        po = sum(y == p for _, y, p in own) / n
        pe = sum(sum(y == c for _, y, _ in own) * sum(p == c for _, _, p in own) for c in ("a", "b", "c", None)) / n**2
        r = got[own[-1][0]]
        assert r.accuracy == pytest.approx(po) and (r.kappa == pytest.approx((po - pe) / (1 - pe)) if pe < 1 else r.kappa is None)


def test_two_samples(spark):
    """Critical values of the asymptotic distribution: 1.358 for 0.05 and 1.628 for 0.01, as published."""
    n = 20_000
    for shift, c in ((1.358, 0.05), (1.628, 0.01)):
        gap = round(shift / math.sqrt(n / 2) * n)  # so many of the second sample lie above all others
        rows = [("g", float(k), True) for k in range(n)] + [("g", float(k + (2 * n if k >= n - gap else 0)), False) for k in range(n)]
        rows = [(g, v if s or v < 2 * n else v - 3 * n, s) for g, v, s in rows] + [("g", None, True), ("g", 1.0, None), (None, 1.0, True), ("one", 1.0, True), ("one", 2.0, False)]
        got = {r.label: r for r in drift.ks_two_sample(spark.createDataFrame(rows, "label string, value double, side boolean"), "label", "value", "side").collect()}
        assert got["g"].statistic == pytest.approx(gap / n) and got["g"].p_value == pytest.approx(c, rel=0.05)
        assert got["g"].drift == (got["g"].p_value < 0.05) and got[None].statistic is None and got["one"].statistic == 1
    assert drift.ks_two_sample(spark.createDataFrame(rows, "label string, value double, side boolean").filter("false"), "label", "value", "side").count() == 0
