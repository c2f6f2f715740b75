"""Dictionaries learned in one task and in passes, and what is built on them; the adaptive window; small sources and sinks."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import codes, drift, estimators, learning, models, policies, series
from shapeloom.plans import catalog
from shapeloom.sources import files, generators

SF = "/root/testdata/sf0.001"


def _series(spark, n=30, p=16, labels="ab"):
    rng = np.random.default_rng(4)
    rows = [(k, labels[k % len(labels)], (rng.standard_normal(p) + 3 * np.sin(np.arange(p) * (1 + k % len(labels)))).tolist()) for k in range(n)]
    return spark.createDataFrame(rows, "vec_id long, label string, x array<double>")


@pytest.mark.parametrize("from_zero", [False, True])
def test_sums_stand_for_series(from_zero):
    rng = np.random.default_rng(1)
    x, s, a, off = rng.standard_normal((40, 24)), rng.standard_normal((4, 7)), rng.standard_normal((40, 4)), rng.integers(0, 18, (40, 4))
    a[rng.random((40, 4)) < 0.3] = 0
    a[:, 2] = 0  # an atom that no series uses
    sums = learning.lagged_sums(x[:13], a[:13], off[:13], 7) + learning.lagged_sums(x[13:], a[13:], off[13:], 7)
    got = learning.update_by_sums(s, sums, 100.0, 5, from_zero)
    assert np.allclose(got, learning.update(x, s, a, off, 100.0, 5, from_zero)) and (got[2] == s[2]).all()
    assert learning.objective_by_sums(got, sums, 0.1) == pytest.approx(learning.objective(x, got, a, off, 0.1))


@pytest.mark.parametrize("how", [{}, {"signed": True, "init": "gauss"}, {"init": "svd", "from_zero": True}])
def test_passes_equal_one_task(spark, how):
    rows = _series(spark).withColumn("label", F.when(F.col("vec_id") % 5 > 0, F.col("label")))  # null labels are one label
    fits = []
    for df, values in ((rows, learning.GROUP_VALUES), (rows.repartition(5, "vec_id"), 0), (rows.union(rows.limit(1).withColumn("x", F.lit(None).cast("array<double>"))), 200)):
        got = learning.learn_dictionaries(df, k=3, share=0.3, most=4, seed=2, group_values=values, **how).collect()
        fits.append({(r.label, r.shapelet_id): r for r in got})
    assert len(fits[0]) == 9 and {r.iterations for r in fits[0].values()} == {4}
    for other in fits[1:]:
        assert set(other) == set(fits[0])
        for key, r in fits[0].items():
            assert np.allclose(r.s, other[key].s) and r.objective == pytest.approx(other[key].objective)


def test_each_label_has_a_task(spark):
    """Longest-first in tasks of their own; by hash over four partitions, and those put together, all six shared one."""
    rows = _series(spark, 42, labels="abcdef").withColumn("label", F.when(F.col("label") != "f", F.col("label")))
    got = learning.learn_dictionaries(rows, k=2, share=0.3, most=2).select("label", F.spark_partition_id().alias("task")).distinct().collect()
    assert {r.label for r in got} == {*"abcde", None} and len(got) == len({r.task for r in got}) == 6


def test_more_labels_than_tasks(spark, monkeypatch):
    rows = _series(spark, 42, labels="abcdef")
    want = {(r.label, r.shapelet_id): r.s for r in learning.learn_dictionaries(rows, k=2, share=0.3, most=2).collect()}
    monkeypatch.setattr(learning, "TASKS", 2)
    got = learning.learn_dictionaries(rows, k=2, share=0.3, most=2).collect()
    assert len(got) == len(want) == 12 and all(np.allclose(r.s, want[r.label, r.shapelet_id]) for r in got)


def test_blocks_hold_every_series_of_rows_in_one_part(spark):
    """Passes ran in as many tasks as the rows had parts: one for one file."""
    rows = _series(spark, 300).withColumn("label", F.when(F.col("label") == "a", "a")).coalesce(1)
    blocks = learning._blocks(learning._drawn(rows, 2, 0.3, False, 0), {"a": 7, None: 3}).collect()
    assert sum(r.label == "a" for r in blocks) == 7 and sum(r.label is None for r in blocks) == 3
    for label in ("a", None):
        own = [r for r in blocks if r.label == label]
        x = np.concatenate([np.frombuffer(r.x).reshape(r.n, -1) for r in own])
        assert sorted(x.tolist()) == sorted(r.x for r in rows.collect() if r.label == label)
        assert all(len(np.frombuffer(r.a)) == len(np.frombuffer(r.off, np.int64)) == 2 * r.n for r in own)


def test_held_out_predicts_as_the_pipeline(spark):
    rows = _series(spark, 120).withColumn("is_test", F.col("vec_id") % 3 == 0).cache()
    pipeline = estimators.shapelet_classifier("logistic", k=2, share=0.5, iterations=5)
    got = {r.vec_id: r.prediction for r in estimators.held_out(pipeline, rows).collect()}
    want = pipeline.fit(rows.filter("not is_test")).transform(rows.filter("is_test")).collect()
    assert len(got) == 40 and got == {r.vec_id: r.prediction for r in want}


def test_learner_stops_and_pools(spark):
    rows = _series(spark)
    few = learning.learn_dictionaries(rows, k=2, share=0.3, eps=0.05).agg(F.max("iterations")).first()[0]
    assert 2 <= few < 50
    one = learning.learn_dictionaries(rows, k=4, share=0.3, most=2, pooled=True).collect()
    assert [r.label for r in one] == [None] * 4
    first = [learning.learn_dictionaries(rows, k=2, most=m).agg(F.sum(F.col("objective"))).first()[0] for m in (1, 6)]
    assert first[1] < first[0]
    for values in (0, 1 << 22):
        assert learning.learn_dictionaries(rows.limit(0), k=2, group_values=values).count() == 0


def test_reconstruction_by_atom():
    rng = np.random.default_rng(3)
    s, a, off = rng.standard_normal((3, 5)), rng.standard_normal((6, 3)), rng.integers(0, 8, (6, 3))
    by_atom = np.zeros((6, 12))
    for i in range(6):
        for k in range(3):
            by_atom[i, off[i, k] : off[i, k] + 5] += a[i, k] * s[k]
    assert np.allclose(by_atom, learning.rebuild(s, a, off, 12))


def _plain_window(values, delta):
    """The window of single values: after each value, drop the oldest while any split shows a change."""
    w, out = [], []
    for v in values:
        w.append(v)
        hit = False
        while True:
            n, mean = len(w), sum(w) / len(w)
            var, log, cut = max(sum(u * u for u in w) / n - mean * mean, 0.0), math.log(2 * math.log(max(n, 3.0)) / delta), False
            for k in range(1, n):
                m = 1 / (1 / k + 1 / (n - k))
                cut |= abs(sum(w[:k]) / k - sum(w[k:]) / (n - k)) > math.sqrt(2 / m * var * log) + 2 / (3 * m) * log
            if not cut:
                break
            hit, w = True, w[1:]
        out.append((hit, len(w)))
    return out


def test_adaptive_window_against_plain_python():
    rng = random.Random(6)
    values = [rng.random() for _ in range(60)] + [5 + rng.random() for _ in range(40)]
    w = drift.AdaptiveWindow(0.01, most=10**6)
    got = [(w.update(v), w.width) for v in values]
    assert got == _plain_window(values, 0.01) and any(h for h, _ in got[60:]) and not any(h for h, _ in got[:60])


def test_adaptive_window_in_buckets(spark):
    rng = random.Random(7)
    values = [rng.random() for _ in range(600)] + [2 + rng.random() for _ in range(300)]
    w = drift.AdaptiveWindow()
    hits = [k for k, v in enumerate(values) if w.update(v)]
    assert hits and min(hits) >= 600 and w.width < 400 and w.mean == pytest.approx(2.5, abs=0.15) and sum(map(len, w.rows)) < 80
    errors = spark.createDataFrame([(k, float(v)) for k, v in enumerate(values)], "batch_num long, error double").repartition(3)
    rows = drift.adaptive_drift(errors).orderBy("batch_num").collect()
    assert [r.batch_num for r in rows if r.drift_detected] == hits and rows[-1].width == w.width
    assert drift.adaptive_drift(errors.limit(0)).count() == 0


def test_windowed_concepts(spark):
    f1 = {r.time: r.f1 for r in generators.sea_stream(spark, 200, 3).collect()}
    rows = generators.sea_windows(spark, 200, 7, 3).orderBy("time").collect()
    assert len(rows) == 200 and all(len(r.x) == 7 for r in rows)
    assert all(r.x == [f1[t] for t in range(r.time - 6, r.time + 1)] for r in rows if r.time >= 6)
    assert [r.time for r, q in zip(rows[1:], rows) if r.concept != q.concept] == [50, 100, 150] and {r.concept for r in rows} == {0, 1, 2}
    theta = generators.SEA_THETA
    assert all(r["class"] == int(r.f1 + r.f2 <= theta[r.concept]) for r in generators.sea_stream(spark, 200, 3).collect())


def test_autoregression(spark):
    params, points = [[0.6, 0.2], [-0.4, 0.3]], [150]
    for width in (0, 60):
        y, regime = generators.ar_values(300, params, points, width, noise=0.0, seed=3)
        for t in range(2, 300):
            share = float(t >= 150) if not width else min(max((t - 120) / 60, 0), 1)
            coef = [(1 - share) * p + share * q for p, q in zip(*params)]
            assert regime[t] == pytest.approx(share) and y[t] == pytest.approx(coef[0] * y[t - 1] + coef[1] * y[t - 2])
    rows = generators.windowed_ar(spark, 300, params, points, 20, width=60).collect()
    value = generators.ar_values(300, params, points, 60)[0]
    assert len(rows) == 281 and all(r["class"] == int(r.time >= 150 + 60 + 20) and np.allclose(r.x, value[r.time - 19 : r.time + 1]) for r in rows)


def test_pipeline_and_grid(spark):
    rows = _series(spark, 60).cache()
    train, test = rows.filter("vec_id % 3 > 0"), rows.filter("vec_id % 3 = 0")
    scores = {(r.k, r.share): r.accuracy for r in models.grid_scores(train, test, [(1, 0.25, 0.1), (2, 0.5, 0.1)], most=3).collect()}
    assert set(scores) == {(1, 0.25), (2, 0.5)} and all(0.5 < v <= 1 for v in scores.values())


def test_scaled_classifier_over_batches():
    rng = np.random.default_rng(8)
    x = rng.standard_normal((90, 3)) * [1, 50, 0.01]
    y = np.where(x[:, 1] > 0, "u", "v")
    m = models.LinearSgd(["u", "v"], scale=True)
    for at in range(0, 90, 30):
        m.partial_fit(x[at : at + 30], y[at : at + 30])
    assert np.allclose(m.scaler.mean, x.mean(axis=0)) and np.allclose(m.scaler.m2 / 90, x.var(axis=0))
    assert (m.predict(x) == y).mean() > 0.95 and np.allclose(m.predict_proba(x).sum(axis=1), 1)


def test_sinks_and_slices(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", 2.0)], "`a.b` int, s string, v double")
    assert files.columns_between(df, 0, -1).columns == ["a.b", "s"]
    files.write_run(spark, {"K": 3, "trace": [1.5, 1.0]}, str(tmp_path / "run"))
    assert files.read_run(spark, str(tmp_path / "run")) == {"K": 3, "trace": [1.5, 1.0]}
    path, schema = str(tmp_path / "results"), "name string, score double"
    for n in (0, 1, 2):
        assert files.open_results(spark, path, schema).count() == n
        files.append_results(spark.createDataFrame([("r", 0.5)], schema), path)
    for k in (3, 11):
        files.write_csv(spark.createDataFrame([(k, "x")], "value int, label string"), str(tmp_path / f"c{k:02d}"))
        next((tmp_path / f"c{k:02d}").glob("*.csv")).rename(tmp_path / f"subject{k:02d}.csv")
    got = files.read_subjects(spark, str(tmp_path / "subject{id}.csv"), [3, 11], "value int, label string").collect()
    assert sorted((r.value, r.subject) for r in got) == [(3, 3), (11, 11)]
    (tmp_path / "bad.csv").write_text("value,label\nno number,x\n")
    with pytest.raises(Exception, match="MALFORMED|Malformed|malformed"):
        files.read_csv(spark, str(tmp_path / "bad.csv"), "value int, label string").collect()
    x = spark.createDataFrame([("i", [1.0, 2.0])], "id string, x array<double>")
    assert [tuple(r) for r in files.plot_rows(x).collect()] == [("i", 0, 1.0), ("i", 1, 2.0)]
    assert files.class_count(df.select(F.lit("u").alias("label")), df.select(F.lit("v").alias("label"))).first()[0] == 2


@pytest.mark.parametrize("signed", [True, False])
def test_one_step_codes_against_plain_python(spark, signed):
    rows = _series(spark, 12).withColumn("x", F.when(F.col("vec_id") == 3, F.array(F.lit(1.0))).when(F.col("vec_id") != 4, F.col("x")))
    atoms = [(k, str(k), 0, [math.cos(k + t) for t in range(3 + k)]) for k in range(3)]  # of 3, 4 and 5 values
    d = spark.createDataFrame(atoms, "pos long, label string, shapelet_id long, s array<double>")
    got = {(r.series_id, r.k): r for r in codes.one_step_codes(rows, d, 0.5, signed).collect()}
    terms = {r.series_id: r for r in codes.one_step_terms(rows, d, 0.5, signed).collect()}
    joined = {r.series_id: r for r in codes.residual_terms(rows.filter("x is not null"), codes.one_step_codes(rows, d, 0.5, signed), d).collect()}
    dist = {(r.vec_id, r.pos): (r.dist, r.shapelet_label) for r in series.shapelet_features(rows, d).collect()}
    assert len(got) == len(dist) == 36 and len(terms) == 12 and set(joined) == set(terms) - {4}
    for r in rows.collect():
        x = r.x or []
        recon, l1 = [0.0] * len(x), 0.0
        for k, name, _, s in atoms:
            places = range(len(x) - len(s) + 1)
            c = [sum(x[o + i] * s[i] for i in range(len(s))) for o in places]
            far = [math.dist(x[o : o + len(s)], s) for o in places]
            assert dist[r.vec_id, k] == (pytest.approx(min(far, default=math.inf)), name)
            a, o = 0.0, 0
            if c:
                at = max(places, key=lambda o: (abs(c[o]), -o))
                size = abs(c[at]) if signed else c[at]
                if size > 0.5:
                    a, o = math.copysign((size - 0.5) / sum(v * v for v in s), c[at]), at
            assert got[r.vec_id, k].a == pytest.approx(a) and got[r.vec_id, k].off == o
            for i in range(len(s) if c else 0):
                recon[o + i] += a * s[i]
            l1 += abs(a)
        assert terms[r.vec_id].recon == pytest.approx(recon) and terms[r.vec_id].l1 == pytest.approx(l1)
        if r.vec_id in joined:
            assert joined[r.vec_id].recon == pytest.approx(recon) and joined[r.vec_id].l1 == pytest.approx(l1)
    assert series.shapelet_features(rows, d.limit(0)).count() == codes.one_step_codes(rows, d.limit(0)).count() == 0


def _warped(a, b, reach):
    t = [[math.inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    t[0][0] = 0.0
    for i, u in enumerate(a, 1):
        for j, v in enumerate(b, 1):
            if abs(i - j) <= reach:
                t[i][j] = (u - v) ** 2 + min(t[i - 1][j], t[i][j - 1], t[i - 1][j - 1])
    return math.sqrt(t[-1][-1])


def test_dtw_query_against_plain_table(spark):
    x = {r.vec_id: r.x for r in series.series(spark, SF).collect()}
    s = {r.pos: r.s for r in catalog.dictionary(spark, SF).collect()}
    rows = catalog.QUERIES["dtw_transform"](spark, SF).collect()
    assert len(rows) == len(x) * len(s)
    for r in rows:
        a, b = x[r.vec_id], s[r.pos]
        assert r.dist == pytest.approx(_warped(a, b, max(int(max(len(a), len(b)) * 0.9), abs(len(a) - len(b)))), abs=2e-6)


def test_labelwise_query_against_arrays(spark):
    old, new = (d.orderBy("pos").collect() for d in catalog._pair(spark, SF))
    picked = policies.labelwise(*[v for d in (old, new) for v in ([r.label for r in d], np.array([r.s for r in d]))])
    want = [((old, new)[side][k].label, ("old", "new")[side], (old, new)[side][k].shapelet_id) for side, k in picked]
    got = catalog.QUERIES["policy_labelwise"](spark, SF).orderBy("label", "place").collect()
    assert [(r.label, r.origin, r.shapelet_id) for r in got] == want
