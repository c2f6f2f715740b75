"""The incremental perceptron against plain loops and finite differences; pipelines saved, loaded and tuned."""

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.sql import functions as F

from shapeloom.operators import estimators, neural, tables
from shapeloom.operators.neural import Perceptron


def test_gradient_is_that_of_finite_differences():
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((30, 4)), rng.integers(0, 3, 30)
    net = Perceptron(4, 3, hidden=5, seed=1)
    got = net.sums(x, y)
    for k in rng.choice(len(net.weights), 40, replace=False):
        up, down = (Perceptron(4, 3, hidden=5, weights=net.weights + s * 1e-6 * np.eye(len(net.weights))[k]).sums(x, y)[-2] for s in (1, -1))
        assert got[k] == pytest.approx((up - down) / 2e-6, rel=1e-4, abs=1e-5)


def batches(n=300):
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, n)
    x = rng.standard_normal((n, 6)) + 2.5 * np.eye(6)[y]
    return [(k // 100, k, x[k].tolist(), int(y[k])) for k in range(n)]


def test_learning_in_batches(spark):
    rows = batches()
    df = spark.createDataFrame([*rows, (0, 900, None, 1), (1, 901, [0.0] * 6, None)], "batch long, id long, features array<double>, target long").repartition(5)
    part = {r.id: r.p for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("p")).collect()}
    folder = tables.shared_folder(spark, "perceptron")
    scored, states = neural.learn_in_batches(df, Perceptron(6, 3, hidden=20, rate=0.02, seed=2), 3, folder)
    net, want = Perceptron(6, 3, hidden=20, rate=0.02, seed=2), {}
    for b in range(3):
        own = [r for r in rows if r[0] == b]
        x = np.array([r[2] for r in own])
        before = net.predict(x)
        for k in range(3):
            use = [r for r in own if part[r[1]] == k]
            net.step(net.sums(np.array([r[2] for r in use]), np.array([r[3] for r in use])))
        want |= {r[1]: (b, r[3], int(p), int(q)) for r, p, q in zip(own, before, net.predict(x))}
    assert {r.id: (r.batch, r.y, r.p_before, r.p_after) for r in scored.collect()} == want
    last = states.filter("batch = 2").first()
    assert np.allclose(last.weights, net.weights) and last.steps == 9 and states.count() == 3
    tables.remove(spark, f"{folder}/states/batch=2")  # as if the run had been stopped there
    again, _ = neural.learn_in_batches(df, Perceptron(6, 3, hidden=20, rate=0.02, seed=2), 3, folder)
    assert {r.id: (r.batch, r.y, r.p_before, r.p_after) for r in again.collect()} == want
    assert np.mean([v[2] == v[1] for v in want.values() if v[0] == 2]) > 0.6
    none = neural.learn_in_batches(df.filter("false"), Perceptron(6, 3), 3)
    assert none[0].count() == 0 and none[1].count() == 0


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(4)
    base = {c: rng.standard_normal(16) * 2 for c in "abc"}
    rows = [(k, c, (base[c] + 0.3 * rng.standard_normal(16)).tolist()) for k, c in enumerate("abc" * 20)]
    return spark.createDataFrame(rows, "vec_id long, label string, x array<double>").repartition(3)


@pytest.mark.parametrize("kind", ["distance", "codes"])
def test_saved_pipeline_predicts_alike(spark, series, tmp_path, kind):
    fit = estimators.shapelet_classifier("logistic", k=2, share=0.5, iterations=20, kind=kind).fit(series)
    fit.write().overwrite().save(f"file://{tmp_path}/model")
    loaded = PipelineModel.load(f"file://{tmp_path}/model")
    got, want = ({r.vec_id: (r.label, r.prediction, tuple(r.vector)) for r in m.transform(series).collect()} for m in (loaded, fit))
    assert got == want and len(got) == 60 and np.mean([{"a": 0, "b": 1, "c": 2}[v[0]] == v[1] for v in got.values()]) > 0.9
    assert loaded.stages[0].bank == fit.stages[0].bank and loaded.stages[0].getOrDefault("kind") == kind
    odd = spark.createDataFrame([(1, "a", None), (2, "b", [1.0])], series.schema)
    assert loaded.stages[0].transform(odd).count() == 2 and loaded.stages[0].transform(odd.filter("false")).count() == 0
    estimators.ShapeletDictionary(k=3).write().overwrite().save(f"file://{tmp_path}/estimator")
    assert estimators.ShapeletDictionary.load(f"file://{tmp_path}/estimator").getOrDefault("k") == 3


def test_cross_validation_over_the_grid(series):
    pipeline = estimators.shapelet_classifier("logistic", iterations=5)
    fit, found = estimators.cross_validated(pipeline, series, [1, 2], [0.25], [0.1], folds=2)
    rows = {(r.k, r.share, r.lam): r.accuracy for r in found.collect()}
    assert set(rows) == {(1, 0.25, 0.1), (2, 0.25, 0.1)} and all(0 <= v <= 1 for v in rows.values())
    assert fit.bestModel.stages[0].getOrDefault("k") == max(rows, key=lambda g: (rows[g], -g[0]))[0]


@pytest.mark.parametrize("lot, jobs", [(1 << 16, 12), (250, 36), (50, None)])
def test_lots_of_batches(spark, lot, jobs):
    """Few jobs however many batches there are; lots, and batches that are larger than one, learn the same."""
    rows = [(k // 60, k, x, y) for _, k, x, y in batches(600)]
    df = spark.createDataFrame(rows, "batch long, id long, features array<double>, target long").repartition(5).cache()
    df.count()
    start = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    scored, states = neural.learn_in_batches(df, Perceptron(6, 3, hidden=20, rate=0.02, seed=2), 3, lot=lot)
    done = len(spark.sparkContext.statusTracker().getJobIdsForGroup(None)) - len(start)
    assert jobs is None or done <= jobs  # 10 batches took over 50 jobs
    net, part = Perceptron(6, 3, hidden=20, rate=0.02, seed=2), {r.id: r.p for r in df.select("id", F.pmod(F.xxhash64("id"), F.lit(3)).alias("p")).collect()}
    want = {}
    for b in range(10):
        own = [r for r in rows if r[0] == b]
        x, y, k = np.array([r[2] for r in own]), np.array([r[3] for r in own]), np.array([part[r[1]] for r in own])
        before = net.predict(x)
        for j in range(3):
            net.step(net.sums(x[k == j], y[k == j]))
        want |= {r[1]: (b, r[3], int(p), int(q)) for r, p, q in zip(own, before, net.predict(x))}
    assert {r.id: (r.batch, r.y, r.p_before, r.p_after) for r in scored.collect()} == want
    assert states.count() == 10 and np.allclose(states.filter("batch = 9").first().weights, net.weights)
