"""Operators that work in buckets, chunks or blocks against plain Python, and the online loop over a restart."""

import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import drift, evaluation, policies, series
from shapeloom.operators.models import LinearSgd, RunningScaler
from shapeloom.streaming import prequential


@pytest.fixture(scope="module")
def stream(spark):
    rng = random.Random(5)
    rows = [(k, rng.choice("abc"), float(rng.randint(0, 99))) for k in range(400)] + [(400, "d", 1.0)]
    return rows, spark.createDataFrame(rows, "seq long, label string, value double").repartition(3).cache()


def _by_label(rows):
    out = {}
    for k, c, v in rows:
        out.setdefault(c, []).append((k, v))
    return out


@pytest.mark.parametrize("bucket", [7, 1 << 16])
def test_numbers_within_labels(stream, bucket):
    rows, df = stream
    got = {r.seq: (r.rn, r.n) for r in series.numbered(df, bucket=bucket).collect()}
    assert got == {k: (i, len(own)) for own in _by_label(rows).values() for i, (k, _) in enumerate(own)}


@pytest.mark.parametrize("chunk", [16, 4096])
def test_windows_from_chunks(stream, chunk, monkeypatch):
    monkeypatch.setattr(series, "CHUNK", chunk)
    monkeypatch.setattr(series.chunks, "__defaults__", (chunk,))
    rows, df = stream
    own = _by_label(rows)
    got = {(r.label, r.start): r.x for r in series.sliding_windows(df, 10, 3, 20).collect()}
    assert got == {(c, s): [v for _, v in x[s : s + 10]] for c, x in own.items() for s in range(0, max(0, len(x) - 10), 3) if s // 3 < 20}
    got = {r.seq: r.x for r in series.trailing_windows(df, 6).collect()}
    assert got == {x[k][0]: [v for _, v in x[k - 5 : k + 1]] for x in own.values() for k in range(5, len(x))}
    for r in [*series.random_windows(df, 9, 15, 2).collect(), *series.bootstrapped_windows(df, 8, 5, 30, 2).collect()]:
        assert r.x == [v for _, v in own[r.label][r.start : r.start + 8]]
    many = series.bootstrapped_windows(df, 8, 5, 30, 2).groupBy("label").count().collect()
    assert {r.label: r["count"] for r in many} == {"a": 30, "b": 30, "c": 30}


def test_running_scores_over_buckets(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice("xyz"), rng.choice("xyzw")) for k in range(120)]
    got = {r.id: (r.accuracy, r.kappa) for r in evaluation.running_scores(spark.createDataFrame(rows, "id long, y string, p string")).collect()}
    for n in range(1, 121):
        some = rows[:n]
        po = sum(y == p for _, y, p in some) / n
        pe = sum(sum(y == c for _, y, _ in some) * sum(p == c for *_, p in some) for c in "xyzw") / n**2
        assert got[n - 1][0] == pytest.approx(po)
        assert got[n - 1][1] is None if pe == 1 else got[n - 1][1] == pytest.approx((po - pe) / (1 - pe))


def test_divergence_counts_repeated_points(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(0, 1, (40, 2)).round(2), rng.normal(0.5, 1, (50, 2)).round(2)
    x, y = np.concatenate([x, x[:9], x[:4]]), np.concatenate([y, y[:7]])
    (ux, cx), (uy, cy) = (np.unique(v, axis=0, return_counts=True) for v in (x, y))
    terms = []
    for row in ux:
        near = []
        for pts, n, k in ((ux, cx, 4), (uy, cy, 3)):
            d = np.sqrt(((pts - row) ** 2).sum(axis=1))
            at = np.argsort(d, kind="stable")[:k]
            near += [n[at].sum(), d[at].max()]
        terms.append(near)
    kp, rp, kq, rq = np.array(terms, dtype=float).T
    p, q = kp / kp.sum(), kq / kq.sum()
    want = float((p * (np.log(p) - np.log(q) + 2 * (np.log(rq) - np.log(rp)))).sum())
    table = lambda v: spark.createDataFrame([(r.tolist(),) for r in v], "x array<double>").repartition(3)
    assert drift.knn_kl(table(x), table(y)).first().kl == pytest.approx(want)


def test_mean_discrepancy_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(drift._blocks, "__kwdefaults__", {"size": 8})
    rng = np.random.default_rng(4)
    x, y = rng.normal(0, 1, (30, 3)), rng.normal(0.3, 1, (20, 3))
    mean = lambda a, b: np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(axis=2)).mean()
    table = lambda v: spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(v)], "id long, x array<double>")
    assert drift.mmd_rbf(table(x), table(y), 0.5).first().mmd2 == pytest.approx(mean(x, x) + mean(y, y) - 2 * mean(x, y))


def test_threshold_moves_with_a_drift(spark):
    errors = [1.0, 1.2, 1.4, 1.5, 1.9, 1.0]
    got = drift.threshold_drift(spark.createDataFrame(list(enumerate(errors)), "batch_num long, error double")).orderBy("batch_num").collect()
    assert [r.drift_detected for r in got] == [False, False, True, False, True, False]


def test_policies_on_arrays():
    old = (["a", "a", "b", "b"], np.array([[0.0, 0], [1, 1], [2, 2], [9, 9]]))
    new = (["a", "a", "b", "c"], np.array([[0.1, 0], [8, 8], [2.5, 2], [5, 5]]))
    y, a_old, a_new = np.array(["a", "b", "a"]), np.array([[3.0, 0, 0, 1], [0, 0, 2, 1], [2, 1, 0, 0]]), np.array([[4.0, 1, 0, 0], [0, 0, 1, 0], [1, 2, 0, 0]])
    run = lambda p, n=None: policies.combine(p, old, new, a_old, a_new, y, np.random.default_rng(0), n)
    assert run("closest", 1)[1].tolist() == [*new[1].tolist(), [0, 0]] and run("dissimilar", 1)[1].tolist()[-1] == [9, 9]
    assert run("closest_set")[1].tolist() == [*new[1].tolist(), [0, 0], [9, 9], [2, 2]]
    assert run("extend")[0] == ["a", "a", "b", "b", "c"] and run("replace") is new
    assert run("top_ranked", 1)[0] == ["a", *new[0]] and len(run("random", 2)[0]) == 6
    assert run("coefficients")[1].tolist() == [[0, 0], [0.1, 0], [2, 2], [9, 9]]  # a: 5 and 5 of 5, 1, 5, 3; b: 2 and the old 1 of 2, 1, 1
    assert run("labelwise")[1].tolist() == [[0, 0], [0.1, 0], [2, 2], [2.5, 2]]
    with pytest.raises(ValueError):
        prequential.Loop(classes=["a"], policy="none")


def test_incremental_classifier():
    rng = np.random.default_rng(0)
    y = rng.choice(["a", "b", "c"], 300)
    x = np.array([{"a": [0, 0], "b": [4, 0], "c": [0, 4]}[c] for c in y]) + rng.normal(0, 0.5, (300, 2))
    m = LinearSgd("abc", scale=True, seed=1)
    for k in range(0, 300, 50):
        m.partial_fit(x[k : k + 50], y[k : k + 50])
    assert (m.predict(x) == y).mean() > 0.95 and np.allclose(m.predict_proba(x).sum(axis=1), 1)
    assert (LinearSgd("abc", seed=1).fit(x, y).fit(x, y).predict(x) == y).mean() > 0.95
    wide = LinearSgd("abc", seed=1).fit(x, y).resize(3)
    assert wide.w.shape == (3, 3) and (wide.predict(np.c_[x, np.ones(300)]) == LinearSgd("abc", seed=1).fit(x, y).predict(x)).all()
    s = RunningScaler().partial_fit(x[:100]).partial_fit(x[100:])
    assert np.allclose(s.mean, x.mean(axis=0)) and np.allclose(s.m2 / s.n, x.var(axis=0))


@pytest.mark.parametrize("policy", ["coefficients", "extend"])
def test_stopped_loop_goes_on_where_it_was(spark, tmp_path, policy):
    rng = np.random.default_rng(2)
    rows = [(k, [float(v) for v in rng.normal(0, 1, 16) + (np.arange(16) % 4 if k % 2 else 0)], "ab"[k % 2]) for k in range(130)]
    schema, source = "seq long, x array<double>, label string", str(tmp_path / "in")
    loop = lambda: prequential.Loop(classes=["a", "b"], atoms=2, share=0.25, iterations=2, mode="scheduled", policy=policy)

    def go():
        q = prequential.start(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source), loop(), 20, str(tmp_path / "out"), str(tmp_path / "check"))
        q.processAllAvailable()
        q.stop()
        q.awaitTermination(30)

    for a, z in ((0, 45), (45, 75), (75, 130)):
        spark.createDataFrame(rows[a:z], schema).coalesce(1).write.mode("append").parquet(source)
        if z != 45:
            go()
    got = sorted(tuple(r)[:6] for r in spark.read.parquet(str(tmp_path / "out")).select("batch", "accuracy", "f1_score", "precision", "kappa", "drift_detected").collect())
    batches = series.tumbling_batches(spark.createDataFrame(rows, schema), 20)
    want = sorted(tuple(r) for r in prequential.replay(batches, loop()).collect())
    assert len(got) == 5 and all(a == pytest.approx(b, nan_ok=True) for a, b in zip(got, want)) and len(want) == 5
    go()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 5


def test_holdout_is_scored_without_a_shuffle_of_its_rows(spark):
    """Every batch scores the same few rows: nothing is grouped by row and batch, which took memory with the number of batches."""
    from shapeloom.operators import evaluation as E

    rng = np.random.default_rng(6)
    rows = spark.createDataFrame([(k // 10, k, "abc"[k % 3], (rng.standard_normal(4) + k % 3).round(3).tolist()) for k in range(90)], "batch long, id long, label string, x array<double>")
    held = spark.createDataFrame([(k, "abc"[k % 3], (rng.standard_normal(4) + k % 3).round(3).tolist()) for k in range(12)] + [(12, "a", None)], "id long, y string, x array<double>")
    means = E.class_means(rows)
    got = E.nearest_mean_of_each(held, means, "before", "p")
    want = E.nearest_mean(means.select("batch").distinct().crossJoin(held), means, "before", "p")
    assert sorted(map(str, got.collect())) == sorted(map(str, want.select(*got.columns).collect())) and got.count() == 8 * 13
    grouped = lambda df: re.search(r"hashpartitioning\([^)]*\bid#", df._jdf.queryExecution().executedPlan().toString())
    assert grouped(want) and not grouped(got)


def test_scaled_values_keep_the_sign_of_zero(spark, tmp_path):
    """Beside the SQL as text: what rounds to zero from below is -0.0 there."""
    import duckdb

    from shapeloom.plans import catalog

    rows = [(k, [(k % 5 - 2.5) * 1000 if k else -1e-4, float(k)], 0) for k in range(10)]
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        want = {r[0]: str(r[1]) for r in con.execute(catalog.SQL["standard_scaler"]).fetchall()}
    got = {r.vec_id: str(r.z) for r in catalog.QUERIES["standard_scaler"](spark, str(tmp_path)).collect()}
    assert got == want and "-0.0" in want[0]
