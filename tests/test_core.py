"""Golden vectors, properties, and parity of the catalog with DuckDB."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from shapeloom.functions import arrays as A
from shapeloom.functions.dtw import dtw
from shapeloom.operators import drift, evaluation, learning, ranking, series
from shapeloom.plans import catalog
from shapeloom.sources import files

SF = "/root/testdata/sf0.001"


def arr(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_golden_arrays(spark):
    one = spark.range(1)
    r = one.select(A.place(arr(4, 5, 6), F.lit(2), 6), A.euclidean(arr(1, 2, 3), arr(4, 5, 6)), A.min_distance(arr(1, 2, 3, 4, 9), arr(3, 4)), A.znorm(arr(5, 5, 5)), A.min_distance(arr(1), arr(1, 2)), A.soft_threshold(F.lit(-3.0), F.lit(1.0), F.lit(2.0)), A.nonneg_threshold(F.lit(-3.0), F.lit(1.0), F.lit(2.0))).first()
    assert r[0] == [0, 0, 4, 5, 6, 0] and r[1] == pytest.approx(5.196152422706632) and r[2] == 0 and r[3] == [0, 0, 0] and r[4] == math.inf and r[5] == -1.0 and r[6] == 0
    with pytest.raises(Exception, match="does not fit"):
        one.select(A.place(arr(4, 5, 6), F.lit(5), 6)).collect()
    with pytest.raises(Exception, match="differ in length"):
        one.select(A.euclidean(arr(1), arr(1, 2))).collect()


def test_dtw_against_plain_table():
    assert dtw([1, 2, 3], [2, 3, 4]) == pytest.approx(math.sqrt(2))
    rng = np.random.default_rng(0)
    for _ in range(20):
        a, b = rng.standard_normal(rng.integers(1, 9)), rng.standard_normal(rng.integers(1, 9))
        reach = max(int(max(len(a), len(b)) * 0.5), abs(len(a) - len(b)))
        t = np.full((len(a) + 1, len(b) + 1), np.inf)
        t[0, 0] = 0
        for i in range(1, len(a) + 1):
            for j in range(max(1, i - reach), min(len(b), i + reach) + 1):
                t[i, j] = (a[i - 1] - b[j - 1]) ** 2 + min(t[i - 1, j], t[i, j - 1], t[i - 1, j - 1])
        assert dtw(a, b, 0.5) == pytest.approx(math.sqrt(t[-1, -1]))
    assert dtw([0, 0, 9], [5, 5, 5], most=1.0) == math.inf


def test_windows_and_splits(spark):
    rows = spark.createDataFrame([(k, "a", float(k)) for k in range(10)], "seq long, label string, value double")
    assert sorted(r.start for r in series.sliding_windows(rows, 4, 2).collect()) == [0, 2, 4]
    assert series.half_split(rows.filter("seq < 5")).filter("is_train").count() == 2
    w = series.random_windows(rows, 4, 7, seed=1).collect()
    assert len(w) == 7 and all(len(r.x) == 4 and r.x[0] == r.start for r in w)
    b = series.bootstrapped_windows(rows, 4, 2, 9, seed=1).collect()
    assert len(b) == 9 and all(len(r.x) == 4 and r.start < 6 for r in b)
    assert series.bootstrapped_windows(rows, 10, 2, 9).count() == 0
    with pytest.raises(ValueError):
        series.compile_windows(rows, "other")
    totals = {}
    for _, c, a, z in series.class_schedule(["w", "j", "d", "u"]):
        totals[c] = totals.get(c, 0) + z - a
    assert list(totals.values()) == [1525, 1525, 775, 375]


def test_statistics(spark):
    d = spark.createDataFrame([("k", "a", 1.0), ("k", "a", 3.0), ("k", "b", 5.0), ("k", "b", 7.0)], "k string, label string, dist double")
    assert ranking.f_statistic(d, ["k"]).first().f_statistic == pytest.approx(4)
    assert ranking.f_statistic(d.filter("label = 'a'"), ["k"]).first().f_statistic is None
    x = spark.createDataFrame([([1.0, 2.0],), ([0.0, 1.0],)], "x array<double>")
    assert drift.mmd_rbf(x, x).first().mmd2 == pytest.approx(0)
    p = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "id long, y string, p string")
    r = evaluation.scores(p).first()
    assert (r.accuracy, r.kappa) == (1, 1)
    assert evaluation.scores(p.filter("y = 'a'")).first().kappa is None


def test_seed_scores_as_published(spark):
    rows = spark.createDataFrame([("ETTh", 0.807, 0.780, 0.768, 0.795, 0.835)], "dataset string, s1 double, s2 double, s3 double, s4 double, s5 double")
    r = evaluation.seed_mean_std(rows, "dataset", ["s1", "s2", "s3", "s4", "s5"]).first()
    assert (round(r.mean, 4), round(r.std, 4)) == (0.7970, 0.0259)


def test_decoded_labels_and_shuffles(spark):
    rows = spark.createDataFrame([(k, bytearray(f"é{k % 3}".encode()) if k else None) for k in range(9)], "id long, label binary")
    assert [r.label for r in files.decode_labels(rows, "label").orderBy("id").collect()] == [None, *[f"é{k % 3}" for k in range(1, 9)]]
    a, b = ([r.id for r in series.shuffled(rows, seed, "id").collect()] for seed in (1, 2))
    assert a == [r.id for r in series.shuffled(rows.repartition(5), 1, "id").collect()] and sorted(a) == sorted(b) == list(range(9)) and a != b


def test_labelwise_pairs(spark):
    rng = np.random.default_rng(1)
    make = lambda n: spark.createDataFrame([("a", k, rng.standard_normal(4).tolist()) for k in range(n)], "label string, shapelet_id long, s array<double>")
    assert ranking.policy_labelwise(make(5), make(5)).count() == 6


def test_learner_lowers_the_objective():
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 24))
    f = learning.learn(x, 3, 8, most=10)
    assert f.trace[-1] < f.trace[0] and (np.linalg.norm(f.s, axis=1) ** 2 <= 100 + 1e-6).all()
    assert learning.objective(x, f.s, f.a, f.off, 0.1) == pytest.approx(f.trace[-1])


def test_sources(spark, tmp_path):
    (tmp_path / "a.arff").write_text("@relation r\n@attribute f numeric\n@attribute class {u,v}\n\n@data\n1.5,u\n2.5,v\n")
    df = files.read_arff(spark, str(tmp_path / "a.arff"))
    assert sorted(map(tuple, df.collect())) == [(1.5, "u"), (2.5, "v")]
    files.write_arff(df, str(tmp_path / "b"), "r")
    assert sorted(map(tuple, files.read_arff(spark, str(tmp_path / "b")).collect())) == [(1.5, "u"), (2.5, "v")]
    (tmp_path / "u.tsv").write_text("1\t1\t2\t3\n2\t5\t5\t5\n")
    u = {r.label: r.x for r in files.read_ucr(spark, str(tmp_path / "u.tsv"), 3).collect()}
    assert u["2"] == [0, 0, 0] and sum(u["1"]) == pytest.approx(0)
    m = spark.createDataFrame([([1.0, 2.5],)], "x array<double>")
    files.write_matrix(m, str(tmp_path / "m"))
    assert files.read_matrix(spark, str(tmp_path / "m")).first().x == [1.0, 2.5]


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.fixture(scope="session")
def duck():
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f[:-8]} AS SELECT * FROM '{SF}/{f}'")
    return con


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 5) + 0.0
    return tuple(map(plain, v)) if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", ["shapelet_distance", "sliding_windows", "tumbling_batches", "class_schedule", "f_statistic", "policy_closest", "policy_coef_merge", "accuracy_kappa", "prequential_cumulative", "ks_two_sample", "dictionary_step", "re_threshold_drift", "drift_point_stats"])
def test_parity(spark, duck, name):
    df = catalog.QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    rel = duck.sql(catalog.SQL[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    assert sorted((tuple(plain(r[c]) for c in cols) for r in df.collect()), key=repr) == sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=repr)
