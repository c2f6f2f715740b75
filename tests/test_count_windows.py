"""Count windows on streams against plain lists, over restarts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.streaming import count_windows as W
from shapeloom.streaming import feed
from shapeloom.streaming.prequential import Loop

SCHEMA = "seq long, k string, v double, name string"


@pytest.fixture(scope="module")
def parts():
    rng = random.Random(3)
    rows = [(s, rng.choice(["a", "a", "a", "b", None]), None if rng.random() < 0.05 else rng.random() * (3 if s > 300 else 1), f"é{s}" if s % 7 else None) for s in range(500)]
    cuts = [0, 3, 180, 181, 460, 500]
    return [rows[a:z] for a, z in zip(cuts, cuts[1:])]


def run(spark, parts, make, schema, name):
    """Each part arrives on its own and is read by a query that starts anew on the same checkpoint."""
    folder = feed.new_folder(spark, "windows")
    for p in parts:
        df = spark.createDataFrame(random.Random(1).sample(p, len(p)), schema)
        df.coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        feed.run_to_end(make(feed.stream_of(spark, folder, df.schema)), folder, name)
    return spark.read.parquet(f"{folder}/{name}").collect()


def by_key(parts):
    rows = [r for p in parts for r in p]
    return {k: [r for r in rows if r[1] == k] for k in ("a", "b", None)}


def test_windows_over_restarts(spark, parts):
    got = run(spark, parts, lambda s: W.count_windows(s, "k", "seq", 16, ["v", "name"]), SCHEMA, "out")
    want = [(k, n // 16 + 1, r[0], r[2], r[3]) for k, rows in by_key(parts).items() for n, r in enumerate(rows[: len(rows) // 16 * 16])]
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))


def test_threshold_over_restarts(spark, parts):
    got = {(r.k, r.batch_num): (r.rows, r.error, r.drift_detected) for r in run(spark, parts, lambda s: W.threshold_windows(s, "k", "seq", 16, "v"), SCHEMA, "out")}
    want = {}
    for k, rows in by_key(parts).items():
        ref = None
        for n in range(len(rows) // 16):
            e = np.mean([r[2] for r in rows[n * 16 : n * 16 + 16] if r[2] is not None])
            hit = ref is not None and e > 1.3 * ref
            ref = e if ref is None or hit else ref
            want[k, n + 1] = (16, pytest.approx(e), hit)
    assert got == want and any(v[2] for v in got.values())


def test_keyed_loops(spark):
    rng = np.random.default_rng(5)
    rows = [(s, "u" if s % 3 else "w", rng.standard_normal(12).tolist(), "xy"[int(rng.integers(2))]) for s in range(150)]
    loop = Loop(classes=["x", "y"], atoms=2, share=0.25, mode="scheduled", iterations=20)
    got = run(spark, [rows[:70], rows[70:]], lambda s: W.keyed_loops(s, "k", loop, 20), "seq long, k string, x array<double>, label string", "out")
    want = []
    for k in "uw":
        own, one = [r for r in rows if r[1] == k], Loop(classes=["x", "y"], atoms=2, share=0.25, mode="scheduled", iterations=20)
        for n in range(len(own) // 20):
            part = own[n * 20 : n * 20 + 20]
            if r := one.step(np.array([v[2] for v in part]), np.array([v[3] for v in part])):
                want.append((k, *r))
    assert sorted((r.k, r.batch, r.accuracy, r.drift_detected) for r in got) == sorted((w[0], w[1], w[2], w[6]) for w in want)


def test_threshold_query_takes_few_micro_batches(spark, monkeypatch):
    """100,000 rows were seven files, each a micro-batch over all state partitions."""
    from shapeloom.plans import catalog
    from shapeloom.streaming import feed

    made, plain = [], feed.lay_out
    monkeypatch.setattr(feed, "lay_out", lambda *a: made.extend(plain(*a)))
    assert catalog.QUERIES["stream_threshold_windows"](spark, "/root/testdata/sf0.1").count() > 390 and made == [0]


@pytest.mark.parametrize("policy", ["coefficients", "top_ranked", "closest"])
def test_loops_over_prepared_windows(spark, policy):
    """What is learned from windows beforehand, over all tasks, gives what the loop by itself learns one window after the other."""
    rng = np.random.default_rng(5)
    rows = [(s, "u" if s % 3 else None, rng.standard_normal(12).tolist() if s != 7 else None, "xy"[int(rng.integers(2))]) for s in range(250)]
    loop = Loop(classes=["x", "y"], atoms=2, share=0.25, mode="scheduled", policy=policy, iterations=20)
    df = spark.createDataFrame(rows, "seq long, k string, x array<double>, label string").repartition(3)
    windows, folder = W.prepared_windows(df, "k", loop, 20), feed.new_folder(spark, "prepared")
    assert windows.filter("labels is not null").count() == 6  # the odd ones, which were learned in the task of their key before
    feed.lay_out(windows.withColumn("part", F.floor(F.col("batch_num") / 2)), "part", folder)
    feed.run_to_end(W.loops_over_windows(feed.stream_of(spark, folder, windows.schema), "k", loop), folder, "out")
    want = []
    for k in ("u", None):
        own, one = [r for r in rows if r[1] == k and r[2]], Loop(classes=["x", "y"], atoms=2, share=0.25, mode="scheduled", policy=policy, iterations=20)
        for n in range(len(own) // 20):
            part = own[n * 20 : n * 20 + 20]
            if r := one.step(np.array([v[2] for v in part]), np.array([v[3] for v in part])):
                want.append((k, *r))
    got = spark.read.parquet(f"{folder}/out").collect()
    assert sorted(map(str, ((r.k, r.batch, r.accuracy, r.drift_detected) for r in got))) == sorted(map(str, ((w[0], w[1], w[2], w[6]) for w in want)))
