"""Places and running sums over ranges, against plain sorts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from shapeloom.operators import ranges


@pytest.fixture(scope="module")
def values():
    rng = random.Random(5)
    v = [(float(rng.choice([7, 7, 7, rng.randrange(1000)])), k, rng.choice(["a", None, "b"])) for k in range(4000)]
    return v + [(1e300, 5000, "a"), (None, 5001, "b"), (None, 5002, None)] + v[:20]


def order(r):
    return (r[0] is not None, r[0] or 0, r[1])


def test_ranked(spark, values):
    df = spark.createDataFrame([(*v, 1) for v in values], "v double, k long, label string, _range int").repartition(5).drop("_range")
    got = sorted(ranges.ranked(df, "v", "k").collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(len(values)))
    assert [(r.v, r.k, r.label) for r in got] == sorted(values, key=order)
    assert ranges.ranked(df.filter("false"), "v").collect() == []


def test_ranges_are_even_with_a_hot_value_and_an_outlier(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, 5.0).when(F.col("id") == 1, 1e300).otherwise(F.rand(1)).alias("v"))
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        n = sorted(Counter(r._range for r in ranges.sorted_ranges(df, "v").select("_range").collect()).values())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(n) == 16 and n[-1] < 3 * n[len(n) // 2]


def test_running_sums(spark, values):
    df = spark.createDataFrame(values, "v double, k long, label string").repartition(5)
    got = sorted(ranges.running_sums(df, ["v", "k"], {"n": F.lit(1), "s": F.col("k")}, by=["label"]).collect(), key=lambda r: (order((r.v, r.k)), r.n))
    n, s = Counter(), Counter()
    want = []
    for v, k, label in sorted(values, key=order):
        n[label] += 1
        s[label] += k
        want.append((v, k, label, n[label], s[label]))
    assert sorted(map(str, (tuple(r) for r in got))) == sorted(map(str, want))
    assert ranges.running_sums(df, ["v"], {"n": F.lit(1)}).agg(F.max("n")).first()[0] == len(values)
    assert ranges.running_sums(df.filter("false"), ["v"], {"n": F.lit(1)}).count() == 0
