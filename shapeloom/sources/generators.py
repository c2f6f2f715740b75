"""Synthetic streams with drift. Recurrences run in one task per stream; several streams run side by side."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _regimes(n: int, points: list[int], width: int) -> np.ndarray:
    """Regime by time; with a width, it rises in a line over that many steps centred on each point."""
    t = np.arange(n, dtype=float)
    if width <= 0:
        return np.searchsorted(points, t, side="right").astype(float)
    return sum((np.clip((t - (p - width / 2)) / width, 0, 1) for p in points), np.zeros(n))


def ar_values(n: int, params: list[list[float]], points: list[int], width: int = 0, noise: float = 1.0, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """An AR process whose parameters change at drift points, at once or over `width` steps, in order of time throughout."""
    order, rng = len(params[0]), np.random.default_rng(seed)
    regime, table = _regimes(n, points, width), np.array(params, dtype=float)
    low = np.minimum(np.floor(regime).astype(int), len(table) - 1)
    a = (regime - low)[:, None]
    coef = (1 - a) * table[low] + a * table[np.minimum(low + 1, len(table) - 1)]
    y = np.zeros(n)
    y[:order] = rng.standard_normal(order)[:n]
    e = rng.standard_normal(n) * noise
    for t in range(order, n):
        y[t] = coef[t] @ y[t - order : t][::-1] + e[t]
    return y, regime


def ar_over(rows: DataFrame, params: list[list[float]], points: list[int], width: int = 0) -> DataFrame:
    """stream, time, value, regime: AR processes that are driven by the noise of rows (stream, time from 0, noise), each stream in a task.

    The first values are the noise itself; a null counts as 0. A stream's length is its caller's bound."""
    order, table = len(params[0]), np.array(params, dtype=float)

    def make(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("time")
        regime = _regimes(int(g.time.max()) + 1, points, width)[g.time]
        low = np.minimum(np.floor(regime).astype(int), len(table) - 1)
        a = (regime - low)[:, None]
        coef = (1 - a) * table[low] + a * table[np.minimum(low + 1, len(table) - 1)]
        y = g.noise.fillna(0.0).to_numpy(dtype=float).copy()
        for t in range(order, len(y)):
            y[t] += coef[t] @ y[t - order : t][::-1]
        return pd.DataFrame({"stream": g.stream, "time": g.time, "value": y, "regime": regime})

    return rows.select("stream", "time", "noise").groupBy("stream").applyInPandas(make, "stream long, time long, value double, regime double")


def windows_of(rows: DataFrame, points: list[int], window: int, width: int = 0) -> DataFrame:
    """stream, time, x, class: trailing windows of each stream of ar_over(); the class is r + 1 once `window` (and `width`) steps have
    passed since drift point r."""
    from pyspark.sql import Window

    w = Window.partitionBy("stream").orderBy("time").rowsBetween(-(window - 1), 0)
    cls = sum((F.when(F.col("time") >= p + window + width, 1).otherwise(0) for p in points), F.lit(0))
    return rows.withColumn("x", F.collect_list("value").over(w)).filter(F.size("x") == window).select("stream", "time", "x", cls.alias("class"))


def ar_stream(spark: SparkSession, n: int, params: list[list[float]], points: list[int], width: int = 0, noise: float = 1.0, seeds: tuple[int, ...] = (42,)) -> DataFrame:
    """stream, time, value, regime."""

    def make(g: pd.DataFrame) -> pd.DataFrame:
        y, r = ar_values(n, params, points, width, noise, int(g.stream.iloc[0]))
        return pd.DataFrame({"stream": g.stream.iloc[0], "time": np.arange(n), "value": y, "regime": r})

    return spark.createDataFrame([(s,) for s in seeds], "stream long").groupBy("stream").applyInPandas(make, "stream long, time long, value double, regime double")


def drift_comparison(spark: SparkSession, n: int, params: list[list[float]], points: list[int], width: int, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """time, abrupt_drift, gradual_drift, abrupt_regime, gradual_regime."""
    a = ar_stream(spark, n, params, points, 0, noise, (seed,)).select("time", F.col("value").alias("abrupt_drift"), F.col("regime").cast("int").alias("abrupt_regime"))
    g = ar_stream(spark, n, params, points, width, noise, (seed,)).select("time", F.col("value").alias("gradual_drift"), F.col("regime").alias("gradual_regime"))
    return a.join(g, "time").select("time", "abrupt_drift", "gradual_drift", "abrupt_regime", "gradual_regime")


def windowed_ar(spark: SparkSession, n: int, params, points: list[int], window: int, width: int = 0, noise: float = 1.0, seed: int = 42) -> DataFrame:
    """time, x, class: trailing windows; the class is r + 1 once `window` (and `width`) steps have passed since drift point r."""
    from pyspark.sql import Window

    rows = ar_stream(spark, n, params, points, width, noise, (seed,))
    w = Window.partitionBy("stream").orderBy("time").rowsBetween(-(window - 1), 0)
    cls = sum((F.when(F.col("time") >= p + window + width, 1).otherwise(0) for p in points), F.lit(0))
    return rows.withColumn("x", F.collect_list("value").over(w)).filter(F.size("x") == window).select("time", "x", cls.alias("class"))


#: Thresholds of the SEA concepts, fixed values of the published definition.
SEA_THETA = (8.0, 9.0, 7.0, 9.5)


def _sea(rows: DataFrame, n: int, drifts: int, seed: int, noise: float) -> DataFrame:
    """concept and class of rows with time, f1 and f2: the concept goes to the next of three at evenly spaced times."""
    passed = sum((F.when(F.col("time") >= n * (k + 1) // (drifts + 1), 1).otherwise(0) for k in range(drifts)), F.lit(0))
    rows = rows.withColumn("concept", (passed % 3).cast("int"))
    clean = (F.col("f1") + F.col("f2") <= F.element_at(F.array(*[F.lit(t) for t in SEA_THETA]), F.col("concept") + 1)).cast("int")
    return rows.withColumn("class", F.when(_unit(F.col("time"), seed, 4) < noise, 1 - clean).otherwise(clean))


def _unit(time, seed: int, k: int):
    """A draw in [0, 1) by hash of the time."""
    return F.pmod(F.xxhash64(time, F.lit(seed), F.lit(k)), F.lit(1 << 40)) / float(1 << 40)


def sea_stream(spark: SparkSession, n: int, drifts: int = 2, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """time, f1, f2, f3, concept, class: features uniform in [0, 10) by hash, class 1 if f1 + f2 <= theta of the concept. In parallel."""
    rows = spark.range(n).withColumnRenamed("id", "time").withColumns({f"f{k}": 10 * _unit(F.col("time"), seed, k) for k in (1, 2, 3)})
    return _sea(rows, n, drifts, seed, noise)


def sea_over(rows: DataFrame, n: int, drifts: int = 2) -> DataFrame:
    """time, f1, f2, f3, concept, class of rows (time from 0 to n - 1, key): features uniform in [0, 10) by the md5 of the key."""
    draw = lambda k: F.conv(F.substring(F.md5(F.concat_ws("|", F.col("key").cast("string"), F.lit(k))), 1, 12), 16, 10).cast("double") / float(1 << 48)
    return _sea(rows.select("time", *[(10 * draw(k)).alias(f"f{k}") for k in (1, 2, 3)]), n, drifts, 0, 0.0)


def sea_windows(spark: SparkSession, n: int, window: int, drifts: int = 3, seed: int = 42, noise: float = 0.0) -> DataFrame:
    """time, x, concept, class of n windows of the stream's first feature: x ends at its time and begins before 0 where it must. Draws are
    by hash of the time, so each row makes its own window and nothing is shuffled."""
    before = F.sequence(F.col("time") - (window - 1), F.col("time"))
    rows = sea_stream(spark, n, drifts, seed, noise)
    return rows.select("time", F.transform(before, lambda t: 10 * _unit(t, seed, 1)).alias("x"), "concept", "class")
