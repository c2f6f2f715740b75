"""Drift rules and two-sample statistics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neighbours import knn_join
from .ranges import running_sums
from .tables import written

#: Rows of a sample whose distances to as many others are taken at once.
BLOCK = 512


def threshold_drift(errors: DataFrame, factor: float = 1.3) -> DataFrame:
    """drift_detected by batch: the error is above factor times the reference error, which is the first batch's, and after a drift that
    of the drifting batch. One pass in order over the table of batches, which has a row for each."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, ref, hits = g.sort_values("batch_num"), None, []
        for e in g.error:
            hits.append(ref is not None and e > factor * ref)
            ref = e if ref is None or hits[-1] else ref
        return g.assign(drift_detected=hits)

    return errors.select("batch_num", "error").groupBy().applyInPandas(walk, "batch_num long, error double, drift_detected boolean")


class AdaptiveWindow:
    """ADWIN as published: a window of values that drops its older part when two parts' means differ by more than chance (delta) allows.

    Values are held as buckets of 2^k of them, at most `most` a size, so n values take memory and time of about log n each."""

    def __init__(self, delta: float = 0.002, most: int = 5):
        self.delta, self.most, self.rows = delta, most, [[]]  # rows[k]: (sum, sum of squares) of buckets of 2^k values, oldest first

    def _whole(self):
        return [(float(1 << k), s, s2) for k in reversed(range(len(self.rows))) for s, s2 in self.rows[k]]  # oldest first

    @property
    def width(self) -> int:
        return sum(len(r) << k for k, r in enumerate(self.rows))

    @property
    def mean(self) -> float:
        return sum(s for _, s, _ in self._whole()) / self.width

    def _add(self, value: float) -> None:
        self.rows[0].append((value, value * value))
        for k in range(len(self.rows)):
            if len(self.rows[k]) > self.most:
                (a, a2), (b, b2) = self.rows[k].pop(0), self.rows[k].pop(0)
                if k + 1 == len(self.rows):
                    self.rows.append([])
                self.rows[k + 1].append((a + b, a2 + b2))

    def _cut(self) -> bool:
        """Whether some split shows a change."""
        n, s, s2 = np.array(self._whole()).T
        if len(n) < 2:
            return False
        whole, left, total = n.sum(), n.cumsum()[:-1], s.cumsum()[:-1]
        right, variance = whole - left, max(s2.sum() / whole - (s.sum() / whole) ** 2, 0.0)
        m, log = 1 / (1 / left + 1 / right), np.log(2 * np.log(max(whole, 3.0)) / self.delta)
        return bool((np.abs(total / left - (s.sum() - total) / right) > np.sqrt(2 / m * variance * log) + 2 / (3 * m) * log).any())

    def update(self, value: float) -> bool:
        """Take a value; whether older ones were dropped."""
        self._add(float(value))
        found = False
        while self._cut():
            found = True
            self.rows[-1].pop(0)
            while len(self.rows) > 1 and not self.rows[-1]:
                self.rows.pop()
        return found


def adaptive_drift(errors: DataFrame, delta: float = 0.002) -> DataFrame:
    """drift_detected and the window's width and mean by batch, in order; as threshold_drift, one pass over a row for each batch."""

    def walk(g: pd.DataFrame) -> pd.DataFrame:
        g, w = g.sort_values("batch_num"), AdaptiveWindow(delta)
        got = [(w.update(e), w.width, w.mean) for e in g.error]
        return g.assign(drift_detected=[v[0] for v in got], width=[v[1] for v in got], mean=[v[2] for v in got])

    kind = "batch_num long, error double, drift_detected boolean, width long, mean double"
    return errors.select("batch_num", "error").groupBy().applyInPandas(walk, kind)


def scheduled_drift(batches: DataFrame) -> DataFrame:
    """Every odd batch."""
    return batches.withColumn("drift_detected", F.col("batch_num") % 2 != 0)


def _blocks(sample: DataFrame, *columns: str, size: int = BLOCK) -> DataFrame:
    """Rows of a sample in blocks of about `size`, each a row of arrays."""
    n = max(1, -(-sample.count() // size))
    return sample.groupBy(F.pmod(F.xxhash64(*columns), F.lit(n)).alias("_k")).agg(F.collect_list(F.struct(*columns)).alias("b")).select("b")


def _block_pairs(a: DataFrame, b: DataFrame, *columns: str) -> DataFrame:
    """All pairs of blocks; the distances of two samples are their product by nature, taken a block pair at a time in Arrow batches."""
    left, right = _blocks(a, *columns).withColumnRenamed("b", "u"), _blocks(b, *columns).withColumnRenamed("b", "v")
    return left.crossJoin(right).repartition(max(1, left.sparkSession.sparkContext.defaultParallelism))


def _matrix(rows) -> np.ndarray:
    return np.array([list(r["x"]) for r in rows], dtype=float)


def _squares(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    return np.stack([((v - row) ** 2).sum(axis=1) for row in u])


def mmd_rbf(x: DataFrame, y: DataFrame, gamma: float = 1.0) -> DataFrame:
    """Biased squared MMD with an RBF kernel, diagonals included."""

    def sums(frames):
        for f in frames:
            got = [(np.exp(-gamma * _squares(_matrix(u), _matrix(v))).sum(), len(u) * len(v)) for u, v in zip(f.u, f.v)]
            yield pd.DataFrame(got, columns=["s", "n"]).astype({"s": float, "n": "int64"})

    def mean_kernel(a, b, name):
        a, b = (s.select("x", F.monotonically_increasing_id().alias("id")) for s in (a, b))  # equal rows are spread over the blocks
        return _block_pairs(a, b, "id", "x").mapInPandas(sums, "s double, n long").agg((F.sum("s") / F.sum("n")).alias(name))

    k = mean_kernel(x, x, "kxx").crossJoin(mean_kernel(y, y, "kyy")).crossJoin(mean_kernel(x, y, "kxy"))  # of one row each
    return k.select((F.col("kxx") + F.col("kyy") - 2 * F.col("kxy")).alias("mmd2"))


#: Below this p-value two samples count as different.
LEVEL = 0.05


def ks_two_sample(rows: DataFrame, by: str, value: str, side: str) -> DataFrame:
    """statistic, p_value and drift by `by`: the largest gap of the two samples' distributions, its asymptotic p-value, and whether that is
    below LEVEL. side is a boolean; rows without a value or a side count for nothing, and a group that lacks a sample has nulls.

    Equal values are counted first; the counts are summed over ranges of (by, value) that hold about as many values each."""
    known = rows.filter(F.col(value).isNotNull() & F.col(side).isNotNull())
    counts = known.groupBy(by, value).agg(F.count_if(F.col(side)).alias("a"), F.count_if(~F.col(side)).alias("b"))
    up = running_sums(counts, [by, value], {"ua": F.col("a"), "ub": F.col("b")}, by=[by])
    whole = counts.groupBy(F.col(by).alias("_by")).agg(F.sum("a").alias("na"), F.sum("b").alias("nb"))
    gap = F.max(F.abs(F.try_divide("ua", "na") - F.try_divide("ub", "nb")))
    g = up.join(whole, F.col(by).eqNullSafe(F.col("_by"))).groupBy(by, "na", "nb").agg(gap.alias("statistic"))
    n = F.sqrt(F.col("na") * F.col("nb") / (F.col("na") + F.col("nb")))
    g = g.withColumn("_l", (n + 0.12 + F.try_divide(F.lit(0.11), n)) * F.col("statistic"))
    term = lambda t, j: t + 2 * F.when(j % 2 == 1, 1.0).otherwise(-1.0) * F.exp(-2.0 * j * j * F.col("_l") * F.col("_l"))
    p = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    p = F.when(F.col("_l") < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), p)))  # the series of a small statistic ends late, at 1
    g = g.withColumn("_p", F.when(F.col("statistic").isNotNull(), p))
    return g.select(by, "statistic", F.col("_p").alias("p_value"), (F.col("_p") < LEVEL).alias("drift"))


def knn_kl(x: DataFrame, y: DataFrame, k: int = 3, digits: int | None = 5) -> DataFrame:
    """kNN estimate of the KL divergence of x from y; x, y: x.

    Rounded rows that are equal are one point with a count. For a point of x, p is the count of its k + 1 nearest points of x, itself
    included, and q that of its k nearest of y; both are shares of their sums over all points, and the sum of
    p * (ln p - ln q + d * (ln radius in y - ln radius in x)) is the estimate. Points with a radius of 0 have no logarithm and are left out."""

    def points(s):
        own = s.select((F.transform("x", lambda v: F.round(v, digits)) if digits is not None else F.col("x")).alias("x")).groupBy("x").agg(F.count("*").alias("n"))
        return own.select(F.xxhash64("x").alias("id"), "x", "n")

    def nearest(a, b, k, name):
        """Of equally far points the one with the smaller count is nearer."""
        met = knn_join(a.select("id", "x"), b, k, other="n")[0]
        return met.groupBy("id").agg(F.max("dist").alias(f"r{name}"), F.sum("other").alias(f"k{name}"))

    px, py = written(points(x), "points"), written(points(y), "points")
    j = nearest(px, px, k + 1, "p").join(nearest(px, py, k, "q"), "id")
    whole = j.agg(F.sum("kp").alias("sp"), F.sum("kq").alias("sq")).crossJoin(px.agg(F.max(F.size("x")).alias("dim")))  # one row
    p, q = F.col("kp") / F.col("sp"), F.col("kq") / F.col("sq")
    term = p * (F.ln(p) - F.ln(q) + F.col("dim") * (F.ln("rq") - F.ln("rp")))
    return j.filter("rp > 0 and rq > 0").crossJoin(F.broadcast(whole)).agg(F.sum(term).alias("kl"))


def drift_point_stats(rows: DataFrame, point: int, window: int = 50, slope: int = 20) -> DataFrame:
    """Changes of mean, population variance and slope around a row number of (seq, value)."""
    near = rows.filter((F.col("seq") >= point - window) & (F.col("seq") < point + window))
    before, after = F.col("seq") < point, F.col("seq") >= point
    sb, sa = before & (F.col("seq") >= point - slope), after & (F.col("seq") < point + slope)
    pick = lambda c, v="value": F.when(c, F.col(v).cast("double"))
    g = near.agg(F.avg(pick(before)).alias("mb"), F.avg(pick(after)).alias("ma"), F.var_pop(pick(before)).alias("vb"), F.var_pop(pick(after)).alias("va"), F.regr_slope(pick(sb), pick(sb, "seq")).alias("slope_before"), F.regr_slope(pick(sa), pick(sa, "seq")).alias("slope_after"))
    return g.select((F.col("ma") - F.col("mb")).alias("mean_change"), (F.col("va") - F.col("vb")).alias("variance_change"), "slope_before", "slope_after", (F.col("slope_after") - F.col("slope_before")).alias("slope_change"))


def distinct_rows(rows: DataFrame, digits: int = 1) -> DataFrame:
    """Different rounded arrays with their counts."""
    return rows.groupBy(F.transform("x", lambda v: F.round(v, digits)).alias("x")).agg(F.count("*").alias("n"))
