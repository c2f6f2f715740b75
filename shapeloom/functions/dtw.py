"""Dynamic time warping, and the registry of metrics."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import arrays


def dtw(a, b, band: float = 0.9, most: float = float("inf")) -> float:
    """Square root of the least sum of squared differences along a warping path within a band of int(max(n, m) * band) of the diagonal.
    Infinity if every cell of a row before the last is above most squared. Rows are vectorised as a running minimum over prefix sums."""
    a, b = np.asarray(a, dtype=float), np.asarray(b, dtype=float)
    n, m = len(a), len(b)
    if not n or not m:
        return 0.0 if n == m else float("inf")
    reach = reach_of(n, m, band)
    above = np.full(m + 1, np.inf)
    above[0] = 0.0
    for i in range(1, n + 1):
        lo, hi = max(1, i - reach), min(m, i + reach)
        cost = (a[i - 1] - b[lo - 1 : hi]) ** 2
        step = np.minimum(above[lo - 1 : hi], above[lo : hi + 1])
        sums = np.cumsum(cost)
        row = np.full(m + 1, np.inf)
        # row[j] = cost[j] + min(step[j], row[j-1]), so row - sums is a running minimum
        row[lo : hi + 1] = sums + np.minimum.accumulate(step - (sums - cost))
        if i < n and row[lo : hi + 1].min() > most * most:
            return float("inf")
        above = row
    return float(np.sqrt(above[m]))


def reach_of(n: int, m: int, band: float) -> int:
    return max(int(max(n, m) * band), abs(n - m))


def dtw_many(x: np.ndarray, b, band: float = 0.9) -> np.ndarray:
    """dtw() of every row of x and b, a row of the table at a time for all of them."""
    x, b = np.asarray(x, dtype=float), np.asarray(b, dtype=float)
    (count, n), m = x.shape, len(b)
    if not n or not m:
        return np.full(count, 0.0 if n == m else np.inf)
    reach = reach_of(n, m, band)
    above = np.full((count, m + 1), np.inf)
    above[:, 0] = 0.0
    for i in range(1, n + 1):
        lo, hi = max(1, i - reach), min(m, i + reach)
        cost = (x[:, i - 1 : i] - b[lo - 1 : hi]) ** 2
        sums = np.cumsum(cost, axis=1)
        step = np.minimum(above[:, lo - 1 : hi], above[:, lo : hi + 1])
        row = np.full((count, m + 1), np.inf)
        row[:, lo : hi + 1] = sums + np.minimum.accumulate(step - (sums - cost), axis=1)
        above = row
    return np.sqrt(np.maximum(above[:, m], 0.0))


def envelope(b: np.ndarray, n: int, reach: int) -> tuple[np.ndarray, np.ndarray]:
    """Least and largest value of b that a path may pair with each of n places."""
    padded = np.concatenate([np.full(reach, np.nan), b, np.full(max(0, n - len(b)) + reach, np.nan)])
    w = np.lib.stride_tricks.sliding_window_view(padded, 2 * reach + 1)[:n]
    return np.nanmin(w, axis=1), np.nanmax(w, axis=1)


def outside(a: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared sum of what lies outside an envelope, by rows of a: below the square of the warped distance, as every place is paired."""
    return (np.maximum(0.0, np.maximum(a - high, low - a)) ** 2).sum(axis=-1)


class NearestByDtw:
    """The nearest of some atoms to a series under dtw(): bounds first, from cheap to dear, and tables only for what they leave.

    Bounds: the pairs of first and of last values, which every path holds; the series outside the atoms' envelopes; the atoms outside that of the
    series. Atoms are tried in order of their bounds, and a table ends when a row is above the best so far."""

    def __init__(self, atoms: list[np.ndarray], band: float = 0.9):
        self.atoms, self.band, self.made = [np.asarray(s, dtype=float) for s in atoms], band, {}

    def _envelopes(self, n: int):
        if n not in self.made:
            self.made[n] = [envelope(s, n, reach_of(n, len(s), self.band)) if n and len(s) else None for s in self.atoms]
        return self.made[n]

    def find(self, v: np.ndarray) -> tuple[int, float, int]:
        """Place of the nearest atom (ties: the first), its distance, and how many tables were filled to their end."""
        n, bounds = len(v), np.zeros(len(self.atoms))
        if not n:
            d = [dtw(v, s, self.band) for s in self.atoms]
            return int(np.argmin(d)), float(min(d)), 0
        for k, (s, e) in enumerate(zip(self.atoms, self._envelopes(n))):
            if e is None:
                bounds[k] = np.inf
                continue
            ends = (v[0] - s[0]) ** 2 + ((v[-1] - s[-1]) ** 2 if n > 1 or len(s) > 1 else 0.0)
            bounds[k] = max(ends, outside(v, *e))
        best, at, full = np.inf, 0, 0
        for k in np.lexsort((np.arange(len(bounds)), bounds)):
            if bounds[k] * (1 - 1e-9) > best * best:
                break
            s = self.atoms[k]
            if np.isinf(bounds[k]) or outside(s, *envelope(v, len(s), reach_of(n, len(s), self.band))) * (1 - 1e-9) > best * best:
                continue
            d = dtw(v, s, self.band, best * (1 + 1e-9))
            full += not np.isinf(d)
            if d < best or d == best and k < at:
                best, at = d, int(k)
        return at, float(best), full


def dtw_features(rows, atoms: list[np.ndarray], band: float = 0.9):
    """rows with features: dtw() to each atom, in Arrow batches, series of one length at once. A null series has infinite distances."""

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = [np.full(len(atoms), np.inf) for _ in x]
        sizes = np.array([-1 if v is None else len(v) for v in x])
        for size in np.unique(sizes[sizes >= 0]):
            at = np.flatnonzero(sizes == size)
            own = np.array([x.iloc[k] for k in at], dtype=float).reshape(len(at), size)
            for k, d in zip(at, np.stack([dtw_many(own, s, band) for s in atoms], axis=1) if atoms else []):
                out[k] = d
        return pd.Series(out, dtype=object)

    return rows.withColumn("features", run("x"))


def nearest_of_many(x: np.ndarray, atoms: list[np.ndarray], band: float = 0.9) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """NearestByDtw.find() of every row of x, with its bounds for all rows at once: each row's table with the atom of the least bound first,
    then an atom's tables for all rows that its bounds don't keep from it."""
    count, n = x.shape
    bounds = np.zeros((count, len(atoms)))
    for k, s in enumerate(atoms):
        if not n or not len(s):
            bounds[:, k] = 0.0 if n == len(s) else np.inf
            continue
        low, high = envelope(s, n, reach_of(n, len(s), band))
        ends = (x[:, 0] - s[0]) ** 2 + ((x[:, -1] - s[-1]) ** 2 if n > 1 or len(s) > 1 else 0.0)
        bounds[:, k] = np.maximum(ends, outside(x, low, high))
    best, at, tables = np.full(count, np.inf), np.zeros(count, dtype=np.int64), np.zeros(count, dtype=np.int64)
    first = bounds.argmin(axis=1)

    def fill(k: int, rows: np.ndarray) -> None:
        d = dtw_many(x[rows], atoms[k], band)
        tables[rows] += 1
        won = (d < best[rows]) | (d == best[rows]) & (k < at[rows])
        best[rows[won]], at[rows[won]] = d[won], k

    for k in range(len(atoms)):
        if len(rows := np.flatnonzero(first == k)):
            fill(k, rows)
    for k in range(len(atoms)):
        if len(rows := np.flatnonzero((first != k) & ~np.isinf(bounds[:, k]) & (bounds[:, k] * (1 - 1e-9) <= best * best))):
            fill(k, rows)
    return at, best, tables


#: Series whose tables with an atom are filled at once.
ROWS = 2048


def nearest_by_dtw(rows, atoms: list[np.ndarray], band: float = 0.9):
    """rows with nearest: struct of k (place of the nearest atom under dtw()), dist, and tables (filled to their end); null for a null series
    or without atoms."""
    atoms = [np.asarray(s, dtype=float) for s in atoms]

    @F.pandas_udf("struct<k:long,dist:double,tables:long>")
    def run(x: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame({"k": pd.array([None] * len(x), dtype="Int64"), "dist": np.nan, "tables": pd.array([None] * len(x), dtype="Int64")})
        sizes = np.array([-1 if v is None else len(v) for v in x], dtype=np.int64)
        for size in np.unique(sizes[sizes >= 0]) if atoms else []:
            every = np.flatnonzero(sizes == size)
            for at in (every[k : k + ROWS] for k in range(0, len(every), ROWS)):
                own = np.array([x.iloc[k] for k in at], dtype=float).reshape(len(at), size)
                for name, v in zip(out.columns, nearest_of_many(own, atoms, band)):
                    out.iloc[at, out.columns.get_loc(name)] = v
        return out

    found = rows.withColumn("nearest", run("x"))
    return found.withColumn("nearest", F.when(F.col("nearest.k").isNotNull(), F.col("nearest")))


def dtw_udf(band: float = 0.9, most: float = float("inf")):
    @F.pandas_udf("double")
    def run(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([dtw(x, y, band, most) for x, y in zip(a, b)], dtype=float)

    return run


METRICS = {"euclidean": arrays.euclidean, "dtw": lambda a, b: dtw_udf()(a, b)}
