"""Exact nearest-neighbour join by pivots: points meet only where the triangle inequality lets them be neighbours.

A bounded number of points of the right side are pivots, and each point belongs to the cell of its nearest pivot. From the cells' radii and
the distances between pivots follows, for every cell of the left side, a distance within which all of its points have k neighbours.
A point of the right side goes only to the cells that it may be so near to; where these are many more than the left side has blocks, near
cells are put together until they fill a block. Groups are cut into blocks of bounded size on both sides, so a crowded cell is many tasks; the k best of each block meet in a ranking that Spark limits to k rows before the shuffle as well.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import discard, written

#: Most pivots (their distances are a table of that many squared on the driver), points of a block, digits of distances that count as equal.
PIVOTS, BLOCK, DIGITS = 512, 1024, 9
#: Pairs whose differences are held at once.
PAIRS = 1 << 15
#: Copies of a point of the right side that are always allowed.
COPIES = 16
_SLACK = 1e-6  # of bounds: distances are rounded, and sums of them aren't exact


def squared(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of u and v, without differences of large products."""
    return np.stack([((v - row) ** 2).sum(axis=1) for row in u]) if len(u) else np.zeros((0, len(v)))


def best_pairs(u: np.ndarray, v: np.ndarray, order: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of u, rows of v and their distance (to DIGITS) for the k nearest of v to each of u; of those equally far, the first in order.

    One matrix product shows which pairs can be among the best, within a bound of its rounding; only their distances are computed by
    differences, so the result is that of squared() over all pairs. Numbers without a finite square leave all pairs to that."""
    least = min(k, len(v))
    with np.errstate(all="ignore"):
        own, others = (u * u).sum(axis=1), (v * v).sum(axis=1)
        near = own[:, None] + others - 2 * (u @ v.T)
        off = 1e-12 * (own + others.max())
        edge = np.partition(near, least - 1, axis=1)[:, least - 1]
        room = 2 * off + 4 * 10.0**-DIGITS * np.sqrt(np.maximum(edge, 0) + off) + 10.0**-DIGITS * 10.0**-DIGITS
        may = near <= (edge + room)[:, None]
        if not np.isfinite(near).all():
            may[:] = True
    i, j = np.nonzero(may)
    d = np.concatenate([np.zeros(0), *[((v[j[s : s + PAIRS]] - u[i[s : s + PAIRS]]) ** 2).sum(axis=1) for s in range(0, len(i), PAIRS)]])
    d = np.sqrt(d).round(DIGITS)
    place = np.empty(len(v), dtype=np.int64)
    place[order] = np.arange(len(v))
    at = np.lexsort((place[j], d, i))
    i, j, d = i[at], j[at], d[at]
    few = np.arange(len(i)) - np.searchsorted(i, i) < k
    return i[few], j[few], d[few]


@dataclass
class Plan:
    """pivots; group: of each left cell; reach[g, j]: a right point of cell j goes to group g if its distance to pivot j is at least that; a_blocks
    and b_blocks of each group; pairs: points compared, out of all."""

    pivots: np.ndarray
    group: np.ndarray
    reach: np.ndarray
    a_blocks: np.ndarray
    b_blocks: np.ndarray
    pairs: int
    all_pairs: int

    @property
    def share(self) -> float:
        return self.pairs / self.all_pairs if self.all_pairs else 0.0


def _celled(rows: DataFrame, other: str, pivots: np.ndarray) -> DataFrame:
    """id, other, x with cell and r (distance to its pivot); points that are null or hold what is no number are left out."""

    def run(frames):
        for f in frames:
            x = np.array(f.x.tolist(), dtype=float).reshape(len(f), -1)
            d = squared(x, pivots)
            cell = d.argmin(axis=1)
            yield pd.DataFrame({"id": f.id, "other": f.other, "x": f.x, "cell": cell.astype(np.int64), "r": np.sqrt(d[np.arange(len(f)), cell])})

    kinds = dict(rows.dtypes)
    known = rows.select("id", F.col(other).alias("other"), F.col("x").cast("array<double>").alias("x")).filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    return written(known.mapInPandas(run, f"id {kinds['id']}, other {kinds[other]}, x array<double>, cell long, r double"), "neighbours")


def _grouped(apart: np.ndarray, rows: np.ndarray, block: int) -> np.ndarray:
    """A group for each cell: near cells together until they fill a block, so that a right point goes to no more places than there are blocks."""
    group, free, g = np.full(len(rows), -1), np.ones(len(rows), dtype=bool), 0
    while free.any():
        order = np.argsort(np.where(free, apart[int(free.argmax())], np.inf), kind="stable")[: int(free.sum())]
        filled = np.cumsum(rows[order])
        own = order[: max(1, int(np.searchsorted(filled, block, side="right")))]
        group[own], free[own], g = g, False, g + 1
    return group


def _routed(b: DataFrame, reach: np.ndarray) -> np.ndarray:
    """How many points of b go to each row of reach."""

    def count(frames):
        n = np.zeros(len(reach), dtype=np.int64)
        for f in frames:
            n += (reach[:, f.cell] <= f.r.to_numpy()).sum(axis=1)
        yield pd.DataFrame({"cell": np.flatnonzero(n), "n": n[n > 0]})

    out = np.zeros(len(reach), dtype=np.int64)
    for r in b.select("cell", "r").mapInPandas(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        out[r.cell] = r.n
    return out


def _planned(a: DataFrame, b: DataFrame, pivots: np.ndarray, k: int, block: int) -> Plan:
    p = len(pivots)
    radius, a_rows = np.zeros(p), np.zeros(p, dtype=np.int64)
    for r in a.groupBy("cell").agg(F.max("r").alias("r"), F.count("*").alias("n")).collect():  # a row for each pivot
        radius[r.cell], a_rows[r.cell] = r.r, r.n
    near = F.row_number().over(Window.partitionBy("cell").orderBy("r"))
    few = b.select("cell", "r").withColumn("o", near).filter(F.col("o") <= k).select("cell", "r").collect()  # k for each pivot
    apart = np.sqrt(squared(pivots, pivots))
    bound = np.full(p, np.inf)
    if len(few) >= k:
        cells, rs = np.array([r.cell for r in few]), np.array([r.r for r in few])
        for i in range(p):
            bound[i] = radius[i] + np.partition(apart[i, cells] + rs, k - 1)[k - 1]
    reach = apart - (radius + bound)[:, None] * (1 + _SLACK) - _SLACK
    reach[a_rows == 0] = np.inf
    group, b_rows = np.arange(p), _routed(b, reach)
    if b_rows.sum() > max(COPIES, 2 * -(-int(a_rows.sum()) // block)) * max(1, b.count()):  # bounds save too little to copy points to so many cells
        group = _grouped(apart, a_rows, block)
        joint = np.full((int(group.max()) + 1, p), np.inf)
        np.minimum.at(joint, group, reach)
        reach, a_rows = joint, np.bincount(group, a_rows).astype(np.int64)
        b_rows = _routed(b, reach)
    blocks = [np.maximum(1, -(-n // block)) for n in (a_rows, b_rows)]
    return Plan(pivots, group, reach, *blocks, int((a_rows * b_rows).sum()), int(a_rows.sum()) * b.count())


def knn_join(a: DataFrame, b: DataFrame, k: int, other: str = "id", pivots: int = PIVOTS, block: int = BLOCK, seed: int = 0) -> tuple[DataFrame, Plan]:
    """id, rank, dist, other: the k nearest points of b for each point of a (id, x), and the plan. other: a column of b that tells them apart;
    of points that are equally far (to DIGITS) the smaller one is nearer.

    x: arrays of one length, ids of a unique. If b has fewer than k points all are neighbours; points without numbers have none and are
    none; an empty side gives an empty result."""
    known = b.filter(F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull() | F.isnan(v)))
    wanted = min(pivots, max(1, int(known.count() ** 0.5)))
    first = known.select(F.col("x").cast("array<double>").alias("x")).orderBy(F.xxhash64("x", F.lit(seed))).limit(wanted).collect()
    spark, kind = a.sparkSession, dict(b.dtypes)[other]
    if not first:
        return spark.createDataFrame([], f"id {dict(a.dtypes)['id']}, rank int, dist double, other {kind}"), Plan(np.zeros((0, 0)), np.zeros(0), np.zeros((0, 0)), np.zeros(0), np.zeros(0), 0, 0)
    at = np.unique(np.array([r.x for r in first], dtype=float), axis=0)
    left, right = _celled(a, "id", at), _celled(b, other, at)
    plan = _planned(left, right, at, k, block)

    def route(frames):
        for f in frames:
            to = plan.reach[:, f.cell] <= f.r.to_numpy()  # cells by rows
            cell, row = np.nonzero(to)
            for s in range(0, len(row), 20_000):
                some = f.iloc[row[s : s + 20_000]]
                yield pd.DataFrame({"other": some.other.to_numpy(), "x": some.x.to_numpy(), "to": cell[s : s + 20_000].astype(np.int64)})

    n_a, n_b = (F.element_at(F.array(*[F.lit(int(v)) for v in n]), (F.col("to") + 1).cast("int")) for n in (plan.a_blocks, plan.b_blocks))
    every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    own = F.element_at(F.array(*[F.lit(int(g)) for g in plan.group]), (F.col("cell") + 1).cast("int")).cast("long")
    ours = left.withColumn("to", own).select("id", "x", "to", F.pmod(F.xxhash64("id"), n_a).cast("int").alias("u"), every(n_b).alias("v"))
    theirs = right.mapInPandas(route, f"other {kind}, x array<double>, to long")
    theirs = theirs.select("other", "x", "to", F.pmod(F.xxhash64("x", "other"), n_b).cast("int").alias("v"), every(n_a).alias("u"))

    def nearest(g: pd.DataFrame, h: pd.DataFrame) -> pd.DataFrame:
        if not len(g) or not len(h):
            return pd.DataFrame({"id": g.id[:0], "dist": np.zeros(0), "other": h.other[:0]})
        u, v = (np.array(t.x.tolist(), dtype=float).reshape(len(t), -1) for t in (g, h))
        i, j, d = best_pairs(u, v, np.argsort(h.other.to_numpy(), kind="stable"), k)
        return pd.DataFrame({"id": g.id.to_numpy()[i], "dist": d, "other": h.other.to_numpy()[j]})

    keys = ["to", "u", "v"]
    met = ours.groupBy(*keys).cogroup(theirs.groupBy(*keys)).applyInPandas(nearest, f"id {dict(a.dtypes)['id']}, dist double, other {kind}")
    rank = F.row_number().over(Window.partitionBy("id").orderBy("dist", "other"))
    got = written(met.withColumn("rank", rank).filter(F.col("rank") <= k).select("id", "rank", "dist", "other"), "neighbours")
    discard(left, right)
    return got, plan
