"""Dictionary learning: alternating sparse coding and dictionary steps, one fit per label in parallel.

Given the atoms, series don't depend on each other, and the dictionary step and the stopping test need only sums over series. So a label
of any size is learned in passes over its series, a small one in one task; learn() is the fit on arrays for the online loop. encode() then codes every series, in Arrow batches, with the learned dictionary.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


@dataclass
class Fit:
    s: np.ndarray
    a: np.ndarray
    off: np.ndarray
    trace: list[float]


def _windows(r: np.ndarray, q: int) -> np.ndarray:
    return np.lib.stride_tricks.sliding_window_view(r, q, axis=1)


def rebuild(s: np.ndarray, a: np.ndarray, off: np.ndarray, p: int) -> np.ndarray:
    """Sum of all atoms at their offsets, for every series at once."""
    n, q = len(a), s.shape[1]
    out = np.zeros((n, p))
    rows = np.arange(n)[:, None]
    for k in range(len(s)):
        np.add.at(out, (rows, off[:, k : k + 1] + np.arange(q)), a[:, k : k + 1] * s[k])
    return out


def objective(x, s, a, off, lam) -> float:
    return float(0.5 * ((x - rebuild(s, a, off, x.shape[1])) ** 2).sum() + lam * np.abs(a).sum())


def code(x, s, a, off, lam, sweeps: int = 5, eps: float = 1e-5, signed: bool = True, rng=None):
    """Coordinate sweeps over atoms in random order, all series at once: they don't depend on each other given the atoms. The
    residual is kept up to date rather than rebuilt. An offset moves only with a coefficient that isn't zero."""
    rng = rng or np.random.default_rng(0)
    a, off = a.copy(), off.copy()
    n, p = x.shape
    kk, q = s.shape
    span, banded = np.arange(q), _banded(s, p)
    placed = None if banded is None or not np.isfinite(s).all() else np.ascontiguousarray(banded.transpose(0, 2, 1))
    if placed is None:
        res = x - rebuild(s, a, off, p)
    else:
        res = np.zeros((n, p))
        for k in range(kk):
            res += a[:, k, None] * placed[k][off[:, k]]
        res = x - res
    last = None
    for _ in range(sweeps):
        order = rng.permutation(kk)
        for lot in (slice(t, t + LOT) for t in range(0, n, LOT)):
            _sweep(res[lot], s, a[lot], off[lot], lam, signed, order, span, banded, placed)
        if eps < 0:  # no objective is near enough to stop
            continue
        f = float(0.5 * (res**2).sum() + lam * np.abs(a).sum())
        if last is not None and abs(last - f) <= eps * max(abs(last), 1e-300):
            break
        last = f
    return a, off


#: Series that are swept at once, so that their residuals stay in a processor's cache.
LOT = 512


def _sweep(res, s, a, off, lam, signed: bool, order, span, banded, placed) -> None:
    """One step for each atom in order, in place. Where `placed` holds an atom at each of its places, whole rows of it are taken."""
    every = np.arange(len(res))
    for k in order:
        norm2 = float(s[k] @ s[k])
        if norm2 == 0:
            continue
        if placed is not None:
            res += a[:, k, None] * placed[k][off[:, k]]
        elif len(some := np.flatnonzero(a[:, k])):
            res[some[:, None], off[some, k, None] + span] += a[some, k, None] * s[k]
        c = res @ banded[k] if banded is not None else _windows(res, len(span)) @ s[k]
        at = np.abs(c).argmax(axis=1)
        m = c[every, at]
        new = np.where(np.abs(m) > lam, np.sign(m) * (np.abs(m) - lam) / norm2, 0.0) if signed else np.where(m > lam, (m - lam) / norm2, 0.0)
        a[:, k] = new
        on = new != 0
        off[on, k] = at[on]
        if placed is not None:
            res -= new[:, None] * placed[k][at]
        elif len(some := np.flatnonzero(on)):
            res[some[:, None], at[some, None] + span] -= new[some, None] * s[k]


#: Points of a series up to which its products with an atom at all places are one with a banded matrix.
BANDED = 256


def _banded(s: np.ndarray, p: int) -> np.ndarray | None:
    """For each atom the matrix (points by places) that has it at each place; None for long series."""
    kk, q = s.shape
    if not 0 < q <= p <= BANDED:
        return None
    out, at = np.zeros((kk, p, p - q + 1)), np.arange(p - q + 1)
    for j in range(q):
        out[:, at + j, at] = s[:, j, None]
    return out


def update(x, s, a, off, c: float = 100.0, sweeps: int = 5, from_zero: bool = False):
    """Block coordinate descent on the atoms under |s_k|^2 <= c. By default a new atom adds to the old one; from_zero is the textbook form."""
    s = s.copy()
    kk, q = s.shape
    rows, span = np.arange(len(x))[:, None], np.arange(q)
    res = x - rebuild(s, a, off, x.shape[1])
    for _ in range(sweeps):
        for k in range(kk):
            n2 = float(a[:, k] @ a[:, k])
            if n2 == 0:
                continue
            place = off[:, k : k + 1] + span
            res[rows, place] += a[:, k : k + 1] * s[k]
            new = (np.zeros(q) if from_zero else s[k]) + a[:, k] @ res[rows, place]
            norm = float(np.linalg.norm(new))
            s[k] = new * (math.sqrt(c) / norm) if norm and n2 <= norm / math.sqrt(c) else new / n2
            res[rows, place] -= a[:, k : k + 1] * s[k]
    return s


def learn(x: np.ndarray, k: int, q: int, lam: float = 0.1, c: float = 100.0, eps: float = 1e-5, most: int = 1000, inner: int = 5, signed: bool = True, seed: int = 0, init: str = "chunks", from_zero: bool = False) -> Fit:
    rng = np.random.default_rng(seed)
    n, p = x.shape
    if init == "gauss":
        s = rng.standard_normal((k, q))
    else:
        at = rng.integers(0, p - q + 1, k)
        s = np.stack([x[i, t : t + q] for i, t in zip(rng.integers(0, n, k), at)])
        if init == "svd":  # the best rank-one form of one chunk is the chunk, up to its sign
            s = s * np.where(s[:, :1] < 0, -1.0, 1.0)
    a = rng.standard_normal((n, k)) if signed else rng.random((n, k))
    off = rng.integers(0, p - q + 1, (n, k))
    trace = [objective(x, s, a, off, lam)]
    for _ in range(most):
        a, off = code(x, s, a, off, lam, inner, eps, signed, rng)
        s = update(x, s, a, off, c, inner, from_zero)
        trace.append(objective(x, s, a, off, lam))
        if trace[-2] == 0 or abs(trace[-2] - trace[-1]) / trace[-2] < eps:
            break
    return Fit(s, a, off, trace)


def lagged_sums(x, a, off, q: int) -> np.ndarray:
    """All that the dictionary step and the objective need of some series, as one vector that adds up over series: per atom the windows at
    its offsets weighted by its coefficients; per pair of atoms the products of coefficients by the lag of offsets, where they overlap;
    the squares of the values; the absolute coefficients."""
    n, k = a.shape
    rows, span = np.arange(n), np.arange(q)
    at = np.stack([a[:, j] @ x[rows[:, None], off[:, j : j + 1] + span] for j in range(k)])
    lags = np.zeros((k, k, 2 * q - 1))
    for i in range(k):
        for j in range(k):
            lag, weight = off[:, j] - off[:, i], a[:, i] * a[:, j]
            near = (np.abs(lag) < q) & (weight != 0)
            lags[i, j] = np.bincount(lag[near] + q - 1, weight[near], 2 * q - 1)
    return np.concatenate([at.ravel(), lags.ravel(), [float((x**2).sum()), float(np.abs(a).sum())]])


def _parted(sums: np.ndarray, k: int, q: int):
    return sums[: k * q].reshape(k, q), sums[k * q : -2].reshape(k, k, 2 * q - 1), sums[-2], sums[-1]


def update_by_sums(s, sums, c: float = 100.0, sweeps: int = 5, from_zero: bool = False):
    """update(), from the sums of all series instead of the series."""
    s, (kk, q) = s.copy(), s.shape
    at, lags, _, _ = _parted(sums, kk, q)
    for _ in range(sweeps):
        for k in range(kk):
            n2 = lags[k, k, q - 1]
            if n2 == 0:
                continue
            others = sum((np.convolve(lags[k, j], s[j])[q - 1 : 2 * q - 1] for j in range(kk) if j != k), np.zeros(q))
            new = (np.zeros(q) if from_zero else s[k]) + at[k] - others
            norm = float(np.linalg.norm(new))
            s[k] = new * (math.sqrt(c) / norm) if norm and n2 <= norm / math.sqrt(c) else new / n2
    return s


def objective_by_sums(s, sums, lam: float) -> float:
    kk, q = s.shape
    at, lags, squares, l1 = _parted(sums, kk, q)
    both = sum(float(s[k] @ np.convolve(lags[k, j], s[j])[q - 1 : 2 * q - 1]) for k in range(kk) for j in range(kk))
    return float(0.5 * (squares - 2 * (at * s).sum() + both) + lam * l1)


def _still(trace: list[float], eps: float) -> bool:
    return len(trace) > 1 and (trace[-2] == 0 or abs(trace[-2] - trace[-1]) / abs(trace[-2]) < eps)


#: Values (series times points) of a label up to which one task learns its dictionary; a larger label is learned in passes over all tasks.
GROUP_VALUES = 1 << 22
#: Values of a block of series, as passes read and write them.
BLOCK_VALUES = 1 << 18
#: Labels, largest first, that get a task of their own; the others are dealt over as many tasks by hash.
TASKS = 256


def _by_label(values: dict):
    """values[label], null for other labels."""
    keys = [v for v in values if v is not None]
    at = F.array_position(F.array(*[F.lit(v) for v in keys]).cast("array<string>"), F.col("label")).cast("int") - 1
    found = F.get(F.array(*[F.lit(values[v]) for v in keys]).cast("array<bigint>"), at)
    return F.when(F.col("label").isNull(), F.lit(values.get(None)).cast("bigint")).otherwise(found)


def _uniform(seed: int, *key):
    return (F.pmod(F.xxhash64("vec_id", F.lit(seed), *key), F.lit(1 << 40)) + 0.5) / float(1 << 40)


def _drawn(rows: DataFrame, k: int, share: float, signed: bool, seed: int) -> DataFrame:
    """rows with first codes a and offsets off, drawn by hash of the id, so that neither order nor partitions matter."""
    each, last = F.sequence(F.lit(1), F.lit(k)), F.size("x") - F.ceil(F.size("x") * F.lit(float(share))) + 1
    if signed:
        a = F.transform(each, lambda i: F.sqrt(-2 * F.log(_uniform(seed, F.lit(1), i))) * F.cos(2 * math.pi * _uniform(seed, F.lit(2), i)))
    else:
        a = F.transform(each, lambda i: _uniform(seed, F.lit(1), i))
    off = F.transform(each, lambda i: F.floor(_uniform(seed, F.lit(3), i) * last))
    return rows.select("vec_id", "label", "x", a.alias("a"), off.alias("off"))


def _first_atoms(rows: DataFrame, k: int, share: float, seed: int, init: str) -> dict:
    """Label to its first atoms: chunks of the k series that come first by hash of the id (again from the first, of fewer), or normal draws."""
    if init not in ("chunks", "svd", "gauss"):
        raise ValueError(f"unknown start {init!r}: use chunks, svd or gauss")
    order = Window.partitionBy("label").orderBy(F.xxhash64("vec_id", F.lit(seed), F.lit("atoms")), "vec_id", "x")
    few = rows.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= k).withColumn("_u", _uniform(seed, F.lit("place")))
    found: dict = {}
    for r in sorted(few.collect(), key=lambda r: r["_r"]):
        found.setdefault(r["label"], []).append((np.array(r["x"], dtype=float), r["_u"]))
    atoms = {}
    for label, got in found.items():
        p = len(got[0][0])
        q = math.ceil(p * share)
        if init == "gauss":
            atoms[label] = np.random.default_rng(seed).standard_normal((k, q))
            continue
        places = max(1, p - q + (init == "chunks"))  # the rank-one start never takes the last place
        chunks = [got[j % len(got)] for j in range(k)]
        s = np.stack([x[t : t + q] for x, t in ((x, int((u + j / k) % 1 * places)) for j, (x, u) in enumerate(chunks))])
        atoms[label] = s * np.where(s[:, :1] < 0, -1.0, 1.0) if init == "svd" else s  # the best rank-one form of a chunk is the chunk, up to its sign
    return atoms


def _arrays(g: pd.DataFrame):
    return np.array(g.x.tolist(), dtype=float), np.array(g.a.tolist(), dtype=float), np.array(g.off.tolist(), dtype=np.int64)


_FIT = "label string, shapelet_id long, s array<double>, iterations long, objective double"


def _nones(n: int) -> pd.Series:
    return pd.Series([None] * n, dtype=object)


def _fitted(label, s, trace) -> pd.DataFrame:
    return pd.DataFrame({"label": label, "shapelet_id": range(len(s)), "s": list(s), "iterations": len(trace), "objective": trace[-1] if trace else None})


_BLOCK = "label string, n long, x binary, a binary, off binary, sums array<double>"


def _block(label, x, a, off) -> pd.DataFrame:
    return pd.DataFrame({"label": [label], "n": [len(x)], "x": [x.tobytes()], "a": [a.tobytes()], "off": [off.tobytes()], "sums": _nones(1)})


def _blocks(state: DataFrame, parts: dict) -> DataFrame:
    """The series of large labels with their codes as arrays of many series, each label in as many blocks as parts says. They are dealt by
    hash, so each task of a pass has its share, however the rows lay."""

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        label, (x, a, off) = None if pd.isna(g.label.iloc[0]) else g.label.iloc[0], _arrays(g)
        lot = max(1, BLOCK_VALUES // max(1, x.shape[1]))
        return pd.concat([_block(label, x[t : t + lot], a[t : t + lot], off[t : t + lot]) for t in range(0, len(x), lot)])

    part = F.pmod(F.xxhash64("vec_id", "x"), _by_label(parts))
    return state.withColumn("_part", part).groupBy("label", "_part").applyInPandas(pack, _BLOCK)


def _in_passes(state: DataFrame, atoms: dict, how: dict) -> dict:
    """Label to (atoms, objectives by iteration), from _blocks(). Each iteration is one pass: every task codes its blocks, writes them with
    their codes for the next one, and beside them its sums by label; only sums are shuffled."""
    spark, folder, done, traces = state.sparkSession, None, {}, {c: [] for c in atoms}
    from .tables import remove, shared_folder

    added = "label string, sums array<double>"

    def total(g: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"label": [g.label.iloc[0]], "sums": [np.sum(np.stack(g.sums.tolist()), axis=0)]})

    try:
        for turn in range(how["most"]):
            now = dict(atoms)

            def run(frames, now=now, turn=turn):
                sums: dict = {}
                for f in frames:
                    for r in f.itertuples():
                        label = None if pd.isna(r.label) else r.label
                        if label not in now:
                            continue
                        x, a, off = (np.frombuffer(v, kind).reshape(r.n, -1) for v, kind in ((r.x, np.float64), (r.a, np.float64), (r.off, np.int64)))
                        a, off = code(x, now[label], a, off, how["lam"], how["inner"], -1.0, how["signed"], np.random.default_rng([how["seed"], turn]))
                        sums[label] = sums.get(label, 0) + lagged_sums(x, a, off, now[label].shape[1])
                        yield _block(label, x, a, off)
                for label, v in sums.items():
                    yield pd.DataFrame({"label": [label], "n": [0], "x": _nones(1), "a": _nones(1), "off": _nones(1), "sums": [v]})

            last, folder = folder, shared_folder(spark, "learn")
            state.mapInPandas(run, _BLOCK).write.parquet(folder)
            read = spark.read.schema(_BLOCK).parquet(folder)
            if last:
                remove(spark, last)
            state = read.filter("n > 0")
            parts = read.filter("n = 0").select("label", "sums", F.pmod(F.spark_partition_id(), F.lit(64)).alias("_k"))
            for r in parts.groupBy("label", "_k").applyInPandas(total, added).groupBy("label").applyInPandas(total, added).collect():
                c, sums = r["label"], np.array(r["sums"])
                atoms[c] = update_by_sums(atoms[c], sums, how["c"], how["inner"], how["from_zero"])
                traces[c].append(objective_by_sums(atoms[c], sums, how["lam"]))
                if _still(traces[c], how["eps"]):
                    done[c] = atoms.pop(c)
            if not atoms:
                break
    finally:
        if folder:
            remove(spark, folder)
    return {c: (s, traces[c]) for c, s in {**done, **atoms}.items()}


def learn_dictionaries(
    rows: DataFrame, k: int = 5, lam: float = 0.1, share: float = 0.5, signed: bool = False, seed: int = 0, most: int = 1000,
    c: float = 100.0, eps: float = 1e-5, inner: int = 5, init: str = "chunks", from_zero: bool = False, pooled: bool = False, group_values: int = GROUP_VALUES,
) -> DataFrame:
    """label, shapelet_id, s, iterations, objective: one dictionary per label, or one of all rows if pooled (its label is null).

    rows: vec_id, label, x; a label's x are of one length, and rows without x count for nothing. Every series counts. A label of at most
    group_values values is learned in one task, a larger one in passes over all tasks; both ways draw and compute the same, up to the order of
    sums. An empty table gives an empty result."""
    label = F.lit(None).cast("string") if pooled else F.col("label").cast("string")
    rows = rows.filter("x is not null").select("vec_id", label.alias("label"), F.col("x").cast("array<double>").alias("x"))
    how = {"lam": lam, "c": c, "eps": eps, "most": most, "inner": inner, "signed": signed, "seed": seed, "from_zero": from_zero}
    sizes = {r["label"]: r["v"] for r in rows.groupBy("label").agg(F.sum(F.size("x")).alias("v")).collect()}
    large = {v: -(-n // BLOCK_VALUES) for v, n in sizes.items() if n > group_values}
    first, state = _first_atoms(rows, k, share, seed, init), _drawn(rows, k, share, signed, seed)
    is_large = _by_label(large).isNotNull()

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        name = None if pd.isna(g.label.iloc[0]) else g.label.iloc[0]
        (x, a, off), s, trace = _arrays(g), first[name], []
        for turn in range(most):
            a, off = code(x, s, a, off, lam, inner, -1.0, signed, np.random.default_rng([seed, turn]))
            sums = lagged_sums(x, a, off, s.shape[1])
            s = update_by_sums(s, sums, c, inner, from_zero)
            trace.append(objective_by_sums(s, sums, lam))
            if _still(trace, eps):
                break
        return _fitted(name, s, trace)

    order = sorted((v for v in sizes if v not in large), key=lambda v: (-sizes[v], v is None, v or ""))[:TASKS]
    tasks = max(1, len(order))
    place = F.coalesce(_by_label({v: n for n, v in enumerate(order)}), F.pmod(F.xxhash64("label"), F.lit(tasks))).cast("int")
    dealt = state.filter(~is_large).withColumn("_task", place).repartitionById(tasks, "_task")  # labels are few: by hash, some share a task beside idle ones
    small = dealt.groupBy("_task", "label").applyInPandas(fit, _FIT)
    if not large:
        return small
    got = _in_passes(_blocks(state.filter(is_large), large), {v: first[v] for v in large}, how)
    found = [(v, j, row.tolist(), len(t), t[-1] if t else None) for v, (s, t) in got.items() for j, row in enumerate(s)]
    return small.unionByName(rows.sparkSession.createDataFrame(found, _FIT))


def learn_grid(rows: DataFrame, grid: list[tuple[int, float, float]], **how) -> DataFrame:
    """The same for each (k, share, lam) of a grid, with these as columns."""
    out = None
    for k, share, lam in grid:
        one = learn_dictionaries(rows, k=k, share=share, lam=lam, **how).withColumns({"k": F.lit(k), "share": F.lit(share), "lam": F.lit(lam)})
        out = one if out is None else out.unionByName(one)
    return out


def code_each(x, s, a, off, lam, most: int = 1000, eps: float = 1e-5, signed: bool = False, seed: int = 0):
    """code() with a stop for each series: when a sweep changes its own objective by less than eps of it, so what a series gets doesn't
    depend on those beside it."""
    a, off, going, last = a.copy(), off.copy(), np.arange(len(x)), np.full(len(x), np.nan)
    for turn in range(most):
        some = x[going]
        a[going], off[going] = code(some, s, a[going], off[going], lam, 1, -1.0, signed, np.random.default_rng([seed, turn]))
        f = 0.5 * ((some - rebuild(s, a[going], off[going], x.shape[1])) ** 2).sum(axis=1) + lam * np.abs(a[going]).sum(axis=1)
        still = np.abs(last[going] - f) <= eps * last[going]
        last[going] = f
        going = going[~still]
        if not len(going):
            break
    return a, off


def encode(rows: DataFrame, dictionary: DataFrame, lam: float = 1.0, signed: bool = False, sweeps: int = 1000, seed: int = 0, eps: float = 1e-5) -> DataFrame:
    """vec_id, label, a, off, squared_error of every series: codes over a bounded dictionary (pos, s; atoms of one length) from a seeded
    start, swept until a series' objective stands still.

    A series shorter than the atoms has codes of 0 and the error of its own squares, a null one has codes of 0 and a null error. Without
    atoms all codes are empty. Series may differ in length."""
    s = [r.s for r in dictionary.orderBy("pos").select("s").collect()]
    s = np.array(s, dtype=float).reshape(len(s), len(s[0]) if s else 0)

    def coded(x: np.ndarray):
        n, k = len(x), len(s)
        a, off = np.zeros((n, k)), np.zeros((n, k), dtype=np.int64)
        if k and x.shape[1] >= s.shape[1]:
            rng = np.random.default_rng(seed)
            a[:] = rng.standard_normal(k) if signed else rng.random(k)
            off[:] = rng.integers(0, x.shape[1] - s.shape[1] + 1, k)
            a, off = code_each(x, s, a, off, lam, sweeps, eps, signed, seed)
            return a, off, ((x - rebuild(s, a, off, x.shape[1])) ** 2).sum(axis=1)
        return a, off, (x**2).sum(axis=1)

    def run(batches):
        for g in batches:
            sizes = g.x.map(lambda v: -1 if v is None else len(v))
            for size, own in g.groupby(sizes, sort=False):
                x = np.array([v for v in own.x] if size >= 0 else [()] * len(own), dtype=float).reshape(len(own), max(int(size), 0))
                a, off, error = coded(x)
                yield pd.DataFrame({"vec_id": own.vec_id, "label": own.label, "a": list(a), "off": list(off.astype(np.int32)), "squared_error": error if size >= 0 else np.full(len(own), None)})

    return rows.select("vec_id", "label", "x").mapInPandas(run, "vec_id long, label string, a array<double>, off array<int>, squared_error double")


def batch_error(encoded: DataFrame, by_label: bool = False) -> DataFrame:
    """Mean reconstruction error, over everything or by label."""
    return (encoded.groupBy("label") if by_label else encoded.groupBy()).agg(F.avg("squared_error").alias("error"))
