"""Sparse codes over a dictionary: coordinate steps, objective, reconstruction error and the dictionary step."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import arrays as A
from .series import atoms_of, lots_by_size


#: Rows of an Arrow batch whose correlations are taken at once.
LOT = 512


def _one_step(x: np.ndarray, s: np.ndarray, lam: float, signed: bool):
    """a, off, m of one atom for every row of x. The products of a place add up in order, so equal windows tie, as in the SQL."""
    places = x.shape[1] - len(s) + 1
    c = np.zeros((len(x), places))
    for j, v in enumerate(s):
        c += x[:, j : j + places] * v
    at = np.abs(c).argmax(axis=1)
    m = c[np.arange(len(x)), at]
    size = np.abs(m) if signed else m
    on = size > lam
    a = np.zeros(len(x))
    a[on] = np.sign(m[on]) * (size[on] - lam) / (s @ s)
    return a, np.where(on, at, 0), m


def _add(recon: np.ndarray, s: np.ndarray, a: np.ndarray, off: np.ndarray) -> None:
    some = np.flatnonzero(a)
    recon[some[:, None], off[some, None] + np.arange(len(s))] += a[some, None] * s


def _step(rows: DataFrame, atoms: list[np.ndarray], lam: float, signed: bool) -> DataFrame:
    """vec_id, label, x with a, off, m and recon: one coordinate step for every atom from zero codes, in Arrow batches. A series that is
    null or shorter than an atom has no code of it."""

    @F.pandas_udf("struct<a:array<double>,off:array<int>,m:array<double>,recon:array<double>>")
    def run(x: pd.Series) -> pd.DataFrame:
        out = np.empty((4, len(x)), dtype=object)
        for at, v in lots_by_size(x, LOT):
            a, off, m = np.zeros((len(v), len(atoms))), np.zeros((len(v), len(atoms)), dtype=np.int32), np.zeros((len(v), len(atoms)))
            recon = np.zeros(v.shape)
            for k, s in enumerate(atoms):
                if v.shape[1] >= len(s):
                    a[:, k], off[:, k], m[:, k] = _one_step(v, s, lam, signed)
                    _add(recon, s, a[:, k], off[:, k])
            for column, values in zip(out, (a, off, m, recon)):
                for i, own in zip(at, values):
                    column[i] = own
        return pd.DataFrame(dict(zip(("a", "off", "m", "recon"), out)))

    return rows.select("vec_id", "label", "x", run("x").alias("c")).select("vec_id", "label", "x", "c.*")


def one_step_codes(rows: DataFrame, dictionary: DataFrame, lam: float = 0.1, signed: bool = True) -> DataFrame:
    """One coordinate step from zero codes: for each series and atom the offset of the largest absolute correlation and the
    thresholded coefficient there. Returns series_id, label, k, a, off, m."""
    names, atoms = atoms_of(dictionary)
    each = _step(rows, atoms, lam, signed).select(F.col("vec_id").alias("series_id"), "label", F.posexplode(F.arrays_zip("a", "off", "m")).alias("_k", "_c"))
    pos = F.get(F.array(*[F.lit(r["pos"]) for r in names]).cast("array<bigint>"), F.col("_k"))
    return each.select("series_id", "label", pos.alias("k"), "_c.a", "_c.off", "_c.m")


def one_step_terms(rows: DataFrame, dictionary: DataFrame, lam: float = 0.1, signed: bool = True) -> DataFrame:
    """residual_terms() of one_step_codes(), in the pass that makes the codes: nothing is shuffled."""
    c = _step(rows, atoms_of(dictionary)[1], lam, signed)
    return c.select(F.col("vec_id").alias("series_id"), "x", "recon", F.aggregate("a", F.lit(0.0), lambda t, v: t + F.abs(v)).alias("l1"))


def one_step_ranks(rows: DataFrame, dictionary: DataFrame, lam: float = 0.1, signed: bool = True) -> DataFrame:
    """k, r: the rank (from 0) of every atom in every series by the size of its code, as ranking.rank_coefficients() ranks
    one_step_codes(); one row of codes a series is shuffled instead of one for each atom."""
    names, atoms = atoms_of(dictionary)
    pos = F.array(*[F.lit(r["pos"]) for r in names]).cast("array<bigint>")
    sized = F.zip_with("a", pos, lambda a, k: F.struct((~F.isnan(a)).alias("known"), (-F.abs(a)).alias("size"), k.alias("k")))
    c = _step(rows, atoms, lam, signed).select("vec_id", sized.alias("c")).groupBy("vec_id").agg(F.array_sort(F.flatten(F.collect_list("c"))).alias("c"))
    return c.select(F.posexplode("c").alias("r", "c")).select("c.k", "r")


def one_step_objectives(rows: DataFrame, dictionaries: dict[str, DataFrame], lam: float = 0.1, signed: bool = True) -> DataFrame:
    """name, objective, n for each dictionary: objective() of one_step_terms() over it and the number of series with values, in one pass
    over the rows for all dictionaries. What they have in common is correlated once."""
    banks = {name: atoms_of(d)[1] for name, d in dictionaries.items()}
    atoms = {s.tobytes(): s for bank in banks.values() for s in bank}
    order = [[s.tobytes() for s in bank] for bank in banks.values()]

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = np.empty(len(x), dtype=object)
        for at, v in lots_by_size(x, LOT):
            coded = {key: _one_step(v, s, lam, signed)[:2] for key, s in atoms.items() if v.shape[1] >= len(s)}
            own = np.zeros((len(v), len(order)))
            for b, keys in enumerate(order):
                recon = np.zeros(v.shape)
                for key in keys:
                    if key in coded:
                        _add(recon, atoms[key], *coded[key])
                        own[:, b] += lam * np.abs(coded[key][0])
                own[:, b] += 0.5 * ((v - recon) ** 2).sum(axis=1)
            for i, values in zip(at, own):
                out[i] = values
        return pd.Series(out)

    sums = rows.filter(F.size("x") > 0).select(run("x").alias("t")).agg(F.count("*").alias("n"), F.array(*[F.sum(F.get("t", F.lit(b))) for b in range(len(banks))]).alias("t"))
    names = F.array(*[F.lit(name) for name in banks])
    return sums.select("n", F.explode(F.arrays_zip(names.alias("name"), F.col("t").alias("objective"))).alias("e")).select("e.name", "e.objective", "n")


def residual_terms(rows: DataFrame, codes: DataFrame, dictionary: DataFrame) -> DataFrame:
    """series_id, x, recon, l1, from codes of any source; a series' codes are one bounded array (one entry per atom)."""
    names, atoms = atoms_of(dictionary)
    of = {r["pos"]: s for r, s in zip(names, atoms)}

    @F.pandas_udf("array<double>")
    def rebuilt(x: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for v, c in zip(x, codes):
            recon = np.zeros(len(v))
            for e in c:
                place = recon[e["off"] : e["off"] + len(of[e["k"]])]
                place += e["a"] * of[e["k"]][: len(place)]
            out.append(recon)
        return pd.Series(out, dtype=object)

    c = codes.groupBy("series_id").agg(F.array_sort(F.collect_list(F.struct("k", "a", "off"))).alias("codes"))
    r = rows.join(c, rows["vec_id"] == c["series_id"])
    return r.select("series_id", "x", rebuilt("x", "codes").alias("recon"), F.aggregate("codes", F.lit(0.0), lambda t, e: t + F.abs(e["a"])).alias("l1"))


def objective(terms: DataFrame, lam: float) -> DataFrame:
    """Sum over series of half the squared residual plus lam times the codes' absolute sum."""
    return terms.agg(F.sum(0.5 * A.squared_distance(F.col("x"), F.col("recon")) + lam * F.col("l1")).alias("objective"))


def reconstruction_error(terms: DataFrame) -> DataFrame:
    """Mean over series of the squared residual."""
    return terms.agg(F.avg(A.squared_distance(F.col("x"), F.col("recon"))).alias("error"))


def dictionary_step(rows: DataFrame, codes: DataFrame, terms: DataFrame, dictionary: DataFrame, c: float = 100.0, from_zero: bool = False) -> DataFrame:
    """One step for every atom at once: s_k (or 0) plus the coefficient-weighted residuals at its offsets, scaled by 1/|A_k|^2, or to
    norm sqrt(c) where it would be longer. Atoms with no coefficient stay. Sums are grouped by (k, place), partially at the source."""
    d = dictionary.select(F.col("pos").alias("k"), "s")
    j = codes.filter("a <> 0").join(terms.select("series_id", "x", "recon"), "series_id").join(F.broadcast(d), "k")
    own = F.zip_with(F.slice(F.zip_with("x", "recon", lambda u, v: u - v), F.col("off") + 1, F.size("s")), F.col("s"), lambda u, v: F.col("a") * (u + F.col("a") * v))
    sums = j.select("k", "a", F.posexplode(own).alias("i", "v")).groupBy("k", "i").agg(F.sum("v").alias("v"), F.sum(F.col("a") * F.col("a")).alias("n2"))
    got = sums.groupBy("k").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda e: e["v"]).alias("v"), F.max("n2").alias("n2"))
    raw = F.col("v") if from_zero else F.zip_with("s", "v", lambda u, v: u + v)
    full = d.join(got, "k", "left").withColumn("raw", raw)
    norm = F.sqrt(A.dot(F.col("raw"), F.col("raw")))
    scale = F.when(F.col("n2") <= norm / F.sqrt(F.lit(c)), F.sqrt(F.lit(c)) / norm).otherwise(1 / F.col("n2"))
    return full.select("k", F.when(F.col("n2").isNull(), F.col("s")).otherwise(F.transform("raw", lambda v: v * scale)).alias("s"))
