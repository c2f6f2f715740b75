"""Column expressions over numeric arrays. All run in the JVM; positions and offsets count from 0."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-8


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def mean(a: Column) -> Column:
    return total(a) / F.size(a)


def let(value: Column, use) -> Column:
    """use(value), with the value computed once rather than wherever a lambda of `use` needs it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def std_pop(a: Column) -> Column:
    return let(mean(a), lambda m: F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, v: s + (v - m) * (v - m)) / F.size(a)))


def znorm(a: Column) -> Column:
    """(v - mean) / population std, with 1 for a std of 0."""
    return let(F.struct(mean(a).alias("m"), std_pop(a).alias("s")), lambda e: F.transform(a, lambda v: (v - e["m"]) / F.when(e["s"] == 0, 1.0).otherwise(e["s"])))


def znorm_eps(a: Column) -> Column:
    """(v - mean) / (population std + 1e-8)."""
    return let(F.struct(mean(a).alias("m"), std_pop(a).alias("s")), lambda e: F.transform(a, lambda v: (v - e["m"]) / (e["s"] + EPS)))


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def squared_distance(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)))


def euclidean(a: Column, b: Column) -> Column:
    """Distance of arrays of one length; raises for arrays of different lengths."""
    return F.when(F.size(a) == F.size(b), F.sqrt(squared_distance(a, b))).otherwise(F.raise_error(F.lit("arrays differ in length")).cast("double"))


def euclidean_within(a: Column, b: Column, most: float = float("inf")) -> Column:
    """Distance, or infinity once the squared sum is above `most`."""
    d = squared_distance(a, b)
    return F.when(d > F.lit(most), F.lit(float("inf"))).otherwise(F.sqrt(d))


def strided(a: Column, share: float) -> Column:
    """Every int(1 / share)-th value for a share of 0.5 or less, else all of them."""
    step = int(1 / share) if share <= 0.5 else 1
    return a if step == 1 else F.filter(a, lambda v, i: i % step == 0)


def segments(a: Column, size) -> Column:
    """All windows of `size` neighbours."""
    n = F.size(a) - size
    return F.when(n >= 0, F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(a, i + 1, size))).otherwise(F.array().cast("array<array<double>>"))


def min_distance(x: Column, s: Column) -> Column:
    """Least distance of s to a window of x; infinity if s is longer."""
    n = F.size(x) - F.size(s)
    every = F.transform(F.sequence(F.lit(0), n), lambda i: F.sqrt(squared_distance(F.slice(x, i + 1, F.size(s)), s)))
    return F.when(n >= 0, F.array_min(every)).otherwise(F.lit(float("inf")))


def min_distance_znorm(x: Column, s: Column) -> Column:
    """The same with each window and s normalised; s is normalised once."""
    n = F.size(x) - F.size(s)
    every = let(znorm_eps(s), lambda z: F.transform(F.sequence(F.lit(0), n), lambda i: F.sqrt(squared_distance(znorm_eps(F.slice(x, i + 1, F.size(s))), z))))
    return F.when(n >= 0, F.array_min(every)).otherwise(F.lit(float("inf")))


def place(s: Column, offset: Column, size) -> Column:
    """s at an offset among zeros; raises if it doesn't fit."""
    fits = offset + F.size(s) <= size
    return F.when(fits, place_cut(s, offset, size)).otherwise(F.raise_error(F.lit("the atom does not fit")).cast("array<double>"))


def place_cut(s: Column, offset: Column, size) -> Column:
    """s at an offset among zeros; what doesn't fit is cut off."""
    return F.transform(F.sequence(F.lit(0), F.lit(size) - 1 if isinstance(size, int) else size - 1), lambda t: F.when((t >= offset) & (t < offset + F.size(s)), F.get(s, t - offset)).otherwise(0.0))


def correlations(x: Column, s: Column) -> Column:
    """Dot products of s with all windows of x."""
    return F.transform(F.sequence(F.lit(0), F.size(x) - F.size(s)), lambda i: dot(F.slice(x, i + 1, F.size(s)), s))


def best_offset(c: Column) -> Column:
    """The first place of the largest absolute value."""
    top = F.array_max(F.transform(c, lambda v: F.abs(v)))
    return (F.array_position(F.transform(c, lambda v: F.abs(v)), top) - 1).cast("int")


def soft_threshold(m: Column, lam, norm2: Column) -> Column:
    """sign(m) (|m| - lam) / norm2, or 0 if |m| <= lam."""
    return F.when(F.abs(m) <= lam, 0.0).otherwise(F.signum(m) * (F.abs(m) - lam) / norm2)


def nonneg_threshold(m: Column, lam, norm2: Column) -> Column:
    """(m - lam) / norm2, or 0 if m <= lam."""
    return F.when(m <= lam, 0.0).otherwise((m - lam) / norm2)


def interpolate(p: Column, q: Column, a: Column) -> Column:
    return (1 - a) * p + a * q


def percent_gain(a: Column, b: Column) -> Column:
    """(a - b) / a * 100; null for a = 0."""
    return F.try_divide(a - b, a) * 100
