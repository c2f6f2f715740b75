"""A fully convolutional network over series: three convolutions with batch normalisation, the mean over time, and a linear layer.

Rows are dealt by hash of their id to mini-batches and, within these, to lots of a bounded number of values. A task sums the gradients of
its lots; one vector of sums a group of tasks comes back, and the driver makes the Adam step. Batch normalisation takes the mean and variance
of a lot while learning and their running means when predicting, so a result depends on ids alone, not on partitions. The state after each
epoch is a row of a table, from which a run that was stopped goes on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .neural import GROUPS, adam
from .tables import exists, shared_folder

STATE = "epoch long, steps long, loss double, weights array<double>, mean array<double>, spread array<double>, running array<double>"
#: Values of the series of a lot: its columns for the widest layer are about 800 numbers each.
LOT_VALUES = 1 << 13
#: Tasks of a step at most.
TASKS = 256
EPSILON, MOMENTUM = 1e-5, 0.1


def windows(x: np.ndarray, width: int) -> np.ndarray:
    """Of (series, time, channels): all windows of a width, padded by half of it with zeros, as (series, time, channels * width)."""
    padded = np.pad(x, ((0, 0), (width // 2, width // 2), (0, 0)))
    cut = np.lib.stride_tricks.sliding_window_view(padded, width, axis=1)
    return cut.reshape(*cut.shape[:2], -1)


def unwindowed(g: np.ndarray, width: int, length: int) -> np.ndarray:
    """The gradient of windows() with respect to its series."""
    n, m = g.shape[:2]
    g = g.reshape(n, m, -1, width)
    out = np.zeros((n, length + 2 * (width // 2), g.shape[2]))
    for k in range(width):
        out[:, k : k + m] += g[..., k]
    return out[:, width // 2 : width // 2 + length]


@dataclass
class Network:
    """Weights as one vector (of each layer: kernel, bias, scale, shift; then the linear layer), Adam's moments, running statistics."""

    classes: int
    channels: int = 1
    filters: tuple[int, ...] = (128, 256, 128)
    widths: tuple[int, ...] = (7, 5, 3)
    rate: float = 1e-3
    seed: int = 0
    steps: int = 0
    weights: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    spread: np.ndarray = field(default=None)
    running: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.weights is None:
            rng, parts = np.random.default_rng(self.seed), []
            for shape in self.shapes():
                inputs = self.inputs[len(parts) // 4]
                first = len(parts) % 4 < 2  # kernels and biases are drawn within the root of their inputs
                parts.append(rng.uniform(-1, 1, shape) / np.sqrt(inputs) if first else np.full(shape, 1.0 - (len(parts) % 4 - 2)))
            self.weights = np.concatenate([p.ravel() for p in parts])
        if self.mean is None:
            self.mean, self.spread = np.zeros_like(self.weights), np.zeros_like(self.weights)
        if self.running is None:
            self.running = np.concatenate([np.r_[np.zeros(f), np.ones(f)] for f in self.filters])

    @property
    def inputs(self) -> list[int]:
        return [c * w for c, w in zip((self.channels, *self.filters), (*self.widths, 1))]

    def shapes(self) -> list[tuple[int, ...]]:
        inner = [s for i, f in zip(self.inputs, self.filters) for s in ((i, f), (f,), (f,), (f,))]
        return [*inner, (self.inputs[-1], self.classes), (self.classes,)]

    def unpacked(self) -> list[np.ndarray]:
        shapes = self.shapes()
        ends = np.cumsum([int(np.prod(s)) for s in shapes])[:-1]
        return [p.reshape(s) for p, s in zip(np.split(self.weights, ends), shapes)]

    def forward(self, x: np.ndarray, learning: bool):
        """Shares of the classes; what backward needs of each layer; the statistics of the lot (means and variances of each layer)."""
        parts, kept, seen, at = self.unpacked(), [], [], 0
        for k, width in enumerate(self.widths):
            kernel, bias, scale, shift = parts[4 * k : 4 * k + 4]
            cut = windows(x, width)
            z = cut @ kernel + bias
            f = len(bias)
            if learning:
                m, v = z.mean(axis=(0, 1)), z.var(axis=(0, 1))
                n = z.shape[0] * z.shape[1]
                seen.append(np.r_[m, v * n / max(1, n - 1)])
            else:
                m, v = self.running[at : at + f], self.running[at + f : at + 2 * f]
            at += 2 * f
            root = np.sqrt(v + EPSILON)
            z = (z - m) / root
            y = z * scale + shift
            kept.append((cut, z, root, y > 0, x.shape[1]))
            x = np.maximum(y, 0)
        pooled = x.mean(axis=1)
        z = pooled @ parts[-2] + parts[-1]
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True), (kept, pooled, x.shape[1]), np.concatenate(seen) if seen else None

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.forward(x, False)[0].argmax(axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of a lot: the gradient of the summed loss, its statistics times its rows, the loss, the number of rows."""
        parts = self.unpacked()
        p, (kept, pooled, length), seen = self.forward(x, True)
        rows = np.arange(len(y))
        loss = -np.log(np.maximum(p[rows, y], 1e-300)).sum()
        p[rows, y] -= 1
        found = [p.sum(axis=0), pooled.T @ p]  # from the last part to the first
        back = np.repeat((p @ parts[-2].T / length)[:, None], length, axis=1)
        for k in reversed(range(len(self.widths))):
            kernel, _, scale, _ = parts[4 * k : 4 * k + 4]
            cut, z, root, on, before = kept[k]
            back = back * on
            found += [back.sum(axis=(0, 1)), (back * z).sum(axis=(0, 1))]
            g = back * scale
            g = (g - g.mean(axis=(0, 1)) - z * (g * z).mean(axis=(0, 1))) / root
            found += [g.sum(axis=(0, 1)), np.tensordot(cut, g, axes=((0, 1), (0, 1)))]
            if k:
                back = unwindowed(g @ kernel.T, self.widths[k], before)
        return np.concatenate([*[f.ravel() for f in reversed(found)], len(y) * seen, [loss, len(y)]])

    def step(self, sums: np.ndarray) -> float:
        """One Adam step from summed sums(); the mean loss before it."""
        n, w = sums[-1], len(self.weights)
        if n == 0:
            return float("nan")
        self.steps += 1
        self.weights, self.mean, self.spread = adam(self.weights, self.mean, self.spread, sums[:w] / n, self.steps, self.rate)
        self.running = (1 - MOMENTUM) * self.running + MOMENTUM * sums[w:-2] / n
        return float(sums[-2] / n)


def shaped(x: pd.Series, channels: int) -> np.ndarray:
    """Series of one length, channel after channel, as (series, time, channels)."""
    return np.array(x.tolist(), dtype=float).reshape(len(x), channels, -1).transpose(0, 2, 1)


def _usable(x, channels: int):
    """Not null, not empty, whole channels, and no value that is null or not finite."""
    odd = F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")))
    return F.coalesce((F.size(x) > 0) & (F.size(x) % channels == 0) & ~odd, F.lit(False))


def gradient(net: Network, rows: DataFrame, lots: int) -> np.ndarray:
    """Network.sums() over the lots of rows (id, lot, x, target): tasks sum theirs in order, groups of tasks theirs, the driver at most GROUPS vectors."""

    def total(f: pd.DataFrame) -> np.ndarray:
        f = f.sort_values("id", kind="stable")
        return sum(net.sums(shaped(part.x, net.channels), part.target.to_numpy().astype(np.int64)) for _, part in f.groupby(f.x.map(len), sort=True))

    def own(frames):
        got, held = 0.0, []
        for f in frames:
            for _, part in f.groupby("lot", sort=True):  # sorted by lot: one goes on from a batch to the next
                if held and held[0].lot.iat[0] != part.lot.iat[0]:
                    got, held = got + total(pd.concat(held)), []
                held.append(part)
        if held:
            got = got + total(pd.concat(held))
            yield pd.DataFrame({"first": [held[0].lot.iat[0]], "g": [got]})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("first")
        return pd.DataFrame({"first": f["first"][:1], "g": [np.sum(np.stack(f.g.tolist()), axis=0)]})

    dealt = rows.select("id", "lot", "x", "target").repartition(min(lots, TASKS), "lot").sortWithinPartitions("lot")
    parts = dealt.mapInPandas(own, "first long, g array<double>").withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    got = [np.array(r.g) for r in sorted(parts.groupBy("_g").applyInPandas(added, "first long, g array<double>").collect())]
    return np.sum(got, axis=0) if got else np.zeros(len(net.weights) + len(net.running) + 2)


def fit(rows: DataFrame, net: Network, epochs: int = 10, steps: int = 8, folder: str | None = None, lot_values: int = LOT_VALUES) -> tuple[Network, DataFrame]:
    """net after learning from rows (id, x, target), and the table of states after each epoch with the epoch's mean loss.

    x: array of numbers, channel after channel; lengths may differ (a lot is normalised by length). target: class from 0. Rows with a null id,
    target or series, or with values that aren't finite, take no part; repeated rows count as often as they come. An empty table leaves net as it
    is. steps: mini-batches of an epoch; how many lots these have follows from the table. The tables are in a new folder under
    spark.checkpoint.dir; with the folder of a run that was stopped, it goes on after the last epoch that was written."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "network")
    source = f"{folder}/rows"
    known = rows.select("id", F.col("x").cast("array<double>").alias("x"), F.col("target").cast("long").alias("target"))
    known = known.filter(F.col("id").isNotNull() & F.col("target").isNotNull() & _usable(F.col("x"), net.channels))
    if not exists(spark, f"{source}/_SUCCESS"):
        known.withColumn("step", F.pmod(F.xxhash64("id"), F.lit(steps))).write.mode("overwrite").partitionBy("step").parquet(source)
    data = spark.read.schema(f"id {dict(known.dtypes)['id']}, x array<double>, target long, step long").parquet(source)
    values = data.agg(F.sum(F.size("x"))).first()[0] or 0
    lots = max(1, -(-values // (steps * lot_values)))
    data = data.withColumn("lot", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lots)))
    for e in range(epochs if values else 0):
        state = f"{folder}/states/epoch={e}"
        if exists(spark, f"{state}/_SUCCESS"):
            net = restored(net, spark.read.parquet(state).first())
            continue
        losses = [net.step(gradient(net, data.filter(F.col("step") == s), lots)) for s in range(steps)]
        own = [v.tolist() for v in (net.weights, net.mean, net.spread, net.running)]
        spark.createDataFrame([(net.steps, float(np.nanmean(losses)), *own)], STATE.removeprefix("epoch long, ")).coalesce(1).write.mode("overwrite").parquet(state)
    if not exists(spark, f"{folder}/states"):
        return net, spark.createDataFrame([], STATE)
    return net, spark.read.schema(STATE).parquet(f"{folder}/states")


def restored(net: Network, state) -> Network:
    """net with the weights, moments and statistics of a row of the table of states."""
    return Network(**{**net.__dict__, "steps": state.steps} | {k: np.array(state[k]) for k in ("weights", "mean", "spread", "running")})


def with_class(net: Network, rows: DataFrame, name: str = "prediction") -> DataFrame:
    """rows with the class that net predicts from x; null where x is null, empty or holds what is no finite number."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(x), dtype="Int64")
        for size, part in x.groupby(x.map(lambda v: -1 if v is None else len(v))):
            if size > 0:
                for s in range(0, len(part), most := max(1, LOT_VALUES // int(size))):
                    some = part.iloc[s : s + most]
                    out[some.index] = net.predict(shaped(some, net.channels))
        return out

    x = F.col("x").cast("array<double>")
    return rows.withColumn(name, run(F.when(_usable(x, net.channels), x)))
