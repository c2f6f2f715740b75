"""An incremental multilayer perceptron: one hidden layer, learned by Adam from gradients that tasks sum over their rows.

The weights are a bounded vector. Small batches are learned one after the other within a task, lot by lot. For a large batch the weights go
to the tasks with each step, and what comes back is one vector of sums a group of tasks, so rows
stay where they are. The state after each batch (weights, both moments, number of steps) is a row of a table.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tables import exists, remove, shared_folder

#: Vectors of sums that the driver adds up at most.
GROUPS = 32
#: Rows of consecutive batches that one task learns, one batch after the other.
LOT = 1 << 16
STATE = "batch long, steps long, weights array<double>, mean array<double>, spread array<double>"


def adam(weights: np.ndarray, mean: np.ndarray, spread: np.ndarray, g: np.ndarray, steps: int, rate: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Weights and both moments after the step of a number with the gradient g."""
    mean = 0.9 * mean + 0.1 * g
    spread = 0.999 * spread + 0.001 * g * g
    rate = rate * np.sqrt(1 - 0.999**steps) / (1 - 0.9**steps)
    return weights - rate * mean / (np.sqrt(spread) + 1e-8), mean, spread


@dataclass
class Perceptron:
    """Weights of inputs to hidden units (rectified) to classes (softmax), as one vector, with Adam's moments."""

    inputs: int
    classes: int
    hidden: int = 100
    rate: float = 1e-3
    penalty: float = 1e-4
    seed: int = 0
    steps: int = 0
    weights: np.ndarray = field(default=None)
    mean: np.ndarray = field(default=None)
    spread: np.ndarray = field(default=None)

    def __post_init__(self):
        if self.weights is None:
            rng, parts = np.random.default_rng(self.seed), []
            for a, b in ((self.inputs, self.hidden), (self.hidden, self.classes)):
                most = np.sqrt(6 / (a + b))
                parts += [rng.uniform(-most, most, a * b), rng.uniform(-most, most, b)]
            self.weights = np.concatenate(parts)
        if self.mean is None:
            self.mean, self.spread = np.zeros_like(self.weights), np.zeros_like(self.weights)

    def layers(self, w: np.ndarray):
        i, h, c = self.inputs, self.hidden, self.classes
        a, b, d, e = np.split(w, np.cumsum([i * h, h, h * c]))
        return a.reshape(i, h), b, d.reshape(h, c), e

    def shares(self, x: np.ndarray) -> np.ndarray:
        a, b, d, e = self.layers(self.weights)
        z = np.maximum(x @ a + b, 0) @ d + e
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)

    def predict(self, x: np.ndarray) -> np.ndarray:
        return self.shares(x).argmax(axis=1)

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Of rows: the gradient of the summed loss, the loss, the number of rows; without the penalty."""
        a, b, d, e = self.layers(self.weights)
        u = x @ a + b
        h = np.maximum(u, 0)
        p = self.shares(x)
        loss = -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum()
        p[np.arange(len(y)), y] -= 1
        back = (p @ d.T) * (u > 0)
        return np.concatenate([(x.T @ back).ravel(), back.sum(axis=0), (h.T @ p).ravel(), p.sum(axis=0), [loss, len(y)]])

    def step(self, sums: np.ndarray) -> float:
        """One Adam step from summed sums(); the mean loss with its penalty, before the step."""
        n = sums[-1]
        if n == 0:
            return float("nan")
        a, b, d, e = self.layers(self.weights)
        decay = np.concatenate([a.ravel(), np.zeros(len(b)), d.ravel(), np.zeros(len(e))])
        g = (sums[:-2] + self.penalty * decay) / n
        self.steps += 1
        self.weights, self.mean, self.spread = adam(self.weights, self.mean, self.spread, g, self.steps, self.rate)
        return float((sums[-2] + 0.5 * self.penalty * (decay**2).sum()) / n)


def _usable(f: pd.DataFrame, inputs: int) -> tuple[np.ndarray, np.ndarray]:
    return np.nan_to_num(np.array(f.features.tolist(), dtype=float).reshape(len(f), inputs), posinf=0.0, neginf=0.0), f.target.to_numpy().astype(np.int64)


def gradient(net: Perceptron, rows: DataFrame) -> np.ndarray:
    """Perceptron.sums() of all rows (features, target): tasks sum theirs, groups of tasks theirs, the driver at most GROUPS vectors."""

    def own(frames):
        total = np.zeros(len(net.weights) + 2)
        for f in frames:
            for k in range(0, len(f), 4096):
                if len(part := f.iloc[k : k + 4096]):
                    total += net.sums(*_usable(part, net.inputs))
        if total[-1]:
            yield pd.DataFrame({"g": [total]})

    def added(f: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"g": [np.sum(np.stack(f.g.tolist()), axis=0)]})

    parts = rows.select("features", "target").mapInPandas(own, "g array<double>").withColumn("_g", F.pmod(F.spark_partition_id(), F.lit(GROUPS)))
    parts = parts.groupBy("_g").applyInPandas(added, "g array<double>")
    got = [np.array(r.g) for r in parts.collect()]
    return np.sum(got, axis=0) if got else np.zeros(len(net.weights) + 2)


def with_prediction(net: Perceptron, rows: DataFrame, name: str) -> DataFrame:
    """rows with the class that net predicts from features."""

    @F.pandas_udf("long")
    def run(x: pd.Series) -> pd.Series:
        f = pd.DataFrame({"features": x, "target": 0})
        return pd.Series(net.predict(_usable(f, net.inputs)[0])) if len(f) else pd.Series([], dtype="int64")

    return rows.withColumn(name, run("features"))


def lots_of(counts: list[tuple[int, int]], most: int) -> list[list[int]]:
    """Batches (number, rows) in order, put together while they have at most `most` rows; a larger one is alone."""
    out, held = [], most + 1
    for b, n in sorted(counts):
        if held + n > most:
            out.append([])
            held = 0
        out[-1].append(b)
        held += n
    return out


def _learn_lot(net: Perceptron, parts: int, every: bool, last: int, ids: str):
    """A function of frames in order of their batch: rows with both predictions, then a row of the state (after each batch, or the last)."""

    def run(frames):
        own, held = Perceptron(**net.__dict__), None

        def learned(f: pd.DataFrame):
            b, (x, y), part = int(f.batch.iloc[0]), _usable(f, own.inputs), f.part.to_numpy()
            before = own.predict(x)
            for k in range(parts):
                own.step(own.sums(x[part == k], y[part == k]))
            scored = pd.DataFrame({"batch": b, "id": f.id, "y": y, "p_before": before, "p_after": own.predict(x)})
            yield scored.assign(steps=pd.array([None] * len(f), dtype="Int64"), weights=None, mean=None, spread=None)
            if every or b == last:
                yield pd.DataFrame({"batch": [b], "id": [None], "y": [None], "p_before": [None], "p_after": [None], "steps": [own.steps], "weights": [own.weights], "mean": [own.mean], "spread": [own.spread]})

        for f in frames:
            held = f if held is None else pd.concat([held, f])
            ends = np.flatnonzero(np.diff(held.batch.to_numpy())) + 1
            for a, z in zip([0, *ends], ends):
                yield from learned(held.iloc[a:z])
            held = held.iloc[ends[-1] :] if len(ends) else held
        if held is not None and len(held):
            yield from learned(held)

    return run, f"batch long, id {ids}, y long, p_before long, p_after long, {STATE.removeprefix('batch long, ')}"


def learn_in_batches(rows: DataFrame, net: Perceptron, parts: int = 3, folder: str | None = None, lot: int = LOT, every: bool = True) -> tuple[DataFrame, DataFrame]:
    """Prequential learning: (batch, id, y, p_before, p_after) of every row, and the table of states after each batch (every: else only
    after the last batch of each lot).

    rows: batch, id, features (arrays of net.inputs), target. Batches are learned in order, each in `parts` mini-batches drawn by hash of the id,
    a step each; a batch is scored before and after it is learned. Each step needs the weights of the one before, so consecutive batches
    of at most `lot` rows together are streamed through one task, and a larger batch is learned by gradients of all tasks; both ways
    compute the same, up to the order of sums. Rows without features or target take no part. The tables are in a new folder under
    spark.checkpoint.dir; with the folder of a run that was stopped, it goes on after the last lot whose last state was written."""
    spark = rows.sparkSession
    folder = folder or shared_folder(spark, "perceptron")
    ids = dict(rows.dtypes)["id"]
    every_row, source = f"{folder}/all", f"{folder}/rows"
    if not exists(spark, f"{every_row}/_SUCCESS"):
        known = rows.filter(F.col("features").isNotNull() & F.col("target").isNotNull()).withColumn("part", F.pmod(F.xxhash64("id"), F.lit(parts)))
        known.select("batch", "id", "target", "features", "part").write.mode("overwrite").parquet(every_row)
    kept = spark.read.schema(f"batch long, id {ids}, target long, features array<double>, part long").parquet(every_row)
    counts = [(r[0], r[1]) for r in kept.groupBy("batch").agg(F.count("*")).collect()]  # two numbers for each batch
    sizes, lots = dict(counts), lots_of(counts, lot)
    if lots and not exists(spark, f"{source}/_SUCCESS"):
        of = spark.createDataFrame([(b, k) for k, own in enumerate(lots) for b in own], "batch long, lot long")
        kept.join(F.broadcast(of), "batch").write.mode("overwrite").partitionBy("lot").parquet(source)
    for k, batches in enumerate(lots):
        last, at = batches[-1], f"{folder}/states/batch={batches[-1]}"
        if exists(spark, f"{at}/_SUCCESS"):
            net = restored(net, spark.read.parquet(at).first())
            continue
        own = spark.read.schema(kept.schema).parquet(f"{source}/lot={k}")
        scored, state = f"{folder}/scored/lot={k}", STATE.removeprefix("batch long, ")
        if sizes[last] > lot:
            before = Perceptron(**net.__dict__)
            for j in range(parts):
                net.step(gradient(net, own.filter(F.col("part") == j)))
            both = with_prediction(net, with_prediction(before, own, "p_before"), "p_after")
            both.select("batch", "id", F.col("target").alias("y"), "p_before", "p_after").write.mode("overwrite").parquet(scored)
            row = [(net.steps, net.weights.tolist(), net.mean.tolist(), net.spread.tolist())]
            spark.createDataFrame(row, state).coalesce(1).write.mode("overwrite").parquet(at)
            continue
        run, kind = _learn_lot(net, parts, every, last, ids)
        out = f"{folder}/learned/lot={k}"
        own.coalesce(1).sortWithinPartitions("batch", "id").mapInPandas(run, kind).write.mode("overwrite").parquet(out)
        got = spark.read.schema(kind).parquet(out)
        got.filter("steps is null").select("batch", "id", "y", "p_before", "p_after").write.mode("overwrite").parquet(scored)
        states = got.filter("steps is not null").select(*[c.split()[0] for c in STATE.split(", ")])
        states.filter(F.col("batch") != last).write.mode("overwrite").parquet(f"{folder}/earlier/lot={k}")
        states.filter(F.col("batch") == last).drop("batch").coalesce(1).write.mode("overwrite").parquet(at)
        net = restored(net, spark.read.parquet(at).first())
        remove(spark, out)
    found = f"batch long, id {ids}, y long, p_before long, p_after long"
    if not lots:
        return spark.createDataFrame([], found), spark.createDataFrame([], STATE)
    states = spark.read.schema(STATE).parquet(f"{folder}/states")
    if exists(spark, f"{folder}/earlier"):
        states = states.unionByName(spark.read.schema(STATE).parquet(f"{folder}/earlier").select(*states.columns))
    return spark.read.schema(found).parquet(f"{folder}/scored").drop("lot"), states


def restored(net: Perceptron, state) -> Perceptron:
    """net with the weights and moments of a row of the table of states."""
    own = {**net.__dict__, "steps": state.steps} | {k: np.array(state[k]) for k in ("weights", "mean", "spread")}
    return Perceptron(**own)
