"""The online loop on Structured Streaming: count batches, features, test, drift rule, dictionary update, training.

count_windows.keyed_loops() runs the same loop by key, on the executors. Here one loop is run on the driver. State is the dictionary, the reference error, the model, and the rows that wait for a full batch. start() writes it with the number of
each micro-batch and takes the last one up again, so a query that is stopped or fails goes on where it was, and a micro-batch that
comes again gives the same rows in the same place. replay() is the same loop over a finished table.
"""

from __future__ import annotations

import math
import pickle
from dataclasses import dataclass, field
from itertools import groupby

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import learning, policies, tables
from ..operators.models import LinearSgd

RESULT = "batch long, accuracy double, f1_score double, precision double, kappa double, drift_detected boolean"


def znorm_rows(x: np.ndarray) -> np.ndarray:
    s = x.std(axis=1, keepdims=True)
    return (x - x.mean(axis=1, keepdims=True)) / np.where(s == 0, 1.0, s)


def transform(x: np.ndarray, bank: np.ndarray) -> np.ndarray:
    q = bank.shape[1]
    z = (bank - bank.mean(axis=1, keepdims=True)) / (bank.std(axis=1, keepdims=True) + 1e-8)
    w = np.lib.stride_tricks.sliding_window_view(x, q, axis=1)
    w = (w - w.mean(axis=2, keepdims=True)) / (w.std(axis=2, keepdims=True) + 1e-8)
    return np.stack([np.sqrt(np.einsum("nij,nij->ni", e, e).min(axis=1)) for e in (w - a for a in z)], axis=1)


def metrics(y, p) -> tuple[float, float, float, float]:
    """Accuracy, macro F1, macro precision, kappa (nan where chance agreement is 1)."""
    classes = sorted({*y, *p})
    tp = np.array([sum((a == c) and (b == c) for a, b in zip(y, p)) for c in classes], dtype=float)
    nt, np_ = np.array([list(y).count(c) for c in classes], dtype=float), np.array([list(p).count(c) for c in classes], dtype=float)
    po, pe = tp.sum() / len(y), (nt * np_).sum() / len(y) ** 2
    return float(po), float(np.mean(2 * tp / (nt + np_))), float(np.mean(np.divide(tp, np_, out=np.zeros_like(tp), where=np_ > 0))), float((po - pe) / (1 - pe)) if pe < 1 else float("nan")


@dataclass
class Loop:
    """One batch at a time. mode: threshold (error above factor times the reference) or scheduled (odd batches); policy: a name of
    policies.POLICIES. The classifier is kept over drifts; weights of features that a new dictionary adds begin at 0."""

    classes: list
    atoms: int = 5
    share: float = 0.5
    lam: float = 0.1
    factor: float = 1.3
    mode: str = "threshold"
    policy: str = "coefficients"
    seed: int = 0
    iterations: int = 1000
    labels: list = field(default_factory=list)
    bank: np.ndarray | None = None
    reference: float | None = None
    model: LinearSgd | None = None
    seen: int = 0

    def __post_init__(self):
        if self.policy not in policies.POLICIES or self.mode not in ("threshold", "scheduled"):
            raise ValueError(f"unknown mode or policy: use threshold or scheduled, and one of {sorted(policies.POLICIES)}")

    def _learn(self, x, y) -> tuple[list, np.ndarray]:
        q = math.ceil(x.shape[1] * self.share)
        own = {c: learning.learn(x[y == c], self.atoms, q, self.lam, signed=False, seed=self.seed, most=self.iterations).s for c in sorted(set(y))}
        return [c for c in own for _ in range(len(own[c]))], np.concatenate(list(own.values()))

    def _codes(self, x, s) -> tuple[float, np.ndarray]:
        """Reconstruction error and codes of a batch, from a seeded random start."""
        rng = np.random.default_rng(self.seed)
        a, off = rng.random((len(x), len(s))), rng.integers(0, x.shape[1] - s.shape[1] + 1, (len(x), len(s)))
        a, off = learning.code(x, s, a, off, 1.0, self.iterations, 1e-5, False, rng)
        return float(((x - learning.rebuild(s, a, off, x.shape[1])) ** 2).sum(axis=1).mean()), a

    def prepare(self, number: int, x: np.ndarray, y: np.ndarray) -> tuple | None:
        """What step() would learn from the batch of a number alone, whatever the state is: labels and atoms, and its codes over them if the
        policy needs them. None if it learns nothing from it, or only the state tells whether it does."""
        if number > 1 and (self.mode != "scheduled" or number % 2 == 0):
            return None
        x, y = znorm_rows(np.asarray(x, dtype=float)), np.asarray(y)
        labels, new = self._learn(x, y)
        return labels, new, self._codes(x, new)[1] if number > 1 and self.policy in policies.CODED else None

    def step(self, x: np.ndarray, y: np.ndarray, prepared: tuple | None = None) -> tuple | None:
        """The result row of a batch, or None for the first one, which trains only. Rows are scored before the update. prepared: what prepare()
        gives for this batch, if it has been made."""
        x, y = znorm_rows(np.asarray(x, dtype=float)), np.asarray(y)
        self.seen += 1
        if self.seen == 1:
            self.labels, self.bank = prepared[:2] if prepared else self._learn(x, y)
            self.model = LinearSgd(self.classes, seed=self.seed).partial_fit(transform(x, self.bank), y)
            self.reference = self._codes(x, self.bank)[0] if self.mode == "threshold" else None
            return None
        error = self._codes(x, self.bank)[0] if self.mode == "threshold" else 0.0
        drift = self.seen % 2 != 0 if self.mode == "scheduled" else error > self.factor * self.reference
        features = transform(x, self.bank)
        row = (self.seen, *metrics(y.tolist(), self.model.predict(features).tolist()), bool(drift))
        if drift:
            labels, new, a_new = prepared or (*self._learn(x, y), None)
            if self.policy in policies.CODED:
                codes = self._codes(x, self.bank)[1], self._codes(x, new)[1] if a_new is None else a_new
            else:
                codes = None, None
            self.labels, self.bank = policies.combine(self.policy, (self.labels, self.bank), (labels, new), *codes, y, np.random.default_rng(self.seed + self.seen))
            self.reference = self._codes(x, self.bank)[0] if self.mode == "threshold" else None
            self.model.resize(len(self.bank))
            features = transform(x, self.bank)
        self.model.partial_fit(features, y)
        return row


def replay(batches: DataFrame, loop: Loop, label: str = "label", batch: str = "batch_num") -> DataFrame:
    """The loop over a finished table with batch numbers, read once in order; the driver holds a batch at a time, as the state demands."""
    rows, ordered = [], batches.select(batch, "seq", "x", label).orderBy(batch, "seq").toLocalIterator()
    for _, own in groupby(ordered, key=lambda r: r[0]):
        own = list(own)
        if r := loop.step(np.array([v.x for v in own]), np.array([v[3] for v in own])):
            rows.append(r)
    return batches.sparkSession.createDataFrame(rows, RESULT)


def _last_state(spark, folder: str) -> tuple[int, bytes] | None:
    if not tables.exists(spark, folder):
        return None
    r = spark.read.schema("data binary, micro_batch long").parquet(folder).orderBy(F.desc("micro_batch")).first()
    return (r.micro_batch, bytes(r.data)) if r else None


def start(source: DataFrame, loop: Loop, size: int, out: str, checkpoint: str, label: str = "label"):
    """A streaming query over rows (seq, x, label): rows wait until `size` of them are there, in order of seq. Results of each micro-batch
    are written to out/micro_batch=<its number> (Parquet), then the state to checkpoint-state; both replace what the number had."""
    spark, folder = source.sparkSession, f"{checkpoint.rstrip('/')}-state"
    found = _last_state(spark, folder)
    held = {"last": found[0], "state": pickle.loads(found[1])} if found else {"last": -1, "state": (pickle.loads(pickle.dumps(loop)), [])}

    def take(df: DataFrame, number: int) -> None:
        if number <= held["last"]:
            return
        own, rows = pickle.loads(pickle.dumps(held["state"]))
        rows = sorted([*rows, *((r.seq, list(r.x), r[label]) for r in df.select("seq", "x", label).collect())], key=lambda r: r[0])
        results = []
        while len(rows) >= size:
            batch, rows = rows[:size], rows[size:]
            if r := own.step(np.array([v[1] for v in batch]), np.array([v[2] for v in batch])):
                results.append(r)
        if results:
            spark.createDataFrame(results, RESULT).coalesce(1).write.mode("overwrite").parquet(f"{out}/micro_batch={number}")
        spark.createDataFrame([(bytearray(pickle.dumps((own, rows))),)], "data binary").coalesce(1).write.mode("overwrite").parquet(f"{folder}/micro_batch={number}")
        if held["last"] >= 0:
            tables.remove(spark, f"{folder}/micro_batch={held['last']}")
        held.update(last=number, state=(own, rows))

    return source.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).start()
