"""Count windows on streams, by key, with state in Spark's state store: rows that wait for a full window, the window's number, the threshold.

A key's state is the rows of its unfinished window (fewer than a window has), one number and one reference error, however long the stream
is. Micro-batches aren't collected: their rows go to the tasks of their keys, and only full windows come out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.series import numbered
from .prequential import RESULT, Loop


def _plain(v):
    """A value of pandas as state variables take it; what is missing is None."""
    if isinstance(v, (np.ndarray, np.generic)):
        v = v.tolist()
    return None if v is pd.NaT or isinstance(v, float) and np.isnan(v) else v


class _Windows(StatefulProcessor):
    """Cuts a key's rows, in their order within a micro-batch and after those that wait, into windows of `size`."""

    def __init__(self, key: str, order: str, size: int, values: list[tuple[str, str]]):
        self.key, self.order, self.size, self.names = key, order, size, [n for n, _ in values]
        self.kinds = ", ".join(f"`{n}` {t}" for n, t in values)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", self.kinds)
        self.done = handle.getValueState("done", "windows long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        fresh = [tuple(map(_plain, r)) for r in new[self.names].itertuples(index=False)]
        held = [*(tuple(r) for r in self.waiting.get()), *fresh] if self.waiting.exists() else fresh
        done = self.done.get()[0] if self.done.exists() else 0
        full = len(held) // self.size
        out = [got for k in range(full) if (got := self.window(key[0], done + k + 1, held[k * self.size : (k + 1) * self.size])) is not None]
        if rest := held[full * self.size :]:
            self.waiting.put(rest)
        elif self.waiting.exists():
            self.waiting.clear()
        self.done.update((done + full,))
        if out:
            yield pd.concat(out)

    def window(self, key, number: int, rows: list[tuple]) -> pd.DataFrame | None:
        """The rows that a full window gives."""
        own = pd.DataFrame(rows, columns=self.names).astype(object)
        own.insert(0, "batch_num", number)
        own.insert(0, self.key, key)
        return own

    def close(self) -> None:
        pass


class _Threshold(_Windows):
    """One row a window: mean error, and whether it is above factor times the reference, which is the first window's error, and after a
    drift that of the drifting window."""

    def __init__(self, *args, factor: float):
        super().__init__(*args)
        self.factor = factor

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.reference = handle.getValueState("reference", "error double")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        """The windows' means at once, by arrays: a micro-batch has many windows, and all that is kept of them is a row each."""
        new = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        at, values = new[self.names[0]].tolist(), pd.to_numeric(new[self.names[-1]]).to_numpy(dtype=float, na_value=np.nan)
        if self.waiting.exists() and (held := [tuple(r) for r in self.waiting.get()]):
            at = [*(r[0] for r in held), *at]
            values = np.concatenate([np.array([np.nan if r[-1] is None else r[-1] for r in held], dtype=float), values])
        done = self.done.get()[0] if self.done.exists() else 0
        full = len(values) // self.size
        windows = values[: full * self.size].reshape(full, self.size)
        reference = self.reference.get()[0] if self.reference.exists() else None
        errors, drifts, last = [], [], reference
        for w, whole in zip(windows, ~np.isnan(windows).any(axis=1)):
            known = w if whole else w[~np.isnan(w)]
            error = float(known.mean()) if len(known) else None
            drift = error is not None and last is not None and error > self.factor * last
            if error is not None and (last is None or drift):
                last = error
            errors.append(error), drifts.append(drift)
        if last is not None and last != reference:
            self.reference.update((last,))
        if len(at) > full * self.size:
            self.waiting.put([(a, None if np.isnan(v) else float(v)) for a, v in zip(at[full * self.size :], values[full * self.size :])])
        elif self.waiting.exists():
            self.waiting.clear()
        self.done.update((done + full,))
        if full:
            yield pd.DataFrame({self.key: pd.Series([key[0]] * full, dtype=object), "batch_num": range(done + 1, done + full + 1), "rows": self.size, "error": errors, "drift_detected": drifts})


class _Loops(_Windows):
    """The online loop of a key: its dictionary, classifier and reference error are state as well; a row of results for each window but the first."""

    def __init__(self, *args, loop: Loop):
        super().__init__(*args)
        self.loop = loop

    def init(self, handle: StatefulProcessorHandle) -> None:
        super().init(handle)
        self.held = handle.getValueState("loop", "data binary")

    def window(self, key, number, rows):
        loop = pickle.loads(self.held.get()[0]) if self.held.exists() else pickle.loads(pickle.dumps(self.loop))
        got = loop.step(np.array([list(r[1]) for r in rows], dtype=float), np.array([r[2] for r in rows]))
        self.held.update((pickle.dumps(loop),))
        if got is None:
            return None
        names = [c.split()[0] for c in RESULT.split(", ")]
        row = pd.DataFrame([got], columns=names)
        row.insert(0, self.key, key)
        return row


def _keyed(stream: DataFrame, key: str, order: str, columns: list[str]):
    kinds = dict(stream.dtypes)
    return stream.select(key, *[c for c in columns if c != key]), [(c, kinds[c]) for c in columns if c != key], T.StructField(key, stream.schema[key].dataType)


def count_windows(stream: DataFrame, key: str, order: str, size: int, columns: list[str]) -> DataFrame:
    """key, batch_num (from 1 within a key), order and columns of the rows of full windows, for a streaming frame.

    Rows of a micro-batch are taken in order; those of a later one come after them. Rows of an unfinished window wait, and never come out if
    the stream ends. A null key is a key; null values stay null. columns: of types that a state variable can hold."""
    rows, kinds, first = _keyed(stream, key, order, [order, *columns])
    out = T.StructType([first, T.StructField("batch_num", T.LongType()), *[stream.schema[n] for n, _ in kinds]])
    return rows.groupBy(key).transformWithStateInPandas(_Windows(key, order, size, kinds), out, "Append", "None")


def threshold_windows(stream: DataFrame, key: str, order: str, size: int, error: str, factor: float = 1.3) -> DataFrame:
    """key, batch_num, rows, error (mean over the window, null errors left out), drift_detected of full windows, for a streaming frame."""
    rows, kinds, first = _keyed(stream.withColumn(error, F.col(error).cast("double")), key, order, [order, error])
    out = T.StructType([first, T.StructField("batch_num", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("error", T.DoubleType()), T.StructField("drift_detected", T.BooleanType())])
    return rows.groupBy(key).transformWithStateInPandas(_Threshold(key, order, size, kinds, factor=factor), out, "Append", "None")


def keyed_loops(stream: DataFrame, key: str, loop: Loop, size: int, order: str = "seq", x: str = "x", label: str = "label") -> DataFrame:
    """The online loop for each key of a streaming frame (key, order, x, label): the result rows of its windows, on the executors.

    As many loops run at once as there are keys; each is the loop as given, from its start. Rows need a series and a label."""
    rows, kinds, first = _keyed(stream.filter(F.col(x).isNotNull() & F.col(label).isNotNull()), key, order, [order, x, label])
    out = T.StructType([first, *T._parse_datatype_string(RESULT).fields])
    return rows.groupBy(key).transformWithStateInPandas(_Loops(key, order, size, kinds, loop=loop), out, "Append", "None")


PREPARED = "batch_num long, x array<double>, y array<string>, labels array<string>, atoms array<double>, codes array<double>"


def prepared_windows(rows: DataFrame, key: str, loop: Loop, size: int, order: str = "seq", x: str = "x", label: str = "label") -> DataFrame:
    """key and PREPARED of the full windows of a finished table (key, order, x, label): a window's series and labels, and what the loop learns
    from it whatever its state is. Windows are spread over all tasks, as dictionaries don't depend on each other."""
    known = rows.filter(F.col(x).isNotNull() & F.col(label).isNotNull()).select(key, order, F.col(x).alias("x"), F.col(label).cast("string").alias("label"))
    placed = numbered(known, key, order).withColumn("batch_num", F.floor(F.col("rn") / size) + 1).filter(F.col("batch_num") * size <= F.col("n"))

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("rn")
        number, own, y = int(g.batch_num.iloc[0]), np.array(g.x.tolist(), dtype=float), g.label.tolist()
        labels, atoms, codes = loop.prepare(number, own, np.array(y)) or (None, None, None)
        flat = lambda v: None if v is None else v.ravel()
        return pd.DataFrame({key: g[key].iloc[:1].tolist(), "batch_num": [number], "x": [own.ravel()], "y": [y], "labels": [labels], "atoms": [flat(atoms)], "codes": [flat(codes)]})

    out = T.StructType([rows.schema[key], *T._parse_datatype_string(PREPARED).fields])
    return placed.select(key, "batch_num", "rn", "x", "label").groupBy(key, "batch_num").applyInPandas(one, out)


class _PreparedLoops(StatefulProcessor):
    """The online loop of a key over prepared windows, in order of their number; its state is read and written once a micro-batch."""

    def __init__(self, key: str, loop: Loop):
        self.key, self.loop = key, loop

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("loop", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        loop, out = pickle.loads(self.held.get()[0]) if self.held.exists() else pickle.loads(pickle.dumps(self.loop)), []
        for r in pd.concat(list(rows)).sort_values("batch_num").itertuples(index=False):
            prepared = None
            if r.labels is not None:
                atoms = np.array(r.atoms, dtype=float).reshape(len(r.labels), -1)
                prepared = list(r.labels), atoms, None if r.codes is None else np.array(r.codes, dtype=float).reshape(len(r.y), -1)
            if (got := loop.step(np.array(r.x, dtype=float).reshape(len(r.y), -1), np.array(list(r.y)), prepared)) is not None:
                out.append(got)
        self.held.update((pickle.dumps(loop),))
        if out:
            made = pd.DataFrame(out, columns=[c.split()[0] for c in RESULT.split(", ")])
            made.insert(0, self.key, pd.Series([key[0]] * len(out), dtype=object))
            yield made

    def close(self) -> None:
        pass


def loops_over_windows(stream: DataFrame, key: str, loop: Loop) -> DataFrame:
    """keyed_loops() for a streaming frame of prepared_windows(), a key's in order from one micro-batch to the next."""
    out = T.StructType([stream.schema[key], *T._parse_datatype_string(RESULT).fields])
    return stream.groupBy(key).transformWithStateInPandas(_PreparedLoops(key, loop), out, "Append", "None")
