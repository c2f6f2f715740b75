"""Series, dictionaries and windows from tables; distance features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from ..functions.dtw import dtw_features, nearest_by_dtw
from .ranges import ranked

QUANT = 6


def series(spark, sf_dir: str) -> DataFrame:
    """vec_id, label, x."""
    e = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return e.select("vec_id", F.col("label").cast("string").alias("label"), F.col("embedding").cast("array<double>").alias("x"))


def chunk_dictionary(rows: DataFrame, first: int = 1, last: int = 2, size: int = 16, at: int = 0) -> DataFrame:
    """pos, label, shapelet_id, s: a chunk of each label's first..last series by id. Bounded by labels * (last - first + 1) rows."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("vec_id"))
    few = rows.withColumn("rn", rank).filter(F.col("rn").between(first, last))
    few = few.select("label", (F.col("rn") - first).cast("long").alias("shapelet_id"), F.slice("x", at + 1, size).alias("s"))
    return few.withColumn("pos", (F.row_number().over(Window.orderBy("label", "shapelet_id")) - 1).cast("long"))


def stream(spark, sf_dir: str) -> DataFrame:
    """seq, ts, event_id, label, value in time order; rows without a time come first, those of one time by event_id."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_id", F.col("event_type").alias("label"), "value")
    return ranked(e, "ts", "event_id")


#: Rows of the stream in a bucket of numbered().
BUCKET = 1 << 16
#: Values of a chunk from which windows are cut, besides those that a window reaches over.
CHUNK = 1 << 12


def same_key_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """left and the other columns of right where all keys are the same, null being a key like any other."""
    other = right.withColumnsRenamed({k: f"_same_{k}" for k in keys})
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_same_{k}"))
    return left.join(other, on, how).drop(*[f"_same_{k}" for k in keys])


def numbered(rows: DataFrame, label: str = "label", order: str = "seq", bucket: int = BUCKET) -> DataFrame:
    """rn (from 0) and n (rows) within each label, by the number of a row in the stream, as ranked() gives it; null is a label.

    Rows are numbered within buckets of a label, of `bucket` numbers each; the windows over a whole label run over one row per bucket."""
    rows = rows.withColumn("_b", F.floor(F.col(order) / bucket))
    every = Window.partitionBy(label)
    before = F.coalesce(F.sum("_n").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = rows.groupBy(label, "_b").agg(F.count("*").alias("_n")).select(label, "_b", before.alias("_before"), F.sum("_n").over(every).alias("n"))
    inside = F.row_number().over(Window.partitionBy(label, "_b").orderBy(order)) - 1
    placed = same_key_join(rows.withColumn("_in", inside), counts, [label, "_b"])
    return placed.withColumn("rn", (F.col("_before") + F.col("_in")).cast("long")).drop("_b", "_in", "_before")


def chunks(numbered_rows: DataFrame, window: int, chunk: int = CHUNK) -> DataFrame:
    """label, n, c, values, seqs: the rows of a label by number, cut into chunks that also hold the window - 1 rows after their last."""
    size = max(chunk, 4 * window)
    own = F.floor(F.col("rn") / size)
    both = F.when((F.col("rn") % size < window - 1) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    g = numbered_rows.select("label", "n", "rn", "seq", "value", F.explode(both).alias("c")).groupBy("label", "c").agg(F.max("n").alias("n"), F.array_sort(F.collect_list(F.struct("rn", "value", "seq"))).alias("r"))
    return g.select("label", "n", "c", (F.col("c") * size).alias("first"), F.lit(size).alias("size"), F.transform("r", lambda e: e["value"]).alias("values"), F.transform("r", lambda e: e["seq"]).alias("seqs"))


def _cut(start, window: int):
    return F.slice("values", (start - F.col("first") + 1).cast("int"), window)


def atoms_of(dictionary: DataFrame, *columns: str) -> tuple[list, list[np.ndarray]]:
    """Rows (pos and the named columns) and atoms of a dictionary in order; it is bounded by its labels and size, so the driver holds it."""
    got = dictionary.orderBy("pos").select("pos", *columns, F.col("s").alias("_s")).collect()
    return got, [np.array(r["_s"], dtype=float) for r in got]


def _normalised(w: np.ndarray) -> np.ndarray:
    return (w - w.mean(axis=-1, keepdims=True)) / (w.std(axis=-1, keepdims=True) + A.EPS)


def feature_matrix(rows: DataFrame, dictionary: DataFrame, znorm: bool = True, metric: str = "euclidean") -> DataFrame:
    """features: the distances of a series in dictionary order, computed in Arrow batches. metric: euclidean is the least distance over the
    places of the atom, infinite where it is longer than the series, or the series null; dtw warps the whole series to the atom."""
    atoms = atoms_of(dictionary)[1]
    if metric == "dtw":
        return dtw_features(rows, atoms)
    if metric != "euclidean":
        raise ValueError(f"unknown metric {metric!r}: use euclidean or dtw")
    return _with_distances(rows, atoms, znorm)


def nearest_atom(rows: DataFrame, dictionary: DataFrame, metric: str = "euclidean", band: float = 0.9) -> DataFrame:
    """rows with pos, shapelet_label and dist of the nearest atom (ties: the first); null where there is none, as for a null series."""
    names, atoms = atoms_of(dictionary, "label")
    if metric == "dtw":
        near = nearest_by_dtw(rows, atoms, band).withColumn("_k", F.col("nearest.k")).withColumn("dist", F.col("nearest.dist")).drop("nearest")
    elif metric == "euclidean":
        near = _with_distances(rows, atoms, False).withColumn("dist", F.array_min("features")).withColumn("_k", F.array_position("features", F.col("dist")) - 1)
        near = near.withColumns({c: F.when(~F.isnan("dist") & (F.col("dist") < float("inf")), F.col(c)) for c in ("_k", "dist")}).drop("features")
    else:
        raise ValueError(f"unknown metric {metric!r}: use euclidean or dtw")
    kind = "array<struct<pos:bigint,shapelet_label:string>>"
    names = F.array(*[F.struct(F.lit(r["pos"]).alias("pos"), F.lit(r["label"]).alias("shapelet_label")) for r in names]).cast(kind)
    return near.withColumn("_n", F.get(names, F.col("_k").cast("int"))).select(*rows.columns, "_n.pos", "_n.shapelet_label", "dist")


def lots_by_size(x: pd.Series, lot: int):
    """(positions, array of the series there) for lots of series of one length; a null series counts as an empty one."""
    size = x.map(lambda v: 0 if v is None else len(v)).to_numpy(dtype=np.int64)
    for p in np.unique(size):
        every = np.flatnonzero(size == p)
        for at in (every[k : k + lot] for k in range(0, len(every), lot)):
            yield at, np.array(x.iloc[at].tolist() if p else [()] * len(at), dtype=float).reshape(len(at), p)


#: Series whose distances are bounded by one matrix product.
LOT = 128
#: Values up to which no square in a matrix product can overflow.
MOST = 1e100


def _plain_distances(v: np.ndarray, bank: np.ndarray, znorm: bool) -> np.ndarray:
    w = np.lib.stride_tricks.sliding_window_view(v, bank.shape[1])
    w = _normalised(w) if znorm else w
    return np.sqrt([np.einsum("ij,ij->i", e, e).min() for e in (w - s for s in bank)])


def least_distances(x: np.ndarray, bank: np.ndarray, znorm: bool) -> np.ndarray:
    """Least distance over the places of each atom (columns) for each series (rows). A matrix product of windows and atoms shows, but for
    what it loses by rounding, where the least can be; only there it is computed by differences."""
    out = np.full((len(x), len(bank)), np.inf)
    safe = (np.abs(x).max(axis=1) < MOST) & bool((np.abs(bank) < MOST).all())  # false for what is no number, too
    for i in np.flatnonzero(~safe):
        out[i] = _plain_distances(x[i], bank, znorm)
    if not safe.any():
        return out
    q = bank.shape[1]
    w = np.lib.stride_tricks.sliding_window_view(x[safe], q, axis=1)
    w = _normalised(w) if znorm else np.ascontiguousarray(w)
    own, theirs = np.einsum("ijk,ijk->ij", w, w), np.einsum("ij,ij->i", bank, bank)
    g = (w.reshape(-1, q) @ (-2 * bank.T)).reshape(*w.shape[:2], len(bank))
    g += own[:, :, None]
    g += theirs
    reach = g.min(axis=1) + 16 * q * np.finfo(float).eps * (own.max(axis=1)[:, None] + theirs)
    i, place, k = np.nonzero(g <= reach[:, None, :])
    least = np.full((len(w), len(bank)), np.inf)
    for t in range(0, len(i), 1 << 16):
        some = slice(t, t + (1 << 16))
        e = w[i[some], place[some]] - bank[k[some]]
        np.minimum.at(least, (i[some], k[some]), np.einsum("ij,ij->i", e, e))
    out[safe] = np.sqrt(least)
    return out


def _with_distances(rows: DataFrame, atoms: list[np.ndarray], znorm: bool) -> DataFrame:
    if not atoms:
        return rows.withColumn("features", F.array().cast("array<double>"))
    banks = []
    for size in sorted({len(s) for s in atoms}):
        at = [k for k, s in enumerate(atoms) if len(s) == size]
        bank = np.stack([atoms[k] for k in at])
        banks.append((size, at, _normalised(bank) if znorm else bank))

    @F.pandas_udf("array<double>")
    def run(x: pd.Series) -> pd.Series:
        out = np.empty(len(x), dtype=object)
        for at, v in lots_by_size(x, LOT):
            d = np.full((len(v), len(atoms)), np.inf)
            for size, ks, bank in banks:
                if v.shape[1] >= size:
                    d[:, ks] = least_distances(v, bank, znorm)
            for i, own in zip(at, d):
                out[i] = own
        return pd.Series(out)

    return rows.withColumn("features", run("x"))


def shapelet_features(rows: DataFrame, dictionary: DataFrame, znorm: bool = False) -> DataFrame:
    """Each series against each shapelet: pos, shapelet_label and least distance, one Arrow pass over the series."""
    names, atoms = atoms_of(dictionary, "label")
    kind = "array<struct<pos:bigint,shapelet_label:string>>"
    names = F.array(*[F.struct(F.lit(r["pos"]).alias("pos"), F.lit(r["label"]).alias("shapelet_label")) for r in names]).cast(kind)
    own = [c for c in rows.columns if c != "x"]
    m = _with_distances(rows, atoms, znorm).select(*own, F.posexplode("features").alias("_k", "dist"))
    return m.withColumn("_n", F.get(names, F.col("_k"))).select(*own, "_n.pos", "_n.shapelet_label", "dist")


def _starts(low, high, step: int):
    """Multiples of step from low to high, both included."""
    a = F.ceil(low / step) * step
    return F.when(a <= high, F.sequence(a.cast("long"), high.cast("long"), F.lit(step).cast("long"))).otherwise(F.array().cast("array<bigint>"))


def sliding_windows(rows: DataFrame, window: int, step: int, most: int = 1000) -> DataFrame:
    """label, start, x: windows of each label's rows in order; starts below n - window only, so the last full one is never emitted.

    Rows beyond the last start go no further; windows are cut from chunks, only where one starts."""
    near = numbered(rows).filter(F.col("rn") < (most - 1) * step + window)
    last = F.least(F.col("first") + F.col("size") - 1, F.col("n") - window - 1, F.lit((most - 1) * step))
    c = chunks(near, window).withColumn("start", F.explode(_starts(F.col("first"), last, step)))
    return c.select("label", "start", _cut(F.col("start"), window).alias("x"))


def trailing_windows(rows: DataFrame, size: int) -> DataFrame:
    """seq, x: the last `size` values at each row of a label, once there are so many."""
    last = F.least(F.col("first") + F.col("size") - 1, F.col("n") - size)
    c = chunks(numbered(rows), size).withColumn("start", F.explode(_starts(F.col("first"), last, 1)))
    return c.select("label", F.get("seqs", (F.col("start") - F.col("first") + size - 1).cast("int")).alias("seq"), _cut(F.col("start"), size).alias("x"))


def _cut_at(rows: DataFrame, starts: DataFrame, window: int) -> DataFrame:
    """label, k, start, x of wanted starts (label, k, start)."""
    size = max(CHUNK, 4 * window)
    wanted = starts.select("label", "k", "start", F.floor(F.col("start") / size).alias("c"))
    return same_key_join(wanted, chunks(numbered(rows), window).drop("n"), ["label", "c"]).select("label", "k", "start", _cut(F.col("start"), window).alias("x"))


def _drawn(*columns) -> F.Column:
    """A number of 48 bits by the md5 of the columns, which other engines have as well; nulls are skipped."""
    return F.conv(F.substring(F.md5(F.concat_ws("|", *[c.cast("string") for c in columns])), 1, 12), 16, 10).cast("long")


def random_windows(rows: DataFrame, window: int, most: int, seed: int = 0) -> DataFrame:
    """label, k, start, x: `most` windows per label of 2 * (window // 2) rows about centres drawn in [window // 2, n - window // 2); labels
    with n <= window have none. Draws are hashes of (label, k, seed)."""
    half = window // 2
    n = rows.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > window)
    draws = n.withColumn("k", F.explode(F.sequence(F.lit(1), F.lit(most))))
    draws = draws.withColumn("start", F.pmod(_drawn(F.col("label"), F.col("k"), F.lit(seed)), F.col("n") - 2 * half))
    return _cut_at(rows, draws, 2 * half)


def bootstrapped_windows(rows: DataFrame, window: int, step: int, most: int, seed: int = 0) -> DataFrame:
    """Sliding passes again and again, the first from 0 and later ones from a hashed start, until each label has `most` windows.
    Labels with n <= window have none (there is nothing to repeat)."""
    n = rows.groupBy("label").agg(F.count("*").alias("n")).filter(F.col("n") > window)
    last = F.col("n") - window - 1
    passes = n.withColumn("pass", F.explode(F.sequence(F.lit(0), F.lit(most - 1))))
    passes = passes.withColumn("from", F.when(F.col("pass") == 0, 0).otherwise(F.pmod(_drawn(F.col("label"), F.col("pass"), F.lit(seed)), F.least(F.lit(step), F.col("n") - window))))
    passes = passes.withColumn("count", F.floor((last - F.col("from")) / step) + 1)  # of a pass; no more starts are made than are wanted
    ahead = Window.partitionBy("label").orderBy("pass").rowsBetween(Window.unboundedPreceding, -1)
    passes = passes.withColumn("before", F.coalesce(F.sum("count").over(ahead), F.lit(0))).filter(F.col("before") < most)
    few = F.least(F.col("count"), most - F.col("before"))
    starts = passes.select("label", "before", F.posexplode(F.sequence(F.col("from").cast("long"), (F.col("from") + (few - 1) * step).cast("long"), F.lit(step).cast("long"))).alias("i", "start"))
    starts = starts.select("label", "start", (F.col("before") + F.col("i") + 1).cast("int").alias("k"))
    return _cut_at(rows, starts, window)


def compile_windows(rows: DataFrame, method: str, window: int = 100, step: int = 1, most: int = 1000, seed: int = 0) -> DataFrame:
    if method == "slide":
        return sliding_windows(rows, window, step, most)
    if method == "random":
        return random_windows(rows, window, most, seed)
    if method == "bootstrapped":
        return bootstrapped_windows(rows, window, step, most, seed)
    raise ValueError(f"unknown method {method!r}: use slide, random or bootstrapped")


def half_split(rows: DataFrame) -> DataFrame:
    """is_train: the first n // 2 rows of each label."""
    return numbered(rows).withColumn("is_train", F.col("rn") < F.floor(F.col("n") / 2))


def train_stat_znorm(rows: DataFrame) -> DataFrame:
    """z: each label's test half by the mean and population std of its train half."""
    s = half_split(rows)
    stats = s.filter("is_train").groupBy("label").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("sd"))
    return same_key_join(s.filter("not is_train"), stats, ["label"]).withColumn("z", (F.col("value") - F.col("m")) / F.when(F.col("sd") == 0, 1.0).otherwise(F.col("sd")))


def standard_scaled(rows: DataFrame, train: DataFrame) -> DataFrame:
    """z: each place of x by the mean and population std of that place in train (0 counts as 1). Places that train lacks give null, a
    null series stays null. The statistics are a row for each place; they go to the rows as one array."""
    own = train.select(F.posexplode("x").alias("_i", "_v")).groupBy("_i").agg(F.avg("_v").alias("m"), F.stddev_pop("_v").alias("sd"))
    fit = own.agg(F.array_sort(F.collect_list(F.struct("_i", "m", "sd"))).alias("_fit"))
    scaled = lambda v, i: (v - F.get("_fit", i)["m"]) / F.when(F.get("_fit", i)["sd"] == 0, 1.0).otherwise(F.get("_fit", i)["sd"])
    return rows.crossJoin(fit).withColumn("z", F.transform("x", scaled)).drop("_fit")  # fit is one row


def stratified_split(rows: DataFrame, test_share: float, key: str, seed: str = "0") -> DataFrame:
    """is_test: ceil(share * n) rows of each label, those first in the md5 of key and seed."""
    draw = F.md5(F.concat_ws("|", F.col(key).cast("string"), F.lit(seed)))
    cells = rows.withColumn("_m", draw).withColumn("_b", F.substring("_m", 1, 3))  # the order is by the digest, so its first digits are its buckets
    every = Window.partitionBy("label")
    before = F.coalesce(F.sum("_n").over(every.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = cells.groupBy("label", "_b").agg(F.count("*").alias("_n")).select("label", "_b", before.alias("_before"), F.sum("_n").over(every).alias("_all"))
    inside = F.row_number().over(Window.partitionBy("label", "_b").orderBy("_m", key))
    return same_key_join(cells.withColumn("_in", inside), counts, ["label", "_b"]).withColumn("is_test", F.col("_before") + F.col("_in") <= F.ceil(F.col("_all") * test_share)).drop("_m", "_b", "_in", "_before", "_all")


def tumbling_batches(rows: DataFrame, size: int, keep_tail: bool = False) -> DataFrame:
    """batch_num from 1 over seq; without keep_tail an incomplete last batch is dropped."""
    b = rows.withColumn("batch_num", (F.floor(F.col("seq") / size) + 1).cast("long"))
    if keep_tail:
        return b
    last = rows.agg(F.floor((F.max("seq") + 1) / size).alias("_full"))  # seq counts all rows from 0, so only the last batch can lack any
    return b.crossJoin(F.broadcast(last)).filter(F.col("batch_num") <= F.col("_full")).drop("_full")


def half_batches(rows: DataFrame, size: int) -> DataFrame:
    """batch_num and part: the first size // 2 rows of a batch test, the rest train; batches that lack a part's rows are dropped."""
    half = size // 2
    b = tumbling_batches(rows, size, keep_tail=True).withColumn("part", F.when(F.col("seq") % size < half, "test").otherwise("train"))
    c = F.count("*").over(Window.partitionBy("batch_num"))
    return b.withColumn("c", c).filter(F.col("c") >= 2 * half).drop("c")


#: Fixed values of the class-incremental schedule: (epochs, classes) of each stage, and rows of a batch.
STAGES = ((5, 2), (4, 3), (5, 4))
BATCH = 300


def class_schedule(classes: Sequence[str], stages=STAGES, batch: int = BATCH) -> list[tuple[int, str, int, int]]:
    """(epoch, class, first, end) by rows of each class: a batch is shared evenly, its remainder goes to the earliest classes."""
    used = dict.fromkeys(classes, 0)
    out, epoch = [], 0
    for epochs, k in stages:
        for _ in range(epochs):
            for i, c in enumerate(classes[:k]):
                n = batch // k + (i < batch % k)
                out.append((epoch, c, used[c], used[c] + n))
                used[c] += n
            epoch += 1
    return out


def scheduled(rows: DataFrame, schedule: list[tuple[int, str, int, int]]) -> DataFrame:
    """Rows with their epoch: a range join of row numbers with the schedule, which is a few rows."""
    plan = rows.sparkSession.createDataFrame(schedule, "epoch long, label string, first long, end long")
    return numbered(rows).join(F.broadcast(plan), "label").filter("rn >= first and rn < end").drop("first", "end", "n")


def label_encode(rows: DataFrame, label: str = "label") -> DataFrame:
    """code: place of the label among the sorted labels, from 0; labels are aggregated before they are ranked. A null label has none."""
    known = rows.select(label).filter(F.col(label).isNotNull()).distinct()
    return rows.join(known.withColumn("code", (F.row_number().over(Window.orderBy(label)) - 1).cast("long")), label, "left")


def label_decode(coded: DataFrame, rows: DataFrame, code: str = "code", label: str = "label") -> DataFrame:
    """coded with the label of each code, as label_encode(rows) numbers them; codes that no label has stay, with a null label."""
    known = label_encode(rows.select(label).distinct(), label).filter(F.col("code").isNotNull()).withColumnRenamed("code", "_code")
    return coded.join(known, F.col(code) == F.col("_code"), "left").drop("_code")


def shuffled(rows: DataFrame, seed: int, *keys: str) -> DataFrame:
    return rows.orderBy(F.xxhash64(*keys, F.lit(seed)), *keys)
