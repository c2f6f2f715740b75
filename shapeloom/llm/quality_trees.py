"""Quality rules, then gradient-boosted trees over document statistics.

Trees are grown on the driver from a bounded sample of labelled documents, with monotone constraints on the features whose direction is
known, and flattened into node arrays that score a whole batch of documents with numpy, one tree level at a time.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_type, slices

SYMBOLS = b"#*$%&|<>"
SPACES = b" \t\n\x0b\x0c\r"
WINDOW = 5
#: Bytes of a text above which its words become numbers, a piece of so many at a time.
PIECE = 1 << 20
_SPACE = re.compile(rb"[ \t-\r]")
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: Features, and the direction in which the quality may go when one of them grows: 1 up, -1 down, 0 either way.
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("upper_share", 0), ("digit_share", 0), ("punct_share", 0), ("words_per_line", 0), ("distinct_share", 0), ("bang_share", -1), ("other_control_share", 0))
_BYTE = {name: np.array([f(b) for b in range(256)], dtype=bool) for name, f in {
    "symbol": lambda b: b in SYMBOLS, "space": lambda b: b in SPACES, "upper": lambda b: 65 <= b <= 90, "digit": lambda b: 48 <= b <= 57,
    "punct": lambda b: 33 <= b <= 126 and not chr(b).isalnum() and b not in SYMBOLS, "letter": lambda b: 65 <= b <= 90 or 97 <= b <= 122 or b >= 192,
    "start": lambda b: b & 0xC0 != 0x80, "control": lambda b: b < 32 and b not in SPACES or b == 127}.items()}


def repeat_words(words: list | np.ndarray) -> int:
    """Words that lie in a window of WINDOW words which the text has twice or more, the first occurrence included.

    words: the words, or numbers that stand for them, as of a long text; their windows are numbered by pairs of numbers, without a tuple each."""
    n = len(words) - WINDOW + 1
    if n < 2:
        return 0
    if isinstance(words, np.ndarray):
        return _repeat_numbers(words)
    windows = list(zip(*[words[k:] for k in range(WINDOW)]))
    if len(set(windows)) == n:
        return 0
    count, total, covered = Counter(windows), 0, 0
    for i, w in enumerate(windows):
        if count[w] > 1:
            total += i + WINDOW - max(i, covered)
            covered = i + WINDOW
    return total


def _numbered(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Equal numbers for equal pairs."""
    return np.unique(a.astype(np.int64) * (int(b.max()) + 1) + b, return_inverse=True)[1].astype(np.int32)


def _repeat_numbers(words: np.ndarray) -> int:
    two = _numbered(words[:-1], words[1:])
    four = _numbered(two[:-2], two[2:])
    five = _numbered(four[:-1], words[4:])
    again = np.flatnonzero(np.bincount(five)[five] > 1)
    if not len(again):
        return 0
    gaps = np.diff(again)
    return WINDOW + int(np.minimum(gaps, WINDOW).sum())


def word_numbers(raw: bytes) -> tuple[np.ndarray, int]:
    """A number for each word, equal for equal words, and how many different ones there are; words are split a piece at a time."""
    known: dict[bytes, int] = {}
    out, at = array("i"), 0
    while at < len(raw):
        end = _SPACE.search(raw, min(at + PIECE, len(raw)))
        end = end.start() if end else len(raw)
        out.extend([known.setdefault(w, len(known)) for w in raw[at:end].split()])
        at = end
    return np.frombuffer(out, dtype=np.int32) if len(out) else np.zeros(0, dtype=np.int32), len(known)


def statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; and the features."""
    raw = (text or "").encode("utf-8", "surrogatepass")
    if len(raw) > PIECE:
        words, different = word_numbers(raw)
    else:
        words = raw.split()  # bytes: at the six ASCII spaces only
        different = len(set(words))
    n = len(words)
    of = sum(np.bincount(np.frombuffer(raw[k : k + PIECE], dtype=np.uint8), minlength=256) for k in range(0, max(len(raw), 1), PIECE))
    has = {k: int(of[m].sum()) for k, m in _BYTE.items()}
    chars = has["start"] - has["space"]
    lines = [x for x in raw.split(b"\n") if x.strip(SPACES)]
    dup, n_lines = len(lines) - len(set(lines)), len(lines)
    del lines
    repeated = repeat_words(words)
    c, w = max(chars, 1), max(n, 1)
    features = (np.log1p(n), chars / w, has["symbol"] / c, dup / max(n_lines, 1), repeated / w, has["upper"] / max(has["letter"], 1), has["digit"] / c, has["punct"] / c, n / max(n_lines, 1), different / w, int(of[33]) / c, has["control"] / c)
    return (n, chars, has["symbol"], dup, repeated), features


@dataclass
class Trees:
    """feature (-1: leaf), cut, left, right, value by node, all trees one after the other; a row goes left if its feature <= cut."""

    feature: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    base: float
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of good quality for each row."""
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            f = self.feature[at]
            inner = f >= 0
            at = np.where(inner, np.where(x[row, np.maximum(f, 0)] <= self.cut[at], self.left[at], self.right[at]), at)
        return 1 / (1 + np.exp(-(self.base + self.value[at].sum(axis=1))))


def grow(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 48, ridge: float = 1.0, least: float = 1.0) -> Trees:
    """Boost trees for the log loss with second-order gains on quantile bins; a constrained split keeps its sides apart by bounds."""
    cuts = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) if len(c) else np.zeros(0) for c in x.T]
    binned = np.stack([np.searchsorted(c, v, side="left") for c, v in zip(cuts, x.T)], axis=1)  # bin <= b exactly if value <= cuts[b]
    mean = min(max(float(y.mean()), 1e-3), 1 - 1e-3)
    base = float(np.log(mean / (1 - mean)))
    raw = np.full(len(y), base)
    feature, cut, left, right, value, roots = [], [], [], [], [], []

    def node(rows, g, h, level, low, high):
        k = len(feature)
        gs, hs = g[rows].sum(), h[rows].sum()
        best = float(np.clip(-gs / (hs + ridge), low, high))
        feature.append(-1), cut.append(0.0), left.append(k), right.append(k), value.append(best * rate)
        if level == depth or hs < 2 * least:
            return k
        top = (1e-6, None)
        for f in range(x.shape[1]):
            if not len(cuts[f]):
                continue
            b = binned[rows, f]
            gl = np.cumsum(np.bincount(b, g[rows], len(cuts[f]) + 1))[:-1]
            hl = np.cumsum(np.bincount(b, h[rows], len(cuts[f]) + 1))[:-1]
            gr, hr = gs - gl, hs - hl
            vl, vr = np.clip(-gl / (hl + ridge), low, high), np.clip(-gr / (hr + ridge), low, high)
            gain = -(gl * vl + (hl + ridge) * vl * vl / 2 + gr * vr + (hr + ridge) * vr * vr / 2) + gs * best + (hs + ridge) * best * best / 2
            gain[(hl < least) | (hr < least) | (monotone[f] * (vr - vl) < 0)] = -1
            j = int(gain.argmax())
            if gain[j] > top[0]:
                top = (float(gain[j]), (f, j, float(vl[j]), float(vr[j])))
        if top[1] is None:
            return k
        f, j, vl, vr = top[1]
        mid, goes = (vl + vr) / 2, binned[rows, f] <= j
        lows, highs = ((low, mid), (mid, high)) if monotone[f] > 0 else ((mid, high), (low, mid)) if monotone[f] < 0 else ((low, high), (low, high))
        feature[k], cut[k] = f, float(cuts[f][j])
        left[k] = node(rows[goes], g, h, level + 1, *lows)
        right[k] = node(rows[~goes], g, h, level + 1, *highs)
        return k

    for _ in range(rounds if len(y) and 0 < y.mean() < 1 else 0):
        p = 1 / (1 + np.exp(-raw))
        roots.append(node(np.arange(len(y)), p - y, np.maximum(p * (1 - p), 1e-9), 0, -np.inf, np.inf))
        one = Trees(np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value), np.array(roots[-1:]), depth, 0.0)
        s = one.score(x)
        raw += np.log(s / (1 - s))
    ints = [np.array(v, dtype=np.int32) for v in (feature, left, right, roots)]
    return Trees(ints[0], np.array(cut, dtype=float), ints[1], ints[2], np.array(value, dtype=float), ints[3], depth, base)


def best_threshold(p: np.ndarray, y: np.ndarray) -> float:
    """The cut with the highest balanced accuracy, in the middle of its gap."""
    if not len(y) or y.min() == y.max():
        return 0.0 if len(y) == 0 or y.min() == 1 else 1.0
    order = np.argsort(p, kind="stable")
    p, y = p[order], y[order]
    good, bad = np.cumsum(y) / y.sum(), np.cumsum(1 - y) / (1 - y).sum()
    gap = np.r_[p[1:] > p[:-1], False]
    k = int(np.where(gap, bad - good, -2).argmax())
    return float((p[k] + p[k + 1]) / 2) if gap[k] else 0.5


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: Trees | None = None) -> DataFrame:
    """_id, the five counts, _features and, with a model, _score of every row, in one pass over whole texts; a null text has no words.

    A text takes about four times its bytes and what its different words take. Other columns aren't looked at; an empty table gives an
    empty result."""
    rows = docs.select(docs[id_col].alias("_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("_text"))
    kind = rows.schema["_id"].dataType
    id_type = arrow_type(kind)
    names = ("_n_words", "_word_chars", "_n_symbols", "_n_dup_lines", "_n_repeat_words")
    out = T.StructType([T.StructField("_id", kind), *[T.StructField(n, T.LongType()) for n in names], T.StructField("_features", T.ArrayType(T.DoubleType())), T.StructField("_score", T.DoubleType())])
    held = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of trees of fixed depth

    def run(batches):
        for b in slices(batches, 8 << 20):
            counts, features = zip(*map(statistics, b.column(1).to_pylist()))
            x = np.array(features, dtype=float)
            score = held.value.score(x) if held.value is not None else np.full(len(x), np.nan)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), *[pa.array(c, pa.int64()) for c in zip(*counts)], pa.array(list(x), pa.list_(pa.float64())), pa.array(score)], names=out.names)

    return rows.mapInArrow(run, out)


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 4000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality") -> Trees:
    """Fit on at most `most_rows` labelled documents, those that come first in a hash of their id; the threshold is set on a fifth of
    them that the trees of a first fit haven't seen. Without usable labels every document passes."""
    picked = labels.select(labels[id_col].alias("_l"), labels[label_col].cast("int").alias("_y")).filter("_l is not null and _y in (0, 1)").groupBy("_l").agg(F.max("_y").alias("_y"))
    picked = picked.orderBy(F.xxhash64("_l", F.lit(3)), "_l").limit(most_rows)
    own = docs.select(docs[id_col].alias("_id"), docs[text_col].alias("_text")).join(F.broadcast(picked), F.col("_id") == F.col("_l"))  # bounded by most_rows
    got = measure(own.select("_id", "_text"), "_id", "_text").select("_id", "_features").join(F.broadcast(picked), F.col("_id") == F.col("_l")).select("_id", "_features", "_y").orderBy(F.xxhash64("_id"), "_id").limit(2 * most_rows).collect()
    x = np.array([r["_features"] for r in got], dtype=float).reshape(-1, len(FEATURES))
    y = np.array([r["_y"] for r in got], dtype=float)
    monotone = tuple(m for _, m in FEATURES)
    if not len(y):
        return Trees(*[np.zeros(0, dtype=np.int32)] * 1, np.zeros(0), *[np.zeros(0, dtype=np.int32)] * 2, np.zeros(0), np.zeros(0, dtype=np.int32), 0, 0.0, 0.0)
    test = np.arange(len(y)) % 5 == 0
    first = grow(x[~test], y[~test], monotone)
    model = grow(x, y, monotone)
    model.threshold = best_threshold(first.score(x[test]), y[test])
    return model


def apply_rules(measured: DataFrame, threshold: float) -> DataFrame:
    """measured (rows of measure()) with _base_failed and _kept: the base rules, then the score of those that pass; a row without a score isn't
    kept. Every row is judged alone, repeated ones too."""
    failed = (F.col("_n_words") < MIN_WORDS) | (100 * F.col("_n_repeat_words") > MAX_REPEAT_PERCENT * F.col("_n_words"))
    return measured.withColumn("_base_failed", failed).withColumn("_kept", ~failed & (F.col("_score") >= threshold))


def op3_quality(spark, sf_dir: str) -> DataFrame:
    """Nulls: a null text has no words and fails the base rules. Rows that repeat an id are judged each by its own text."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    got = apply_rules(measure(docs, model=model), model.threshold)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "score")
    return got.select(F.col("_id").alias("doc_id"), *[F.col(f"_{n}").alias(n) for n in names])
