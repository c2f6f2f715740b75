"""Mixing sources to target weights along a time-varying curriculum, with DataFrame functions only.

Targets are filled up by weight under a cap per source. A source's documents stand in a hashed order and are read again and
again until its target is reached; the middle of each reading is a point of the source's cumulative token demand. The source's
weight schedule over training time (piecewise linear) is integrated, and its inverse at that point is the training position.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, word_count

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: (time, weight) knots by class of source: heavy sources fade, the middle ones are even, light ones grow.
SCHEDULES = (((0.0, 1.5), (1.0, 0.5)), ((0.0, 1.0), (1.0, 1.0)), ((0.0, 0.5), (0.5, 0.75), (1.0, 1.75)))
#: Bits of a hash that make the cells of a source's hashed order.
CELL_BITS = 16


def _segments(knots: Sequence[tuple[float, float]]):
    """The schedule's integral, scaled to 1, as a literal array of segments: start, weight there, slope, area before."""
    if knots[0][0] != 0 or knots[-1][0] != 1 or any(a[0] >= b[0] for a, b in zip(knots, knots[1:])) or min(w for _, w in knots) < 0:
        raise ValueError("knots must rise from time 0 to time 1, with weights of 0 or more")
    whole = sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(knots, knots[1:]))
    if whole <= 0:
        raise ValueError("a schedule needs some weight")
    area, out = 0.0, []
    for (t0, w0), (t1, w1) in zip(knots, knots[1:]):
        out.append(F.struct(F.lit(float(t0)).alias("t"), F.lit(w0 / whole).alias("w"), F.lit((w1 - w0) / (t1 - t0) / whole).alias("m"), F.lit(area).alias("a")))
        area += (t1 - t0) * (w0 + w1) / 2 / whole
    return F.array(*out)


def source_targets(sized: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = MAX_REPEATS) -> DataFrame:
    """_null, _src, _source_size, _rank, _target of each source; sized: _null, _src, _size, of rows or of sums.

    The windows without a key run over one row per source, after aggregation."""
    s = sized.groupBy("_null", "_src").agg(F.sum("_size").alias("_source_size"))
    s = s.withColumn("_rank", F.row_number().over(Window.orderBy("_null", "_src")) - 1)
    s = s.withColumn("_w", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") % len(weights) + 1).cast("int")))
    s = s.withColumn("_cap", F.lit(float(cap)) * F.col("_source_size"))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy(F.lit(0))
    level = (F.sum("_source_size").over(every) - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / (F.sum("_w").over(every) - F.coalesce(F.sum("_w").over(before), F.lit(0.0)))
    s = s.withColumn("_full", F.col("_cap") / F.col("_w") < level)
    rest = (F.sum("_source_size").over(every) - F.sum(F.when(F.col("_full"), F.col("_cap")).otherwise(0.0)).over(every)) / F.sum(F.when(F.col("_full"), 0.0).otherwise(F.col("_w"))).over(every)
    target = F.when(F.col("_full"), F.col("_cap")).otherwise(F.least(F.col("_w") * rest, F.col("_cap")))
    return s.select("_null", "_src", "_source_size", "_rank", F.coalesce(target, F.lit(0.0)).alias("_target"))


def _mixed(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: Sequence[float], cap: int, schedules, whole: bool) -> DataFrame:
    text = F.coalesce(docs[text_col].cast("string"), F.lit(""))
    base = docs.select(docs[id_col].alias("_id"), docs[source_col].isNull().alias("_null"), F.coalesce(docs[source_col].cast("string"), F.lit("")).alias("_src"), word_count(text).alias("_size"), F.xxhash64(docs[id_col], text).alias("_h"), *([F.struct("*").alias("_row")] if whole else []))
    base = base.withColumn("_cell", F.shiftrightunsigned("_h", 64 - CELL_BITS))
    base = base if whole else materialize(base, "mix-sizes")  # whole rows are read twice rather than written once more
    totals = materialize(base.groupBy("_null", "_src", "_cell").agg(F.sum("_size").alias("_size")), "mix-cells")
    sources = materialize(source_targets(totals, weights, cap), "mix-sources")
    # sums before a cell in two steps, so that no window over a source has more than 2**(CELL_BITS / 2) rows
    totals = totals.withColumn("_part", F.shiftright("_cell", CELL_BITS // 2))
    before = lambda w, o: F.coalesce(F.sum("_size").over(w.orderBy(o).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    parts = totals.groupBy("_null", "_src", "_part").agg(F.sum("_size").alias("_size")).withColumn("_ahead", before(Window.partitionBy("_null", "_src"), "_part")).drop("_size")
    inside = before(Window.partitionBy("_null", "_src", "_part"), "_cell")
    bases = totals.withColumn("_in", inside).join(parts, ["_null", "_src", "_part"]).withColumn("_base", F.col("_ahead") + F.col("_in")).drop("_size", "_in", "_ahead", "_part").join(sources, ["_null", "_src"])
    inside = Window.partitionBy("_null", "_src", "_cell").orderBy("_h", "_id", "_size").rowsBetween(Window.unboundedPreceding, -1)
    rows = base.withColumn("_local", F.coalesce(F.sum("_size").over(inside), F.lit(0))).join(bases, ["_null", "_src", "_cell"])
    mid = F.col("_base") + F.col("_local") + F.col("_size") / 2
    copies = F.when(F.col("_source_size") > 0, F.greatest(F.lit(0), F.least(F.lit(cap), F.ceil((F.col("_target") - mid) / F.col("_source_size"))))).otherwise(0).cast("int")
    rows = rows.withColumns({"_mid": mid, "_copies": copies}).withColumn("_taken", F.col("_copies") * F.col("_size"))
    segs = F.element_at(F.array(*[_segments(k) for k in schedules]), (F.col("_rank") % len(schedules) + 1).cast("int"))
    rows = rows.withColumn("_segs", segs)

    def position(e):
        share = F.least((e * F.col("_source_size") + F.col("_mid")) / F.col("_target"), F.lit(1.0))
        g = F.element_at(F.filter("_segs", lambda s: s["a"] <= share), -1)
        left = share - g["a"]
        down = g["w"] + F.sqrt(F.greatest(g["w"] * g["w"] + 2 * g["m"] * left, F.lit(0.0)))
        return g["t"] + F.when(left <= 0, 0.0).otherwise(2 * left / down)

    every = F.when(F.col("_copies") > 0, F.transform(F.sequence(F.lit(0), F.col("_copies") - 1), position)).otherwise(F.array().cast("array<double>"))
    return rows.select("_id", "_size", "_source_size", "_target", "_copies", "_taken", every.alias("_positions"), "_h", *(["_row"] if whole else []))


def _in_ranges(rows: DataFrame, at: str, *then: str) -> DataFrame:
    """rows dealt over ranges of `at`, each sorted; null ones, which have no place in the order, anywhere by their hash _h.

    Positions are spread over [0, 1], as every source fills its schedule, so ranges of equal width need no sample."""
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    part = F.when(F.col(at).isNull(), F.pmod("_h", F.lit(n))).otherwise(F.least(F.floor(F.col(at) * n), F.lit(n - 1)))
    return rows.repartitionById(n, part.cast("int")).sortWithinPartitions(F.col(at).asc_nulls_last(), "_h", *then)


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """One row per row of docs: _id, _size, _source_size, _target, _copies, _taken, _positions (one in [0, 1] per copy), sorted by first position.

    Size is the number of words (null text: 0; a text of any length is counted whole). Sources rank by code point, null last, and get
    the weights in turn. A document of size 0 takes no words. Ids may repeat or be null; the order within a source is by hash of
    id and text, so only rows that share both are placed by chance. An empty table gives an empty result. Cells of a source's
    order are keyed by source and hash, so a hot source or id is spread."""
    rows = _mixed(docs, id_col, text_col, source_col, weights, cap, schedules, False)
    return _in_ranges(rows.withColumn("_first", F.get("_positions", F.lit(0))), "_first").drop("_first", "_h")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: Sequence[float] = WEIGHTS, cap: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The mix itself: every document once for each copy, with the columns of docs of whatever names, sorted by training position."""
    rows = _mixed(docs, id_col, text_col, source_col, weights, cap, schedules, True)
    return _in_ranges(rows.select(F.explode("_positions").alias("_at"), "_h", "_row"), "_at").select("_row.*")


def op7_mixing(spark, sf_dir: str) -> DataFrame:
    rows = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return rows.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_taken").alias("taken"), F.col("_positions").alias("positions"))
