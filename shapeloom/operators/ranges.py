"""Places and running sums over a whole table in an order, without one task for all of it.

The rows are dealt into ranges of the order by splitters that Spark draws from a sample of them, so ranges hold about as many rows each
whatever the values are: a day with most of the rows is many ranges, an outlier is no range of its own. Rows that are equal in the
order are told apart by a last key, so they are split over ranges as well. The sorted table is written once, sums are taken
by range, and the only window over everything runs over one row a range.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .tables import written

_LOW = (1 << 33) - 1  # of monotonically_increasing_id: the place within a partition
_BEFORE = Window.unboundedPreceding, -1


def sorted_ranges(df: DataFrame, *order: str | Column) -> DataFrame:
    """df with _range (rising with the order) and _at (place within it, from 0), written sorted; nulls come first."""
    with_tie = df.withColumn("_tie", F.monotonically_increasing_id())
    dealt = with_tie.repartitionByRange(*order, "_tie").sortWithinPartitions(*order, "_tie").drop("_tie")
    own = F.col("_place")
    placed = written(dealt.withColumn("_place", F.monotonically_increasing_id()), "ranges")
    out = placed.withColumn("_range", F.shiftright(own, 33)).withColumn("_at", own.bitwiseAND(_LOW)).drop("_place")
    out._folder = placed._folder
    return out


def ranked(df: DataFrame, *order: str | Column, name: str = "seq") -> DataFrame:
    """df with its place by `order` from 0, over all rows; rows that are equal in the order have some order, the same at every read.

    An empty table stays empty; the table of ranges has a row for each partition, so it is broadcast."""
    rows = sorted_ranges(df, *order)
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0))
    starts = rows.groupBy("_range").agg(F.count("*").alias("_n")).select("_range", before.alias("_first"))
    return rows.join(F.broadcast(starts), "_range").withColumn(name, F.col("_first") + F.col("_at")).drop("_range", "_at", "_first")


def running_sums(df: DataFrame, order: Sequence[str | Column], sums: Mapping[str, Column], by: Sequence[str] = ()) -> DataFrame:
    """df with running sums by `order`, each row included, of the named columns; by: keys whose rows are summed apart (null is a key).

    A row for each range and key is summed over all ranges, and every range within itself."""
    rows = df
    for name, value in sums.items():
        rows = rows.withColumn(f"_v_{name}", value)
    rows = sorted_ranges(rows, *order)
    keys = [F.struct(*by).alias("_key")] if by else [F.lit(0).alias("_key")]
    rows = rows.select("*", *keys)
    inside = Window.partitionBy("_range", "_key").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0)
    every = Window.partitionBy("_key").orderBy("_range").rowsBetween(*_BEFORE)
    sub = rows.groupBy("_range", "_key").agg(*[F.sum(f"_v_{n}").alias(f"_s_{n}") for n in sums])
    sub = sub.select(F.col("_range").alias("_r"), F.col("_key").alias("_k"), *[F.sum(f"_s_{n}").over(every).alias(f"_b_{n}") for n in sums])
    rows = rows.select("*", *[F.sum(f"_v_{n}").over(inside).alias(f"_i_{n}") for n in sums])
    out = rows.join(sub, (F.col("_range") == F.col("_r")) & F.col("_key").eqNullSafe(F.col("_k")), "left")
    for n in sums:
        out = out.withColumn(n, F.when(F.col(f"_b_{n}").isNull(), F.col(f"_i_{n}")).otherwise(F.col(f"_b_{n}") + F.coalesce(f"_i_{n}", F.lit(0))))
    return out.drop("_range", "_at", "_key", "_r", "_k", *[f"_{p}_{n}" for p in "vbi" for n in sums])
