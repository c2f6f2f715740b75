"""Table functions for SQL: windows cut from an ordered table as its rows pass."""

from __future__ import annotations

from collections import deque

from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.udtf import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn

_KEY, _ORDER, _VALUE = "label", "seq", "value"


def _constant(argument: AnalyzeArgument, name: str, least: int) -> int:
    if argument.isTable or not argument.isConstantExpression or not isinstance(argument.value, int) or argument.value < least:
        raise ValueError(f"{name} has to be a constant of at least {least}")
    return argument.value


class CutWindows:
    """cut_windows(TABLE(t), window, step, most): label, start, x of the sliding windows of each label's rows in order of seq.

    t has the columns label, seq and value (others are ignored); Spark deals it by label and sorts it, as analyze() asks, so the call needs no
    clauses of its own. Only `window` values are held. Starts are multiples of step below n - window, `most` of them at most; a null label is a
    label, null values stay. A label is one task: for tables whose labels are too large for that there is series.sliding_windows."""

    @staticmethod
    def analyze(t: AnalyzeArgument, window: AnalyzeArgument, step: AnalyzeArgument, most: AnalyzeArgument) -> AnalyzeResult:
        if not t.isTable:
            raise ValueError("the first argument has to be a table: TABLE(name) or TABLE(query)")
        lacking = {_KEY, _ORDER, _VALUE} - set(t.dataType.names)
        if lacking:
            raise ValueError(f"the table lacks {', '.join(sorted(lacking))}")
        for argument, name in ((window, "window"), (step, "step"), (most, "most")):
            _constant(argument, name, 1)
        label, value = t.dataType[_KEY].dataType, t.dataType[_VALUE].dataType
        schema = T.StructType([T.StructField("label", label), T.StructField("start", T.LongType()), T.StructField("x", T.ArrayType(value))])
        return AnalyzeResult(schema, partitionBy=[PartitioningColumn(_KEY)], orderBy=[OrderingColumn(_ORDER)])

    def __init__(self):
        self.held, self.seen = None, 0

    def eval(self, t, window: int, step: int, most: int):
        if self.held is None:
            self.held = deque(maxlen=window)
        start = self.seen - window  # this row is the one behind the window, so it isn't the label's last full one
        if start >= 0 and start % step == 0 and start // step < most:
            yield t[_KEY], start, list(self.held)
        self.held.append(t[_VALUE])
        self.seen += 1


def register(spark: SparkSession) -> None:
    """Make the table functions known to SQL under their names."""
    from pyspark.sql.functions import udtf

    spark.udtf.register("cut_windows", udtf(CutWindows))
