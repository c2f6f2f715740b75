"""Classifier metrics from predictions (y, p), grouped or running. All start from confusion counts, which are aggregated at the source."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A
from .ranges import running_sums


def confusion(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    return pred.groupBy(*(by or []), "y", "p").agg(F.count("*").alias("n"))


def class_counts(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """c, tp, n_true, n_pred for every class present in truth or prediction."""
    by = by or []
    m = confusion(pred, by)
    t = m.select(*by, F.col("y").alias("c"), F.when(F.col("y") == F.col("p"), F.col("n")).otherwise(0).alias("tp"), F.col("n").alias("nt"), F.lit(0).cast("long").alias("np"))
    q = m.select(*by, F.col("p").alias("c"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("nt"), F.col("n").alias("np"))
    return t.unionByName(q).groupBy(*by, "c").agg(F.sum("tp").alias("tp"), F.sum("nt").alias("n_true"), F.sum("np").alias("n_pred"))


def _prf(c: DataFrame, zero: float = 0.0) -> DataFrame:
    p = F.coalesce(F.try_divide("tp", "n_pred"), F.lit(zero))
    r = F.coalesce(F.try_divide("tp", "n_true"), F.lit(zero))
    f = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("n_true") + F.col("n_pred")), F.lit(zero))
    return c.withColumns({"precision": p, "recall": r, "f1": f})


def report(pred: DataFrame) -> DataFrame:
    return _prf(class_counts(pred)).select("c", "precision", "recall", "f1", F.col("n_true").alias("support"))


def scores(pred: DataFrame, by: list[str] | None = None) -> DataFrame:
    """accuracy, f1_score, precision (macro, 0 for undefined), kappa (null where chance agreement is 1)."""
    by = by or []
    c = _prf(class_counts(pred, by))
    g = c.groupBy(*by).agg(F.sum("tp").alias("hit"), F.sum("n_true").alias("n"), F.avg("f1").alias("f1_score"), F.avg("precision").alias("precision"), F.sum(F.col("n_true") * F.col("n_pred")).alias("x"))
    po, pe = F.col("hit") / F.col("n"), F.col("x") / (F.col("n") * F.col("n"))
    return g.select(*by, po.alias("accuracy"), "f1_score", "precision", F.try_divide(po - pe, 1 - pe).alias("kappa"))


def weighted_scores(pred: DataFrame, zero: float = 0.0) -> DataFrame:
    c = _prf(class_counts(pred), zero)
    return c.agg(*[(F.sum(F.col(k) * F.col("n_true")) / F.sum("n_true")).alias(k) for k in ("precision", "recall", "f1")])


def running_scores(pred: DataFrame, order: str = "id") -> DataFrame:
    """Accuracy and kappa of all rows so far, in an order without ties; null is a class like any other.

    Every row is two marks, of its truth and of its prediction. The agreement by chance is the sum over classes of truths times
    predictions so far: a truth adds the number of earlier predictions of its class to it, a prediction that of truths up to its own row.
    So two passes of running sums over ranges of the order give it, the first by class, and no task sees a whole class."""
    rows = pred.select(F.col(order).alias("_id"), "y", "p", F.col("y").eqNullSafe(F.col("p")).cast("long").alias("_hit"))
    mark = lambda at, c, t: F.struct(F.lit(at).alias("at"), F.col(c).cast("string").alias("c"), F.lit(t).alias("t"))
    marks = rows.select("_id", "_hit", F.explode(F.array(mark(0, "y", 1), mark(1, "p", 0))).alias("m")).select("_id", "_hit", "m.*")
    seen = running_sums(marks, ["_id", "at"], {"truths": F.col("t").cast("long"), "guesses": (1 - F.col("t")).cast("long")}, by=["c"])
    chance = F.when(F.col("t") == 1, F.col("guesses")).otherwise(F.col("truths"))
    total = running_sums(seen.select("_id", "at", "_hit", chance.alias("chance")), ["_id", "at"], {"s": F.col("chance"), "hits": F.when(F.col("at") == 0, F.col("_hit")).otherwise(0), "n": (1 - F.col("at")).cast("long")})
    po, pe = F.col("hits") / F.col("n"), F.col("s") / (F.col("n").cast("double") * F.col("n"))
    return total.filter("at = 1").select(F.col("_id").alias(order), po.alias("accuracy"), F.when(pe != 1, (po - pe) / (1 - pe)).alias("kappa"))


def class_means(rows: DataFrame) -> DataFrame:
    """batch, label, before and after: mean arrays of each label's series in all batches up to (and with) a batch; rows: batch, label, x.

    This is the state of an incremental nearest-mean classifier before and after it learns a batch; labels without a mean are null."""
    sums = rows.select("batch", "label", F.posexplode("x").alias("i", "v")).groupBy("batch", "label", "i").agg(F.sum("v").alias("s"), F.count("*").alias("c"))
    grid = sums.select("batch").distinct().crossJoin(F.broadcast(sums.select("label", "i").distinct()))  # labels times places is bounded
    w = Window.partitionBy("label", "i").orderBy("batch")
    ahead, so_far = w.rowsBetween(Window.unboundedPreceding, -1), w.rowsBetween(Window.unboundedPreceding, 0)
    g = grid.join(sums, ["batch", "label", "i"], "left").select("batch", "label", "i", *[(F.sum("s").over(o) / F.sum("c").over(o)).alias(n) for n, o in (("before", ahead), ("after", so_far))])
    ordered = F.array_sort(F.collect_list(F.struct("i", "before", "after")))
    g = g.groupBy("batch", "label").agg(ordered.alias("m"))
    have = lambda k: F.when(F.get("m", F.lit(0))[k].isNotNull(), F.transform("m", lambda e: e[k]))
    return g.select("batch", "label", have("before").alias("before"), have("after").alias("after"))


def nearest_mean(rows: DataFrame, means: DataFrame, state: str, name: str) -> DataFrame:
    """batch, id, y and the label of the nearest mean; rows: batch, id, y, x. Ties go to the label that sorts first; none is null."""
    j = rows.join(means.select("batch", F.col("label").alias("_l"), F.col(state).alias("_m")).filter("_m is not null"), "batch")
    return j.groupBy("batch", "id", "y").agg(F.min(F.struct(F.round(A.squared_distance(F.col("x"), F.col("_m")), 9), "_l"))["_l"].alias(name))


def nearest_mean_of_each(rows: DataFrame, means: DataFrame, state: str, name: str) -> DataFrame:
    """nearest_mean() of the same few rows (id, y, x) at every batch that has a mean: batch, id, y and the label of the nearest.

    rows are bounded and broadcast; a batch's means are one row (labels times places), so a row and batch is scored where that lies, and nothing is
    shuffled or grouped by row and batch."""
    known = means.filter(F.col(state).isNotNull()).groupBy("batch").agg(F.collect_list(F.struct(F.col("label").alias("l"), F.col(state).alias("m"))).alias("_means"))
    far = F.transform("_means", lambda e: F.struct(F.round(A.squared_distance(F.col("x"), e["m"]), 9).alias("d"), e["l"].alias("l")))
    return known.crossJoin(F.broadcast(rows)).select("batch", "id", "y", F.array_min(far)["l"].alias(name))


def holdout_progressive(scored: DataFrame) -> DataFrame:
    """Accuracy on a fixed holdout at each batch; scored: batch, y, p (one row per batch and holdout row)."""
    return scored.groupBy("batch").agg(F.avg((F.col("y") == F.col("p")).cast("double")).alias("accuracy"))


def before_and_after(scored: DataFrame) -> DataFrame:
    """Accuracy of each batch before and after training on it; scored: batch, y, p_before, p_after."""
    return scored.groupBy("batch").agg(*[F.avg((F.col("y") == F.col(f"p_{k}")).cast("double")).alias(f"accuracy_{k}") for k in ("before", "after")])


def coefficients_long(weights: DataFrame, batch: str, columns: list[str]) -> DataFrame:
    return weights.unpivot([batch], columns, "variable", "value")


def seed_mean_std(rows: DataFrame, key: str, seeds: list[str]) -> DataFrame:
    return rows.unpivot([key], seeds, "seed", "value").groupBy(key).agg(F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"))
