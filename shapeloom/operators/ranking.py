"""Shapelet quality, closest matches, coefficient ranks and dictionary update policies.

Dictionaries are bounded (labels times atoms per label), so pairs of atoms are a small cross join; everything else keys on label or atom.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import arrays as A


def f_statistic(rows: DataFrame, by: list[str], value: str = "dist", label: str = "label") -> DataFrame:
    """f by `by`: between = sum of (class mean - mean)^2 / (C - 1), not weighted by class size; within = squared deviations from class
    means / (n - C). Null where a denominator is 0."""
    per = rows.groupBy(*by, label).agg(F.count("*").alias("n"), F.sum(value).alias("s"), F.avg(value).alias("m"), (F.var_pop(value) * F.count("*")).alias("w"))
    whole = Window.partitionBy(*by)
    per = per.withColumn("mean", F.sum("s").over(whole) / F.sum("n").over(whole))
    g = per.groupBy(*by).agg(F.sum((F.col("m") - F.col("mean")) * (F.col("m") - F.col("mean"))).alias("b"), F.count("*").alias("c"), F.sum("n").alias("n"), F.sum("w").alias("w"))
    return g.select(*by, F.try_divide(F.try_divide(F.col("b"), F.col("c") - 1), F.try_divide(F.col("w"), F.col("n") - F.col("c"))).alias("f_statistic"))


def quality_rank(scores: DataFrame, key: str) -> DataFrame:
    """quality_rank from 1, by f descending and then key; one row per shapelet is ranked."""
    return scores.withColumn("quality_rank", F.row_number().over(Window.orderBy(F.desc_nulls_last("f_statistic"), key)))


def atom_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """pos_a, pos_b, dist of all pairs of atoms of equal length."""
    left = a.select(F.col("pos").alias("pos_a"), F.col("s").alias("sa"))
    right = b.select(F.col("pos").alias("pos_b"), F.col("s").alias("sb"))
    p = left.crossJoin(F.broadcast(right)).filter(F.size("sa") == F.size("sb"))
    return p.select("pos_a", "pos_b", F.sqrt(A.squared_distance(F.col("sa"), F.col("sb"))).alias("dist"))


def closest(pairs: DataFrame, k: int = 1) -> DataFrame:
    """The k closest of b for each of a, ties to the smaller number."""
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("pos_a").orderBy("dist", "pos_b"))).filter(F.col("rank") <= k)


def closest_map(pairs: DataFrame, k: int = 1) -> DataFrame:
    """pos_a and its k matches as an array of (dist, pos_b)."""
    return closest(pairs, k).groupBy("pos_a").agg(F.array_sort(F.collect_list(F.struct("dist", "pos_b"))).alias("matches"))


def nearest_of_b(pairs: DataFrame, n: int, far: bool = False) -> DataFrame:
    """n atoms of b by their least distance to a, nearest (or farthest) first, with their order."""
    low = pairs.groupBy("pos_b").agg(F.min("dist").alias("dist"))
    order = F.row_number().over(Window.orderBy(F.desc("dist") if far else F.asc("dist"), "pos_b"))
    return low.withColumn("rank", order).filter(F.col("rank") <= n)


def _joined(head: DataFrame, tail: DataFrame) -> DataFrame:
    """Atoms of head and then of tail, renumbered; both have pos (their order) and label, s."""
    rows = head.select(F.lit(0).alias("part"), "pos", "label", "s").unionByName(tail.select(F.lit(1).alias("part"), "pos", "label", "s"))
    return rows.withColumn("new_pos", (F.row_number().over(Window.orderBy("part", "pos")) - 1).cast("long"))


def policy_closest_set(a: DataFrame, b: DataFrame, per_atom: int = 1) -> DataFrame:
    """All of a, then each one's closest of b, the first time each comes up."""
    hit = closest(atom_pairs(a, b), per_atom).groupBy("pos_b").agg(F.min(F.struct("pos_a", "rank")).alias("o"))
    tail = b.join(hit, b["pos"] == hit["pos_b"]).select((F.col("o.pos_a") * 1_000_000 + F.col("o.rank")).alias("pos"), "label", "s")
    return _joined(a, tail)


def policy_closest(a: DataFrame, b: DataFrame, n: int = 12, far: bool = False) -> DataFrame:
    """All of a, then the n of b nearest to it (or, with far, those with the largest least distance)."""
    hit = nearest_of_b(atom_pairs(a, b), n, far)
    return _joined(a, b.join(hit, b["pos"] == hit["pos_b"]).select(F.col("rank").alias("pos"), "label", "s"))


def policy_random(a: DataFrame, b: DataFrame, n: int = 10, seed: str = "0") -> DataFrame:
    """n of b, those first in the md5 of their number and the seed, then a."""
    order = F.row_number().over(Window.orderBy(F.md5(F.concat_ws("|", F.col("pos").cast("string"), F.lit(seed)))))
    return _joined(b.withColumn("o", order).filter(F.col("o") <= n).drop("pos").withColumnRenamed("o", "pos"), a)


def policy_top_ranked(a: DataFrame, b: DataFrame, ranks: DataFrame, n: int = 10) -> DataFrame:
    """The n of b first in ranks (k, overall_rank), then a."""
    top = ranks.filter(F.col("overall_rank") <= n).select("k", "overall_rank")
    return _joined(b.join(top, b["pos"] == top["k"]).select(F.col("overall_rank").alias("pos"), "label", "s"), a)


def policy_labelwise(old: DataFrame, new: DataFrame) -> DataFrame:
    """Per label, pairs of old and new atoms by ascending distance, each atom once; both atoms of a pair go in until there are as many
    as old atoms (so an odd number is passed by one). Greedy in order, hence one task per label, over its few atoms."""
    import pandas as pd

    left = old.select("label", F.col("shapelet_id").alias("old_id"), F.col("s").alias("so"))
    right = new.select("label", F.col("shapelet_id").alias("new_id"), F.col("s").alias("sn"))
    pairs = left.join(right, "label").select("label", "old_id", "new_id", F.sqrt(A.squared_distance(F.col("so"), F.col("sn"))).alias("dist"))

    def pick(p: pd.DataFrame) -> pd.DataFrame:
        want, used_o, used_n, rows = p.old_id.nunique(), set(), set(), []
        for r in p.sort_values(["dist", "old_id", "new_id"]).itertuples(index=False):
            if len(rows) >= want:
                break
            if r.old_id in used_o or r.new_id in used_n:
                continue
            used_o.add(r.old_id), used_n.add(r.new_id)
            rows += [(r.label, len(rows), "old", r.old_id), (r.label, len(rows) + 1, "new", r.new_id)]
        return pd.DataFrame(rows, columns=["label", "place", "origin", "shapelet_id"])

    return pairs.groupBy("label").applyInPandas(pick, "label string, place long, origin string, shapelet_id long")


def coefficient_sums(codes: DataFrame, origin: str) -> DataFrame:
    """label, shapelet_id, origin, total: coefficients summed over the series; codes: label, shapelet_id, a."""
    return codes.groupBy("label", "shapelet_id").agg(F.sum("a").alias("total")).withColumn("origin", F.lit(origin))


def policy_coefficients(old_sums: DataFrame, new_sums: DataFrame, per_label: int) -> DataFrame:
    """Per label the per_label atoms of both with the largest sums; ties: old_coeff's name sorts above, then the higher number."""
    w = Window.partitionBy("label").orderBy(F.desc("total"), F.desc("origin"), F.desc("shapelet_id"))
    return old_sums.unionByName(new_sums).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= per_label)


def rank_coefficients(codes: DataFrame, top_k: int = 10) -> DataFrame:
    """k, mean_rank, top_count, overall_rank: per series the atoms rank by |a| (from 0); codes: series_id, k, a."""
    r = F.row_number().over(Window.partitionBy("series_id").orderBy(F.desc(F.abs("a")), "k")) - 1
    return overall_ranks(codes.withColumn("r", r), top_k)


def overall_ranks(ranks: DataFrame, top_k: int = 10) -> DataFrame:
    """rank_coefficients() from the ranks of atoms: k, r."""
    g = ranks.groupBy("k").agg(F.avg("r").alias("mean_rank"), F.count_if(F.col("r") < top_k).alias("top_count"))
    return g.withColumn("overall_rank", F.row_number().over(Window.orderBy("mean_rank", "k")))


def new_classes(batch: DataFrame, seen: DataFrame) -> DataFrame:
    return batch.select("label").distinct().join(seen.select("label").distinct(), "label", "left_anti")


def seen_classes(batch: DataFrame, seen: DataFrame) -> DataFrame:
    return batch.select("label").union(seen.select("label")).distinct()
