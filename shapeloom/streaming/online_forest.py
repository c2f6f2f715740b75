"""The adaptive random forest on Structured Streaming: every tree is a key, its state lives in the state store, and trees are spread over tasks.

Each row goes to every tree, which votes before it learns. The votes of a row come together again in one aggregation over the trees.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import learning, series
from ..operators.evaluation import running_scores
from ..operators.forest import HoeffdingTree, Member, Settings
from ..operators.tables import written
from . import feed

VOTES = "tree long, seq long, votes array<double>, drifts long, warnings long"


class TreeProcessor(StatefulProcessor):
    """A tree's rows in order of seq within a micro-batch: vote, then learn. The state is bounded by depth, classes and features."""

    def __init__(self, settings: Settings):
        self.settings = settings

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("member", "data binary")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        tree = int(key[0])
        member = pickle.loads(self.state.get()[0]) if self.state.exists() else Member(self.settings, tree)
        own = pd.concat(list(rows)).sort_values("seq", kind="stable")
        out = []
        for number, y, x in zip(own.seq, own.target, own.features):
            x = np.asarray(x if x is not None else (), dtype=float)
            out.append((tree, int(number), member.vote(x), member.drifts, member.warnings))
            if y is not None and not pd.isna(y) and len(x):
                member.learn(x, int(y), int(number))
        self.state.update((pickle.dumps(member),))
        yield pd.DataFrame(out, columns=["tree", "seq", "votes", "drifts", "warnings"])

    def close(self) -> None:
        pass


def forest_votes(stream: DataFrame, settings: Settings) -> DataFrame:
    """tree, seq, votes, drifts, warnings of each row of a streaming frame (seq, target, features) and tree; drifts and warnings: of the
    tree before the row.

    A row without target votes only, and so does one without features (by the classes' shares it is told nothing). Rows may get more features later, none fewer.
    A micro-batch's rows are learned in order of seq; rows that come in a later one are learned later."""
    each = stream.select("seq", "target", "features", F.explode(F.array(*[F.lit(t).cast("long") for t in range(settings.trees)])).alias("tree"))
    return each.groupBy("tree").transformWithStateInPandas(TreeProcessor(settings), VOTES, "Append", "None")


def elected(votes: DataFrame) -> DataFrame:
    """seq, prediction (ties: the smallest class), drifts and warnings of all trees so far. A row has a vote of each tree, so the lists are bounded."""
    lists = votes.groupBy("seq").agg(F.array_sort(F.collect_list(F.struct("tree", "votes"))).alias("v"), F.sum("drifts").alias("drifts"), F.sum("warnings").alias("warnings"))
    total = F.aggregate("v", F.transform(F.get("v", F.lit(0))["votes"], lambda _: F.lit(0.0)), lambda t, e: F.zip_with(t, e["votes"], lambda a, b: a + b))
    return lists.withColumn("_t", total).select("seq", (F.array_position("_t", F.array_max("_t")) - 1).cast("long").alias("prediction"), "drifts", "warnings")


def replay_forest(rows: DataFrame, batch: str, settings: Settings, folder: str | None = None) -> DataFrame:
    """elected() for a finished table (seq, target, features and a column `batch` that rises with seq): streamed batch after batch from a new
    folder under spark.checkpoint.dir, which stays there with its checkpoint."""
    spark = rows.sparkSession
    folder = folder or feed.new_folder(spark, "forest")
    feed.lay_out(rows.select("seq", F.col("target").cast("long").alias("target"), "features", batch), batch, folder)
    schema = f"seq long, target long, features array<double>, {batch} {dict(rows.dtypes)[batch]}"
    feed.run_to_end(forest_votes(feed.stream_of(spark, folder, schema), settings), folder, "votes")
    return elected(spark.read.schema(VOTES).parquet(f"{folder}/votes"))


def class_incremental(rows: DataFrame, classes: list[str], stages, atoms: int = 5, share: float = 0.5, trees: int = 10, seed: int = 32, rows_at_once: int = 1 << 15, **tree) -> DataFrame:
    """The class-incremental run: seq, epoch, label, prediction, accuracy, kappa (both so far), atoms (in use), drifts, warnings.

    rows: seq, label, x. Epochs deal out the classes' rows by schedule, each in an order drawn by seed. A class that an epoch is the first to
    bring has its dictionary learned from its rows there, and its atoms are appended to those in use; features are distances to the atoms that
    are in use in an epoch. The forest votes on each row before it learns it; rows_at_once of them are a micro-batch. Epochs are as large as
    use the table up. Rows without a label take no part."""
    epochs = sum(e for e, _ in stages)
    batch = max(1, rows.count() // epochs)
    plan = series.class_schedule(classes, stages, batch)
    own = series.scheduled(rows, plan).select("epoch", "label", F.col("seq").alias("vec_id"), "x")
    own = series.ranked(own.withColumn("_o", F.xxhash64("vec_id", F.lit(seed))), "epoch", "_o", "vec_id", name="seq").drop("_o")
    own = own.withColumn("x", _normalised("x"))
    first = {c: min(e for e, k, _, _ in plan if k == c) for c in {k for _, k, _, _ in plan}}
    starts = rows.sparkSession.createDataFrame(list(first.items()), "label string, _first long")
    fresh = own.join(F.broadcast(starts), "label").filter("epoch = _first")
    learned = learning.learn_dictionaries(fresh, k=atoms, share=share, seed=seed)
    bank = learned.join(F.broadcast(starts), "label").select("label", "_first", "shapelet_id", "s").collect()  # atoms times classes
    bank.sort(key=lambda r: (r._first, r.label, r.shapelet_id))
    d = rows.sparkSession.createDataFrame([(k, r.label, r.s) for k, r in enumerate(bank)], "pos long, label string, s array<double>")
    in_use = [(e, sum(r._first <= e for r in bank)) for e in range(epochs)]
    use = rows.sparkSession.createDataFrame(in_use, "epoch long, atoms int")
    made = written(series.feature_matrix(own.join(F.broadcast(use), "epoch"), d), "forest-features")  # use has a row for each epoch
    made = made.withColumn("features", F.slice("features", 1, F.col("atoms")))
    code = F.array_position(F.array(*[F.lit(c) for c in sorted(classes)]), F.col("label")) - 1
    made = made.select("seq", "epoch", "label", "atoms", code.cast("long").alias("target"), "features")
    part = made.withColumn("part", F.floor(F.col("seq") / rows_at_once))
    got = replay_forest(part, "part", Settings(classes=len(classes), trees=trees, seed=seed, **tree))
    names = F.array(*[F.lit(c) for c in sorted(classes)])
    pred = made.select("seq", "epoch", "label", "atoms").join(got, "seq").withColumn("prediction", F.get(names, F.col("prediction").cast("int")))
    so_far = running_scores(pred.select("seq", F.col("label").alias("y"), F.col("prediction").alias("p")), "seq")
    return pred.join(so_far, "seq").select("seq", "epoch", "label", "prediction", "accuracy", "kappa", "atoms", "drifts", "warnings")


def _normalised(x: str):
    from ..functions import arrays as A

    return A.znorm(F.col(x))


@dataclass
class Boosted:
    """Online boosting of Hoeffding trees: a row's weight goes from tree to tree, larger after a tree that has it wrong, smaller after one that
    has it right, and each learns it as often as a Poisson draw of that weight says. A tree's vote is the logarithm of its odds."""

    settings: Settings

    def __post_init__(self):
        self.members = [HoeffdingTree(self.settings, t) for t in range(self.settings.trees)]
        self.right, self.wrong = np.zeros(len(self.members)), np.zeros(len(self.members))

    def vote(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(self.settings.classes)
        for tree, r, w in zip(self.members, self.right, self.wrong):
            odds = 1.0 if r + w == 0 else np.log((r + 1e-9) / (w + 1e-9))
            total[int(tree.shares(x).argmax())] += max(odds, 0.0)
        return total

    def learn(self, x: np.ndarray, y: int, number: int) -> None:
        weight, draws = 1.0, np.random.default_rng([self.settings.seed, number])
        for k, tree in enumerate(self.members):
            if (times := draws.poisson(weight)) > 0:
                tree.learn(x, y, float(times))
            if int(tree.shares(x).argmax()) == y:
                self.right[k] += weight
                weight *= (self.right[k] + self.wrong[k]) / (2 * self.right[k])
            else:
                self.wrong[k] += weight
                weight *= (self.right[k] + self.wrong[k]) / (2 * self.wrong[k])


class BoostProcessor(TreeProcessor):
    """An ensemble of a key, whose trees learn one after the other: keys are spread over tasks, the trees of one can't be."""

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = pickle.loads(self.state.get()[0]) if self.state.exists() else Boosted(self.settings)
        own, out = pd.concat(list(rows)).sort_values("seq", kind="stable"), []
        for number, y, x in zip(own.seq, own.target, own.features):
            x = np.asarray(x if x is not None else (), dtype=float)
            out.append((key[0], int(number), int(held.vote(x).argmax()) if len(x) else None))
            if y is not None and not pd.isna(y) and len(x):
                held.learn(x, int(y), int(number))
        self.state.update((pickle.dumps(held),))
        yield pd.DataFrame(out, columns=["key", "seq", "prediction"]).astype({"prediction": "Int64"})


def boosted_predictions(stream: DataFrame, settings: Settings) -> DataFrame:
    """key, seq, prediction of each row of a streaming frame (key, seq, target, features), before the key's ensemble learns it.

    Cases as forest_votes; a row without features has no prediction."""
    kind = dict(stream.dtypes)["key"]
    each = stream.select("key", "seq", F.col("target").cast("long").alias("target"), "features")
    return each.groupBy("key").transformWithStateInPandas(BoostProcessor(settings), f"key {kind}, seq long, prediction long", "Append", "None")
