"""The adaptive forest: its trees against plain sums, and the streamed forest against a plain loop."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators.forest import HoeffdingTree, Leaf, Member, Settings
from shapeloom.streaming import feed, online_forest


def blobs(n, seed=0, classes=3, features=6, turn=None):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    centre = np.eye(features)[:classes] * 3
    shown = np.where(np.arange(n) < (turn or n), y, (y + 1) % classes)  # after the turn, classes look like others
    return rng.standard_normal((n, features)) + centre[shown], y


def test_leaf_sums_are_those_of_its_rows():
    x, y = blobs(200)
    x[5, 1] = np.inf
    leaf, w = Leaf(np.arange(6), np.zeros(3), 0), np.arange(200) % 3 + 1.0
    for row, c, k in zip(x, y, w):
        leaf.learn(row, c, k)
    for c in range(3):
        own, k = x[y == c], w[y == c]
        for f in range(6):
            use = np.isfinite(own[:, f])
            mean = np.average(own[use, f], weights=k[use])
            assert leaf.n[f, c] == k[use].sum() and leaf.mean[f, c] == pytest.approx(mean)
            assert leaf.m2[f, c] == pytest.approx((k[use] * (own[use, f] - mean) ** 2).sum())
        assert leaf.counts[c] == k.sum()


def test_splits_follow_the_bound():
    s = Settings(classes=2, grace=10, depth=1)
    tree = HoeffdingTree(s, 0)
    rng = np.random.default_rng(1)
    for k in range(400):
        y = k % 2
        tree.learn(np.array([rng.standard_normal() + 8 * y, rng.standard_normal()]), y, 1.0)
        if isinstance(tree.root, list):
            break
    bound = np.sqrt(np.log(1 / s.delta) / (2 * (k + 1)))
    assert isinstance(tree.root, list) and tree.root[0] == 0 and 1 < tree.root[1] < 7 and bound < 1  # gains of nearly 1 and 0
    assert k + 1 >= 10 and np.sqrt(np.log(1 / s.delta) / (2 * (k + 1 - 10))) > 0.9 if k + 1 > 10 else True
    noise = HoeffdingTree(Settings(classes=2, grace=10, tie=0.0), 0)
    for k in range(300):
        noise.learn(rng.standard_normal(2), k % 2, 1.0)
    assert isinstance(noise.root, Leaf)


def test_member_replaces_its_tree_after_a_drift():
    x, y = blobs(3000, turn=1500)
    member, right = Member(Settings(classes=3, seed=1), 0), []
    for k in range(len(x)):
        right.append(int(member.vote(x[k]).argmax()) == y[k])
        member.learn(x[k], int(y[k]), k)
    assert member.warnings >= 1 and member.drifts >= 1 and np.mean(right[1000:1500]) > 0.8 and np.mean(right[2500:]) > 0.8
    still = Member(Settings(classes=3, seed=1, warning=None, drift=None), 0)
    for k in range(len(x)):
        still.learn(x[k], int(y[k]), k)
    assert (still.drifts, still.warnings) == (0, 0)


def plain_forest(rows, settings):
    members, out = [Member(settings, t) for t in range(settings.trees)], {}
    for number, y, x in rows:
        votes = np.sum([m.vote(np.array(x)) for m in members], axis=0)
        out[number] = (int(votes.argmax()), sum(m.drifts for m in members), sum(m.warnings for m in members))
        if y is not None:
            for m in members:
                m.learn(np.array(x), y, number)
    return out


def test_streamed_forest_equals_a_plain_loop(spark):
    x, y = blobs(2000, turn=1200)
    rows = [(k, None if k % 97 == 0 else int(c), v.tolist()[: 6 if k > 300 else 4], k // 400) for k, (v, c) in enumerate(zip(x, y))]
    s = Settings(classes=3, trees=6, seed=4)
    df = spark.createDataFrame(rows, "seq long, target long, features array<double>, part long").repartition(5)
    got = {r.seq: (r.prediction, r.drifts, r.warnings) for r in online_forest.replay_forest(df, "part", s).collect()}
    assert got == plain_forest([r[:3] for r in rows], s)
    assert max(v[1] for v in got.values()) > 0


def test_stopped_stream_goes_on(spark):
    x, y = blobs(120)
    rows = [(k, int(c), v.tolist(), k // 40) for k, (v, c) in enumerate(zip(x, y))]
    s, folder = Settings(classes=3, trees=2, seed=4), feed.new_folder(spark, "forest")
    df = spark.createDataFrame(rows, "seq long, target long, features array<double>, part long")
    schema = df.schema.simpleString()
    for part in range(3):  # a query of its own for each file: the trees come from the state store
        df.filter(F.col("part") == part).coalesce(1).write.mode("append").parquet(f"{folder}/feed")
        feed.run_to_end(online_forest.forest_votes(feed.stream_of(spark, folder, df.schema), s), folder, "votes")
    assert schema and {r.seq: (r.prediction, r.drifts, r.warnings) for r in online_forest.elected(spark.read.schema(online_forest.VOTES).parquet(f"{folder}/votes")).collect()} == plain_forest([r[:3] for r in rows], s)


def test_class_incremental_run(spark):
    rng = np.random.default_rng(2)
    base = {c: rng.standard_normal(24) * 2 for c in "abcd"}
    rows = [(k, c, (base[c] + 0.3 * rng.standard_normal(24)).tolist()) for k, c in enumerate("abcd" * 60)]
    df = spark.createDataFrame(rows, "seq long, label string, x array<double>")
    got = sorted(online_forest.class_incremental(df, list("abcd"), ((3, 2), (2, 4)), atoms=2, share=0.25, trees=3).collect(), key=lambda r: r.seq)
    assert [r.seq for r in got] == list(range(len(got))) and {r.atoms for r in got if r.epoch < 3} == {4} and {r.atoms for r in got if r.epoch >= 3} == {8}
    assert {r.label for r in got if r.epoch < 3} == {"a", "b"} and got[-1].accuracy == pytest.approx(np.mean([r.label == r.prediction for r in got]))
    assert np.mean([r.label == r.prediction for r in got if r.epoch == 2]) > 0.8


def test_boosted_streams_equal_plain_loops(spark):
    x, y = blobs(600)
    rows = [("uvw"[k % 3], k, int(c), v.tolist(), k // 200) for k, (v, c) in enumerate(zip(x, y))] + [("u", 600, 1, None, 2), ("u", 601, None, x[0].tolist(), 2)]
    s, folder = Settings(classes=3, trees=5, grace=20, seed=9), feed.new_folder(spark, "boost")
    df = spark.createDataFrame(rows, "key string, seq long, target long, features array<double>, part long").repartition(4)
    feed.lay_out(df, "part", folder)
    feed.run_to_end(online_forest.boosted_predictions(feed.stream_of(spark, folder, df.schema), s), folder, "out")
    got = {r.seq: r.prediction for r in spark.read.parquet(f"{folder}/out").collect()}
    want, held = {600: None}, {k: online_forest.Boosted(s) for k in "uvw"}
    for key, seq, target, features, _ in rows:
        if features is not None:
            want[seq] = int(held[key].vote(np.array(features)).argmax())
            if target is not None:
                held[key].learn(np.array(features), target, seq)
    assert got == want and np.mean([want[r[1]] == r[2] for r in rows[300:600]]) > 0.8


def test_boosting_weighs_by_errors():
    """By the published rule: with n rows seen, the weights that trees have right and wrong halve apart after each tree."""
    x, y = blobs(200)
    one = online_forest.Boosted(Settings(classes=3, trees=3, grace=20, seed=2))
    for k in range(200):
        right, wrong = one.right.copy(), one.wrong.copy()
        one.learn(x[k], int(y[k]), k)
        weight = 1.0
        for t in range(3):
            hit = one.right[t] > right[t]
            assert (one.right[t] - right[t] + one.wrong[t] - wrong[t]) == pytest.approx(weight)
            weight *= (one.right[t] + one.wrong[t]) / (2 * (one.right[t] if hit else one.wrong[t]))


def test_a_leaf_keeps_its_model_until_it_learns():
    """Votes of rows between two learned ones take logarithms once; the kept parts aren't state, and are gone when a row is learned."""
    import pickle

    rng, leaf = np.random.default_rng(4), Leaf(np.arange(3), np.zeros(2), 0)
    for k in range(40):
        x = rng.standard_normal(3) + k % 2
        if k % 5 == 0:
            x[1] = np.nan
        fresh = pickle.loads(pickle.dumps(leaf))
        assert not {"_model", "_last"} & set(fresh.__dict__)
        kept = leaf._parts()
        assert [p.tolist() for p in leaf.shares(x)] == [p.tolist() for p in fresh.shares(x.copy())] and leaf._parts() is kept
        leaf.learn(x, k % 2, 1.0), fresh.learn(x, k % 2, 1.0)
        assert leaf._parts() is not kept and [p.tolist() for p in leaf.shares(x)] == [p.tolist() for p in fresh.shares(x.copy())]
