"""The convolutional network against finite differences, plain loops and separable series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import convolution, tables
from shapeloom.operators.convolution import Network


@pytest.mark.parametrize("channels,widths", [(1, (3, 3, 1)), (2, (5, 4, 3))])
def test_gradient_is_that_of_finite_differences(channels, widths):
    rng = np.random.default_rng(0)
    x, y = rng.standard_normal((6, 9, channels)), rng.integers(0, 3, 6)
    own = dict(classes=3, channels=channels, filters=(4, 3, 5), widths=widths)
    net = Network(**own, seed=1)
    got = net.sums(x, y)
    assert len(got) == len(net.weights) + 2 * 12 + 2 and got[-1] == 6
    for k in range(len(net.weights)):
        up, down = (Network(**own, weights=net.weights + s * 1e-6 * (np.arange(len(net.weights)) == k)).sums(x, y)[-2] for s in (1, -1))
        assert got[k] == pytest.approx((up - down) / 2e-6, rel=1e-3, abs=1e-6)


def test_layers_against_sums_by_place():
    rng = np.random.default_rng(1)
    x = rng.standard_normal((2, 7, 2))
    net = Network(classes=2, channels=2, filters=(3,), widths=(5,), seed=2)
    net.running = np.r_[rng.standard_normal(3), rng.uniform(0.5, 2, 3)]
    kernel, bias, scale, shift, last, off = net.unpacked()
    for n in range(2):
        pooled = np.zeros(3)
        for f in range(3):
            for t in range(7):
                z = bias[f] + sum(kernel[c * 5 + j, f] * x[n, t + j - 2, c] for c in range(2) for j in range(5) if 0 <= t + j - 2 < 7)
                z = (z - net.running[f]) / np.sqrt(net.running[3 + f] + 1e-5) * scale[f] + shift[f]
                pooled[f] += max(z, 0) / 7
        z = np.exp(pooled @ last + off)
        assert np.allclose(net.forward(x, False)[0][n], z / z.sum())


def waves(n=240):
    rng = np.random.default_rng(5)
    y = rng.integers(0, 3, n)
    sizes = np.where(np.arange(n) % 4 == 0, 24, 16)
    return [(k, (np.sin(np.arange(s) * (0.4, 1.2, 2.4)[c] + rng.uniform(0, 6)) + 0.2 * rng.standard_normal(s)).tolist(), int(c)) for k, (c, s) in enumerate(zip(y, sizes))]


def test_learning_equals_a_plain_loop_and_goes_on_after_a_stop(spark):
    rows = waves()
    schema = "id long, x array<double>, target long"
    odd = [(900, None, 1), (901, [], 1), (902, [0.0, None], 1), (903, [float("nan")] * 16, 0), (904, [1.0] * 16, None), (None, [1.0] * 16, 2), (905, [float("inf")] * 16, 1)]
    df = spark.createDataFrame([*rows, *odd], schema).repartition(5)
    own = dict(classes=3, filters=(6, 8, 6), widths=(5, 3, 3), rate=0.01, seed=3)
    folder = tables.shared_folder(spark, "network")
    net, states = convolution.fit(df, Network(**own), 12, 2, folder, lot_values=1024)
    lots = -(-sum(len(r[1]) for r in rows) // (2 * 1024))
    at = {r.id: (r.s, r.l) for r in df.filter("id < 900").select("id", F.pmod(F.xxhash64("id"), F.lit(2)).alias("s"), F.pmod(F.xxhash64("id", F.lit(1)), F.lit(lots)).alias("l")).collect()}
    want = Network(**own)
    for _ in range(12):
        for s in range(2):
            sums = 0.0
            for lot in range(lots):
                for size in (16, 24):
                    part = [r for r in rows if at[r[0]] == (s, lot) and len(r[1]) == size]
                    sums = sums + want.sums(np.array([r[1] for r in part])[:, :, None], np.array([r[2] for r in part]))
            want.step(sums)
    assert lots > 1 and net.steps == 24 and np.allclose(net.weights, want.weights, atol=1e-6) and np.allclose(net.running, want.running, atol=1e-6)
    losses = [r.loss for r in states.orderBy("epoch").collect()]
    assert len(losses) == 12 and losses[-1] < losses[0] / 2
    got = {r.id: r.prediction for r in convolution.with_class(net, df).collect() if r.id is not None}
    assert {k: got[k] for k in (900, 901, 902, 903, 905)} == dict.fromkeys((900, 901, 902, 903, 905)) and got[904] in (0, 1, 2)
    assert np.mean([got[k] == c for k, _, c in rows]) > 0.9
    plain = {k: int(want.predict(np.array(x)[None, :, None])[0]) for k, x, _ in rows}
    assert np.mean([got[k] == plain[k] for k in plain]) > 0.99
    for e in (10, 11):
        tables.remove(spark, f"{folder}/states/epoch={e}")  # as if the run had been stopped there
    again, _ = convolution.fit(df, Network(**own), 12, 2, folder, lot_values=1024)
    assert again.steps == 24 and np.allclose(again.weights, net.weights, atol=1e-9)
    none, states = convolution.fit(df.filter("false"), Network(**own), 2, 2)
    assert none.steps == 0 and states.count() == 0 and convolution.with_class(none, df.filter("false")).count() == 0
