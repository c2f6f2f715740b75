"""The table function against the DataFrame form, and MAT-files written, read and cut."""

import io
import random
import struct

import numpy as np
import pytest

from shapeloom.functions import tables
from shapeloom.operators import series
from shapeloom.sources import generators, mat


def test_cut_windows_in_sql(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice(["a", "b", None]), float(k) if k % 9 else None, "x") for k in range(200)]
    df = spark.createDataFrame(rows, "seq long, label string, value double, start string").repartition(4)
    df.createOrReplaceTempView("rows_to_cut")
    tables.register(spark)
    for window, step, most in ((5, 3, 1000), (4, 1, 7), (90, 2, 5)):
        got = spark.sql(f"SELECT * FROM cut_windows(TABLE(rows_to_cut), {window}, {step}, {most})").collect()
        want = series.sliding_windows(df, window, step, most).collect()
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, map(tuple, want)))
    assert spark.sql("SELECT * FROM cut_windows(TABLE(SELECT * FROM rows_to_cut WHERE false), 5, 3, 10)").count() == 0
    for call, why in (("TABLE(SELECT 1 AS label), 5, 3, 10", "lacks seq, value"), ("TABLE(rows_to_cut), 0, 3, 10", "window has to be"), ("1, 5, 3, 10", "has to be a table")):
        with pytest.raises(Exception, match=why):
            spark.sql(f"SELECT * FROM cut_windows({call})").collect()


@pytest.mark.parametrize("compressed", ["true", "false"])
def test_mat_round_trip(spark, tmp_path, compressed):
    mat.register(spark)
    rng = np.random.default_rng(0)
    rows = [([float(k), *rng.standard_normal(3).tolist(), float("nan") if k % 50 == 0 else 0.5],) for k in range(500)]
    df = spark.createDataFrame(rows, "values array<double>").repartition(3)
    to = f"file://{tmp_path}/out"
    df.write.format("mat").option("compressed", compressed).mode("append").save(to)
    back = spark.read.format("mat").option("rows", 64).load(to)
    assert sorted(map(str, (r["values"] for r in back.collect()))) == sorted(map(str, (r[0] for r in rows)))
    assert back.rdd.getNumPartitions() == (3 if compressed == "true" else sum(-(-n // 64) for n in [r["count"] for r in back.groupBy("file").count().collect()]))
    df.limit(5).coalesce(1).write.format("mat").mode("overwrite").save(to)
    assert spark.read.format("mat").load(to).count() == 5 and not list((tmp_path / "out").glob("_attempts*"))


def test_mat_variables_types_and_errors(spark, tmp_path):
    def element(kind, data, order="<"):
        return struct.pack(order + "II", kind, len(data)) + data + b"\0" * (-len(data) % 8)

    def array(name, values, kind, klass, order, small=False):
        named = struct.pack(order + "I", len(name) << 16 | 1) + name.encode().ljust(4, b"\0") if small else element(1, name.encode(), order)
        parts = element(6, struct.pack(order + "II", klass, 0), order) + element(5, struct.pack(order + "ii", *values.shape), order) + named + element(kind, values.astype(order + mat.TYPES[kind]).tobytes("F"), order)
        return struct.pack(order + "II", 14, len(parts)) + parts

    for order, mark in (("<", b"IM"), (">", b"MI")):
        a, b = np.arange(6).reshape(2, 3), np.arange(7, dtype=float).reshape(7, 1)
        text = array("s", np.array([[65, 66]]), 4, 4, order)  # characters are left out
        data = b"x".ljust(124) + struct.pack(order + "H", 0x0100) + mark + text + array("ab", a, 1, 8, order, small=True) + array("second", b, 9, 6, order)
        (tmp_path / "v.mat").write_bytes(data)
        mat.register(spark)
        read = lambda **o: [(r.row, r["values"]) for r in spark.read.format("mat").options(**o).load(str(tmp_path / "v.mat")).orderBy("row").collect()]
        assert read() == [(0, [0, 1, 2]), (1, [3, 4, 5])] and read(variable="second") == [(k, [float(k)]) for k in range(7)]
        for cut in (100, 300, len(data) - 1):
            with pytest.raises(ValueError):
                list(mat.arrays(io.BytesIO(data[:cut]), cut))
        with pytest.raises(Exception, match="has no array"):
            read(variable="third")
    squeezed = mat.packed("x", np.ones((50, 2)), True)
    broken = squeezed[:132] + struct.pack("<I", len(squeezed) - 136 - 4) + squeezed[136:-4]
    with pytest.raises(ValueError, match="cut short"):
        list(mat.arrays(io.BytesIO(broken), len(broken)))


def test_streams_driven_by_rows(spark):
    params, rng = [[0.6, 0.2], [-0.4, 0.3]], random.Random(2)
    rows = [(s, t, None if t == 7 else rng.random()) for s in (4, 9) for t in range(60)]
    got = {(r.stream, r.time): (r.value, r.regime) for r in generators.ar_over(spark.createDataFrame(rows, "stream long, time long, noise double").repartition(3), params, [30], 10).collect()}
    for s in (4, 9):
        y = []
        for t in range(60):
            e, r = next(v for a, b, v in rows if (a, b) == (s, t)) or 0.0, min(1.0, max(0.0, (t - 25) / 10))
            c = [(1 - r) * p + r * q for p, q in zip(*params)]
            y.append(e + (c[0] * y[-1] + c[1] * y[-2] if t > 1 else 0))
            assert got[s, t] == (pytest.approx(y[-1]), pytest.approx(r))
    sea = generators.sea_over(spark.range(300).selectExpr("id AS time", "if(id % 50 = 0, null, id % 100) AS key"), 300).collect()
    assert len(sea) == 300 and all(0 <= r.f1 < 10 and r["class"] == int(r.f1 + r.f2 <= generators.SEA_THETA[r.concept]) for r in sea) and {r.concept for r in sea} == {0, 1, 2}
    assert generators.ar_over(spark.createDataFrame([], "stream long, time long, noise double"), params, [3]).count() == 0
