"""Codes over several dictionaries, and ranks of atoms, in one pass over the series."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.operators import codes, ranking
from shapeloom.plans import catalog


def _rows(spark, n=23, p=20):
    rng = np.random.default_rng(3)
    x = [rng.standard_normal(p if k % 4 else p + 3).tolist() for k in range(n)]
    x[5], x[10], x[15] = None, [1.0, 2.0], [1.0] * p  # no series, one shorter than the atoms, one whose places all tie
    return spark.createDataFrame([(k, str(k % 3), v) for k, v in enumerate(x)], "vec_id long, label string, x array<double>")


def _bank(spark, *seeds):
    return spark.createDataFrame([(k, np.random.default_rng(v).standard_normal(4 + v % 2).tolist()) for k, v in enumerate(seeds)], "pos long, s array<double>")


@pytest.mark.parametrize("lam", [0.0, 0.5])
def test_objectives_of_all_dictionaries_in_one_pass(spark, lam):
    rows, banks = _rows(spark), {"u": _bank(spark, 1, 2, 3), "v": _bank(spark, 3, 4)}
    made = codes.one_step_objectives(rows, banks, lam)
    got = {r.name: r for r in made.collect()}
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Join" not in plan
    for name, bank in banks.items():
        some = rows.filter("size(x) > 0")
        assert got[name].objective == pytest.approx(codes.objective(codes.one_step_terms(some, bank, lam), lam).first()[0])
        assert got[name].n == some.count() == 22


def test_ranks_equal_those_of_exploded_codes(spark):
    rows, bank = _rows(spark), _bank(spark, 1, 2, 3, 4, 5)
    rows = rows.unionByName(rows.filter("vec_id < 3"))  # ids that come twice rank together
    want = ranking.rank_coefficients(codes.one_step_codes(rows, bank, 0.5), 2).collect()
    assert sorted(ranking.overall_ranks(codes.one_step_ranks(rows, bank, 0.5), 2).collect()) == sorted(want)


def test_bakeoff_counts_no_null_series(spark, tmp_path):
    """A held-out series without values has no row in the SQL; it raised."""
    import duckdb

    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    e.withColumn("embedding", F.when(F.col("vec_id") != 400, F.when(F.col("vec_id") == 405, F.slice("embedding", 1, 9)).otherwise(F.col("embedding")))).coalesce(1).write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    want = sorted(con.sql(catalog.SQL["policy_bakeoff"]).fetchall())
    assert sorted(map(tuple, catalog.QUERIES["policy_bakeoff"](spark, str(tmp_path)).collect())) == want
