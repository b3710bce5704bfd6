import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgersieve.operators import quantiles
from ledgersieve.operators.quantiles import grouped_quantiles

SHARES = {"q1": 0.25, "median": 0.5, "top": 0.99}


def checked(spark, monkeypatch, rows, many):
    monkeypatch.setattr(quantiles, "MANY", many)
    found = {r["k"]: [r[name] for name in SHARES]
             for r in grouped_quantiles(rows, ["k"], F.col("v"), SHARES).collect()}
    values = {}
    for r in rows.collect():
        values.setdefault(r["k"], []).append(r["v"])
    for k, own in values.items():
        assert found[k] == pytest.approx(list(np.quantile(own, list(SHARES.values()))), rel=1e-15)


@pytest.mark.parametrize("many", [0, 5, 10**6])
def test_cut_bins_give_the_same_quantiles(spark, monkeypatch, many):
    rng = np.random.default_rng(many)
    rows = [("close", 1000 + float(x) * 1e-10) for x in rng.integers(0, 10**9, 400)]
    rows += [("tight", 1000.2 + float(x) * 2.3e-13) for x in rng.integers(0, 50, 300)] + [("tight", 1000.0)]
    rows += [("below", -5.0 - float(x) * 1e-6) for x in rng.integers(0, 300, 200)]
    rows += [("equal", 7.0)] * 50 + [("zero", 0.0)] * 9 + [("tiny", 5e-324 * i) for i in range(20)]
    rows += [("wide", float(x)) for x in rng.normal(0, 1e6, 300)] + [("one", 3.5)]
    checked(spark, monkeypatch, spark.createDataFrame(rows, "k string, v double"), many)


def test_a_million_values_in_one_bin_meet_in_no_task(spark):
    """A million neighbours and one value apart: nearly all lie in a few parts of the bin."""
    rows = spark.range(1_000_000).selectExpr("'a' as k", "1000.0D + id * 1.2e-13D as v").union(
        spark.sql("select 'a', 1000.2D"))
    values = rows.selectExpr("k", "1L as bin", "v as value").distinct().selectExpr(
        "*", "1L as n", "0L as bin_below", "1000001L as group_rows", "1000.0D as lo", "1000.2D as hi")
    wanted = "500000 >= below and 500000 < up_to"
    cut = quantiles._cut(quantiles._cut(values, ["k"], wanted, "group_rows"), ["k"], wanted, "group_rows")
    assert 0 < cut.count() < 2000
    distinct = rows.distinct().count()
    got = grouped_quantiles(rows, ["k"], F.col("v"), {"median": 0.5}).first()
    assert distinct > 500_000 and got["median"] == 1000.0 + 500_000 * 1.2e-13
