import math

import numpy as np
import pytest

from ledgersieve import ScreenConfig
from ledgersieve.operators import outliers, quantiles
from ledgersieve.operators.quantiles import grouped_quantiles
from pyspark.sql import functions as F

from tests.conftest import ids


def accounts(ledger, **groups):
    return ledger(*({"account": None if name == "missing" else name, "amount": float(v),
                     "transaction_id": f"{name}{i}"}
                    for name, values in groups.items() for i, v in enumerate(values)))


AROUND = [100_000 + d for d in (-900, -400, -100, 0, 50, 200, 600, 800, -250, 340)]


def test_extreme_amount_is_flagged_within_its_own_account(ledger):
    rows = accounts(ledger, savings=[*AROUND, 500_000], loans=[5_000_000 + d for d in AROUND])
    flagged = outliers.detect_outliers(rows)
    assert ids(flagged) == ["savings10"]
    row = flagged.first()
    assert row["direction"] == "high" and "'savings' — high extreme" in row["flag_reason"]
    assert "savings10" in ids(outliers.detect_outliers(rows, method="iqr"))
    assert outliers.detect_outliers(rows, method="zscore").count() <= 1
    low = outliers.detect_outliers(accounts(ledger, savings=[*AROUND, 1]), method="iqr").first()
    assert low["direction"] == "low" and low["iqr_lower_bound"] > 1


def test_small_and_unnamed_accounts_are_skipped(ledger):
    rows = accounts(ledger, two=[1, 1e9], missing=[1, 1, 1, 1, 1e9])
    for method in outliers.METHODS:
        assert outliers.detect_outliers(rows, method=method).count() == 0


def test_degenerate_spread(ledger):
    rows = accounts(ledger, flat=[5, 5, 5, 5, 6], same=[7, 7, 7, 7])
    assert ids(outliers.detect_outliers(rows)) == ["flat4"]
    assert outliers.detect_outliers(rows, method="zscore").count() == 0


def test_unknown_method(ledger):
    with pytest.raises(ValueError, match="mystery"):
        outliers.detect_outliers(ledger({}), method="mystery")


def test_classic_score_is_masked_where_the_robust_one_is_not(ledger):
    rows = accounts(ledger, a=[100, 101, 99, 102, 98, 10_000, 10_100])
    assert ids(outliers.detect_outliers(rows)) == ["a5", "a6"]
    assert outliers.detect_outliers(rows, method="zscore").count() == 0


def test_summaries(ledger):
    flagged = outliers.detect_outliers(accounts(
        ledger, a=[100, 101, 99, 102, 98, 10_000, -10_000.255], b=[*AROUND, 900_000]))
    summary = outliers.summarize_outliers(flagged).first()
    assert (summary["total_flagged"], summary["high_side"], summary["low_side"]) == (3, 2, 1)
    assert [tuple(r) for r in outliers.outliers_by_account(flagged).collect()] == [("a", 2), ("b", 1)]


def test_box_statistics(ledger):
    values = [1, 2, 3, 4, 5, 6, 7, 100]
    box = outliers.account_box_stats(accounts(ledger, a=values)).first()
    q1, median, q3 = np.percentile(values, [25, 50, 75])
    assert (box["q1"], box["median"], box["q3"]) == (q1, median, q3)
    assert (box["whisker_low"], box["whisker_high"]) == (1, 7)


SHAPES = {
    "normal": lambda rng: rng.normal(0, 1e4, 501),
    "money": lambda rng: np.round(rng.lognormal(8, 2, 400), 2),
    "tiny": lambda rng: rng.random(97) * 1e-9,
    "huge": lambda rng: rng.random(50) * 1e200 - 5e199,
    "ties": lambda rng: rng.choice([-1.0, 0.0, 3.5], 300),
    "close": lambda rng: 1e6 + rng.random(200),
    "one": lambda rng: np.array([7.25]),
    "two": lambda rng: np.array([-7.25, 9.0]),
}


@pytest.mark.parametrize("per_e_fold", [1, 4096])
def test_quantiles_equal_numpy(spark, monkeypatch, per_e_fold):
    # Wide bins hold many different values
    monkeypatch.setattr(quantiles, "PER_E_FOLD", per_e_fold)
    rng = np.random.default_rng(3)
    data = {name: shape(rng) for name, shape in SHAPES.items()}
    rows = spark.createDataFrame(
        [(name, float(v)) for name, values in data.items() for v in values] + [("one", None)],
        "name string, v double").repartition(5)
    shares = {"low": 0.0, "q1": 0.25, "median": 0.5, "p61": 0.61, "q3": 0.75, "high": 1.0}
    got = {r["name"]: r for r in grouped_quantiles(rows, ["name"], F.col("v"), shares).collect()}
    assert set(got) == set(data)
    for name, values in data.items():
        assert got[name]["group_rows"] == len(values)
        for label, share in shares.items():
            assert math.isclose(got[name][label], np.quantile(values, share), rel_tol=1e-14,
                                abs_tol=1e-300), (name, label)


def test_infinite_amounts_are_the_outermost(spark):
    rows = spark.createDataFrame(
        [("a", v) for v in (float("inf"), 1.0, 2.0, 3.0, float("-inf"), float("nan"))]
        + [("b", float("inf"))], "name string, v double")
    got = {r["name"]: tuple(r)[1:] for r in grouped_quantiles(
        rows, ["name"], F.col("v"), {"low": 0.0, "mid": 0.5, "high": 1.0}).collect()}
    assert got["a"][:3] == (5, float("-inf"), 2.0) or got["a"][0] == 5 and got["a"][2] == 2.0
    assert got["b"][0] == 1 and got["b"][2] == float("inf")


def test_statistics_are_exact_when_one_account_holds_most_rows(ledger, spark):
    rows = spark.range(30_000).select(
        F.concat(F.lit("T"), F.col("id").cast("string")).alias("transaction_id"),
        F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("a"), F.col("id") % 50))
        .alias("account"),
        (F.pmod(F.xxhash64("id"), F.lit(1_000_000)) / 100).alias("amount"))
    spread = {r["account"]: r for r in outliers.account_spread(
        rows, outliers.account_medians(rows)).collect()}
    hot = np.array([r["amount"] for r in rows.filter("account = 'hot'").collect()])
    assert spread["hot"]["median"] == np.median(hot)
    assert spread["hot"]["mad"] == np.median(np.abs(hot - np.median(hot)))
    assert spread["hot"]["account_rows"] == len(hot)


def test_threshold_is_strict(ledger):
    # median 0, mad 1: the score of 10 is 6.745
    rows = accounts(ledger, a=[-1, -1, 0, 1, 1, 10])
    cut = 0.6745 * 9.5 / 1.0
    spread = outliers.account_spread(rows, outliers.account_medians(rows)).first()
    assert spread["median"] == 0.5 and spread["mad"] == 1.0
    assert outliers.detect_outliers(rows, ScreenConfig(modified_z_threshold=cut)).count() == 0
    assert outliers.detect_outliers(rows, ScreenConfig(modified_z_threshold=cut - 1e-9)).count() == 1
