"""First-digit test of amounts."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s

DIGITS = range(1, 10)


def digit_counters(ledger: DataFrame, amount: str = "amount") -> DataFrame:
    """One row: how many amounts lead with each digit, and how many there are."""
    digits = ledger.select(s.leading_digit(F.col(amount)).alias("digit"))
    counted = digits.agg(*(F.count_if(F.col("digit") == d).alias(f"d{d}") for d in DIGITS))
    return counted.withColumn("sample_size", reduce(add, (F.col(f"d{d}") for d in DIGITS)))


def _actual(digit: int) -> Column:
    return F.try_divide(F.col(f"d{digit}"), F.col("sample_size"))


def benford_digits(ledger: DataFrame, amount: str = "amount") -> DataFrame:
    """Nine rows: actual and expected share of each leading digit."""
    rows = F.array(*(
        F.struct(
            F.lit(d).alias("digit"),
            F.col(f"d{d}").alias("actual_count"),
            _actual(d).alias("actual_proportion"),
            F.lit(s.expected_share(d)).alias("expected_proportion"),
        )
        for d in DIGITS
    ))
    return (
        digit_counters(ledger, amount)
        .select(F.inline(rows))
        .withColumn("actual_pct", s.rint_to(F.col("actual_proportion") * 100, 2))
        .withColumn("expected_pct", s.rint_to(F.col("expected_proportion") * 100, 2))
    )


def benford_stats(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), amount: str = "amount"
) -> DataFrame:
    """One row: chi-square test, mean absolute deviation and conformity."""
    n = F.col("sample_size")
    square_terms, gaps = [], []
    for d in DIGITS:
        expected = F.lit(s.expected_share(d))
        square_terms.append(F.try_divide(
            (F.col(f"d{d}") - expected * n) * (F.col(f"d{d}") - expected * n), expected * n))
        gaps.append(F.abs(_actual(d) - expected))
    half = F.col("chi2") / 2
    # Upper tail of the chi-square distribution with 8 degrees of freedom
    tail = F.exp(-half) * (1 + half + half * half / 2 + half * half * half / 6)
    reliable = n >= cfg.benford_min_sample
    return (
        digit_counters(ledger, amount)
        .withColumn("chi2", reduce(add, square_terms))
        .withColumn("p", tail)
        .withColumn("mad", reduce(add, gaps) / 9)
        .select(
            n,
            reliable.alias("sample_size_reliable"),
            F.when(~reliable, F.format_string(
                fv.SAMPLE_SIZE_WARNING, n, F.lit(cfg.benford_min_sample))
            ).alias("sample_size_warning"),
            s.rint_to(F.col("chi2"), 3).alias("chi2_statistic"),
            s.rint_to(F.col("p"), 5).alias("p_value"),
            (F.col("p") < 0.05).alias("is_statistically_significant"),
            s.rint_to(F.col("mad"), 5).alias("mad_score"),
            s.conformity_label(F.col("mad")).alias("conformity_rating"),
        )
    )


def overrepresented_digits(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), amount: str = "amount"
) -> DataFrame:
    """The digits (nine at most) that lead more often than expected, largest excess first."""
    excess = F.col("actual_proportion") - F.col("expected_proportion")
    return (
        benford_digits(ledger, amount)
        .filter(excess > cfg.benford_tolerance)
        .select("digit", "actual_pct", "expected_pct",
                s.rint_to(excess * 100, 2).alias("excess_pct"))
        .orderBy(F.col("excess_pct").desc(), "digit")
    )


def flag_benford(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), amount: str = "amount"
) -> DataFrame:
    """Transactions whose leading digit is over-represented."""
    digits = overrepresented_digits(ledger, cfg, amount).select(
        F.col("digit").alias("leading_digit"))
    flagged = ledger.withColumn("leading_digit", s.leading_digit(F.col(amount))).join(
        F.broadcast(digits), "leading_digit", "left_semi")
    return flagged.select(
        *ledger.columns, "leading_digit", F.lit(fv.BENFORD_REASON).alias("flag_reason"))
