"""Unusual amounts within each account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators.quantiles import grouped_quantiles
from ledgersieve.sources.kept import kept


# --- Account statistics, one row per account --------------------------------

def _named(ledger: DataFrame, account: str) -> DataFrame:
    return ledger.filter(F.col(account).isNotNull())


def account_medians(
    ledger: DataFrame, amount: str = "amount", account: str = "account"
) -> DataFrame:
    """Exact median and row count per account."""
    medians = grouped_quantiles(
        _named(ledger, account), [account], F.col(amount), {"median": 0.5}, size="account_rows")
    return kept(medians, "medians")


def account_spread(
    ledger: DataFrame, medians: DataFrame, amount: str = "amount", account: str = "account"
) -> DataFrame:
    """Median, row count and median absolute deviation (``mad``) per account."""
    deviation = F.abs(F.col(amount) - F.col("median"))
    compared = ledger.select(account, amount).join(medians, account)
    spread = grouped_quantiles(compared, [account], deviation, {"mad": 0.5}).drop("group_rows")
    return kept(medians.join(spread, account), "spread")


def account_quartiles(
    ledger: DataFrame, amount: str = "amount", account: str = "account"
) -> DataFrame:
    shares = {"q1": 0.25, "median": 0.5, "q3": 0.75}
    quartiles = grouped_quantiles(
        _named(ledger, account), [account], F.col(amount), shares, size="account_rows")
    return kept(quartiles, "quartiles")


def account_moments(
    ledger: DataFrame, amount: str = "amount", account: str = "account"
) -> DataFrame:
    """Row count, mean and sample standard deviation per account."""
    return kept(
        _named(ledger, account).groupBy(account).agg(
            F.count("*").alias("account_rows"),
            F.avg(amount).alias("mean"),
            F.stddev_samp(amount).alias("std"),
        ),
        "moments",
    )


# --- Screens ----------------------------------------------------------------

def _direction(amount: Column, centre: Column) -> Column:
    return F.when(amount > centre, "high").otherwise("low")


def outlier_reason(method: str, account: Column, direction: Column) -> Column:
    return F.concat(
        F.lit(fv.OUTLIER_REASON_HEAD % fv.OUTLIER_METHOD_NAMES[method]),
        account.cast("string"),
        F.lit(fv.OUTLIER_REASON_MIDDLE),
        direction,
        F.lit(fv.OUTLIER_REASON_TAIL),
    )


def modified_z(amount: Column) -> Column:
    """Modified z-score against ``median`` and ``mad`` of the account."""
    mad = F.when(F.col("mad") == 0, F.lit(fv.DEGENERATE_MAD)).otherwise(F.col("mad"))
    return F.lit(fv.NORMAL_CONSISTENCY) * (amount - F.col("median")) / mad


def is_modified_z_outlier(amount: Column, cfg: ScreenConfig) -> Column:
    enough = F.col("account_rows") >= cfg.min_account_rows
    return enough & (F.abs(modified_z(amount)) > cfg.modified_z_threshold)


def detect_outliers_modified_zscore(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    account: str = "account",
    spread: DataFrame | None = None,
) -> DataFrame:
    if spread is None:
        spread = account_spread(
            ledger, account_medians(ledger, amount, account), amount, account)
    value = F.col(amount)
    direction = _direction(value, F.col("median"))
    return (
        ledger.join(spread, account)
        .filter(is_modified_z_outlier(value, cfg))
        .select(
            *ledger.columns,
            s.rint_to(modified_z(value), 2).alias("modified_z_score"),
            s.rint_to(F.col("median"), 2).alias("account_median"),
            direction.alias("direction"),
            outlier_reason("modified_zscore", F.col(account), direction).alias("flag_reason"),
        )
    )


def detect_outliers_iqr(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    account: str = "account",
) -> DataFrame:
    reach = (F.col("q3") - F.col("q1")) * cfg.iqr_multiplier
    fences = (
        account_quartiles(ledger, amount, account)
        .filter(F.col("account_rows") >= cfg.min_account_rows)
        .select(account, "q1", "q3", (F.col("q1") - reach).alias("lower"),
                (F.col("q3") + reach).alias("upper"))
    )
    value = F.col(amount)
    direction = _direction(value, F.col("upper"))
    return (
        ledger.join(fences, account)
        .filter((value < F.col("lower")) | (value > F.col("upper")))
        .select(
            *ledger.columns,
            s.rint_to(F.col("q1"), 2).alias("account_q1"),
            s.rint_to(F.col("q3"), 2).alias("account_q3"),
            s.rint_to(F.col("lower"), 2).alias("iqr_lower_bound"),
            s.rint_to(F.col("upper"), 2).alias("iqr_upper_bound"),
            direction.alias("direction"),
            outlier_reason("iqr", F.col(account), direction).alias("flag_reason"),
        )
    )


def detect_outliers_zscore(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    account: str = "account",
) -> DataFrame:
    moments = account_moments(ledger, amount, account).filter(
        (F.col("account_rows") >= cfg.min_account_rows) & (F.col("std") != 0)
    ).select(account, "mean", "std")
    value = F.col(amount)
    z = (value - F.col("mean")) / F.col("std")
    direction = _direction(value, F.col("mean"))
    return (
        ledger.join(moments, account)
        .filter(F.abs(z) > cfg.z_threshold)
        .select(
            *ledger.columns,
            s.rint_to(z, 2).alias("z_score"),
            s.rint_to(F.col("mean"), 2).alias("account_mean"),
            direction.alias("direction"),
            outlier_reason("zscore", F.col(account), direction).alias("flag_reason"),
        )
    )


METHODS = {
    "modified_zscore": detect_outliers_modified_zscore,
    "iqr": detect_outliers_iqr,
    "zscore": detect_outliers_zscore,
}


def detect_outliers(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), method: str = "modified_zscore", **columns
) -> DataFrame:
    if method not in METHODS:
        raise ValueError(f"There is no outlier test {method!r}; there are {', '.join(METHODS)}.")
    return METHODS[method](ledger, cfg, **columns)


# --- Summaries --------------------------------------------------------------

def summarize_outliers(flagged: DataFrame, amount: str = "amount") -> DataFrame:
    return flagged.agg(
        F.count("*").alias("total_flagged"),
        F.count_if(F.col("direction") == "high").alias("high_side"),
        F.count_if(F.col("direction") == "low").alias("low_side"),
        s.rint_to(s.total(F.col(amount)), 2).alias("total_value"),
    )


def outliers_by_account(flagged: DataFrame, account: str = "account") -> DataFrame:
    return (
        flagged.groupBy(account).agg(F.count("*").alias("outliers_flagged"))
        .orderBy(F.col("outliers_flagged").desc(), account)
    )


def account_box_stats(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    amount: str = "amount",
    account: str = "account",
) -> DataFrame:
    """Per account: quartiles, and the most extreme amounts within reach of the box."""
    boxes = account_quartiles(ledger, amount, account)
    reach = (F.col("q3") - F.col("q1")) * cfg.iqr_multiplier
    value = F.col(amount)
    whiskers = (
        ledger.join(boxes, account)
        .groupBy(account)
        .agg(
            F.min(F.when(value >= F.col("q1") - reach, value)).alias("low"),
            F.max(F.when(value <= F.col("q3") + reach, value)).alias("high"),
        )
    )
    return boxes.join(whiskers, account).select(
        account,
        "account_rows",
        *(s.rint_to(F.col(c), 2).alias(c) for c in ("q1", "median", "q3")),
        s.rint_to(F.least("low", "q1"), 2).alias("whisker_low"),
        s.rint_to(F.greatest("high", "q3"), 2).alias("whisker_high"),
    )
