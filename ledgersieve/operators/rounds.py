"""Round amounts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s

ALL_TIERS = "(all tiers)"


def reported_tier(cfg: ScreenConfig, amount: str = "amount") -> Column:
    """Tier label of the amount if the tier is at or above the minimum, else null.

    A higher minimum hides the lower tiers; it does not move amounts between tiers.
    """
    minimum = cfg.round_min_tier
    if minimum is None:
        return s.roundness_tier(F.col(amount), cfg.round_tiers)
    labels = [tier.label for tier in cfg.round_tiers if tier.multiple >= minimum]
    if not labels:
        raise ValueError(f"A minimum tier of {minimum} excludes all roundness tiers.")
    tier = s.roundness_tier(F.col(amount), cfg.round_tiers)
    return F.when(tier.isin(labels), tier)


def round_reason(tier: Column) -> Column:
    return F.concat(F.lit(fv.ROUND_REASON_HEAD), tier, F.lit(fv.ROUND_REASON_TAIL))


def flag_round_numbers(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), amount: str = "amount"
) -> DataFrame:
    return (
        ledger.withColumn("roundness_tier", reported_tier(cfg, amount))
        .filter(F.col("roundness_tier").isNotNull())
        .withColumn("flag_reason", round_reason(F.col("roundness_tier")))
    )


def summarize_round_numbers(
    flagged: DataFrame, cfg: ScreenConfig = ScreenConfig(), amount: str = "amount"
) -> DataFrame:
    """Rows and exposure of each tier that occurs, and of all tiers together."""
    groups = {ALL_TIERS: F.lit(True)}
    for tier in cfg.round_tiers:
        groups[tier.label] = F.col("roundness_tier") == tier.label
    sums = []
    for i, condition in enumerate(groups.values()):
        sums.append(F.count_if(condition).alias(f"rows{i}"))
        sums.append(s.total(F.when(condition, F.col(amount))).alias(f"value{i}"))
    rows = F.array(*(
        F.struct(
            F.lit(label).alias("roundness_tier"),
            F.col(f"rows{i}").alias("total_flagged"),
            s.rint_to(F.col(f"value{i}"), 2).alias("total_exposure"),
        )
        for i, label in enumerate(groups)
    ))
    return flagged.agg(*sums).select(F.inline(rows)).filter(
        (F.col("total_flagged") > 0) | (F.col("roundness_tier") == ALL_TIERS))
