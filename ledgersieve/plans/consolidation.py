"""All findings of a transaction in one row."""

from __future__ import annotations

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.operators import duplicates as dup
from ledgersieve.operators import outliers, parties, rounds, timing
from ledgersieve.plans.scoring import ID, base_columns, times
from ledgersieve.sources.kept import kept

# In the order in which reasons are listed
METHODS = list(fv.METHOD_TITLES)


DIRECTIONS = ("high", "low")


def _kinds(cfg: ScreenConfig) -> list[tuple[str, Column, Column | None]]:
    """Method, condition on a row of the findings and text of each kind of reason, as listed.

    Kinds of a method are in the order of their texts. Those of outliers hold the account, so they
    have no text here, and are put in order where they are listed.
    """
    weekend, late = (F.coalesce(F.col(c), F.lit(False)) for c in ("is_weekend", "is_after_hours"))
    labels = sorted({tier.label for tier in cfg.round_tiers},
                    key=lambda label: (label + fv.ROUND_REASON_TAIL).encode())
    categories = sorted(fv.RELATED_PARTY_REASONS, key=lambda c: fv.RELATED_PARTY_REASONS[c].encode())
    times_of_day = ((False, False), (True, False), (True, True), (False, True))
    kinds = {
        "benford": [(F.col("benford_hit"), F.lit(fv.BENFORD_REASON))],
        "duplicate": [(F.col("duplicate_hit"), dup.duplicate_reason(cfg))],
        "round_number": [(F.col("roundness_tier") == label, rounds.round_reason(F.lit(label)))
                         for label in labels],
        "outlier": [((F.col("outlier_direction") == way) & F.col("account").isNotNull(), None)
                    for way in DIRECTIONS],
        "journal_entry": [(F.col("journal_hit") & (weekend == w) & (late == l),
                           timing.timing_reason(cfg, F.lit(w), F.lit(l))) for w, l in times_of_day],
        "related_party": [(F.col("related_party_category") == category,
                           parties.related_reason(F.lit(category))) for category in categories],
    }
    return [(method, holds, text) for method in METHODS for holds, text in kinds[method]]


def flag_reasons(found: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """One row per flagged id: how often each kind of reason holds, and the texts of outliers.

    Reasons of one id that differ in the account only are counted together, under the least of
    their texts. The other texts are the same for all ids, so the groups hold counters only, which
    are combined before the shuffle without a sort; texts are gathered for outliers alone.
    """
    counted = found.groupBy(F.col(ID).alias("flagged_id")).agg(*(
        F.count_if(holds).alias(f"count{i}") for i, (_, holds, _) in enumerate(_kinds(cfg))))
    direction = F.col("outlier_direction")
    reason = outliers.outlier_reason("modified_zscore", F.col("account"), direction)
    texts = kept(
        found.filter(reason.isNotNull()).groupBy(F.col(ID).alias("outlier_id")).agg(*(
            F.min(F.when(direction == way, reason)).alias(f"text_{way}") for way in DIRECTIONS)),
        "outlier-reasons")
    any_kind = reduce(or_, (F.col(name) > 0 for name in counted.columns[1:]))
    return counted.filter(any_kind).join(
        texts, F.col("flagged_id").eqNullSafe(F.col("outlier_id")), "left").drop("outlier_id")


def consolidate(
    ledger: DataFrame, reasons: DataFrame, cfg: ScreenConfig = ScreenConfig()
) -> DataFrame:
    """Ledger rows flagged by any method, with a flag per method and all reasons."""
    counts: dict[str, list[Column]] = {method: [] for method in METHODS}
    parts: dict[str, list[Column]] = {method: [] for method in METHODS}
    for i, (method, _, text) in enumerate(_kinds(cfg)):
        if text is None:
            text = F.col(f"text_{DIRECTIONS[len(parts[method])]}")
        counts[method].append(F.col(f"count{i}"))
        parts[method].append(times(text, F.col(f"count{i}")))
    high, low = parts["outlier"]
    parts["outlier"] = [F.when(F.col("text_high") <= F.col("text_low"), F.array(high, low))
                        .otherwise(F.array(low, high))]
    flags = {method: reduce(add, own) > 0 for method, own in counts.items()}
    return ledger.join(reasons, F.col(ID).eqNullSafe(F.col("flagged_id"))).select(
        *base_columns(ledger),
        *(flag.alias(f"flagged_{method}") for method, flag in flags.items()),
        reduce(add, (flag.cast("int") for flag in flags.values())).alias("flag_count"),
        F.concat_ws(" | ", *(part for method in METHODS for part in parts[method]))
        .alias("flag_reasons"),
    )


def flag_count_breakdown(consolidated: DataFrame) -> DataFrame:
    return (
        consolidated.groupBy("flag_count").agg(F.count("*").alias("transactions"))
        .orderBy(F.col("flag_count").desc())
    )


def multi_flag_leads(consolidated: DataFrame, at_least: int = 2) -> DataFrame:
    return consolidated.filter(F.col("flag_count") >= at_least)
