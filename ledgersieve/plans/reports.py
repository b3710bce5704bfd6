"""The figures behind charts and summary tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.functions import scalars as s

URGENT = ["Critical", "High"]


def _rated(rating: str):
    return F.count_if(F.col("risk_rating") == rating).alias(rating.lower())


def _exposure():
    urgent = F.when(F.col("risk_rating").isin(URGENT), F.col("amount"))
    return s.rint_to(s.total(urgent), 2)


def risk_summary(scored: DataFrame) -> DataFrame:
    return scored.agg(
        F.count("*").alias("total_flagged"),
        *(_rated(rating) for rating in fv.RATINGS),
        _exposure().alias("total_exposure_critical_high"),
    )


def rating_breakdown(scored: DataFrame) -> DataFrame:
    """All four ratings, also those nobody has."""
    rows = F.array(*(
        F.struct(F.lit(rating).alias("risk_rating"), F.col(rating.lower()).alias("transactions"))
        for rating in fv.RATINGS
    ))
    return scored.agg(*(_rated(rating) for rating in fv.RATINGS)).select(F.inline(rows))


def flags_by_method(found: DataFrame) -> DataFrame:
    """Rows flagged by each method, most first."""
    hits = {
        "benford": F.col("benford_hit"),
        "duplicate": F.col("duplicate_hit"),
        "round_number": F.col("roundness_tier").isNotNull(),
        "outlier": F.col("outlier_direction").isNotNull(),
        "journal_entry": F.col("journal_hit"),
        "related_party": F.col("related_party_category").isNotNull(),
    }
    counts = found.agg(*(F.count_if(hit).alias(m) for m, hit in hits.items()))
    rows = F.array(*(
        F.struct(F.lit(title).alias("method"), F.col(m).alias("flagged_rows"))
        for m, title in fv.METHOD_TITLES.items()
    ))
    return counts.select(F.inline(rows)).orderBy(F.col("flagged_rows").desc(), "method")


def monthly_trend(scored: DataFrame) -> DataFrame:
    """Scored transactions per month and rating."""
    return (
        scored.groupBy(s.month_bucket(F.col("date")).alias("month"))
        .agg(*(F.count_if(F.col("risk_rating") == r).alias(r.lower()) for r in fv.RATINGS))
        .orderBy("month")
    )


def top_risk(scored: DataFrame, n: int = 15) -> DataFrame:
    """The highest scores; ties in the order of ids."""
    return (
        scored.select("transaction_id", "date", "amount", "account", "risk_score",
                      "risk_rating", "score_breakdown")
        .orderBy(F.col("risk_score").desc(), "transaction_id", "date", "amount", "account")
        .limit(n)
    )


def engagement_kpis(
    ledger: DataFrame, scored: DataFrame, reconciled: DataFrame | None = None
) -> DataFrame:
    """One row of headline figures; loan figures are null without a reconciliation."""
    figures = scored.agg(
        F.count("*").alias("transactions_flagged"),
        _rated("Critical"),
        _rated("High"),
        _exposure().alias("exposure_critical_high"),
    ).withColumn("transactions_reviewed", ledger.agg(F.count("*")).scalar())
    loan_columns = {
        "loans_reviewed": F.lit(None).cast("long"),
        "reconciliation_exceptions": F.lit(None).cast("long"),
        "possible_ghost_loans": F.lit(None).cast("long"),
    }
    if reconciled is not None:
        loans = reconciled.agg(F.struct(
            F.count("*").alias("loans_reviewed"),
            F.count_if(~F.col("category").isin(fv.NOT_A_FINDING)).alias("reconciliation_exceptions"),
            F.count_if(F.col("category") == fv.GHOST_LOAN).alias("possible_ghost_loans"),
        ).alias("loans"))
        figures = figures.withColumn("loans", loans.scalar())
        loan_columns = {name: F.col(f"loans.{name}") for name in loan_columns}
    return figures.withColumns(loan_columns).drop("loans")
