"""Writing findings."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv


def _urgency():
    chain = F.lit(len(fv.RECONCILIATION_ORDER))
    for rank, category in enumerate(fv.RECONCILIATION_ORDER):
        chain = F.when(F.col("category") == category, rank).otherwise(chain)
    return chain


# The order in which each kind of finding is presented. Screens return their rows
# unsorted, because a global sort costs a shuffle that later steps do not need.
REPORT_ORDER = {
    "duplicate_ids": lambda: [F.col("transaction_id")],
    "duplicates": lambda: [F.col("duplicate_group_id"), F.col("date")],
    "round_numbers": lambda: [F.col("amount").desc()],
    "outliers_modified_zscore": lambda: [F.abs("modified_z_score").desc()],
    "outliers_iqr": lambda: [F.col("amount").desc()],
    "outliers_zscore": lambda: [F.abs("z_score").desc()],
    "user_concentration": lambda: [F.col("concentration_ratio").desc()],
    "timing": lambda: [F.col("date")],
    "related_party": lambda: [F.col("related_party_category"), F.col("amount").desc()],
    "related_party_fuzzy": lambda: [F.col("similarity_score").desc()],
    "reconciliation_bars": lambda: [_urgency()],
    "risk_scored": lambda: [F.col("risk_score").desc()],
    "consolidated": lambda: [F.col("flag_count").desc(), F.col("amount").desc()],
    "reconciled": lambda: [_urgency(), F.abs("variance").desc_nulls_last()],
}
TIE_BREAKERS = ["transaction_id", "loan_id", "user"]


def in_report_order(findings: DataFrame, kind: str) -> DataFrame:
    ties = [F.col(name) for name in TIE_BREAKERS if name in findings.columns]
    return findings.orderBy(*REPORT_ORDER[kind](), *ties)


def write_findings(findings: DataFrame, path: str, kind: str | None = None, fmt: str = "csv") -> None:
    """Write findings as CSV with header or as Parquet, sorted if ``kind`` names an order."""
    if fmt not in ("csv", "parquet"):
        raise ValueError(f"Unsupported format: {fmt}. Use csv or parquet.")
    ordered = in_report_order(findings, kind) if kind else findings
    writer = ordered.write.mode("overwrite")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
