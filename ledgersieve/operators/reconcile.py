"""Loan balances of the ledger against the supporting schedule."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s

GL, SCHEDULE = "gl_outstanding_balance", "schedule_outstanding_balance"


def gl_loan_balances(
    gl: DataFrame,
    loan_id: str = "loan_id",
    amount: str = "amount",
    account: str = "account",
    counterparty: str = "counterparty",
) -> DataFrame:
    """Disbursed less repaid per loan, in one grouping.

    The borrower is the counterparty of the loan's earliest row that names one. A loan
    with neither a disbursement nor a repayment is not listed.
    """
    disbursed = F.col(account) == fv.DISBURSEMENT_ACCOUNT
    repaid = F.col(account) == fv.REPAYMENT_ACCOUNT
    sums = [
        s.total(F.when(disbursed, F.col(amount))).alias("total_disbursed"),
        s.total(F.when(repaid, F.col(amount))).alias("total_repaid"),
        F.count_if(disbursed | repaid).alias("loan_rows"),
    ]
    columns = ["loan_id", "total_disbursed", "total_repaid", GL]
    rows = gl.filter(F.col(loan_id).isNotNull()).withColumn("loan_id", F.col(loan_id))
    balances = (
        rows.groupBy("loan_id").agg(*sums).filter(F.col("loan_rows") > 0)
        .withColumn(GL, F.col("total_disbursed") - F.col("total_repaid")).select(*columns)
    )
    if counterparty not in gl.columns:
        return balances
    # Only rows that name someone are sorted for the borrower; the sums are hashed
    earliest = F.min(F.struct("date", "transaction_id", F.col(counterparty).alias("name")))
    borrowers = rows.filter(F.col(counterparty).isNotNull()).groupBy("loan_id").agg(
        earliest.getField("name").alias("borrower"))
    return balances.join(borrowers, "loan_id", "left")


def reconciliation_category(cfg: ScreenConfig) -> Column:
    gl, schedule = F.col(GL), F.col(SCHEDULE)
    # greatest() skips nulls; with both balances missing the variance must stay null
    base = F.when(gl.isNotNull() & schedule.isNotNull(),
                  F.greatest(F.abs(gl), F.abs(schedule), F.lit(1.0)))
    share = F.abs(gl - schedule) / base
    only_gl, only_schedule = (
        gl.isNotNull() & schedule.isNull(), schedule.isNotNull() & gl.isNull())
    return (
        F.when(only_gl & (F.abs(gl) <= cfg.closed_loan_floor), fv.CLOSED_LOAN)
        .when(only_gl, fv.UNSUPPORTED_GL)
        .when(only_schedule, fv.GHOST_LOAN)
        .when(share <= cfg.clean_tolerance, fv.CLEAN_TIE_OUT)
        .when(share <= cfg.timing_tolerance, fv.TIMING_DIFFERENCE)
        .otherwise(fv.MATERIAL_VARIANCE)
    )


def reconcile_loans(
    balances: DataFrame, schedule: DataFrame, cfg: ScreenConfig = ScreenConfig()
) -> DataFrame:
    """Every loan of either side with its variance and category.

    A full outer join of a table unique per loan with one that need not be, written as
    a left join plus the loans only the ledger has: a left join can be split where one
    loan id (or a missing one) fills much of the schedule, a full outer join cannot.
    """
    if "borrower" not in balances.columns:
        balances = balances.withColumn("borrower", F.lit(None).cast("string"))
    gl_side = balances.select("loan_id", GL, F.col("borrower").alias("gl_borrower"))
    listed = schedule.select("loan_id", "borrower", "product", SCHEDULE)
    scheduled = listed.join(gl_side, "loan_id", "left").select(
        "loan_id", GL, "product", SCHEDULE,
        F.coalesce("borrower", "gl_borrower").alias("borrower"))
    ledger_only = gl_side.join(listed.select("loan_id").distinct(), "loan_id", "left_anti").select(
        "loan_id", GL,
        F.lit(None).cast("string").alias("product"),
        F.lit(None).cast("double").alias(SCHEDULE),
        F.col("gl_borrower").alias("borrower"),
    )
    return (
        scheduled.unionByName(ledger_only)
        .withColumn("variance", F.col(GL) - F.col(SCHEDULE))
        .withColumn("category", reconciliation_category(cfg))
    )


def actionable_findings(reconciled: DataFrame) -> DataFrame:
    return reconciled.filter(~F.col("category").isin(fv.NOT_A_FINDING))


def summarize_reconciliation(reconciled: DataFrame) -> DataFrame:
    """Totals in one row, with the number of loans in each category."""
    by_category = reconciled.groupBy("category").agg(
        F.count("*").alias("loans"),
        F.sum(s.money(F.col(GL))).alias("gl"),
        F.sum(s.money(F.col(SCHEDULE))).alias("schedule"),
    )

    def added(name: str) -> Column:
        return F.coalesce(F.sum(name).cast("double"), F.lit(0.0))

    def loans_in(category: str) -> Column:
        return F.coalesce(F.sum(F.when(F.col("category") == category, F.col("loans"))), F.lit(0))

    names = ["ghost_loans", "unsupported_gl", "material_variances",
             "timing_differences", "clean_tie_outs", "closed_loans"]
    return by_category.agg(
        F.coalesce(F.sum("loans"), F.lit(0)).alias("total_loans_reviewed"),
        s.rint_to(added("gl"), 2).alias("total_gl_balance"),
        s.rint_to(added("schedule"), 2).alias("total_schedule_balance"),
        s.rint_to(added("gl") - added("schedule"), 2).alias("net_variance"),
        *(loans_in(category).alias(name)
          for category, name in zip(fv.RECONCILIATION_ORDER, names)),
    )


def reconciliation_bars(reconciled: DataFrame) -> DataFrame:
    """Signed size of each open item: the variance, or the one balance there is."""
    return actionable_findings(reconciled).select(
        "loan_id", "category",
        F.coalesce(F.col("variance"), F.col(GL), -F.col(SCHEDULE)).alias("plot_value"))
