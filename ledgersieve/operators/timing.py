"""When entries were posted, and by whom."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.sources.kept import kept


def timing_reason(
    cfg: ScreenConfig, weekend: Column | None = None, late: Column | None = None
) -> Column:
    """Text on a row with the marks ``is_weekend`` and ``is_after_hours``, or of marks given."""
    hours = fv.AFTER_HOURS_REASON % (cfg.business_start_hour, cfg.business_end_hour)
    parts = F.concat_ws(
        " and ",
        F.when(F.col("is_weekend") if weekend is None else weekend, fv.WEEKEND_REASON),
        F.when(F.col("is_after_hours") if late is None else late, hours),
    )
    return F.concat(F.lit(fv.TIMING_REASON_HEAD), parts)


def with_timing(ledger: DataFrame, cfg: ScreenConfig, date: str = "date") -> DataFrame:
    return ledger.withColumns({
        "is_weekend": s.is_weekend(F.col(date)),
        "is_after_hours": s.is_after_hours(F.col(date), cfg),
    })


def flag_timing_anomalies(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), date: str = "date"
) -> DataFrame:
    return (
        with_timing(ledger, cfg, date)
        .filter(F.col("is_weekend") | F.col("is_after_hours"))
        .withColumn("flag_reason", timing_reason(cfg))
    )


def user_counts(
    ledger: DataFrame, cfg: ScreenConfig = ScreenConfig(), user: str = "user", date: str = "date"
) -> DataFrame:
    """Entries and odd-time entries per user; read twice by ``user_concentration``."""
    if user not in ledger.columns:
        ledger = ledger.withColumn(user, F.lit(None).cast("string"))
    counts = (
        with_timing(ledger.select(user, date), cfg, date)
        .groupBy(user)
        .agg(
            F.count("*").alias("total_transactions"),
            F.count_if(F.col("is_weekend") | F.col("is_after_hours")).alias("flagged_transactions"),
        )
    )
    return kept(counts, "user-counts")


def user_concentration(
    ledger: DataFrame,
    cfg: ScreenConfig = ScreenConfig(),
    user: str = "user",
    date: str = "date",
    per_user: DataFrame | None = None,
) -> DataFrame:
    """Each user's share of odd-time entries against the share of all entries."""
    if per_user is None:
        per_user = user_counts(ledger, cfg, user, date)
    # Rows without a user count in both totals but are not listed.
    whole = per_user.agg(
        F.struct(F.sum("total_transactions").alias("all_rows"),
                 F.sum("flagged_transactions").alias("flagged_rows")).alias("whole"))
    ratio = s.rint_to(F.coalesce(F.col("pct_of_flagged") / F.col("pct_of_total"), F.lit(0.0)), 2)
    return (
        per_user.withColumn("whole", whole.scalar())
        .filter(F.col(user).isNotNull())
        .withColumn("pct_of_total", F.col("total_transactions") / F.col("whole.all_rows"))
        .withColumn("pct_of_flagged", F.coalesce(
            F.try_divide(F.col("flagged_transactions"), F.col("whole.flagged_rows")), F.lit(0.0)))
        .withColumn("concentration_ratio", ratio)
        .select(
            user, "total_transactions", "pct_of_total", "flagged_transactions", "pct_of_flagged",
            "concentration_ratio",
            ((F.col("concentration_ratio") >= cfg.concentration_ratio)
             & (F.col("flagged_transactions") >= cfg.concentration_min_flagged)).alias("flagged"),
        )
    )


def concentrated_users(users: DataFrame, user: str = "user") -> DataFrame:
    """The flagged users as a table of known size."""
    return kept(users.filter("flagged").select(user), "concentrated-users")


def high_risk_timing(
    timing_flagged: DataFrame, concentrated: DataFrame, user: str = "user"
) -> DataFrame:
    """Odd-time entries of users with a disproportionate share of them."""
    if user not in timing_flagged.columns:
        return timing_flagged.filter(F.lit(False))
    return timing_flagged.join(concentrated.select(user), user, "left_semi").select(
        *timing_flagged.columns)


def timing_summary(ledger: DataFrame, users: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    counts = with_timing(ledger, cfg).agg(
        F.count_if(F.col("is_weekend") | F.col("is_after_hours")).alias("total_timing_anomalies"),
        F.count_if("is_weekend").alias("weekend_postings"),
        F.count_if("is_after_hours").alias("after_hours_postings"),
    )
    return counts.withColumn("flagged_users", users.agg(F.count_if("flagged")).scalar())


def user_share_chart(users: DataFrame, user: str = "user") -> DataFrame:
    """Users with odd-time entries: percent of volume against percent of anomalies."""
    return users.filter(F.col("flagged_transactions") > 0).select(
        user,
        s.rint_to(F.col("pct_of_total") * 100, 2).alias("pct_of_volume"),
        s.rint_to(F.col("pct_of_flagged") * 100, 2).alias("pct_of_anomalies"),
        "concentration_ratio",
    )
