"""Staff who appear as counterparties."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators.near_names import closest_staff
from ledgersieve.sources.kept import kept


def staff_roster(ledger: DataFrame, user: str = "user") -> DataFrame:
    """Distinct normalised user names with one original spelling each (the greatest)."""
    if user not in ledger.columns:
        ledger = ledger.withColumn(user, F.lit(None).cast("string"))
    return roster_of(kept(ledger.select(user).distinct(), "users"), user)


def roster_of(users: DataFrame, user: str = "user") -> DataFrame:
    """The roster of a table with one row per user: each name is normalised once."""
    name = F.col(user).cast("string")
    return (
        users.filter(F.col(user).isNotNull())
        .groupBy(s.normalised_name(name).alias("normalized_name"))
        .agg(F.max(name).alias("staff_name"))
    )


def related_reason(category: Column) -> Column:
    return F.when(
        category == fv.SELF_DEALING, fv.RELATED_PARTY_REASONS[fv.SELF_DEALING]
    ).when(category == fv.STAFF_AS_BORROWER, fv.RELATED_PARTY_REASONS[fv.STAFF_AS_BORROWER])


def _has_both(ledger: DataFrame, user: str, counterparty: str) -> bool:
    return user in ledger.columns and counterparty in ledger.columns


def with_related_party(
    ledger: DataFrame, roster: DataFrame, user: str = "user", counterparty: str = "counterparty"
) -> DataFrame:
    """Add ``is_staff`` for the counterparty and, where it is, ``related_party_category``."""
    if not _has_both(ledger, user, counterparty):
        return ledger.withColumns({
            "is_staff": F.lit(False), "related_party_category": F.lit(None).cast("string")})
    party = s.normalised_name(F.col(counterparty))
    staff = roster.filter(F.col("normalized_name") != "").select("normalized_name")
    category = F.when(
        F.col("normalized_name").isNull(), F.lit(None)
    ).when(
        F.col("normalized_name") == s.normalised_name(F.col(user)), fv.SELF_DEALING
    ).otherwise(fv.STAFF_AS_BORROWER)
    return ledger.join(staff, party == F.col("normalized_name"), "left").select(
        *ledger.columns,
        F.col("normalized_name").isNotNull().alias("is_staff"),
        category.alias("related_party_category"),
    )


def flag_related_party(
    ledger: DataFrame,
    roster: DataFrame | None = None,
    user: str = "user",
    counterparty: str = "counterparty",
) -> DataFrame:
    if roster is None:
        roster = kept(staff_roster(ledger, user), "roster")
    return (
        with_related_party(ledger, roster, user, counterparty)
        .filter("is_staff")
        .drop("is_staff")
        .withColumn("flag_reason", related_reason(F.col("related_party_category")))
    )


def related_party_summary(flagged: DataFrame, near: DataFrame | None = None) -> DataFrame:
    """Transactions per category and, if the near matches are given, their number."""
    counts = flagged.groupBy("related_party_category").agg(F.count("*").alias("transactions"))
    if near is None:
        return counts
    return counts.unionByName(near.agg(F.count("*").alias("transactions")).select(
        F.lit(fv.NEAR_MATCH).alias("related_party_category"), "transactions"))


# --- Near matches -----------------------------------------------------------

def flag_fuzzy_related_party(
    ledger: DataFrame,
    exact_flagged: DataFrame | None = None,
    cfg: ScreenConfig = ScreenConfig(),
    roster: DataFrame | None = None,
    user: str = "user",
    counterparty: str = "counterparty",
) -> DataFrame:
    """Counterparties that resemble a staff name without being one; for review."""
    if not _has_both(ledger, user, counterparty):
        return ledger.filter(F.lit(False)).withColumns({
            "closest_staff_match": F.lit(None).cast("string"),
            "similarity_score": F.lit(None).cast("double"),
            "flag_reason": F.lit(None).cast("string"),
        })
    if roster is None:
        roster = kept(staff_roster(ledger, user), "roster")
    if exact_flagged is None:
        exact_flagged = flag_related_party(ledger, roster, user, counterparty)
    named = ledger.withColumn("name", s.normalised_name(F.col(counterparty)))
    staff = roster.select(F.col("normalized_name").alias("name"))
    names = kept(
        named.select("name").filter(F.col("name") != "").distinct()
        .join(staff, "name", "left_anti"), "counterparty-names")
    matches = kept(closest_staff(names, roster, cfg.fuzzy_cutoff).join(
        roster, "normalized_name"), "closest-staff")
    # Ids with an exact match are looked up for the few rows that have a near match only
    known = exact_flagged.select(F.col("transaction_id").alias("known_id")).distinct()
    candidates = named.join(matches, "name").join(
        known, F.col("transaction_id").eqNullSafe(F.col("known_id")), "left_anti")
    share = F.col("similarity")
    return candidates.select(
        *ledger.columns,
        F.col("staff_name").alias("closest_staff_match"),
        s.rint_to(share, 3).alias("similarity_score"),
        F.concat(
            F.lit(fv.FUZZY_REASON_HEAD), F.col("staff_name"), F.lit(fv.FUZZY_REASON_MIDDLE),
            s.percent_text(share), F.lit(fv.FUZZY_REASON_TAIL),
        ).alias("flag_reason"),
    )
