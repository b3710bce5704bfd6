"""One weighted, materiality-adjusted risk score per transaction."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgersieve import fixed_values as fv
from ledgersieve.config import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators import outliers, parties, rounds, timing
from ledgersieve.sources.kept import kept

ID = "transaction_id"


# --- Materiality --------------------------------------------------------------

def materiality_factor(cfg: ScreenConfig, amount: str = "amount") -> Column:
    """Amount against the account's ``median``, clipped; 1 where there is no median."""
    ratio = F.try_divide(F.col(amount), F.col("median"))
    clipped = F.greatest(
        F.least(ratio, F.lit(cfg.materiality_ceiling)), F.lit(cfg.materiality_floor))
    # greatest() and least() skip nulls, so the missing ratio is handled first
    return F.when(ratio.isNull(), F.lit(1.0)).otherwise(clipped)


def with_materiality(
    ledger: DataFrame, medians: DataFrame, cfg: ScreenConfig = ScreenConfig()
) -> DataFrame:
    return ledger.join(medians.select("account", "median"), "account", "left").select(
        *ledger.columns, materiality_factor(cfg).alias("materiality_factor"))


# --- All row-level screens in one pass ------------------------------------------

def annotate(
    ledger: DataFrame,
    digits: DataFrame,
    spread: DataFrame,
    concentrated: DataFrame,
    roster: DataFrame,
    cfg: ScreenConfig,
) -> DataFrame:
    """The ledger with the verdict of every screen that looks at one row at a time.

    ``digits`` has nine rows at most; the other tables are read from the shared folder,
    so the planner broadcasts each only if its measured size allows it.
    """
    rows = ledger.withColumn("leading_digit", s.leading_digit(F.col("amount")))
    hits = digits.select(F.col("digit").alias("leading_digit"), F.lit(True).alias("digit_hit"))
    rows = rows.join(F.broadcast(hits), "leading_digit", "left")

    rows = rows.withColumn("roundness_tier", rounds.reported_tier(cfg))

    rows = rows.join(spread, "account", "left")
    amount = F.col("amount")
    is_outlier = F.coalesce(outliers.is_modified_z_outlier(amount, cfg), F.lit(False))
    rows = rows.withColumns({
        "outlier_direction": F.when(
            is_outlier, F.when(amount > F.col("median"), "high").otherwise("low")),
        "materiality_factor": materiality_factor(cfg),
    })

    rows = timing.with_timing(rows, cfg)
    if "user" in ledger.columns:
        suspects = concentrated.select("user", F.lit(True).alias("user_hit"))
        rows = rows.join(suspects, "user", "left")
    else:
        rows = rows.withColumn("user_hit", F.lit(None).cast("boolean"))
    odd_time = F.col("is_weekend") | F.col("is_after_hours")

    rows = parties.with_related_party(rows, roster)
    digit_hit, user_hit = F.col("digit_hit").isNotNull(), F.col("user_hit").isNotNull()
    # Stated on the join marks, so that the filter on it does not classify rows once more
    any_hit = (
        digit_hit | (odd_time & user_hit) | F.col("roundness_tier").isNotNull()
        | F.col("outlier_direction").isNotNull() | F.col("is_staff")
    )
    return rows.select(
        *ledger.columns,
        "materiality_factor",
        any_hit.alias("any_hit"),
        digit_hit.alias("benford_hit"),
        "roundness_tier",
        "outlier_direction",
        "is_weekend",
        "is_after_hours",
        odd_time.alias("timing_hit"),
        (odd_time & user_hit).alias("journal_hit"),
        "related_party_category",
    )


# --- Findings: the flagged rows ---------------------------------------------------

VERDICTS = ["benford_hit", "roundness_tier", "outlier_direction", "is_weekend",
            "is_after_hours", "journal_hit", "related_party_category"]


def marked_findings(annotated: DataFrame) -> DataFrame:
    """The flagged rows, reduced to id, account and verdicts, each once.

    ``annotated`` has ``duplicate_hit`` too. What is counted over these rows is what is counted
    over ``findings``, which are up to twice as many.
    """
    return annotated.filter(F.col("any_hit") | F.col("duplicate_hit")).select(
        ID, "account", *VERDICTS, "duplicate_hit")


def findings(annotated: DataFrame, duplicate_rows: DataFrame) -> DataFrame:
    """The flagged rows, reduced to id, account and verdicts.

    A row can occur twice: for the screens that look at the row, and as a duplicate.
    """
    types = dict(annotated.dtypes)
    by_row = annotated.filter("any_hit").select(
        ID, "account", *VERDICTS, F.lit(False).alias("duplicate_hit"))
    by_key = duplicate_rows.select(
        ID, "account",
        *((F.lit(False) if types[v] == "boolean" else F.lit(None).cast("string")).alias(v)
          for v in VERDICTS),
        F.lit(True).alias("duplicate_hit"),
    )
    return by_row.unionByName(by_key)


# --- Points ---------------------------------------------------------------------

@dataclass(frozen=True)
class Evidence:
    """One kind of entry in the score breakdown, in breakdown order."""

    label: str
    points: int
    holds: Column  # on a row of the findings

    @property
    def entry(self) -> str:
        return f"{self.label} (+{self.points})"


def evidence_kinds(cfg: ScreenConfig) -> list[Evidence]:
    holds = {
        "duplicate": F.col("duplicate_hit"),
        "outlier": F.col("outlier_direction").isNotNull(),
        "journal_entry": F.col("journal_hit"),
        "benford": F.col("benford_hit"),
    }
    kinds = [Evidence(fv.RISK_LABELS[m], fv.METHOD_POINTS[m], hit) for m, hit in holds.items()]
    for tier in cfg.round_tiers:
        kinds.append(Evidence(fv.RISK_LABELS["round_number"] % tier.label, tier.points,
                              F.col("roundness_tier").eqNullSafe(tier.label)))
    for category, points in fv.RELATED_PARTY_POINTS.items():
        kinds.append(Evidence(fv.RISK_LABELS["related_party"] % category, points,
                              F.col("related_party_category").eqNullSafe(category)))
    return kinds


def risk_contributions(found: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """One row per transaction and piece of evidence."""
    entries = F.array(*(
        F.when(kind.holds, F.struct(
            F.lit(kind.label).alias("label"), F.lit(kind.points).alias("points")))
        for kind in evidence_kinds(cfg)
    ))
    return found.select(ID, F.inline(F.filter(entries, lambda entry: entry.isNotNull())))


def times(entry: Column, count: Column) -> Column:
    """The entry, followed by how often it counts where that is more than once."""
    return F.when(count > 1, F.concat(entry, F.lit(" x"), count.cast("string"))).when(
        count == 1, entry)


def id_scores(found: DataFrame, cfg: ScreenConfig = ScreenConfig()) -> DataFrame:
    """Points and breakdown per transaction id; repeated ids add up.

    The rows that meet in a group are reduced to one counter per kind of evidence, so
    the state of a group has a fixed size and is combined before the shuffle.
    """
    kinds = {f"count{i}": kind for i, kind in enumerate(evidence_kinds(cfg))}
    counted = found.filter(F.col(ID).isNotNull()).groupBy(ID).agg(
        *(F.count_if(kind.holds).alias(name) for name, kind in kinds.items()))
    base = reduce(add, (F.col(name) * kind.points for name, kind in kinds.items()))
    parts = [times(F.lit(kind.entry), F.col(name)) for name, kind in kinds.items()]
    return counted.select(
        ID, base.alias("base_score"), F.concat_ws("; ", *parts).alias("score_breakdown"))


def base_columns(ledger: DataFrame) -> list[str]:
    fixed = [ID, "date", "amount", "account", "description"]
    return fixed + [name for name in ("user", "counterparty") if name in ledger.columns]


def score(
    with_factor: DataFrame, scores: DataFrame
) -> DataFrame:
    """Ledger rows whose id has points, rated against the highest raw score of all.

    The rows are written once, because the highest raw score has to be known before the
    first row can be rated.
    """
    raw = kept(
        with_factor.join(scores, ID).select(
            *base_columns(with_factor), "base_score", "score_breakdown", "materiality_factor",
            (F.col("base_score") * F.col("materiality_factor")).alias("raw_score")),
        "raw-scores",
    )
    highest = raw.agg(F.max("raw_score")).scalar()
    rated = F.when(highest > 0, s.rint_to(F.col("raw_score") / highest * 100, 1)).otherwise(0.0)
    return raw.withColumn("risk_score", rated).withColumn(
        "risk_rating", s.risk_rating(F.col("risk_score")))
