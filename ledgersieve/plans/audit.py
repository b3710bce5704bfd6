"""The audit as a whole: every screen, the score and the reconciliation."""

from __future__ import annotations

from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from functools import cached_property

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame

from ledgersieve.config import ScreenConfig
from ledgersieve.operators import benford, duplicates, outliers, parties, reconcile, rounds, timing
from ledgersieve.plans import consolidation, reports, scoring
from ledgersieve.sources import sinks
from ledgersieve.sources.kept import kept, scope


@dataclass(frozen=True)
class Audit:
    """All results of one engagement, each built when it is first asked for.

    The tables several results depend on (account statistics, users, roster, findings)
    and the rated transactions are written to the shared folder once and read from there.
    """

    ledger: DataFrame
    gl: DataFrame | None = None
    schedule: DataFrame | None = None
    cfg: ScreenConfig = ScreenConfig()

    # Shared tables
    @cached_property
    def overrepresented_digits(self) -> DataFrame:
        return kept(benford.overrepresented_digits(self.ledger, self.cfg), "digits")

    @cached_property
    def medians(self) -> DataFrame:
        return outliers.account_medians(self.ledger)

    @cached_property
    def spread(self) -> DataFrame:
        return outliers.account_spread(self.ledger, self.medians)

    @cached_property
    def user_counts(self) -> DataFrame:
        return timing.user_counts(self.ledger, self.cfg)

    @cached_property
    def user_concentration(self) -> DataFrame:
        return timing.user_concentration(self.ledger, self.cfg, per_user=self.user_counts)

    @cached_property
    def concentrated_users(self) -> DataFrame:
        return timing.concentrated_users(self.user_concentration)

    @cached_property
    def close_slots(self) -> DataFrame | None:
        return duplicates.close_slots(self.ledger, self.cfg)

    @cached_property
    def roster(self) -> DataFrame:
        return kept(parties.roster_of(self.user_counts), "roster")

    @cached_property
    def duplicate_rows(self) -> DataFrame:
        return duplicates.duplicate_payment_rows(self.ledger, self.cfg, slots=self.close_slots)

    def write_shared_tables(self) -> None:
        """Write the tables the row-level screens need, as jobs that run side by side."""
        chains = [["spread"], ["close_slots"], ["concentrated_users", "roster"],
                  ["overrepresented_digits"]]

        @inheritable_thread_target(self.ledger.sparkSession)
        def write(chain: list[str]) -> None:
            for name in chain:
                getattr(self, name)

        with ThreadPoolExecutor(len(chains)) as pool:
            list(pool.map(write, chains))

    @cached_property
    def annotated(self) -> DataFrame:
        return self._annotate(self.ledger)

    def _annotate(self, ledger: DataFrame) -> DataFrame:
        self.write_shared_tables()
        return scoring.annotate(
            ledger, self.overrepresented_digits, self.spread, self.concentrated_users,
            self.roster, self.cfg)

    @cached_property
    def findings(self) -> DataFrame:
        """The ledger is read once for the screens of rows and for duplicates."""
        marked = duplicates.with_duplicate_mark(self.ledger, self.cfg, slots=self.close_slots)
        return kept(scoring.marked_findings(self._annotate(marked)), "findings")

    # Screens
    @cached_property
    def benford_digits(self) -> DataFrame:
        return benford.benford_digits(self.ledger)

    @cached_property
    def benford_stats(self) -> DataFrame:
        return benford.benford_stats(self.ledger, self.cfg)

    @cached_property
    def benford_flagged(self) -> DataFrame:
        return benford.flag_benford(self.ledger, self.cfg)

    @cached_property
    def duplicate_flagged(self) -> DataFrame:
        return duplicates.duplicate_payments(self.ledger, self.cfg, slots=self.close_slots)

    @cached_property
    def round_flagged(self) -> DataFrame:
        return rounds.flag_round_numbers(self.ledger, self.cfg)

    @cached_property
    def outlier_flagged(self) -> DataFrame:
        return outliers.detect_outliers_modified_zscore(self.ledger, self.cfg, spread=self.spread)

    @cached_property
    def timing_flagged(self) -> DataFrame:
        return timing.flag_timing_anomalies(self.ledger, self.cfg)

    @cached_property
    def journal_high_risk(self) -> DataFrame:
        return timing.high_risk_timing(self.timing_flagged, self.concentrated_users)

    @cached_property
    def related_party_flagged(self) -> DataFrame:
        return parties.flag_related_party(self.ledger, self.roster)

    @cached_property
    def related_party_fuzzy(self) -> DataFrame:
        """Kept, since findings for review and the summary's count both read it."""
        return kept(parties.flag_fuzzy_related_party(
            self.ledger, self.related_party_flagged, self.cfg, self.roster), "near-matches")

    @cached_property
    def related_party_summary(self) -> DataFrame:
        return parties.related_party_summary(self.related_party_flagged, self.related_party_fuzzy)

    @property
    def flagged_sets(self) -> dict[str, DataFrame]:
        return {
            "flagged_benford": self.benford_flagged,
            "flagged_duplicate": self.duplicate_flagged,
            "flagged_round_number": self.round_flagged,
            "flagged_outlier": self.outlier_flagged,
            "flagged_journal_entry": self.journal_high_risk,
            "flagged_related_party": self.related_party_flagged,
        }

    # Score and consolidation
    @cached_property
    def contributions(self) -> DataFrame:
        return scoring.risk_contributions(self.findings, self.cfg)

    @cached_property
    def risk_scored(self) -> DataFrame:
        scores = scoring.id_scores(self.findings, self.cfg)
        return scoring.score(
            scoring.with_materiality(self.ledger, self.spread, self.cfg), scores)

    @cached_property
    def consolidated(self) -> DataFrame:
        reasons = consolidation.flag_reasons(self.findings, self.cfg)
        return consolidation.consolidate(self.ledger, reasons, self.cfg)

    # Reconciliation, if both tables are there
    @cached_property
    def gl_balances(self) -> DataFrame | None:
        if self.gl is None or self.schedule is None:
            return None
        return reconcile.gl_loan_balances(self.gl)

    @cached_property
    def reconciled(self) -> DataFrame | None:
        if self.gl_balances is None:
            return None
        return reconcile.reconcile_loans(self.gl_balances, self.schedule, self.cfg)

    @cached_property
    def kpis(self) -> DataFrame:
        return reports.engagement_kpis(self.ledger, self.risk_scored, self.reconciled)

    def publish(self, folder: str, fmt: str = "csv") -> dict[str, str]:
        """Write the consolidated, the scored and, if there are any, the loan findings."""
        outputs = {
            "consolidated_findings": ("consolidated", self.consolidated),
            "risk_scored_findings": ("risk_scored", self.risk_scored),
        }
        if self.reconciled is not None:
            outputs["reconciliation_findings"] = ("reconciled", self.reconciled)
        paths = {}
        for name, (kind, findings) in outputs.items():
            paths[name] = f"{folder.rstrip('/')}/{name}.{fmt}"
            sinks.write_findings(findings, paths[name], kind, fmt)
        return paths


def run_audit(
    ledger: DataFrame,
    gl: DataFrame | None = None,
    schedule: DataFrame | None = None,
    cfg: ScreenConfig = ScreenConfig(),
) -> Audit:
    """All screens on ``ledger``; loans are reconciled if both tables are given.

    The ledger is written to the shared folder first, so that its source is read and its
    texts are parsed once, and each screen reads the columns it needs.
    """
    return Audit(kept(ledger, "ledger"), gl, schedule, cfg)


def publish_audit(
    folder: str,
    ledger: DataFrame,
    gl: DataFrame | None = None,
    schedule: DataFrame | None = None,
    cfg: ScreenConfig = ScreenConfig(),
    fmt: str = "csv",
) -> dict[str, str]:
    """Run an audit, write its findings, and delete every table that was kept on the way."""
    with scope(ledger.sparkSession):
        return run_audit(ledger, gl, schedule, cfg).publish(folder, fmt)
