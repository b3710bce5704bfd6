"""Ledger screening on Spark: anomaly screens, risk scoring and reconciliation."""

from ledgersieve.config import ScreenConfig
from ledgersieve.plans.audit import Audit, run_audit

__all__ = ["Audit", "ScreenConfig", "run_audit"]
