"""Scoring, consolidation, reports and the audit as a whole."""
