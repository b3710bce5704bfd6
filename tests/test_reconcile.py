import pytest

from ledgersieve import fixed_values as fv
from ledgersieve import run_audit
from ledgersieve.operators import reconcile
from ledgersieve.sources.sinks import in_report_order

from tests.conftest import at

BALANCES = "loan_id string, gl_outstanding_balance double, borrower string"
SCHEDULE = "loan_id string, borrower string, product string, schedule_outstanding_balance double"
GL = ("transaction_id string, date timestamp_ntz, amount double, account string, "
      "counterparty string, loan_id string")


@pytest.mark.parametrize("gl, schedule, category", [
    (1_000_000.0, 1_005_000.0, fv.CLEAN_TIE_OUT), (1_000_000.0, 900_000.0, fv.TIMING_DIFFERENCE),
    (1_000_000.0, 500_000.0, fv.MATERIAL_VARIANCE), (200.0, None, fv.CLOSED_LOAN),
    (-5_000.0, None, fv.CLOSED_LOAN), (500_000.0, None, fv.UNSUPPORTED_GL),
    (None, 750_000.0, fv.GHOST_LOAN), (0.0, 0.0, fv.CLEAN_TIE_OUT), (0.0, 0.5, fv.MATERIAL_VARIANCE),
    (98.0, 100.0, fv.CLEAN_TIE_OUT), (80.0, 100.0, fv.TIMING_DIFFERENCE)])
def test_categories(frame, gl, schedule, category):
    left = frame(BALANCES, *([("L", gl, None)] if gl is not None else []))
    right = frame(SCHEDULE, *([("L", "b", "p", schedule)] if schedule is not None else []))
    row, = reconcile.reconcile_loans(left, right).collect()
    assert row["category"] == category


def test_both_balances_missing(frame):
    row, = reconcile.reconcile_loans(frame(BALANCES), frame(SCHEDULE, ("L", "b", "p", None))).collect()
    assert row["category"] == fv.MATERIAL_VARIANCE


def test_balances(frame):
    gl = frame(GL,
               ("1", at("2025-01-01"), 1_000_000.0, fv.DISBURSEMENT_ACCOUNT, None, "L1"),
               ("2", at("2025-02-01"), 300_000.0, fv.REPAYMENT_ACCOUNT, "Late Name", "L1"),
               ("3", at("2025-01-15"), 10.0, "Loan Fee", "Early Name", "L1"),
               ("4", at("2025-01-15"), 10.0, "Loan Fee", "x", "L2"),
               ("5", at("2025-01-15"), 99.0, fv.REPAYMENT_ACCOUNT, "y", "L3"),
               ("6", at("2025-01-15"), 99.0, fv.REPAYMENT_ACCOUNT, "y", None))
    got = {r["loan_id"]: r for r in reconcile.gl_loan_balances(gl).collect()}
    assert set(got) == {"L1", "L3"}
    assert got["L1"]["gl_outstanding_balance"] == 700_000.0 and got["L1"]["borrower"] == "Early Name"
    assert got["L3"]["gl_outstanding_balance"] == -99.0
    assert "borrower" not in reconcile.gl_loan_balances(gl.drop("counterparty")).columns


def test_borrower_of_the_schedule_wins(frame):
    left = frame(BALANCES, ("A", 1e6, "Ledger Name"), ("B", 1e6, "Ledger Only"))
    right = frame(SCHEDULE, ("A", "Schedule Name", "p", 1e6))
    got = {r["loan_id"]: r["borrower"] for r in reconcile.reconcile_loans(left, right).collect()}
    assert got == {"A": "Schedule Name", "B": "Ledger Only"}
    bare = reconcile.reconcile_loans(left.drop("borrower"), right).collect()
    assert {r["loan_id"]: r["borrower"] for r in bare} == {"A": "Schedule Name", "B": None}


def test_repeated_and_missing_loan_ids_of_the_schedule_stay(frame):
    left = frame(BALANCES, ("A", 100.0, None))
    right = frame(SCHEDULE, ("A", "b", "p", 100.0), ("A", "b", "p", 50.0), (None, "n", "p", 7.0),
                  (None, "n", "p", 8.0))
    rows = reconcile.reconcile_loans(left, right)
    assert sorted((str(r["loan_id"]), r["category"]) for r in rows.collect()) == [
        ("A", fv.CLEAN_TIE_OUT), ("A", fv.MATERIAL_VARIANCE),
        ("None", fv.GHOST_LOAN), ("None", fv.GHOST_LOAN)]


def test_order_findings_and_summary(frame):
    left = frame(BALANCES, ("clean", 100.0, None), ("big", 1000.0, None), ("bigger", 9000.0, None),
                 ("closed", 1.0, None), ("gl", 6000.25, None))
    right = frame(SCHEDULE, ("clean", "b", "p", 100.0), ("big", "b", "p", 100.0),
                  ("bigger", "b", "p", 100.0), ("ghost", "b", "p", 40.5))
    rows = reconcile.reconcile_loans(left, right)
    assert [r["loan_id"] for r in in_report_order(rows, "reconciled").collect()] == [
        "ghost", "gl", "bigger", "big", "clean", "closed"]
    assert reconcile.actionable_findings(rows).count() == 4
    summary = reconcile.summarize_reconciliation(rows).first().asDict()
    assert summary == {
        "total_loans_reviewed": 6, "total_gl_balance": 16101.25, "total_schedule_balance": 340.5,
        "net_variance": 15760.75, "ghost_loans": 1, "unsupported_gl": 1, "material_variances": 2,
        "timing_differences": 0, "clean_tie_outs": 1, "closed_loans": 1}
    bars = {r["loan_id"]: r["plot_value"] for r in reconcile.reconciliation_bars(rows).collect()}
    assert bars == {"ghost": -40.5, "gl": 6000.25, "bigger": 8900.0, "big": 900.0}


def test_audit_with_loans(ledger, frame, tmp_path):
    gl = frame(GL, ("1", at("2025-01-01"), 800.0, fv.DISBURSEMENT_ACCOUNT, "n", "L1"))
    schedule = frame(SCHEDULE, ("L1", "n", "p", 800.0), ("L9", "n", "p", 5.0))
    audit = run_audit(ledger({"amount": 1_000_000.0}), gl, schedule)
    kpis = audit.kpis.first()
    assert (kpis["loans_reviewed"], kpis["reconciliation_exceptions"], kpis["possible_ghost_loans"]) == (2, 1, 1)
    assert "reconciliation_findings" in audit.publish(str(tmp_path), "parquet")
