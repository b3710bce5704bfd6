import pytest

from ledgersieve import ScreenConfig, run_audit
from ledgersieve.operators import duplicates
from ledgersieve.plans import consolidation, reports, scoring
from pyspark.sql import functions as F

from tests.conftest import at, ids

VERDICTS = {"materiality_factor": 1.0, "benford_hit": False, "roundness_tier": None,
            "outlier_direction": None, "is_weekend": False, "is_after_hours": False,
            "timing_hit": False, "journal_hit": False, "related_party_category": None}
TYPES = {"materiality_factor": "double", "roundness_tier": "string", "outlier_direction": "string",
         "related_party_category": "string"}


def annotated(rows, verdicts):
    """The ledger with hand-made verdicts per id."""
    for name, default in VERDICTS.items():
        column = F.lit(default)
        for tid, given in verdicts.items():
            if name in given:
                column = F.when(F.col("transaction_id") == tid, F.lit(given[name])).otherwise(column)
        rows = rows.withColumn(name, column.cast(TYPES.get(name, "boolean")))
    return with_any_hit(rows)


def with_any_hit(rows):
    return rows.withColumn("any_hit", F.expr(
        "benford_hit or journal_hit or roundness_tier is not null or outlier_direction is not null "
        "or related_party_category is not null"))


def scored(rows, verdicts, duplicate_ids=(), cfg=ScreenConfig()):
    marked = annotated(rows, verdicts)
    dups = rows.filter(F.col("transaction_id").isin(list(duplicate_ids)))
    medians = rows.groupBy("account").agg(F.percentile("amount", 0.5).alias("median"))
    with_factor = scoring.with_materiality(rows, medians, cfg)
    result = scoring.score(with_factor, scoring.id_scores(scoring.findings(marked, dups), cfg))
    return {r["transaction_id"]: r for r in result.collect()}


TIERS = [t.label for t in ScreenConfig().round_tiers]


def four(ledger):
    return ledger(*({"transaction_id": f"T{i}", "amount": 100_000.0} for i in range(1, 5)))


def test_weights_order_the_evidence(ledger):
    got = scored(four(ledger), {"T1": {"benford_hit": True}}, ["T2"])
    assert got["T2"]["risk_score"] == 100.0 and got["T1"]["risk_score"] == 25.0
    assert set(got) == {"T1", "T2"}
    got = scored(four(ledger), {"T1": {"roundness_tier": TIERS[0]}, "T2": {"roundness_tier": TIERS[3]}})
    assert got["T1"]["base_score"] == 20 and got["T2"]["base_score"] == 5
    got = scored(four(ledger), {"T1": {"related_party_category": "Self-dealing"},
                                "T2": {"related_party_category": "Staff as borrower"},
                                "T3": {"roundness_tier": "unheard of"}})
    assert got["T1"]["base_score"] == 45 and got["T2"]["base_score"] == 20
    assert got["T3"]["base_score"] == 0 and got["T3"]["risk_rating"] == "Low"


def test_breakdown_lists_evidence_in_order(ledger):
    got = scored(four(ledger), {"T1": {
        "benford_hit": True, "outlier_direction": "high", "journal_hit": True,
        "roundness_tier": TIERS[1], "related_party_category": "Self-dealing"}}, ["T1"])["T1"]
    assert got["base_score"] == 40 + 25 + 30 + 10 + 15 + 45
    assert got["score_breakdown"] == (
        "Duplicate Payment (+40); Statistical Outlier (+25); "
        "Journal Entry Timing (User Concentration) (+30); Benford's Law (+10); "
        "Round Number (Very round (multiple of 500,000)) (+15); "
        "Related Party (Self-dealing) (+45)")


def test_no_pile_up_at_the_top(ledger):
    rows = ledger(*({"transaction_id": f"T{i}", "amount": a} for i, a in
                    enumerate([100_000.0] * 4 + [50_000_000.0])))
    got = scored(rows, {f"T{i}": {"benford_hit": True} for i in range(5)})
    assert got["T4"]["risk_score"] == 100.0 and got["T4"]["materiality_factor"] == 2.0
    assert {got[f"T{i}"]["risk_score"] for i in range(4)} == {50.0}
    assert got["T0"]["risk_rating"] == "High" and got["T4"]["risk_rating"] == "Critical"


def test_repeated_ids_add_up_on_every_row(ledger):
    rows = ledger({"transaction_id": "A", "amount": 100.0}, {"transaction_id": "A", "amount": 300.0},
                  {"transaction_id": "B"}, {"transaction_id": None})
    marked = annotated(rows, {"A": {"benford_hit": True}, "B": {"benford_hit": True}})
    found = scoring.findings(marked, rows.filter("transaction_id = 'A'"))
    result = scoring.score(marked, scoring.id_scores(found))
    got = [tuple(r) for r in result.filter("transaction_id = 'A'").select(
        "base_score", "score_breakdown").collect()]
    assert got == [(100, "Duplicate Payment (+40) x2; Benford's Law (+10) x2")] * 2
    assert result.count() == 3


def test_repeats_are_counted(ledger):
    rows = ledger(*({"transaction_id": "A"} for _ in range(7)))
    marked = annotated(rows, {"A": {"benford_hit": True}})
    found = scoring.findings(marked, rows.limit(0))
    row = scoring.id_scores(found).first()
    assert (row["base_score"], row["score_breakdown"]) == (70, "Benford's Law (+10) x7")
    merged = consolidation.consolidate(rows, consolidation.flag_reasons(found))
    assert merged.count() == 7 and merged.first()["flag_reasons"].endswith("distribution x7")


@pytest.mark.parametrize("amount, account, factor", [
    (100.0, "a", 1.0), (1.0, "a", 0.5), (1e9, "a", 2.0), (-50.0, "a", 0.5), (150.0, "a", 1.5),
    (5.0, "zero", 1.0), (5.0, None, 1.0), (5.0, "new", 1.0)])
def test_materiality(ledger, frame, amount, account, factor):
    medians = frame("account string, median double", ("a", 100.0), ("zero", 0.0))
    row = scoring.with_materiality(ledger({"amount": amount, "account": account}), medians).first()
    assert row["materiality_factor"] == factor


def test_nothing_flagged(ledger):
    marked = annotated(four(ledger), {})
    result = scoring.score(marked, scoring.id_scores(
        scoring.findings(marked, four(ledger).limit(0))))
    assert result.count() == 0 and "risk_rating" in result.columns
    assert reports.risk_summary(result).first() == (0, 0, 0, 0, 0, 0.0)
    assert [r["transactions"] for r in reports.rating_breakdown(result).collect()] == [0] * 4


def test_consolidation(ledger):
    rows = ledger({"transaction_id": "A", "account": "Fees"}, {"transaction_id": "B"},
                  {"transaction_id": "C"}, {"transaction_id": None})
    marked = annotated(rows, {"A": {"benford_hit": True, "outlier_direction": "low"},
                              "B": {"journal_hit": True, "is_weekend": True}})
    marked = marked.withColumn("benford_hit", F.col("benford_hit") | F.col("transaction_id").isNull())
    marked = with_any_hit(marked)
    reasons = consolidation.flag_reasons(
        scoring.findings(marked, rows.filter("transaction_id = 'A'")))
    got = {r["transaction_id"]: r for r in consolidation.consolidate(rows, reasons).collect()}
    assert set(got) == {"A", "B", None}
    a = got["A"]
    assert a["flag_count"] == 3 and a["flagged_benford"] and a["flagged_duplicate"]
    assert not a["flagged_related_party"]
    parts = a["flag_reasons"].split(" | ")
    assert [p[:12] for p in parts] == ["Benford's La", "Potential du", "Statistical "]
    assert got["B"]["flag_reasons"] == "Journal entry timing: posted on a weekend"
    merged = consolidation.consolidate(rows, reasons)
    assert [tuple(r) for r in consolidation.flag_count_breakdown(merged).collect()] == [(3, 1), (1, 2)]
    assert consolidation.multi_flag_leads(merged).count() == 1


# --- The whole audit on a ledger with planted anomalies -------------------------

@pytest.fixture(scope="module")
def planted(ledger):
    people = ["Asha Mrema", "Ben Kway", "Clara Temba", "Daudi Ngowi"]
    rows = []
    for i in range(240):
        rows.append({"transaction_id": f"N{i:03}", "date": at(f"2025-0{1 + i % 6}-0{3 + i % 5}T1{i % 7}:17"),
                     "amount": 90_000.0 + (i * 7919) % 20_011 + 0.37, "account": ["Loans", "Fees"][i % 2],
                     "user": people[i % 4], "counterparty": f"Client {chr(65 + i % 26)}{i}"})
    # keep ordinary rows on weekdays
    for row in rows:
        while row["date"].weekday() >= 5:
            row["date"] = row["date"].replace(day=row["date"].day + 2)
    for i in range(2):
        rows.append({"transaction_id": f"DUP{i}", "date": at(f"2025-03-04T1{i}:00"),
                     "amount": 95_321.4, "account": "Loans", "user": "Ben Kway",
                     "counterparty": "Twice Paid"})
    rows.append({"transaction_id": "RND", "amount": 3_000_000.0, "account": "Loans",
                 "user": "Ben Kway", "counterparty": "Somebody"})
    for i in range(6):
        rows.append({"transaction_id": f"ODD{i}", "date": at(f"2025-03-08T22:0{i}"), "amount": 91_000.5 + i,
                     "account": "Fees", "user": "Clara Temba", "counterparty": f"Night {i * 111}"})
    rows.append({"transaction_id": "SELF", "amount": 99_500.25, "account": "Loans",
                 "user": "Daudi Ngowi", "counterparty": "daudi  NGOWI"})
    rows.append({"transaction_id": "NEAR", "amount": 99_500.75, "account": "Loans",
                 "user": "Asha Mrema", "counterparty": "Daudi Ngowe"})
    return ledger(*rows)


@pytest.fixture(scope="module")
def audit(planted):
    return run_audit(planted)


def test_planted_anomalies_are_found(audit):
    def found(df):
        return {r["transaction_id"] for r in df.select("transaction_id").collect()}

    assert found(audit.duplicate_flagged) == {"DUP0", "DUP1"} == found(audit.duplicate_rows)
    assert found(audit.round_flagged) == {"RND"}
    assert found(audit.outlier_flagged) == {"RND"}
    assert found(audit.timing_flagged) == {f"ODD{i}" for i in range(6)} == found(audit.journal_high_risk)
    assert found(audit.related_party_flagged) == {"SELF"}
    assert found(audit.related_party_fuzzy) == {"NEAR"}
    assert audit.user_concentration.filter("flagged").first()["user"] == "Clara Temba"
    assert audit.benford_stats.first()["sample_size"] == audit.ledger.count()


def test_scores_of_planted_anomalies(audit):
    rows = {r["transaction_id"]: r for r in audit.risk_scored.collect()}
    assert max(r["risk_score"] for r in rows.values()) == 100.0
    assert {"DUP0", "DUP1", "RND", "SELF", "ODD0"} <= set(rows)
    # A near match is for review only and earns no points
    assert rows["NEAR"]["score_breakdown"] == "Benford's Law (+10)"
    assert rows["RND"]["risk_score"] == 100.0 and rows["RND"]["materiality_factor"] == 2.0
    top = [r["transaction_id"] for r in reports.top_risk(audit.risk_scored, 1).collect()]
    assert top == ["RND"]


def test_annotated_agrees_with_the_single_screens(audit):
    marked = audit.annotated

    def same(condition, flagged):
        left = marked.filter(condition).select("transaction_id")
        assert left.exceptAll(flagged.select("transaction_id")).isEmpty()
        assert flagged.select("transaction_id").exceptAll(left).isEmpty()

    same("benford_hit", audit.benford_flagged)
    same("roundness_tier is not null", audit.round_flagged)
    same("outlier_direction is not null", audit.outlier_flagged)
    same("timing_hit", audit.timing_flagged)
    same("journal_hit", audit.journal_high_risk)
    same("related_party_category is not null", audit.related_party_flagged)
    assert marked.count() == audit.ledger.count()


def test_reports(audit):
    scored_rows = audit.risk_scored.count()
    assert sum(r["transactions"] for r in reports.rating_breakdown(audit.risk_scored).collect()) == scored_rows
    trend = reports.monthly_trend(audit.risk_scored).collect()
    assert sum(r["critical"] + r["high"] + r["medium"] + r["low"] for r in trend) == scored_rows
    by_method = {r["method"]: r["flagged_rows"] for r in
                 reports.flags_by_method(audit.findings).collect()}
    assert by_method["Duplicate Payments"] == 2 and by_method["Journal Entry Timing"] == 6
    assert set(audit.flagged_sets) == {
        "flagged_benford", "flagged_duplicate", "flagged_round_number", "flagged_outlier",
        "flagged_journal_entry", "flagged_related_party"}


def test_without_loan_tables_everything_else_is_there(audit, spark, tmp_path):
    assert audit.reconciled is None and audit.gl_balances is None
    kpis = audit.kpis.first()
    assert kpis["transactions_reviewed"] == audit.ledger.count() and kpis["loans_reviewed"] is None
    paths = audit.publish(str(tmp_path))
    assert set(paths) == {"consolidated_findings", "risk_scored_findings"}
    back = spark.read.option("header", True).csv(paths["risk_scored_findings"])
    assert back.count() == audit.risk_scored.count()


def test_optional_columns_may_be_absent(planted):
    bare = run_audit(planted.drop("user", "counterparty"))
    assert bare.duplicate_flagged.count() == 0 and bare.related_party_flagged.count() == 0
    assert bare.related_party_fuzzy.count() == 0 and bare.journal_high_risk.count() == 0
    assert {"RND"} <= {r["transaction_id"] for r in bare.risk_scored.collect()}
    assert "user" not in bare.risk_scored.columns
    assert bare.consolidated.count() > 0


def test_findings_hold_each_flagged_row_once(audit):
    # a row that is flagged by itself and as a duplicate was written, read and grouped twice
    apart = scoring.findings(audit.annotated, audit.duplicate_rows)
    assert apart.count() - audit.findings.count() == apart.select(
        "transaction_id", "account", "duplicate_hit").distinct().groupBy("transaction_id").count().where(
        "count > 1").count() > 0
    for once, twice in (
            (scoring.risk_contributions(audit.findings), scoring.risk_contributions(apart)),
            (reports.flags_by_method(audit.findings), reports.flags_by_method(apart)),
            (scoring.id_scores(audit.findings), scoring.id_scores(apart))):
        assert sorted(map(tuple, once.collect())) == sorted(map(tuple, twice.collect()))


@pytest.mark.parametrize("parties", ["group", "ignore"])
def test_duplicates_are_marked_on_all_rows(ledger, parties):
    rows = ledger({"counterparty": "x"}, {"counterparty": "x"}, {"counterparty": None},
                  {"counterparty": None}, {"amount": None}, {"amount": None}, {"counterparty": "y"})
    cfg = ScreenConfig(null_counterparty=parties)
    marked = duplicates.with_duplicate_mark(rows, cfg)
    assert marked.count() == 7
    assert ids(marked.filter("duplicate_hit")) == ids(duplicates.duplicate_payment_rows(rows, cfg))


def test_reasons_of_one_id_are_counted_without_a_sort(ledger):
    rows = ledger(*({"transaction_id": "A", "account": a} for a in ("b", "a b", "a")))
    marked = annotated(rows, {"A": {"outlier_direction": "low", "journal_hit": True,
                                    "is_weekend": True, "is_after_hours": True}})
    reasons = consolidation.flag_reasons(scoring.findings(marked, rows))
    assert consolidation.consolidate(rows, reasons).first()["flag_reasons"].split(" | ")[1:] == [
        "Statistical outlier (modified z-score) within 'a b' — low extreme relative to peer transactions x3",
        "Journal entry timing: posted on a weekend and posted outside business hours (8:00-18:00) x3"]
    plan = reasons._jdf.queryExecution().executedPlan().toString()
    assert "SortAggregate" not in plan
