import pytest
from pyspark.sql import functions as F

from ledgersieve.functions import scalars as s
from ledgersieve.sources import ledgers, sinks
from tests.conftest import at

MESSY = "`Txn_ID` string, `Transaction Date` string, `Txn_Amount` string, `GL_Account` string, `Narration` string"
CANONICAL = "transaction_id string, date string, amount string, account string, description string"


def test_aliases_are_matched_whatever_their_case_and_blanks():
    found = ledgers.match_columns(
        [" Txn_ID ", "Transaction Date", "VALUE", "amount", "noise"],
        {"transaction_id": ["transaction_id", "txn_id"], "date": ["date", "transaction_date"],
         "amount": ["amount", "value"]}, required=True)
    assert found == {"transaction_id": " Txn_ID ", "date": "Transaction Date", "amount": "amount"}


def test_missing_required_column_is_an_error_and_optional_is_not(spark):
    raw = spark.createDataFrame([("1", "2025-01-01", "5")], "id string, date string, amount string")
    with pytest.raises(ledgers.DataValidationError, match="account"):
        ledgers.standardise_columns(raw)
    assert ledgers.match_columns(["x"], {"user": ["user"]}, required=False) == {}


def test_unknown_columns_are_dropped_and_optional_ones_kept(spark):
    raw = spark.createDataFrame(
        [("1", "2025-01-01", "5", "A", "d", "Ben", "zzz")],
        "id string, date string, amount string, account string, memo string, officer string, extra string")
    assert ledgers.standardise(raw).columns == [
        "transaction_id", "date", "amount", "account", "description", "user"]


def test_bad_values_are_counted_and_dropped_once(frame):
    raw = frame(CANONICAL,
                ("1", "2025-01-06", "1000", "A", "ok"),
                ("2", "not-a-date", "garbage", "A", "both bad"),
                ("3", "2025-01-07", "garbage", "A", "amount bad"),
                ("1", "2025-01-08", "7", "A", "id again"),
                (None, "2025-01-08", "7", "A", None),
                (None, "2025-01-08", "7", "A", None))
    kept = ledgers.standardise(raw)
    assert kept.count() == 4
    report = ledgers.data_quality_report(raw).first().asDict()
    assert report == {
        "total_rows_loaded": 6, "rows_dropped_bad_date_or_amount": 2, "bad_dates_found": 1,
        "bad_amounts_found": 2, "duplicate_transaction_ids": 2, "rows_after_cleaning": 4,
        "has_user_column": False, "has_counterparty_column": False}


@pytest.mark.parametrize("text, value", [
    ("1234.5", 1234.5), ("TZS 1,234.50", 1234.5), ("$ -7", -7.0), ("(1,234)", 1234.0),
    ("1e3", 1000.0), (" 42 ", 42.0), ("+5", 5.0), ("garbage", None), ("", None), ("N/A", None),
    ("1.2.3", None), ("5-3", None), ("NaN", None), ("Infinity", None), ("12d", 12.0),
    (None, None)])
def test_amounts(frame, text, value):
    raw = frame(CANONICAL, ("1", "2025-01-01", text, "A", "d"))
    assert ledgers.coerce_types(raw).first()["amount"] == value


@pytest.mark.parametrize("text, value", [
    ("2025-01-06", "2025-01-06T00:00:00"), ("2025-01-06 23:30:15", "2025-01-06T23:30:15"),
    ("2025-01-06T23:30", "2025-01-06T23:30:00"), ("06/01/2025 08:15", "2025-01-06T08:15:00"),
    ("not-a-date", None), ("2025-13-45", None), ("20250106", None), ("NaT", None), (None, None)])
def test_dates(frame, text, value):
    raw = frame(CANONICAL, ("1", text, "5", "A", "d"))
    got = ledgers.coerce_types(raw, ["dd/MM/yyyy HH:mm"]).first()["date"]
    assert got == (at(value) if value else None)


def test_csv_is_read_standardised_and_validated(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text("Txn_ID,Transaction Date,Txn_Amount,GL_Account,Narration,Vendor\n"
                    "007,2025-01-06 10:00:00,\"TZS 1,500\",Cash,rent,Juma\n"
                    "008,2025-01-07,NA,Cash,none,null\n")
    row, = ledgers.load_ledger(spark, str(path)).collect()
    assert row["transaction_id"] == "007" and row["amount"] == 1500.0 and row["counterparty"] == "Juma"

    (tmp_path / "empty.csv").write_text("id,date,amount,account,memo\n")
    with pytest.raises(ledgers.DataValidationError, match="no rows"):
        ledgers.validate(ledgers.read_raw(spark, str(tmp_path / "empty.csv")))
    (tmp_path / "bad.csv").write_text("id,date,amount,account,memo\n1,x,y,A,m\n")
    with pytest.raises(ledgers.DataValidationError, match="dropped"):
        ledgers.validate(ledgers.read_raw(spark, str(tmp_path / "bad.csv")))
    with pytest.raises(ValueError, match="Unsupported"):
        ledgers.read_raw(spark, "ledger.xlsx")
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist"):
        ledgers.read_raw(spark, str(tmp_path / "nowhere.csv")).count()


def test_quoted_texts_hold_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "quoted.csv"
    path.write_text('id,memo,date,amount,account\n1,"say ""hi"", ok",2025-01-06,5,A\n'
                    '2,"two\nlines",2025-01-07,6,B\n')
    rows = {r["transaction_id"]: r for r in ledgers.load_ledger(spark, str(path)).collect()}
    assert rows["1"]["description"] == 'say "hi", ok' and rows["1"]["amount"] == 5.0
    assert rows["2"]["description"] == "two\nlines" and rows["2"]["account"] == "B"
    whole = ledgers.read_raw(spark, str(path), line_breaks=False)
    assert whole.first()["memo"] == 'say "hi", ok'
    (tmp_path / "loans.csv").write_text(
        'loan_id,borrower,schedule_outstanding_balance\nL1,"Ann ""A""\nBo",7\n')
    loan = ledgers.read_schedule(spark, str(tmp_path / "loans.csv")).first()
    assert loan["borrower"] == 'Ann "A"\nBo' and loan["schedule_outstanding_balance"] == 7.0


@pytest.mark.parametrize("texts, found", [
    (["03/15/2025", "04/02/2025 08:15"], ["2025-03-15T00:00:00", "2025-04-02T08:15:00"]),
    (["15/03/2025", "04/02/2025"], ["2025-03-15T00:00:00", "2025-02-04T00:00:00"]),
    (["2025/03/05", "2025-03-06"], ["2025-03-05T00:00:00", "2025-03-06T00:00:00"]),
    (["15 Mar 2025", "x"], ["2025-03-15T00:00:00", None]),
    (["x", None], [None, None])])
def test_written_forms_of_dates_are_found(frame, texts, found):
    raw = frame(CANONICAL, *((str(i), t, "5", "A", "d") for i, t in enumerate(texts)))
    typed = ledgers.coerce_types(raw, ledgers.detect_date_formats(raw)).orderBy("transaction_id")
    assert [r["date"] for r in typed.collect()] == [at(f) if f else None for f in found]


def test_dates_that_could_be_either_are_an_error(frame):
    raw = frame(CANONICAL, ("1", "03/04/2025", "5", "A", "d"))
    with pytest.raises(ledgers.DataValidationError, match="equally"):
        ledgers.detect_date_formats(raw)


def test_headers_that_fold_alike_are_an_error():
    aliases = {"amount": ["amount", "value"], "date": ["date"]}
    with pytest.raises(ledgers.DataValidationError, match="same name"):
        ledgers.match_columns(["Amount", "amount ", "date"], aliases, required=True)
    assert ledgers.match_columns(["amount", "Value", "VALUE", "Date"], aliases, required=True) == {
        "amount": "amount", "date": "Date"}


def test_amounts_no_double_holds_are_bad(frame):
    raw = frame(CANONICAL, ("1", "2025-01-06", "1e999", "A", "d"), ("2", "2025-01-06", "4", "A", "d"))
    assert ledgers.data_quality_report(raw).first()["bad_amounts_found"] == 1
    typed = frame(CANONICAL.replace("amount string", "amount double"),
                  ("1", "2025-01-06", float("inf"), "A", "d"))
    assert ledgers.coerce_types(typed).first()["amount"] is None


@pytest.mark.parametrize("values, total", [
    ([1e16, 1.0, -1e16], 1.0), ([1e23, 2e23], 3e23), ([1e200, 1e200, 5.0], 2e200), ([0.1, 0.2], 0.3),
    ([None], 0.0), ([1e24, -1e24, 7.5], 7.5)])
def test_sums_of_any_size(frame, values, total):
    got = frame("v double", *((v,) for v in values)).agg(s.total(F.col("v"))).first()[0]
    assert got == pytest.approx(total, rel=1e-11)


def test_schedule_columns_are_typed(spark, tmp_path):
    path = tmp_path / "schedule.csv"
    path.write_text("loan_id,borrower,product,officer,disbursement_date,disbursement_amount,"
                    "schedule_outstanding_balance\nLN1,Neema,Farm,Ben,2025-01-01 09:00:00,500.5,abc\n")
    row = ledgers.read_schedule(spark, str(path)).first()
    assert row["disbursement_amount"] == 500.5 and row["schedule_outstanding_balance"] is None


def test_findings_are_written_in_report_order(spark, tmp_path):
    rows = spark.createDataFrame([("a", 5.0, 1), ("b", 7.0, 1), ("c", 1.0, 2)],
                                 "transaction_id string, amount double, flag_count int")
    path = str(tmp_path / "out.csv")
    sinks.write_findings(rows, path, "consolidated")
    back = spark.read.option("header", True).csv(path)
    assert sorted(back.columns) == ["amount", "flag_count", "transaction_id"]
    assert [r[0] for r in sinks.in_report_order(rows, "consolidated").collect()] == ["c", "b", "a"]
    sinks.write_findings(rows, str(tmp_path / "out.parquet"), fmt="parquet")
    assert spark.read.parquet(str(tmp_path / "out.parquet")).count() == 3
    with pytest.raises(ValueError):
        sinks.write_findings(rows, path, fmt="xlsx")


def test_texts_are_parsed_once_in_the_plan(frame):
    raw = frame("id string, date string, amount string, account string, description string",
                ("1", "2025-01-01", "TZS 5", "a", "d"), ("2", "03/02/2025", "x", "a", "d"),
                ("3", "no", "1e400", "a", "d"), ("4", "03/02/2025", "7", "a", None))
    ledger = ledgers.standardise(raw, ["dd/MM/yyyy"])
    plan = ledger._jdf.queryExecution().executedPlan().toString()
    assert [plan.count(part) for part in ("regexp_extract", "regexp_replace", "gettimestamp")] == [2, 1, 1]
    assert [(r["transaction_id"], r["amount"]) for r in ledger.collect()] == [("1", 5.0), ("4", 7.0)]


HEADER = "transaction_id,date,amount,account,description\n"
FILES = {
    "plain": ("1,2025-01-01,5,a,d\n2,2025-01-02,6,a,d\n", True),
    "quoted": ('1,2025-01-01,5,a,"x, ""y"""\n\n2,2025-01-02,6,a,"z"\n', True),
    "carriage returns": ("1,2025-01-01,5,a,d\r\n", True),
    "two feet": ('1,2025-01-01,5,a,5" and 6" pipe\n', True),
    "across lines": ('1,2025-01-01,5,a,"x\ny"\n2,2025-01-02,6,a,"z"\n', False),
    "closed and opened in a line": ('1,2025-01-01,5,"a\n","x\ny"\n', False),
    "one foot": ('1,2025-01-01,5,a,5" pipe\n2,2025-01-02,6,a,d\n', False),
    "lone carriage return": ("1,2025-01-01,5,a,x\ry\n", False),
}


@pytest.mark.parametrize("name", FILES)
def test_files_are_split_where_no_quoted_text_goes_on(spark, tmp_path, name):
    body, safe = FILES[name]
    path = tmp_path / "ledger.csv"
    header = HEADER.replace("\n", "\r\n") if name == "carriage returns" else HEADER
    path.write_bytes((header + body).encode())
    assert ledgers.lines_are_rows(spark, str(path)) is safe
    found, whole = (sorted(map(tuple, ledgers.read_raw(spark, str(path), line_breaks=b).collect()), key=str)
                    for b in (None, True))
    assert found == whole


def test_a_large_quoted_file_is_read_by_many_tasks(spark, tmp_path):
    path = tmp_path / "ledger.csv"
    path.write_text(HEADER + "".join(f'{i},2025-01-01,5,a,"x, {i}"\n' for i in range(40_000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "100000")
    try:
        raw = ledgers.read_raw(spark, str(path))
        assert raw.rdd.getNumPartitions() > 8
        assert raw.count() == 40_000 and raw.distinct().count() == 40_000
        assert ledgers.read_raw(spark, str(path), line_breaks=True).rdd.getNumPartitions() == 1
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
