import random
from datetime import datetime, timedelta

import pytest

from ledgersieve import ScreenConfig
from ledgersieve.functions import scalars as s
from ledgersieve.operators import duplicates
from ledgersieve.operators.numbering import consecutive_numbers
from pyspark.sql import functions as F

from tests.conftest import at, ids


def pay(day, party="Juma", amount=500_000.0, account="Loan", **other):
    return {"date": at(day), "counterparty": party, "amount": amount, "account": account, **other}


def test_pair_within_window_is_flagged_and_others_are_not(ledger):
    rows = ledger(pay("2025-01-10T09:00"), pay("2025-01-11T09:00"),
                  pay("2025-01-10T09:00", "Neema"), pay("2025-01-24T09:00", "Neema"),
                  pay("2025-01-10T09:00", "Rosa"), pay("2025-01-10T09:00", "Rosa", account="Fee"))
    flagged = duplicates.duplicate_payments(rows)
    assert ids(flagged) == ["T0", "T1"]
    assert {r["duplicate_group_id"] for r in flagged.collect()} == {"DUP-GRP-1"}
    assert ids(duplicates.duplicate_payment_rows(rows)) == ["T0", "T1"]


def test_window_is_inclusive_to_the_microsecond(ledger):
    rows = ledger(pay("2025-01-01T00:00:00"), pay("2025-01-04T00:00:00"),
                  pay("2025-01-01T00:00:00", "B"), pay("2025-01-04T00:00:00.000001", "B"),
                  pay("2025-01-01T00:00:00", "C"), pay("2025-01-04T00:00:01", "C"))
    assert ids(duplicates.duplicate_payments(rows)) == ["T0", "T1"]


def test_one_group_per_key_even_with_two_clusters(ledger):
    rows = ledger(*(pay(f"2025-0{m}-0{d}T00:00") for m in (1, 5) for d in (1, 2)))
    flagged = duplicates.duplicate_payments(rows)
    assert flagged.count() == 4
    assert {r["duplicate_group_id"] for r in flagged.collect()} == {"DUP-GRP-1"}


def test_missing_counterparties_group_together_unless_ignored(ledger):
    rows = ledger(pay("2025-01-01T00:00", None), pay("2025-01-02T00:00", None))
    assert duplicates.duplicate_payments(rows).count() == 2
    ignored = duplicates.duplicate_payments(rows, ScreenConfig(null_counterparty="ignore"))
    assert ignored.count() == 0


def test_without_counterparty_column_nothing_is_flagged(ledger):
    rows = ledger(pay("2025-01-01T00:00"), pay("2025-01-02T00:00")).drop("counterparty")
    empty = duplicates.duplicate_payments(rows)
    assert empty.count() == 0 and empty.columns[-2:] == ["duplicate_group_id", "flag_reason"]
    assert duplicates.duplicate_payment_rows(rows).count() == 0


def test_group_numbers_follow_the_text_of_the_key(ledger):
    parties = ["b", "B", "a", "ä", None]
    rows = ledger(*(pay(f"2025-01-0{d}T00:00", p, amount)
                    for p in parties for amount in (9.0, 10.0, 2e7, 0.5) for d in (1, 2)))
    got = {(r["counterparty"], r["amount"]): r["duplicate_group_id"]
           for r in duplicates.duplicate_payments(rows).collect()}
    texts = sorted((f"{'nan' if p is None else p}|Loan|{a!r}", p, a) for p, a in got)
    assert got == {(p, a): f"DUP-GRP-{i}" for i, (_, p, a) in enumerate(texts, 1)}


@pytest.mark.parametrize("days", [0, 0.5, 3])
def test_against_brute_force_with_one_key_holding_most_rows(ledger, days):
    rng = random.Random(5)
    start = datetime(1969, 12, 1)
    rows = []
    for i in range(400):
        party = "hot" if rng.random() < 0.5 else f"p{rng.randrange(40)}"
        rows.append(pay((start + timedelta(hours=rng.randrange(0, 4000))).isoformat(), party,
                        float(rng.choice([1, 2])), transaction_id=f"T{i}"))
    expected = sorted(
        a["transaction_id"] for i, a in enumerate(rows)
        if any(i != j and a["counterparty"] == b["counterparty"] and a["amount"] == b["amount"]
               and abs((a["date"] - b["date"]).total_seconds()) <= days * 86400
               for j, b in enumerate(rows)))
    cfg = ScreenConfig(duplicate_window_days=days)
    assert ids(duplicates.duplicate_payment_rows(ledger(*rows), cfg)) == expected
    assert ids(duplicates.duplicate_payments(ledger(*rows), cfg)) == expected


def test_repeated_ids(ledger):
    rows = ledger({"transaction_id": "A"}, {"transaction_id": "B"}, {"transaction_id": "A"},
                  {"transaction_id": None}, {"transaction_id": None})
    got = [r["transaction_id"] for r in duplicates.exact_id_duplicates(rows).collect()]
    assert sorted(got, key=str) == ["A", "A", None, None]


def test_summary(ledger):
    rows = ledger(pay("2025-01-10T09:00", amount=0.1), pay("2025-01-11T09:00", amount=0.1),
                  pay("2025-01-11T10:00", amount=0.1))
    assert duplicates.summarize_duplicates(duplicates.duplicate_payments(rows)).first() == (1, 3, 0.3)
    none = duplicates.summarize_duplicates(duplicates.duplicate_payments(ledger(pay("2025-01-10"))))
    assert none.first() == (0, 0, 0.0)


def test_keys_that_read_alike_share_a_group(ledger):
    rows = ledger(*({"counterparty": c, "account": a} for c, a in
                    [("A|B", "C"), ("A|B", "C"), ("A", "B|C"), ("A", "B|C"), ("Z", "C"), ("Z", "C")]))
    groups = [r[0] for r in duplicates.duplicate_payments(rows).orderBy("transaction_id").select(
        "duplicate_group_id").collect()]
    assert groups == ["DUP-GRP-1"] * 4 + ["DUP-GRP-2"] * 2


def test_fractional_windows_are_named_as_given(ledger):
    rows = duplicates.duplicate_payments(
        ledger({"counterparty": "A"}, {"counterparty": "A"}), ScreenConfig(duplicate_window_days=0.5))
    assert rows.first()["flag_reason"].endswith("within 0.5 day(s)")


def test_consecutive_numbers_over_many_ranges(spark):
    texts = spark.range(3000).select(F.sha1(F.col("id").cast("string")).alias("text"))
    got = {r["text"]: r["no"] for r in consecutive_numbers(texts, "text", "no").collect()}
    assert got == {t: i for i, t in enumerate(sorted(got), 1)}


@pytest.mark.parametrize("value", [0.0, 1.0, -5.5, 1e7, 123456789.25, 0.0005, 1234567890123.4, 9e15])
def test_float_text_is_what_python_prints(frame, value):
    assert frame("v double", (value,)).select(s.float_text(F.col("v"))).first()[0] == repr(value)


def test_clock_micros(spark):
    row = spark.sql("select timestamp_ntz'2025-01-06 13:14:15.000016' a, "
                    "timestamp_ntz'1969-12-31 23:59:59.5' b")
    got = row.select(s.clock_micros(F.col("a")), s.clock_micros(F.col("b"))).first()
    assert tuple(got) == (1736169255000016, -500000)


@pytest.mark.parametrize("stretch", [1, 2, 1024])
def test_stretches_of_a_long_key_give_what_one_look_at_all_gives(spark, monkeypatch, stretch):
    """Seconds around and before 1970, under one key and a window of two seconds."""
    monkeypatch.setattr(duplicates, "STRETCH_SLOTS", stretch)
    rng = random.Random(stretch)
    seconds = sorted({rng.randint(-900, 900) for _ in range(300)})
    rows = spark.createDataFrame([(str(x), x * 1.0) for x in seconds], "transaction_id string, x double")
    ledger = rows.selectExpr(
        "transaction_id", "cast(timestamp_seconds(x) as timestamp_ntz) as date", "5.0D as amount",
        "'a' as account", "'c' as counterparty")
    cfg = ScreenConfig(duplicate_window_days=2 / 86_400)
    expected = [str(x) for x in seconds if any(0 < abs(x - y) <= 2 for y in seconds)]
    assert ids(duplicates.duplicate_payment_rows(ledger, cfg)) == sorted(expected)


def test_no_task_sees_all_slots_of_a_key(spark):
    """A million rows under one key: half of all rows share a time with another."""
    ledger = spark.range(1_000_000).selectExpr(
        "cast(id as string) as transaction_id", "'a' as account", "'c' as counterparty", "5.0D as amount",
        "cast(timestamp_micros(id - id % 4 + greatest(id % 4, 1)) as timestamp_ntz) as date")
    keyed = lambda cfg: duplicates._keyed(
        ledger, cfg, "amount", "date", "counterparty", "account")
    same_time = duplicates._close_slots(keyed(ScreenConfig(duplicate_window_days=0)),
                                        ScreenConfig(duplicate_window_days=0))
    assert "Window" not in same_time._jdf.queryExecution().executedPlan().toString()
    assert same_time.count() == 250_000
    slots = keyed(ScreenConfig(duplicate_window_days=1 / 86_400_000_000)).select(*duplicates.KEY, "slot").distinct()
    largest = duplicates._stretched(slots, 1).groupBy(*duplicates.KEY, "stretch").count().agg({"count": "max"})
    assert largest.first()[0] <= duplicates.STRETCH_SLOTS + 2


def test_close_slots_of_a_key_are_listed_in_blocks(spark):
    """Ten thousand slots around 1970 under one key, all but every tenth with two rows."""
    ledger = spark.range(20_000).where("id % 20 <> 1").selectExpr(
        "cast(id as string) as transaction_id", "'a' as account", "'c' as counterparty", "5.0D as amount",
        "cast(timestamp_seconds((id div 2 - 5000) * 4.0D + id % 2) as timestamp_ntz) as date")
    cfg = ScreenConfig(duplicate_window_days=2 / 86_400)
    slots = duplicates.close_slots(ledger, cfg)
    assert slots.count() <= 20_000 // 64 + 2
    expected = {str(x) for x in range(20_000) if x % 20 > 1}
    assert {r[0] for r in duplicates.duplicate_payment_rows(ledger, cfg, slots=slots).select("transaction_id").collect()} \
        == expected
    marked = duplicates.with_duplicate_mark(ledger, cfg, slots=slots)
    assert {r[0] for r in marked.where("duplicate_hit").select("transaction_id").collect()} == expected
    assert marked.count() == 19_000
