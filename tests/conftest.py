from datetime import datetime

import pytest

from ledgersieve.session import local_session


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, "tests")
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def frame(spark):
    """Rows as dicts -> DataFrame with an explicit schema."""
    def build(schema: str, *rows):
        names = [part.split()[0].strip("`") for part in schema.split(",")]
        values = [tuple(row.get(n) if isinstance(row, dict) else row[i]
                        for i, n in enumerate(names)) for row in rows]
        return spark.createDataFrame(values, schema)
    return build


def at(text: str) -> datetime:
    return datetime.fromisoformat(text)


LEDGER = ("transaction_id string, date timestamp_ntz, amount double, account string, "
          "description string, user string, counterparty string")


@pytest.fixture(scope="session")
def ledger(frame):
    """Rows as keyword dicts with sensible defaults."""
    def build(*rows):
        full = []
        for i, row in enumerate(rows):
            base = {"transaction_id": f"T{i}", "date": at("2025-03-05T10:00:00"),
                    "amount": 100.0, "account": "Cash", "description": "d",
                    "user": "Asha", "counterparty": f"Party {i}"}
            full.append({**base, **row})
        return frame(LEDGER, *full)
    return build


def ids(df):
    return sorted(row["transaction_id"] for row in df.select("transaction_id").collect())
