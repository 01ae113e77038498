import sys
from datetime import date
from decimal import Decimal
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from ledgerloom import finish_ledger, local_session  # noqa: E402
from ledgerloom.schemas import MONEY, RAW_CELLS  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    session = local_session(4, 4)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", "1m")
    yield session
    session.stop()


def money(x):
    return None if x is None else Decimal(str(x)).quantize(Decimal("0.01"))


LEDGER_ROWS = [
    (1, "2024-01-01", "SALARY ACME", 0, 50000, 60000),
    (2, "2024-01-05", "HOME LOAN EMI 001", 10000, 0, 50000),
    (3, "2024-01-09", "UPI SWIGGY ORDER", 500, 0, 49500),
    (4, "2024-02-01", "SALARY ACME", 0, 50000, 99500),
    (5, "2024-02-05", "HOME LOAN EMI 002", 10000, 0, 89500),
    (6, "2024-02-20", "ATM CASH WDL", 2000, 0, 87500),
    (7, "2024-03-01", "SALARY ACME", 0, 50000, 137500),
    (8, "2024-03-05", "HOME LOAN EMI 003", 10000, 0, 127500),
    (9, "2024-03-15", "XYZZY", 150, 0, 127350),
]


def make_ledger(spark, rows, statement="g1"):
    """Rows of (row_no, iso date or None, description, debit, credit, balance)."""
    data = [
        (
            statement,
            r[0],
            date.fromisoformat(r[1]) if r[1] else None,
            r[2],
            money(r[3]),
            money(r[4]),
            money(r[5]),
        )
        for r in rows
    ]
    schema = (
        f"statement_id string, row_no bigint, txn_date date, description string, "
        f"debit {MONEY}, credit {MONEY}, balance {MONEY}"
    )
    return finish_ledger(spark.createDataFrame(data, schema))


def make_grid(spark, grids):
    data = [(k, i, cells) for k, rows in grids.items() for i, cells in enumerate(rows)]
    return spark.createDataFrame(data, RAW_CELLS)


GRID_ROWS = [
    ["Customer Name : ASHA RAO", None, None, None, None],
    ["Account No : 123456789012", "IFSC Code : ABCD0123456", None, None, None],
    ["Statement From : 01-04-2024 To : 30-04-2024", None, None, None, None],
    ["Tran Date", "Particulars", "Debit", "Credit", "Balance"],
    ["OPENING BALANCE", None, None, None, "1,000.00"],
    ["02-04-2024", "SALARY", None, "5,000.00 Cr", "6,000.00"],
    ["13/04/2024", "RENT", "1,200.50", None, "4,799.50"],
    ["TRANSACTION TOTAL", None, "1,200.50", "5,000.00", None],
    ["This is a system generated statement", None, None, None, None],
]


@pytest.fixture(scope="session")
def golden(spark):
    return make_ledger(spark, LEDGER_ROWS).cache()


@pytest.fixture(scope="session")
def golden_grid(spark):
    return make_grid(spark, {"g2": GRID_ROWS}).cache()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def plain(df, *order):
    """Rows as dicts, decimals as floats, keys without the statement."""
    out = []
    for r in (df.orderBy(*order) if order else df).collect():
        out.append(
            {
                k: float(v) if isinstance(v, Decimal) else v
                for k, v in r.asDict().items()
                if k != "statement_id"
            }
        )
    return out
