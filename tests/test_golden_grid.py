"""Hand-derived answers for a raw grid."""

from datetime import date

from conftest import plain

import ledgerloom as ll


def test_layout(golden_grid):
    (layout,) = plain(ll.detect_layouts(golden_grid))
    assert layout["header_row_no"] == 3
    assert layout["names"] == ["date", "description", "debit", "credit", "balance"]


def test_ledger(golden_grid):
    ledger = ll.build_ledger(golden_grid, ll.detect_layouts(golden_grid))
    got = [
        (r["row_no"], r["txn_date"], r["description"], r["debit"], r["credit"], r["balance"], r["txn_type"])
        for r in plain(ledger, "row_no")
    ]
    assert got == [
        (5, date(2024, 4, 2), "SALARY", 0.0, 5000.0, 6000.0, "credit"),
        (6, date(2024, 4, 13), "RENT", 1200.5, 0.0, 4799.5, "debit"),
    ]


def test_metadata(golden_grid):
    (meta,) = plain(ll.process(golden_grid).metadata)
    assert meta == {
        "account_number": "123456789012",
        "ifsc_code": "ABCD0123456",
        "period_from": "01-04-2024",
        "period_to": "30-04-2024",
        "customer_name": "ASHA RAO ACCOUNT NO",
        "opening_balance": 1000.0,
        "closing_balance": 4799.5,
    }
