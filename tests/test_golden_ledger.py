"""Hand-derived answers for a nine-row ledger."""

from datetime import date

import pytest
from conftest import plain

import ledgerloom as ll


@pytest.fixture(scope="module")
def flow(golden):
    return ll.flows(golden)


@pytest.fixture(scope="module")
def report(golden):
    return ll.report_ledger(golden)


def test_transaction_summary(flow):
    assert plain(ll.transaction_summary(flow)) == [
        {
            "total_transactions": 9,
            "start_date": date(2024, 1, 1),
            "end_date": date(2024, 3, 15),
            "unique_months": 3,
            "credit_count": 3,
            "debit_count": 6,
            "total_credit": 150000.0,
            "total_debit": 32650.0,
            "opening_balance": 60000.0,
            "closing_balance": 127350.0,
        }
    ]


def test_months(flow, report):
    months = plain(ll.monthly_summary(flow), "month")
    assert [
        (m["month"], m["total_credit"], m["total_debit"], m["net_flow"], m["opening_balance"], m["closing_balance"])
        for m in months
    ] == [
        ("2024-01", 50000, 10500, 39500, 60000, 49500),
        ("2024-02", 50000, 12000, 38000, 99500, 87500),
        ("2024-03", 50000, 10150, 39850, 137500, 127350),
    ]
    surplus = plain(ll.monthly_surplus(report), "month")
    assert [(m["income"], m["expenses"], m["surplus"]) for m in surplus] == [
        (50000, 10500, 39500),
        (50000, 12000, 38000),
        (50000, 10150, 39850),
    ]
    assert [m["savings_rate"] for m in surplus] == pytest.approx([79.0, 76.0, 79.7])
    assert [m["surplus"] for m in plain(ll.monthly_balance_surplus(flow), "month")] == [39500, 38000, 39850]


def test_summaries_agree_on_a_rollup(flow):
    coarse = ll.rollup(flow, "month", "txn_date", "expense_category", "income_source")
    for operator in (
        ll.transaction_summary,
        ll.monthly_summary,
        ll.expense_categories,
        ll.income_sources,
        ll.weekday_spending,
        ll.monthly_spending_stats,
    ):
        assert sorted(map(str, operator(flow).collect())) == sorted(map(str, operator(coarse).collect()))


def test_end_balance_and_counts(report):
    assert plain(ll.end_balance(report)) == [{"eod_balance": 127350.0}]
    assert plain(ll.direction_counts(report)) == [
        {"credit_transactions": 3, "debit_transactions": 6, "total_transactions": 9}
    ]


def test_categories(flow, report):
    got = [(c["category"], c["amount"]) for c in plain(ll.expense_categories(flow), "position")]
    assert got == [
        ("EMI & Loans", 30000),
        ("Cash Withdrawal", 2000),
        ("Food & Dining", 500),
        ("Uncategorized", 150),
    ]
    assert len(plain(ll.top_expenses(flow, 2))) == 2
    got = [(c["category"], c["amount"]) for c in plain(ll.report_expense_categories(report), "position")]
    assert got == [
        ("EMI & Loans", 30000),
        ("Cash Withdrawal", 2000),
        ("Online Payments", 500),
        ("Others", 150),
    ]
    (largest,) = plain(ll.largest_category(report))
    assert (largest["category"], largest["amount"]) == ("EMI & Loans", 30000)
    assert largest["percentage"] == pytest.approx(91.8836, abs=1e-4)


def test_spending(flow, golden):
    (stats,) = plain(ll.monthly_spending_stats(flow))
    assert stats["average_monthly_spending"] == pytest.approx(10883.333333)
    assert (stats["highest_month"], stats["highest_amount"]) == ("2024-02", 12000)
    assert (stats["lowest_month"], stats["lowest_amount"]) == ("2024-03", 10150)
    week = {d["day_of_week"]: d["amount"] for d in plain(ll.weekday_spending(flow))}
    assert week == {"Monday": 10000, "Tuesday": 12500, "Thursday": 0, "Friday": 10150}
    assert plain(ll.large_transactions(golden)) == [
        {"threshold": 10000.0, "count": 3, "total_amount": 30000.0}
    ]


def test_income_and_metrics(flow, golden):
    (income,) = plain(ll.income_summary(flow))
    assert income == {"total_income": 150000.0, "average_monthly_income": 50000.0}
    assert [(s["source"], s["amount"]) for s in plain(ll.income_sources(flow))] == [("Salary", 150000)]
    emis = ll.recurring_totals(ll.recurring_payments(golden))
    (metrics,) = plain(ll.financial_metrics(ll.transaction_summary(flow), ll.income_summary(flow), emis))
    assert metrics == pytest.approx(
        {
            "net_cashflow": 117350,
            "expense_ratio": 21.766667,
            "savings_rate": 78.233333,
            "emi_to_income_ratio": 20.0,
        }
    )


def test_recurring(golden, report):
    assert plain(ll.recurring_payments(golden)) == [
        {
            "row_no": 2,
            "amount": 10000.0,
            "description": "HOME LOAN EMI 001",
            "frequency": "monthly",
            "occurrences": 3,
            "confidence": "high",
            "first_date": date(2024, 1, 5),
            "last_date": date(2024, 3, 5),
        }
    ]
    assert plain(ll.report_recurring_payments(report)) == [
        {
            "row_no": 2,
            "amount": 10000.0,
            "description": "HOME LOAN EMI 001",
            "frequency": 3,
            "likely_emi": True,
            "regular_pattern": True,
            "confidence": "High",
            "total_paid": 30000.0,
            "first_date": date(2024, 1, 5),
            "last_date": date(2024, 3, 5),
        }
    ]


def test_unusual(golden):
    assert ll.unusual_transactions(golden).count() == 0
    found = plain(ll.top_unusual(ll.unusual_transactions(golden, 1)), "position")
    assert [(u["row_no"], u["unusual_count"]) for u in found] == [(2, 3), (5, 3), (8, 3)]
    assert found[0]["deviation_factor"] == pytest.approx(1.322158, abs=1e-6)


def test_overall_summary(report):
    (s,) = plain(ll.overall_summary(ll.monthly_surplus(report)))
    assert s["net_surplus"] == 117350
    assert s["average_monthly_income"] == 50000
    assert s["overall_savings_rate"] == pytest.approx(78.233333)


def test_quality(golden):
    columns = ll.column_quality(golden)
    assert {c["missing_count"] for c in plain(columns)} == {0}
    assert plain(ll.quality_score(columns)) == [
        {"total_rows": 9, "column_count": 8, "essential_found": 4, "quality_score": 90.0}
    ]
