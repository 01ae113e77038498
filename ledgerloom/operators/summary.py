"""Summaries per statement and per month."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import classify
from ..rules import REPORT_EXPENSE_RULES, RuleSet
from ..schemas import KEY, ZERO, day_order
from .flows import rollup


def percent_of(part: str, whole: str) -> str:
    """part / whole * 100, or 0 if the whole is not positive."""
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS double) / CAST({whole} AS double) * 100 ELSE 0.0D END"


#: Totals of a statement from its measures by month.
TOTALS = [
    "sum(rows) AS total_transactions",
    "min(first_date) AS start_date",
    "max(last_date) AS end_date",
    "count(month) AS unique_months",
    "sum(credit_count) AS credit_count",
    "sum(debit_count) AS debit_count",
    "sum(credit) AS total_credit",
    "sum(debit) AS total_debit",
    "min_by(first_row_balance, first_row) AS opening_balance",
    "max_by(last_row_balance, last_row) AS closing_balance",
]


def transaction_summary(flow: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """Counts, period, totals and balances of every statement.

    Balances come from ``metadata`` if given, else from the ledger in row order;
    a missing balance counts as 0.
    """
    summary = rollup(flow, "month").groupBy(KEY).agg(*map(F.expr, TOTALS))
    if metadata is not None:
        balances = metadata.select(KEY, "opening_balance", "closing_balance")
        summary = summary.drop("opening_balance", "closing_balance").join(balances, KEY, "left")
    return summary.withColumns(
        {c: F.expr(f"coalesce({c}, {ZERO})") for c in ("opening_balance", "closing_balance")}
    )


def monthly_summary(flow: DataFrame) -> DataFrame:
    """Counts, totals, net flow and first/last balance by date of every month."""
    return rollup(flow.where("month IS NOT NULL"), "month").selectExpr(
        KEY,
        "month",
        "credit_count",
        "debit_count",
        "credit AS total_credit",
        "debit AS total_debit",
        "credit - debit AS net_flow",
        "first_day_balance AS opening_balance",
        "last_day_balance AS closing_balance",
    )


def monthly_balance_surplus(flow: DataFrame) -> DataFrame:
    """Income, expenses, surplus and balances per month; a missing balance counts as 0."""
    return monthly_summary(flow).selectExpr(
        KEY,
        "month",
        "total_credit AS income",
        "total_debit AS expenses",
        "net_flow AS surplus",
        f"coalesce(opening_balance, {ZERO}) AS opening_balance",
        f"coalesce(closing_balance, {ZERO}) AS closing_balance",
    )


# ---- the second report, on its own ledger view ----


_BALANCE_ORDER = f"CASE WHEN balance IS NOT NULL THEN coalesce({day_order()}, row_no) END"


def report_rollup(report: DataFrame, rules: RuleSet = REPORT_EXPENSE_RULES) -> DataFrame:
    """The second report's ledger added up by month, direction and category.

    The figures below take it in place of the rows; ``rows`` and ``last_place`` stand
    for the rows that a line adds up and the place of its last balance.
    """
    category = f"CASE WHEN dr_cr_indicator = 'DR' THEN {classify('description', rules)} END AS category"
    return report.groupBy(KEY, "has_date", "month", "dr_cr_indicator", F.expr(category)).agg(
        F.expr("count(1) AS rows"),
        F.expr("sum(debit) AS debit"),
        F.expr("sum(credit_amount) AS credit_amount"),
        F.expr(f"max({_BALANCE_ORDER}) AS last_place"),
        F.expr(f"max_by(balance, {_BALANCE_ORDER}) AS balance"),
    )


def direction_counts(report: DataFrame) -> DataFrame:
    rows = "rows" if "rows" in report.columns else "1L"
    return report.groupBy(KEY).agg(
        F.expr(f"sum(CASE WHEN dr_cr_indicator = 'CR' THEN {rows} ELSE 0 END) AS credit_transactions"),
        F.expr(f"sum(CASE WHEN dr_cr_indicator = 'DR' THEN {rows} ELSE 0 END) AS debit_transactions"),
        F.expr(f"sum({rows}) AS total_transactions"),
    )


def end_balance(report: DataFrame) -> DataFrame:
    """Last balance by date, or credits minus debits if no row has a balance."""
    order = "last_place" if "last_place" in report.columns else _BALANCE_ORDER
    return report.groupBy(KEY).agg(
        F.expr(f"coalesce(max_by(balance, {order}), sum(credit_amount) - sum(debit)) AS eod_balance")
    )


def monthly_surplus(report: DataFrame) -> DataFrame:
    """Income, expenses, surplus and savings rate per month (one ``Total`` without dates)."""
    month = F.expr("CASE WHEN has_date THEN month ELSE 'Total' END AS month")
    return (
        report.groupBy(KEY, month)
        .agg(
            F.expr("sum(CASE WHEN dr_cr_indicator = 'CR' THEN credit_amount ELSE 0 END) AS income"),
            F.expr("sum(CASE WHEN dr_cr_indicator = 'DR' THEN debit ELSE 0 END) AS expenses"),
        )
        .selectExpr(
            KEY,
            "month",
            "income",
            "expenses",
            "income - expenses AS surplus",
            f"{percent_of('(income - expenses)', 'income')} AS savings_rate",
        )
    )


def monthly_expenses(report: DataFrame) -> DataFrame:
    return monthly_surplus(report).select(KEY, "month", "expenses")


def overall_summary(surplus: DataFrame) -> DataFrame:
    """Totals, savings rate and monthly averages from ``monthly_surplus``."""
    return (
        surplus.groupBy(KEY)
        .agg(
            F.expr("sum(income) AS total_income"),
            F.expr("sum(expenses) AS total_expenses"),
            F.expr("count(1) AS months"),
        )
        .selectExpr(
            KEY,
            "total_income",
            "total_expenses",
            "total_income - total_expenses AS net_surplus",
            f"{percent_of('(total_income - total_expenses)', 'total_income')} AS overall_savings_rate",
            "CAST(total_income AS double) / months AS average_monthly_income",
            "CAST(total_expenses AS double) / months AS average_monthly_expenses",
        )
    )
