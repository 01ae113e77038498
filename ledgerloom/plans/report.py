"""The text report and the tables behind the charts."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import currency, currency_or_text, lit, percentage, shorten
from ..operators import summary
from ..operators.categories import report_expense_categories
from ..schemas import KEY

# Section titles of the report, in order.
SECTIONS = [
    "TRANSACTION SUMMARY",
    "End of Day Balance",
    "MONTHLY EXPENSES",
    "EXPENSE CATEGORIES",
    "HIGHEST EXPENSE CATEGORY",
    "MONTHLY SURPLUS ANALYSIS",
    "EMI/RECURRING PAYMENTS ANALYSIS",
    "OVERALL SUMMARY",
]
NO_RECURRING = "No recurring EMI patterns detected."


def report_lines(report: DataFrame) -> DataFrame:
    """``(statement_id, section, line_no, text)`` from the rows of ``comprehensive_report``."""

    def lines(section: int, *texts: str) -> str:
        return f"array({', '.join([lit(SECTIONS[section]), *texts])})"

    def each(items: str, text: str) -> str:
        return f"coalesce(transform({items}, x -> {text}), array())"

    def titled(section: int, items: str) -> str:
        return f"concat({lines(section)}, {items})"

    def labelled(label: str, value: str) -> str:
        return f"concat({lit(label)}, {value})"

    category = (
        "concat(rpad(x.category, 25, ' '), ': ₹', " + _right("format_number(x.amount, 2)", 10) + ", ' (', "
        + _right(percentage("CAST(x.amount AS double) / expenses * 100"), 6) + ", ')')"
    )
    month = (
        f"concat_ws(' | ', x.month, {currency('x.income')}, {currency('x.expenses')}, {currency('x.surplus')}, "
        f"{percentage('x.savings_rate')})"
    )
    recurring = (
        f"concat_ws(' | ', {currency('x.amount')}, {shorten('x.description')}, concat(x.frequency, ' times'), "
        f"x.confidence, {currency('x.total_paid')})"
    )
    recurring_total = labelled("Total Monthly EMI/Recurring: ", currency("recurring"))
    sections = [
        lines(
            0,
            labelled("Credit Transactions: ", "transaction_counts.credit_transactions"),
            labelled("Debit Transactions:  ", "transaction_counts.debit_transactions"),
            labelled("Total Transactions:  ", "transaction_counts.total_transactions"),
        ),
        f"array({labelled(SECTIONS[1] + ': ', currency('eod_balance'))})",
        titled(2, each("monthly_expenses", f"concat(x.month, ': ', {currency('x.expenses')})")),
        titled(3, each("largest_first", category)),
        lines(
            4,
            labelled("Category: ", "most_expense_category.category"),
            labelled("Amount: ", currency("most_expense_category.amount")),
            "concat('Percentage: ', coalesce("
            f"{percentage('most_expense_category.percentage')}, 'n/a'), ' of total expenses')",
        ),
        titled(5, each("monthly_surplus", month)),
        titled(
            6,
            f"CASE WHEN size(emi_analysis) > 0 THEN concat({each('emi_analysis', recurring)}, array({recurring_total}))"
            f" ELSE array({lit(NO_RECURRING)}) END",
        ),
        lines(
            7,
            labelled("Total Income:           ", currency("summary.total_income")),
            labelled("Total Expenses:         ", currency("summary.total_expenses")),
            labelled("Net Surplus:            ", currency("summary.net_surplus")),
            labelled("Overall Savings Rate:   ", percentage("summary.overall_savings_rate")),
            labelled("Avg Monthly Income:     ", currency("summary.average_monthly_income")),
            labelled("Avg Monthly Expenses:   ", currency("summary.average_monthly_expenses")),
        ),
    ]
    numbered = ", ".join(
        f"transform({texts}, (t, i) -> named_struct('section', {s}, 'line_no', i, 'text', t))"
        for s, texts in enumerate(sections)
    )
    largest_first = (
        "transform(array_sort(transform(expense_categories, (c, i) -> named_struct("
        "'less', -c.amount, 'i', i, 'category', c.category, 'amount', c.amount))), "
        "c -> named_struct('category', c.category, 'amount', c.amount))"
    )
    return (
        report.withColumns(
            {
                "largest_first": F.expr(largest_first),
                "expenses": F.expr("aggregate(expense_categories, 0D, (a, c) -> a + CAST(c.amount AS double))"),
                "recurring": F.expr(
                    "aggregate(emi_analysis, CAST(0 AS decimal(38,2)), (a, e) -> CAST(a + e.amount AS decimal(38,2)))"
                ),
            }
        )
        .selectExpr(KEY, f"inline(flatten(array({numbered})))")
    )


def _right(text: str, width: int) -> str:
    """Right-aligned in ``width`` characters; longer text stays whole."""
    return f"concat(repeat(' ', greatest({width} - length({text}), 0)), {text})"


# ---- tables behind the charts and the transaction view ----


def monthly_table(flow: DataFrame) -> DataFrame:
    """Income, expenses, net and balances per month."""
    return summary.monthly_balance_surplus(flow).withColumnRenamed("surplus", "net")


def income_versus_expenses(flow: DataFrame) -> DataFrame:
    """One row per month and bar of the grouped chart."""
    return summary.monthly_balance_surplus(flow).unpivot(
        [KEY, "month"], ["income", "expenses"], "series", "amount"
    )


def category_shares(report: DataFrame) -> DataFrame:
    return report_expense_categories(report).select(KEY, "category", "amount", "percentage")


def display_ledger(ledger: DataFrame) -> DataFrame:
    """The ledger as shown to a reader: money columns as currency text."""
    money = ["amount", "debit", "credit", "balance"]
    return ledger.withColumns({c: F.expr(currency_or_text(f"CAST({c} AS string)")) for c in money})
