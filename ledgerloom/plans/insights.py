"""Combined results: one row per statement, sections as structs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import category_rank
from ..operators import categories, quality, recurring, spending, summary
from ..operators.flows import GRAIN, flows, rollup
from ..operators.summary import percent_of
from ..operators.typing import report_ledger
from ..rules import EXPENSE_RULES
from ..schemas import KEY, ZERO
from ..session import reliable_checkpoint
from .process import Statements


_RATIO = "coalesce(CAST(total_emi AS double), 0D) / average_monthly_income * 100"
METRICS = [
    "total_credit - total_debit AS net_cashflow",
    f"{percent_of('total_debit', 'total_credit')} AS expense_ratio",
    f"{percent_of('(total_credit - total_debit)', 'total_credit')} AS savings_rate",
    f"CASE WHEN average_monthly_income > 0 THEN {_RATIO} END AS emi_to_income_ratio",
]


def financial_metrics(totals: DataFrame, income: DataFrame, emis: DataFrame) -> DataFrame:
    """Cash flow and ratios from the summary, the income summary and the recurring totals.

    The instalment ratio is NULL without a positive mean monthly income.
    """
    return (
        totals.select(KEY, "total_credit", "total_debit")
        .join(income.select(KEY, "average_monthly_income"), KEY, "left")
        .join(emis.select(KEY, "total_emi"), KEY, "left")
        .selectExpr(KEY, *METRICS)
    )


def _listed(df: DataFrame, name: str, order: str, fields: list[str]) -> DataFrame:
    """The rows of a section, to be gathered as an array sorted by the ``order`` expressions.

    Only sections with few rows per statement come here: months, weekdays,
    categories, accepted recurring amounts and top lists.
    """
    return df.selectExpr(KEY, f"struct({order}, struct({', '.join(fields)}) AS item) AS {name}")


def _section(df: DataFrame, name: str) -> DataFrame:
    """A section of one row per statement."""
    return df.select(KEY, F.struct(*[c for c in df.columns if c != KEY]).alias(name))


def _gather(listed: list[DataFrame], single: list[DataFrame] = (), others: list[DataFrame] = (), figures: list[str] = ()) -> DataFrame:
    """All sections of a statement in one row: a union of their rows and one aggregation.

    Every row fills the column of its own section and leaves the others NULL, which
    aggregates pass over; ``figures`` are aggregates over the columns of ``others``.
    """
    lists = [df.columns[-1] for df in listed]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [*listed, *single, *others])
    gathered = rows.groupBy(KEY).agg(
        *[F.expr(f"array_sort(collect_list({name})).item AS {name}") for name in lists],
        *[F.first(df.columns[-1], ignorenulls=True).alias(df.columns[-1]) for df in single],
        *map(F.expr, figures),
    )
    return gathered.withColumns({name: F.expr(f"CASE WHEN size({name}) > 0 THEN {name} END") for name in lists})


def _names(aggregates: list[str]) -> list[str]:
    return [a.rsplit(" AS ", 1)[1] for a in aggregates]


ACCOUNT = ["account_number", "ifsc_code", "period_from", "period_to", "customer_name"]


def _insight_rows(ledger: DataFrame, metadata: DataFrame | None, details: list[DataFrame], checked: list[DataFrame]) -> DataFrame:
    """The sections of the first report, one row per statement.

    The ledger is rolled up once to (day, category, source) and from there to months;
    every summary reads one of the two rollups, written to the checkpoint folder.
    """
    flow = reliable_checkpoint(rollup(flows(ledger), *GRAIN))
    months = reliable_checkpoint(rollup(flow, "month"))  # small: all figures by month read it
    monthly = summary.monthly_summary(months)
    surplus = summary.monthly_balance_surplus(months)
    expenses = categories.expense_totals(flow).withColumn("rule_order", F.expr(category_rank("category", EXPENSE_RULES)))
    emis = reliable_checkpoint(recurring.recurring_payments(ledger))  # small: accepted amounts only
    unusual = reliable_checkpoint(spending.unusual_transactions(ledger))
    emi_fields = [c for c in emis.columns if c not in (KEY, "row_no")]
    single = [_section(spending.large_transactions(ledger), "large_transactions"), *checked]
    if metadata is not None:
        single.append(_section(metadata.select(KEY, *ACCOUNT, "opening_balance", "closing_balance"), "found"))
    found = _gather(
        [
            _listed(monthly, "monthly_summary", "month", [c for c in monthly.columns if c != KEY]),
            _listed(surplus, "monthly_surplus", "month", [c for c in surplus.columns if c != KEY]),
            _listed(expenses, "expense_categories", "-amount AS less, rule_order", ["category", "amount"]),
            _listed(spending.monthly_spending(months), "monthly_spending", "month", ["month", "amount"]),
            _listed(spending.weekday_spending(flow), "day_of_week_spending", "day_of_week", ["day_of_week", "amount"]),
            _listed(categories.monthly_income(months), "monthly_income", "month", ["month", "income"]),
            _listed(categories.income_sources(flow), "income_sources", "rule_order", ["source", "amount"]),
            _listed(emis, "emis", "-amount AS less, row_no", emi_fields),
            _listed(
                spending.largest_unusual(unusual), "unusual_transactions", "position", ["amount", "deviation_factor", "description", "date"]
            ),
            *details,
        ],
        single,
        [months, emis.selectExpr(KEY, "amount AS emi"), unusual.selectExpr(KEY, "1L AS odd")],
        [
            *summary.TOTALS, *categories.INCOME, *spending.MONTHS,
            "sum(emi) AS total_emi", "count(emi) AS emi_count", "count(odd) AS unusual_count",
        ],
    )
    # statements without a row in the ledger have no report
    found = found.where("total_transactions IS NOT NULL")
    if metadata is None:
        kind = ", ".join(f"{f}: string" for f in ACCOUNT)
        found = found.withColumn("account_info", F.expr(f"CAST(NULL AS struct<{kind}>)"))
    else:
        info = f"CASE WHEN found IS NOT NULL THEN struct({', '.join(f'found.{f}' for f in ACCOUNT)}) END"
        found = found.withColumns(
            {"account_info": F.expr(info), **{c: F.col(f"found.{c}") for c in ("opening_balance", "closing_balance")}}
        )
    return found


def _insights(found: DataFrame, metadata: bool, *more: str) -> DataFrame:
    totals = [f"coalesce({c}, {ZERO}) AS {c}" if c.endswith("_balance") else c for c in _names(summary.TOTALS)]
    known = ["opening_balance", "closing_balance"]
    if not metadata:
        known = [f"coalesce({c}, {ZERO})" for c in known]
    return found.selectExpr(
        KEY,
        f"named_struct('account_info', account_info, 'opening_balance', {known[0]}, 'closing_balance', {known[1]}) AS account_summary",
        f"struct({', '.join(totals)}) AS transaction_summary",
        f"struct({', '.join(METRICS)}) AS financial_metrics",
        "struct(monthly_summary, monthly_surplus) AS monthly_analysis",
        "struct(expense_categories, slice(expense_categories, 1, 5) AS top_expenses, monthly_spending,"
        f" CASE WHEN size(months) > 0 THEN struct({', '.join(spending.STATS)}) END AS monthly_spending_stats,"
        " day_of_week_spending, large_transactions) AS spending_analysis",
        "struct(total_income, average_monthly_income, monthly_income, income_sources) AS income_analysis",
        "struct(emis, coalesce(total_emi, 0) AS total_emi, emi_count) AS emi_analysis",
        "struct(unusual_transactions, unusual_count) AS alerts",
        *more,
    )


def comprehensive_insights(ledger: DataFrame, metadata: DataFrame | None = None) -> DataFrame:
    """All analyses of the first report, one row per statement."""
    return _insights(_insight_rows(ledger, metadata, [], []), metadata is not None)


def analyze(statements: Statements) -> DataFrame:
    """Insights and data quality of processed statements."""
    columns = reliable_checkpoint(quality.column_quality(statements.ledger, statements.raw, statements.layouts))
    details = _listed(columns, "columns", "column", ["column", "data_type", "missing_count", "missing_percentage"])
    score = _section(quality.quality_score(columns), "score")
    found = _insight_rows(statements.ledger, statements.metadata, [details], [score])
    return _insights(found, True, "CASE WHEN score IS NOT NULL THEN struct(score.*, columns) END AS data_quality")


def comprehensive_report(report: DataFrame) -> DataFrame:
    """All analyses of the second report, one row per statement."""
    brief = reliable_checkpoint(summary.report_rollup(report))  # one pass over the rows for all but the payments
    surplus = reliable_checkpoint(summary.monthly_surplus(brief))
    shares = reliable_checkpoint(categories.report_expense_categories(brief))
    emis = reliable_checkpoint(recurring.report_recurring_payments(report))
    emi_fields = [c for c in emis.columns if c not in (KEY, "row_no")]
    found = _gather(
        [
            _listed(surplus, "monthly_expenses", "month", ["month", "expenses"]),
            _listed(shares, "expense_categories", "rule_order", ["category", "amount"]),
            _listed(surplus, "monthly_surplus", "month", [c for c in surplus.columns if c != KEY]),
            _listed(emis, "emi_analysis", "-amount AS less, row_no", emi_fields),
        ],
        [
            _section(summary.direction_counts(brief), "transaction_counts"),
            _section(summary.end_balance(brief), "end"),
            _section(shares.where("position = 1").select(KEY, "category", "amount", "percentage"), "largest"),
            _section(summary.overall_summary(surplus), "summary"),
        ],
    )
    found = found.selectExpr("*", "largest.category", "largest.amount", "largest.percentage")
    return found.selectExpr(
        KEY, "transaction_counts", "end.eod_balance", "monthly_expenses", "expense_categories",
        f"struct({', '.join(categories.LARGEST)}) AS most_expense_category", "monthly_surplus", "emi_analysis", "summary",
    )


def analyze_report(statements: Statements) -> DataFrame:
    """The second report on processed statements."""
    return comprehensive_report(report_ledger(statements.ledger, statements.layouts))
