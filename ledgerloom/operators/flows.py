"""Money flows: the additive measures all summaries are built from.

``flows`` turns each ledger row into measures; ``rollup`` adds measures up to any
coarser grain.  Both frames have the same measure columns, so every summary can
read the rows or a rollup of them: a report that needs many summaries reads the
ledger once, rolls it up and works on the much smaller rollup.  A frame without the
other grain columns is the result of ``rollup`` to its grain, and is not added up again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import classify
from ..rules import EXPENSE_RULES, INCOME_RULES, RuleSet
from ..schemas import KEY, ZERO, day_order

SUMS = ["rows", "credit_count", "debit_count", "credit", "debit", "expense", "income"]
GRAIN = ["month", "txn_date", "expense_category", "income_source"]


def flows(
    ledger: DataFrame, expense_rules: RuleSet = EXPENSE_RULES, income_rules: RuleSet = INCOME_RULES
) -> DataFrame:
    """Per ledger row: amounts by direction, categories and the balance with its order."""
    is_expense = "(coalesce(txn_type, 'debit') = 'debit' AND debit > 0 AND description IS NOT NULL)"
    is_income = "(credit > 0 AND description IS NOT NULL)"
    row = "CASE WHEN balance IS NOT NULL THEN row_no END"
    day = f"CASE WHEN balance IS NOT NULL AND txn_date IS NOT NULL THEN {day_order()} END"
    return ledger.selectExpr(
        KEY,
        "month",
        "txn_date",
        f"CASE WHEN {is_expense} THEN {classify('description', expense_rules)} END AS expense_category",
        f"CASE WHEN {is_income} THEN {classify('description', income_rules)} END AS income_source",
        "1L AS rows",
        "CAST(coalesce(txn_type = 'credit', false) AS bigint) AS credit_count",
        "CAST(coalesce(txn_type = 'debit', false) AS bigint) AS debit_count",
        f"coalesce(credit, {ZERO}) AS credit",
        f"coalesce(debit, {ZERO}) AS debit",
        f"CASE WHEN {is_expense} THEN debit ELSE {ZERO} END AS expense",
        f"CASE WHEN {is_income} THEN credit ELSE {ZERO} END AS income",
        "txn_date AS first_date",
        "txn_date AS last_date",
        f"{row} AS first_row",
        f"{row} AS last_row",
        "balance AS first_row_balance",
        "balance AS last_row_balance",
        f"{day} AS first_day",
        f"{day} AS last_day",
        "balance AS first_day_balance",
        "balance AS last_day_balance",
    )


MEASURES = [
    *[f"sum({c}) AS {c}" for c in SUMS],
    "min(first_date) AS first_date",
    "max(last_date) AS last_date",
]
for order in ("row", "day"):
    MEASURES += [
        f"min(first_{order}) AS first_{order}",
        f"max(last_{order}) AS last_{order}",
        f"min_by(first_{order}_balance, first_{order}) AS first_{order}_balance",
        f"max_by(last_{order}_balance, last_{order}) AS last_{order}_balance",
    ]


def rollup(flow: DataFrame, *grain: str) -> DataFrame:
    """Measures per statement and ``grain`` columns."""
    if [c for c in GRAIN if c in flow.columns] == list(grain):
        return flow
    return flow.groupBy(KEY, *grain).agg(*[F.expr(m) for m in MEASURES])
