"""Bank-statement analytics on Spark: raw table cells to ledgers, summaries and reports."""

from .operators.categories import (
    classify_by_table,
    expense_categories,
    income_sources,
    income_summary,
    largest_category,
    monthly_income,
    report_expense_categories,
    top_expenses,
)
from .operators.flows import flows, rollup
from .operators.grid import detect_layouts, map_by_name
from .operators.metadata import account_metadata, statement_metadata, text_balances
from .operators.quality import column_quality, quality_score
from .operators.recurring import (
    payment_gaps,
    recurring_members,
    recurring_payments,
    recurring_totals,
    report_recurring_payments,
)
from .operators.spending import (
    debit_sketch,
    large_transactions,
    monthly_spending,
    monthly_spending_stats,
    sketched_large_transactions,
    top_unusual,
    unusual_transactions,
    weekday_spending,
)
from .operators.summary import (
    direction_counts,
    end_balance,
    monthly_balance_surplus,
    monthly_expenses,
    monthly_summary,
    monthly_surplus,
    overall_summary,
    transaction_summary,
)
from .operators.typing import (
    build_ledger,
    finish_ledger,
    infer_date_formats,
    rejected_cells,
    rejected_table_cells,
    report_ledger,
    report_ledger_from_table,
    table_layouts,
)
from .plans.insights import (
    analyze,
    analyze_report,
    comprehensive_insights,
    comprehensive_report,
    financial_metrics,
)
from .plans.process import Statements, process
from .plans.report import (
    category_shares,
    display_ledger,
    income_versus_expenses,
    monthly_table,
    report_lines,
)
from .session import local_session, tune
from .sources.grids import concat_pages, from_frame, number_page_rows, read_grids, read_ledger, read_tables
from .sources.sinks import write_grid, write_grid_csv, write_ledger, write_report, write_workbook

__all__ = [name for name in dir() if not name.startswith("_")]
