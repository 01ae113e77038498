"""The registered queries: every operator over whole tables.

Results use plain types: money as double with 2 decimals, ratios with 6.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import session
from ..functions import text
from ..operators import categories, grid, metadata, quality, recurring, spending, summary, typing
from ..operators.flows import flows
from ..plans import insights, process, report
from ..rules import EXPENSE_RULES
from ..schemas import KEY, MONEY
from ..sources.grids import concat_pages, from_frame, number_page_rows, read_grids, read_ledger
from ..sources.sinks import write_grid, write_grid_csv, write_ledger, write_report, write_workbook
from . import adapters

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def plain(df: DataFrame) -> DataFrame:
    """Decimals and doubles rounded to what is compared."""
    out = []
    for name, kind in df.dtypes:
        if kind.startswith("decimal"):
            out.append(f"round(CAST({name} AS double), 2) AS {name}")
        elif kind == "double":
            out.append(f"round({name}, 6) AS {name}")
        else:
            out.append(name)
    return df.selectExpr(*out)


def query(build: Query) -> Query:
    @wraps(build)
    def run(spark: SparkSession, folder: str) -> DataFrame:
        session.tune(spark)
        return plain(build(spark, folder))

    QUERIES[build.__name__] = run
    return run


def _flow(spark, folder):
    return flows(adapters.order_ledger(spark, folder))


def _report(spark, folder):
    return typing.report_ledger(adapters.order_ledger(spark, folder))


def _stored_report(spark, folder):
    return typing.report_ledger(adapters.stored_ledger(spark, folder))


# ---- ledger ----


@query
def typed_ledger(spark, folder):
    return adapters.order_ledger(spark, folder).select(
        KEY, "row_no", "txn_date", "month", "description", "debit", "credit", "balance", "txn_type", "transaction_amount"
    )


@query
def report_ledger(spark, folder):
    return _report(spark, folder).drop("has_date")


@query
def display_ledger(spark, folder):
    shown = report.display_ledger(adapters.order_ledger(spark, folder))
    return shown.selectExpr(
        KEY, "row_no", "debit", "credit", "balance", "amount", f"{text.shorten('description', 12)} AS short_text"
    )


# ---- summaries ----


@query
def transaction_summary(spark, folder):
    return summary.transaction_summary(_flow(spark, folder))


@query
def monthly_summary(spark, folder):
    return summary.monthly_summary(_flow(spark, folder))


@query
def monthly_balance_surplus(spark, folder):
    return summary.monthly_balance_surplus(_flow(spark, folder))


@query
def direction_counts(spark, folder):
    return summary.direction_counts(_report(spark, folder))


@query
def end_balance(spark, folder):
    return summary.end_balance(_report(spark, folder))


@query
def monthly_expenses(spark, folder):
    return summary.monthly_expenses(_report(spark, folder))


@query
def undated_expenses(spark, folder):
    """Every second statement has no date column: its expenses are one total."""
    odd = f"CAST({KEY} AS bigint) % 2 = 1"
    ledger = adapters.order_ledger(spark, folder)
    ledger = ledger.withColumns({"txn_date": F.expr(f"CASE WHEN NOT {odd} THEN txn_date END"), "month": F.expr(f"CASE WHEN NOT {odd} THEN month END")})
    layouts = ledger.select(KEY).distinct().withColumn("col_map", F.expr(f"CASE WHEN {odd} THEN map('debit', 1) ELSE map('date', 0) END"))
    return summary.monthly_expenses(typing.report_ledger(ledger, layouts))


@query
def monthly_surplus(spark, folder):
    return summary.monthly_surplus(_report(spark, folder))


@query
def overall_summary(spark, folder):
    return summary.overall_summary(summary.monthly_surplus(_report(spark, folder)))


# ---- categories and income ----


@query
def expense_categories(spark, folder):
    return categories.expense_categories(_flow(spark, folder))


@query
def top_expenses(spark, folder):
    return categories.top_expenses(_flow(spark, folder))


@query
def report_expense_categories(spark, folder):
    return categories.report_expense_categories(_report(spark, folder)).drop("rule_order")


@query
def largest_category(spark, folder):
    return categories.largest_category(_stored_report(spark, folder))


@query
def categories_by_table(spark, folder):
    """The first report's rules as a table, applied by joins."""
    spent = adapters.order_ledger(spark, folder).where("txn_type = 'debit' AND debit > 0")
    named = categories.classify_by_table(spent, EXPENSE_RULES.to_frame(spark), EXPENSE_RULES.default)
    return named.groupBy(KEY, "category").agg(F.sum("debit").alias("amount"))


@query
def income_summary(spark, folder):
    return categories.income_summary(_flow(spark, folder))


@query
def monthly_income(spark, folder):
    return categories.monthly_income(_flow(spark, folder))


@query
def income_sources(spark, folder):
    return categories.income_sources(_flow(spark, folder)).drop("rule_order")


# ---- spending ----


@query
def monthly_spending_stats(spark, folder):
    return spending.monthly_spending_stats(_flow(spark, folder))


@query
def weekday_spending(spark, folder):
    return spending.weekday_spending(_flow(spark, folder))


@query
def large_transactions(spark, folder):
    return spending.large_transactions(adapters.stored_ledger(spark, folder))


@query
def sketched_large_transactions(spark, folder):
    """The large debits from sketches kept by day, and how far their rank is from the exact one."""
    ledger = adapters.stored_ledger(spark, folder)
    days = session.reliable_checkpoint(spending.debit_sketch(ledger, "txn_date"))
    exact = spending.large_transactions(ledger).select(KEY, F.col("count").alias("exact_count"))
    return (
        spending.sketched_large_transactions(days)
        .join(exact, KEY)
        .selectExpr(
            KEY,
            "round(threshold, 6) AS threshold",
            "count",
            "CAST(round(total_amount, 2) AS double) AS total_amount",
            "round(abs(count - exact_count) / all_n, 9) AS rank_error",
        )
    )


@query
def unusual_transactions(spark, folder):
    return spending.unusual_transactions(adapters.event_ledger(spark, folder))


@query
def top_unusual_transactions(spark, folder):
    unusual = spending.unusual_transactions(adapters.event_ledger(spark, folder), 1.0)
    return spending.top_unusual(unusual)


# ---- recurring payments ----


@query
def recurring_payments(spark, folder):
    return recurring.recurring_payments(adapters.stored_ledger(spark, folder))


@query
def recurring_payments_events(spark, folder):
    ledger = adapters.event_ledger(spark, folder)
    return recurring.recurring_payments(ledger, min_amount=20, min_occurrences=2, amount_tolerance=0.02)


@query
def report_recurring_payments(spark, folder):
    return recurring.report_recurring_payments(_stored_report(spark, folder))


@query
def recurring_totals(spark, folder):
    return recurring.recurring_totals(recurring.recurring_payments(adapters.stored_ledger(spark, folder)))


@query
def recurring_members(spark, folder):
    """Every payment behind the recurring amounts, with the days since the one before."""
    ledger = adapters.stored_ledger(spark, folder)
    payments = ledger.where("txn_type = 'debit' AND debit >= 1000 AND description IS NOT NULL")
    return recurring.recurring_members(payments, recurring.recurring_payments(ledger))


@query
def payment_gaps(spark, folder):
    return recurring.payment_gaps(adapters.event_payments(spark, folder), "ts")


@query
def financial_metrics(spark, folder):
    ledger = adapters.stored_ledger(spark, folder)
    flow = flows(ledger)
    return insights.financial_metrics(
        summary.transaction_summary(flow),
        categories.income_summary(flow),
        recurring.recurring_totals(recurring.recurring_payments(ledger)),
    )


# ---- grids: header search, mapping, typing, metadata ----


@query
def header_rows(spark, folder):
    return grid.detect_headers(adapters.order_grid(spark, folder)).select(KEY, "header_row_no", "n_cols")


@query
def odd_headers(spark, folder):
    """Repeated names, a header found by one word, and no header at all."""
    named = grid.name_columns(grid.detect_headers(adapters.odd_grid(spark, folder)))
    return named.selectExpr(KEY, "header_row_no", "array_join(header, '|') AS header")


@query
def layout_names(spark, folder):
    layouts = grid.detect_layouts(adapters.order_grid(spark, folder))
    return layouts.selectExpr(KEY, "array_join(header, '|') AS header", "array_join(names, '|') AS names")


@query
def column_profile(spark, folder):
    raw = adapters.order_grid(spark, folder)
    return grid.profile_columns(raw, grid.name_columns(grid.detect_headers(raw)))


@query
def transaction_rows(spark, folder):
    raw = adapters.order_grid(spark, folder)
    named = grid.name_columns(grid.detect_headers(raw))
    return grid.transaction_rows(raw, named).selectExpr(KEY, "row_no", "array_join(cells, '|', '') AS line")


@query
def grid_ledger(spark, folder):
    raw = adapters.order_grid(spark, folder)
    ledger = typing.build_ledger(raw, grid.detect_layouts(raw))
    return ledger.select(
        KEY, "row_no", "txn_date", "month", "description", "debit", "credit", "amount", "balance",
        "dr_cr_indicator", "txn_type", "transaction_amount",
    )


@query
def inferred_dates(spark, folder):
    """Day-first, month-first and year-first statements, read without being told which is which."""
    raw = adapters.mixed_date_grid(spark, folder)
    layouts = typing.infer_date_formats(raw, grid.detect_layouts(raw))
    return typing.build_ledger(raw, layouts).select(KEY, "row_no", "txn_date")


@query
def rejected_cells(spark, folder):
    """The cells of a ledger's typed columns that cannot be read, and why."""
    return process.process(adapters.flawed_grid(spark, folder)).rejects


@query
def flawed_ledger(spark, folder):
    """A ledger of the same cells: what cannot be read counts as 0 or as no date, and ends no job."""
    return process.process(adapters.flawed_grid(spark, folder)).ledger.select(KEY, "row_no", "txn_date", "debit", "credit")


@query
def grid_column_types(spark, folder):
    """Types of all columns, those without a standard name by their cells."""
    done = process.process(adapters.flawed_grid(spark, folder))
    return quality.column_quality(done.ledger, done.raw, done.layouts)


@query
def unnamed_report(spark, folder):
    """The second report's ledger where date and text stand in columns of no standard name."""
    done = process.process(adapters.unnamed_grid(spark, folder))
    return typing.report_ledger(done.ledger, done.layouts).drop("has_date")


@query
def grid_metadata(spark, folder):
    return process.process(adapters.order_grid(spark, folder)).metadata


@query
def document_accounts(spark, folder):
    return metadata.account_metadata(adapters.document_lines(spark, folder))


@query
def frame_layouts(spark, folder):
    orders = adapters.table(spark, folder, "orders")
    key = F.expr("cast(o_custkey div 150 as string)")
    raw = from_frame(
        orders, key, "o_orderkey", ["o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]
    )
    return grid.detect_layouts(raw).selectExpr(KEY, "header_row_no", "array_join(names, '|') AS names")


@query
def page_rows(spark, folder):
    pages = concat_pages(adapters.order_pages(spark, folder))
    stacked = pages.selectExpr(KEY, "page_no", "page_row", "array(c0, c1) AS cells")
    return number_page_rows(stacked).selectExpr(KEY, "row_no", "array_join(cells, '|', '') AS line")


@query
def clean_amounts(spark, folder):
    grouped = f"format_number(CAST(l_extendedprice AS {MONEY}), 2)"
    cell = f"concat('INR ', {grouped}, CASE WHEN l_returnflag = 'R' THEN ' Dr' ELSE ' Cr' END)"
    return adapters.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey",
        "l_linenumber",
        f"{text.clean_amount(cell)} AS cleaned",
        f"coalesce({text.to_number(grouped)}, 0) AS coerced",
    )


@query
def parsed_dates(spark, folder):
    formats = ["dd/MM/yyyy", "d-M-yyyy", "yyyy-MM-dd", "dd-MMM-yyyy", "dd.MM.yyyy 10:30:00", "MM/dd/yyyy"]
    shown = " ".join(
        f"WHEN {i} THEN date_format(l_shipdate, {text.lit(f.replace('10:30:00', 'HH:mm:ss'))})"
        for i, f in enumerate(formats)
    )
    cell = f"CASE l_orderkey % {len(formats)} {shown} END"
    return adapters.table(spark, folder, "lineitem").selectExpr(
        "l_orderkey", "l_linenumber", f"{text.parse_date(cell)} AS parsed"
    )


@query
def amount_splits(spark, folder):
    mark_debit, mark_credit = typing.split_by_indicator("amount", "mark")
    prefix_debit, prefix_credit, prefix_label = typing.split_by_prefix("amount", "trim(mark)")
    sign_debit, sign_credit, sign_label = typing.split_by_sign("amount")
    merged_amount, merged_label = typing.merge_columns("sign_debit", "sign_credit")
    return (
        adapters.table(spark, folder, "orders")
        .selectExpr(
            "o_orderkey",
            f"CAST(o_totalprice - 100000 AS {MONEY}) AS amount",
            "CASE o_orderstatus WHEN 'F' THEN ' dr' WHEN 'O' THEN 'Credit' ELSE '?' END AS mark",
        )
        .selectExpr(
            "o_orderkey",
            f"{mark_debit} AS mark_debit",
            f"{mark_credit} AS mark_credit",
            f"{prefix_debit} AS prefix_debit",
            f"{prefix_credit} AS prefix_credit",
            f"{prefix_label} AS prefix_label",
            f"{sign_debit} AS sign_debit",
            f"{sign_credit} AS sign_credit",
            f"{sign_label} AS sign_label",
        )
        .selectExpr(
            "*",
            f"{typing.transaction_type('mark_debit', 'mark_credit')} AS mark_type",
            f"{merged_amount} AS merged_amount",
            f"{merged_label} AS merged_label",
        )
    )


# ---- ready-made tables ----


@query
def table_mapping(spark, folder):
    _, tables = adapters.order_tables(spark, folder)
    return grid.map_by_name(tables).drop("header")


@query
def table_ledger(spark, folder):
    rows, tables = adapters.order_tables(spark, folder)
    return typing.report_ledger_from_table(session.reliable_checkpoint(rows), tables).drop("has_date")


@query
def table_rejects(spark, folder):
    """Number and date cells of ready-made tables that cannot be read: here amounts with thousand separators and unit."""
    rows, tables = adapters.order_tables(spark, folder)
    odd = "transform(cells, (c, i) -> CASE WHEN row_no % 199 = 0 AND i = 4 THEN '1,250.00 Cr' WHEN row_no % 199 = 1 AND i = 4 THEN repeat('9', 30) ELSE c END)"
    rows = rows.withColumn("cells", F.expr(odd)).where("row_no % 199 < 5")
    return typing.rejected_table_cells(rows, typing.table_layouts(rows, tables))


@query
def moneyless_ledger(spark, folder):
    """Tables without any money: every row counts as DR with 0."""
    return typing.report_ledger_from_table(*adapters.moneyless_tables(spark, folder)).drop("has_date")


# ---- written and read back ----


@query
def exported_ledger(spark, folder):
    """A layout with a column of no standard name, through the ledger's file."""
    shown = adapters.order_entries(spark, folder).selectExpr(
        KEY, "row_no", "date_format(txn_date, 'dd/MM/yyyy') AS `Tran Date`", "description AS `Particulars`",
        "debit AS `Debit`", "credit AS `Credit`", "concat('T', row_no % 7) AS `Teller`",
    )
    raw = from_frame(shown, KEY, "row_no")
    path = session.shared_folder(spark) + "/ledger"
    write_ledger(typing.build_ledger(raw, grid.detect_layouts(raw)), path)
    return read_ledger(spark, path).selectExpr(
        KEY, "row_no", "txn_date", "description", "debit", "credit", "element_at(extra, 'teller') AS teller", "size(extra) AS n_extra"
    )


@query
def exported_grid(spark, folder):
    path = session.shared_folder(spark) + "/grid"
    write_grid(adapters.order_grid(spark, folder), path)
    raw = spark.read.parquet(path)
    named = grid.name_columns(grid.detect_headers(raw))
    return grid.transaction_rows(raw, named).selectExpr(KEY, "row_no", "array_join(cells, '|', '') AS line")


@query
def exported_csv(spark, folder):
    """Statements as CSV files, one each, read back line by line."""
    path = session.shared_folder(spark) + "/csv"
    write_grid_csv(adapters.order_grid(spark, folder), path)
    raw = read_grids(spark, f"{path}/*/*").withColumn(KEY, F.regexp_extract(KEY, f"{KEY}=([^/]*)/", 1))
    named = grid.name_columns(grid.detect_headers(raw))
    return grid.transaction_rows(raw, named).selectExpr(KEY, "array_join(cells, '|', '') AS line")


@query
def quoted_line_breaks(spark, folder):
    """Whole texts as cells of CSV files, one file per source, written and read back: most cells hold line breaks."""
    path = session.shared_folder(spark) + "/csv"
    write_grid_csv(adapters.document_cells(spark, folder), path)
    raw = read_grids(spark, f"{path}/*/*", multiline=True)
    return raw.selectExpr(
        f"regexp_extract({KEY}, '{KEY}=([^/]*)/', 1) AS {KEY}",
        "CAST(cells[0] AS bigint) AS doc_id",
        "CAST(length(coalesce(cells[1], '')) AS bigint) AS n_chars",
        "md5(coalesce(cells[1], '')) AS text_md5",
    )


def _workbook(spark, folder, dataset):
    """One of the workbook's three datasets, as written and read back."""
    ledger, path = adapters.order_ledger(spark, folder), session.shared_folder(spark) + "/book"
    flow = flows(ledger)
    write_workbook(ledger, summary.transaction_summary(flow), summary.monthly_summary(flow), path)
    return spark.read.parquet(f"{path}/{dataset}")


@query
def exported_workbook(spark, folder):
    return _workbook(spark, folder, "monthly_summary")


@query
def workbook_summary(spark, folder):
    return _workbook(spark, folder, "summary")


@query
def workbook_transactions(spark, folder):
    return _workbook(spark, folder, "transactions").select(
        KEY, "row_no", "txn_date", "month", "description", "debit", "credit", "balance", "txn_type", "transaction_amount"
    )


@query
def exported_report(spark, folder):
    """The text report through its files: lines by statement, in their order within a file."""
    path = session.shared_folder(spark) + "/text"
    write_report(report.report_lines(insights.comprehensive_report(_stored_report(spark, folder))), path, buckets=8)
    return spark.read.text(path).selectExpr(f"split(value, '\t', 2)[0] AS {KEY}", "split(value, '\t', 2)[1] AS text")


# ---- quality ----


@query
def column_quality(spark, folder):
    return quality.column_quality(adapters.order_ledger(spark, folder))


@query
def grid_quality(spark, folder):
    done = process.process(adapters.order_grid(spark, folder), materialize=True)
    return quality.quality_score(quality.column_quality(done.ledger, done.raw, done.layouts))


# ---- reports and chart tables ----


@query
def insights_overview(spark, folder):
    wide = insights.comprehensive_insights(adapters.stored_ledger(spark, folder))
    return wide.selectExpr(
        KEY,
        "transaction_summary.total_transactions",
        "transaction_summary.opening_balance",
        "financial_metrics.net_cashflow",
        "financial_metrics.savings_rate",
        "financial_metrics.emi_to_income_ratio",
        "size(monthly_analysis.monthly_summary) AS months",
        "array_join(spending_analysis.top_expenses.category, '|') AS top_expenses",
        "spending_analysis.monthly_spending_stats.highest_month",
        "spending_analysis.large_transactions.count AS large_count",
        "size(spending_analysis.day_of_week_spending) AS weekdays",
        "array_join(income_analysis.income_sources.source, '|') AS income_sources",
        "emi_analysis.total_emi",
        "emi_analysis.emi_count",
        "alerts.unusual_count",
    )


def _cents(x: str) -> str:
    return f"CAST({x} * 100 AS bigint)"


def _lines(items: str, *fields: str) -> str:
    """The items of a section as text, in their order."""
    return f"array_join(transform({items}, x -> concat_ws(' ', {', '.join(fields)})), '|')"


@query
def insights_sections(spark, folder):
    """What the sections of the first report hold, in order."""
    wide = insights.comprehensive_insights(adapters.stored_ledger(spark, folder))
    months = _lines(
        "monthly_analysis.monthly_summary", "x.month", "x.credit_count", "x.debit_count", _cents("x.total_credit"), _cents("x.total_debit"),
        _cents("x.opening_balance"), _cents("x.closing_balance"),
    )
    return wide.selectExpr(
        KEY,
        f"{months} AS months",
        f"{_lines('monthly_analysis.monthly_surplus', 'x.month', _cents('x.surplus'))} AS surplus",
        f"{_lines('spending_analysis.expense_categories', 'x.category', _cents('x.amount'))} AS categories",
        f"{_lines('spending_analysis.day_of_week_spending', 'x.day_of_week', _cents('x.amount'))} AS weekdays",
        f"{_lines('income_analysis.income_sources', 'x.source', _cents('x.amount'))} AS sources",
        f"{_lines('emi_analysis.emis', _cents('x.amount'), 'x.frequency', 'x.occurrences', 'x.first_date', 'x.last_date')} AS emis",
    )


@query
def report_sections(spark, folder):
    """What the sections of the second report hold, in order."""
    wide = insights.comprehensive_report(_stored_report(spark, folder))
    return wide.selectExpr(
        KEY,
        f"{_lines('monthly_surplus', 'x.month', _cents('x.income'), _cents('x.expenses'))} AS months",
        f"{_lines('expense_categories', 'x.category', _cents('x.amount'))} AS categories",
        f"{_lines('emi_analysis', _cents('x.amount'), 'x.frequency', 'x.confidence', _cents('x.total_paid'))} AS emis",
    )


@query
def analysis_overview(spark, folder):
    done = process.process(adapters.order_grid(spark, folder), materialize=True)
    wide = insights.analyze(done)
    return wide.select(
        KEY,
        "account_summary.account_info.account_number",
        "account_summary.opening_balance",
        "transaction_summary.total_transactions",
        "transaction_summary.total_debit",
        "emi_analysis.emi_count",
        "data_quality.quality_score",
        "data_quality.column_count",
    )


@query
def report_overview(spark, folder):
    wide = insights.comprehensive_report(_stored_report(spark, folder))
    return wide.selectExpr(
        KEY,
        "transaction_counts.credit_transactions",
        "eod_balance",
        "size(monthly_expenses) AS months",
        "array_join(expense_categories.category, '|') AS categories",
        "most_expense_category.category",
        "size(emi_analysis) AS emi_count",
        "summary.net_surplus",
        "summary.overall_savings_rate",
    )


@query
def text_report(spark, folder):
    return report.report_lines(insights.comprehensive_report(_stored_report(spark, folder)))


@query
def chart_monthly_table(spark, folder):
    return report.monthly_table(_flow(spark, folder))


@query
def chart_income_versus_expenses(spark, folder):
    return report.income_versus_expenses(_flow(spark, folder))


@query
def chart_category_shares(spark, folder):
    return report.category_shares(_report(spark, folder))
