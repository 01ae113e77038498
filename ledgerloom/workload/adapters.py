"""Ledgers, grids and tables derived from the benchmark's own tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lit
from ..operators.typing import finish_ledger
from ..schemas import KEY, MONEY
from ..session import reliable_checkpoint
from ..sources.grids import from_frame

DESCRIPTIONS = (
    "SALARY ACME CORP, HOME LOAN EMI, UPI SWIGGY ORDER, AMAZON MARKETPLACE, UBER TRIP INVOICE, "
    "ELECTRICITY BILL, NETFLIX, DMART GROCERY, OYO STAY, APOLLO PHARMACY, SCHOOL FEES, "
    "MUTUAL FUND SIP, ATM CWDR, NEFT VENDOR, SB INTEREST, DIVIDEND, REFUND, CHQ CLG, GST CHARGE, XYZZY"
).split(", ")

STATEMENT_CUSTOMERS = 150
FIRST_ROW = 5  # grid rows before the transactions
LAST_ROW = 1 << 40


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _money(cents: str) -> str:
    return f"CAST(CAST({cents} AS decimal(17,0)) * 0.01BD AS {MONEY})"


def order_entries(spark: SparkSession, folder: str) -> DataFrame:
    """Orders as account entries; cents are whole numbers, so no rounding rule matters."""
    texts = ", ".join(lit(d) for d in DESCRIPTIONS)
    return (
        table(spark, folder, "orders")
        .selectExpr(
            "*",
            "CASE WHEN o_orderkey % 101 = 0 THEN 0 "
            "ELSE (CAST(round(o_totalprice * 100) AS bigint) + 50) div 100 END AS used",
        )
        .selectExpr(
            f"CAST(o_custkey div {STATEMENT_CUSTOMERS} AS string) AS {KEY}",
            "o_orderkey AS row_no",
            "CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS date) END AS txn_date",
            f"get(array({texts}), CAST(o_orderkey % 20 AS int)) AS description",
            f"{_money('''CASE WHEN o_orderstatus IN ('F', 'P') THEN used ELSE 0 END''')} AS debit",
            f"{_money('''CASE WHEN o_orderstatus = 'O' THEN used ELSE 0 END''')} AS credit",
            f"{_money('CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 7919) % 1000000 END')} AS balance",
        )
    )


def order_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A typed ledger: one statement per 150 customers, one row per order."""
    return finish_ledger(order_entries(spark, folder))


def event_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """A ledger of skewed amounts: one statement per user, one row per event."""
    value = _money("CAST(round(value * 100) AS bigint)")
    nothing = _money("0")
    return finish_ledger(
        table(spark, folder, "events").selectExpr(
            f"CAST(user_id AS string) AS {KEY}",
            "event_id AS row_no",
            "CAST(ts AS date) AS txn_date",
            "event_type AS description",
            f"CASE WHEN event_type = 'purchase' THEN {nothing} ELSE {value} END AS debit",
            f"CASE WHEN event_type = 'purchase' THEN {value} ELSE {nothing} END AS credit",
        )
    )


def event_payments(spark: SparkSession, folder: str) -> DataFrame:
    """Event payments with their time of day, in whole currency units."""
    return table(spark, folder, "events").selectExpr(
        f"CAST(user_id AS string) AS {KEY}", "ts", f"CAST(floor(value) AS {MONEY}) AS debit"
    )


# ---- raw grids: the order ledger written out as the cells of three statement layouts ----


def _cells(*cells: str) -> str:
    return f"array({', '.join(cells)})"


def _by_layout(*choices: str) -> str:
    return (
        f"CASE CAST({KEY} AS bigint) % 3 WHEN 0 THEN {choices[0]} WHEN 1 THEN {choices[1]} ELSE {choices[2]} END"
    )


def _grid_entries(entries: DataFrame) -> DataFrame:
    """The transaction rows of every statement as text cells."""
    spent = "CASE WHEN debit > 0 THEN format_number(debit, 2) END"
    earned = "CASE WHEN credit > 0 THEN concat(format_number(credit, 2), ' Cr') END"
    either = "CASE WHEN debit + credit > 0 THEN format_number(debit + credit, 2) END"
    mark = "CASE WHEN debit > 0 THEN 'DR' WHEN credit > 0 THEN 'CR' END"
    left = "format_number(balance, 2)"
    return entries.selectExpr(
        KEY,
        f"row_no + {FIRST_ROW} AS row_no",
        _by_layout(
            _cells("date_format(txn_date, 'dd-MM-yyyy')", "description", spent, earned, left),
            _cells("date_format(txn_date, 'dd/MM/yyyy')", "description", either, mark, left),
            _cells("description", "date_format(txn_date, 'yyyy-MM-dd')", earned, spent, f"concat({left}, ' Dr')"),
        )
        + " AS cells",
    )


def _grid_frame(entries: DataFrame) -> DataFrame:
    """Account lines, header row and footers of every statement."""
    header = _by_layout(
        _cells("'Tran Date'", "'Particulars'", "'Debit'", "'Credit'", "'Balance'"),
        _cells("'Value Date'", "'Narration'", "'Amount(INR)'", "'DR/CR'", "'Balance(INR)'"),
        _cells("'Description'", "'Booked On'", "'Deposit Money'", "'Withdrawal Money'", "'Running Balance Amount'"),
    )
    holder = f"concat('Customer Name : HOLDER ', translate({KEY}, '0123456789', 'ABCDEFGHIJ'), '.')"
    account = f"concat('Account No : ', lpad({KEY}, 12, '7'))"
    bank = f"concat('IFSC Code : ABCD', lpad({KEY}, 7, '0'))"
    period = "concat('Statement From : ', first_day, ' To : ', last_day)"
    lines = {
        0: _cells(holder, "NULL", "NULL", "NULL", "NULL"),
        1: _cells(account, bank, "NULL", "NULL", "NULL"),
        2: _cells(period, "NULL", "NULL", "NULL", "NULL"),
        3: header,
        4: _cells("'OPENING BALANCE'", "NULL", "NULL", "NULL", f"concat({KEY}, ',000.50')"),
        LAST_ROW: _cells("'TRANSACTION TOTAL'", "NULL", "'1.00'", "'2.00'", "NULL"),
        LAST_ROW + 1: _cells("'This is a system generated statement'", "NULL", "NULL", "NULL", "NULL"),
    }
    rows = ", ".join(f"named_struct('row_no', {no}L, 'cells', {cells})" for no, cells in lines.items())
    return (
        entries.groupBy(KEY)
        .agg(
            F.expr("date_format(min(txn_date), 'dd-MM-yyyy') AS first_day"),
            F.expr("date_format(max(txn_date), 'dd-MM-yyyy') AS last_day"),
        )
        .selectExpr(KEY, f"inline(array({rows}))")
    )


def order_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Raw cells of whole statements: account lines, header row, transactions and footers."""
    entries = order_entries(spark, folder)
    rows = _grid_entries(entries).unionByName(_grid_frame(entries))
    return reliable_checkpoint(rows)


def odd_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Grids whose header repeats a name, is found by one word only, or is missing."""
    entries = order_entries(spark, folder)
    rows = entries.selectExpr(
        KEY,
        f"row_no + {FIRST_ROW} AS row_no",
        _cells("date_format(txn_date, 'dd-MM-yyyy')", "description", "CAST(debit AS string)", "CAST(credit AS string)", "CAST(balance AS string)"),
    ).toDF(KEY, "row_no", "cells")
    repeated = {0: _cells("'Some Bank'", *["NULL"] * 4), 2: _cells("'Tran Date'", "'Particulars'", "'Debit'", "'Debit'", "'Balance'")}
    one_word = {0: _cells("'Hello'", *["NULL"] * 4), 1: _cells("'Booked Date'", "'What'", "'Sum'", "NULL", "' '")}
    lists = [
        "array(" + ", ".join(f"named_struct('row_no', {no}L, 'cells', {cells})" for no, cells in lines.items()) + ")"
        for lines in (repeated, one_word)
    ]
    kind = "array<struct<row_no:bigint,cells:array<string>>>"
    heads = entries.select(KEY).distinct().selectExpr(
        KEY, f"inline({_by_layout(*(f'CAST({x} AS {kind})' for x in lists), f'CAST(array() AS {kind})')})"
    )
    return rows.unionByName(heads)


# Cells no ledger can hold.
LONG_AMOUNT, BAD_AMOUNT, BAD_DATE = "123456789012345678901234567890.55", "1.2.3", "31-31-2024"


def flawed_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Plain statements with columns of no standard name, and now and then an amount or a date that cannot be read."""
    day = f"CASE WHEN row_no % 227 = 0 THEN {lit(BAD_DATE)} ELSE date_format(txn_date, 'dd-MM-yyyy') END"
    spent = f"CASE WHEN row_no % 211 = 0 THEN {lit(LONG_AMOUNT)} WHEN row_no % 223 = 0 THEN {lit(BAD_AMOUNT)} ELSE CAST(debit AS string) END"
    shown = order_entries(spark, folder).selectExpr(
        KEY, "row_no", f"{day} AS `Tran Date`", "description AS `Particulars`", f"{spent} AS `Debit`", "CAST(credit AS string) AS `Credit`",
        "CASE WHEN row_no % 3 > 0 THEN CAST(row_no % 7 AS string) END AS `Teller`",
        "CASE WHEN row_no % 2 = 0 THEN format_number(row_no % 5000 + 0.25, 2) ELSE '12' END AS `Rate`",
        "date_format(date_add(DATE'2024-01-01', CAST(row_no % 90 AS int)), 'dd MMM yyyy') AS `Seen`",
        "CASE WHEN row_no % 5 = 0 THEN '7' ELSE 'x' END AS `Remark Code`",
    )
    return from_frame(shown, KEY, "row_no")


def mixed_date_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Statements that write dates day first, month first, year first, and month first among dates in words."""
    words = "CASE WHEN row_no % 2 = 0 THEN date_format(txn_date, 'dd MMM yyyy') ELSE date_format(txn_date, 'MM/dd/yyyy') END"
    day = f"CASE CAST({KEY} AS bigint) % 4 WHEN 0 THEN date_format(txn_date, 'dd-MM-yyyy') WHEN 1 THEN date_format(txn_date, 'MM-dd-yyyy') WHEN 2 THEN date_format(txn_date, 'yyyy-MM-dd') ELSE {words} END"
    shown = order_entries(spark, folder).selectExpr(
        KEY, "row_no", f"{day} AS `Tran Date`", "description AS `Particulars`", "debit AS `Debit`", "credit AS `Credit`"
    )
    return from_frame(shown, KEY, "row_no")


def unnamed_grid(spark: SparkSession, folder: str) -> DataFrame:
    """Statements whose text columns have no standard name; every second one has dates, in words, among them."""
    posted = f"CASE WHEN CAST({KEY} AS bigint) % 2 = 1 THEN date_format(txn_date, 'dd MMM yyyy') ELSE concat('N', row_no) END"
    shown = order_entries(spark, folder).selectExpr(
        KEY, "row_no", "CAST(row_no AS string) AS `No`", f"{posted} AS `Posted`", "description AS `Payee`", "debit AS `Debit`", "credit AS `Credit`", "balance AS `Balance`"
    )
    return from_frame(shown, KEY, "row_no")


def moneyless_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Ready-made tables with a date and a text, and no money at all."""
    entries = order_entries(spark, folder)
    rows = entries.selectExpr(KEY, "row_no", "array(date_format(txn_date, 'yyyy-MM-dd'), description) AS cells")
    return rows, entries.select(KEY).distinct().selectExpr(KEY, "array('date', 'details') AS header")


def stored_ledger(spark: SparkSession, folder: str) -> DataFrame:
    """The order ledger on shared storage, for analyses that read it more than once."""
    return reliable_checkpoint(finish_ledger(order_entries(spark, folder)))


def order_pages(spark: SparkSession, folder: str) -> list[DataFrame]:
    """The order ledger as page tables of 40 rows; every third page lacks the last column."""
    base = order_entries(spark, folder).selectExpr(
        KEY,
        "row_no div 40 AS page_no",
        "row_no % 40 AS page_row",
        "description AS c0",
        "format_number(debit, 2) AS c1",
    )
    return [base.where("page_no % 3 <> 0"), base.where("page_no % 3 = 0").drop("c1")]


def document_lines(spark: SparkSession, folder: str) -> DataFrame:
    """Whole documents as grids: one row per line of text."""
    return (
        table(spark, folder, "documents")
        .selectExpr(f"CAST(doc_id AS string) AS {KEY}", "posexplode(split(text, '\\n')) AS (row_no, line)")
        .selectExpr(KEY, "CAST(row_no AS bigint) AS row_no", "array(line) AS cells")
    )


def document_cells(spark: SparkSession, folder: str) -> DataFrame:
    """Documents as rows of one grid per source: id and whole text."""
    return table(spark, folder, "documents").selectExpr(
        f"coalesce(source, 'none') AS {KEY}", "CAST(doc_id AS bigint) AS row_no", "array(CAST(doc_id AS string), text) AS cells"
    )


# ---- ready-made tables for the second report, four layouts ----

TABLE_HEADERS = [
    ["Txn_Date", "Narration", "Txn_Amount", "Txn_Type", "Balance"],
    ["date", "details", "debit", "credit", "closing_balance"],
    ["posting_date", "remark", "amount", "ref", "available_balance"],
    ["Posted", "Payee", "Value", "No", "Left"],
]


def order_tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Rows and headers of ready-made tables: marked, split, signed and unnamed amounts."""
    day, text = "date_format(txn_date, 'yyyy-MM-dd')", "description"
    debit, credit, left = (f"CAST({c} AS string)" for c in ("debit", "credit", "balance"))
    either, signed = "CAST(debit + credit AS string)", "CAST(credit - debit AS string)"
    mark = "CASE WHEN debit > 0 THEN 'Debit' WHEN credit > 0 THEN 'Credit' END"
    number = "concat('N', row_no)"
    kind = f"CAST({KEY} AS bigint) % 4"
    entries = order_entries(spark, folder)
    rows = entries.selectExpr(
        KEY,
        "row_no",
        f"CASE {kind} WHEN 0 THEN {_cells(day, text, either, mark, left)} "
        f"WHEN 1 THEN {_cells(day, text, debit, credit, left)} "
        f"ELSE {_cells(day, text, signed, number, left)} END AS cells",
    )
    headers = ", ".join(_cells(*map(lit, h)) for h in TABLE_HEADERS)
    tables = (
        entries.select(KEY).distinct().selectExpr(KEY, f"get(array({headers}), CAST({kind} AS int)) AS header")
    )
    return rows, tables
