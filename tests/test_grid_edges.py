"""Edge cases of header search, naming, mapping and typing."""

from datetime import date

import pytest
from conftest import make_grid, plain

import ledgerloom as ll
from ledgerloom.functions import text
from ledgerloom.operators import grid as g
from ledgerloom.sources.grids import from_frame


def one(spark, expression, value):
    df = spark.createDataFrame([(value,)], "x string")
    return df.selectExpr(f"{expression} AS y").first()["y"]


@pytest.mark.parametrize(
    "cell, amount",
    [
        ("1,234.56 Cr", 1234.56),
        ("(500)", 500),
        ("Rs.500", 0.5),
        ("-12.30", -12.3),
        ("5.", 5),
        ("1.2.3", 0),
        ("--5", 0),
        ("-", 0),
        (".", 0),
        ("", 0),
        (None, 0),
        ("n/a", 0),
    ],
)
def test_clean_amount(spark, cell, amount):
    assert float(one(spark, text.clean_amount("x"), cell)) == amount


@pytest.mark.parametrize(
    "cell, day",
    [
        ("02-04-2024", date(2024, 4, 2)),
        ("13/04/2024", date(2024, 4, 13)),
        (" 1/2/24 ", date(2024, 2, 1)),
        ("2024-02-13", date(2024, 2, 13)),
        ("05-JAN-2024", date(2024, 1, 5)),
        ("5 January 2024", date(2024, 1, 5)),
        ("05.01.2024 10:30", date(2024, 1, 5)),
        ("31/02/2024", None),
        ("02-13-2024", None),
        ("TOTAL", None),
        ("", None),
        (None, None),
    ],
)
def test_parse_date(spark, cell, day):
    assert one(spark, text.parse_date("x"), cell) == day


def test_month_first_override(spark):
    assert one(spark, text.parse_date("x", text.MONTH_FIRST), "02-13-2024") == date(2024, 2, 13)


def test_display_text(spark):
    assert one(spark, text.currency("CAST(x AS double)"), "1234567.5") == "₹1,234,567.50"
    assert one(spark, text.currency("CAST(x AS double)"), None) == "₹0.00"
    assert one(spark, text.currency_or_text("x"), " ") == ""
    assert one(spark, text.currency_or_text("x"), "abc") == "abc"
    assert one(spark, text.currency_or_text("x"), "-5") == "₹-5.00"
    assert one(spark, text.percentage("CAST(x AS double)"), "79.66") == "79.7%"
    assert one(spark, text.shorten("x"), "a" * 51) == "a" * 50 + "..."
    assert one(spark, text.shorten("x"), "a" * 50) == "a" * 50


def test_header_search(spark):
    raw = make_grid(
        spark,
        {
            "first_of_equals": [["Date", "Debit", "Credit"], ["Date", "Debit", "Credit"], ["1", "2", "3"]],
            "best": [["Date Amount", "Balance"], ["Tran Date", "Particulars", "Debit", "Credit"], ["1", "2"]],
            "fallback": [["x", "y"], ["my balance", "z"], ["amount", "z"]],
            "none": [["a", "b"], ["c", "d"]],
        },
    )
    found = {r["statement_id"]: r["header_row_no"] for r in g.detect_headers(raw).collect()}
    assert found == {"first_of_equals": 0, "best": 1, "fallback": 1, "none": None}


def test_names(spark):
    raw = make_grid(
        spark,
        {
            "double": [["Tran Date", "Value Date", "Amount", "Amount", "Amount"], ["a", "b", "c", "d", "e"]],
            "blank": [[" Txn Date\n", None, "Balance", "Debit"], ["a", "b", "c", "d"]],
            "none": [["a", "b"], ["c", "d"]],
        },
    )
    named = g.name_columns(g.detect_headers(raw))
    got = {r["statement_id"]: (r["header"], r["names"]) for r in named.collect()}
    assert got["double"][0] == ["tran date", "value date", "amount", "amount_1", "amount_2"]
    assert got["double"][1] == ["date", "date", "amount", "amount_1", "amount_2"]
    assert got["blank"] == (["txn date", "col_1", "balance", "debit"], ["date", "col_1", "balance", "debit"])
    assert got["none"][1] == ["0", "1"]
    layouts = {r["statement_id"]: r["col_map"] for r in ll.detect_layouts(raw).collect()}
    assert layouts["double"]["date"] == 0  # the first of two date columns counts


def test_boilerplate_rows(spark):
    rows = [
        ["Date", "Description", "Debit", "Credit"],
        ["01-01-2024", "Opening Balance", "1", None],
        ["01-01-2024", "total 5 dr 7 cr", None, "1"],
        ["Legend: a", "b", None, None],
        ["only one", None, None, None],
        [None, None, None, None],
        ["02-01-2024", "SHOP", "5", None],
    ]
    raw = make_grid(spark, {"some": rows, "nothing_left": rows[:6]})
    layouts = ll.detect_layouts(raw)
    kept = {}
    for r in g.transaction_rows(raw, layouts).collect():
        kept.setdefault(r["statement_id"], []).append(r["row_no"])
    assert kept["some"] == [6]
    assert sorted(kept["nothing_left"]) == [1, 2, 3, 4]  # if nothing survives all filled rows stay


def test_mapping_by_content(spark):
    raw = make_grid(
        spark,
        {
            "s": [
                ["When", "Description", "DR Value", "Deposit Value", "Balance Value", "Cr No"],
                ["01-01-2024", "PAY 1", "10", None, "90", "x"],
                ["02-01-2024", "PAY 2", None, "5", "95", "y"],
                ["03-01-2024", "PAY 3", "1", "2", "94", "z"],
            ]
        },
    )
    (layout,) = ll.detect_layouts(raw).collect()
    # a description full of digits keeps its name, a text column is no credit column
    assert layout["names"] == ["date", "description", "debit", "credit", "balance", "cr no"]


def test_amount_with_indicator(spark):
    raw = make_grid(
        spark,
        {
            "s": [
                ["Tran Date", "Particulars", "Amount(INR)", "DR/CR", "Balance(INR)", "Branch Name"],
                ["01-01-2024", "A", "1,000.00", " DR", "9", "X"],
                ["02-01-2024", "B", "500.00", "Credit", "9", "X"],
                ["03-01-2024", "C", "70.00", None, "9", "X"],
            ]
        },
    )
    ledger = ll.build_ledger(raw, ll.detect_layouts(raw))
    got = [
        (r["debit"], r["credit"], r["txn_type"], r["transaction_amount"], r["branch"])
        for r in plain(ledger, "row_no")
    ]
    assert got == [
        (1000.0, 0.0, "debit", 1000.0, "X"),
        (0.0, 500.0, "credit", 500.0, "X"),
        (0.0, 0.0, "unknown", 0.0, "X"),
    ]
    report = [(r["amount"], r["debit"], r["credit_amount"], r["dr_cr_indicator"]) for r in plain(ll.report_ledger(ledger), "row_no")]
    # the second report looks at the first letter of the mark as it stands
    assert report == [(1000.0, 0.0, 0.0, "CR"), (500.0, 0.0, 500.0, "CR"), (70.0, 0.0, 0.0, "CR")]


def test_layouts_without_columns(spark):
    raw = make_grid(
        spark,
        {
            "signed": [["Date", "Description", "Amount"], ["01-01-2024", "A", "-5"], ["02-01-2024", "B", "7"]],
            "undated": [["Description", "Debit", "Credit"], ["A", "5", None], ["B", None, "7"]],
        },
    )
    done = ll.process(raw)
    ledger = {(r["statement_id"], r["description"]): r for r in done.ledger.collect()}
    assert ledger["signed", "A"]["debit"] is None and ledger["signed", "A"]["txn_type"] is None
    assert ll.recurring_payments(done.ledger, 1, 1).count() == 0
    report = ll.report_ledger(done.ledger, done.layouts)
    got = {
        (r["statement_id"], r["description"]): (float(r["debit"]), float(r["credit_amount"]), r["dr_cr_indicator"])
        for r in report.collect()
    }
    assert got == {
        ("signed", "A"): (5, 0, "DR"),
        ("signed", "B"): (0, 7, "CR"),
        ("undated", "A"): (5, 0, "DR"),
        ("undated", "B"): (0, 7, "CR"),
    }
    months = {(r["statement_id"], r["month"]): float(r["expenses"]) for r in ll.monthly_expenses(report).collect()}
    assert months == {("signed", "2024-01"): 5, ("undated", "Total"): 5}
    quality = {r["statement_id"]: r for r in ll.quality_score(ll.column_quality(done.ledger, raw, done.layouts)).collect()}
    # date, description, amount + month_year, transaction_amount, nothing missing
    assert quality["signed"]["quality_score"] == pytest.approx(3 / 5 * 50 + 50)
    assert quality["undated"]["column_count"] == 5


def test_extra_columns_count_for_quality(spark):
    raw = make_grid(
        spark,
        {
            "s": [
                ["Date", "Description", "Debit", "Credit", "Remarks"],
                ["01-01-2024", "A", "5", None, None],
                ["bad", "B", None, "7", "x"],
            ]
        },
    )
    done = ll.process(raw)
    columns = {r["column"]: r["missing_percentage"] for r in ll.column_quality(done.ledger, raw, done.layouts).collect()}
    assert columns == {
        "date": 50.0,
        "description": 0.0,
        "debit": 0.0,
        "credit": 0.0,
        "type": 0.0,
        "month_year": 50.0,
        "transaction_amount": 0.0,
        "remarks": 50.0,
    }


def test_frame_names_serve_as_header(spark):
    df = spark.createDataFrame(
        [("s", 1, "01-01-2024", "A", "5", "0"), ("s", 2, "02-01-2024", "B", "0", "7")],
        "id string, no int, `Tran Date` string, Particulars string, DR string, CR string",
    )
    raw = from_frame(df, "id", "no")
    ledger = ll.build_ledger(raw, ll.detect_layouts(raw))
    got = [(r["txn_date"], r["description"], r["debit"], r["credit"]) for r in plain(ledger, "row_no")]
    assert got == [(date(2024, 1, 1), "A", 5.0, 0.0), (date(2024, 1, 2), "B", 0.0, 7.0)]


def test_empty_input(spark):
    raw = make_grid(spark, {"s": [["Date", "Debit", "Credit"]]}).where("false")
    done = ll.process(raw)
    assert done.ledger.count() == 0
    assert done.metadata.count() == 0
    assert ll.transaction_summary(ll.flows(done.ledger)).count() == 0


def test_ready_made_tables(spark):
    tables = spark.createDataFrame(
        [
            ("split", ["value_date", "remark", "withdrawal", "deposit", "dr balance"]),
            ("guess", ["When", "Who", "What"]),
            ("none", ["a", "b"]),
            ("numbers", ["txn_date", "amount"]),
            ("marks", ["date", "details", "amount", "type"]),
        ],
        "statement_id string, header array<string>",
    )
    rows = spark.createDataFrame(
        [
            ("split", 1, ["2024-01-05", "A", "10", "", "1"]),
            ("split", 2, ["2024-01-06", "B", "1,000", "7", "2"]),
            ("split", 3, ["no date", "C", "1", "7", "2"]),
            ("guess", 1, ["05/01/2024", "A", "-150"]),
            ("guess", 2, ["06/01/2024", None, "90"]),
            ("none", 1, ["x", "y"]),
            ("numbers", 1, ["2024-01-05", "-3"]),
            ("marks", 1, ["2024-01-05", "A", "5", "Sent"]),
            ("marks", 2, ["2024-01-05", "B", "-5", "dr"]),
            ("marks", 3, ["2024-01-05", "C", "-5", "Credit"]),
            ("marks", 4, ["2024-01-05", "D", "5", ""]),
        ],
        "statement_id string, row_no bigint, cells array<string>",
    )
    got = {
        (r["statement_id"], r["row_no"]): (
            r["description"], float(r["amount"]), float(r["debit"]), float(r["credit_amount"]), r["dr_cr_indicator"],
        )
        for r in ll.report_ledger_from_table(rows, tables).collect()
    }
    assert got == {
        ("split", 1): ("A", -10, 10, 0, "DR"),
        ("split", 2): ("B", 7, 0, 7, "CR"),  # grouped digits are no number here
        ("guess", 1): ("05/01/2024", -150, 150, 0, "DR"),  # first text column whose name lacks 'date'
        ("guess", 2): ("06/01/2024", 90, 0, 90, "CR"),
        ("none", 1): ("x", 0, 0, 0, "DR"),
        ("marks", 1): ("A", 5, 0, 0, "CR"),  # an unknown mark counts as credit without an amount
        ("marks", 2): ("B", -5, 5, 0, "DR"),
        ("marks", 3): ("C", -5, 0, 5, "CR"),
        ("marks", 4): ("D", 5, 0, 0, "CR"),
        ("numbers", 1): ("DR", -3, 3, 0, "DR"),  # without a text column the mark describes the row
    }
