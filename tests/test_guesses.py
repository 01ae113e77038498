"""Date formats found from the cells, unreadable cells, columns without a standard name, members of recurring payments."""

from datetime import date, timedelta

import pytest
from conftest import make_grid, make_ledger, plain, rows
from pyspark.sql import Observation

import ledgerloom as ll
from ledgerloom.operators import quality, recurring, typing
from ledgerloom.operators.grid import detect_layouts

HEAD = ["Tran Date", "Particulars", "Debit", "Credit"]


def dated(*days):
    return [HEAD, *([d, "SHOP", "5", None] for d in days)]


def test_date_formats_are_inferred(spark):
    grids = {
        "ambiguous": dated("01-02-2024", "03/04/2024"),
        "month": dated("01-02-2024", "02-13-2024"),
        "day": dated("01-02-2024", "13-02-2024", "13-02-2024", "02-14-2024"),
        "shapes": dated("05 Jan 2024", "2024-01-06", "01-17-2024", "06-07-2024"),
        "clock": dated("02/13/2024 10:30", None, " "),
        "none": dated("x", "y"),
        "empty": dated(None),
        "undated": [["Particulars", "Debit", "Credit", "Balance"], ["SHOP", "5", None, "1"]],
    }
    raw = make_grid(spark, grids)
    layouts = typing.infer_date_formats(raw, detect_layouts(raw))
    found = {r.statement_id: r.date_formats for r in layouts.collect()}
    assert found["ambiguous"] == ["d-M-yyyy"] and found["month"] == ["M-d-yyyy"]
    assert found["none"] is found["empty"] is found["undated"] is None
    got = {}
    for r in typing.build_ledger(raw, layouts).orderBy("row_no").collect():
        got.setdefault(r.statement_id, []).append(r.txn_date)
    assert got["ambiguous"] == [date(2024, 2, 1), date(2024, 4, 3)]
    assert got["month"] == [date(2024, 1, 2), date(2024, 2, 13)]
    # one reading for a column: the cell that does not fit it has no date
    assert got["day"] == [date(2024, 2, 1), date(2024, 2, 13), date(2024, 2, 13), None]
    assert got["shapes"] == [date(2024, 1, 5), date(2024, 1, 6), date(2024, 1, 17), date(2024, 6, 7)]
    assert got["clock"] == [date(2024, 2, 13), None, None] and got["none"] == [None, None]
    assert rows(ll.process(raw, None).ledger.select("statement_id", "row_no", "txn_date"), "statement_id", "row_no") == rows(
        typing.build_ledger(raw, layouts).select("statement_id", "row_no", "txn_date"), "statement_id", "row_no"
    )


def test_unreadable_cells_end_no_job_and_are_listed(spark):
    long = "9" * 30
    grid = [HEAD + ["Balance"], ["01-01-2024", "A", long, None, "1"], ["bad", "B", "1.2.3", "x", "-"], ["02-01-2024", "C", f"INR {long}.5", "7 Cr", long], [None, "D", "1", "2", "3"]]
    done = ll.process(make_grid(spark, {"s": grid}))
    seen = Observation("cells")
    ledger = typing.build_ledger(done.raw, done.layouts, observation=seen)
    got = {r["description"]: (r["debit"], r["credit"], r["balance"], r["txn_date"]) for r in plain(ledger)}
    assert got == {"A": (0, 0, 1, date(2024, 1, 1)), "B": (0, 0, 0, None), "C": (0, 7, 0, date(2024, 1, 2)), "D": (1, 2, 3, None)}
    assert seen.get == {"rows": 4, "rejected_amounts": 4, "rejected_dates": 1}
    assert sorted((r.row_no, r.column, r.reason) for r in done.rejects.collect()) == [
        (1, "debit", "too long"), (2, "date", "not a date"), (2, "debit", "not a number"), (3, "balance", "too long"), (3, "debit", "too long"),
    ]


def test_unreadable_table_cells(spark):
    table = make_grid(spark, {"s": [["2024-01-01", "A", "9" * 30, "5"], ["soon", "B", "1,000", ""], ["2024-01-02", "C", "-3.5", None]]})
    tables = spark.createDataFrame([("s", ["date", "details", "amount", "balance"])], "statement_id string, header array<string>")
    ledger = typing.report_ledger_from_table(table, tables)
    assert [(r["description"], r["amount"]) for r in plain(ledger, "row_no")] == [("A", 0), ("C", -3.5)]
    found = typing.rejected_table_cells(table, typing.table_layouts(table, tables)).collect()
    assert sorted((r.row_no, r.column, r.reason) for r in found) == [(0, "amount", "too long"), (1, "amount", "not a number"), (1, "date", "not a date")]


@pytest.mark.parametrize(
    "names, cells, want",
    [
        (["Posted", "Payee"], ["05 Jan 2024", "ASHA"], (date(2024, 1, 5), "ASHA")),
        (["Payee", "Posted"], ["ASHA", "05 Jan 2024"], (date(2024, 1, 5), "ASHA")),
        (["No", "Payee"], ["17", "ASHA"], (None, "ASHA")),
        (["Update", "Payee"], ["soon", "ASHA"], (None, "ASHA")),
        (["Update", "No"], ["soon", "17"], (None, "soon")),
        (["Posted", "No"], ["05 Jan 2024", "17"], (date(2024, 1, 5), "")),
        (["No", "Code"], ["17", "8"], (None, "")),
    ],
)
def test_report_finds_date_and_text_among_other_columns(spark, names, cells, want):
    grid = [["Debit", "Credit", "Balance", *names], ["5", None, "9", *cells], ["7", None, "2", *cells]]
    done = ll.process(make_grid(spark, {"s": grid}))
    got = ll.report_ledger(done.ledger, done.layouts).collect()
    assert [(r.txn_date, r.description) for r in got] == [want] * 2
    assert {r.has_date for r in got} == {want[0] is not None}


def test_report_drops_undated_rows_of_a_guessed_column(spark):
    grid = [["Posted", "Particulars", "Debit", "Credit", "Balance"], [" ", "A", "5", None, "9"], ["05 Jan 2024", "B", "7", None, "2"], ["x", "C", "7", None, "2"]]
    done = ll.process(make_grid(spark, {"s": grid}))
    assert [r.description for r in ll.report_ledger(done.ledger, done.layouts).collect()] == ["B"]


def test_types_of_other_columns(spark):
    head = ["Tran Date", "Particulars", "Debit", "Credit", "Whole", "Money", "Seen", "Mixed", "Blank"]
    body = [["01-01-2024", "A", "5", "1", "1,234", "3", "05 Jan 2024", "4", None], ["01-01-2024", "A", "5", "1", None, "-1,234.5", "2024-01-01", "x", " "]]
    done = ll.process(make_grid(spark, {"s": [head, *body]}))
    found = {r.column: r.data_type for r in quality.column_quality(done.ledger, done.raw, done.layouts).collect()}
    assert [found[x.lower()] for x in head[4:]] == ["bigint", "decimal", "date", "string", "string"]


@pytest.mark.parametrize("tolerance", [0.1, 0.0, 0.45])
def test_members_of_recurring_payments(spark, tolerance):
    first = date(2024, 1, 1)
    amounts = [1000, 1100, 1100.01, 900, 899.99, 1000, 1450, 1000, 5000, 690]
    days = [0, 30, 30, 60, 61, 30, 90, None, 90, 0]
    data = [(i, None if d is None else str(first + timedelta(days=d)), "HOME LOAN", a, 0, 0) for i, (a, d) in enumerate(zip(amounts, days))]
    ledger = make_ledger(spark, data)
    found = recurring.recurring_payments(ledger, 1, 1, tolerance)
    got = {}
    for r in recurring.recurring_members(ledger, found, amount_tolerance=tolerance).collect():
        got.setdefault(r.seed_row_no, {})[r.row_no] = r.gap_days
    assert {r.row_no: r.occurrences for r in found.collect()} == {k: len(v) for k, v in got.items()}
    for seed, members in got.items():
        want = {i: None for i, a in enumerate(amounts) if abs(a - amounts[seed]) / amounts[seed] <= tolerance}
        before = None
        for d, i in sorted((days[i], i) for i in want if days[i] is not None):
            want[i], before = None if before is None else d - before, d
        assert members == want


def test_reports_gather_sections_in_one_aggregation(spark, golden):
    plan = ll.comprehensive_insights(golden)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Join") <= 1 and plan.count("Exchange ") <= 10
    plan = ll.comprehensive_report(ll.report_ledger(golden))._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and plan.count("Exchange ") <= 4


def test_local_session_without_a_checkpoint_folder(spark, monkeypatch):
    from ledgerloom import session

    monkeypatch.setattr(session, "_configured", lambda spark: None)
    one, two = session.shared_folder(spark), session.shared_folder(spark)
    assert one != two and one.rsplit("/", 1)[0] == two.rsplit("/", 1)[0]
    assert session.reliable_checkpoint(spark.range(3)).count() == 3


def test_the_package_offers_the_whole_way(spark, tmp_path):
    """From files to both reports by the package's own names."""
    grid = [["Tran Date", "Particulars", "Debit", "Credit", "Balance"], ["02-13-2024", 'RENT, "home"', "5", None, "9"], ["03-01-2024", "SALARY\nACME", None, "7", "16"]]
    ll.write_grid_csv(make_grid(spark, {"s": grid}), str(tmp_path / "csv"))
    done = ll.process(ll.read_grids(spark, f"{tmp_path}/csv/*/*", multiline=True), None)
    assert [(r.txn_date, r.description) for r in done.ledger.orderBy("row_no").collect()] == [(date(2024, 2, 13), 'RENT, "home"'), (date(2024, 3, 1), "SALARY\nACME")]
    (found,) = ll.analyze(done).collect()
    assert found.transaction_summary.total_transactions == 2 and found.data_quality.columns
    assert ll.report_lines(ll.analyze_report(done)).count() > 8 and done.rejects.isEmpty()
    assert all(hasattr(ll, name) for name in ll.__all__)
