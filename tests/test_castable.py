"""Which cells are numbers, and how often the columns of layouts and tables are worked out."""

from ledgerloom.functions import text
from ledgerloom.operators import typing

CELLS = [
    "1", " 1.5 ", "-.5", "+5.", "1e3", "1E-2", "1d", "2F", "0x1p3", "inf", "-Infinity", "NaN", " 7 ", "\u00017", "٣", "12\n",
    "", " ", ".", "-", "1.2.3", "abc", "NEFT", "INFO", "1,000", "02 Jan 2024", "2024-01-02", "1-", "9" * 30, None,
]


def test_casts_are_as_without_a_guard(spark):
    cells = spark.createDataFrame([(c,) for c in CELLS], "c string")
    for kind in ("double", "decimal(28,2)"):
        found = cells.selectExpr("c", f"{text.to_number('c', kind)} AS a", f"try_cast({text.strip('c')} AS {kind}) AS b")
        assert found.where("NOT (a <=> b)").collect() == []
    digits = "regexp_replace(c, '[^0-9.-]', '')"
    found = cells.selectExpr("c", f"{text.clean_amount('c')} AS a", f"coalesce(try_cast({digits} AS decimal(28,2)), 0) AS b")
    assert found.where("NOT (a <=> b)").collect() == []


def test_names_are_not_matched_per_row(spark):
    """Filters on a table's positions do not reach the rows joined to it."""
    rows = spark.range(100).selectExpr("CAST(id % 4 AS string) AS statement_id", "id AS row_no", "array('2024-01-02', 'x', '-5', 'N1', '7') AS cells")
    tables = rows.select("statement_id").distinct().selectExpr(
        "statement_id", "CASE statement_id WHEN '0' THEN array('Posted', 'Payee', 'Value', 'No', 'Left') ELSE array('date', 'details', 'amount', 'ref', 'balance') END AS header"
    )
    plan = typing.table_layouts(rows, tables)._jdf.queryExecution().optimizedPlan().toString()
    assert "posting_date" not in plan and "closing_balance" not in plan
    assert typing.report_ledger_from_table(rows, tables).count() == 100
