"""Completeness of the columns a statement's layout provides."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, lit, parse_date, strip
from ..schemas import KEY
from .grid import transaction_rows

# The columns a good statement has.
ESSENTIAL = ["date", "description", "amount", "debit", "credit"]

# report name -> ledger column
TYPED = {
    "date": "txn_date",
    "description": "description",
    "amount": "amount",
    "debit": "debit",
    "credit": "credit",
    "balance": "balance",
    "dr_cr_indicator": "dr_cr_indicator",
    "cheque_no": "cheque_no",
    "reference_no": "reference_no",
    "branch": "branch",
    "type": "txn_type",
    "month_year": "month",
    "transaction_amount": "transaction_amount",
}
PLAIN_COLUMNS = ["date", "description", "debit", "credit", "balance", "type", "month_year", "transaction_amount"]
_TYPED_NAMES = ", ".join(lit(name) for name in TYPED)


def _missing(name: str) -> str:
    value = TYPED[name]
    if name in ("description", "dr_cr_indicator"):  # '' is a blank cell
        return f"coalesce({value}, '') = ''"
    return f"{value} IS NULL"


_WHOLE = r"(\d+|\d{1,3}(,\d{2,3})+)"
#: What a cell can be, as bits; a blank one is nothing.
_KIND = bind(
    strip("get(cells, pos)"),
    "c_",
    f"CASE WHEN coalesce(c_, '') = '' THEN 0 WHEN c_ RLIKE {lit(f'^-?{_WHOLE}$')} THEN 1 WHEN c_ RLIKE {lit(f'^-?{_WHOLE}?[.][0-9]+$')} THEN 2"
    f" WHEN {parse_date('c_')} IS NOT NULL THEN 4 ELSE 8 END",
)
#: The narrowest type that all cells of a column have: whole numbers are decimals, everything is text.
_TYPE = "CASE kinds WHEN 1 THEN 'bigint' WHEN 2 THEN 'decimal' WHEN 3 THEN 'decimal' WHEN 4 THEN 'date' ELSE 'string' END"


def ledger_quality(ledger: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Missing values per typed column, one row per statement and column, in a single pass."""
    columns = list(TYPED) if columns is None else columns
    types = dict(ledger.dtypes)
    counted = ledger.groupBy(KEY).agg(
        F.expr("count(1) AS total_rows"),
        *[F.expr(f"count_if({_missing(c)}) AS missing_{c}") for c in columns],
    )
    cells = ", ".join(
        f"named_struct('column', {lit(c)}, 'data_type', {lit(types[TYPED[c]])}, 'missing_count', missing_{c})"
        for c in columns
    )
    return counted.selectExpr(KEY, "total_rows", f"inline(array({cells}))")


def column_quality(
    ledger: DataFrame, raw: DataFrame | None = None, layouts: DataFrame | None = None
) -> DataFrame:
    """Missing count and percentage per column present in the statement's layout.

    ``data_type`` is the ledger's for columns it has, else the narrowest type of the cells (whole numbers,
    decimals, dates, text).  Without ``raw`` and ``layouts`` every statement counts as having the plain
    debit/credit layout.
    """
    if layouts is None:
        present = ledger_quality(ledger, PLAIN_COLUMNS)
    else:
        known = layouts.selectExpr(
            KEY,
            "map_keys(col_map) AS cols",
            "map_contains_key(col_map, 'amount') AS amount",
            "map_contains_key(col_map, 'amount') AND map_contains_key(col_map, 'dr_cr_indicator') AS marked",
            "map_contains_key(col_map, 'debit') AND map_contains_key(col_map, 'credit') AS both",
            "map_contains_key(col_map, 'date') AS dated",
        )
        derived = (
            "flatten(array(cols,"
            " CASE WHEN marked THEN array('debit', 'credit') ELSE array() END,"
            " CASE WHEN marked OR both THEN array('type') ELSE array() END,"
            " CASE WHEN dated THEN array('month_year') ELSE array() END,"
            " CASE WHEN both OR amount THEN array('transaction_amount') ELSE array() END))"
        )
        shown = known.selectExpr(KEY, f"explode(array_distinct({derived})) AS column").where(
            f"column IN ({_TYPED_NAMES})"
        )
        typed = ledger_quality(ledger).join(shown, [KEY, "column"], "left_semi")
        others = f"map_filter(col_map, (n_, p_) -> n_ NOT IN ({_TYPED_NAMES}))"
        carried = layouts.withColumn("others", F.expr(others)).where("size(others) > 0")
        untyped = (
            transaction_rows(raw, carried, "others")
            .selectExpr(KEY, "cells", "explode(others) AS (column, pos)")
            .groupBy(KEY, "column")
            .agg(
                F.expr("count(1) AS total_rows"),
                F.expr("count_if(get(cells, pos) IS NULL) AS missing_count"),
                F.expr(f"bit_or(coalesce({_KIND}, 0)) AS kinds"),
            )
            .selectExpr(KEY, "total_rows", "column", f"{_TYPE} AS data_type", "missing_count")
        )
        present = typed.unionByName(untyped)
    return present.withColumn("missing_percentage", F.expr("missing_count / total_rows * 100"))


def quality_score(columns: DataFrame) -> DataFrame:
    """Rows, columns and score: half for essential columns found, half for mean completeness."""
    essential = ", ".join(lit(c) for c in ESSENTIAL)
    return (
        columns.groupBy(KEY)
        .agg(
            F.expr("max(total_rows) AS total_rows"),
            F.expr("count(1) AS column_count"),
            F.expr(f"count_if(column IN ({essential})) AS essential_found"),
            F.expr("avg(missing_percentage) AS missing"),
        )
        .selectExpr(
            KEY,
            "total_rows",
            "column_count",
            "essential_found",
            f"essential_found / {len(ESSENTIAL)} * 50 + (100 - missing) / 100 * 50 AS quality_score",
        )
    )
