"""Raw cells to transaction rows: header search, boilerplate removal, column mapping.

All layouts are handled in one plan: headers and position maps are rows of a
``layouts`` frame (one per statement), never driver-side schemas.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, lit, strip
from ..schemas import KEY, ROW_BITS
from ..session import reliable_checkpoint

# Phrases that score a header row.
HEADER_PHRASES = [
    "date", "tran date", "transaction date", "value date", "posting date",
    "particulars", "description", "transaction particulars", "narration",
    "amount", "debit", "credit", "withdrawal", "deposit", "dr", "cr",
    "balance", "closing balance", "running balance",
]
MIN_HEADER_SCORE = 3
FALLBACK_PHRASES = ["date", "amount", "balance"]

# Known column names and their standard name.
STANDARD_NAMES = {
    "date": "tran date, transaction date, value date, posting date, txn date",
    "description": "particulars, transaction particulars, narration, transaction details, details",
    "amount": "amount(inr), amount (inr)",
    "debit": "withdrawal amt, withdrawal, dr",
    "credit": "deposit amt, deposit, cr",
    "dr_cr_indicator": "dr/cr",
    "balance": "balance(inr), balance (inr), closing balance, running balance, balance amt",
    "cheque_no": "chq no, cheque no",
    "reference_no": "ref no, reference no",
    "branch": "branch name",
}
CANONICAL = ", ".join(lit(name) for name in STANDARD_NAMES)

# Texts that mark a row as no transaction.
BOILERPLATE = (
    r"opening balance|closing balance|total.*dr.*cr|transaction total|legends?"
    r"|registered office|branch address|in compliance with|system generated|this is a system"
    r"|^\s*$"
)

# Shapes of date and amount cells, and their shares of a column.
DATE_CELL = r"\d{1,2}[-/]\d{1,2}[-/]\d{2,4}|\d{2,4}[-/]\d{1,2}[-/]\d{1,2}"
AMOUNT_CELL = r"[\d,]+\.?\d*"
DATE_SHARE = 0.5
AMOUNT_SHARE = 0.3

# all cells of a row in lower case; a missing cell counts as ''
ROW_TEXT = "lower(array_join(cells, ' ', ''))"

IS_TRANSACTION = (
    f"(size(filter(cells, c -> c IS NOT NULL)) >= 2 AND NOT {ROW_TEXT} RLIKE {lit(BOILERPLATE)})"
)


def header_rank() -> str:
    """The number of header phrases in a possible header row (at least 3), 0 for a row that only
    names a date, an amount or a balance, NULL for any other row."""
    score = " + ".join(f"CAST(contains(text_, {lit(p)}) AS int)" for p in HEADER_PHRASES)
    named = " OR ".join(f"contains(text_, {lit(p)})" for p in FALLBACK_PHRASES)
    ranked = bind(
        score, "score_", f"CASE WHEN score_ >= {MIN_HEADER_SCORE} THEN score_ WHEN {named} THEN 0 END"
    )
    return bind(ROW_TEXT, "text_", ranked)


def standard_name(name: str) -> str:
    pairs = [
        f"{lit(synonym)}, {lit(standard)}"
        for standard, known in STANDARD_NAMES.items()
        for synonym in known.split(", ")
    ]
    return f"coalesce(element_at(map({', '.join(pairs)}), {name}), {name})"


def unique_names(names: str) -> str:
    """Give the 2nd, 3rd, ... occurrence of a name the suffix _1, _2, ..."""
    earlier = f"size(filter(slice({names}, 1, i_), other_ -> other_ = name_))"
    return f"transform({names}, (name_, i_) -> CASE WHEN {earlier} > 0 THEN concat(name_, '_', {earlier}) ELSE name_ END)"


def detect_headers(raw: DataFrame) -> DataFrame:
    """One row per statement: header row, its cells, the width and the last kept row.

    The row with the highest phrase score (at least 3, first one on ties) wins;
    else the first row naming a date, an amount or a balance; else there is none.
    """
    limit = 1 << ROW_BITS
    best = (
        f"CASE WHEN rank_ > 0 AND row_no >= {limit} THEN CAST(raise_error('row_no must be below 2**{ROW_BITS}') AS bigint)"
        f" WHEN rank_ > 0 THEN CAST(rank_ AS bigint) * {limit} - row_no END"
    )
    # numbers only, so that one hash aggregation does
    stats = (
        raw.selectExpr(KEY, "row_no", "cells", f"{header_rank()} AS rank_")
        .groupBy(KEY)
        .agg(
            F.expr("max(size(cells)) AS n_cols"),
            F.expr(f"max(CASE WHEN {IS_TRANSACTION} THEN row_no END) AS last_kept_row"),
            F.expr(f"max({best}) AS best_"),
            F.expr("min(CASE WHEN rank_ IS NOT NULL THEN row_no END) AS first_"),
        )
        .withColumn("header_row_no", F.expr(f"coalesce(pmod(-best_, {limit}L), first_)"))
        .drop("best_", "first_")
    )
    if "names" in raw.columns:
        given = raw.selectExpr(KEY, "names AS given_names").distinct()
        stats = stats.join(given, KEY)
    else:
        stats = stats.withColumn("given_names", F.expr("CAST(NULL AS array<string>)"))
    # then the cells of the one row found, among the few that could be it
    cells = raw.where(f"{header_rank()} IS NOT NULL").selectExpr(KEY, "row_no AS header_row_no", "cells AS header_cells")
    return stats.join(cells, [KEY, "header_row_no"], "left").select(
        KEY, "header_row_no", "header_cells", "n_cols", "last_kept_row", "given_names"
    )


def name_columns(headers: DataFrame) -> DataFrame:
    """Add ``header`` (unique lower-case names) and ``names`` (standard names), by position."""
    positions = "sequence(0, n_cols - 1)"
    cell = f"lower({strip('''coalesce(get(source_, i_), '')''')})"
    named = f"CASE WHEN {cell} IN ('', 'nan') THEN concat('col_', i_) ELSE {cell} END"
    return (
        headers.where("n_cols > 0")
        .withColumn(
            "source_",
            F.expr(
                "CASE WHEN header_row_no IS NOT NULL THEN header_cells "
                f"ELSE coalesce(given_names, transform({positions}, i_ -> CAST(i_ AS string))) END"
            ),
        )
        .withColumn("plain_", F.expr(f"transform({positions}, i_ -> {named})"))
        .withColumn("header", F.expr(unique_names("plain_")))
        .withColumn("names", F.expr(f"transform(header, n_ -> {standard_name('n_')})"))
        .drop("source_", "plain_", "header_cells", "given_names")
    )


def transaction_rows(raw: DataFrame, layouts: DataFrame, *carry: str) -> DataFrame:
    """Rows below the header that are transactions, with the ``carry`` columns of their layout.

    If no row of a statement survives the boilerplate rules, all its rows stay.
    """
    start = "coalesce(header_row_no, -1)"
    return (
        raw.selectExpr(KEY, "row_no", "cells", f"{IS_TRANSACTION} AS kept_")
        .join(layouts.select(KEY, "header_row_no", "last_kept_row", *carry), KEY)
        .where(
            f"row_no > {start} AND (kept_ OR "
            f"(NOT coalesce(last_kept_row > {start}, false) AND exists(cells, c -> c IS NOT NULL)))"
        )
        .select(KEY, "row_no", "cells", *carry)
    )


def profile_columns(raw: DataFrame, named: DataFrame) -> DataFrame:
    """Per statement and column without a standard name: rows, date cells and amount cells."""
    other = f"filter(sequence(0, size(names) - 1), i_ -> get(names, i_) NOT IN ({CANONICAL}))"
    open_layouts = named.withColumn("other", F.expr(other)).where("size(other) > 0")
    return (
        transaction_rows(raw, open_layouts, "other")
        .selectExpr(KEY, "cells", "explode(other) AS col_pos")
        .selectExpr(KEY, "col_pos", f"{strip('''coalesce(get(cells, col_pos), '')''')} AS value")
        .selectExpr(KEY, "col_pos", "CASE WHEN lower(value) NOT IN ('nan', 'none', '') THEN value END AS value")
        .groupBy(KEY, "col_pos")
        .agg(
            F.expr("count(1) AS n"),
            F.expr(f"count_if(value RLIKE {lit(DATE_CELL)}) AS n_date"),
            F.expr(f"count_if(value RLIKE {lit(AMOUNT_CELL)}) AS n_amount"),
        )
    )


def map_by_content(named: DataFrame, profile: DataFrame) -> DataFrame:
    """Layouts with ``names`` completed from column content and ``col_map`` name -> position.

    Columns that already have a standard name keep it.  The first column of
    mostly dates becomes ``date``; columns with enough amounts take the role
    their name hints at.  Each role goes to the first fitting column only.
    """
    dates = f"p.n_date > p.n * {DATE_SHARE}"
    amounts = f"p.n_amount > p.n * {AMOUNT_SHARE}"
    role = f"""
        CASE WHEN {dates} THEN 'date'
            WHEN NOT ({amounts}) THEN NULL
            WHEN p.name RLIKE 'debit|withdrawal|(^|[^a-z])dr([^a-z]|$)' THEN 'debit'
            WHEN p.name RLIKE 'credit|deposit|(^|[^a-z])cr([^a-z]|$)' THEN 'credit'
            WHEN contains(p.name, 'balance') THEN 'balance'
            WHEN contains(p.name, 'amount') THEN 'amount' END"""
    profiles = profile.groupBy(KEY).agg(
        F.expr("array_sort(collect_list(struct(col_pos, n, n_date, n_amount))) AS profile_")
    )
    candidates = f"""
        transform(
            transform(profile_, p -> named_struct('col_pos', p.col_pos, 'n', p.n, 'n_date', p.n_date,
                'n_amount', p.n_amount, 'name', get(names, p.col_pos))),
            p -> named_struct('col_pos', p.col_pos, 'role', {role}))"""
    roles = ("date", "debit", "credit", "balance", "amount")
    chosen = ", ".join(
        f"CASE WHEN NOT array_contains(names, '{r}') THEN get(filter(candidates_, c -> c.role = '{r}'), 0).col_pos END"
        for r in roles
    )
    targets = ", ".join(lit(r) for r in roles)
    return (
        named.join(profiles, KEY, "left")
        .withColumn("candidates_", F.expr(candidates))
        .withColumn("chosen_", F.expr(f"array({chosen})"))
        .withColumn(
            "names",
            F.expr(
                "transform(names, (n_, i_) -> coalesce("
                f"get(array({targets}), CAST(array_position(chosen_, i_) AS int) - 1), n_))"
            ),
        )
        .withColumn("col_map", F.expr(positions_by_name("names")))
        .drop("candidates_", "chosen_", "profile_")
    )


def positions_by_name(names: str) -> str:
    """Map name -> position; of equal names the first one counts."""
    return (
        f"map_from_entries(filter(transform({names}, (n_, i_) -> struct(n_ AS key, i_ AS value)), "
        f"e_ -> array_position({names}, e_.key) = e_.value + 1))"
    )


def detect_layouts(raw: DataFrame) -> DataFrame:
    """Header search, naming and content mapping: one layout row per statement.

    The names are written once, being needed for the content and the result.
    """
    named = reliable_checkpoint(name_columns(detect_headers(raw)))
    return map_by_content(named, profile_columns(raw, named))


# Name patterns per target, in order, for ready-made tables.
DATE_PATTERNS = "date, transaction_date, txn_date, value_date, posting_date"
AMOUNT_PATTERNS = "amount, transaction_amount, txn_amount, debit_amount, credit_amount"
DEBIT_PATTERNS = "debit, debit_amount, dr, withdrawal"
CREDIT_PATTERNS = "credit, credit_amount, cr, deposit"
DESCRIPTION_PATTERNS = "description, particulars, narration, details, transaction_details, remark"
BALANCE_PATTERNS = "balance, closing_balance, running_balance, available_balance"
INDICATOR_PATTERNS = "dr_cr, type, transaction_type, dr_cr_indicator, txn_type"


def _first_position(patterns: str, skip: str | None = None) -> str:
    """Position of the first name containing the first pattern that any name contains."""
    but = f" AND NOT contains(n_, {lit(skip)})" if skip else ""
    tries = [
        f"nullif(array_position(transform(lower_, n_ -> contains(n_, {lit(p)}){but}), true), 0L)"
        for p in patterns.split(", ")
    ]
    return f"CAST(coalesce({', '.join(tries)}) - 1 AS int)"


def map_by_name(tables: DataFrame) -> DataFrame:
    """Position of each target in a ready-made table ``(statement_id, header)``, by name patterns.

    Debit and credit columns are looked for only if there is no amount column.
    """
    return (
        tables.withColumn("lower_", F.expr(f"transform(header, h -> lower({strip('h')}))"))
        .withColumn("amount_pos", F.expr(_first_position(AMOUNT_PATTERNS)))
        .selectExpr(
            *tables.columns,
            f"{_first_position(DATE_PATTERNS)} AS date_pos",
            "amount_pos",
            f"CASE WHEN amount_pos IS NULL THEN {_first_position(DEBIT_PATTERNS, 'balance')} END AS debit_pos",
            f"CASE WHEN amount_pos IS NULL THEN {_first_position(CREDIT_PATTERNS, 'balance')} END AS credit_pos",
            f"{_first_position(DESCRIPTION_PATTERNS)} AS description_pos",
            f"{_first_position(BALANCE_PATTERNS)} AS balance_pos",
            f"{_first_position(INDICATOR_PATTERNS)} AS indicator_pos",
        )
    )
