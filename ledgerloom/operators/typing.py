"""Typed ledgers: dates, money, debit/credit direction.

The small rules are SQL fragments over column names or expressions.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from ..functions.text import (
    DAY_FIRST,
    MONTH_FIRST,
    amount_flaw,
    clean_amount,
    date_flaw,
    lit,
    number_flaw,
    parse_date,
    shape,
    strip,
    to_number,
)
from ..schemas import KEY, MONEY, ZERO
from ..session import reliable_checkpoint
from .grid import CANONICAL, map_by_name, transaction_rows


def split_by_indicator(amount: str, indicator: str) -> tuple[str, str]:
    """(debit, credit) of an amount with a DR/CR mark; any other mark gives neither."""
    mark = f"upper({strip(indicator)})"
    return (
        f"CASE WHEN {mark} IN ('DR', 'DEBIT') THEN {amount} ELSE {ZERO} END",
        f"CASE WHEN {mark} IN ('CR', 'CREDIT') THEN {amount} ELSE {ZERO} END",
    )


def transaction_type(debit: str, credit: str) -> str:
    return f"CASE WHEN {debit} > 0 THEN 'debit' WHEN {credit} > 0 THEN 'credit' ELSE 'unknown' END"


def finish_ledger(df: DataFrame) -> DataFrame:
    """Add month, type and unified amount to a frame with the basic ledger columns."""

    def own(name: str, kind: str) -> str:
        return name if name in df.columns else f"CAST(NULL AS {kind}) AS {name}"

    both = "debit IS NOT NULL AND credit IS NOT NULL"
    return df.selectExpr(
        KEY,
        "row_no",
        own("txn_date", "date"),
        own("description", "string"),
        *[own(name, MONEY) for name in ("debit", "credit", "amount", "balance")],
        *[own(name, "string") for name in ("dr_cr_indicator", "cheque_no", "reference_no", "branch")],
        own("extra", "map<string,string>"),
    ).selectExpr(
        KEY,
        "row_no",
        "txn_date",
        "date_format(txn_date, 'yyyy-MM') AS month",
        "description",
        "debit",
        "credit",
        "amount",
        "balance",
        "dr_cr_indicator",
        f"CASE WHEN {both} THEN {transaction_type('debit', 'credit')} END AS txn_type",
        f"CASE WHEN {both} THEN CAST(debit + credit AS {MONEY}) ELSE amount END AS transaction_amount",
        "cheque_no",
        "reference_no",
        "branch",
        "extra",
    )


def _cell(name: str) -> str:
    """The cell of a column by its standard name, in a row that carries its layout's ``col_map``."""
    return f"get(cells, element_at(col_map, '{name}'))"


def _date(value: str, layouts: DataFrame, date_formats: Iterable[str]) -> str:
    """A date cell parsed by the layout's own formats, if it has any, else by those given."""
    if "date_formats" not in layouts.columns:
        return parse_date(value, date_formats)
    known = tuple(dict.fromkeys([*date_formats, *DAY_FIRST, *MONTH_FIRST]))
    tried = f"transform(date_formats, f_ -> CASE f_ {' '.join(f'WHEN {lit(f)} THEN {parse_date(value, [f])}' for f in known)} END)"
    first = f"get(filter({tried}, d_ -> d_ IS NOT NULL), 0)"
    return f"CASE WHEN date_formats IS NULL THEN {parse_date(value, date_formats)} ELSE {first} END"


_MONEY_NAMES = ("debit", "credit", "amount", "balance")


def infer_date_formats(
    raw: DataFrame, layouts: DataFrame, candidates: Iterable[str] = tuple(dict.fromkeys([*DAY_FIRST, *MONTH_FIRST]))
) -> DataFrame:
    """Layouts with ``date_formats``: how the date column of each statement is to be read.

    Every distinct date text of a statement is tried with every format.  Of formats that
    fit the same shape of text (day first and month first) only the one that reads most
    cells stays, the earlier candidate on ties; so a column is read one way throughout,
    while texts of different shapes may stand in one column.  A column that no
    format fits has NULL, for the formats ``build_ledger`` is given.
    """
    candidates = tuple(candidates)
    dated = layouts.where("map_contains_key(col_map, 'date')")
    texts = (
        transaction_rows(raw, dated, "col_map")
        .selectExpr(KEY, f"{_cell('date')} AS text")
        .where("text IS NOT NULL")
        .groupBy(KEY, "text")
        .count()
    )
    counted = texts.groupBy(KEY).agg(
        *[F.expr(f"coalesce(sum(count) FILTER (WHERE {parse_date('text', [f])} IS NOT NULL), 0) AS n{i}") for i, f in enumerate(candidates)]
    )
    fits = ", ".join(
        f"named_struct('n', n{i}, 'shape', {lit(shape(f))}, 'place', {i}, 'format', {lit(f)})" for i, f in enumerate(candidates)
    )
    better = "y.shape = x.shape AND (y.n > x.n OR (y.n = x.n AND y.place < x.place))"
    chosen = f"transform(filter(fits_, x -> x.n > 0 AND NOT exists(fits_, y -> {better})), x -> x.format)"
    found = counted.selectExpr(KEY, f"array({fits}) AS fits_").selectExpr(KEY, f"{chosen} AS found_")
    own = F.expr("CASE WHEN size(found_) > 0 THEN found_ END")
    return layouts.drop("date_formats").join(found, KEY, "left").withColumn("date_formats", own).drop("found_")


def rejected_cells(raw: DataFrame, layouts: DataFrame, date_formats: Iterable[str] = DAY_FIRST) -> DataFrame:
    """Cells ``build_ledger`` takes no value from: ``statement_id, row_no, column, cell, reason``.

    An amount that is ``too long`` for the ledger or ``not a number`` counts as 0
    there, a text that is ``not a date`` as no date.
    """
    reasons = {"date": date_flaw(_cell("date"), _date(_cell("date"), layouts, date_formats))}
    reasons |= {name: amount_flaw(_cell(name)) for name in _MONEY_NAMES}
    carried = ["col_map", *(["date_formats"] if "date_formats" in layouts.columns else [])]
    return _flawed(transaction_rows(raw, layouts, *carried), {name: (_cell(name), why) for name, why in reasons.items()})


def _flawed(rows: DataFrame, checks: dict[str, tuple[str, str]]) -> DataFrame:
    found = ", ".join(f"named_struct('column', {lit(n)}, 'cell', {cell}, 'reason', {why})" for n, (cell, why) in checks.items())
    return rows.selectExpr(KEY, "row_no", f"inline(filter(array({found}), x -> x.reason IS NOT NULL))")


def build_ledger(
    raw: DataFrame, layouts: DataFrame, date_formats: Iterable[str] = DAY_FIRST, observation: Observation | None = None
) -> DataFrame:
    """Project the transaction rows of every layout onto the one typed ledger.

    ``layouts`` may have a column ``date_formats array<string>`` (see ``infer_date_formats``): where it is not
    NULL, its formats (of ``DAY_FIRST``, ``MONTH_FIRST`` or ``date_formats``) are tried in its order, others are not.
    An ``observation`` counts ``rows``, ``rejected_amounts`` and ``rejected_dates`` while the ledger is read;
    ``rejected_cells`` lists them.
    """
    own_formats = "date_formats" in layouts.columns

    # columns without a standard name, and second ones of a name
    unmapped = (
        f"filter(sequence(0, size(names) - 1), i_ -> get(names, i_) NOT IN ({CANONICAL})"
        " OR array_position(names, get(names, i_)) <> i_ + 1)"
    )
    label = "CASE WHEN array_position(header, get(header, i_)) = i_ + 1 THEN get(header, i_) ELSE concat(get(header, i_), '#', i_) END"
    # found once per layout, not once per row
    layouts = layouts.withColumn("extra_", F.expr(f"transform({unmapped}, i_ -> struct({label} AS key, i_ AS place))"))
    extra = "map_from_entries(transform(extra_, e_ -> struct(e_.key AS key, get(cells, e_.place) AS value)))"

    def text(name: str) -> str:
        return f"CASE WHEN map_contains_key(col_map, '{name}') THEN coalesce({_cell(name)}, '') END AS {name}"

    def money(name: str) -> str:
        return f"CASE WHEN map_contains_key(col_map, '{name}') THEN {clean_amount(_cell(name))} END AS {name}"

    carried = ["col_map", "extra_", *(["date_formats"] if own_formats else [])]
    date = _date(_cell("date"), layouts, date_formats)
    rows = transaction_rows(raw, layouts, *carried)
    if observation is not None:
        flaws = " + ".join(f"CAST({amount_flaw(_cell(name))} IS NOT NULL AS int)" for name in _MONEY_NAMES)
        rows = rows.observe(
            observation,
            F.expr("count(1) AS rows"),
            F.expr(f"coalesce(sum({flaws}), 0) AS rejected_amounts"),
            F.expr(f"count_if({date_flaw(_cell('date'), date)} IS NOT NULL) AS rejected_dates"),
        )
    typed = rows.selectExpr(
        KEY,
        "row_no",
        f"{date} AS txn_date",
        f"{extra} AS extra",
        text("description"),
        *[money(name) for name in _MONEY_NAMES],
        text("dr_cr_indicator"),
        *[f"{_cell(name)} AS {name}" for name in ("cheque_no", "reference_no", "branch")],
    )
    marked = "amount IS NOT NULL AND dr_cr_indicator IS NOT NULL"
    debit, credit = split_by_indicator("amount", "dr_cr_indicator")
    return finish_ledger(
        typed.withColumns(
            {
                "debit": F.expr(f"CASE WHEN {marked} THEN {debit} ELSE debit END"),
                "credit": F.expr(f"CASE WHEN {marked} THEN {credit} ELSE credit END"),
            }
        )
    )


def split_by_prefix(amount: str, indicator: str) -> tuple[str, str, str]:
    """(debit, credit, DR/CR) by the first letter of the mark; an unknown mark is CR with 0."""
    debit, credit = f"startswith(upper({indicator}), 'D')", f"startswith(upper({indicator}), 'C')"
    return (
        f"CASE WHEN {debit} THEN abs({amount}) ELSE {ZERO} END",
        f"CASE WHEN {credit} THEN abs({amount}) ELSE {ZERO} END",
        f"CASE WHEN {debit} THEN 'DR' ELSE 'CR' END",
    )


def split_by_sign(amount: str) -> tuple[str, str, str]:
    return (
        f"CASE WHEN {amount} < 0 THEN abs({amount}) ELSE {ZERO} END",
        f"CASE WHEN {amount} > 0 THEN {amount} ELSE {ZERO} END",
        f"CASE WHEN {amount} < 0 THEN 'DR' ELSE 'CR' END",
    )


def merge_columns(debit: str, credit: str) -> tuple[str, str]:
    """(amount, DR/CR) of separate debit and credit columns."""
    return (
        f"CASE WHEN {debit} > 0 THEN CAST(-{debit} AS {MONEY}) ELSE {credit} END",
        f"CASE WHEN {debit} > 0 THEN 'DR' ELSE 'CR' END",
    )


def _directed(df: DataFrame) -> DataFrame:
    """The second report's columns from ``single``/``mark`` or ``own_debit``/``own_credit``.

    A single amount is split by its mark, without a mark by its sign; else separate
    columns are merged; else there is no money and the row counts as DR with 0.
    Rows without a date go away, unless the statement has no date column at all.
    """
    # the first letter of the mark, or what stands for it: D, C or neither
    side = (
        "CASE WHEN single IS NULL THEN 'own columns' WHEN mark IS NOT NULL THEN upper(left(mark, 1))"
        " WHEN single < 0 THEN 'D' WHEN single > 0 THEN 'C' ELSE '' END"
    )
    return (
        df.where("txn_date IS NOT NULL OR NOT has_date")
        .selectExpr(
            KEY, "row_no", "txn_date", "description", "single", "own_debit", "own_credit", "balance", "has_date",
            f"{side} AS side",
        )
        .selectExpr(
            KEY,
            "row_no",
            "txn_date",
            "date_format(txn_date, 'yyyy-MM') AS month",
            "description",
            f"CAST(coalesce(single, {merge_columns('own_debit', 'own_credit')[0]}, 0) AS {MONEY}) AS amount",
            f"CAST(CASE side WHEN 'D' THEN abs(single) WHEN 'own columns' THEN coalesce(own_debit, 0) ELSE 0 END AS {MONEY}) AS debit",
            f"CAST(CASE side WHEN 'C' THEN abs(single) WHEN 'own columns' THEN coalesce(own_credit, 0) ELSE 0 END AS {MONEY})"
            " AS credit_amount",
            "CASE WHEN side = 'D' OR (side = 'own columns' AND coalesce(own_debit > 0, true)) THEN 'DR' ELSE 'CR' END"
            " AS dr_cr_indicator",
            f"CAST(balance AS {MONEY}) AS balance",
            "has_date",
        )
    )


def report_ledger(ledger: DataFrame, layouts: DataFrame | None = None, date_formats: Iterable[str] = DAY_FIRST) -> DataFrame:
    """The second report's view of a typed ledger.

    With ``layouts``, a date or description column that no name gives is looked for
    among the columns without a standard name: the first text column that begins with a
    date, and the first other text column, one whose name does not speak of a date if there is one;
    the ledger is written to the checkpoint folder for that, so that its cells are parsed once.
    Statements without any date column keep their rows.
    """
    if layouts is None:
        rows = ledger.withColumns({"has_date": F.lit(True), "date_": F.col("txn_date"), "text_": F.col("description")})
    else:
        rows = _with_guesses(ledger, layouts, date_formats)
    return _directed(
        rows.selectExpr(
            KEY,
            "row_no",
            "date_ AS txn_date",
            "coalesce(text_, '') AS description",
            "coalesce(amount, transaction_amount) AS single",
            "coalesce(dr_cr_indicator, txn_type) AS mark",
            f"coalesce(debit, {ZERO}) AS own_debit",
            f"coalesce(credit, {ZERO}) AS own_credit",
            "balance",
            "has_date",
        )
    )


def _with_guesses(ledger: DataFrame, layouts: DataFrame, date_formats: Iterable[str]) -> DataFrame:
    """Ledger rows with ``has_date, date_, text_``, found among the ``extra`` columns where the layout has none."""
    ledger = reliable_checkpoint(
        ledger.select(KEY, "row_no", "txn_date", "description", "amount", "transaction_amount", "dr_cr_indicator", "txn_type", "debit", "credit", "balance", "extra")
    )
    has = layouts.selectExpr(
        KEY, "map_contains_key(col_map, 'date') AS named_date", "map_contains_key(col_map, 'description') AS named_text"
    )
    # only statements whose names leave something open are read twice
    extras = ledger.join(has.where("NOT named_date OR NOT named_text"), KEY, "left_semi").where("size(extra) > 0")
    names = extras.groupBy(KEY).agg(F.expr("max(map_keys(extra)) AS names"))
    profile = profile_table(extras.selectExpr(KEY, "row_no", "map_values(extra) AS cells")).join(names, KEY)
    parsed = parse_date("p.first_value", date_formats)
    texts = "filter(profile, p -> NOT p.numeric AND NOT (p.col_pos <=> date_pos))"
    undated = f"filter({texts}, p -> NOT get(names, p.col_pos) RLIKE '(?i)date')"
    guessed = (
        has.join(profile, KEY, "left")
        .withColumn("date_pos", F.expr(f"CASE WHEN NOT named_date THEN get(filter(profile, p -> NOT p.numeric AND {parsed} IS NOT NULL), 0).col_pos END"))
        .selectExpr(
            KEY, "named_date", "named_text", "get(names, date_pos) AS date_name",
            f"get(names, coalesce(get({undated}, 0).col_pos, get({texts}, 0).col_pos)) AS text_name",
        )
    )
    return ledger.join(reliable_checkpoint(guessed), KEY).withColumns(
        {
            "has_date": F.expr("named_date OR date_name IS NOT NULL"),
            "date_": F.expr(f"CASE WHEN named_date THEN txn_date ELSE {parse_date('extra[date_name]', date_formats)} END"),
            "text_": F.expr("CASE WHEN named_text THEN description ELSE extra[text_name] END"),
        }
    )


def profile_table(rows: DataFrame) -> DataFrame:
    """Per statement: the columns of a ready-made table and what their values look like.

    ``profile`` holds, by position: the largest absolute number, whether every
    filled cell is a number, and the first filled cell.
    """
    number = to_number("value", "double")
    figures = (
        rows.selectExpr(KEY, "row_no", "posexplode(cells) AS (col_pos, value)")
        .where(f"value IS NOT NULL AND {strip('value')} <> ''")
        .selectExpr(KEY, "row_no", "col_pos", f"{number} AS number")
        .groupBy(KEY, "col_pos")
        .agg(
            F.expr("max(abs(number)) AS max_abs"),
            F.expr("bool_and(number IS NOT NULL) AS numeric"),
            F.expr("min(row_no) AS row_no"),
        )
    )
    # the first filled cell is read from its row afterwards, so no text is aggregated
    firsts = figures.groupBy(KEY, "row_no").agg(F.expr("collect_list(struct(col_pos, max_abs, numeric)) AS columns"))
    firsts = reliable_checkpoint(firsts)  # a few rows per statement
    return (
        rows.join(firsts, [KEY, "row_no"])
        .selectExpr(KEY, "cells", "inline(columns)")
        .selectExpr(KEY, "col_pos", "max_abs", "numeric", "get(cells, col_pos) AS first_value")
        .groupBy(KEY)
        .agg(F.expr("array_sort(collect_list(struct(col_pos, max_abs, numeric, first_value))) AS profile"))
    )


def table_layouts(rows: DataFrame, tables: DataFrame, date_formats: Iterable[str] = DAY_FIRST) -> DataFrame:
    """Where the second report's columns stand in ready-made tables: positions by name, else guessed from the content."""

    def first(condition: str) -> str:
        return f"get(filter(profile, p -> {condition}), 0).col_pos"

    split = "debit_pos IS NOT NULL AND credit_pos IS NOT NULL"
    plain = "get(header, p.col_pos) RLIKE '(?i)date|^(amount|debit)$'"
    # written first: filters on these columns would be worked out anew for every row the tables are derived from and joined to
    named = reliable_checkpoint(map_by_name(tables))
    # only tables whose column names leave something open are read twice
    unclear = named.where(
        f"date_pos IS NULL OR description_pos IS NULL OR (amount_pos IS NULL AND NOT ({split}))"
    )
    profile = profile_table(rows.join(unclear.select(KEY), KEY, "left_semi"))
    return (
        named.join(profile, KEY, "left")
        .selectExpr(
            KEY,
            f"coalesce(date_pos, {first('NOT p.numeric AND ' + parse_date('p.first_value', date_formats) + ' IS NOT NULL')}) AS date_pos",
            f"coalesce(amount_pos, CASE WHEN NOT ({split}) THEN {first('p.max_abs > 100')} END) AS amount_pos",
            "CASE WHEN amount_pos IS NOT NULL THEN indicator_pos END AS indicator_pos",
            f"CASE WHEN {split} THEN debit_pos END AS debit_pos",
            f"CASE WHEN {split} THEN credit_pos END AS credit_pos",
            f"coalesce(description_pos, {first(f'NOT p.numeric AND NOT {plain}')}) AS description_pos",
            f"{first('NOT p.numeric')} AS any_text_pos",
            "balance_pos",
        )
    )


def rejected_table_cells(rows: DataFrame, layouts: DataFrame, date_formats: Iterable[str] = DAY_FIRST) -> DataFrame:
    """Cells of ready-made tables that give no value: ``statement_id, row_no, column, cell, reason`` (see ``rejected_cells``)."""
    checks = {}
    for name, place in (("date", "date_pos"), ("amount", "amount_pos"), ("debit", "debit_pos"), ("credit", "credit_pos"), ("balance", "balance_pos")):
        cell = f"get(cells, {place})"
        checks[name] = (cell, date_flaw(cell, parse_date(cell, date_formats)) if name == "date" else number_flaw(cell))
    return _flawed(rows.join(layouts, KEY), checks)


def report_ledger_from_table(
    rows: DataFrame, tables: DataFrame, date_formats: Iterable[str] = DAY_FIRST
) -> DataFrame:
    """The second report's ledger from ready-made tables of any column names.

    ``rows`` is ``(statement_id, row_no, cells)`` without the header line and
    ``tables`` is ``(statement_id, header)``.  Columns are found by name; a
    missing date, amount or description column is guessed from the content.
    """
    layouts = reliable_checkpoint(table_layouts(rows, tables, date_formats))

    def cell(position: str) -> str:
        return f"get(cells, {position})"

    def number(position: str) -> str:
        return f"CASE WHEN {position} IS NOT NULL THEN coalesce({to_number(cell(position))}, {ZERO}) END"

    typed = rows.join(layouts, KEY).selectExpr(
        KEY,
        "row_no",
        f"{parse_date(cell('date_pos'), date_formats)} AS txn_date",
        "date_pos IS NOT NULL AS has_date",
        f"CASE WHEN description_pos IS NOT NULL THEN coalesce({cell('description_pos')}, '') END AS description",
        f"coalesce({cell('any_text_pos')}, '') AS any_text",
        f"{to_number(cell('balance_pos'))} AS balance",
        f"{number('amount_pos')} AS single",
        f"CASE WHEN indicator_pos IS NOT NULL THEN coalesce({cell('indicator_pos')}, '') END AS mark",
        f"{number('debit_pos')} AS own_debit",
        f"{number('credit_pos')} AS own_credit",
        "description_pos IS NULL AND amount_pos IS NULL AND debit_pos IS NULL AS any_text_counts",
    )
    directed = _directed(
        typed.withColumn("description", F.expr("CASE WHEN any_text_counts THEN any_text ELSE description END"))
    )
    # a table with money but no text column is described by its own DR/CR column
    return directed.withColumn("description", F.coalesce("description", "dr_cr_indicator"))
