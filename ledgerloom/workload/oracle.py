"""DuckDB SQL for the registered queries, written from the rules and not from the Spark plans.

``PARTS`` are common table expressions; a query pulls in the ones it names.
"""

from __future__ import annotations

import re

from ..operators.grid import (
    AMOUNT_PATTERNS,
    BALANCE_PATTERNS,
    CREDIT_PATTERNS,
    DATE_PATTERNS,
    DEBIT_PATTERNS,
    DESCRIPTION_PATTERNS,
    INDICATOR_PATTERNS,
)
from ..operators.metadata import ACCOUNT, IFSC, NAME, NOT_A_NAME, PERIOD
from ..rules import EXPENSE_RULES, INCOME_RULES, LOAN_WORDS, REPORT_EXPENSE_RULES, REPORT_LOAN_WORDS, RuleSet
from .adapters import BAD_AMOUNT, BAD_DATE, DESCRIPTIONS, FIRST_ROW, LAST_ROW, LONG_AMOUNT, STATEMENT_CUSTOMERS, TABLE_HEADERS


def _text_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def _any(text: str, words) -> str:
    return "(" + " OR ".join(f"contains({text}, '{w}')" for w in words) + ")"


def _case(rules: RuleSet, text: str) -> str:
    cases = " ".join(f"WHEN {_any(text, words)} THEN '{category}'" for category, words in rules.categories)
    return f"CASE {cases} ELSE '{rules.default}' END"


def _rank(rules: RuleSet, column: str) -> str:
    return f"(list_position({_text_list(rules.names())}, {column}) - 1)"


def _money(x: str) -> str:
    return f"round(CAST({x} AS DOUBLE), 2)"


def _cents(x: str) -> str:
    return f"CAST(round(CAST({x} AS DOUBLE) * 100) AS BIGINT)"


def _percent(part: str, whole: str) -> str:
    return f"CASE WHEN {whole} > 0 THEN CAST({part} AS DOUBLE) / CAST({whole} AS DOUBLE) * 100 ELSE 0.0 END"


PARTS: dict[str, str] = {}

PARTS["entry"] = f"""
    SELECT CAST(o_custkey // {STATEMENT_CUSTOMERS} AS VARCHAR) AS statement_id, o_orderkey AS row_no,
        CASE WHEN o_orderkey % 97 <> 0 THEN CAST(o_orderdate AS DATE) END AS txn_date,
        {_text_list(DESCRIPTIONS)}[o_orderkey % 20 + 1] AS description,
        CASE WHEN o_orderkey % 101 = 0 THEN 0
            ELSE (CAST(round(o_totalprice * 100) AS BIGINT) + 50) // 100 END AS used,
        o_orderstatus,
        CASE WHEN o_orderkey % 13 <> 0 THEN (o_orderkey * 7919) % 1000000 END AS balance_cents
    FROM orders"""

PARTS["l"] = """
    SELECT statement_id, row_no, txn_date, strftime(txn_date, '%Y-%m') AS month, description,
        CAST(CASE WHEN o_orderstatus IN ('F', 'P') THEN used ELSE 0 END / 100.0 AS DECIMAL(18,2)) AS debit,
        CAST(CASE WHEN o_orderstatus = 'O' THEN used ELSE 0 END / 100.0 AS DECIMAL(18,2)) AS credit,
        CAST(balance_cents / 100.0 AS DECIMAL(18,2)) AS balance,
        CASE WHEN used = 0 THEN 'unknown' WHEN o_orderstatus IN ('F', 'P') THEN 'debit'
            WHEN o_orderstatus = 'O' THEN 'credit' ELSE 'unknown' END AS txn_type
    FROM entry"""

PARTS["r"] = """
    SELECT statement_id, row_no, txn_date, month, description, debit + credit AS amount,
        CASE WHEN txn_type = 'debit' THEN debit + credit ELSE 0 END AS debit,
        CASE WHEN txn_type = 'credit' THEN debit + credit ELSE 0 END AS credit_amount,
        CASE WHEN txn_type = 'debit' THEN 'DR' ELSE 'CR' END AS dr_cr_indicator, balance
    FROM l WHERE txn_date IS NOT NULL"""

PARTS["ev"] = """
    SELECT CAST(user_id AS VARCHAR) AS statement_id, event_id AS row_no, CAST(ts AS DATE) AS txn_date,
        event_type AS description,
        CAST(CASE WHEN event_type = 'purchase' THEN 0 ELSE round(value * 100) / 100.0 END AS DECIMAL(18,2)) AS debit,
        CAST(CASE WHEN event_type = 'purchase' THEN round(value * 100) / 100.0 ELSE 0 END AS DECIMAL(18,2)) AS credit
    FROM events"""

PARTS["totals"] = """
    SELECT statement_id, count(*) AS total_transactions, min(txn_date) AS start_date, max(txn_date) AS end_date,
        count(DISTINCT month) AS unique_months, count(*) FILTER (txn_type = 'credit') AS credit_count,
        count(*) FILTER (txn_type = 'debit') AS debit_count, sum(credit) AS total_credit, sum(debit) AS total_debit,
        coalesce(arg_min(balance, row_no) FILTER (balance IS NOT NULL), 0) AS opening_balance,
        coalesce(arg_max(balance, row_no) FILTER (balance IS NOT NULL), 0) AS closing_balance
    FROM l GROUP BY statement_id"""

PARTS["months"] = """
    SELECT statement_id, month, count(*) FILTER (txn_type = 'credit') AS credit_count,
        count(*) FILTER (txn_type = 'debit') AS debit_count, sum(credit) AS total_credit, sum(debit) AS total_debit,
        first(balance ORDER BY txn_date, row_no) FILTER (balance IS NOT NULL) AS opening_balance,
        last(balance ORDER BY txn_date, row_no) FILTER (balance IS NOT NULL) AS closing_balance
    FROM l WHERE month IS NOT NULL GROUP BY statement_id, month"""

PARTS["surplus"] = f"""
    SELECT *, income - expenses AS surplus, {_percent('(income - expenses)', 'income')} AS savings_rate
    FROM (SELECT statement_id, month, sum(CASE WHEN dr_cr_indicator = 'CR' THEN credit_amount ELSE 0 END) AS income,
            sum(CASE WHEN dr_cr_indicator = 'DR' THEN debit ELSE 0 END) AS expenses
        FROM r GROUP BY statement_id, month)"""

PARTS["overall"] = f"""
    SELECT statement_id, total_income, total_expenses, total_income - total_expenses AS net_surplus,
        {_percent('(total_income - total_expenses)', 'total_income')} AS overall_savings_rate,
        CAST(total_income AS DOUBLE) / months AS average_monthly_income,
        CAST(total_expenses AS DOUBLE) / months AS average_monthly_expenses
    FROM (SELECT statement_id, sum(income) AS total_income, sum(expenses) AS total_expenses, count(*) AS months
        FROM surplus GROUP BY statement_id)"""

PARTS["cats"] = f"""
    SELECT *, row_number() OVER (PARTITION BY statement_id
        ORDER BY amount DESC, {_rank(EXPENSE_RULES, 'category')}) AS position
    FROM (SELECT statement_id, {_case(EXPENSE_RULES, 'lower(description)')} AS category, sum(debit) AS amount
        FROM l WHERE txn_type = 'debit' GROUP BY ALL) WHERE amount > 0"""

PARTS["rcats"] = f"""
    SELECT *, row_number() OVER (PARTITION BY statement_id
            ORDER BY amount DESC, {_rank(REPORT_EXPENSE_RULES, 'category')}) AS position,
        CAST(amount AS DOUBLE) / CAST(sum(amount) OVER (PARTITION BY statement_id) AS DOUBLE) * 100 AS percentage,
        {_rank(REPORT_EXPENSE_RULES, 'category')} AS rule_order
    FROM (SELECT statement_id, {_case(REPORT_EXPENSE_RULES, 'lower(description)')} AS category, sum(debit) AS amount
        FROM r WHERE dr_cr_indicator = 'DR' GROUP BY ALL) WHERE amount > 0"""

PARTS["sources"] = f"""
    SELECT *, {_rank(INCOME_RULES, 'source')} AS rule_order
    FROM (SELECT statement_id, {_case(INCOME_RULES, 'lower(description)')} AS source, sum(credit) AS amount
        FROM l WHERE credit > 0 GROUP BY ALL) WHERE amount > 0"""

PARTS["income"] = """
    SELECT t.statement_id, t.total_credit AS total_income, m.mean AS average_monthly_income
    FROM totals t LEFT JOIN (SELECT statement_id, avg(CAST(total_credit AS DOUBLE)) AS mean
        FROM months GROUP BY statement_id) m USING (statement_id)"""

PARTS["stats"] = """
    SELECT statement_id, avg(CAST(total_debit AS DOUBLE)) AS average_monthly_spending,
        first(month ORDER BY total_debit DESC, month) AS highest_month, max(total_debit) AS highest_amount,
        first(month ORDER BY total_debit, month) AS lowest_month, min(total_debit) AS lowest_amount
    FROM months GROUP BY statement_id"""

PARTS["large"] = """
    SELECT statement_id, threshold, count(*) AS "count", sum(debit) AS total_amount
    FROM l JOIN (SELECT statement_id, quantile_cont(CAST(debit AS DOUBLE), 0.9) AS threshold
        FROM l GROUP BY statement_id) USING (statement_id)
    WHERE CAST(debit AS DOUBLE) >= threshold GROUP BY statement_id, threshold"""


def _unusual(source: str, multiplier: float) -> str:
    return f"""
    SELECT statement_id, row_no, debit AS amount,
        CASE WHEN std > 0 THEN (CAST(debit AS DOUBLE) - mean) / std ELSE 0.0 END AS deviation_factor,
        description, txn_date AS "date"
    FROM {source} JOIN (SELECT statement_id, avg(CAST(debit AS DOUBLE)) AS mean, stddev_samp(CAST(debit AS DOUBLE)) AS std
        FROM {source} GROUP BY statement_id) USING (statement_id)
    WHERE CAST(debit AS DOUBLE) > mean + {multiplier} * std"""


PARTS["unusual"] = _unusual("ev", 2.5)
PARTS["unusual_1"] = _unusual("ev", 1.0)
PARTS["unusual_l"] = _unusual("l", 2.5)


def _walk(name: str, source: str, tolerance: float, order: str, qualifies: str, words, divisor: str, keep: str) -> None:
    """The ordered walk row by row: pairs for the bands, a recursive step per candidate row."""
    PARTS[f"{name}_c"] = source
    PARTS[f"{name}_m"] = f"""
    SELECT a.statement_id, a.a, sum(b.n) AS members, sum(b.nd) AS nd, min(b.d0) AS first_date, max(b.d1) AS last_date
    FROM (SELECT DISTINCT statement_id, a FROM {name}_c WHERE {keep}) a
    JOIN (SELECT statement_id, a, count(*) AS n, count(txn_date) AS nd, min(txn_date) AS d0, max(txn_date) AS d1
        FROM {name}_c GROUP BY statement_id, a) b
    ON a.statement_id = b.statement_id AND abs(b.a - a.a) / a.a <= {tolerance}
    GROUP BY a.statement_id, a.a"""
    PARTS[f"{name}_q"] = f"""
    SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY {order}) AS i
    FROM (SELECT c.*, m.members, m.first_date, m.last_date, {_any('lower(c.description)', words)} AS likely,
            coalesce(nd >= 2 AND (m.last_date - m.first_date) / nullif(nd - 1, 0) BETWEEN 25 AND 35, false) AS cadence
        FROM {name}_c c JOIN {name}_m m ON c.statement_id = m.statement_id AND c.a = m.a)
    WHERE {qualifies}"""
    PARTS[f"{name}_w"] = f"""
    SELECT DISTINCT statement_id, CAST(0 AS BIGINT) AS i, CAST([] AS DOUBLE[]) AS taken, false AS accepted
    FROM {name}_q
    UNION ALL
    SELECT w.statement_id, q.i,
        CASE WHEN len(list_filter(w.taken, lambda p: abs(q.a - p) / {divisor} <= {tolerance})) > 0
            THEN w.taken ELSE list_append(w.taken, q.a) END,
        len(list_filter(w.taken, lambda p: abs(q.a - p) / {divisor} <= {tolerance})) = 0
    FROM {name}_w w JOIN {name}_q q ON q.statement_id = w.statement_id AND q.i = w.i + 1"""
    PARTS[f"{name}_s"] = f"""
    SELECT q.* FROM {name}_q q JOIN {name}_w w ON q.statement_id = w.statement_id AND q.i = w.i WHERE w.accepted"""


_walk(
    "emi",
    "SELECT statement_id, row_no, txn_date, description, CAST(debit AS DOUBLE) AS a FROM l "
    "WHERE txn_type = 'debit' AND debit >= 1000",
    0.1, "row_no", "members >= 3 AND (likely OR cadence)", LOAN_WORDS, "p", "true",
)
_walk(
    "eve",
    "SELECT statement_id, row_no, txn_date, description, CAST(debit AS DOUBLE) AS a FROM ev "
    "WHERE debit > 0 AND debit >= 20",
    0.02, "row_no", "members >= 2 AND (likely OR cadence)", LOAN_WORDS, "p", "true",
)
_walk(
    "rep",
    "SELECT statement_id, row_no, txn_date, description, CAST(debit AS DOUBLE) AS a FROM r WHERE dr_cr_indicator = 'DR'",
    0.05, "txn_date, row_no",
    "a >= 1000 AND members >= 2 AND (likely OR members >= 3)",
    REPORT_LOAN_WORDS, "greatest(p, 1)", "a >= 1000",
)

_FIRST_REPORT_EMI = """
    SELECT statement_id, row_no, round(a, 2) AS amount, description,
        CASE WHEN cadence THEN 'monthly' ELSE 'unknown' END AS frequency, members AS occurrences,
        CASE WHEN likely AND cadence THEN 'high' ELSE 'medium' END AS confidence, first_date, last_date
    FROM {name}_s"""

PARTS["emi_out"] = _FIRST_REPORT_EMI.format(name="emi")
PARTS["emi_sum"] = "SELECT statement_id, sum(amount) AS total_emi, count(*) AS emi_count FROM emi_out GROUP BY statement_id"
PARTS["rep_out"] = """
    SELECT statement_id, row_no, round(a, 2) AS amount, description, members AS frequency, likely AS likely_emi,
        cadence AND members >= 3 AS regular_pattern,
        CASE WHEN likely AND cadence AND members >= 3 THEN 'High' ELSE 'Medium' END AS confidence,
        round(a * members, 2) AS total_paid, first_date, last_date
    FROM rep_s"""

PARTS["metrics"] = f"""
    SELECT t.statement_id, t.total_credit - t.total_debit AS net_cashflow,
        {_percent('t.total_debit', 't.total_credit')} AS expense_ratio,
        {_percent('(t.total_credit - t.total_debit)', 't.total_credit')} AS savings_rate,
        CASE WHEN i.average_monthly_income > 0
            THEN coalesce(e.total_emi, 0) / i.average_monthly_income * 100 END AS emi_to_income_ratio
    FROM totals t JOIN income i USING (statement_id) LEFT JOIN emi_sum e USING (statement_id)"""

# ---- grids ----

PARTS["ids"] = """
    SELECT statement_id, min(txn_date) AS first_day, max(txn_date) AS last_day FROM entry GROUP BY statement_id"""

# cells of a transaction row that are filled, per layout
PARTS["g"] = f"""
    SELECT statement_id, CAST(statement_id AS BIGINT) % 3 AS layout, row_no + {FIRST_ROW} AS row_no, txn_date,
        month, description, debit, credit, balance, txn_type,
        CASE WHEN txn_date IS NULL THEN 0 ELSE 1 END + 1 + CASE WHEN balance IS NULL THEN 0 ELSE 1 END
            + CASE WHEN txn_type = 'unknown' THEN 0 WHEN CAST(statement_id AS BIGINT) % 3 = 1 THEN 2 ELSE 1 END AS filled
    FROM l"""

PARTS["gl"] = """
    SELECT statement_id, row_no, txn_date, month, description, debit, credit,
        CASE WHEN layout = 1 THEN debit + credit END AS amount, coalesce(balance, 0) AS balance,
        CASE WHEN layout = 1 THEN CASE txn_type WHEN 'debit' THEN 'DR' WHEN 'credit' THEN 'CR' ELSE '' END
        END AS dr_cr_indicator, txn_type, debit + credit AS transaction_amount, layout
    FROM g WHERE filled >= 2"""

PARTS["gmeta"] = """
    SELECT i.statement_id, lpad(i.statement_id, 12, '7') AS account_number,
        'ABCD' || lpad(i.statement_id, 7, '0') AS ifsc_code,
        strftime(first_day, '%d-%m-%Y') AS period_from, strftime(last_day, '%d-%m-%Y') AS period_to,
        'HOLDER ' || translate(i.statement_id, '0123456789', 'ABCDEFGHIJ') AS customer_name,
        CAST(i.statement_id AS BIGINT) * 1000 + 0.5 AS opening_balance, b.closing_balance
    FROM ids i LEFT JOIN (SELECT statement_id, arg_max(balance, row_no) AS closing_balance FROM gl GROUP BY statement_id) b
    USING (statement_id)"""

_GROUPED = "format('{:,.2f}', CAST(%s AS DOUBLE))"
PARTS["glines"] = f"""
    SELECT statement_id, row_no, CASE layout
        WHEN 0 THEN concat(coalesce(strftime(txn_date, '%d-%m-%Y'), ''), '|', description, '|',
            CASE WHEN debit > 0 THEN {_GROUPED % 'debit'} ELSE '' END, '|',
            CASE WHEN credit > 0 THEN {_GROUPED % 'credit'} || ' Cr' ELSE '' END, '|',
            coalesce({_GROUPED % 'balance'}, ''))
        WHEN 1 THEN concat(coalesce(strftime(txn_date, '%d/%m/%Y'), ''), '|', description, '|',
            CASE WHEN debit + credit > 0 THEN {_GROUPED % '(debit + credit)'} ELSE '' END, '|',
            CASE txn_type WHEN 'debit' THEN 'DR' WHEN 'credit' THEN 'CR' ELSE '' END, '|',
            coalesce({_GROUPED % 'balance'}, ''))
        ELSE concat(description, '|', coalesce(strftime(txn_date, '%Y-%m-%d'), ''), '|',
            CASE WHEN credit > 0 THEN {_GROUPED % 'credit'} || ' Cr' ELSE '' END, '|',
            CASE WHEN debit > 0 THEN {_GROUPED % 'debit'} ELSE '' END, '|',
            coalesce({_GROUPED % 'balance'} || ' Dr', ''))
        END AS line
    FROM g WHERE filled >= 2"""

PARTS["gquality"] = """
    SELECT statement_id, total_rows, columns AS column_count, essential AS essential_found,
        essential / 5 * 50 + (100 - missing / total_rows * 100 / columns) / 100 * 50 AS quality_score
    FROM (SELECT statement_id, count(*) AS total_rows, CASE WHEN any_value(layout) = 1 THEN 10 ELSE 8 END AS columns,
            CASE WHEN any_value(layout) = 1 THEN 5 ELSE 4 END AS essential,
            2 * count(*) FILTER (txn_date IS NULL) + count(*) FILTER (dr_cr_indicator = '') AS missing
        FROM gl GROUP BY statement_id)"""

# ---- ready-made tables ----


def _position(names: list[str], patterns: str, skip: str = "") -> str:
    for pattern in patterns.split(", "):
        for i, name in enumerate(names):
            if pattern in name.strip().lower() and not (skip and skip in name.lower()):
                return str(i)
    return "CAST(NULL AS INTEGER)"


def _table_mapping() -> str:
    selects = []
    for kind, names in enumerate(TABLE_HEADERS):
        amount = _position(names, AMOUNT_PATTERNS)
        split = amount.startswith("CAST")
        none = "CAST(NULL AS INTEGER)"
        columns = {
            "date_pos": _position(names, DATE_PATTERNS),
            "amount_pos": amount,
            "debit_pos": _position(names, DEBIT_PATTERNS, "balance") if split else none,
            "credit_pos": _position(names, CREDIT_PATTERNS, "balance") if split else none,
            "description_pos": _position(names, DESCRIPTION_PATTERNS),
            "balance_pos": _position(names, BALANCE_PATTERNS),
            "indicator_pos": _position(names, INDICATOR_PATTERNS),
        }
        cells = ", ".join(f"{v} AS {k}" for k, v in columns.items())
        selects.append(f"SELECT statement_id, {cells} FROM ids WHERE CAST(statement_id AS BIGINT) % 4 = {kind}")
    return " UNION ALL ".join(selects)


PARTS["t"] = "SELECT *, CAST(statement_id AS BIGINT) % 4 AS kind FROM l"
PARTS["tl"] = """
    SELECT statement_id, row_no, txn_date, month,
        CASE WHEN kind = 3 THEN strftime(txn_date, '%Y-%m-%d') ELSE description END AS description,
        CASE WHEN kind = 0 THEN debit + credit ELSE credit - debit END AS amount, debit,
        credit AS credit_amount, CASE WHEN debit > 0 THEN 'DR' ELSE 'CR' END AS dr_cr_indicator,
        CASE WHEN kind = 3 THEN NULL ELSE balance END AS balance
    FROM t WHERE txn_date IS NOT NULL"""

# ---- documents ----

PARTS["doc"] = "SELECT CAST(doc_id AS VARCHAR) AS statement_id, upper(replace(text, chr(10), ' ')) AS t FROM documents"


def _match(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(t, '{pattern}', {group}), '')"


def _document_accounts() -> str:
    first, second = PERIOD.values()
    names = []
    for pattern in NAME.values():
        name = f"trim(regexp_extract(t, '{pattern}', 1))"
        names.append(f"CASE WHEN length({name}) > 3 AND NOT regexp_matches({name}, '{NOT_A_NAME}') THEN {name} END")
    periods = [
        f"CASE WHEN regexp_matches(t, '{first}') THEN {_match(first, g)} ELSE {_match(second, g)} END" for g in (1, 2)
    ]
    return f"""
    SELECT statement_id, coalesce({', '.join(_match(p) for p in ACCOUNT.values())}) AS account_number,
        {_match(IFSC['ifsc'])} AS ifsc_code, {periods[0]} AS period_from, {periods[1]} AS period_to,
        coalesce({', '.join(names)}) AS customer_name
    FROM doc"""


# ---- text report ----

_CURRENCY = "'₹' || " + _GROUPED
PARTS["report_base"] = """
    SELECT s.*, c.cr, c.dr, c.n, e.eod, k.category, k.amount, k.percentage
    FROM overall s JOIN (SELECT statement_id, count(*) FILTER (dr_cr_indicator = 'CR') AS cr,
            count(*) FILTER (dr_cr_indicator = 'DR') AS dr, count(*) AS n FROM r GROUP BY statement_id) c USING (statement_id)
    JOIN eod e USING (statement_id) JOIN biggest k USING (statement_id)"""
PARTS["eod"] = """
    SELECT statement_id, coalesce(last(balance ORDER BY txn_date, row_no) FILTER (balance IS NOT NULL),
        sum(credit_amount) - sum(debit)) AS eod FROM r GROUP BY statement_id"""
PARTS["biggest"] = """
    SELECT i.statement_id, coalesce(c.category, 'None') AS category, coalesce(c.amount, 0) AS amount, c.percentage
    FROM (SELECT DISTINCT statement_id FROM r) i LEFT JOIN (SELECT * FROM rcats WHERE position = 1) c USING (statement_id)"""


def _text_report() -> str:
    titles = [
        (0, "TRANSACTION SUMMARY"), (2, "MONTHLY EXPENSES"), (3, "EXPENSE CATEGORIES"), (4, "HIGHEST EXPENSE CATEGORY"),
        (5, "MONTHLY SURPLUS ANALYSIS"), (6, "EMI/RECURRING PAYMENTS ANALYSIS"), (7, "OVERALL SUMMARY"),
    ]
    lines = [f"SELECT statement_id, {s} AS section, 0 AS line_no, '{t}' AS text FROM report_base" for s, t in titles]
    fixed = [
        (0, 1, "'Credit Transactions: ' || cr"),
        (0, 2, "'Debit Transactions:  ' || dr"),
        (0, 3, "'Total Transactions:  ' || n"),
        (1, 0, f"'End of Day Balance: ' || {_CURRENCY % 'eod'}"),
        (4, 1, "'Category: ' || category"),
        (4, 2, f"'Amount: ' || {_CURRENCY % 'amount'}"),
        (4, 3, "'Percentage: ' || coalesce(printf('%.1f', percentage) || '%', 'n/a') || ' of total expenses'"),
        (7, 1, f"'Total Income:           ' || {_CURRENCY % 'total_income'}"),
        (7, 2, f"'Total Expenses:         ' || {_CURRENCY % 'total_expenses'}"),
        (7, 3, f"'Net Surplus:            ' || {_CURRENCY % 'net_surplus'}"),
        (7, 4, "'Overall Savings Rate:   ' || printf('%.1f', overall_savings_rate) || '%'"),
        (7, 5, f"'Avg Monthly Income:     ' || {_CURRENCY % 'average_monthly_income'}"),
        (7, 6, f"'Avg Monthly Expenses:   ' || {_CURRENCY % 'average_monthly_expenses'}"),
    ]
    lines += [f"SELECT statement_id, {s}, {n}, {text} FROM report_base" for s, n, text in fixed]
    by_month = "row_number() OVER (PARTITION BY statement_id ORDER BY month)"
    lines += [
        f"SELECT statement_id, 2, {by_month}, month || ': ' || {_CURRENCY % 'expenses'} FROM surplus",
        f"SELECT statement_id, 3, position, rpad(category, 25, ' ') || ': ₹' || lpad({_GROUPED % 'amount'}, "
        f"CAST(greatest(10, length({_GROUPED % 'amount'})) AS INTEGER), ' ') || ' (' || lpad(printf('%.1f', percentage) || '%', 6, ' ') || ')' FROM rcats",
        f"SELECT statement_id, 5, {by_month}, month || ' | ' || {_CURRENCY % 'income'} || ' | ' || {_CURRENCY % 'expenses'}"
        f" || ' | ' || {_CURRENCY % 'surplus'} || ' | ' || printf('%.1f', savings_rate) || '%' FROM surplus",
        "SELECT statement_id, 6, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, row_no), "
        f"{_CURRENCY % 'amount'} || ' | ' || CASE WHEN length(description) > 50 THEN substr(description, 1, 50) || '...' "
        f"ELSE description END || ' | ' || frequency || ' times | ' || confidence || ' | ' || {_CURRENCY % 'total_paid'} FROM rep_out",
        f"SELECT statement_id, 6, count(*) + 1, 'Total Monthly EMI/Recurring: ' || {_CURRENCY % 'sum(amount)'} FROM rep_out GROUP BY statement_id",
        "SELECT statement_id, 6, 1, 'No recurring EMI patterns detected.' FROM report_base WHERE statement_id NOT IN "
        "(SELECT statement_id FROM rep_out)",
    ]
    union = " UNION ALL ".join(lines)
    return f"SELECT statement_id, section, CAST(line_no AS INTEGER) AS line_no, text FROM ({union})"


def _with_parts(final: str) -> str:
    """Prefix a query with the parts it names, directly or through other parts."""
    needed: list[str] = []

    def visit(sql: str) -> None:
        for name in PARTS:
            if name not in needed and re.search(rf"\b(FROM|JOIN)\s+{name}\b", sql):
                needed.append(name)
                visit(PARTS[name])

    visit(final)
    order: list[str] = []

    def place(name: str) -> None:
        if name in order:
            return
        for other in needed:
            if other != name and re.search(rf"\b(FROM|JOIN)\s+{other}\b", PARTS[name]):
                place(other)
        order.append(name)

    for name in needed:
        place(name)
    parts = ",\n".join(f"{name} AS ({PARTS[name]})" for name in order)
    return f"WITH RECURSIVE {parts}\n{final}" if parts else final


_QUERIES: dict[str, str] = {
    "typed_ledger": f"""SELECT statement_id, row_no, txn_date, month, description, {_money('debit')} AS debit,
        {_money('credit')} AS credit, {_money('balance')} AS balance, txn_type,
        {_money('debit + credit')} AS transaction_amount FROM l""",
    "report_ledger": f"""SELECT statement_id, row_no, txn_date, month, description, {_money('amount')} AS amount,
        {_money('debit')} AS debit, {_money('credit_amount')} AS credit_amount, dr_cr_indicator,
        {_money('balance')} AS balance FROM r""",
    "display_ledger": f"""SELECT statement_id, row_no, {_CURRENCY % 'debit'} AS debit, {_CURRENCY % 'credit'} AS credit,
        coalesce({_CURRENCY % 'balance'}, '') AS balance, '' AS amount,
        CASE WHEN length(description) > 12 THEN substr(description, 1, 12) || '...' ELSE description END AS short_text
        FROM l""",
    "transaction_summary": f"""SELECT * REPLACE ({_money('total_credit')} AS total_credit, {_money('total_debit')} AS total_debit,
        {_money('opening_balance')} AS opening_balance, {_money('closing_balance')} AS closing_balance) FROM totals""",
    "exported_workbook": f"""SELECT statement_id, month, credit_count, debit_count, {_money('total_credit')} AS total_credit,
        {_money('total_debit')} AS total_debit, {_money('total_credit - total_debit')} AS net_flow,
        {_money('opening_balance')} AS opening_balance, {_money('closing_balance')} AS closing_balance FROM months""",
    "monthly_summary": f"""SELECT statement_id, month, credit_count, debit_count, {_money('total_credit')} AS total_credit,
        {_money('total_debit')} AS total_debit, {_money('total_credit - total_debit')} AS net_flow,
        {_money('opening_balance')} AS opening_balance, {_money('closing_balance')} AS closing_balance FROM months""",
    "monthly_balance_surplus": f"""SELECT statement_id, month, {_money('total_credit')} AS income,
        {_money('total_debit')} AS expenses, {_money('total_credit - total_debit')} AS surplus,
        coalesce({_money('opening_balance')}, 0) AS opening_balance,
        coalesce({_money('closing_balance')}, 0) AS closing_balance FROM months""",
    "direction_counts": """SELECT statement_id, count(*) FILTER (dr_cr_indicator = 'CR') AS credit_transactions,
        count(*) FILTER (dr_cr_indicator = 'DR') AS debit_transactions, count(*) AS total_transactions
        FROM r GROUP BY statement_id""",
    "end_balance": f"SELECT statement_id, {_money('eod')} AS eod_balance FROM eod",
    "monthly_expenses": f"SELECT statement_id, month, {_money('expenses')} AS expenses FROM surplus",
    "monthly_surplus": f"""SELECT statement_id, month, {_money('income')} AS income, {_money('expenses')} AS expenses,
        {_money('surplus')} AS surplus, round(savings_rate, 6) AS savings_rate FROM surplus""",
    "overall_summary": f"""SELECT statement_id, {_money('total_income')} AS total_income,
        {_money('total_expenses')} AS total_expenses, {_money('net_surplus')} AS net_surplus,
        round(overall_savings_rate, 6) AS overall_savings_rate,
        round(average_monthly_income, 6) AS average_monthly_income,
        round(average_monthly_expenses, 6) AS average_monthly_expenses FROM overall""",
    "expense_categories": f"SELECT statement_id, category, {_money('amount')} AS amount, position FROM cats",
    "top_expenses": f"SELECT statement_id, category, {_money('amount')} AS amount, position FROM cats WHERE position <= 5",
    "report_expense_categories": f"""SELECT statement_id, category, {_money('amount')} AS amount, position,
        round(percentage, 6) AS percentage FROM rcats""",
    "largest_category": f"""SELECT statement_id, category, {_money('amount')} AS amount,
        round(percentage, 6) AS percentage FROM biggest""",
    "categories_by_table": f"SELECT statement_id, category, {_money('amount')} AS amount FROM cats",
    "income_summary": f"""SELECT statement_id, {_money('total_income')} AS total_income,
        round(average_monthly_income, 6) AS average_monthly_income FROM income""",
    "monthly_income": f"SELECT statement_id, month, {_money('total_credit')} AS income FROM months",
    "income_sources": f"SELECT statement_id, source, {_money('amount')} AS amount FROM sources",
    "monthly_spending_stats": f"""SELECT statement_id, round(average_monthly_spending, 6) AS average_monthly_spending,
        highest_month, {_money('highest_amount')} AS highest_amount, lowest_month,
        {_money('lowest_amount')} AS lowest_amount FROM stats""",
    "weekday_spending": f"""SELECT statement_id, dayname(txn_date) AS day_of_week, {_money('sum(debit)')} AS amount
        FROM l WHERE txn_date IS NOT NULL GROUP BY ALL""",
    "large_transactions": f"""SELECT statement_id, round(threshold, 6) AS threshold, "count",
        {_money('total_amount')} AS total_amount FROM large""",
    "sketched_large_transactions": """SELECT * FROM (
        WITH c AS (SELECT statement_id, CAST(round(debit * 100) AS BIGINT) AS v FROM l WHERE debit IS NOT NULL),
        b AS (SELECT statement_id, sign(v) * (length(CAST(abs(v) AS VARCHAR)) * 1000
                + CAST(rpad(left(CAST(abs(v) AS VARCHAR), 3), 3, '0') AS BIGINT)) AS bucket, v FROM c),
        r AS (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY v) - 1 AS place,
                avg(CAST(v AS DOUBLE)) OVER (PARTITION BY statement_id, bucket) / 100 AS mean,
                0.9::DOUBLE * (count(*) OVER (PARTITION BY statement_id) - 1) AS wanted FROM b),
        p AS (SELECT statement_id, max(mean) FILTER (place = floor(wanted)) AS low_mean,
                max(bucket) FILTER (place = floor(wanted)) AS low_bucket,
                max(mean) FILTER (place = ceil(wanted)) AS high_mean,
                max(bucket) FILTER (place = ceil(wanted)) AS high_bucket,
                max(wanted - floor(wanted)) AS fraction, count(*) AS all_n FROM r GROUP BY ALL),
        t AS (SELECT *, low_mean + (high_mean - low_mean) * fraction AS threshold FROM p)
        SELECT statement_id, round(t.threshold, 6) AS threshold, count(*) AS "count",
            round(CAST(sum(v) AS DOUBLE) / 100, 2) AS total_amount,
            round(abs(count(*) - any_value(large."count")) / any_value(all_n), 9) AS rank_error
        FROM b JOIN t USING (statement_id) JOIN large USING (statement_id)
        WHERE bucket >= CASE WHEN t.threshold <= low_mean THEN low_bucket ELSE high_bucket END
        GROUP BY statement_id, t.threshold)""",
    "unusual_transactions": f"""SELECT statement_id, row_no, {_money('amount')} AS amount,
        round(deviation_factor, 6) AS deviation_factor, description, "date" FROM unusual""",
    "top_unusual_transactions": f"""SELECT statement_id, row_no, {_money('amount')} AS amount,
        round(deviation_factor, 6) AS deviation_factor, description, "date", position, unusual_count
        FROM (SELECT *, row_number() OVER (PARTITION BY statement_id ORDER BY amount DESC, row_no) AS position,
            count(*) OVER (PARTITION BY statement_id) AS unusual_count FROM unusual_1) WHERE position <= 10""",
    "recurring_payments": "SELECT * FROM emi_out",
    "recurring_payments_events": _FIRST_REPORT_EMI.format(name="eve"),
    "report_recurring_payments": "SELECT * FROM rep_out",
    "recurring_totals": "SELECT statement_id, round(total_emi, 2) AS total_emi, emi_count FROM emi_sum",
    "payment_gaps": """
        SELECT statement_id, amount, count(*) AS payments, round(avg(gap), 6) AS mean_gap,
            coalesce(avg(gap) BETWEEN 25 AND 35, false) AS is_monthly
        FROM (SELECT CAST(user_id AS VARCHAR) AS statement_id, floor(value) AS amount,
                floor(date_diff('microsecond', lag(ts) OVER (PARTITION BY user_id, floor(value) ORDER BY ts), ts)
                    / 86400000000.0) AS gap
            FROM events WHERE floor(value) > 0) GROUP BY statement_id, amount""",
    "financial_metrics": f"""SELECT statement_id, {_money('net_cashflow')} AS net_cashflow,
        round(expense_ratio, 6) AS expense_ratio, round(savings_rate, 6) AS savings_rate,
        round(emi_to_income_ratio, 6) AS emi_to_income_ratio FROM metrics""",
    "header_rows": "SELECT statement_id, CAST(3 AS BIGINT) AS header_row_no, 5 AS n_cols FROM ids",
    "odd_headers": """SELECT statement_id,
        CAST(CASE CAST(statement_id AS BIGINT) % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 END AS BIGINT) AS header_row_no,
        CASE CAST(statement_id AS BIGINT) % 3 WHEN 0 THEN 'tran date|particulars|debit|debit_1|balance'
            WHEN 1 THEN 'booked date|what|sum|col_3|col_4' ELSE '0|1|2|3|4' END AS header FROM ids""",
    "undated_expenses": f"""SELECT statement_id, CASE WHEN CAST(statement_id AS BIGINT) % 2 = 1 THEN 'Total' ELSE month END AS month,
        {_money("sum(CASE WHEN txn_type = 'debit' THEN debit ELSE 0 END)")} AS expenses
        FROM l WHERE CAST(statement_id AS BIGINT) % 2 = 1 OR txn_date IS NOT NULL GROUP BY ALL""",
    "layout_names": """SELECT statement_id, CASE CAST(statement_id AS BIGINT) % 3
            WHEN 0 THEN 'tran date|particulars|debit|credit|balance'
            WHEN 1 THEN 'value date|narration|amount(inr)|dr/cr|balance(inr)'
            ELSE 'description|booked on|deposit money|withdrawal money|running balance amount' END AS header,
        CASE CAST(statement_id AS BIGINT) % 3 WHEN 0 THEN 'date|description|debit|credit|balance'
            WHEN 1 THEN 'date|description|amount|dr_cr_indicator|balance'
            ELSE 'description|date|credit|debit|balance' END AS names FROM ids""",
    "column_profile": """
        SELECT statement_id, pos AS col_pos, count(*) AS n,
            count(*) FILTER (pos = 1 AND txn_date IS NOT NULL) AS n_date,
            count(*) FILTER (CASE pos WHEN 1 THEN txn_date IS NOT NULL WHEN 2 THEN credit > 0
                WHEN 3 THEN debit > 0 ELSE balance IS NOT NULL END) AS n_amount
        FROM g, (SELECT unnest([1, 2, 3, 4]) AS pos) WHERE layout = 2 AND filled >= 2 GROUP BY statement_id, pos""",
    "transaction_rows": "SELECT statement_id, row_no, line FROM glines",
    "exported_grid": "SELECT statement_id, row_no, line FROM glines",
    "quoted_line_breaks": """SELECT coalesce(source, 'none') AS statement_id, doc_id,
        length(t) AS n_chars, md5(t) AS text_md5
        FROM (SELECT *, replace(coalesce(text, ''), chr(13) || chr(10), chr(10)) AS t FROM documents)""",
    "exported_ledger": f"""SELECT statement_id, row_no, txn_date, description, {_money('debit')} AS debit,
        {_money('credit')} AS credit, 'T' || (row_no % 7) AS teller, 1 AS n_extra FROM l""",
    "grid_ledger": f"""SELECT statement_id, row_no, txn_date, month, description, {_money('debit')} AS debit,
        {_money('credit')} AS credit, {_money('amount')} AS amount, {_money('balance')} AS balance, dr_cr_indicator,
        txn_type, {_money('transaction_amount')} AS transaction_amount FROM gl""",
    "grid_metadata": f"""SELECT statement_id, account_number, ifsc_code, period_from, period_to, customer_name,
        {_money('opening_balance')} AS opening_balance, {_money('closing_balance')} AS closing_balance FROM gmeta""",
    "document_accounts": _document_accounts(),
    "frame_layouts": """SELECT statement_id, CAST(NULL AS BIGINT) AS header_row_no,
        'o_custkey|o_orderstatus|o_totalprice|date|o_orderpriority' AS names FROM ids""",
    "page_rows": f"""
        SELECT statement_id, CAST(start_row + page_row AS BIGINT) AS row_no,
            description || '|' || CASE WHEN page_no % 3 = 0 THEN '' ELSE {_GROUPED % 'debit'} END AS line
        FROM (SELECT *, row_no // 40 AS page_no, row_no % 40 AS page_row FROM l) l
        JOIN (SELECT statement_id, page_no, coalesce(sum(n) OVER (PARTITION BY statement_id ORDER BY page_no
                ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start_row
            FROM (SELECT statement_id, row_no // 40 AS page_no, max(row_no % 40) + 1 AS n FROM l GROUP BY ALL))
        USING (statement_id, page_no)""",
    "clean_amounts": """SELECT l_orderkey, l_linenumber, round(l_extendedprice, 2) AS cleaned,
        CASE WHEN l_extendedprice < 1000 THEN round(l_extendedprice, 2) ELSE 0 END AS coerced FROM lineitem""",
    "parsed_dates": """SELECT l_orderkey, l_linenumber, CASE
            WHEN l_orderkey % 6 < 5 THEN CAST(l_shipdate AS DATE)
            WHEN day(l_shipdate) <= 12 THEN make_date(year(l_shipdate), day(l_shipdate), month(l_shipdate)) END AS parsed
        FROM lineitem""",
    "amount_splits": """
        SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN a ELSE 0 END AS mark_debit,
            CASE WHEN o_orderstatus = 'O' THEN a ELSE 0 END AS mark_credit,
            CASE WHEN o_orderstatus = 'F' AND a > 0 THEN 'debit' WHEN o_orderstatus = 'O' AND a > 0 THEN 'credit'
                ELSE 'unknown' END AS mark_type,
            CASE WHEN o_orderstatus = 'F' THEN abs(a) ELSE 0 END AS prefix_debit,
            CASE WHEN o_orderstatus = 'O' THEN abs(a) ELSE 0 END AS prefix_credit,
            CASE WHEN o_orderstatus = 'F' THEN 'DR' ELSE 'CR' END AS prefix_label,
            CASE WHEN a < 0 THEN -a ELSE 0 END AS sign_debit, CASE WHEN a > 0 THEN a ELSE 0 END AS sign_credit,
            CASE WHEN a < 0 THEN 'DR' ELSE 'CR' END AS sign_label, a AS merged_amount,
            CASE WHEN a < 0 THEN 'DR' ELSE 'CR' END AS merged_label
        FROM (SELECT o_orderkey, o_orderstatus, round((round(o_totalprice * 100) - 10000000) / 100, 2) AS a FROM orders)""",
    "table_mapping": _table_mapping(),
    "table_ledger": f"""SELECT statement_id, row_no, txn_date, month, description, {_money('amount')} AS amount,
        {_money('debit')} AS debit, {_money('credit_amount')} AS credit_amount, dr_cr_indicator,
        {_money('balance')} AS balance FROM tl""",
    "inferred_dates": "SELECT statement_id, row_no, txn_date FROM l",
    "rejected_cells": f"""
        SELECT statement_id, row_no, 'date' AS "column", '{BAD_DATE}' AS cell, 'not a date' AS reason FROM l WHERE row_no % 227 = 0
        UNION ALL SELECT statement_id, row_no, 'debit', '{LONG_AMOUNT}', 'too long' FROM l WHERE row_no % 211 = 0
        UNION ALL SELECT statement_id, row_no, 'debit', '{BAD_AMOUNT}', 'not a number' FROM l WHERE row_no % 223 = 0 AND row_no % 211 <> 0""",
    "flawed_ledger": f"""SELECT statement_id, row_no, CASE WHEN row_no % 227 <> 0 THEN txn_date END AS txn_date,
        CASE WHEN row_no % 211 = 0 OR row_no % 223 = 0 THEN 0 ELSE {_money('debit')} END AS debit, {_money('credit')} AS credit FROM l""",
    "grid_column_types": """
        SELECT statement_id, total_rows, "column", missing_count, round(missing_count / total_rows * 100, 6) AS missing_percentage,
            CASE "column" WHEN 'date' THEN 'date' WHEN 'teller' THEN 'bigint' WHEN 'rate' THEN 'decimal' WHEN 'seen' THEN 'date'
                WHEN 'debit' THEN 'decimal(28,2)' WHEN 'credit' THEN 'decimal(28,2)' WHEN 'transaction_amount' THEN 'decimal(28,2)'
                ELSE 'string' END AS data_type
        FROM (SELECT statement_id, count(*) AS total_rows, count(*) FILTER (txn_date IS NULL OR row_no % 227 = 0) AS "date",
                count(*) FILTER (row_no % 3 = 0) AS teller, count(*) FILTER (txn_date IS NULL OR row_no % 227 = 0) AS month_year,
                CAST(0 AS BIGINT) AS description, CAST(0 AS BIGINT) AS debit, CAST(0 AS BIGINT) AS credit, CAST(0 AS BIGINT) AS rate,
                CAST(0 AS BIGINT) AS seen, CAST(0 AS BIGINT) AS "remark code", CAST(0 AS BIGINT) AS "type", CAST(0 AS BIGINT) AS transaction_amount
            FROM l GROUP BY statement_id)
        UNPIVOT (missing_count FOR "column" IN ("date", teller, month_year, description, debit, credit, rate, seen, "remark code", "type", transaction_amount))""",
    "unnamed_report": f"""
        SELECT statement_id, row_no, CASE WHEN dated THEN txn_date END AS txn_date, CASE WHEN dated THEN month END AS month,
            CASE WHEN dated THEN description ELSE 'N' || row_no END AS description, {_money('debit + credit')} AS amount,
            CASE WHEN txn_type = 'debit' THEN {_money('debit')} ELSE 0 END AS debit,
            CASE WHEN txn_type = 'credit' THEN {_money('credit')} ELSE 0 END AS credit_amount,
            CASE WHEN txn_type = 'debit' THEN 'DR' ELSE 'CR' END AS dr_cr_indicator, coalesce({_money('balance')}, 0) AS balance
        FROM (SELECT *, CAST(statement_id AS BIGINT) % 2 = 1 AS dated FROM l) WHERE txn_date IS NOT NULL OR NOT dated""",
    "table_rejects": """
        SELECT statement_id, row_no, 'balance' AS "column", CASE row_no % 199 WHEN 0 THEN '1,250.00 Cr' ELSE repeat('9', 30) END AS cell,
            CASE row_no % 199 WHEN 0 THEN 'not a number' ELSE 'too long' END AS reason
        FROM l WHERE row_no % 199 < 2 AND CAST(statement_id AS BIGINT) % 4 <> 3""",
    "moneyless_ledger": """
        SELECT statement_id, row_no, txn_date, month, description, 0.0 AS amount, 0.0 AS debit, 0.0 AS credit_amount,
            'DR' AS dr_cr_indicator, CAST(NULL AS DOUBLE) AS balance
        FROM l WHERE txn_date IS NOT NULL""",
    "exported_csv": "SELECT statement_id, line FROM glines",
    "recurring_members": """
        SELECT statement_id, seed_row_no, row_no, txn_date, round(a, 2) AS amount,
            CASE WHEN txn_date IS NOT NULL THEN txn_date - lag(txn_date) OVER (PARTITION BY statement_id, seed_row_no ORDER BY txn_date NULLS LAST, row_no) END AS gap_days
        FROM (SELECT s.statement_id, s.row_no AS seed_row_no, c.row_no, c.txn_date, c.a
            FROM emi_s s JOIN emi_c c ON c.statement_id = s.statement_id AND abs(c.a - s.a) / s.a <= 0.1)""",
    "column_quality": """
        SELECT statement_id, total_rows, "column", missing_count,
            CASE WHEN "column" = 'date' THEN 'date' WHEN "column" IN ('debit', 'credit', 'balance', 'transaction_amount') THEN 'decimal(28,2)' ELSE 'string' END AS data_type,
            round(missing_count / total_rows * 100, 6) AS missing_percentage
        FROM (SELECT statement_id, count(*) AS total_rows,
                count(*) FILTER (txn_date IS NULL) AS "date", CAST(0 AS BIGINT) AS description, CAST(0 AS BIGINT) AS debit,
                CAST(0 AS BIGINT) AS credit, count(*) FILTER (balance IS NULL) AS balance, CAST(0 AS BIGINT) AS "type",
                count(*) FILTER (month IS NULL) AS month_year, CAST(0 AS BIGINT) AS transaction_amount
            FROM l GROUP BY statement_id)
        UNPIVOT (missing_count FOR "column" IN ("date", description, debit, credit, balance, "type", month_year, transaction_amount))""",
    "grid_quality": "SELECT * REPLACE (round(quality_score, 6) AS quality_score) FROM gquality",
    "insights_sections": f"""
        SELECT t.statement_id, m.months, m.surplus, c.categories, w.weekdays, i.sources, e.emis
        FROM totals t
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', month, credit_count, debit_count, {_cents('total_credit')},
                {_cents('total_debit')}, {_cents('opening_balance')}, {_cents('closing_balance')}), '|' ORDER BY month) AS months,
            string_agg(concat_ws(' ', month, {_cents('(total_credit - total_debit)')}), '|' ORDER BY month) AS surplus
            FROM months GROUP BY statement_id) m USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', category, {_cents('amount')}), '|' ORDER BY position) AS categories
            FROM cats GROUP BY statement_id) c USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', d, {_cents('amount')}), '|' ORDER BY d) AS weekdays
            FROM (SELECT statement_id, dayname(txn_date) AS d, sum(debit) AS amount FROM l WHERE txn_date IS NOT NULL GROUP BY ALL)
            GROUP BY statement_id) w USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', source, {_cents('amount')}), '|' ORDER BY rule_order) AS sources
            FROM sources GROUP BY statement_id) i USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', {_cents('amount')}, frequency, occurrences, first_date, last_date), '|'
                ORDER BY amount DESC, row_no) AS emis
            FROM emi_out GROUP BY statement_id) e USING (statement_id)""",
    "report_sections": f"""
        SELECT b.statement_id, n.months, c.categories, e.emis
        FROM report_base b
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', month, {_cents('income')}, {_cents('expenses')}), '|' ORDER BY month) AS months
            FROM surplus GROUP BY statement_id) n USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', category, {_cents('amount')}), '|' ORDER BY rule_order) AS categories
            FROM rcats GROUP BY statement_id) c USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(concat_ws(' ', {_cents('amount')}, frequency, confidence, {_cents('total_paid')}), '|'
                ORDER BY amount DESC, row_no) AS emis
            FROM rep_out GROUP BY statement_id) e USING (statement_id)""",
    "insights_overview": f"""
        SELECT t.statement_id, t.total_transactions, {_money('t.opening_balance')} AS opening_balance,
            {_money('m.net_cashflow')} AS net_cashflow, round(m.savings_rate, 6) AS savings_rate,
            round(m.emi_to_income_ratio, 6) AS emi_to_income_ratio, n.months, c.top_expenses, s.highest_month,
            g."count" AS large_count, w.weekdays, i.income_sources, coalesce(e.total_emi, 0) AS total_emi,
            coalesce(e.emi_count, 0) AS emi_count, coalesce(u.n, 0) AS unusual_count
        FROM totals t JOIN metrics m USING (statement_id)
        LEFT JOIN (SELECT statement_id, CAST(count(*) AS INTEGER) AS months FROM months GROUP BY statement_id) n USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(category, '|' ORDER BY position) AS top_expenses
            FROM cats WHERE position <= 5 GROUP BY statement_id) c USING (statement_id)
        LEFT JOIN stats s USING (statement_id)
        LEFT JOIN large g USING (statement_id)
        LEFT JOIN (SELECT statement_id, CAST(count(DISTINCT dayname(txn_date)) AS INTEGER) AS weekdays FROM l GROUP BY statement_id) w
            USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(source, '|' ORDER BY rule_order) AS income_sources
            FROM sources GROUP BY statement_id) i USING (statement_id)
        LEFT JOIN emi_sum e USING (statement_id)
        LEFT JOIN (SELECT statement_id, count(*) AS n FROM unusual_l GROUP BY statement_id) u USING (statement_id)""",
    "report_overview": f"""
        SELECT b.statement_id, b.cr AS credit_transactions, {_money('b.eod')} AS eod_balance, n.months, c.categories,
            b.category, e.emi_count, {_money('b.net_surplus')} AS net_surplus,
            round(b.overall_savings_rate, 6) AS overall_savings_rate
        FROM report_base b
        LEFT JOIN (SELECT statement_id, CAST(count(*) AS INTEGER) AS months FROM surplus GROUP BY statement_id) n USING (statement_id)
        LEFT JOIN (SELECT statement_id, string_agg(category, '|' ORDER BY rule_order) AS categories
            FROM rcats GROUP BY statement_id) c USING (statement_id)
        LEFT JOIN (SELECT statement_id, CAST(count(*) AS INTEGER) AS emi_count FROM rep_out GROUP BY statement_id) e USING (statement_id)""",
    "text_report": _text_report(),
    "exported_report": f"SELECT statement_id, text FROM ({_text_report()})",
    "chart_monthly_table": f"""SELECT statement_id, month, {_money('total_credit')} AS income,
        {_money('total_debit')} AS expenses, {_money('total_credit - total_debit')} AS net,
        coalesce({_money('opening_balance')}, 0) AS opening_balance,
        coalesce({_money('closing_balance')}, 0) AS closing_balance FROM months""",
    "chart_income_versus_expenses": f"""SELECT statement_id, month, 'income' AS series, {_money('total_credit')} AS amount FROM months
        UNION ALL SELECT statement_id, month, 'expenses', {_money('total_debit')} FROM months""",
    "chart_category_shares": f"""SELECT statement_id, category, {_money('amount')} AS amount,
        round(percentage, 6) AS percentage FROM rcats""",
}

# The analysis of the written-out grids walks the rows the grid keeps.
_walk(
    "gemi",
    "SELECT statement_id, row_no, txn_date, description, CAST(debit AS DOUBLE) AS a FROM gl "
    "WHERE txn_type = 'debit' AND debit >= 1000",
    0.1, "row_no", "members >= 3 AND (likely OR cadence)", LOAN_WORDS, "p", "true",
)
_QUERIES["analysis_overview"] = f"""
    SELECT m.statement_id, m.account_number, {_money('m.opening_balance')} AS opening_balance,
        t.n AS total_transactions, {_money('t.debit')} AS total_debit, coalesce(e.n, 0) AS emi_count,
        round(q.quality_score, 6) AS quality_score, CAST(q.column_count AS BIGINT) AS column_count
    FROM gmeta m JOIN (SELECT statement_id, count(*) AS n, sum(debit) AS debit FROM gl GROUP BY statement_id) t USING (statement_id)
    JOIN gquality q USING (statement_id)
    LEFT JOIN (SELECT statement_id, count(*) AS n FROM gemi_s GROUP BY statement_id) e USING (statement_id)"""

# the workbook's datasets hold the same rows as the frames written to it
_QUERIES["workbook_summary"] = _QUERIES["transaction_summary"]
_QUERIES["workbook_transactions"] = _QUERIES["typed_ledger"]

ORACLE: dict[str, str] = {name: _with_parts(sql) for name, sql in _QUERIES.items()}
