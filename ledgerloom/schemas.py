"""Column contracts shared by every operator.

A frame is keyed by ``statement_id``; ``row_no`` is the line order inside one
statement (unique, below 2**41).  In a ledger, NULL in ``description``,
``debit``, ``credit``, ``amount`` or ``dr_cr_indicator`` means "the layout has no
such column"; a blank cell is '' or 0.  ``extra`` holds the cells of all other
columns of the layout by their header name.
"""

KEY = "statement_id"
MONEY = "decimal(28,2)"
ROW_BITS = 41

RAW_CELLS = "statement_id string, row_no bigint, cells array<string>"

LEDGER = f"""
    statement_id string, row_no bigint, txn_date date, month string, description string,
    debit {MONEY}, credit {MONEY}, amount {MONEY}, balance {MONEY}, dr_cr_indicator string,
    txn_type string, transaction_amount {MONEY},
    cheque_no string, reference_no string, branch string, extra map<string,string>
"""

ZERO = f"CAST(0 AS {MONEY})"


def day_order(day: str = "txn_date", row_no: str = "row_no") -> str:
    """(day, row_no) packed into one bigint.

    ``min_by``/``max_by`` over a bigint stay in hash aggregation; a struct key
    would force a sort of every input row.
    """
    packed = f"CAST(unix_date({day}) AS bigint) * {1 << ROW_BITS} + {row_no}"
    return (
        f"CASE WHEN {row_no} < {1 << ROW_BITS} THEN {packed} "
        "ELSE CAST(raise_error('row_no must be below 2**41') AS bigint) END"
    )


def cents(money: str) -> str:
    return f"CAST({money} * 100 AS bigint)"
