"""Cell-level SQL fragments: blanks, amounts, dates and display text.

Each function takes and returns the text of a SQL expression.  All of them stay in the JVM.
"""

from __future__ import annotations

from collections.abc import Iterable

from ..schemas import MONEY

_NUMBER = r"^-?(\d+\.?\d*|\.\d+)$"
# every text a cast takes as a number, and few others: a failing cast throws and catches an exception, which costs far more than a match
_CASTABLE = (
    r"^[\x00-\x20\x7F]*[+-]?((\p{Nd}+\.?\p{Nd}*|\.\p{Nd}+)([eE][+-]?\p{Nd}+)?[dDfF]?|0[xX].*|(?i:inf|infinity|nan))[\x00-\x20\x7F]*$"
)
WHITESPACE = " \t\n\r\f\u000b\u00a0"

# Texts a CSV reader takes as a missing cell.
MISSING = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]

# Day first, then ISO.  Separators are folded to '-' before parsing.
DAY_FIRST = (
    "d-M-yyyy", "d-M-yy", "yyyy-M-d", "d-MMM-yyyy", "d-MMM-yy", "d-MMMM-yyyy", "MMM-d-yyyy", "MMMM-d-yyyy", "yyyyMMdd",
)
MONTH_FIRST = ("M-d-yyyy", "M-d-yy", "yyyy-M-d")

_CLOCK = r"[ T]\d{1,2}:\d{2}(:\d{2}([.]\d+)?)?( ?[AaPp][Mm])?$"
_SHAPE = {  # a cheap guard per format, so that a row is parsed once, not once per format
    "yyyy": r"\d{4}", "yy": r"\d{2}", "MMMM": r"[A-Za-z]{4,}", "MMM": r"[A-Za-z]{3}",
    "M": r"\d{1,2}", "d": r"\d{1,2}", "yyyyMMdd": r"\d{8}",
}


def lit(text: str) -> str:
    """A SQL string literal."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def bind(value: str, name: str, use: str) -> str:
    """``use`` with ``name`` standing for ``value``, which is computed once per row."""
    return f"get(transform(array({value}), {name} -> {use}), 0)"


def strip(x: str) -> str:
    return f"trim(BOTH {lit(WHITESPACE)} FROM {x})"


def missing_to_null(x: str) -> str:
    return f"CASE WHEN {x} NOT IN ({', '.join(map(lit, MISSING))}) THEN {x} END"


def parse_date(x: str, formats: Iterable[str] = DAY_FIRST) -> str:
    """Text to date; the first fitting format wins, anything else is NULL."""
    text = f"regexp_replace(regexp_replace({strip(x)}, {lit(_CLOCK)}, ''), '[/., ]+', '-')"
    tries = []
    for fmt in formats:
        tries.append(f"CASE WHEN day_ RLIKE {lit(shape(fmt))} THEN CAST(try_to_timestamp(day_, {lit(fmt)}) AS DATE) END")
    return bind(text, "day_", f"coalesce({', '.join(tries)})")


def shape(fmt: str) -> str:
    """The pattern of all texts a date format could fit; formats that read the same texts differently share it."""
    return "^" + "-".join(_SHAPE[part] for part in fmt.split("-")) + "$"


def date_flaw(x: str, parsed: str) -> str:
    """Why a date cell gives no date, NULL if it does or is blank."""
    return f"CASE WHEN {strip(x)} <> '' AND {parsed} IS NULL THEN 'not a date' END"


def _digits(x: str) -> str:
    return f"regexp_replace({x}, {lit('[^0-9.-]')}, '')"


def _try_number(x: str, kind: str) -> str:
    return f"CASE WHEN {x} RLIKE {lit(_CASTABLE)} THEN try_cast({x} AS {kind}) END"


def clean_amount(x: str, money: str = MONEY) -> str:
    """Money text to a number: keep digits, '.' and '-'; anything unreadable or too long is 0 (``amount_flaw`` tells which)."""
    return f"coalesce({_try_number(_digits(x), money)}, CAST(0 AS {money}))"


def amount_flaw(x: str, money: str = MONEY) -> str:
    """Why ``clean_amount`` gives 0 for a cell with digits, NULL if it reads the cell."""
    number = f"CASE WHEN d_ RLIKE {lit(_NUMBER)} THEN 'too long' WHEN d_ RLIKE '[0-9]' THEN 'not a number' END"
    return bind(_digits(x), "d_", f"CASE WHEN try_cast(d_ AS {money}) IS NULL THEN {number} END")


def to_number(x: str, money: str = MONEY) -> str:
    """A plain number or NULL (``number_flaw`` tells why); thousand separators are not accepted."""
    return _try_number(strip(x), money)


def number_flaw(x: str, money: str = MONEY) -> str:
    """Why ``to_number`` gives NULL for a cell that is not blank."""
    why = f"CASE WHEN n_ RLIKE {lit(_NUMBER)} THEN 'too long' ELSE 'not a number' END"
    return bind(strip(x), "n_", f"CASE WHEN n_ <> '' AND try_cast(n_ AS {money}) IS NULL THEN {why} END")


def contains_any(x: str, words: Iterable[str]) -> str:
    """Whether ``x`` holds any of the words, as parts of words too."""
    return "(" + " OR ".join(f"contains({x}, {lit(w)})" for w in words) + ")"


def currency(x: str) -> str:
    return f"concat('₹', format_number(coalesce({x}, 0), 2))"


def currency_or_text(x: str) -> str:
    """Currency text when the cell is a number, '' when blank, else the cell itself."""
    number = f"try_cast({strip(x)} AS double)"
    return (
        f"CASE WHEN {x} IS NULL OR {strip(x)} = '' THEN '' WHEN {number} IS NULL THEN {x} "
        f"ELSE concat('₹', format_number({number}, 2)) END"
    )


def percentage(x: str) -> str:
    return f"CASE WHEN {x} IS NOT NULL THEN concat(format_string('%.1f', CAST({x} AS double)), '%') END"


def shorten(x: str, width: int = 50) -> str:
    return f"CASE WHEN length({x}) > {width} THEN concat(substring({x}, 1, {width}), '...') ELSE {x} END"
