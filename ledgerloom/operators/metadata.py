"""Account metadata searched in the whole text of a statement.

The text of a statement is its cells joined by blanks, column by column for the
account fields and row by row for the balances; the first match counts.  A
statement may be far too long for one string, so the text is searched in blocks
of rows.  A match covers at most a handful of neighbouring cells, so a block can
be cut down to its first cells, the cells of its first match and its last cells
without losing the first match of the whole.  Blocks are merged in three steps,
and no step gathers more than ``BLOCK`` of them (the last one ``rows/BLOCK**2``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, clean_amount, lit, strip
from ..schemas import KEY
from ..session import reliable_checkpoint

BLOCK = 4096
EDGE = 8  # the longest match spans 6 non-blank cells
SEP = "\u000b"  # joins cells; whitespace to the patterns, and no cell contains it
WALL = "\u0001"  # stands for left-out cells; no pattern crosses it

# Search patterns, the first that matches wins.
ACCOUNT = {
    "account_1": r"ACCOUNT\s*NO\s*:?\s*(\d+)",
    "account_2": r"A/C\s*NO\s*:?\s*(\d+)",
    "account_3": r"ACCOUNT\s*NUMBER\s*:?\s*(\d+)",
    "account_4": r"(\d{10,18})",
}
IFSC = {"ifsc": r"IFSC\s*CODE?\s*:?\s*([A-Z]{4}\d{7})"}
PERIOD = {
    "period_1": r"FROM\s*:?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s*TO\s*:?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
    "period_2": r"PERIOD\s*:?\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})\s*TO\s*(\d{1,2}[-/]\d{1,2}[-/]\d{2,4})",
}
NAME = {
    "name_1": r"CUSTOMER\s*NAME\s*:?\s*([A-Z\s]+)",
    "name_2": r"NAME\s*:?\s*([A-Z\s]+)",
}
NOT_A_NAME = "AXIS|BANK|LTD|ADDRESS"
BALANCE = {
    "opening": r"OPENING\s*BALANCE[:\s]*([0-9,.-]+)",
    "closing": r"CLOSING\s*BALANCE[:\s]*([0-9,.-]+)",
}

# a name runs on for any number of cells; one character is enough to find where it starts
_STARTS = {key: pattern[:-2] + ")" for key, pattern in NAME.items()}
_BY_COLUMN = ACCOUNT | IFSC | PERIOD | NAME
NAME_CELLS = 64  # cells of a name kept in the search; longer ones are followed in the grid


def _joined(pieces: str) -> str:
    return f"concat(array_join(transform({pieces}, p -> p.text), {lit(SEP)}), {lit(SEP)})"


def _separators(text: str) -> str:
    return f"(length({text}) - length(replace({text}, {lit(SEP)}, '')))"


def _shorten(pieces: str, patterns: dict[str, str]) -> str:
    """Keep the first cells, the last cells and the cells of each pattern's first match.

    A wall takes the place of the cells left out between them.  What is kept are runs
    of the real text in their order, so each pattern's first match stays the first.
    """
    before = _separators("substring(t_, 1, at_ - 1)")

    def match(key: str, pattern: str) -> str:
        length = _separators(f"regexp_extract(t_, {lit(pattern)}, 0)")
        if key in NAME:
            length = f"least({length}, {NAME_CELLS})"
        span = f"CASE WHEN at_ > 0 THEN named_struct('a', {before}, 'b', {before} + {length}) END"
        return bind(f"regexp_instr(t_, {lit(pattern)})", "at_", span)

    matches = [match(k, p) for k, p in patterns.items()]
    ends = [
        f"named_struct('a', 0, 'b', {EDGE - 1})",
        f"named_struct('a', size({pieces}) - {EDGE}, 'b', size({pieces}) - 1)",
    ]
    wall = f"named_struct('col', -1, 'row', -1L, 'text', {lit(WALL)})"
    cut = (
        f"transform({pieces}, (p, i) -> CASE WHEN exists(spans_, v -> v.a <= i AND i <= v.b) THEN p ELSE {wall} END)"
    )
    squeezed = "filter(cut_, (p, i) -> NOT (p.col = -1 AND coalesce(get(cut_, i - 1).col = -1, false)))"
    kept = bind(f"array({', '.join(ends + matches)})", "spans_", bind(cut, "cut_", squeezed))
    return f"CASE WHEN size({pieces}) > {4 * EDGE} THEN {bind(_joined(pieces), 't_', kept)} ELSE {pieces} END"


def _merge(
    parts: DataFrame, keys: list[str], order: list[str], patterns: dict[str, str], tidy=lambda pieces: pieces
) -> DataFrame:
    """Join the parts of each group in order and shorten again."""
    fields = ", ".join([*order, "pieces"])
    return (
        parts.groupBy(*keys)
        .agg(F.expr(f"array_sort(collect_list(struct({fields}))) AS parts"))
        .selectExpr(*keys, "flatten(parts.pieces) AS pieces")
        .selectExpr(*keys, f"{tidy('pieces')} AS pieces")
        .selectExpr(*keys, f"{_shorten('pieces', patterns)} AS pieces")
    )


def _row_blocks(raw: DataFrame) -> DataFrame:
    """Rows of a statement gathered in blocks of consecutive row numbers."""
    clean = f"transform(cells, c -> translate(upper(coalesce(c, '')), {lit(SEP + WALL)}, '  '))"
    return (
        raw.selectExpr(KEY, f"row_no div {BLOCK} AS block", "row_no", f"{clean} AS cells")
        .groupBy(KEY, "block")
        .agg(F.expr("array_sort(collect_list(struct(row_no, cells))) AS rows"))
    )


_FILLED = f"p -> p.text RLIKE {lit(r'\S')}"


def _column_blocks(blocks: DataFrame) -> DataFrame:
    """One row per block and column, cells in row order."""
    return (
        blocks.withColumn("width", F.expr("array_max(transform(rows, r -> size(r.cells)))"))
        .where("width > 0")
        .selectExpr(KEY, "block", "rows", "explode(sequence(0, width - 1)) AS col")
        .selectExpr(
            KEY,
            "col",
            "block",
            "transform(rows, r -> r.row_no) AS row_nos",
            "transform(rows, r -> coalesce(get(r.cells, col), '')) AS texts",
        )
    )


def _search_columns(columns: DataFrame) -> DataFrame:
    """Per statement: the cells around the first match of each pattern, column by column."""
    # Blank cells are no pieces, but the piece after them keeps their blanks.  The arrays are
    # bound to names: the optimizer would otherwise compute them anew for every piece.
    before = "coalesce(get(filled_, j - 1), -1)"
    blanks = (
        f"CASE WHEN x - {before} > 1 "
        f"THEN concat(array_join(slice(texts_, {before} + 2, x - {before} - 1), ' '), ' ') ELSE '' END"
    )
    pieces = (
        "transform(filled_, (x, j) -> named_struct('col', col, 'row', get(rows_, x), "
        f"'text', concat({blanks}, get(texts_, x))))"
    )
    filled = f"filter(sequence(0, size(texts_) - 1), i -> get(texts_, i) RLIKE {lit(r'\S')})"
    pieces = bind("texts", "texts_", bind("row_nos", "rows_", bind(filled, "filled_", pieces)))
    parts = columns.selectExpr(KEY, "col", "block", f"{pieces} AS pieces").selectExpr(
        KEY, "col", "block", f"block div {BLOCK} AS outer_block", f"{_shorten('pieces', _BY_COLUMN)} AS pieces"
    )
    parts = _merge(parts, [KEY, "col", "outer_block"], ["block"], _BY_COLUMN)
    return _with_text(_merge(parts, [KEY], ["col", "outer_block"], _BY_COLUMN))


def _search_rows(blocks: DataFrame) -> DataFrame:
    """Per statement: the cells around the first opening and closing balance, row by row."""
    cells = (
        "flatten(transform(rows, r -> transform(r.cells, (c, i) -> "
        "named_struct('col', i, 'row', r.row_no, 'text', c))))"
    )
    parts = (
        blocks.selectExpr(KEY, "block", f"filter({cells}, {_FILLED}) AS pieces")
        .selectExpr(KEY, "block", f"{_drop_colons('pieces')} AS pieces")
        .selectExpr(KEY, "block", f"block div {BLOCK} AS outer_block", f"{_shorten('pieces', BALANCE)} AS pieces")
    )
    parts = _merge(parts, [KEY, "outer_block"], ["block"], BALANCE, _drop_colons)
    return _with_text(_merge(parts, [KEY], ["outer_block"], BALANCE, _drop_colons))


def _with_text(found: DataFrame) -> DataFrame:
    return found.withColumn("found_text", F.expr(_joined("pieces")))


def _drop_colons(pieces: str) -> str:
    """Of neighbouring cells that hold only colons keep one: the balance patterns skip them all."""
    only = lit(r"^[\s:]*$")
    return (
        f"filter({pieces}, (p, i) -> NOT (p.text RLIKE {only} "
        f"AND coalesce(get({pieces}, i - 1).text RLIKE {only}, false)))"
    )


def _found_names(found: DataFrame) -> DataFrame:
    """The accepted name of every statement as far as the search kept it.

    ``open`` marks statements whose name may go on where the search left cells out or
    runs over the end of a block.
    """

    def capture(pattern: str) -> str:
        first = _separators("substring(found_text, 1, at_ - 1)")
        last = f"{first} + {_separators(f'regexp_replace(run_, {lit(r'\s+$')}, {lit('')})')}"
        same_block = (
            f"get(pieces, {first}).col = get(pieces, {last}).col"
            f" AND get(pieces, {first}).row div {BLOCK} = get(pieces, {last}).row div {BLOCK}"
        )
        ends = f"substring(found_text, at_ + length(run_), 1) <> {lit(WALL)}"
        name = strip(f"translate(regexp_extract(found_text, {lit(pattern)}, 1), {lit(SEP)}, ' ')")
        captured = (
            f"CASE WHEN at_ > 0 THEN named_struct('name', {name}, 'whole', coalesce({ends} AND {same_block}, false)) END"
        )
        run = f"regexp_extract(found_text, {lit(pattern)}, 0)"
        return bind(f"regexp_instr(found_text, {lit(pattern)})", "at_", bind(run, "run_", captured))

    accepted = "length({n}.name) > 3 AND NOT {n}.name RLIKE " + lit(NOT_A_NAME)
    one, two = accepted.format(n="name_1"), accepted.format(n="name_2")
    return found.selectExpr(KEY, *[f"{capture(p)} AS {k}" for k, p in NAME.items()]).selectExpr(
        KEY,
        f"CASE WHEN {one} THEN name_1.name WHEN {two} THEN name_2.name END AS customer_name",
        "coalesce(NOT name_1.whole, false) OR "
        f"(NOT coalesce({one}, false) AND coalesce(NOT name_2.whole, false)) AS open",
    )


def _customer_names(columns: DataFrame, found: DataFrame) -> DataFrame:
    """The text captured by each name pattern, followed from its start as far as it runs."""

    def start(pattern: str) -> str:
        first = _separators("substring(found_text, 1, at_ - 1)")
        place = f"CASE WHEN at_ > 0 THEN get(pieces, {first}) END"
        return bind(f"regexp_instr(found_text, {lit(pattern)})", "at_", place)

    # text between two places: a column and a block of rows
    place = f"CAST({{}} AS bigint) * {1 << 40} + {{}}"
    starts = (
        found.selectExpr(
            KEY,
            "inline(array("
            + ", ".join(f"named_struct('pattern', '{k}', 'start', {start(p)})" for k, p in _STARTS.items())
            + "))",
        )
        .where("start IS NOT NULL")
        .selectExpr(
            KEY, "pattern", "start.row AS start_row", place.format("start.col", f"start.row div {BLOCK}") + " AS begin"
        )
    )
    # In its first block the run ends after its start; a later block may begin inside the start.
    run = r"NAME\s*+:?+\s*+[A-Z\s]++[^A-Z\s]"
    later = f"regexp_replace(text, {lit(r'^\s*(NAME)?\s*:?')}, '') RLIKE {lit(r'[^A-Z\s]')}"
    ends = f"""
        CASE WHEN place <> begin THEN {later}
            WHEN pattern = 'name_1' THEN text RLIKE {lit(r'CUSTOMER\s*' + run)}
            ELSE text RLIKE {lit(run)} END"""
    skipped = "greatest(CAST(array_position(row_nos, start_row) AS int), 1)"
    parts = (
        columns.withColumn("place", F.expr(place.format("col", "block")))
        .join(starts, KEY)
        .where("place >= begin")
        .withColumn(
            "text",
            F.expr(
                f"array_join(CASE WHEN place = begin THEN slice(texts, {skipped}, size(texts)) ELSE texts END, ' ')"
            ),
        )
        .selectExpr(KEY, "pattern", "place", "text", f"{ends} AS ends")
    )
    last = parts.where("ends").groupBy(KEY, "pattern").agg(F.min("place").alias("last"))
    captured = " ".join(
        f"WHEN pattern = '{k}' THEN regexp_extract(text, {lit(p)}, 1)" for k, p in NAME.items()
    )
    return (
        parts.join(last, [KEY, "pattern"], "left")
        .where("last IS NULL OR place <= last")
        .groupBy(KEY, "pattern")
        .agg(F.expr("concat(array_join(array_sort(collect_list(struct(place, text))).text, ' '), ' ') AS text"))
        .selectExpr(KEY, "pattern", f"{strip(f'CASE {captured} END')} AS name")
        .where(f"length(name) > 3 AND NOT name RLIKE {lit(NOT_A_NAME)}")
        .groupBy(KEY)
        .agg(F.expr("min(struct(pattern, name)).name AS customer_name"))
    )


def _group(pattern: str, group: int = 1) -> str:
    return f"nullif(regexp_extract(found_text, {lit(pattern)}, {group}), '')"


def account_metadata(raw: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Account number, IFSC code, period and customer name of every statement."""
    columns = _column_blocks(_row_blocks(raw) if blocks is None else blocks)
    found = reliable_checkpoint(_search_columns(columns))
    names = _found_names(found)
    if not names.where("open").isEmpty():
        still_open = found.join(names.where("open").select(KEY), KEY, "left_semi")
        followed = _customer_names(columns, still_open)
        names = names.where("NOT open").select(KEY, "customer_name").unionByName(followed)

    def period(group: int) -> str:
        cases = " ".join(f"WHEN {_group(p)} IS NOT NULL THEN {_group(p, group)}" for p in PERIOD.values())
        return f"CASE {cases} END"

    fields = found.selectExpr(
        KEY,
        f"coalesce({', '.join(map(_group, ACCOUNT.values()))}) AS account_number",
        f"{_group(IFSC['ifsc'])} AS ifsc_code",
        f"{period(1)} AS period_from",
        f"{period(2)} AS period_to",
    )
    ids = raw.select(KEY).distinct()
    return ids.join(fields, KEY, "left").join(names.select(KEY, "customer_name"), KEY, "left")


def text_balances(raw: DataFrame, blocks: DataFrame | None = None) -> DataFrame:
    """Opening and closing balance named in the text of a statement, NULL if it names none."""
    return (
        _search_rows(_row_blocks(raw) if blocks is None else blocks)
        .selectExpr(KEY, *[f"{_group(p)} AS {k}" for k, p in BALANCE.items()])
        .selectExpr(
            KEY,
            *[f"CASE WHEN {k} IS NOT NULL THEN {clean_amount(k)} END AS {k}_balance" for k in BALANCE],
        )
    )


def ledger_balances(ledger: DataFrame) -> DataFrame:
    """First and last balance of a ledger in row order."""
    row = "CASE WHEN balance IS NOT NULL THEN row_no END"
    return ledger.groupBy(KEY).agg(
        F.expr(f"min_by(balance, {row}) AS first_balance"), F.expr(f"max_by(balance, {row}) AS last_balance")
    )


def statement_metadata(raw: DataFrame, ledger: DataFrame) -> DataFrame:
    """One row per statement: account fields and balances (text first, else the ledger's).

    The cells are gathered into blocks once, for both searches.
    """
    blocks = reliable_checkpoint(_row_blocks(raw))
    return (
        account_metadata(raw, blocks)
        .join(text_balances(raw, blocks), KEY, "left")
        .join(ledger_balances(ledger), KEY, "left")
        .withColumn("opening_balance", F.coalesce("opening_balance", "first_balance"))
        .withColumn("closing_balance", F.coalesce("closing_balance", "last_balance"))
        .drop("first_balance", "last_balance")
    )
