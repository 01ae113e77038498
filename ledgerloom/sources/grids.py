"""Reading extracted tables: CSV grids, ready-made tables, frames and page tables."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import lit, missing_to_null
from ..schemas import KEY, LEDGER
from ..session import reliable_checkpoint

PAGE_GROUP = 4096


#: Texts that part nothing: a line is read whole and cut into cells by an expression.
NO_SEPARATOR, INNER_BREAK = "\u0001\u0002\u0003", "\u0001\u0002"
#: A cell behind its comma: quoted up to the quote that closes it, or plain.
CELL = r',("[^"]*+(?:""[^"]*+)*+"(?=,|$)|[^,]*+)'


def _cells(line: str) -> str:
    """All cells of a CSV line, however many; missing ones are NULL."""
    plain = "CASE WHEN c RLIKE '(?s)^\".*\"$' AND length(c) > 1 THEN replace(substring(c, 2, length(c) - 2), '\"\"', '\"') ELSE c END"
    found = f"transform(regexp_extract_all(concat(',', {line}), {lit(CELL)}, 1), c -> {plain})"
    return f"transform({found}, c -> {missing_to_null('c')})"


def _scan(spark: SparkSession, path: str | list[str], header: bool) -> DataFrame:
    # Lines of a file keep their order: a file is cut into splits by byte offset, a
    # full split is a task of its own, and no split has more lines than bytes.
    line_no = f"monotonically_increasing_id() & {(1 << 33) - 1}L"
    return (
        spark.read.schema("line string")
        .option("header", header)
        .option("sep", NO_SEPARATOR)
        .option("quote", "")
        .csv(path)
        .selectExpr(
            f"_metadata.file_path AS {KEY}",
            f"_metadata.file_block_start + ({line_no}) AS row_no",
            "_metadata.file_block_start AS block_start",
            f"{_cells('line')} AS cells",
        )
    )


def _scan_quoted(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Files whose quoted cells may contain line breaks, cut into splits like others; ``row_no`` 0 is a file's first line.

    A line with an odd number of quotes before it in its file starts inside a quoted cell.  Quotes are counted per
    split, and a running sum over the splits of a file says which of them start inside a cell.  Only splits with an
    odd line, or that start inside, are gone through line by line; lines of others are whole.  The lines are
    written once, so that every step sees the same splits.
    """
    # a byte offset and a number within the task, as in _scan
    lines = reliable_checkpoint(
        spark.read.option("lineSep", "\n")
        .text(path)
        .selectExpr(
            f"_metadata.file_path AS {KEY}",
            "_metadata.file_block_start AS block_start",
            f"_metadata.file_block_start + (monotonically_increasing_id() & {(1 << 33) - 1}L) AS row_no",
            "regexp_replace(value, '\r$', '') AS value",
            "(length(value) - length(replace(value, '\"', ''))) % 2 AS odd",
        )
    )
    splits = lines.groupBy(KEY, "block_start").agg(
        F.expr("sum(odd) % 2 AS odd"), F.expr("max(odd) AS broken"), F.min("row_no").alias("first")
    )
    before = f"OVER (PARTITION BY {KEY} ORDER BY block_start ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    splits = splits.selectExpr(
        KEY,
        "block_start",
        "broken",
        f"coalesce(sum(odd) {before}, 0) % 2 AS inside",
        f"min(first) OVER (PARTITION BY {KEY}) AS file_first",
    )
    tagged = lines.join(splits, [KEY, "block_start"])
    whole = tagged.where("broken = 0 AND inside = 0").selectExpr(KEY, "row_no - file_first AS row_no", "value AS line")

    # within a split: the last line that starts outside, at or before each line
    split = f"PARTITION BY {KEY}, block_start ORDER BY row_no ROWS BETWEEN UNBOUNDED PRECEDING AND"
    torn = (
        tagged.where("broken = 1 OR inside = 1")
        .selectExpr("*", f"(inside + coalesce(sum(odd) OVER ({split} 1 PRECEDING), 0)) % 2 AS within")
        .selectExpr("*", f"max(CASE WHEN within = 0 THEN row_no END) OVER ({split} CURRENT ROW) AS start")
    )
    # an open line may have begun in a split before; that split is torn too, as its quotes do not close
    carried = (
        torn.groupBy(KEY, "block_start")
        .agg(F.max("start").alias("last"))
        .selectExpr(KEY, "block_start", f"last_value(last, true) {before} AS earlier")
    )
    joined = (
        torn.join(carried, [KEY, "block_start"])
        .groupBy(KEY, F.expr("coalesce(start, earlier) - file_first AS row_no"))
        .agg(F.expr("array_sort(collect_list(struct(row_no, value))).value AS parts"))
        .selectExpr(KEY, "row_no", f"array_join(parts, {lit(INNER_BREAK)}) AS line")
    )
    return (
        whole.unionByName(joined)
        .where("trim(line) <> ''")
        .selectExpr(KEY, "row_no", f"transform({_cells('line')}, c -> replace(c, {lit(INNER_BREAK)}, '\n')) AS cells")
    )


def read_grids(spark: SparkSession, path: str | list[str], multiline: bool = False) -> DataFrame:
    """Extracted statements as raw cells, one CSV file per statement; lines may have any number of cells.

    The first line of a file (``0,1,2,...``) carries no data.  ``multiline`` is
    for files whose quoted cells contain line breaks; their lines are written to the checkpoint folder first.
    Files of both kinds are split among tasks.
    """
    if multiline:
        return _scan_quoted(spark, path).where("row_no > 0")
    return _scan(spark, path, True).drop("block_start")


def read_tables(spark: SparkSession, path: str | list[str], multiline: bool = False) -> tuple[DataFrame, DataFrame]:
    """Ready-made tables of any columns: their rows and ``(statement_id, header)``."""
    if multiline:
        lines = _scan_quoted(spark, path)
        return lines.where("row_no > 0"), lines.where("row_no = 0").selectExpr(KEY, "cells AS header")
    # the reader itself leaves out first lines; they stand in the first split of a file
    first = _scan(spark, path, False).where("block_start = 0")
    tables = first.groupBy(KEY).agg(F.expr("min_by(cells, row_no) AS header"))
    return _scan(spark, path, True).drop("block_start"), tables


def read_ledger(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A processed ledger written by ``write_ledger``."""
    if fmt == "csv":
        plain = LEDGER.replace("extra map<string,string>", "extra string")
        rows = spark.read.schema(plain).option("header", True).option("escape", '"').option("emptyValue", "").csv(path)
        return rows.withColumn("extra", F.from_json("extra", "map<string,string>"))
    reader = spark.read.schema(LEDGER)
    return reader.format(fmt).load(path)


def from_frame(
    df: DataFrame, statement_id: str | Column, row_no: str, columns: list[str] | None = None
) -> DataFrame:
    """Any DataFrame as raw cells; its column names serve where no header row is found."""
    columns = columns or [c for c in df.columns if c not in (statement_id, row_no)]
    key = F.col(statement_id) if isinstance(statement_id, str) else statement_id
    return df.select(
        key.cast("string").alias(KEY),
        F.col(row_no).cast("bigint").alias("row_no"),
        F.array(*[F.col(f"`{c}`").cast("string") for c in columns]).alias("cells"),
        F.array(*[F.lit(c) for c in columns]).alias("names"),
    )


def concat_pages(pages: Iterable[DataFrame]) -> DataFrame:
    """Stack page tables; a page with fewer columns gets NULL cells."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pages)


def number_page_rows(pages: DataFrame) -> DataFrame:
    """Raw cells of ``(statement_id, page_no, page_row, cells)`` with one row number per statement.

    Pages are stacked in page order.  The offset of a page is a running sum over
    the pages before it, taken in three levels so that no window ever covers more
    than ``PAGE_GROUP`` pages or page groups.
    """
    counts = pages.groupBy(KEY, "page_no").agg(F.expr("max(page_row) + 1 AS n"))
    level = counts.selectExpr(
        "*", f"page_no div {PAGE_GROUP} AS grp", f"page_no div {PAGE_GROUP**2} AS section"
    )
    groups = level.groupBy(KEY, "section", "grp").agg(F.sum("n").alias("n"))
    sections = groups.groupBy(KEY, "section").agg(F.sum("n").alias("n"))

    def before(frame: DataFrame, keys: list[str], order: str, name: str) -> DataFrame:
        running = (
            f"coalesce(sum(n) OVER (PARTITION BY {', '.join(keys)} ORDER BY {order} "
            f"ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS {name}"
        )
        return frame.selectExpr("*", running).drop("n")

    offsets = (
        before(level, [KEY, "section", "grp"], "page_no", "in_group")
        .join(before(groups, [KEY, "section"], "grp", "in_section"), [KEY, "section", "grp"])
        .join(before(sections, [KEY], "section", "start"), [KEY, "section"])
        .selectExpr(KEY, "page_no", "start + in_section + in_group AS first_row")
    )
    return pages.join(offsets, [KEY, "page_no"]).selectExpr(KEY, "first_row + page_row AS row_no", "cells")
