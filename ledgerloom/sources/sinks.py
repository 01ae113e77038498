"""Writing ledgers, grids and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import KEY


def write_ledger(ledger: DataFrame, path: str, fmt: str = "parquet", mode: str = "errorifexists") -> None:
    """The processed ledger: parquet by month, or CSV with a header."""
    if fmt == "csv":
        if "extra" in ledger.columns:
            ledger = ledger.withColumn("extra", F.to_json("extra"))
        ledger.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    else:
        # a month is spread over files by statement and, for a huge statement, by row range
        rows = ledger.repartition("month", KEY, F.expr("row_no div 1000000"))
        rows.write.mode(mode).partitionBy("month").format(fmt).save(path)


def write_grid(raw: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw cells with their row numbers, so that later runs need not read them off the files."""
    raw.write.mode(mode).parquet(path)


def write_grid_csv(raw: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Raw cells as extraction leaves them: one folder with one CSV file per statement, a first line of column numbers."""
    quoted = "transform(cells, c -> CASE WHEN c RLIKE '[\",\r\n]' THEN concat('\"', replace(c, '\"', '\"\"'), '\"') ELSE coalesce(c, '') END)"
    lines = raw.selectExpr(KEY, "row_no", f"array_join({quoted}, ',') AS value")
    widths = raw.groupBy(KEY).agg(F.max(F.size("cells")).alias("width")).where("width > 0")
    heads = widths.selectExpr(KEY, "-1L AS row_no", "array_join(sequence(0, width - 1), ',') AS value")
    (
        heads.unionByName(lines)
        .repartition(KEY)
        .sortWithinPartitions(KEY, "row_no")
        .select(KEY, "value")
        .write.mode(mode)
        .partitionBy(KEY)
        .text(path)
    )


def write_workbook(ledger: DataFrame, summary: DataFrame, monthly: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Three datasets side by side: transactions, summary and monthly summary."""
    for name, frame in (("transactions", ledger), ("summary", summary), ("monthly_summary", monthly)):
        frame.write.mode(mode).parquet(f"{path}/{name}")


def write_report(lines: DataFrame, path: str, mode: str = "errorifexists", buckets: int | None = None) -> None:
    """The text report: one folder of text per statement, or ``buckets`` folders for many statements.

    In a bucket the lines of a statement stand together, each behind the statement's id and a tab.
    """
    if buckets is None:
        rows, by, text = lines.repartition(KEY), KEY, F.col("text")
    else:
        by = "bucket"
        rows = lines.withColumn(by, F.pmod(F.xxhash64(KEY), F.lit(buckets))).repartition(buckets, by)
        text = F.concat(F.col(KEY), F.lit("\t"), F.col("text"))
    (
        rows.sortWithinPartitions(*dict.fromkeys([by, KEY, "section", "line_no"]))
        .select(by, text.alias("value"))
        .write.mode(mode)
        .partitionBy(by)
        .text(path)
    )
