"""Spending patterns: months, weekdays, large and unusual transactions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from ..schemas import KEY, cents
from .flows import rollup


def monthly_spending(flow: DataFrame) -> DataFrame:
    return rollup(flow.where("month IS NOT NULL"), "month").selectExpr(KEY, "month", "debit AS amount")


#: Figures of a statement from its measures by month; one small list of calendar months, in order, names the months.
_DATED = "FILTER (WHERE month IS NOT NULL)"
MONTHS = [
    f"avg(CAST(debit AS double)) {_DATED} AS average_monthly_spending",
    f"max(debit) {_DATED} AS highest_amount",
    f"min(debit) {_DATED} AS lowest_amount",
    f"array_sort(collect_list(struct(month, debit)) {_DATED}) AS months",
]
STATS = [
    "average_monthly_spending",
    "get(filter(months, m -> m.debit = highest_amount), 0).month AS highest_month",
    "highest_amount",
    "get(filter(months, m -> m.debit = lowest_amount), 0).month AS lowest_month",
    "lowest_amount",
]


def monthly_spending_stats(flow: DataFrame) -> DataFrame:
    """Mean monthly spending, highest and lowest month (the earliest on ties)."""
    months = rollup(flow.where("month IS NOT NULL"), "month")
    return months.groupBy(KEY).agg(*map(F.expr, MONTHS)).selectExpr(KEY, *STATS)


def weekday_spending(flow: DataFrame) -> DataFrame:
    """Debit total per weekday that occurs in the statement."""
    return (
        flow.where("txn_date IS NOT NULL")
        .groupBy(KEY, F.expr("date_format(txn_date, 'EEEE') AS day_of_week"))
        .agg(F.sum("debit").alias("amount"))
    )


def _bucket(digits: int) -> str:
    """Order-preserving bucket of an amount in cents: sign, number of digits, leading ``digits`` digits.

    With four there are at most 9,000 buckets per number of digits, whatever the statement holds.
    """
    lead = f"CAST(rpad(substring(CAST(abs(value) AS string), 1, {digits}), {digits}, '0') AS int)"
    return f"CAST(signum(value) AS int) * (length(CAST(abs(value) AS string)) * {10**digits} + {lead})"


def large_transactions(ledger: DataFrame, share: float = 0.9) -> DataFrame:
    """The exact ``share`` quantile of all debits, and the debits at or above it.

    The quantile interpolates between two neighbouring ranks.  The ranks are
    found in a histogram first and then among the distinct amounts of the one or
    two buckets that hold them, so no task ever orders a whole statement.
    """
    counts = (
        ledger.where("debit IS NOT NULL")
        .groupBy(KEY, F.expr(f"{cents('debit')} AS value"))
        .agg(F.count(F.lit(1)).alias("n"))
        .selectExpr(KEY, "value", "n", f"{_bucket(4)} AS bucket", "CAST(value AS decimal(38,0)) * n AS total")
    )
    earlier = f"OVER (PARTITION BY {KEY} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    histogram = (
        counts.groupBy(KEY, "bucket")
        .agg(F.sum("n").alias("bucket_n"), F.sum("total").alias("bucket_total"))
        .selectExpr(
            "*",
            f"sum(bucket_n) OVER (PARTITION BY {KEY}) AS all_n",
            f"sum(bucket_total) OVER (PARTITION BY {KEY}) AS all_total",
            f"coalesce(sum(bucket_n) {earlier}, 0) AS n_before",
            f"coalesce(sum(bucket_total) {earlier}, 0) AS total_before",
        )
        .selectExpr("*", f"{float(share)}D * (all_n - 1) AS place")
        .selectExpr("*", "CAST(floor(place) AS bigint) AS low_rank", "place - floor(place) AS fraction")
        .selectExpr("*", "least(low_rank + 1, all_n - 1) AS high_rank")
        .where("n_before <= high_rank AND low_rank < n_before + bucket_n")
        .drop("place")
    )
    inside = f"OVER (PARTITION BY {KEY}, bucket ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    ranked = counts.join(histogram, [KEY, "bucket"]).selectExpr(
        "*",
        f"n_before + coalesce(sum(n) {inside}, 0) AS rank",
        f"total_before + coalesce(sum(total) {inside}, 0) AS below",
    )

    def at(side: str, column: str):
        here = f"rank <= {side}_rank AND {side}_rank < rank + n"
        return F.expr(f"max(CASE WHEN {here} THEN {column} END) AS {side}_{column}")

    return (
        ranked.groupBy(KEY)
        .agg(
            *[F.max(c).alias(c) for c in ("all_n", "all_total", "fraction")],
            *[at(side, column) for side in ("low", "high") for column in ("value", "rank", "below")],
        )
        .selectExpr("*", "low_value / 100.0D + (high_value / 100.0D - low_value / 100.0D) * fraction AS threshold")
        .selectExpr("*", "threshold <= low_value / 100.0D AS from_low")
        .selectExpr(
            KEY,
            "threshold",
            "all_n - CASE WHEN from_low THEN low_rank ELSE high_rank END AS count",
            "CAST((all_total - CASE WHEN from_low THEN low_below ELSE high_below END) / 100 AS decimal(38,2))"
            " AS total_amount",
        )
    )


def debit_sketch(ledger: DataFrame, *grain: str, digits: int = 3) -> DataFrame:
    """Number and total of the debits per statement, ``grain`` columns and bucket of ``digits`` leading digits (1 to 8).

    A sketch of the amounts' distribution that merges by addition: the rows of days, months or files are added up
    to any coarser grain.  Amounts of a bucket differ by less than one part in ``10 ** (digits - 1)``.
    """
    if not 1 <= digits <= 8:
        raise ValueError("digits must be 1 to 8")
    return (
        ledger.where("debit IS NOT NULL")
        .selectExpr(KEY, *grain, f"{cents('debit')} AS value")
        .groupBy(KEY, *grain, F.expr(f"{_bucket(digits)} AS bucket"))
        .agg(F.count(F.lit(1)).alias("n"), F.expr("sum(CAST(value AS decimal(38,0))) AS total"))
    )


def sketched_large_transactions(sketch: DataFrame, share: float = 0.9) -> DataFrame:
    """``large_transactions`` from a ``debit_sketch`` of any grain, without reading the ledger again.

    The mean of a bucket stands for its amounts, so ``threshold`` is off by less than a bucket's width; ``count`` and
    ``total_amount`` are those of the threshold's bucket and all above it, ``all_n`` counts all debits.  A statement
    has at most as many rows in its window as there are buckets.
    """
    merged = sketch.groupBy(KEY, "bucket").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    earlier = f"OVER (PARTITION BY {KEY} ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    placed = (
        merged.selectExpr(
            KEY,
            "n",
            "CAST(total AS double) / n / 100.0D AS mean",
            f"sum(n) OVER (PARTITION BY {KEY}) AS all_n",
            f"sum(total) OVER (PARTITION BY {KEY}) AS all_total",
            f"coalesce(sum(n) {earlier}, 0) AS n_before",
            f"coalesce(sum(total) {earlier}, 0) AS total_before",
        )
        .selectExpr("*", f"{float(share)}D * (all_n - 1) AS place")
        .selectExpr("*", "CAST(floor(place) AS bigint) AS low_rank", "place - floor(place) AS fraction")
        .selectExpr("*", "least(low_rank + 1, all_n - 1) AS high_rank")
    )

    def at(side: str, column: str):
        here = f"n_before <= {side}_rank AND {side}_rank < n_before + n"
        return F.expr(f"max(CASE WHEN {here} THEN {column} END) AS {side}_{column}")

    return (
        placed.groupBy(KEY)
        .agg(
            *[F.max(c).alias(c) for c in ("all_n", "all_total", "fraction")],
            *[at(side, column) for side in ("low", "high") for column in ("mean", "n_before", "total_before")],
        )
        .selectExpr("*", "low_mean + (high_mean - low_mean) * fraction AS threshold")
        .selectExpr("*", "threshold <= low_mean AS from_low")
        .selectExpr(
            KEY,
            "threshold",
            "all_n - CASE WHEN from_low THEN low_n_before ELSE high_n_before END AS count",
            "CAST((all_total - CASE WHEN from_low THEN low_total_before ELSE high_total_before END) / 100 AS decimal(38,2))"
            " AS total_amount",
            "all_n",
        )
    )


def unusual_transactions(ledger: DataFrame, std_multiplier: float = 2.5) -> DataFrame:
    """Debits above mean + ``std_multiplier`` sample deviations; zero debits count too."""
    stats = (
        ledger.groupBy(KEY)
        .agg(
            F.expr("avg(CAST(debit AS double)) AS mean"),
            F.expr("stddev_samp(CAST(debit AS double)) AS std"),
        )
        .where("std IS NOT NULL")
    )
    return (
        ledger.select(KEY, "row_no", "txn_date", "description", "debit")
        .join(stats, KEY)
        .where(f"CAST(debit AS double) > mean + {float(std_multiplier)}D * std")
        .selectExpr(
            KEY,
            "row_no",
            "debit AS amount",
            "CASE WHEN std > 0 THEN (CAST(debit AS double) - mean) / std ELSE 0.0D END AS deviation_factor",
            "description",
            "txn_date AS date",
        )
    )


def top_unusual(unusual: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest unusual debits per statement, with the count of all of them."""
    unusual = reliable_checkpoint(unusual)  # few rows, ranked and counted
    return largest_unusual(unusual, n).join(unusual_counts(unusual), KEY)


def largest_unusual(unusual: DataFrame, n: int = 10) -> DataFrame:
    """The ``n`` largest with their ``position``.

    The rank filter is applied before the shuffle too, so a statement sends at
    most ``n`` rows per input partition to the task that ranks it.
    """
    position = f"row_number() OVER (PARTITION BY {KEY} ORDER BY amount DESC, row_no) AS position"
    return unusual.selectExpr("*", position).where(f"position <= {n}")


def unusual_counts(unusual: DataFrame) -> DataFrame:
    return unusual.groupBy(KEY).agg(F.count(F.lit(1)).alias("unusual_count"))
