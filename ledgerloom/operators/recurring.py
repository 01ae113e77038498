"""Recurring payments: amounts that come back within a tolerance, about once a month.

Seeds are walked in order; a seed is skipped if it lies within the tolerance of an
accepted one, and accepted if enough payments of a similar amount exist and they
look like an instalment.  In Spark:

1. Payments are reduced to distinct amounts; equal amounts share all figures, and
   only the first row of an amount that can qualify matters as a seed.
2. The figures of an amount's band (count, first and last date) are added up from
   dyadic blocks: every amount adds to one block per level, every band is a
   handful of blocks.  That costs ``amounts * log(band)`` rows; pairs of amounts
   are never formed.
3. The walk itself is a fold over the qualifying amounts of a statement.  The
   statements with more than ``FOLD_LIMIT`` of them are walked in parallel: a
   seed that comes before all its rivals is accepted for certain; every seed knows
   which one above and below is accepted if it is itself; and from the certain ones
   these pointers are followed by doubling, so a chain of any length takes as many
   rounds as its length has bits.  What no chain reaches lies between two chains and is
   decided in a few more turns.
"""

from __future__ import annotations

from dataclasses import dataclass
from math import log

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bind, contains_any
from ..rules import LOAN_WORDS, REPORT_LOAN_WORDS
from ..schemas import KEY, ROW_BITS, cents, day_order
from ..session import reliable_checkpoint

FOLD_LIMIT = 20_000
BROADCAST_ROWS = 100_000  # rows of a few numbers: some megabytes

# A monthly cadence in days, and the limits of the second report.
MONTHLY_DAYS = (25, 35)
REPORT_TOLERANCE = 0.05
REPORT_MIN_AMOUNT = 1000


@dataclass(frozen=True)
class Walk:
    """How seeds block each other: within ``tolerance`` of an accepted amount, relative to it."""

    tolerance: float
    least_divisor: float = 0.0

    def __post_init__(self) -> None:
        if self.tolerance and not 1e-6 <= self.tolerance < 1:
            raise ValueError("the tolerance must be 0, or at least 0.000001 and below 1")

    def blocks(self, accepted: str, value: str) -> str:
        """Whether ``accepted`` blocks ``value`` (both in cents), in floating point."""
        taken, amount = _money(accepted), _money(value)
        divisor = f"greatest({taken}, {self.least_divisor}D)" if self.least_divisor else taken
        return f"abs({amount} - {taken}) / {divisor} <= {self.tolerance}D"

    @property
    def _width(self) -> float:
        return log(1 + self.tolerance) * 0.999

    def cell(self, value: str) -> str:
        """Logarithmic cell so narrow that any two amounts in it block each other."""
        return f"CAST(floor(ln(CAST({value} AS double)) / {self._width}D) AS bigint)"

    @property
    def reach(self) -> int:
        """How many cells away an amount can be blocked: a larger one blocks further down than a smaller one up."""
        return int(-log(1 - self.tolerance) / self._width) + 1


def _money(value: str) -> str:
    return f"(({value}) / 100.0D)"


def _distinct_amounts(payments: DataFrame) -> DataFrame:
    """Figures per distinct positive amount; ``seq`` is the order in which seeds are walked.

    Seeds and bands both read them, so they are written to the checkpoint folder.
    """
    return reliable_checkpoint(
        payments.where("value > 0")
        .groupBy(KEY, "value")
        .agg(
            F.expr("count(1) AS n"),
            F.expr("count(txn_date) AS n_dates"),
            F.expr("min(txn_date) AS first_date"),
            F.expr("max(txn_date) AS last_date"),
            F.expr("min(seq) AS first_seq"),
            F.expr("min(CASE WHEN likely THEN seq END) AS likely_seq"),
        )
    )


def _with_band(seeds: DataFrame, tolerance: float, keep: list[str]) -> DataFrame:
    """Add to ``keep`` the smallest and largest amount in cents within the tolerance of ``value``.

    The bounds are those of the floating-point test |b - a| / a <= tolerance: it is
    monotone in b, so trying the cents around the rounded bound is exact.
    """

    def inside(b: str) -> str:
        return f"abs({_money(b)} - {_money('value')}) / {_money('value')} <= {tolerance}D"

    return seeds.selectExpr(
        "*",
        f"CAST(ceil(value * {1 - tolerance}D) AS bigint) AS low_",
        f"CAST(floor(value * {1 + tolerance}D) AS bigint) AS high_",
    ).selectExpr(
        KEY,
        "value",
        *keep,
        f"CASE WHEN {inside('low_ - 1')} THEN low_ - 1 WHEN {inside('low_')} THEN low_ ELSE low_ + 1 END AS low",
        f"CASE WHEN {inside('high_ + 1')} THEN high_ + 1 WHEN {inside('high_')} THEN high_ ELSE high_ - 1 END AS high",
    )


def _cover(seeds: DataFrame) -> DataFrame:
    """The dyadic blocks that make up the band of every seed.

    On each level the blocks [left, right) lie in the band; one at either end that is
    not half of a block one level up is used on this level.
    """
    keep = [KEY, "value", "first_seq", "likely_seq"]
    return (
        seeds.selectExpr(
            *keep, "low", "high", "explode(sequence(0, CAST(floor(log2(high - low + 1)) AS int))) AS level"
        )
        .selectExpr(
            *keep,
            "level",
            "shiftright(low + shiftleft(1L, level) - 1, level) AS left_",
            "shiftright(high + 1, level) AS right_",
        )
        .where("left_ < right_")
        .selectExpr(
            *keep,
            "level",
            "explode(array(CASE WHEN left_ % 2 = 1 THEN left_ END,"
            " CASE WHEN right_ % 2 = 1 AND left_ + left_ % 2 < right_ THEN right_ - 1 END)) AS block",
        )
        .where("block IS NOT NULL")
    )


def band_figures(amounts: DataFrame, seeds: DataFrame, tolerance: float) -> DataFrame:
    """Add the figures of all amounts within the tolerance to every seed amount."""
    spread = 2 * tolerance / (1 - tolerance)
    blocks = (
        amounts.selectExpr(
            "*", f"explode(sequence(0, CAST(floor(log2((value + 2) * {spread}D + 2)) AS int))) AS level"
        )
        .groupBy(KEY, "level", F.expr("shiftright(value, level) AS block"))
        .agg(
            F.expr("sum(n) AS n"),
            F.expr("sum(n_dates) AS n_dates"),
            F.expr("min(first_date) AS first_date"),
            F.expr("max(last_date) AS last_date"),
        )
    )
    needed = _cover(_with_band(seeds, tolerance, ["first_seq", "likely_seq"]))
    return (
        # blocks grow with the data and their size is not known beforehand: never broadcast them
        needed.join(blocks.hint("merge"), [KEY, "level", "block"])
        .groupBy(KEY, "value")
        .agg(
            F.expr("max(first_seq) AS first_seq"),
            F.expr("max(likely_seq) AS likely_seq"),
            F.expr("sum(n) AS members"),
            F.expr("sum(n_dates) AS n_dates"),
            F.expr("min(first_date) AS first_date"),
            F.expr("max(last_date) AS last_date"),
        )
    )


# the mean of consecutive day gaps is the whole span over the number of gaps
_CADENCE = (
    "coalesce(datediff(last_date, first_date) / nullif(n_dates - 1, 0)"
    f" BETWEEN {MONTHLY_DAYS[0]} AND {MONTHLY_DAYS[1]}, false)"
)

_SEED = "seq, value, regular, likely, members, first_date, last_date"
_SEED_TYPE = (
    "struct<seq:bigint,value:bigint,regular:boolean,likely:boolean,members:bigint,first_date:date,last_date:date>"
)


def _seeds(figures: DataFrame, members: int, regular: str, first_counts: str) -> DataFrame:
    """The one seed an amount can have: its first row, or its first row with a loan word."""
    return (
        figures.where(f"members >= {members}")
        .selectExpr("*", f"{regular} AS regular")
        .selectExpr("*", f"CASE WHEN {first_counts} THEN first_seq ELSE likely_seq END AS seq")
        .where("seq IS NOT NULL")
        .selectExpr("*", "coalesce(seq = likely_seq, false) AS likely")
        .selectExpr(KEY, *_SEED.split(", "))
    )


def _fold(seeds: DataFrame, walk: Walk) -> DataFrame:
    """Walk the seeds of every statement in order and keep those no accepted one blocks."""
    kept = f"""
        aggregate(seeds, CAST(array() AS array<{_SEED_TYPE}>),
            (taken, s) -> CASE WHEN exists(taken, p -> {walk.blocks('p.value', 's.value')}) THEN taken
                ELSE concat(taken, array(s)) END)"""
    listed = seeds.groupBy(KEY).agg(
        F.expr(f"CAST(array_sort(collect_list(struct({_SEED}))) AS array<{_SEED_TYPE}>) AS seeds")
    )
    return listed.selectExpr(KEY, f"inline({kept})")


def walk_seeds(seeds: DataFrame, walk: Walk, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """The accepted seeds of the ordered walk.

    A statement with ``fold_limit`` seeds at most is folded as an array; those with more
    are decided side by side, in rounds that follow whole chains of seeds.
    """
    if not walk.tolerance:  # amounts are distinct
        return seeds
    seeds = reliable_checkpoint(seeds)
    large = seeds.groupBy(KEY).count().where(f"count > {fold_limit}").select(KEY)
    if large.isEmpty():
        return _fold(seeds, walk)
    undecided = seeds.join(large, KEY, "left_semi").selectExpr(KEY, f"{walk.cell('value')} AS cell", "value", "seq")
    undecided, accepted = reliable_checkpoint(undecided), None
    while not undecided.isEmpty():
        found = _decided(undecided, walk)
        undecided = reliable_checkpoint(_drop_blocked(undecided, found, walk))
        accepted = found if accepted is None else accepted.unionByName(found)
    walked = seeds.join(accepted.select(KEY, "seq"), [KEY, "seq"], "left_semi").select(*seeds.columns)
    return _fold(seeds.join(large, KEY, "left_anti"), walk).unionByName(walked)


def _decided(undecided: DataFrame, walk: Walk) -> DataFrame:
    """Seeds accepted for certain: those ahead of all their rivals, and all that these lead to."""
    cells = reliable_checkpoint(_around(undecided, walk.reach))
    rivals = [f"{side}[{d}]" for side in ("above", "below") for d in range(walk.reach)]
    ahead = " AND ".join(f"coalesce(seq < {r}, true)" for r in rivals)
    roots = reliable_checkpoint(cells.where(ahead).select(KEY, "seq"))
    marks = roots
    for pointers in _pointers(undecided, cells, walk):
        pointers = reliable_checkpoint(pointers)
        # only seeds that something leads to, or that are accepted already, are on a chain
        starts = pointers.selectExpr(KEY, "next AS seq").unionByName(roots).distinct()
        jumps = reliable_checkpoint(pointers.join(starts, [KEY, "seq"], "left_semi"))
        found = roots
        while not jumps.isEmpty():
            found, jumps = _double(found, jumps)
        marks = marks.unionByName(found)
    return reliable_checkpoint(undecided.join(marks.distinct(), [KEY, "seq"], "left_semi"))


def _double(marks: DataFrame, jumps: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mark what one jump reaches, and make every jump twice as long."""
    reached = marks.join(jumps, [KEY, "seq"]).selectExpr(KEY, "next AS seq")
    second = jumps.selectExpr(KEY, "seq AS next", "next AS last")
    longer = jumps.join(second, [KEY, "next"]).selectExpr(KEY, "seq", "last AS next")
    return reliable_checkpoint(marks.unionByName(reached).distinct()), reliable_checkpoint(longer)


def _around(undecided: DataFrame, reach: int) -> DataFrame:
    """The first seed of every cell, and those of the cells above and below, by distance.

    The cells of a statement are few: their number is that of tolerances between the
    smallest and the largest amount.
    """

    def first(distance: int, side: str) -> str:
        return f"min(seq) OVER (PARTITION BY {KEY} ORDER BY cell RANGE BETWEEN {distance} {side} AND {distance} {side})"

    def sides(side: str) -> str:
        return f"array({', '.join(first(d, side) for d in range(1, 2 * reach + 2))})"

    firsts = undecided.groupBy(KEY, "cell").agg(F.min("seq").alias("seq"))
    return firsts.selectExpr("*", f"{sides('FOLLOWING')} AS above", f"{sides('PRECEDING')} AS below")


def _pointers(undecided: DataFrame, cells: DataFrame, walk: Walk) -> list[DataFrame]:
    """Per seed the next one above, and the next one below, that is accepted if the seed is: ``seq, next``.

    Given that ``p`` is accepted, look at the seeds on one side of it that it does not
    block.  The first of them within ``reach + 1`` cells is accepted too if it
    comes before all others in its own reach; nothing on the other side of ``p``
    reaches it.  Downwards ``p`` has to come before all seeds below it as well, since it
    does not stop those that come earlier and lie just inside its tolerance.
    """
    k = walk.reach
    ahead = f"min(seq) OVER (PARTITION BY {KEY}, cell ORDER BY value ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    banded = _with_band(undecided.selectExpr("*", f"{ahead} AS before"), walk.tolerance, ["cell", "seq", "before"])
    out = []
    for side, cut, order, sign in (("above", "high + 1", "DESC", "+"), ("below", "low - 1", "ASC", "-")):
        asked = banded.where(f"{cut} > 0").selectExpr(
            KEY, f"{walk.cell(cut)} AS cell", f"{cut} AS value", "CAST(NULL AS bigint) AS own", "seq", "cell AS home", "before"
        )
        there = undecided.selectExpr(
            KEY, "cell", "value", "seq AS own", "CAST(NULL AS bigint) AS seq", "CAST(NULL AS bigint) AS home", "CAST(NULL AS bigint) AS before"
        )
        # the first seed of the cell beyond the cut; a seed at the cut itself counts
        beyond = f"min(own) OVER (PARTITION BY {KEY}, cell ORDER BY value {order}, own NULLS LAST ROWS UNBOUNDED PRECEDING)"
        cuts = there.unionByName(asked).selectExpr("*", f"{beyond} AS cut").where("own IS NULL").drop("own", "value")
        cuts = cuts.withColumnRenamed("cell", "at").join(cells.selectExpr(KEY, "cell AS home", side), [KEY, "home"])
        nearer, here = ("home + d < at", "home + d = at") if sign == "+" else ("home - d > at", "home - d = at")
        firsts = (
            f"filter(transform(sequence(1, {k + 1}), d -> named_struct('seq', CASE WHEN {nearer} THEN NULL"
            f" WHEN {here} THEN cut ELSE {side}[d - 1] END, 'd', d)), x -> x.seq IS NOT NULL)"
        )
        earlier = f"exists(sequence({k + 2}, {2 * k + 1}), d -> d <= m.d + {k} AND coalesce({side}[d - 1] < m.seq, false))"
        ruled = "true" if sign == "+" else f"coalesce(seq < before, true) AND forall(sequence(1, {k}), d -> coalesce(seq < below[d - 1], true))"
        out.append(cuts.where(ruled).selectExpr("*", f"array_min({firsts}) AS m").where(f"m IS NOT NULL AND NOT {earlier}").selectExpr(KEY, "seq", "m.seq AS next"))
    return out


def _drop_blocked(undecided: DataFrame, accepted: DataFrame, walk: Walk) -> DataFrame:
    """Seeds that are not accepted and that no accepted one rules out.

    An accepted amount rules out what comes later within its tolerance, and whatever
    would have ruled it out itself.
    """
    steps = f"sequence({-walk.reach}, {walk.reach})"
    near = accepted.selectExpr(KEY, f"explode(transform({steps}, d -> cell + d)) AS cell", "struct(value, seq) AS p")
    # a cell has one accepted seed at most
    near = near.groupBy(KEY, "cell").agg(F.collect_list("p").alias("accepted"))
    out = f"{walk.blocks('p.value', 'value')} AND (p.seq <= seq OR {walk.blocks('value', 'p.value')})"
    return (
        undecided.join(near, [KEY, "cell"], "left")
        .where(f"NOT coalesce(exists(accepted, p -> {out}), false)")
        .drop("accepted")
    )


def _payments(rows: DataFrame, amount: str, seq: str, words: tuple[str, ...]) -> DataFrame:
    return rows.selectExpr(
        KEY,
        f"{cents(amount)} AS value",
        "txn_date",
        f"{seq} AS seq",
        f"{bind('lower(description)', 'text_', contains_any('text_', words))} AS likely",
    )


def _with_descriptions(found: DataFrame, rows: DataFrame, row_no: str) -> DataFrame:
    """Fetch the seeds' descriptions last, so that no text travels through the search.

    ``row_no`` gets a seed's row number back from its place in the walk.
    """
    texts = rows.select(KEY, "row_no", "description")
    found = reliable_checkpoint(found)
    if found.count() <= BROADCAST_ROWS:  # else both sides are shuffled
        found = F.broadcast(found)
    return found.selectExpr("*", f"{row_no} AS row_no").join(texts, [KEY, "row_no"])


def recurring_payments(
    ledger: DataFrame,
    min_amount: float = 1000,
    min_occurrences: int = 3,
    amount_tolerance: float = 0.1,
    fold_limit: int = FOLD_LIMIT,
) -> DataFrame:
    """Recurring debits: similar amounts, with a loan word in the seed's text or a monthly cadence."""
    walk = Walk(amount_tolerance)
    rows = ledger.where(
        f"txn_type = 'debit' AND CAST(debit AS double) >= {float(min_amount)}D AND description IS NOT NULL"
    )
    amounts = _distinct_amounts(_payments(rows, "debit", "row_no", LOAN_WORDS))
    figures = band_figures(amounts, amounts, amount_tolerance)
    seeds = _seeds(figures, min_occurrences, f"n_dates >= 2 AND {_CADENCE}", "regular")
    return _with_descriptions(walk_seeds(seeds, walk, fold_limit), rows, "seq").selectExpr(
        KEY,
        "row_no",
        "CAST(CAST(value AS decimal(28,0)) / 100 AS decimal(28,2)) AS amount",
        "description",
        "CASE WHEN regular THEN 'monthly' ELSE 'unknown' END AS frequency",
        "members AS occurrences",
        "CASE WHEN likely AND regular THEN 'high' ELSE 'medium' END AS confidence",
        "first_date",
        "last_date",
    )


def recurring_members(payments: DataFrame, recurring: DataFrame, amount: str = "debit", amount_tolerance: float = 0.1) -> DataFrame:
    """The payments behind each recurring amount, with the days since the one before.

    ``statement_id, seed_row_no, row_no, txn_date, amount, gap_days``: ``payments`` are the rows the search
    was given, ``recurring`` its result with the same tolerance.  Payments meet the few accepted
    amounts in logarithmic cells, the exact test follows; a payment may belong to several.  Gaps
    are taken between days, not rows, so that a group of any size is ordered by its days only:
    the first payment of a day (by row) has the gap to the day before, later ones 0, the first of all and undated ones NULL.
    """
    walk = Walk(amount_tolerance)
    around = f"sequence({-walk.reach}, {walk.reach})" if amount_tolerance else "array(0)"
    cell = walk.cell if amount_tolerance else (lambda value: value)
    seeds = recurring.selectExpr(KEY, "row_no AS seed_row_no", f"{cents('amount')} AS seed")
    seeds = seeds.selectExpr("*", f"explode(transform({around}, d -> {cell('seed')} + d)) AS cell")
    rows = payments.selectExpr(KEY, "row_no", "txn_date", f"{cents(amount)} AS value").where("value > 0")
    members = (
        rows.withColumn("cell", F.expr(cell("value")))
        .join(seeds, [KEY, "cell"])
        .where(walk.blocks("seed", "value"))
        .selectExpr(KEY, "seed_row_no", "row_no", "txn_date", "CAST(CAST(value AS decimal(28,0)) / 100 AS decimal(28,2)) AS amount")
    )
    days = (
        members.where("txn_date IS NOT NULL")
        .groupBy(KEY, "seed_row_no", "txn_date")
        .agg(F.min("row_no").alias("first_row"))
        .withColumn("gap", F.expr(f"datediff(txn_date, lag(txn_date) OVER (PARTITION BY {KEY}, seed_row_no ORDER BY txn_date))"))
    )
    gap = "CASE WHEN row_no = first_row THEN gap WHEN first_row IS NOT NULL THEN 0 END"
    return members.join(days, [KEY, "seed_row_no", "txn_date"], "left").selectExpr(
        KEY, "seed_row_no", "row_no", "txn_date", "amount", f"{gap} AS gap_days"
    )


def report_recurring_payments(report: DataFrame, fold_limit: int = FOLD_LIMIT) -> DataFrame:
    """Recurring debits of the second report: narrower band, and three payments are enough."""
    rows = report.where("dr_cr_indicator = 'DR'")
    seq = f"coalesce({day_order()}, row_no)"
    amounts = _distinct_amounts(_payments(rows, "debit", seq, REPORT_LOAN_WORDS))
    large = amounts.where(f"value >= {REPORT_MIN_AMOUNT * 100}")
    figures = band_figures(amounts, large, REPORT_TOLERANCE)
    seeds = _seeds(figures, 2, f"members >= 3 AND n_dates >= 2 AND {_CADENCE}", "regular OR members >= 3")
    walk = Walk(REPORT_TOLERANCE, least_divisor=1.0)
    row_no = f"pmod(seq, {1 << ROW_BITS})"  # day_order refuses row numbers beyond
    return _with_descriptions(walk_seeds(seeds, walk, fold_limit), rows, row_no).selectExpr(
        KEY,
        "row_no",
        "CAST(CAST(value AS decimal(28,0)) / 100 AS decimal(28,2)) AS amount",
        "description",
        "members AS frequency",
        "likely AS likely_emi",
        "regular AS regular_pattern",
        "CASE WHEN likely AND regular THEN 'High' ELSE 'Medium' END AS confidence",
        "CAST(CAST(value * members AS decimal(38,0)) / 100 AS decimal(38,2)) AS total_paid",
        "first_date",
        "last_date",
    )


def recurring_totals(recurring: DataFrame) -> DataFrame:
    """Sum of the recurring amounts and their number."""
    return recurring.groupBy(KEY).agg(F.expr("sum(amount) AS total_emi"), F.expr("count(1) AS emi_count"))


def payment_gaps(payments: DataFrame, time: str = "txn_date", amount: str = "debit") -> DataFrame:
    """Mean gap in whole days between consecutive payments of the same amount.

    Works for dates and for timestamps, where every gap is floored to whole days.
    Payments are reduced to the first and last one per calendar day before they
    are put in order, so a group orders days, not payments.
    """
    days = (
        payments.where(f"{time} IS NOT NULL AND {amount} > 0")
        .selectExpr(KEY, f"{amount} AS amount", f"CAST({time} AS timestamp_ntz) AS ts")
        .groupBy(KEY, "amount", F.expr("CAST(ts AS date) AS day"))
        .agg(F.expr("count(1) AS n"), F.expr("min(ts) AS first_ts"), F.expr("max(ts) AS last_ts"))
    )
    before = f"lag(last_ts) OVER (PARTITION BY {KEY}, amount ORDER BY day)"
    return (
        days.selectExpr("*", f"timestampdiff(DAY, {before}, first_ts) AS gap")
        .groupBy(KEY, "amount")
        .agg(
            F.expr("sum(n) AS payments"),
            # gaps inside a day are 0
            F.expr("CAST(coalesce(sum(gap), 0) AS double) / nullif(sum(n) - 1, 0) AS mean_gap"),
        )
        .selectExpr(
            "*", f"coalesce(mean_gap BETWEEN {MONTHLY_DAYS[0]} AND {MONTHLY_DAYS[1]}, false) AS is_monthly"
        )
    )
