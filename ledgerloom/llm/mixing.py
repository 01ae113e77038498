"""Mixing sources to target weights: repetition rates from token counts, whole copies plus one seeded draw.

Sources in code point order (null last) weigh 5, 2, 1 and so on again.  They share the corpus by weight; no
target exceeds ``MOST`` times its source, the excess goes to the others by weight until none is above.  A
document is taken floor(rate) times, and once more if its draw falls below the fraction.  A draw is a hash of
seed and id, turned by one of ``TURNS`` equal steps: every turn gives each document the same chance, and a
source uses the turn whose words come nearest to its target, which matters where a few very long documents
make up much of a source.  Draws do not depend on the partitioning, so reruns agree; rows with equal ids draw
alike, a null id draws by its text.  Null and empty texts have size 0 and are taken like the others of their source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import WORD

WEIGHTS, MOST, SEED = (5, 2, 1), 3, "mix-1"
BITS, TURNS = 52, 32


def size(text: str = "text") -> Column:
    return F.coalesce(F.regexp_count(F.col(text), F.lit(WORD)), F.lit(0)).cast("long")


def draw(seed: str = SEED) -> Column:
    """52 bits of a hash."""
    name = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("text")), F.lit("none"))
    digits = F.substring(F.md5(F.concat(F.lit(seed + " "), name).cast("binary")), 1, 13)
    return F.conv(digits, 16, 10).cast("long")


def source_targets(sizes: DataFrame) -> DataFrame:
    """``source, source_size, target`` of every source of ``(source, size)``; one row per source is ordered in one task."""
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in WEIGHTS]), (place % len(WEIGHTS) + 1).cast("int"))
    weighed = totals.withColumn("place", place).withColumn("weight", weight)
    # sources by how soon they reach their limit: the level that the rest would get if all before are full
    order = Window.orderBy(F.col("source_size") / F.col("weight"), "place")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    every = Window.partitionBy()
    full = F.coalesce(F.sum(MOST * F.col("source_size")).over(before), F.lit(0))
    spent = F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (F.sum("source_size").over(every) - full) / (F.sum("weight").over(every) - spent)
    levelled = weighed.withColumn("level", level).withColumn("level", F.max("level").over(every))
    target = F.least((MOST * F.col("source_size")).cast("double"), F.col("level") * F.col("weight"))
    return levelled.select("source", "source_size", target.alias("target"))


def _copies(turn: Column) -> Column:
    rate = F.when(F.col("source_size") > 0, F.least(F.lit(float(MOST)), F.col("target") / F.col("source_size"))).otherwise(0.0)
    turned = (F.col("draw") + turn * (1 << BITS) / F.lit(TURNS)).cast("long") % (1 << BITS)
    once_more = turned / F.lit(float(1 << BITS)) < rate - F.floor(rate)
    return (F.floor(rate) + once_more.cast("long")).cast("long")


def _met(docs: DataFrame, targets: DataFrame) -> DataFrame:
    named = targets.withColumnRenamed("source", "source__of")
    return docs.join(named, docs["source"].eqNullSafe(named["source__of"]), "left").drop("source__of")


def source_plan(sized: DataFrame) -> DataFrame:
    """``source, source_size, target, turn`` of every source of ``(source, size, draw)``."""
    targets = reliable_checkpoint(source_targets(sized))
    takes = [F.sum(F.col("size") * _copies(F.lit(k))).alias(f"take{k}") for k in range(TURNS)]
    tried = _met(sized, targets).groupBy("source", "source_size", "target").agg(*takes)
    far = F.array_min(F.array(*[F.struct(F.abs(F.col(f"take{k}") - F.col("target")), F.lit(k).alias("turn")) for k in range(TURNS)]))
    return tried.select("source", "source_size", "target", far["turn"].alias("turn"))


def plan_mix(docs: DataFrame) -> DataFrame:
    """``doc_id, size, source_size, target, taken`` of every document."""
    sized = reliable_checkpoint(docs.select("doc_id", "source", size().alias("size"), draw().alias("draw")))
    plan = reliable_checkpoint(source_plan(sized))
    return _met(sized, plan).select(
        "doc_id", "size", "source_size", "target", (F.col("size") * _copies(F.col("turn"))).alias("taken")
    )


def mix(docs: DataFrame) -> DataFrame:
    """The mixed corpus: every document as often as it is taken, the columns unchanged."""
    sized = reliable_checkpoint(docs.select("source", size().alias("size"), draw().alias("draw")))
    plan = reliable_checkpoint(source_plan(sized))
    columns = [F.col(f"`{c}`") for c in docs.columns]
    own = docs.select(F.struct(*columns).alias("row"), "source", draw().alias("draw"))
    taken = _met(own, plan).withColumn("copies", _copies(F.col("turn")))
    return taken.select("row", F.explode(F.array_repeat(F.lit(True), F.col("copies").cast("int")))).select("row.*")
