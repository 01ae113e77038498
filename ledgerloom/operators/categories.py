"""Expense categories and income sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.keywords import category_rank, classify
from ..rules import EXPENSE_RULES, INCOME_RULES, REPORT_EXPENSE_RULES, RuleSet
from ..schemas import KEY
from .flows import rollup


def _ranked(totals: DataFrame, rules: RuleSet) -> DataFrame:
    """Add ``rule_order`` and ``position`` by amount; a statement has one row per category here."""
    return totals.withColumn("rule_order", F.expr(category_rank("category", rules))).withColumn(
        "position",
        F.expr(f"row_number() OVER (PARTITION BY {KEY} ORDER BY amount DESC, rule_order)"),
    )


def expense_totals(flow: DataFrame) -> DataFrame:
    """Debit total per category, zero totals left out."""
    return (
        flow.where("expense > 0")
        .groupBy(KEY, F.col("expense_category").alias("category"))
        .agg(F.sum("expense").alias("amount"))
        .where("amount > 0")
    )


def expense_categories(flow: DataFrame, rules: RuleSet = EXPENSE_RULES) -> DataFrame:
    """Debit total per category, zero totals left out; ``position`` 1 is the largest."""
    return _ranked(expense_totals(flow), rules).drop("rule_order")


def top_expenses(flow: DataFrame, n: int = 5, rules: RuleSet = EXPENSE_RULES) -> DataFrame:
    return expense_categories(flow, rules).where(f"position <= {n}")


def report_expense_categories(report: DataFrame, rules: RuleSet = REPORT_EXPENSE_RULES) -> DataFrame:
    """Debit total and share per category of the second report, largest first."""
    totals = (
        report.where("dr_cr_indicator = 'DR'")
        .selectExpr(KEY, "category" if "category" in report.columns else f"{classify('description', rules)} AS category", "debit")
        .groupBy(KEY, "category")
        .agg(F.sum("debit").alias("amount"))
        .where("amount > 0")
    )
    whole = f"CAST(sum(amount) OVER (PARTITION BY {KEY}) AS double)"
    return _ranked(totals, rules).withColumn(
        "percentage", F.expr(f"CAST(amount AS double) / {whole} * 100")
    )


#: The largest category, and what stands for it where nothing was spent.
LARGEST = ["coalesce(category, 'None') AS category", "coalesce(amount, CAST(0 AS decimal(28,2))) AS amount", "percentage"]


def largest_category(report: DataFrame, rules: RuleSet = REPORT_EXPENSE_RULES) -> DataFrame:
    """The category with the highest total; 'None', 0 and no percentage without expenses."""
    return largest_of(report, report_expense_categories(report, rules))


def largest_of(report: DataFrame, shares: DataFrame) -> DataFrame:
    """``largest_category`` from the categories already computed."""
    largest = shares.where("position = 1").select(KEY, "category", "amount", "percentage")
    return report.select(KEY).distinct().join(largest, KEY, "left").selectExpr(KEY, *LARGEST)


def _grams(text: str, n: int) -> str:
    """All runs of ``n`` characters of a text, overlaps included."""
    return f"regexp_extract_all({text}, '(?s)(?=(.{{{n}}}))', 1)"


def rarest_grams(words: DataFrame, texts: DataFrame) -> DataFrame:
    """``(word, gram)``: of the trigrams of each word the one that the fewest texts hold.

    A word with a trigram that no text holds is in none and left out; words of fewer than three
    characters are their own gram.  Trigrams of the texts are added up before they are shuffled.
    """
    held = texts.selectExpr(f"explode(array_distinct({_grams('text_', 3)})) AS gram").groupBy("gram").agg(F.expr("count(*) AS n"))
    wanted = words.where("length(word) >= 3").select("word").distinct()
    pairs = wanted.selectExpr("word", f"explode(array_distinct({_grams('word', 3)})) AS gram")
    best = (
        pairs.join(held, "gram", "left")
        .groupBy("word")
        .agg(F.expr("min(struct(coalesce(n, 0) AS n, gram)) AS best"))
        .where("best.n > 0")
        .selectExpr("word", "best.gram AS gram")
    )
    return best.unionByName(words.where("length(word) < 3").select("word").distinct().selectExpr("word", "word AS gram"))


def classify_by_table(rows: DataFrame, rules: DataFrame, default: str, text: str = "description") -> DataFrame:
    """Add ``category`` by a rule table ``(priority, category, keywords)`` of any size.

    The rule of lowest priority with a keyword inside the lower-case text wins, ``default`` where none has.
    Texts and keywords meet on the keyword's rarest trigram, so neither side is collected or paired in full, and
    keywords with a common beginning meet in different keys; each distinct text is classified once.
    """
    words = rules.selectExpr("priority", "category", "explode(keywords) AS word").where("word IS NOT NULL")
    # of the rules with a word the first one counts
    words = words.groupBy("word").agg(F.min(F.struct("priority", "category")).alias("rule_"))
    texts = rows.select(F.lower(text).alias("text_")).where("text_ IS NOT NULL").distinct()
    held = f"array_distinct(flatten(array(array(''), {', '.join(_grams('text_', n) for n in (1, 2, 3))})))"
    found = (
        texts.selectExpr("text_", f"explode({held}) AS gram")
        .join(words.join(rarest_grams(words, texts), "word"), "gram")
        .where("contains(text_, word)")
        .groupBy("text_")
        .agg(F.min("rule_").alias("rule_"))
        .selectExpr("text_", "rule_.category AS category")
    )
    named = rows.join(found, F.lower(rows[text]) == found["text_"], "left").drop("text_")
    return named.withColumn("category", F.coalesce("category", F.lit(default)))


def monthly_income(flow: DataFrame) -> DataFrame:
    return rollup(flow.where("month IS NOT NULL"), "month").selectExpr(KEY, "month", "credit AS income")


#: Income of a statement from its measures by month.
INCOME = [
    "sum(credit) AS total_income",
    "avg(CASE WHEN month IS NOT NULL THEN CAST(credit AS double) END) AS average_monthly_income",
]


def income_summary(flow: DataFrame) -> DataFrame:
    """Total income and its mean over the months of the statement."""
    return rollup(flow, "month").groupBy(KEY).agg(*map(F.expr, INCOME))


def income_sources(flow: DataFrame, rules: RuleSet = INCOME_RULES) -> DataFrame:
    """Credit total per source, in rule order, zero totals left out."""
    return (
        flow.where("income > 0")
        .groupBy(KEY, F.col("income_source").alias("source"))
        .agg(F.sum("income").alias("amount"))
        .where("amount > 0")
        .withColumn("rule_order", F.expr(category_rank("source", rules)))
    )
