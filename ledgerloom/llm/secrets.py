"""Secret scan: a trigram inverted index picks the documents each rule is verified on.

Every rule's regular expression yields a Boolean query over trigrams (``trigrams.py``).  The index holds,
for each trigram that some rule asks for, the ids of the documents with it; queries are answered from the
index alone, and only the candidates of a rule are scanned with its expression.  A rule without mandatory
trigrams scans every text.  All of it is DataFrame functions.

A document is found again by its id: rows with equal ids are candidates together, a null id is an id
of its own.  Null and empty texts have no spans.  Other columns are not read.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .trigrams import Query, trigram_query, trigrams_of


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``at_least`` code points."""

    kind: str
    pattern: str
    group: int = 0
    at_least: int = 0

    @property
    def query(self) -> Query:
        return trigram_query(self.pattern)


BASE_RULES = (
    Rule("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", r"[0-9a-f]+", 0, 24),
)
MORE_RULES = (
    Rule("session", r"ASIA[A-Z0-9]+", 0, 20),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]+", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 0, 15),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]+", 0, 24),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 0, 40),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 0),
)


def _any_of(trigrams: set[str]) -> str:
    """An expression that looks for all trigrams at once, branching letter by letter."""
    tree: dict[str, dict[str, set[str]]] = {}
    for t in sorted(trigrams):
        tree.setdefault(t[0], {}).setdefault(t[1], set()).add(t[2])
    esc = lambda c: "\\" + c if not c.isalnum() else c
    set_of = lambda s: "[" + "".join(map(esc, sorted(s))) + "]"
    second = {a: "|".join(f"{esc(b)}{set_of(c)}" for b, c in rest.items()) for a, rest in tree.items()}
    return f"(?={set_of(set(tree))})(?=(" + "|".join(f"{esc(a)}(?:{rest})" for a, rest in second.items()) + "))"


def build_index(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Postings ``(trigram, doc_id)`` of the trigrams that the rules ask for, over lower-cased texts."""
    wanted = set().union(*(trigrams_of(r.query) for r in rules))
    if not wanted:
        return docs.select(F.lit("").alias("trigram"), "doc_id").limit(0)
    found = F.regexp_extract_all(F.lower("text"), F.lit(_any_of(wanted)), F.lit(1))
    return docs.where("text is not null").select(F.explode(F.array_distinct(found)).alias("trigram"), "doc_id")


def _evaluate(query: Query, have: Column) -> Column:
    if isinstance(query, str):
        return F.array_contains(have, query)
    parts = [_evaluate(q, have) for q in query[1]]
    return reduce(lambda a, b: a & b if query[0] == "and" else a | b, parts)


def candidates(index: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id, kinds``: for each document the rules whose query its postings answer."""
    have = index.groupBy("doc_id").agg(F.collect_set("trigram").alias("have"))
    asked = [(r.kind, r.query) for r in rules if r.query is not None]
    kinds = F.array(*[F.when(_evaluate(q, F.col("have")), F.lit(k)) for k, q in asked])
    return have.select("doc_id", F.array_compact(kinds).alias("kinds")).where(F.size("kinds") > 0)


def spans(rule: Rule, order: int, text: str = "text") -> Column:
    """``array<struct<start, kind_no, stop, kind>>`` of a rule's matches, in code points, the end exclusive."""
    pattern, t = rule.pattern, F.col(text)
    run = re.fullmatch(r"(\w*)(\[[^]]*\])\+", pattern)
    if not rule.group and run and re.fullmatch(f"{run[2]}*", run[1]):
        # a head and a run of a class that holds the head: the expression itself can leave out short runs
        pattern = f"{run[1]}{run[2]}{{{max(1, rule.at_least - len(run[1]))},}}"
    found = F.regexp_extract_all(t, F.lit(pattern), F.lit(0))
    checked = F.regexp_extract_all(t, F.lit(pattern), F.lit(rule.group)) if rule.group else found
    pieces = F.arrays_zip(F.split(t, pattern, -1).alias("before"), found.alias("found"), checked.alias("checked"))

    def step(state: Column, x: Column) -> Column:
        start = state["at"] + F.length(x["before"])
        stop = start + F.length(x["found"])
        one = F.array(F.struct(start.alias("start"), F.lit(order).alias("kind_no"), stop.alias("stop"), F.lit(rule.kind).alias("kind")))
        out = F.when(F.length(x["checked"]) >= rule.at_least, F.concat(state["out"], one)).otherwise(state["out"])
        return F.struct(F.coalesce(stop, start).alias("at"), out.alias("out"))

    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,stop:int,kind:string>>)")
    folded = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), none.alias("out")), step)["out"]
    return F.when(F.regexp_like(t, F.lit(pattern)), folded).otherwise(none)


def joined(found: Column) -> Column:
    """``kind:start:end`` by start, then kind as listed, comma-joined."""
    text = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["stop"].cast("string"))
    return F.array_join(F.transform(F.array_sort(found), text), ",")


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """``doc_id`` and a column of spans for each rule, named by its kind; one row per document."""
    chosen = docs.select("doc_id", "text")
    index = reliable_checkpoint(build_index(chosen, rules))
    asked = reliable_checkpoint(candidates(index, rules)).withColumnRenamed("doc_id", "asked_id")
    met = chosen.join(asked, chosen["doc_id"].eqNullSafe(asked["asked_id"]), "left").drop("asked_id")
    none = F.expr("cast(array() as array<struct<start:int,kind_no:int,stop:int,kind:string>>)")
    text = F.coalesce("text", F.lit(""))
    met = met.withColumn("text", text)
    columns = [
        (spans(r, k) if r.query is None else F.when(F.array_contains("kinds", r.kind), spans(r, k)).otherwise(none)).alias(r.kind)
        for k, r in enumerate(rules)
    ]
    return met.select("doc_id", *columns)


def secret_report(docs: DataFrame) -> DataFrame:
    """Counts of the base kinds, the hash of their spans, and all spans as text; one row per document."""
    found = find_secrets(docs, (*BASE_RULES, *MORE_RULES))
    base = F.concat(*[F.col(r.kind) for r in BASE_RULES])
    every = F.concat(*[F.col(r.kind) for r in (*BASE_RULES, *MORE_RULES)])
    return found.select(
        "doc_id",
        *[F.size(r.kind).cast("long").alias(f"n_{r.kind}") for r in BASE_RULES],
        F.sha2(joined(base), 256).alias("base_sha256"),
        joined(every).alias("spans"),
    )
