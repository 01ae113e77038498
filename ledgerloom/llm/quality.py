"""Quality rules with risk-controlled thresholds.

A rule rejects a document when a measure of its text exceeds the rule's cutoff.  Cutoffs are chosen per
stratum (language) from a fixed grid, by exact (Clopper-Pearson) upper bounds on the share of the good labelled
documents (``quality`` 1) that are rejected.  With confidence ``1 - doubt`` no stratum loses more than ``risk`` of its
good documents to the rules together.  ``doubt`` is shared by the strata, and in a stratum by two searches:

* together: every set of rules is tightened step by step, the rules in turn, and what the set rejects as a whole is
  bounded by ``risk``.  A set's steps are nested and fixed by the bad labels alone, so they are tested in sequence up
  to the first failure without a correction; only the sets share the doubt.
* apart: every rule is tightened alone and bounded by ``risk / rules``.

Steps that reject no further labelled bad document are left out.  The certified cutoffs that reject most labelled bad
documents are used, the fewest and mildest if several do, none if they reject no bad one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce
from itertools import combinations
from math import exp, lgamma, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint
from .common import bytes_list, ready, text_bytes

RISK, DOUBT = 0.02, 0.05
SYMBOLS = b"#*$%&|<>"
LEAST_WORDS, MOST_REPEATED = 50, 50
BASE = f"n_words < {LEAST_WORDS} or 100 * n_repeat_words > {MOST_REPEATED} * n_words"
Counts = Counter[tuple[int, ...]]


@dataclass(frozen=True)
class Rule:
    """Rejects where ``measure`` (SQL over the measures below) exceeds the cutoff."""

    name: str
    measure: str
    grid: tuple[float, ...]


RULES = (
    Rule("symbols", "n_symbols / greatest(n_words, 1)", (0.02, 0.05, 0.1, 0.2, 0.3, 0.5, 1.0)),
    Rule("same_lines", "n_dup_lines / greatest(n_lines, 1)", (0.1, 0.2, 0.3, 0.4, 0.5, 0.7)),
    Rule("repeated_words", "n_repeat_words / greatest(n_words, 1)", (0.05, 0.1, 0.15, 0.2, 0.3, 0.4)),
    Rule("long_words", "word_chars / greatest(n_words, 1)", (8.0, 10.0, 12.0, 15.0, 20.0)),
    Rule("short_words", "-word_chars / greatest(n_words, 1)", (-3.0, -2.5, -2.0, -1.5)),
)


def measure(text: bytes) -> tuple[int, int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_lines, n_repeat_words of a whole text."""
    words = text.split()
    if not words:
        return 0, 0, len(text) - len(text.translate(None, SYMBOLS)), 0, 0, 0
    raw = np.frombuffer(b"".join(words), np.uint8)
    lines = [x for x in text.split(b"\n") if x.strip()]
    windows = list(zip(words, words[1:], words[2:]))
    repeated = 0
    if len(set(windows)) < len(windows):
        counts = Counter(windows)
        hit = np.zeros(len(words), dtype=bool)
        at = np.flatnonzero(np.fromiter((counts[w] > 1 for w in windows), bool, len(windows)))
        for k in range(3):
            hit[at + k] = True
        repeated = int(hit.sum())
    return (
        len(words),
        int(((raw & 0xC0) != 0x80).sum()),
        len(text) - len(text.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        len(lines),
        repeated,
    )


MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_lines", "n_repeat_words")


def measures(docs: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """The columns ``keep`` and the measures of every text; null and empty texts measure 0."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([measure(x) for x in bytes_list(batch.column(len(keep)))], dtype=np.int64).reshape(-1, len(MEASURES))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[: len(keep)], *(pa.array(found[:, k]) for k in range(len(MEASURES)))],
                names=[*batch.schema.names[: len(keep)], *MEASURES],
            )

    chosen = docs.select(*[F.col(f"`{c}`") for c in keep], text_bytes(text).alias("text__bytes"))
    schema = chosen.drop("text__bytes").schema
    for name in MEASURES:
        schema = schema.add(name, "long")
    return chosen.mapInArrow(run, schema)


def _beta_share(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - _beta_share(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, f, c, d = 1e-300, 1.0, 1.0, 0.0
    for i in range(100_000):
        m = i // 2
        if i == 0:
            term = 1.0
        elif i % 2 == 0:
            term = m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m))
        else:
            term = -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))
        d = 1 / ((1 + term * d) or tiny)
        c = (1 + term / c) or tiny
        f *= c * d
        if i and abs(1 - c * d) < 1e-14:
            break
    return front * (f - 1)


def upper_bound(k: int, n: int, doubt: float) -> float:
    """Exact upper confidence bound of a probability after ``k`` hits in ``n`` trials."""
    if k >= n:
        return 1.0
    low, high = k / n, 1.0
    for _ in range(60):
        p = (low + high) / 2
        # P(at most k hits) falls with p
        if _beta_share(n - k, k + 1, 1 - p) > doubt:
            low = p
        else:
            high = p
    return high


def _certified(good: Counts, bad: Counts, risk: float, doubt: float) -> dict[str, float]:
    """The cutoffs of one stratum; documents are counted by the number of each rule's cutoffs they exceed."""
    n, rules = sum(good.values()), range(len(RULES))

    def hits(counts: Counts, depth: tuple[int, ...]) -> int:
        # depth d of a rule is its d-th mildest cutoff
        least = [len(RULES[r].grid) - depth[r] + 1 for r in rules]
        return sum(c for levels, c in counts.items() if any(depth[r] and levels[r] >= least[r] for r in rules))

    def walk(members: tuple[int, ...], risk: float, doubt: float) -> tuple[int, ...]:
        depth = passed = (0,) * len(RULES)
        for d in range(1, max(len(RULES[r].grid) for r in members) + 1):
            for r in members:
                tighter = (*depth[:r], d, *depth[r + 1 :])
                if d <= len(RULES[r].grid) and hits(bad, tighter) > hits(bad, depth):
                    if upper_bound(hits(good, tighter), n, doubt) > risk:
                        return passed
                    depth = passed = tighter
        return passed

    if not n:
        return {}
    sets = [m for k in range(1, len(RULES) + 1) for m in combinations(rules, k)]
    found = [walk(m, risk, doubt / 2 / len(sets)) for m in sets]
    alone = [walk((r,), risk / len(RULES), doubt / 2 / len(RULES)) for r in rules]
    found.append(tuple(alone[r][r] for r in rules))
    best = max(found, key=lambda d: (hits(bad, d), -sum(x > 0 for x in d), -sum(d)))
    return {RULES[r].name: sorted(RULES[r].grid)[-best[r]] for r in rules if best[r]}


def choose_cutoffs(measured: DataFrame, labels: DataFrame, risk: float = RISK, doubt: float = DOUBT) -> dict[tuple, float]:
    """Certified cutoffs ``{(stratum, rule): cutoff}`` from all labelled documents.

    Labels without id or quality are ignored; a document with several labels counts once with each
    different one.  Bad documents that the base rules reject count for nothing.  A stratum without enough
    good labels certifies nothing.
    """
    known = labels.select("doc_id", "quality").where("doc_id is not null and quality in (0, 1)").distinct()
    levels = [reduce(lambda a, b: a + b, [F.expr(f"({r.measure}) > {c!r}D").cast("int") for c in r.grid]).alias(r.name) for r in RULES]
    rows = (
        measured.join(known, "doc_id")
        .select("stratum", "quality", F.expr(BASE).alias("base"), *levels)
        .groupBy("stratum", "quality", "base", *[r.name for r in RULES])
        .count()
        .collect()
    )
    strata: dict[str | None, tuple[Counts, Counts]] = {}
    for row in rows:
        good, bad = strata.setdefault(row["stratum"], (Counter(), Counter()))
        key = tuple(row[r.name] for r in RULES)
        if row["quality"] == 1:
            good[key] += row["count"]
        elif not row["base"]:
            bad[key] += row["count"]
    return {(s, name): c for s, (good, bad) in strata.items() for name, c in _certified(good, bad, risk, doubt / len(strata)).items()}


def judge(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per document: its id, the measures, ``base_failed`` and ``kept``.

    ``kept`` is false if the text has fewer than 50 words, if more than half of its words stand in
    repeated windows, or if a certified rule of its language (null is a stratum of its own) rejects it.
    """
    chosen = docs.select("doc_id", F.col("lang").alias("stratum"), "text")
    measured = reliable_checkpoint(measures(chosen, "doc_id", "stratum"))
    cutoffs = choose_cutoffs(measured, labels)
    strata = sorted({s for s, _ in cutoffs}, key=str)
    table = [(s, *(cutoffs.get((s, r.name)) for r in RULES)) for s in strata]
    schema = "of string, " + ", ".join(f"cut_{r.name} double" for r in RULES)
    cuts = docs.sparkSession.createDataFrame(table, schema)
    met = measured.join(cuts, measured["stratum"].eqNullSafe(cuts["of"]), "left")
    base = F.expr(BASE)
    rejects = [F.coalesce(F.expr(f"({r.measure}) > cut_{r.name}"), F.lit(False)) for r in RULES]
    return met.select(
        "doc_id",
        *MEASURES,
        base.alias("base_failed"),
        (~base & ~reduce(lambda a, b: a | b, rejects)).alias("kept"),
    )
