"""Fill-in-middle transformation: texts cut at two units, their parts put in another order.

A unit is a run of ASCII letters or any other single code point.  One ``fullmatch`` of ``(unit)*`` keeps every
repetition of its group, so ``ends(1)`` holds the end of every unit: its length is the number of units, and
the two cuts are read from it.  Draws come from a hash of seed and id, so reruns and lost tasks change nothing.

Null and empty texts give an empty plain output; a null id is hashed as the empty text; rows with equal ids get
the same draws, each for its own text; other columns are not read.  A text that holds a sentinel stays plain,
since its parts could not be told apart.  A match keeps about 50 bytes for each unit of the text at hand.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ready
from .token_files import by_bytes

# possessive: nothing is kept for a way back, the repetitions are
UNITS = regex.compile(r"([A-Za-z]++|[^A-Za-z])*+")
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SENTINEL = regex.compile("|".join((PREFIX, SUFFIX, MIDDLE)))
#: Texts of a hundred that are transformed, and transformed ones of a hundred that begin with the suffix.
CHANGED, SUFFIX_FIRST = 90, 20


def draws(doc_id: int | None, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).digest()
    return [int.from_bytes(digest[k : k + 4]) for k in (0, 4, 8, 12)]


def transform(text: str, numbers: list[int], changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST) -> tuple[int, str, int | None, int | None, str]:
    """Units, form, code points of prefix and middle (None if plain), output."""
    ends = UNITS.fullmatch(text).ends(1)
    n, (one, two, form, order) = len(ends), numbers
    if not text or form % 100 >= changed or SENTINEL.search(text):
        return n, "plain", None, None, text
    first, second = sorted((one % (n + 1), two % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (first, second))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if order % 100 < suffix_first:
        return n, "spm", a, b - a, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle
    return n, "psm", a, b - a, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle


def fill_in_middle(
    docs: DataFrame, seed: int = 1, changed: int = CHANGED, suffix_first: int = SUFFIX_FIRST, doc_id: str = "doc_id", text: str = "text"
) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` of every text."""
    ready(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in by_bytes(batch):
                ids = part.column(0)
                found = [transform(t or "", draws(d, seed), changed, suffix_first) for d, t in zip(ids.to_pylist(), part.column(1).to_pylist())]
                n, form, prefix, middle, output = zip(*found)
                kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string())
                columns = [pa.array(x, kind) for x, kind in zip((n, form, prefix, middle, output), kinds)]
                yield pa.RecordBatch.from_arrays([ids, *columns], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])

    chosen = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return chosen.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: Column, form: Column) -> Column:
    """The text that gave an output."""
    parts = F.split(output, SENTINEL.pattern, -1)  # empty, then the three parts as they stand
    part = lambda k: F.get(parts, F.lit(k))
    return F.when(form == "psm", F.concat(part(1), part(3), part(2))).when(form == "spm", F.concat(part(2), part(3), part(1))).otherwise(output)
