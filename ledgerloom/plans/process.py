"""From raw cells to the processed parts of many statements."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame

from ..functions.text import DAY_FIRST
from ..operators.grid import detect_layouts
from ..operators.metadata import statement_metadata
from ..operators.typing import build_ledger, infer_date_formats, rejected_cells
from ..session import reliable_checkpoint


@dataclass
class Statements:
    """Parts of processed statements; metadata is searched when first asked for, and once."""

    raw: DataFrame
    layouts: DataFrame
    ledger: DataFrame
    materialize: bool = False
    date_formats: Iterable[str] = DAY_FIRST

    @cached_property
    def metadata(self) -> DataFrame:
        found = statement_metadata(self.raw, self.ledger)
        return reliable_checkpoint(found) if self.materialize else found

    @property
    def rejects(self) -> DataFrame:
        """The cells that gave the ledger no value, with the reason."""
        return rejected_cells(self.raw, self.layouts, self.date_formats)


def process(
    raw: DataFrame, date_formats: Iterable[str] | None = DAY_FIRST, materialize: bool = False
) -> Statements:
    """Layouts, ledger and metadata of all statements in ``raw``.

    ``date_formats=None`` infers the formats of every date column from its cells.

    Layouts, one row per statement, are written to the checkpoint folder: every part reads them.
    With ``materialize`` ledger and metadata are written too,
    so that the many summaries of a report do not repeat the parsing.
    """
    layouts = detect_layouts(raw)
    if date_formats is None:
        layouts, date_formats = infer_date_formats(raw, layouts), DAY_FIRST
    layouts = reliable_checkpoint(layouts)
    ledger = build_ledger(raw, layouts, date_formats)
    if materialize:
        ledger = reliable_checkpoint(ledger)
    return Statements(raw, layouts, ledger, materialize, date_formats)
