"""Metadata found across cells and blocks, against a search in the whole text."""

import random
import re

import pytest
from conftest import make_grid, plain

import ledgerloom as ll
from ledgerloom.operators import metadata as m


def whole_text(rows):
    """The expected fields, searched in the joined text of one statement."""
    width = max(len(r) for r in rows)
    padded = [[(c or "") for c in r] + [""] * (width - len(r)) for r in rows]
    by_column = " ".join(row[i] for i in range(width) for row in padded).upper()
    by_row = " ".join(c for row in padded for c in row).upper()

    def first(patterns, text):
        for p in patterns:
            found = re.search(p, text, re.ASCII)
            if found:
                return found.groups()
        return (None, None)

    name = None
    for p in m.NAME.values():
        found = re.search(p, by_column, re.ASCII)
        if found:
            text = found.group(1).strip()
            if len(text) > 3 and not re.search(m.NOT_A_NAME, text):
                name = text
                break
    period = first(m.PERIOD.values(), by_column)
    balance = [first([p], by_row)[0] for p in m.BALANCE.values()]
    return (
        first(m.ACCOUNT.values(), by_column)[0],
        first(m.IFSC.values(), by_column)[0],
        period[0],
        period[1],
        name,
        *[None if b is None else number(b) for b in balance],
    )


def number(text):
    try:
        return float(re.sub(r"[^\d.-]", "", text))
    except ValueError:
        return 0.0


WORDS = [
    None, None, "", " ", "Account", "No", "Account No", ":", ": :", "A/C No :", "12", "123456789012", "IFSC", "Code",
    "IFSC CODE ABCD0123456", "ABCD0123456", "From", "To", "01-02-2024", "28/02/24", "Period :", "Customer",
    "Name", "Customer Name :", "ASHA RAO", "BANK", "Opening", "Balance", "Opening Balance :", "Closing Balance",
    "1,000.50", "-5", "x9", "RAM", "Account Number", "from 1-1-24", "to: 2-2-24",
]


@pytest.mark.parametrize("block, edge, name_cells", [(4096, 8, 64), (4, 8, 2), (3, 6, 64), (30, 6, 1)])
def test_random_grids(spark, monkeypatch, block, edge, name_cells):
    # tiny blocks put most matches across block borders; an edge has to hold a match
    monkeypatch.setattr(m, "BLOCK", block)
    monkeypatch.setattr(m, "EDGE", edge)
    monkeypatch.setattr(m, "NAME_CELLS", name_cells)
    rng = random.Random(block)
    grids = {
        f"s{i}": [[rng.choice(WORDS) for _ in range(rng.randint(1, 4))] for _ in range(rng.choice([1, 5, 40, 90]))]
        for i in range(60)
    }
    for rows in grids.values():  # rows of a grid are equally wide
        width = max(len(r) for r in rows)
        for r in rows:
            r += [None] * (width - len(r))
    raw = make_grid(spark, grids)
    got = {r["statement_id"]: r for r in ll.account_metadata(raw).join(ll.text_balances(raw), "statement_id", "left").collect()}
    for k, rows in grids.items():
        r = got[k]
        values = (
            r["account_number"], r["ifsc_code"], r["period_from"], r["period_to"], r["customer_name"],
            *[None if r[c] is None else float(r[c]) for c in ("opening_balance", "closing_balance")],
        )
        assert values == whole_text(rows), (k, rows)


def test_long_name_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(m, "BLOCK", 4)
    rows = [["x1", "a"]] * 3 + [["Customer", "b"], ["Name :", "c"]] + [["MARIA", None]] * 30 + [["9", "d"]]
    (meta,) = plain(ll.account_metadata(make_grid(spark, {"s": rows})))
    assert meta["customer_name"] == " ".join(["MARIA"] * 30)


def test_balances_fall_back_to_the_ledger(spark):
    raw = make_grid(
        spark,
        {
            "s": [
                ["Date", "Description", "Debit", "Credit", "Balance"],
                ["01-01-2024", "A", "5", None, "95"],
                ["02-01-2024", "B", None, "7", None],
            ]
        },
    )
    (meta,) = plain(ll.process(raw).metadata)
    # a blank balance is 0 in the ledger
    assert (meta["opening_balance"], meta["closing_balance"]) == (95.0, 0.0)
    assert meta["account_number"] is None and meta["customer_name"] is None
