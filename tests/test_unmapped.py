"""Columns without a standard name, date formats per layout, and the walk over amounts far apart."""

import time
from datetime import date

from conftest import make_grid, make_ledger, plain
from pyspark.sql import functions as F

import ledgerloom as ll

GRID = [
    ["Tran Date", "Particulars", "Debit", "Credit", "Balance", "Teller", "Particulars", "Teller"],
    ["02-03-2024", "RENT", "1,200.50", None, "10", "T1", "flat 3", "x"],
    ["Jan 5, 2024", "SALARY", None, "5,000.00", "20", None, "", "y"],
    ["20240106", "FEE", "1", None, "30", "T2", None, None],
]


def test_unmapped_columns_are_kept(spark, tmp_path):
    done = ll.process(make_grid(spark, {"s": GRID}))
    rows = done.ledger.orderBy("row_no").collect()
    assert [r.extra for r in rows] == [
        {"teller": "T1", "particulars_1": "flat 3", "teller_1": "x"},
        {"teller": None, "particulars_1": "", "teller_1": "y"},
        {"teller": "T2", "particulars_1": None, "teller_1": None},
    ]
    assert [r.txn_date for r in rows] == [date(2024, 3, 2), date(2024, 1, 5), date(2024, 1, 6)]
    for fmt in ("csv", "parquet"):
        ll.write_ledger(done.ledger, str(tmp_path / fmt), fmt)
        back = ll.read_ledger(spark, str(tmp_path / fmt), fmt).orderBy("row_no").collect()
        assert back[0].extra == rows[0].extra and back[1].extra["teller_1"] == "y"


def test_date_formats_of_a_layout(spark):
    raw = make_grid(spark, {"day": GRID[:2], "month": GRID[:2]})
    layouts = ll.detect_layouts(raw).withColumn(
        "date_formats", F.expr("CASE WHEN statement_id = 'month' THEN array('M-d-yyyy', 'yyyy-M-d') END")
    )
    got = {r.statement_id: r.txn_date for r in ll.build_ledger(raw, layouts).collect()}
    assert got == {"day": date(2024, 3, 2), "month": date(2024, 2, 3)}


def test_walk_does_not_slow_down_with_accepted_amounts(spark):
    rows = [(3 * i + k, f"2024-0{k + 1}-0{k + 2}", "LOAN", 1000 + i * 7, 0, None) for i in range(2500) for k in range(3)]
    ledger = make_ledger(spark, rows).cache()
    ledger.count()
    took, found = [], []
    for tolerance in (0.1, 0.00001):
        start = time.time()
        found.append(ll.recurring_payments(ledger, amount_tolerance=tolerance).count())
        took.append(time.time() - start)
    assert found[1] == 2500 and found[0] < 100
    assert took[1] < 3 * took[0] + 5
    assert {r["occurrences"] for r in plain(ll.recurring_payments(ledger, amount_tolerance=0.00001))} == {3}
