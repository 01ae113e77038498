"""Exact quantiles, unusual payments, page numbers, files and combined reports."""

import random
import statistics
from datetime import date

import pytest
from pyspark.sql import functions as F
from conftest import make_ledger, plain

import ledgerloom as ll
from ledgerloom.rules import EXPENSE_RULES, rules_from_frame


def quantile(values, share):
    values = sorted(values)
    place = share * (len(values) - 1)
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] + (values[high] - values[low]) * (place - low)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.0, 1.0])
def test_quantile(spark, share):
    rng = random.Random(3)
    groups = {}
    for i in range(25):
        n = rng.choice([1, 2, 3, 10, 11, 21, 200])
        pool = rng.choice([[0, 0, 0, 5], [0.01, 0.02], [10**7, 10**7 + 0.01, 3], None, [-5, -7.5, 2]])
        groups[f"s{i}"] = [rng.choice(pool) if pool else round(rng.expovariate(0.01), 2) for _ in range(n)]
    rows = [(k, i, float(v)) for k, vs in groups.items() for i, v in enumerate(vs)]
    ledger = spark.createDataFrame(rows, "statement_id string, row_no bigint, d double").selectExpr(
        "statement_id", "row_no", "CAST(d AS decimal(18,2)) AS debit"
    )
    got = {r["statement_id"]: r for r in ll.large_transactions(ledger, share).collect()}
    for k, values in groups.items():
        threshold = quantile(values, share)
        assert got[k]["threshold"] == pytest.approx(threshold)
        large = [v for v in values if v >= got[k]["threshold"]]
        assert got[k]["count"] == len(large), (k, values)
        assert float(got[k]["total_amount"]) == pytest.approx(sum(large))


def test_sketched_quantile(spark):
    """Sketches of days add up to that of all rows; the threshold is within a bucket's width, the rank within a bucket."""
    rng = random.Random(2)
    amounts = {"s": [round(rng.lognormvariate(4, 2), 2) for _ in range(2000)], "t": [0.0] * 50, "u": [7.31], "v": [0.0, 0.05, 12.0, 120.0]}
    rows = [(k, i, date(2024, 1, 1 + i % 9), f"{v:.2f}") for k, values in amounts.items() for i, v in enumerate(values)]
    ledger = spark.createDataFrame([*rows, ("w", 0, None, None)], "statement_id string, row_no int, txn_date date, d string").selectExpr(
        "statement_id", "row_no", "txn_date", "CAST(d AS decimal(28,2)) AS debit"
    )
    days = ll.debit_sketch(ledger, "txn_date")
    got = {r["statement_id"]: r for r in ll.sketched_large_transactions(days).collect()}
    assert sorted(map(str, got.values())) == sorted(map(str, ll.sketched_large_transactions(ll.debit_sketch(ledger)).collect()))
    assert set(got) == set(amounts)  # a statement without debits has none, as in the exact query
    for k, values in amounts.items():
        want = quantile(values, 0.9)
        assert abs(got[k]["threshold"] - want) <= 0.01 * want, k
        assert got[k]["all_n"] == len(values)
        assert abs(got[k]["count"] - sum(v >= want for v in values)) <= max(1, 0.01 * len(values)), k
    assert float(got["t"]["total_amount"]) == 0 and got["t"]["count"] == 50
    with pytest.raises(ValueError):
        ll.debit_sketch(ledger, digits=9)


def test_unusual_edges(spark):
    single = make_ledger(spark, [(1, "2024-01-01", "A", 5, 0, None)], "one")
    same = make_ledger(spark, [(i, None, "A", 5, 0, None) for i in range(4)], "same")
    spiky = [(i, None, "A", 1, 0, None) for i in range(30)] + [(99, None, "B", 1000, 0, None)]
    found = ll.unusual_transactions(single.unionByName(same).unionByName(make_ledger(spark, spiky, "spiky")))
    (r,) = found.collect()
    values = [1] * 30 + [1000]
    assert r["row_no"] == 99
    assert r["deviation_factor"] == pytest.approx((1000 - statistics.mean(values)) / statistics.stdev(values))


def test_equal_dates_are_ordered_by_row(spark):
    rows = [(3, "2024-01-05", "A", 1, 0, 30), (1, "2024-01-05", "B", 1, 0, 10), (2, "2024-01-05", "C", 1, 0, None)]
    flow = ll.flows(make_ledger(spark, rows))
    (m,) = plain(ll.monthly_summary(flow))
    assert (m["opening_balance"], m["closing_balance"]) == (10, 30)
    report = ll.report_ledger(make_ledger(spark, rows))
    assert plain(ll.end_balance(report)) == [{"eod_balance": 30.0}]


def test_end_balance_without_balances(spark):
    rows = [(1, "2024-01-05", "A", 10, 0, None), (2, "2024-01-06", "B", 0, 25, None), (3, None, "C", 99, 0, None)]
    assert plain(ll.end_balance(ll.report_ledger(make_ledger(spark, rows)))) == [{"eod_balance": 15.0}]


def test_totals_add_up(golden, spark):
    undated = make_ledger(spark, [(10, None, "ODD", 33, 0, None)])
    flow = ll.flows(golden.unionByName(undated))
    total = plain(ll.transaction_summary(flow))[0]["total_debit"]
    assert sum(c["amount"] for c in plain(ll.expense_categories(flow))) == total
    assert sum(m["total_debit"] for m in plain(ll.monthly_summary(flow))) == total - 33


def test_no_expenses(spark):
    report = ll.report_ledger(make_ledger(spark, [(1, "2024-01-01", "PAY", 0, 10, None)]))
    assert plain(ll.largest_category(report)) == [{"category": "None", "amount": 0.0, "percentage": None}]
    text = [r["text"] for r in ll.report_lines(ll.comprehensive_report(report)).collect()]
    assert "No recurring EMI patterns detected." in text
    assert "Percentage: n/a of total expenses" in text


def test_categories_first_match(spark):
    texts = ["SUPERMARKET", "HOTEL", "FLIGHT", "Amazon Pay UPI", "gas station", "XYZ"]
    rows = [(i, "2024-01-01", t, 10 + i, 0, None) for i, t in enumerate(texts)]
    got = {c["category"]: c["amount"] for c in plain(ll.expense_categories(ll.flows(make_ledger(spark, rows))))}
    assert got == {
        "Shopping": 10 + 13, "Food & Dining": 11, "Transportation": 12 + 14, "Uncategorized": 15,
    }


def test_custom_rules(spark, golden):
    same = rules_from_frame(EXPENSE_RULES.to_frame(spark), "Uncategorized")
    assert same.categories == EXPENSE_RULES.categories
    frame = spark.createDataFrame(
        [(2, "Late", ["xyz"]), (1, "It's early", ["xyz", "atm"])], "priority int, category string, keywords array<string>"
    )
    mine = rules_from_frame(frame, "Rest")
    got = {c["category"]: c["amount"] for c in plain(ll.expense_categories(ll.flows(golden, mine), mine))}
    assert got == {"It's early": 2150, "Rest": 30500}


def test_rule_table_by_joins(spark):
    rules = spark.createDataFrame(
        [(i, f"c{i}", [f"key{i}", "z" * (i % 3 + 1)] if i > 11_990 else [f"key{i}x"]) for i in range(12_000)] + [(-1, "all caps", ["%_(", "ab"])],
        "priority int, category string, keywords array<string>",
    )
    texts = ["KEY11995 here", "nothing", "a zz b", None, "", "xAB", "50%_(", "key7 key7x"]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    got = {r.i: r.category for r in ll.classify_by_table(rows, rules, "Rest").collect()}
    assert got == {0: "c11995", 1: "Rest", 2: "c11991", 3: "Rest", 4: "Rest", 5: "all caps", 6: "all caps", 7: "c7"}


def test_many_keywords_with_one_beginning(spark):
    """No trigram brings together more than a small share of what meets, and the rules are those of a direct search."""
    from ledgerloom.operators import categories

    rng = random.Random(3)
    numbers = rng.sample(range(100_000), 50_000)
    rules = spark.createDataFrame([(i, f"c{n}", [f"transfer to {n:05d}"]) for i, n in enumerate(numbers)], "priority int, category string, keywords array<string>")
    texts = [f"Transfer to {rng.randrange(100_000):05d} ref {rng.randrange(1000)}" for _ in range(3000)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, description string")
    got = {r.i: r.category for r in ll.classify_by_table(rows, rules, "Rest").collect()}
    known = set(numbers)
    assert got == {i: f"c{n}" if (n := int(t.split()[2])) in known else "Rest" for i, t in enumerate(texts)}

    lower = rows.select(F.lower("description").alias("text_"))
    keys = categories.rarest_grams(rules.selectExpr("explode(keywords) AS word"), lower).groupBy("gram").agg(F.count("*").alias("words"))
    meet = lower.join(keys, F.expr("contains(text_, gram)")).groupBy("gram").agg(F.sum("words").alias("n"))
    most, whole = meet.agg(F.max("n"), F.sum("n")).first()
    assert most <= 0.01 * whole and whole < 0.01 * len(numbers) * len(texts)


def test_page_numbers(spark, monkeypatch):
    from ledgerloom.sources import grids

    monkeypatch.setattr(grids, "PAGE_GROUP", 2)
    rng = random.Random(1)
    pages = [(k, p, r, [f"{k}{p}-{r}"]) for k in "ab" for p in range(11) for r in range(rng.randint(1, 4))]
    shuffled = rng.sample(pages, len(pages))
    df = spark.createDataFrame(shuffled, "statement_id string, page_no int, page_row int, cells array<string>")
    got = [(r["statement_id"], r["row_no"], r["cells"]) for r in grids.number_page_rows(df).orderBy("statement_id", "row_no").collect()]
    want = []
    for k in "ab":
        want += [(k, i, p[3]) for i, p in enumerate(p for p in pages if p[0] == k)]
    assert got == want


def test_pages_of_different_width(spark):
    wide = spark.createDataFrame([("s", "a", "b")], "statement_id string, c0 string, c1 string")
    narrow = spark.createDataFrame([("s", "c")], "statement_id string, c0 string")
    got = sorted(map(tuple, ll.concat_pages([wide, narrow]).collect()), key=str)
    assert got == [("s", "a", "b"), ("s", "c", None)]


def test_read_extracted_files(spark, tmp_path):
    (tmp_path / "one.csv").write_text('0,1,2\nTran Date,Debit,"Credit"\n01-01-2024,"1,000.00",\n,,\n02-01-2024,NaN,5\n')
    (tmp_path / "two.csv").write_text("0,1\nDate Amount,Balance\n01-01-2024,\"a \"\"b\"\"\"\n")
    raw = ll.read_grids(spark, str(tmp_path))
    got = {}
    for r in raw.orderBy("row_no").collect():
        got.setdefault(r["statement_id"][-7:], []).append(r["cells"])
    assert got["one.csv"] == [
        ["Tran Date", "Debit", "Credit"], ["01-01-2024", "1,000.00", None], [None, None, None], ["02-01-2024", None, "5"],
    ]
    assert got["two.csv"] == [["Date Amount", "Balance"], ["01-01-2024", 'a "b"']]


def test_lines_of_any_width(spark, tmp_path):
    wide = [f"c{i}" for i in range(300)]
    gap = ["a"] * 63 + ["", "", "x"] + [""] * 4
    text = "0,1\n" + ",".join(wide) + "\n" + ",".join(gap) + '\n"q,""1""",,"open\nlast\n'
    (tmp_path / "w.csv").write_text(text)
    rows = [r["cells"] for r in ll.read_grids(spark, str(tmp_path)).orderBy("row_no").collect()]
    assert rows == [wide, ["a"] * 63 + [None, None, "x"] + [None] * 4, ['q,"1"', None, '"open'], ["last"]]


def test_long_amounts_are_kept(spark):
    from ledgerloom.functions.text import amount_flaw, clean_amount

    cells = ["12345678901234567.00", "-99,999,999,999,999,999.5 Cr", "1.2.3", "x", "", None]
    df = spark.createDataFrame([(c,) for c in cells], "c string").selectExpr(f"{clean_amount('c')} AS v")
    assert [str(r.v) for r in df.collect()] == ["12345678901234567.00", "-99999999999999999.50", "0.00", "0.00", "0.00", "0.00"]
    # a longer one counts as 0 and is named as a reject
    df = spark.createDataFrame([(c,) for c in ("9" * 40, *cells)], "c string").selectExpr(f"{clean_amount('c')} AS v", f"{amount_flaw('c')} AS flaw")
    assert [(r.v == 0, r.flaw) for r in df.collect()][:4] == [(True, "too long"), (False, None), (False, None), (True, "not a number")]


def test_recurring_with_large_row_numbers(spark, golden):
    moved = golden.withColumn("row_no", F.expr(f"row_no + {1 << 41}"))
    want, got = (plain(ll.recurring_payments(x), "row_no") for x in (golden, moved))
    assert [{**r, "row_no": r["row_no"] + (1 << 41)} for r in want] == got and got


def test_line_order_of_split_files(spark, tmp_path):
    lines = "".join(f"row {i},x\n" for i in range(40000))
    (tmp_path / "big.csv").write_text("0,1\n" + lines)
    (tmp_path / "small.csv").write_text("0,1\n" + lines[:5000])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 30000)
    spark.conf.set("spark.sql.files.openCostInBytes", 1000)
    try:
        raw = ll.read_grids(spark, str(tmp_path))
        assert raw.rdd.getNumPartitions() > 4
        big = raw.where("statement_id LIKE '%big.csv'").orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert [r["cells"][0] for r in big] == [f"row {i}" for i in range(40000)]
    assert len({r["row_no"] for r in big}) == 40000


def test_line_breaks_in_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('0,1\n"Tran\nDate",Amount\n')
    (row,) = ll.read_grids(spark, str(tmp_path), multiline=True).collect()
    assert row["cells"] == ["Tran\nDate", "Amount"]


def _written(rng, rows):
    """CSV text of rows, cells quoted where they need it and sometimes where they do not."""
    quoted = lambda c: '"' + c.replace('"', '""') + '"' if rng.random() < 0.2 or set(c) & set('",\n') else c
    return "0,1,2\n" + "".join(",".join(map(quoted, r)) + "\n" for r in rows)


def test_line_breaks_in_cells_across_splits(spark, tmp_path):
    """Quoted cells over any number of lines and splits, against the rows written."""
    rng, want = random.Random(5), {}
    for name, n, share in (("a", 400, 0.3), ("b", 900, 0.02), ("c", 500, 0.0), ("d", 3, 1.0), ("e", 0, 0.0)):
        cell = lambda: "".join(rng.choice(['x', 'y z', '"', ',', "\n", "\n\n", "é"]) for _ in range(rng.randint(1, 9)))  # noqa: E731,B023
        want[name] = [[f"r{i}", *(cell() if rng.random() < share else f"p{rng.randint(0, 99)}" for _ in range(2))] for i in range(n)]
    want["d"][1][2] = "long\n" * 3000 + "end"  # one cell over several splits
    for name, rows in want.items():
        (tmp_path / f"{name}.csv").write_text(_written(rng, rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", 2000)
    spark.conf.set("spark.sql.files.openCostInBytes", 100)
    try:
        got = ll.read_grids(spark, str(tmp_path), multiline=True).orderBy("row_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    for name, rows in want.items():
        found = [r["cells"] for r in got if r["statement_id"].endswith(f"/{name}.csv")]
        blank = [[c if c.strip() else None for c in r] for r in rows]
        assert [[c if c and c.strip() else None for c in r] for r in found] == blank, name


def test_ledger_round_trip(spark, golden, tmp_path):
    want = sorted(map(str, golden.collect()))
    for fmt in ("csv", "parquet"):
        ll.write_ledger(golden, str(tmp_path / fmt), fmt)
        back = ll.read_ledger(spark, str(tmp_path / fmt), fmt).select(*golden.columns)
        assert sorted(map(str, back.collect())) == want


def test_processed_file_as_table(spark, golden, tmp_path):
    """The written ledger read back by column names gives the second report's ledger."""
    out = golden.selectExpr(
        "txn_date AS date", "description", "debit", "credit", "balance", "txn_type AS type", "month AS month_year", "transaction_amount"
    )
    out.coalesce(1).write.option("header", True).csv(str(tmp_path / "t"))
    rows, tables = ll.read_tables(spark, str(tmp_path / "t"))
    got = ll.report_ledger_from_table(rows, tables)
    columns = ["txn_date", "month", "description", "amount", "debit", "credit_amount", "dr_cr_indicator", "balance"]
    want = ll.report_ledger(golden)
    assert sorted(map(str, got.select(*columns).collect())) == sorted(map(str, want.select(*columns).collect()))


def test_workbook_grid_and_text_sinks(spark, golden, golden_grid, tmp_path):
    flow = ll.flows(golden)
    ll.write_workbook(golden, ll.transaction_summary(flow), ll.monthly_summary(flow), str(tmp_path / "book"))
    counts = [spark.read.parquet(str(tmp_path / "book" / n)).count() for n in ("transactions", "summary", "monthly_summary")]
    assert counts == [9, 1, 3]
    ll.write_grid(golden_grid, str(tmp_path / "grid"))
    assert sorted(map(str, spark.read.parquet(str(tmp_path / "grid")).collect())) == sorted(map(str, golden_grid.collect()))
    lines = ll.report_lines(ll.comprehensive_report(ll.report_ledger(golden)))
    ll.write_report(lines, str(tmp_path / "text"))
    (part,) = (tmp_path / "text" / "statement_id=g1").glob("*.txt")
    text = part.read_text().splitlines()
    assert text[:5] == [
        "TRANSACTION SUMMARY", "Credit Transactions: 3", "Debit Transactions:  6", "Total Transactions:  9",
        "End of Day Balance: ₹127,350.00",
    ]
    assert "EMI & Loans              : ₹ 30,000.00 ( 91.9%)" in text
    assert "2024-01 | ₹50,000.00 | ₹10,500.00 | ₹39,500.00 | 79.0%" in text
    assert "₹10,000.00 | HOME LOAN EMI 001 | 3 times | High | ₹30,000.00" in text
    assert "Total Monthly EMI/Recurring: ₹10,000.00" in text
    assert text[-1] == "Avg Monthly Expenses:   ₹10,883.33"


def test_combined_insights(golden, golden_grid):
    (r,) = ll.comprehensive_insights(golden).collect()
    assert r["transaction_summary"]["total_transactions"] == 9
    assert r["financial_metrics"]["emi_to_income_ratio"] == pytest.approx(20)
    assert [m["month"] for m in r["monthly_analysis"]["monthly_surplus"]] == ["2024-01", "2024-02", "2024-03"]
    assert [c["category"] for c in r["spending_analysis"]["top_expenses"]][0] == "EMI & Loans"
    assert r["spending_analysis"]["large_transactions"]["count"] == 3
    assert r["emi_analysis"]["emis"][0]["first_date"] == date(2024, 1, 5)
    assert (float(r["emi_analysis"]["total_emi"]), r["emi_analysis"]["emi_count"]) == (10000, 1)
    assert r["alerts"]["unusual_transactions"] is None and r["alerts"]["unusual_count"] == 0
    done = ll.process(golden_grid, materialize=True)
    (a,) = ll.analyze(done).collect()
    assert a["account_summary"]["account_info"]["ifsc_code"] == "ABCD0123456"
    assert float(a["transaction_summary"]["closing_balance"]) == 4799.5
    assert a["data_quality"]["quality_score"] == 90.0
    (b,) = ll.analyze_report(done).collect()
    assert float(b["eod_balance"]) == 4799.5
    assert b["summary"]["overall_savings_rate"] == pytest.approx((5000 - 1200.5) / 5000 * 100)


def test_display_and_chart_tables(golden):
    (first, *_) = ll.display_ledger(golden).orderBy("row_no").collect()
    assert (first["credit"], first["debit"], first["amount"]) == ("₹50,000.00", "₹0.00", "")
    bars = ll.income_versus_expenses(ll.flows(golden)).orderBy("month", "series").collect()
    assert [(b["series"], float(b["amount"])) for b in bars[:2]] == [("expenses", 10500.0), ("income", 50000.0)]
    assert ll.monthly_table(ll.flows(golden)).columns == [
        "statement_id", "month", "income", "expenses", "net", "opening_balance", "closing_balance",
    ]
    assert ll.category_shares(ll.report_ledger(golden)).count() == 4


def test_one_statement_among_many(spark, golden):
    """A statement's figures do not depend on the others in the ledger."""
    other = make_ledger(spark, [(i, "2024-05-01", "LOAN", 777 + i, 0, 5) for i in range(300)], "other")
    both = golden.unionByName(other)
    for operator in (
        lambda l: ll.transaction_summary(ll.flows(l)),
        lambda l: ll.recurring_payments(l, 500, 2),
        ll.large_transactions,
        lambda l: ll.top_unusual(ll.unusual_transactions(l, 1)),
    ):
        assert sorted(map(str, operator(both).where("statement_id = 'g1'").collect())) == sorted(map(str, operator(golden).collect()))


def test_report_in_buckets(spark, golden, tmp_path):
    one = ll.report_lines(ll.comprehensive_report(ll.report_ledger(golden)))
    lines = one.unionByName(one.withColumn("statement_id", F.lit("g2")))
    ll.write_report(lines, str(tmp_path / "text"), buckets=3)
    files = list((tmp_path / "text").glob("bucket=*/*.txt"))
    assert 1 <= len(files) <= 2
    read = [line.split("\t", 1) for f in files for line in f.read_text().splitlines()]
    want = [r["text"] for r in one.orderBy("section", "line_no").collect()]
    for statement in ("g1", "g2"):
        assert [text for s, text in read if s == statement] == want
