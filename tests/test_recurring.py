"""Recurring payments against a direct walk over the rows."""

import random
from datetime import date, timedelta

import pytest
from conftest import make_ledger, money

import ledgerloom as ll
from ledgerloom.operators import recurring as rec
from ledgerloom.rules import LOAN_WORDS, REPORT_LOAN_WORDS
from ledgerloom.schemas import MONEY


def cadence(dates):
    days = sorted(d for d in dates if d)
    if len(days) < 2:
        return False
    gaps = [(b - a).days for a, b in zip(days, days[1:])]
    return 25 <= sum(gaps) / len(gaps) <= 35


def walk(rows, min_amount, least, tolerance):
    """(row_no, members, monthly, likely) of the accepted seeds of one statement, in row order."""
    found, taken = [], []
    candidates = [r for r in rows if r[3] >= min_amount and r[3] > 0]
    for row_no, day, text, amount in candidates:
        if any(abs(amount - p) / p <= tolerance for p in taken):
            continue
        similar = [c for c in candidates if abs(c[3] - amount) / amount <= tolerance]
        if len(similar) < least:
            continue
        likely = any(w in text.lower() for w in LOAN_WORDS)
        monthly = cadence([c[1] for c in similar])
        if likely or monthly:
            found.append((row_no, len(similar), monthly, likely))
            taken.append(amount)
    return sorted(found)


def report_walk(rows):
    found, taken = [], []
    dated = sorted((r for r in rows if r[1] and r[3] > 0), key=lambda r: (r[1], r[0]))
    for row_no, day, text, amount in dated:
        if any(abs(amount - p) / max(p, 1) <= 0.05 for p in taken):
            continue
        similar = [c for c in dated if abs(c[3] - amount) / amount <= 0.05]
        if len(similar) < 2:
            continue
        likely = any(w in text.lower() for w in REPORT_LOAN_WORDS)
        regular = len(similar) >= 3 and cadence([c[1] for c in similar])
        if amount >= 1000 and (likely or regular or len(similar) >= 3):
            found.append((row_no, len(similar), regular, likely))
            taken.append(amount)
    return sorted(found)


def random_rows(rng, n):
    base = [rng.choice([1000, 1100, 1210, 900, 2000, 952.38, 950, 1049.99, 1050, 5000.5]) for _ in range(4)]
    rows = []
    for i in range(n):
        amount = rng.choice(base) if rng.random() < 0.5 else round(rng.uniform(700, 6000), 2)
        if rng.random() < 0.2:  # exactly at the tolerance
            amount = round(rng.choice(base) * rng.choice([0.9, 1.1, 0.95, 1.05]), 2)
        day = None if rng.random() < 0.1 else date(2024, 1, 1) + timedelta(days=rng.randint(0, 200))
        rows.append((i * 3 + 1, day, rng.choice(["SHOP", "Home LOAN", "rent", "EMI 5"]), amount))
    return rows


@pytest.fixture(scope="module")
def statements():
    rng = random.Random(7)
    return {f"s{i}": random_rows(rng, rng.choice([0, 1, 4, 15, 60])) for i in range(80)}


@pytest.fixture(scope="module")
def ledger(spark, statements):
    data = [(k, n, d, t, money(a), money(0)) for k, rows in statements.items() for n, d, t, a in rows]
    schema = f"statement_id string, row_no bigint, txn_date date, description string, debit {MONEY}, credit {MONEY}"
    return ll.finish_ledger(spark.createDataFrame(data, schema)).cache()


@pytest.mark.parametrize("fold_limit", [rec.FOLD_LIMIT, 0, 9])
@pytest.mark.parametrize("tolerance, least, min_amount", [(0.1, 3, 1000), (0.05, 2, 800)])
def test_first_report(ledger, statements, fold_limit, tolerance, least, min_amount):
    found = ll.recurring_payments(ledger, min_amount, least, tolerance, fold_limit)
    got = {}
    for r in found.collect():
        got.setdefault(r["statement_id"], []).append(
            (r["row_no"], r["occurrences"], r["frequency"] == "monthly", r["confidence"] == "high")
        )
    for k, rows in statements.items():
        want = [(n, members, monthly, monthly and likely) for n, members, monthly, likely in walk(rows, min_amount, least, tolerance)]
        assert sorted(got.get(k, [])) == want, k


@pytest.mark.parametrize("fold_limit", [rec.FOLD_LIMIT, 0])
def test_second_report(ledger, statements, fold_limit):
    found = ll.report_recurring_payments(ll.report_ledger(ledger), fold_limit)
    got = {}
    for r in found.collect():
        got.setdefault(r["statement_id"], []).append(
            (r["row_no"], r["frequency"], r["regular_pattern"], r["likely_emi"])
        )
        assert float(r["total_paid"]) == pytest.approx(float(r["amount"]) * r["frequency"])
    for k, rows in statements.items():
        assert sorted(got.get(k, [])) == report_walk(rows), k


def accepted_by_hand(values, tolerance):
    """The walk over amounts in cents, in the given order."""
    taken = []
    for v in values:
        if not any(abs(v / 100.0 - p / 100.0) / (p / 100.0) <= tolerance for p in taken):
            taken.append(v)
    return sorted(taken)


def seeds_of(spark, statements):
    rows = [(k, i, v, True, True, 3, date(2024, 1, 1), date(2024, 1, 1)) for k, values in statements.items() for i, v in enumerate(values)]
    kinds = "statement_id string, seq bigint, value bigint, regular boolean, likely boolean, members bigint, first_date date, last_date date"
    return spark.createDataFrame(rows, kinds)


def orders_of(rng, n):
    """Distinct amounts in orders that make long chains, short ones and meeting ones."""
    low = rng.choice([1, 40, 900, 100_000])
    values = sorted({int(low * (1 + rng.choice([0.0004, 0.003, 0.02])) ** i) + i for i in range(n)})
    half = len(values) // 2
    zigzag = [v for pair in zip(values[:half], values[::-1]) for v in pair]
    shuffled = rng.sample(values, len(values))
    blocks = [v for a in range(0, len(values), 17) for v in values[a : a + 17][::-1]]
    return [values, values[::-1], list(dict.fromkeys(zigzag)), shuffled, blocks, values[half:] + values[:half][::-1], values[half::-1] + values[half + 1 :]]


@pytest.mark.parametrize("tolerance", [0.1, 0.05, 0.45, 0.9])
def test_walk_in_rounds_equals_the_walk(spark, tolerance):
    rng = random.Random(int(tolerance * 100))
    statements = {f"s{k}-{j}": values for k in range(8) for j, values in enumerate(orders_of(rng, rng.choice([3, 30, 150])))}
    seeds, found = seeds_of(spark, statements), {}
    for r in rec.walk_seeds(seeds, rec.Walk(tolerance), fold_limit=0).collect():
        found.setdefault(r.statement_id, []).append(r.value)
    for k, values in statements.items():
        assert sorted(found[k]) == accepted_by_hand(values, tolerance), k


def test_long_chains_take_few_rounds(spark, monkeypatch):
    """20,000 amounts, each blocked or freed by those next to it: rising, falling, and meeting in the middle."""
    n = 20_000
    rising = [100_000 + 700 * i for i in range(n)]
    chains = {"rising": rising, "falling": rising[::-1], "meeting": [v for pair in zip(rising[: n // 2], rising[: n // 2 - 1 : -1]) for v in pair]}
    rounds, double = [], rec._double
    monkeypatch.setattr(rec, "_double", lambda *x: rounds.append(1) or double(*x))
    for name, values in chains.items():
        rounds.clear()
        got = rec.walk_seeds(seeds_of(spark, {name: values}), rec.Walk(0.01), fold_limit=1000)
        assert sorted(r.value for r in got.select("value").collect()) == accepted_by_hand(values, 0.01)
        assert 0 < len(rounds) <= 2 * n.bit_length()


def test_input_order_does_not_matter(ledger):
    shuffled = ledger.repartition(7, "description").orderBy("debit")
    for operator in (ll.recurring_payments, lambda l: ll.report_recurring_payments(ll.report_ledger(l))):
        assert sorted(map(str, operator(ledger).collect())) == sorted(map(str, operator(shuffled).collect()))


def test_tolerance_is_checked(ledger):
    with pytest.raises(ValueError):
        ll.recurring_payments(ledger, amount_tolerance=1.0)


def test_gaps_with_time_of_day(spark):
    rows = [
        ("s", "2024-01-01 10:00:00", 5),
        ("s", "2024-01-31 09:59:59", 5),  # 29 full days
        ("s", "2024-03-02 12:00:00", 5),  # 31 full days
        ("s", "2024-03-02 13:00:00", 5),  # same day
        ("s", "2024-03-02 13:00:00", 9),
    ]
    df = spark.createDataFrame(rows, "statement_id string, t string, debit int").selectExpr(
        "statement_id", "CAST(t AS timestamp_ntz) AS ts", "CAST(debit AS decimal(18,2)) AS debit"
    )
    got = {int(r["amount"]): (r["payments"], r["mean_gap"], r["is_monthly"]) for r in ll.payment_gaps(df, "ts").collect()}
    assert got == {5: (4, 20.0, False), 9: (1, None, False)}
