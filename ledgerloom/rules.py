"""Keyword rule sets: ordered, the first category with a matching keyword wins."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class RuleSet:
    name: str
    categories: tuple[tuple[str, tuple[str, ...]], ...]
    default: str

    def names(self) -> list[str]:
        return [category for category, _ in self.categories] + [self.default]

    def to_frame(self, spark: SparkSession) -> DataFrame:
        """The rule table ``(rule_set, priority, category, keywords)``."""
        rows = [
            (self.name, i, category, list(words))
            for i, (category, words) in enumerate(self.categories)
        ]
        return spark.createDataFrame(
            rows, "rule_set string, priority int, category string, keywords array<string>"
        )


MAX_RULES = 10_000


def rules_from_frame(frame: DataFrame, default: str, name: str = "custom") -> RuleSet:
    """Compile a rule table ``(priority, category, keywords)`` into a rule set.

    Rules are written by hand and become one CASE expression, so the table must
    stay small; a larger one is refused rather than cut.
    """
    rows = frame.select("priority", "category", "keywords").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"a rule table holds at most {MAX_RULES} categories")
    ordered = sorted(rows, key=lambda r: r["priority"])
    return RuleSet(name, tuple((r["category"], tuple(r["keywords"])) for r in ordered), default)


def parse_rules(name: str, text: str, default: str) -> RuleSet:
    """One category per line: ``Category: keyword, keyword, ...``."""
    categories = []
    for line in text.strip().splitlines():
        category, words = line.split(":", 1)
        categories.append((category.strip(), tuple(w.strip() for w in words.split(","))))
    return RuleSet(name, tuple(categories), default)


# Categories and keywords, in matching order.
EXPENSE_RULES = parse_rules("expense", """
Food & Dining: restaurant, cafe, food, dining, zomato, swiggy, eatsure, mcdonalds, dominos, pizza, kfc, subway, starbucks, hotel, dhaba, canteen, mess
Shopping: amazon, flipkart, myntra, ajio, shopping, store, retail, mall, market, bazaar, nykaa, limeroad, snapdeal, clothing, apparel, fashion
Transportation: uber, ola, rapido, auto, taxi, cab, petrol, fuel, diesel, gas station, hp, bharat petroleum, metro, railway, train, bus, flight, airlines, parking, toll, transport
Bills & Utilities: electricity, water, gas, bill, utility, mobile, recharge, phone, broadband, internet, wifi, dth, cable, tv, airtel, jio, bsnl, vodafone, electricity board, mseb, bescom
Entertainment: netflix, prime, hotstar, spotify, youtube, disney, cinema, movie, theatre, multiplex, pvr, inox, gaming, games, entertainment, amusement, club
EMI & Loans: emi, loan, repayment, installment, equated monthly, home loan, car loan, personal loan, education loan, credit card, hdfc, icici, sbi, axis, kotak
Groceries: grocery, supermarket, dmart, bigbasket, grofers, fresh, vegetables, fruits, milk, bread, rice, dal, reliance fresh, more, spencer, foodworld, market
Travel: flight, hotel, booking, makemytrip, goibibo, yatra, cleartrip, expedia, oyo, airbnb, resort, travel, tour, trip, vacation, holiday
Health: hospital, clinic, pharmacy, medical, medicine, drug, doctor, lab, diagnostic, pathology, apollo, fortis, health, dental, eye care, checkup, consultation
Education: school, college, university, course, education, tuition, fees, admission, exam, coaching, training, institute, academy, learning, study, books, stationery
Investments: mutual fund, mf, sip, stocks, shares, equity, investment, gold, silver, bond, fd, fixed deposit, recurring deposit, rd, ppf, nsc, elss
Cash Withdrawal: atm, cash, withdrawal, cwdr, cash out
Transfers: transfer, neft, rtgs, imps, upi, paytm, phonepe, gpay, amazon pay, mobikwik, freecharge
""", "Uncategorized")

# The shorter rule set of the second report.
REPORT_EXPENSE_RULES = parse_rules("report_expense", """
EMI & Loans: emi, loan, installment, equated, repayment
Bills & Utilities: electricity, water, gas, bill, utility, pvvnlpostp, indraprast, airtel, mobile, recharge
Bank Charges: charge, gst, consolidated, fee
Business Payments: neft, rtgs, imps, transfer, garment, chemical, dyes, trading, industries, cetp, upsidc
Cash Withdrawal: cash, atm, cwdr
Online Payments: payu, paytm, upi, nbsm, techprocess
Cheque Payments: clg, cheque, dd issued, con
""", "Others")

# Income sources.
INCOME_RULES = parse_rules("income", """
Salary: salary, sal, payroll, wages, stipend
Business Income: business, revenue, sales, invoice, payment
Interest: interest, int, fd interest, sb interest
Dividends: dividend, div
Refunds: refund, cashback, reversal
Transfers: transfer, neft, rtgs, imps, upi
""", "Other Income")

# Words that mark a repayment.
LOAN_WORDS = ("emi", "loan", "installment", "repayment", "equated")
REPORT_LOAN_WORDS = ("emi", "loan", "installment", "equated")
