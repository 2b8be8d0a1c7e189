import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify, parsing


@pytest.mark.parametrize(
    "desc,want",
    [
        ("NACH/abc", False), ("nach/ 1", True), ("EMI payment", True), ("premium", False), ("lazypay", True), ("snapmint emi", True),
    ],
)
def test_short_words_stand_alone(spark, desc, want):
    from ledgerloom.functions import rules

    df = spark.createDataFrame([(desc,)], "d string").select(rules.mentions(F.lower("d"), rules.EMI).alias("m"))
    assert df.first().m is want


CREDITS = {
    "salary for april": "salary", "Pocketly": "loan_disbursal", "self transfer": "self_transfer", "paid by family member one": "family_transfer", "refund of salary": "refund",
    "reimb travel": "reimbursement", "wallet load": "non_income", "Cash Dep atm": "cash_deposit", "consulting fee": "business", "dividend": "dividend", "int pd": "interest",
    "house rent": "rental", "hello": "needs_verification", "": "needs_verification",
}


def test_credit_classes(spark):
    df = spark.createDataFrame([(k,) for k in CREDITS], "d string")
    assert {r.d: r.c for r in df.withColumn("c", classify.credit_class(F.lower("d"))).collect()} == CREDITS


def test_cash_deposits_are_credits_whatever_their_direction(spark):
    rows = [(1, i, i, None, "cash deposit at/br", kind, 100, 0) for i, kind in enumerate(["CR", "DR", ""])] + [(1, 9, 9, None, "cash deposit", "DR", 0, 0)]
    df = spark.createDataFrame(rows, "account_id long, row_no long, txn_id long, date date, desc string, type string, amount_c long, balance_c long")
    got = classify.enriched(df).orderBy("row_no").collect()
    assert [(r.flow, r.credit_class) for r in got] == [("CR", "cash_deposit")] * 3 + [(None, None)]


DATES = {
    "5 Apr 2024": "2024-04-05", "05 April 2024": "2024-04-05", "05 APR 24": "2024-04-05", "05Apr2024": "2024-04-05", "05Apr24": "2024-04-05", "05/04/2024": "2024-04-05",
    "05-04-2024": "2024-04-05", "05.04.2024": "2024-04-05", "04/25/2024": "2024-04-25", "05/04/24": "2024-04-05", "2024-04-05": "2024-04-05", "2024/4/5": "2024-04-05",
    "31/02/2024": None, "05/04/1999": None, "": None, "soon": None,
}


def test_dates(spark):
    df = spark.createDataFrame([(k,) for k in DATES], "d string").withColumn("p", parsing.parse_date(F.col("d")).cast("string"))
    assert {r.d: r.p for r in df.collect()} == DATES


AMOUNTS = {"1,23,456.78": 12345678, "(500.00)": 50000, "-42.10": 4210, "₹ 10.00": 1000, "570.53 Cr.": 57053, "Rs. 7": 700, "abc": 0, "": 0}


def test_amounts(spark):
    df = spark.createDataFrame([(k,) for k in AMOUNTS], "d string").withColumn("p", parsing.parse_amount_c(F.col("d")))
    assert {r.d: r.p for r in df.collect()} == AMOUNTS


def test_formula_guard(spark):
    cells = ["=1+1", "+x", "-x", "@x", "\tx", "x=1", ""]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(parsing.guarded(F.col("c")).alias("g"))
    assert [r.g for r in df.collect()] == ["'=1+1", "'+x", "'-x", "'@x", "'\tx", "x=1", ""]


SENDERS = {
    "NEFT/Globex India/77": "globex india", "NEFT-ACME CORP  more": "acme corp", "NEFTINW-0099-JANE DOE": "jane doe", "IMPS-77-JOHN-ICIC0001234": "john", "IMPS-77-JOHN": "",
    "RTGS/9912/STEEL WORKS/x": "steel works", "payroll: acme one two three four": "acme one two three", "POS/4512/big bazaar": "", "UPI/a@b.c/lunch": "", "MB:Received from X": "", "": "", None: "",
}


def test_senders(spark):
    df = spark.createDataFrame([(k,) for k in SENDERS], "d string").withColumn("e", classify.employer(F.coalesce("d", F.lit(""))))
    assert {r.d: r.e for r in df.collect()} == SENDERS


def test_many_narrations_are_classified_where_they_stand(spark, monkeypatch):
    rows = [(1, i, i, None, d, "CR", 100, 0) for i, d in enumerate([*CREDITS, None, "Salary", "Salary"])]
    df = spark.createDataFrame(rows, "account_id long, row_no long, txn_id long, date date, desc string, type string, amount_c long, balance_c long")
    once = sorted(map(str, classify.enriched(df).collect()))
    monkeypatch.setattr(classify, "MOST_BROADCAST", 0)
    plain = classify.enriched(df)
    assert sorted(map(str, plain.select(*classify.enriched(df).columns).collect())) == once and len(once) == len(rows)
    assert "Join" not in plain._jdf.queryExecution().executedPlan().toString()
