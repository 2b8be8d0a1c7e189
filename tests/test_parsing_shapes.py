"""Texts at the edge of the shapes that are told apart before a date or an amount is parsed."""

from pyspark.sql import functions as F

from ledgerloom.functions.parsing import parse_amount_c, parse_date


def test_dates_of_usual_and_other_shapes(spark):
    want = {
        "05/04/2024": "2024-04-05", "5-4-2024": "2024-04-05", "04/25/2024": "2024-04-25", "04-25-2024": None, "05/04-2024": None, "05.04.36": None, "5 APR 2024": "2024-04-05", "31 Feb 2024": None,
        "on 05Apr24 at": "2024-04-05", "5 April 24": "2024-04-05", "2024-04-05\n": "2024-04-05", "05/04/1999": None, "12.50": None, "": None, None: None,
    }
    got = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "k int, t string").select("k", parse_date(F.col("t")).cast("string").alias("d"))
    assert {r.k: r.d for r in got.collect()} == dict(enumerate(want.values()))


def test_amounts_of_usual_and_other_shapes(spark):
    want = {"12.50": 1250, "1,234": 123_400, "Rs. 5 Cr.": 500, "(7.1)": 710, "1E2": 10_000, ".5": 50, "-3": 300, "١٢": 1200, "12 shops": 0, "1-2": 0, "1.2.3": 0, "": 0, None: 0}
    got = spark.createDataFrame([(k, t) for k, t in enumerate(want)], "k int, t string").select("k", parse_amount_c(F.col("t")).alias("c"))
    assert {r.k: r.c for r in got.collect()} == dict(enumerate(want.values()))
