"""Tables of tax forms, breakdowns that add up, observed checks, differences of readings, and whole editions of reports."""

import json
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.operators import engine, reports, sinks, versions
from ledgerloom.sources import tax_forms

LEDGER = "account_id long, row_no long, day string, desc string, type string, amount_c long, balance_c long"


def ledger(spark, rows):
    return classify.enriched(spark.createDataFrame(rows, LEDGER).withColumn("date", F.to_date("day")).drop("day"))


def test_a_heading_ends_the_deductor(spark):
    rows = [
        (1, 0, 0, ["Name of Deductor", "TAN"]), (1, 0, 1, ["Acme", "ABCD12345E", "10.00"]), (1, 1, 0, ["Name of Deductor", None]), (1, 1, 1, ["x", "7.00"]), (1, 1, 2, ["Beta contract", "BETA12345E", "1.00"]),
        (1, 1, 3, ["", "2.00", "2.00"]), (2, 0, 0, ["1", "3.00"]), (3, 0, 0, [None, None]), (3, 0, 1, []),
    ]
    got = tax_forms.credit_table_entries(spark.createDataFrame(rows, "doc_id long, table_no int, row_no int, cells array<string>")).orderBy("table_no", "row_no").collect()
    assert [(r.doc_id, r.table_no, r.row_no, r.kind, r.tan, r.section, r.paid_c, r.deducted_c) for r in got] == [
        (1, 0, 1, "total", "ABCD12345E", "other", 1000, 0), (1, 1, 2, "total", "BETA12345E", "194C", 100, 0), (1, 1, 3, "payment", "BETA12345E", "194C", 200, 200)
    ]


def test_breakdowns_add_up(spark):
    rng, rows = random.Random(2), []
    for account in range(30):
        for k, desc in enumerate(rng.choices(["Salary april", "Dividend credit infy", "Savings interest credit", "Rent received flat 7", "Client payment for project", "tea"], k=rng.randint(0, 6))):
            rows.append((account, k + 1, "2024-01-01", desc, "CR", rng.randint(1, 99_999), None))
    frame = ledger(spark, rows)
    parts = {}
    for r in reports.income_breakdown(frame).collect():
        assert r.amount >= 0 and r.share_bp >= 0
        parts.setdefault(r.account_id, []).append((r.amount, r.share_bp))
    whole = {r.account_id: r.c for r in frame.where(F.col("credit_class").isin("salary", "business", "interest", "dividend", "rental")).groupBy("account_id").agg(F.sum("amount_c").alias("c")).collect()}
    assert set(parts) == set(whole)
    for account, c in whole.items():
        assert sum(a for a, _ in parts[account]) == (c + 50) // 100 and sum(s for _, s in parts[account]) == 10_000
    assert reports.income_breakdown(ledger(spark, [])).collect() == []


def test_checks_are_counted_while_they_are_written(spark, tmp_path):
    rows = [(a, k, f"2024-01-{k:02d}", "tea", "DR", 100, None if a == 1 and k == 2 else 500) for a in (1, 2, 3) for k in range(1, 3 + (a > 1))]
    checked, seen = reports.observed(reports.consistency(engine.engine(ledger(spark, rows))))
    checked.write.parquet(str(tmp_path / "out"))
    written = spark.read.parquet(str(tmp_path / "out")).collect()
    assert {r.account_id: r.warnings for r in written} == {1: ["few rows", "balances"], 2: [], 3: []}
    assert seen.get == {"accounts": 3, "failed": 0, "warned": 1}


def test_differences_are_those_of_bags(spark):
    rng = random.Random(4)
    side = lambda: spark.createDataFrame([(rng.randint(1, 3), rng.choice(["a", "b", None]), rng.choice([1, None])) for _ in range(60)], "k long, a string, b long")
    old, new = side(), side()
    found = versions.differences(old, new, ["k", "a", "b"])
    bag = lambda f: sorted((r.k, r.a or "", r.b or 0) for r in f.collect())
    times = lambda c: sorted((r.k, r.a or "", r.b or 0) for r in found.collect() for _ in range(r[c]))
    assert times("added") == bag(new.exceptAll(old)) and times("removed") == bag(old.exceptAll(new)) and times("unchanged") == bag(old.intersectAll(new))
    assert versions.differences(old.limit(0), new.limit(0), ["k"]).collect() == []


def test_no_reader_sees_half_an_edition(spark, tmp_path):
    folder = str(tmp_path / "book")
    good = {"one": spark.range(3).toDF("n"), "two": spark.createDataFrame([("x",)], "a string")}
    with pytest.raises(FileNotFoundError):
        sinks.read_book(spark, folder)
    first = sinks.write_book(good, folder)
    broken = {"one": spark.range(9).toDF("n"), "two": spark.range(1).select(F.raise_error(F.lit("killed")).cast("string").alias("a"))}
    with pytest.raises(Exception, match="killed"):
        sinks.write_book(broken, folder, edition="half")
    assert sinks.editions(spark, folder) == [first]
    book = sinks.read_book(spark, folder)
    assert set(book) == {"one", "two"} and book["one"].count() == 3
    with pytest.raises(FileNotFoundError):
        sinks.read_book(spark, folder, "half")
    sinks.write_book({"one": spark.range(5).toDF("n")}, folder, edition="next")
    assert sinks.read_book(spark, folder)["one"].count() == 5 and sinks.read_book(spark, folder, first)["one"].count() == 3
    with pytest.raises(Exception):
        sinks.write_book({"one": spark.range(5).toDF("n")}, folder, edition="next")


def test_one_document_an_upload(spark):
    rows = spark.createDataFrame([(1, 2, "2024-01-02", "tea", "DR", 150, 850), (1, 1, "2024-01-01", "gift", "CR", 1000, None)], "up long, row_no long, day string, desc string, type string, amount_c long, balance_c long").withColumn("date", F.to_date("day"))
    names = spark.createDataFrame([(1, "a.pdf"), (2, None)], "up long, filename string")
    got = {r.up: json.loads(r.document) for r in sinks.upload_documents(rows, "up", names, parse_ms=250).collect()}
    assert got[1] == {"transactions": [{"date": "2024-01-01", "desc": "gift", "type": "CR", "amount": 10.0}, {"date": "2024-01-02", "desc": "tea", "type": "DR", "amount": 1.5, "balance": 8.5}], "count": 2, "parse_time": 0.25, "filename": "a.pdf"}
    assert got[2] == {"transactions": [], "count": 0, "parse_time": 0.25}
