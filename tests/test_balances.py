import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import balances

SCHEMA = "account_id long, row_no long, txn_id long, date date, desc string, type string, amount_c long, balance_c long"


def ledger(spark, rows):
    """rows: (type, amount_c, balance_c) of one account."""
    given = [(1, i + 1, i + 1, None, f"row {i}", *r) for i, r in enumerate(rows)]
    return spark.createDataFrame(given, SCHEMA).withColumn("date", F.expr("date_add(date'2024-04-01', cast(row_no as int))"))


def valid(rng, n, start):
    rows, balance = [], start
    for _ in range(n):
        kind, amount = rng.choice(["CR", "DR"]), rng.randint(500, 500_000)
        balance += amount if kind == "CR" else -amount
        rows.append((kind, amount, balance))
    return rows


GOLDEN = [("CR", 5000, 15000), ("DR", 2000, 13000), ("CR", 3000, 10000), ("DR", 1000, 9000), ("DR", 500, 6000), ("CR", 700, None), ("DR", 700, 6000)]


def test_golden_ledger(spark):
    rows = balances.validate(ledger(spark, GOLDEN), F.lit(10000)).orderBy("row_no").collect()
    assert [r.status for r in rows] == ["verified", "verified", "swapped", "verified", "amount_fixed", "verified", "verified"]
    assert (rows[2].new_type, rows[4].new_amount_c) == ("DR", 3000)
    filled = balances.fill_balances(ledger(spark, GOLDEN), F.lit(10000)).orderBy("row_no").collect()
    assert [r.filled_c for r in filled] == [15000, 13000, 10000, 9000, 6000, 6700, 6000]


@pytest.mark.parametrize("seed", range(3))
def test_valid_ledgers_have_no_findings(spark, seed):
    rows = ledger(spark, valid(random.Random(seed), 60, 1_000_000))
    assert {r.status for r in balances.validate(rows, F.lit(1_000_000)).collect()} == {"verified"}
    assert balances.verify(rows).first().continuity_errors == 0
    assert balances.audit_mismatches(rows).count() == 0
    assert balances.repair_types(rows).where("row_no > 1 and fixed_type != type").count() == 0


def test_one_flip_is_one_fix(spark):
    given = valid(random.Random(9), 40, 1_000_000)
    kind, amount, balance = given[20]
    given[20] = ("DR" if kind == "CR" else "CR", amount, balance)
    out = balances.validation_summary(balances.validate(ledger(spark, given), F.lit(1_000_000))).first()
    assert (out.auto_fixed, out.unverified, out.badge_color) == (1, 0, "green")


def test_order_of_partitions_does_not_matter(spark):
    rows = ledger(spark, valid(random.Random(4), 80, 1_000_000)).withColumn("balance_c", F.when(F.col("row_no") % 7 != 0, F.col("balance_c")))
    a = balances.fill_balances(rows, F.lit(0)).select("row_no", "filled_c").orderBy("row_no").collect()
    b = balances.fill_balances(rows.repartition(7).orderBy(F.rand(3)), F.lit(0)).select("row_no", "filled_c").orderBy("row_no").collect()
    assert a == b


def test_duplicates_and_narrations(spark):
    rows = ledger(spark, [("CR", 100, 100)]).select("*").unionByName(ledger(spark, [("CR", 100, 100)]).withColumn("row_no", F.lit(2).cast("long")))
    long = rows.withColumn("desc", F.lit("  paid   for goods  Statement Generated on page 2")).withColumn("date", F.lit("2024-04-01").cast("date"))
    got = balances.deduplicate(long).collect()
    assert [(r.row_no, r.desc) for r in got] == [(1, "paid for goods")]
