"""Accounts and documents of a single row, which smaller tables lack."""

from datetime import datetime

import duckdb

from ledgerloom.plans import catalog, oracle
from ledgerloom.sources import strategies


def against_sql(spark, folder, name, orders):
    """Rows that only the query has, and rows that only its SQL has, over these orders."""
    frame = spark.createDataFrame(orders, "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp, o_orderpriority string")
    frame.coalesce(1).write.parquet(f"{folder}/orders.parquet")
    got = catalog.queries()[name](spark, str(folder))
    db = duckdb.connect()
    db.execute(f"create view orders as select * from '{folder}/orders.parquet/*.parquet'")
    want = db.execute(oracle.oracle_sql()[name])
    at = [[c[0] for c in want.description].index(c) for c in got.columns]
    a, b = sorted(tuple(r) for r in got.collect()), sorted(tuple(r[k] for k in at) for r in want.fetchall())
    return [r for r in a if r not in b], [r for r in b if r not in a], a


def test_accounts_without_a_known_balance_have_no_warnings(spark, tmp_path):
    rows = [(23, 1, "O", 10.0, datetime(1997, 3, 4), "x"), (24, 2, "O", 20.0, datetime(1997, 3, 4), "x")]
    more, less, got = against_sql(spark, tmp_path, "consistency_warnings", rows)
    assert (more, less) == ([], []) and [r[0] for r in got] == [2]


def test_of_single_rows_the_one_with_a_balance_is_kept(spark):
    line = "Aligned Bank account\nTxn Date   Narration   Debit   Credit   Balance\n05/04/2024   groceries   10.00   -   90.00"
    pages = spark.createDataFrame([(1, 1, line)], "doc_id long, page_no int, text string")
    cells = spark.createDataFrame([(1, 1, ["Date", "Narration", "Withdrawals", "Deposits", "Balance"]), (1, 2, ["05/04/2024", "groceries", "10.00", "-", ""])], "doc_id long, row_no long, cells array<string>")
    found, won = strategies.read(pages, cells)
    assert [(r.way, r.balance_c) for r in found.collect()] == [("relaxed", 9_000)]
    assert [r.way for r in strategies.learned(won, strategies.fingerprints(pages)).collect()] == ["relaxed"]
