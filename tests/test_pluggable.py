"""Banks of the user's own, statements through the data source, ways of reading, rows lost to page ends."""

import os
import time

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import bundles, statements, strategies, tables
from ledgerloom.sources.statements import BANKS, Bank, Layout

PAGES = "doc_id long, page_no int, text string"


def piped():
    """Lines `yyyy-mm-dd | words | amount C or D | balance`."""
    parts = F.transform(F.split("line", r"\|"), lambda x: F.trim(x))
    moved = F.split(F.get(parts, F.lit(2)), " ")
    said = F.when(F.get(moved, F.lit(1)) == "C", "CR").otherwise("DR")
    return Layout((F.size(parts) == 4) & F.get(parts, F.lit(0)).rlike(r"^\d{4}-\d{2}-\d{2}$"), F.lit(False), F.get(parts, F.lit(1)), F.get(moved, F.lit(0)), F.get(parts, F.lit(3)), date=F.get(parts, F.lit(0)), said=said)


MERIDIAN = Bank(lambda t: t.contains("meridian bank"), piped, like="axis")
TEXT = "Meridian Bank\n2024-04-01 | Opening gift | 100.00 C | 100.00\n2024-04-02 | Tea | 30.50 D | 69.50\nwith milk\n2024-04-03 | Salary | 1,000.00 C | 1,069.50"
WANT = [("2024-04-01", "Opening gift", "CR", 10_000, 10_000), ("2024-04-02", "Tea", "DR", 3_050, 6_950), ("2024-04-03", "Salary", "CR", 100_000, 106_950)]


def rows_of(found):
    return [(str(r.date), r.desc, r.type, r.amount_c, r.balance_c) for r in found.orderBy("doc_id", "row_no").collect()]


def test_a_ninth_bank_without_touching_the_library(spark):
    pages = spark.createDataFrame([(1, 1, TEXT), (2, 1, "IFSC UTIB0000001\nTran Date Value Date Transaction Particulars Amount DR/CR\n01-04-2024 01-04-2024 tea 5 DR 95 BR1")], PAGES)
    banks = BANKS.with_bank("meridian", MERIDIAN, before="icici")
    found = statements.transactions(pages, banks)
    assert rows_of(found.where("doc_id = 1")) == WANT
    assert rows_of(found.where("doc_id = 2")) == [("2024-04-01", "tea", "DR", 500, 9_500)]
    assert {r.bank for r in found.collect()} == {"meridian", "axis"}
    assert "meridian" not in BANKS.known
    assert {r.bank for r in statements.transactions(pages).collect()} == {"axis", "generic"}


def test_names_are_used_once_and_rules_must_exist():
    with pytest.raises(ValueError):
        BANKS.with_bank("hdfc", MERIDIAN)
    with pytest.raises(ValueError):
        BANKS.with_bank("other", Bank(lambda t: F.lit(True), piped, like="nobody"))


def test_order_of_fingerprints_decides(spark):
    anything = Bank(lambda t: F.lit(True))
    page = spark.range(1).select(F.lit("IFSC UTIB0000001\nTransaction Particulars DR/CR").alias("t"))
    name = lambda banks: page.select(banks.name_of(F.col("t"))).first()[0]
    assert name(BANKS.with_bank("any", anything)) == "axis"
    assert name(BANKS.with_bank("any", anything, before="icici")) == "any"


def test_bundles_round_trip(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(bundles, "BLOCK_BYTES", 7)
    rows = [(1, 1, "a\nb"), (1, 2, ""), (2, 1, "é日本"), (3, 1, None), (4, 1, "x" * 5000), (4, 2, "last")]
    pages = spark.createDataFrame(rows, PAGES)
    bundles.write_bundles(pages, str(tmp_path / "b"), bundles=2)
    bundles.register(spark)
    back = spark.read.format(bundles.FORMAT).load(str(tmp_path / "b"))
    assert sorted((int(r.doc_id), r.page_no, r.text) for r in back.collect()) == sorted((i, p, t or "") for i, p, t in rows)
    assert back.select("bundle").distinct().count() == 2
    os.mkdir(tmp_path / "none")
    assert spark.read.format(bundles.FORMAT).load(str(tmp_path / "none")).collect() == []
    (tmp_path / "plain.txt").write_text("no title\x1e")
    assert [(r.doc_id, r.text) for r in spark.read.format(bundles.FORMAT).load(str(tmp_path / "plain.txt")).collect()] == [(None, "no title")]


def test_bundles_as_a_stream(spark, tmp_path):
    bundles.register(spark)
    folder = tmp_path / "in"
    folder.mkdir()
    (folder / "b.txt").write_text(f"Document: 1\n{TEXT}\x1e")

    def run():
        stream = spark.readStream.format(bundles.FORMAT).load(str(folder))
        stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "progress")).trigger(once=True).start().awaitTermination(120)
        return sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect())

    assert run() == ["1"]
    time.sleep(0.01)
    (folder / "a.txt").write_text("Document: 2\nlater, by an earlier name\x1e")
    assert run() == ["1", "2"]
    assert run() == ["1", "2"]


def test_ways_are_chosen_by_balances_and_remembered(spark):
    aligned = "Aligned\nDate   Narration   Debit   Credit   Balance\n" + "\n".join(f"0{k}/04/2024   item {k}   -   10.00   {k * 10}.00" for k in range(1, 5))
    pages = spark.createDataFrame([(1, 1, aligned), (2, 1, "Nothing here"), (3, 1, "Ruled")], PAGES)
    head = ["Date", "Narration", "Debit", "Credit", "Balance"]
    table = [(3, 1, head)] + [(3, 1 + k, [f"0{k}/05/2024", f"thing {k}", "", "5.00", f"{k * 5}.00"]) for k in range(1, 4)]
    wrong = [(1, 1, head)] + [(1, 1 + k, [f"0{k}/04/2024", f"item {k}", "", "10.00", "7.00"]) for k in range(1, 5)]
    cells = spark.createDataFrame(table + wrong, "doc_id long, row_no long, cells array<string>")
    found, won = strategies.read(pages, cells)
    assert {r.doc_id: (r.way, r.rows, r.follow) for r in won.collect()} == {1: ("relaxed", 4, 3), 3: ("table", 3, 2)}
    assert sorted((r.doc_id, r.amount_c) for r in found.collect()) == [(1, 1000)] * 4 + [(3, 500)] * 3
    known = strategies.learned(won, strategies.fingerprints(pages))
    assert {r.way for r in known.collect()} == {"relaxed", "table"}
    told = known.withColumn("way", F.lit("table"))
    again, _ = strategies.read(pages, cells, known=told)
    assert {(r.doc_id, r.way) for r in again.collect()} == {(1, "table"), (3, "table")}


def test_rows_lost_to_page_ends(spark):
    head = ["Sr No", "Txn Date", "Narration", "Chq No", "Withdrawal (Dr.)", "Deposit (Cr.)", "Balance"]
    cells = [(1, 1, head), (1, 2, ["1", "1 Apr 2024", "open", "", "", "100.00", "100.00"]), (1, 3, ["", "", "more words", "", "", "", ""]), (1, 4, ["4", "4 Apr 2024", "tea", "", "5.00", "", "85.00"])]
    lines = ["Statement", "1 1 Apr 2024 open", "100.00 100.00", "2 2 Apr 2024 cake for 20.00 80.00", "Page 1 of 2", "3 3 Apr 2024 from", "a friend 10.00", "90.00", "4 4 Apr 2024 tea 5.00 85.00", "5 5 Apr 2024 no amounts"]
    table = spark.createDataFrame(cells, "doc_id long, row_no long, cells array<string>")
    text = spark.createDataFrame([(1, k, x) for k, x in enumerate(lines)], "doc_id long, line_no long, line string")
    assert [r.serial for r in tables.missing_serials(table).orderBy("serial").collect()] == [2, 3]
    whole = tables.with_footer_rows(table, text)
    assert tables.missing_serials(whole).collect() == []
    assert [r.cells[0] for r in whole.orderBy("row_no").collect()] == ["Sr No", "1", "", "2", "3", "4", "5"]
    got = rows_of(tables.turned_by_balance(tables.generic(whole)))
    assert [g[1] for g in got] == ["open more words", "cake for", "from a friend", "tea"]
    assert [g[2:] for g in got] == [("CR", 10_000, 10_000), ("DR", 2_000, 8_000), ("CR", 1_000, 9_000), ("DR", 500, 8_500)]
