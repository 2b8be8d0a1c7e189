from pyspark.sql import functions as F

from ledgerloom.operators import sinks
from ledgerloom.sources import invoices, statements, tables, tax_forms


def pages(spark, *texts):
    return spark.createDataFrame([(d, n, t) for d, n, t in texts], "doc_id long, page_no long, text string")


HDFC = """HDFC0001
Date Narration Ref Closing Balance
Opening Balance 1,000.00
05/04/24 UPI-SHOP ONE 000012345678 05/04/24 100.00 900.00
second line
06/04/24 SALARY ACME 0000GF4640465798 06/04/24 5,000.50 5,900.50"""


def test_lines_of_one_layout(spark):
    got = statements.transactions(pages(spark, (1, 1, HDFC), (1, 2, "07/04/24 RENT 000012345679 07/04/24 900.50 5,000.00\nPage No 2\nlost line"), (2, 1, None))).orderBy("row_no").collect()
    assert [(str(r.date), r.desc, r.type, r.amount_c, r.balance_c) for r in got] == [
        ("2024-04-05", "UPI-SHOP ONE second line", "DR", 10000, 90000),
        ("2024-04-06", "SALARY ACME", "CR", 500050, 590050),
        ("2024-04-07", "RENT", "DR", 90050, 500000),
    ]


def test_route_needs_the_labels_in_order(spark):
    right = "\n".join(x.title() for x in statements.ORDERED_LABELS)
    wrong = "\n".join(x.title() for x in reversed(statements.ORDERED_LABELS))
    got = pages(spark, (1, 1, right), (2, 1, wrong), (3, 1, None)).select(statements.bank_of(F.col("text")).alias("b")).collect()
    assert [r.b for r in got] == ["saraswat", "generic", "generic"]


def test_narrations_before_their_line(spark):
    text = "IFSC Code CNRB0001\nDate Particulars Deposits Withdrawals Balance\nUPI paid\n12:30:45\nto shop\n5-04-2024 10.00 90.00\nChq: 1\nrefund\n6-04-2024 -5.00 95.00\npage 2"
    got = statements.transactions(pages(spark, (1, 1, text))).orderBy("row_no").collect()
    assert [(r.desc, r.type, r.amount_c) for r in got] == [("UPI paid to shop", "DR", 1000), ("refund", "CR", 500)]


def test_tables_without_a_header(spark):
    rows = [(1, i, [f"0{i}/04/2024", f"a narration number {i}", "10.00" if i % 2 else "0.00", "0.00" if i % 2 else "5.00", f"{100 + i}.00"]) for i in range(1, 8)]
    df = spark.createDataFrame(rows, "doc_id long, row_no long, cells array<string>")
    got = tables.generic(df).orderBy("row_no").collect()
    assert [(r.type, r.amount_c) for r in got] == [("DR", 1000), ("CR", 500)] * 3 + [("DR", 1000)]


def test_sections_hold_until_the_next(spark):
    lines = [(1, 1, "5.00"), (1, 2, "Dividend"), (1, 3, "A 1.00 2.00"), (2, 1, "B 3.00")]
    df = spark.createDataFrame(lines, "doc_id long, line_no long, line string")
    got = tax_forms.information_entries(df).orderBy("doc_id", "line_no").collect()
    assert [(r.section, r.amount_c, r.modified_c) for r in got] == [("other_income", 500, 0), ("dividend", 100, 200), ("other_income", 300, 0)]


def test_header_roles():
    assert invoices.roles(["Invoice Date", "Invoice No", "Invoice Value", "GSTIN of supplier", "Supplier Name", "IGST"]) == {
        "igst": "IGST", "gstin": "GSTIN of supplier", "date": "Invoice Date", "total": "Invoice Value", "party": "Supplier Name", "invoice_no": "Invoice No",
    }


def test_running_balance_is_set_anew_only_where_it_differs(spark):
    rows = [(1, 1, 10, 110), (1, 2, 5, None), (1, 3, 5, 130), (1, 4, 1, 131), (1, 5, 1, 132)]
    df = spark.createDataFrame(rows, "doc_id long, row_no long, signed_c long, balance_c long")
    assert [tuple(r) for r in tables.continuity(df, 100).collect()] == [(1, 3, 120, 130)]


def test_reports_as_files(spark, tmp_path):
    frame = spark.createDataFrame([("=1", [1, 2])], "a string, b array<int>")
    sinks.write_reports({"x": frame}, str(tmp_path), "csv")
    assert [tuple(r) for r in spark.read.option("header", True).csv(str(tmp_path / "x")).collect()] == [("'=1", "[1,2]")]
    sinks.write_reports({"y": frame}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "y")).collect() == frame.collect()


def test_statement_stream(spark, tmp_path):
    frame = pages(spark, (1, 1, HDFC))
    frame.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(frame.schema).parquet(str(tmp_path / "in"))
    query = sinks.ingest_stream(stream, statements.transactions, str(tmp_path / "out"), str(tmp_path / "cp"))
    query.awaitTermination(120)
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_tables_with_dates_and_amounts_in_other_columns(spark):
    rows = [(1, 1, ["Date", "Particulars", "Amount"]), (1, 2, ["", "shop 05/04/2024", "10.00 Dr"]), (1, 3, ["", "of the corner", ""]), (1, 4, ["", "x" * 151, ""]), (1, 5, ["06/04/2024", "", "5.00 Cr"])]
    got = tables.generic(spark.createDataFrame(rows, "doc_id long, row_no long, cells array<string>")).orderBy("row_no").collect()
    assert [(str(r.date), r.desc, r.type, r.amount_c) for r in got] == [("2024-04-05", "shop 05/04/2024 of the corner", "DR", 1000), ("2024-04-06", "", "CR", 500)]


def test_any_layout_of_lines(spark):
    text = "Some bank\nDate Details Amount Balance\n5 Apr 2024 SHOP ONE 10.00 90.00\ngoes on\n06/04/2024 PAY IN 5.00 Cr 95.00\nClosing balance 95.00\n07-04-2024 FEE 0.00 1.00 94.00\n08-04-2024 LONE 7.00"
    got = statements.transactions(pages(spark, (1, 1, text))).orderBy("row_no").collect()
    assert [(str(r.date), r.desc, r.type, r.amount_c, r.balance_c) for r in got] == [
        ("2024-04-05", "SHOP ONE goes on", "CR", 1000, 9000), ("2024-04-06", "PAY IN", "CR", 500, 9500), ("2024-04-07", "FEE", "DR", 100, 9400), ("2024-04-08", "LONE", "DR", 700, None),
    ]


def test_documents_by_table_or_lines_and_those_without_rows(spark):
    lines = pages(spark, (1, 1, HDFC), (2, 1, "A bank\nwithout lines"), (3, 1, "Nothing"))
    cells = spark.createDataFrame([(2, 1, ["Date", "Narration", "Debit", "Credit", "Balance"]), (2, 2, ["05/04/2024", "shop", "10.00", "", "90.00"]), (2, 3, ["06/04/2024", "pay", "", "5.00", ""])], "doc_id long, row_no long, cells array<string>")
    found = statements.ingest(lines, cells)
    assert sorted((r.doc_id, r.type, r.amount_c, r.balance_c) for r in found.where("doc_id = 2").collect()) == [(2, "CR", 500, 9500), (2, "DR", 1000, 9000)]
    assert found.where("doc_id = 1").count() == 2 and [r.doc_id for r in statements.without_rows(lines, found).collect()] == [3]
    assert statements.ingest(lines.where("false"), cells.where("false")).collect() == []


def test_words_that_are_unsure_or_doubled(spark):
    rows = [(1, 1, "a", 10, 0, 90.0), (1, 1, "a", 20, 3, 90.0), (1, 1, "b", 30, 1, 12.0), (1, 1, "c", 40, 2, 31.0), (1, 1, "d", 10, 60, 95.0)]
    df = spark.createDataFrame(rows, "doc_id long, page_no long, text string, left int, top int, conf double")
    assert sorted(r.line for r in tables.word_rows(df).collect()) == ["a c", "d"]
