"""The projected ledger and customers printed as statements and tax forms, to be read again."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.sources import fixtures

LIFT_C = 100_000_000_000
BANKS = ["hdfc", "icici", "axis", "canara", "saraswat", "kotak", "sbi", "pnb"]


def rupees(paise):
    return F.format_string("%d.%02d", F.floor(paise / 100), paise % 100)


def statement_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions ten years later, with balances lifted above zero, and the bank that prints them."""
    rows = fixtures.ledger(spark, sf_dir)
    return rows.select(
        F.col("account_id").alias("doc_id"), "row_no", "txn_id", F.add_months("date", 120).alias("date"), F.trim("desc").alias("desc"), "type", "amount_c",
        (F.col("balance_c") + LIFT_C).alias("balance_c"), F.element_at(F.array(*[F.lit(b) for b in BANKS]), (F.col("account_id") % 8 + 1).cast("int")).alias("bank"),
    )


def statement_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, text: twenty transactions a page, in the layout of each document's bank."""
    rows = statement_rows(spark, sf_dir)
    d = lambda form: F.date_format("date", form)
    amount, balance, cr = rupees(F.col("amount_c")), rupees(F.col("balance_c")), F.col("type") == "CR"
    opened = rupees(F.lit(fixtures.OPENING_C + LIFT_C))
    note, bank = F.concat(F.lit("note "), F.col("row_no").cast("string")), F.col("bank")
    text = (
        F.when(bank == "hdfc", F.concat_ws("\n", F.concat_ws(" ", d("dd/MM/yy"), "desc", F.lpad(F.col("txn_id").cast("string"), 12, "0"), d("dd/MM/yy"), amount, balance), note))
        .when(bank == "icici", F.concat_ws("\n", F.concat_ws(" ", d("dd-MM-yyyy"), "desc", amount, balance), note))
        .when(bank == "axis", F.concat_ws(" ", d("dd-MM-yyyy"), d("dd-MM-yyyy"), "desc", amount, "type", balance, F.lit("BR12")))
        .when(bank == "canara", F.concat_ws("\n", "desc", note, F.concat_ws(" ", d("d-MM-yyyy"), F.concat(F.when(cr, "-").otherwise(""), amount), balance)))
        .when(bank == "saraswat", F.concat_ws("\n", F.concat_ws(" ", d("dd/MM/yyyy"), F.lit("123456"), F.concat(F.when(cr, "").otherwise("-"), amount), balance), "desc"))
        .when(bank == "sbi", F.concat_ws("\n", F.concat_ws(" ", d("dd/MM/yyyy"), "desc"), F.concat(F.lit("CIF: 8812-"), F.lpad(F.col("txn_id").cast("string"), 11, "7")), F.concat_ws(" ", amount, balance)))
        .when(bank == "pnb", F.concat_ws(" ", d("dd/MM/yyyy"), F.when(cr, "0.00").otherwise(amount), F.when(cr, amount).otherwise("0.00"), F.concat(balance, F.lit(" Cr.")), "desc"))
        .otherwise(F.concat_ws(" ", d("dd/MM/yyyy"), "desc", amount, balance))
    )
    page = F.when(bank == "saraswat", F.floor((100_000 - F.col("row_no")) / 20)).otherwise(F.floor((F.col("row_no") - 1) / 20))
    order = F.when(bank == "saraswat", -F.col("row_no")).otherwise(F.col("row_no"))
    pages = rows.withColumns({"text": text, "page": page, "order": order}).groupBy("doc_id", "bank", "page").agg(F.sort_array(F.collect_list(F.struct("order", "text"))).alias("rows"))
    ranked = pages.groupBy("doc_id", "bank").agg(F.sort_array(F.collect_list(F.struct("page", "rows"))).alias("pages"))
    flat = ranked.select("doc_id", "bank", F.posexplode("pages").alias("at", "p"))
    body = F.array_join(F.transform("p.rows", lambda x: x["text"]), "\n")
    labels = "Account Details\nGeneral Details\nNumber: 1\nNickname: a\nIBAN: x\nName: b\nStatus: ok\nType: s\nCurrency: INR\nOpen Date: 1\nBranch: z\nBalance Details\nAvailable Balance: 1\nTotal Balance: 1\nLedger Balance: 1\nEffective Available Balance: 1\nUnclear Balance: 0\nTransactions List"
    head = (
        F.when(bank == "hdfc", F.concat(F.lit("HDFC0001234 branch\nDate Narration Ref Closing Balance\nOpening Balance "), opened))
        .when(bank == "icici", F.concat(F.lit("www.icicibank.com\nPARTICULARS DEPOSITS WITHDRAWALS\n01-01-2001 B/F "), opened))
        .when(bank == "axis", F.lit("IFSC UTIB0000001\nTran Date Value Date Transaction Particulars Amount DR/CR"))
        .when(bank == "canara", F.lit("IFSC Code CNRB0001\nDate Particulars Deposits Withdrawals Balance"))
        .when(bank == "saraswat", F.lit(labels))
        .when(bank == "sbi", F.concat(F.lit("IFSC SBIN0001\nPost Date Value Date Description Debit Credit Balance\nOpening Balance "), opened))
        .when(bank == "pnb", F.lit("IFSC Code PUNB0001\nTransaction Date Cheque Number Withdrawal Deposit Balance Narration"))
        .otherwise(F.concat(F.lit("IFSC KKBK0001\nDate Description Amount Balance\nOpening Balance "), opened))
    )
    number = F.concat(F.lit("A/c No: "), F.lpad(F.col("doc_id").cast("string"), 10, "0"), F.lit(" Current account\nStatement period 01/04/2005 to 31/03/2006"))
    return flat.select("doc_id", (F.col("at") + 1).alias("page_no"), F.when(F.col("at") == 0, F.concat_ws("\n", head, number, body)).otherwise(body).alias("text"))


def _lines(rows: DataFrame, texts: list) -> DataFrame:
    return rows.select("doc_id", F.posexplode(F.array(*texts)).alias("at", "line")).select("doc_id", (F.col("at") + 1).alias("line_no"), "line")


def information_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.abs(F.round(F.col("c_acctbal") * 100).cast("long")).alias("c"))
    a, k = rupees(F.col("c")), rupees(F.col("doc_id") * 10 + 5)
    f = F.concat
    texts = [
        f(F.lit("Opening line "), k), F.lit("Salary and perquisites"), f(F.lit("Employer paid "), a, F.lit(" "), k, F.lit(" 01-04-2024")), F.lit("Interest from savings bank"),
        f(F.lit("Branch one "), k), f(F.lit("Branch two "), k), f(F.lit("Dividend of shares "), a), f(F.lit("GST turnover "), a), F.lit("no amount here"), f(F.lit("Rent received "), k),
    ]
    return _lines(rows, texts)


def credit_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.abs(F.round(F.col("c_acctbal") * 100).cast("long")).alias("c"))
    a, k = rupees(F.col("c")), rupees(F.col("doc_id") * 10 + 5)
    f, sp = F.concat, F.lit(" ")
    texts = [
        f(F.lit("Before any part "), k), F.lit("PART A - Tax deducted"), f(F.lit("Acme salary ABCD12345E "), a, sp, k, sp, k), f(F.lit("Globex professional WXYZ54321K "), k, sp, k),
        f(F.lit("No account number "), a), F.lit("PART B"), f(F.lit("One amount "), a), f(F.lit("House sold "), a, sp, k), F.lit("PART C"), f(F.lit("Collected "), a, sp, k),
        F.lit("Part - D refunds"), f(F.lit("Refund "), k, F.lit(" 05-06-2024")), F.lit("PART E"), f(F.lit("Deposit reported "), a), F.lit("PART G"), f(F.lit("Default "), a),
    ]
    return _lines(rows, texts)


def table_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The transactions as table rows: three headers and one table without; an overflow row after every fifth."""
    rows = statement_rows(spark, sf_dir)
    amount, balance, cr = rupees(F.col("amount_c")), rupees(F.col("balance_c")), F.col("type") == "CR"
    d, kind, none = F.date_format("date", "dd/MM/yyyy"), F.col("doc_id") % 4, F.lit("")
    left, right = F.when(cr, "").otherwise(amount), F.when(cr, amount).otherwise("")
    cells = (
        F.when(kind == 0, F.array(d, F.col("desc"), left, right, balance))
        .when(kind == 1, F.array(F.col("row_no").cast("string"), F.col("desc"), d, balance, F.concat_ws(" ", amount, "type")))
        .when(kind == 2, F.array(d, F.col("txn_id").cast("string"), right, left, F.col("desc"), balance))
        .otherwise(F.array(d, F.concat("desc", F.lit(" long enough")), F.when(cr, "0.00").otherwise(amount), F.when(cr, amount).otherwise("0.00"), balance))
    )
    body = rows.select("doc_id", (F.col("row_no") * 10).alias("row_no"), cells.alias("cells"))
    over = F.array(none, F.lit("overflow"), none, none, none)
    more = rows.where("row_no % 5 = 0 and doc_id % 4 = 0").select("doc_id", (F.col("row_no") * 10 + 1).alias("row_no"), over.alias("cells"))
    heads = [["Txn Date", "Narration", "Withdrawal (Dr.)", "Deposit (Cr.)", "Closing Balance"], ["Sr No", "Particulars", "Value Date", "Balance(INR)", "Amount(Rs)"], ["Date", "Chq/Ref No", "Credit", "Debit", "Details", "Bal"]]
    ids = rows.select("doc_id").distinct()
    named = F.element_at(F.array(*[F.array(*[F.lit(x) for x in h]) for h in heads]), (F.col("doc_id") % 4 + 1).cast("int"))
    head = ids.where("doc_id % 4 < 3").select("doc_id", F.lit(2).cast("long").alias("row_no"), named.alias("cells"))
    title = ids.select("doc_id", F.lit(1).cast("long").alias("row_no"), F.array(F.lit("Statement of account"), none, none, none, none).alias("cells"))
    foot = ids.select("doc_id", F.lit(10_000_000).cast("long").alias("row_no"), F.array(none, F.lit("Closing balance"), none, none, F.lit("1.00")).alias("cells"))
    return body.unionByName(more).unionByName(head).unionByName(title.where("doc_id % 4 < 3")).unionByName(foot)


def online_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-cell rows with every eleventh direction and every thirteenth amount wrong."""
    rows = statement_rows(spark, sf_dir)
    wrong = F.when(F.col("txn_id") % 13 == 0, F.col("amount_c") + 77_700).otherwise(F.col("amount_c"))
    cr = (F.col("type") == "CR") != (F.col("txn_id") % 11 == 0)
    a, e = rupees(wrong), F.lit("")
    cells = F.array(F.date_format("date", "ddMMM yyyy"), e, F.concat_ws(" ", "desc", F.lpad(F.col("txn_id").cast("string"), 12, "0")), e, F.when(cr, e).otherwise(a), F.when(cr, a).otherwise(e), rupees(F.col("balance_c")))
    return rows.select("doc_id", "row_no", cells.alias("cells"))


def merged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = statement_rows(spark, sf_dir)
    d = F.when(F.col("row_no") % 3 == 0, F.date_format("date", "dd-MMyyyy")).otherwise(F.date_format("date", "dd-MM-yyyy"))
    first = F.concat(F.col("desc"), F.lit(" text\n"), F.col("row_no").cast("string"), F.lit(" "), d, F.lit(" "), d)
    a, cr = rupees(F.col("amount_c")), F.col("type") == "CR"
    return rows.select("doc_id", "row_no", F.array(first, F.lit(""), F.when(cr, "-").otherwise(a), F.when(cr, a).otherwise("-"), rupees(F.col("balance_c"))).alias("cells"))


def page_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words as recognised on pages: each transaction a row 60 apart, words up to 9 lower than the first."""
    rows = statement_rows(spark, sf_dir)
    top = (F.col("row_no") % 20) * 60
    w = lambda text, left, low: F.struct(text.alias("text"), F.lit(left).alias("left"), (top + low).alias("top"))
    words = F.array(w(F.date_format("date", "dd-MM-yyyy"), 100, 0), w(F.lit("word"), 300, 9), w(rupees(F.col("amount_c")), 700, 4), w(rupees(F.col("balance_c")), 900, 2))
    return rows.select("doc_id", F.floor(F.col("row_no") / 20).alias("page_no"), F.inline(words))


def placed_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Transactions as words with places: the two words of a cell 4 apart, cells 40, tops up to one point off."""
    rows = statement_rows(spark, sf_dir)
    top = (F.col("row_no") % 20) * 12
    w = lambda text, x0, x1, low: F.struct(text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"), (top + low).alias("top"))
    words = F.array(w(F.date_format("date", "dd-MM-yyyy"), 10, 60, 0), w(F.lit("two"), 100, 120, 1), w(F.lit("words"), 124, 150, -1), w(rupees(F.col("amount_c")), 190, 230, 0))
    return rows.select("doc_id", F.floor(F.col("row_no") / 20).alias("page_no"), F.inline(words))


def invoice_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices as a spreadsheet's strings: grouped digits and signs, some totals and taxable values left blank."""
    rows = fixtures.invoices(spark, sf_dir)
    shown = lambda c: F.concat(F.format_number(F.floor(F.col(c) / 100), 0), F.lit("."), F.lpad((F.col(c) % 100).cast("string"), 2, "0"))
    k = F.col("h") % 4
    return rows.select(
        F.col("invoice_no").alias("Invoice No"), F.date_format("date", "dd-MM-yyyy").alias("Invoice Date"), F.col("party").alias("Customer Name"), F.lower("gstin_raw").alias("Customer GSTIN"),
        F.when(k == 1, "").otherwise(F.concat(F.lit("₹ "), shown("taxable_c"))).alias("Taxable Value"), shown("cgst_c").alias("CGST Amount"), shown("sgst_c").alias("SGST"),
        F.when(F.col("igst_c") == 0, F.lit(None)).otherwise(shown("igst_c")).alias("IGST"), F.when(k == 2, "nan").otherwise(shown("total_c")).alias("Invoice Value"),
    )


def taxpayer_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"))
    number = F.concat(F.lit("ABCDE"), F.lpad((F.col("doc_id") % 10000).cast("string"), 4, "0"), F.lit("F"))
    return rows.select("doc_id", F.concat(F.lit("Form\nPAN "), number, F.lit("\nName : JANE DOE\nAddress: 1 Main Road\nAssessment Year: 2024 - 25\n")).alias("text"))


def mixed_statements(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pages, table cells and placed words of documents of four kinds (doc_id % 4), each best read in one way.

    0: ruled tables; 1: aligned text, besides tables that lost their balances; 2: placed words; 3: lines.
    """
    rows = statement_rows(spark, sf_dir).withColumn("kind", F.col("doc_id") % 4)
    amount, balance, cr = rupees(F.col("amount_c")), rupees(F.col("balance_c")), F.col("type") == "CR"
    day, none, bar = F.date_format("date", "dd/MM/yyyy"), F.lit(""), F.lit("   ")
    left, right = F.when(cr, "-").otherwise(amount), F.when(cr, amount).otherwise("-")
    opened = rupees(F.lit(fixtures.OPENING_C + LIFT_C))

    said = F.when(F.col("kind") == 1, F.concat(day, bar, "desc", bar, left, bar, right, bar, balance)).otherwise(F.concat_ws(" ", day, "desc", amount, balance))
    lines = F.transform(F.sort_array(F.collect_list(F.struct("row_no", said.alias("line")))), lambda x: x["line"])
    typed = rows.where("kind in (1, 3)").groupBy("doc_id", "kind").agg(F.array_join(lines, "\n").alias("body"))
    head = F.when(F.col("kind") == 1, F.lit("Aligned Bank account\nTxn Date   Narration   Debit   Credit   Balance")).otherwise(F.concat(F.lit("Line Bank account\nOpening Balance "), opened))
    pages = typed.select("doc_id", F.lit(1).alias("page_no"), F.concat_ws("\n", head, "body").alias("text"))
    bare = rows.where("kind in (0, 2)").select("doc_id", "kind").distinct()
    title = F.when(F.col("kind") == 0, "Ruled Bank account").otherwise("Placed Bank account")
    pages = pages.unionByName(bare.select("doc_id", F.lit(1).alias("page_no"), title.alias("text")))

    body = F.when(F.col("kind") == 0, F.array(day, F.col("desc"), left, right, balance)).otherwise(F.array(day, F.col("desc"), left, right, none))
    cells = rows.where("kind in (0, 1)").select("doc_id", (F.col("row_no") + 1).alias("row_no"), body.alias("cells"))
    names = F.array(*[F.lit(x) for x in ("Date", "Narration", "Withdrawals", "Deposits", "Balance")])
    cells = cells.unionByName(rows.where("kind in (0, 1)").select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("row_no"), names.alias("cells")))

    w = lambda text, x0, x1: F.struct(text.alias("text"), F.lit(x0).alias("x0"), F.lit(x1).alias("x1"))
    at = F.array(w(day, 10, 60), w(F.lit("Ref"), 100, 118), w(F.col("desc"), 122, 180), w(F.concat_ws(" ", amount, "type"), 220, 270), w(balance, 300, 360))
    words = rows.where("kind = 2").select("doc_id", F.floor(F.col("row_no") / 20).alias("page_no"), ((F.col("row_no") % 20 + 2) * 12).alias("top"), F.inline(at))
    named = F.array(w(F.lit("Date"), 10, 60), w(F.lit("Narration"), 100, 180), w(F.lit("Amount"), 220, 270), w(F.lit("Balance"), 300, 360))
    heads = rows.where("kind = 2").select("doc_id").distinct().select("doc_id", F.lit(0).cast("long").alias("page_no"), F.lit(0).cast("long").alias("top"), F.inline(named))
    return pages, cells, words.unionByName(heads)


def footer_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Tables with serial numbers that lack every seventh row, and the lines of their pages, which have all of them."""
    rows = statement_rows(spark, sf_dir)
    amount, balance, cr = rupees(F.col("amount_c")), rupees(F.col("balance_c")), F.col("type") == "CR"
    day, serial, none = F.date_format("date", "d MMM yyyy"), F.col("row_no").cast("string"), F.lit("")
    body = F.array(serial, day, F.col("desc"), none, F.when(cr, none).otherwise(amount), F.when(cr, amount).otherwise(none), balance)
    cells = rows.where("row_no % 7 != 0").select("doc_id", (F.col("row_no") + 1).alias("row_no"), body.alias("cells"))
    names = F.array(*[F.lit(x) for x in ("Sr No", "Txn Date", "Narration", "Chq No", "Withdrawal (Dr.)", "Deposit (Cr.)", "Balance")])
    cells = cells.unionByName(rows.select("doc_id").distinct().select("doc_id", F.lit(1).cast("long").alias("row_no"), names.alias("cells")))
    said = F.array(F.concat_ws(" ", serial, day, "desc"), F.concat_ws(" ", amount, balance), F.concat(F.lit("Page "), serial, F.lit(" of 9")))
    lines = rows.select("doc_id", "row_no", F.posexplode(said).alias("k", "line"))
    return cells, lines.select("doc_id", (F.col("row_no") * 10 + F.col("k")).alias("line_no"), "line")


def uploads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger's accounts as uploads: each once, every third once more in another order, every seventh with one amount changed."""
    rows = fixtures.ledger(spark, sf_dir).select("account_id", "row_no", "date", "desc", "type", "amount_c", "balance_c")
    one = rows.withColumn("upload_id", F.col("account_id") * 10 + 1)
    again = rows.where("account_id % 3 = 0").withColumn("upload_id", F.col("account_id") * 10 + 2).withColumn("row_no", -F.col("row_no"))
    changed = rows.where("account_id % 7 = 0").withColumn("upload_id", F.col("account_id") * 10 + 3).withColumn("amount_c", F.col("amount_c") + F.when(F.col("row_no") == 1, 1).otherwise(0))
    return one.unionByName(again).unionByName(changed)


def _tabled(rows: DataFrame, tables: list[list]) -> DataFrame:
    every = [F.struct(F.lit(t).alias("table_no"), F.lit(k).alias("row_no"), F.array(*[c if not isinstance(c, str) else F.lit(c) for c in cells]).alias("cells")) for t, rows_ in enumerate(tables) for k, cells in enumerate(rows_)]
    width = max(len(r) for t in tables for r in t)
    every = [e.withField("cells", F.concat(e["cells"], F.array_repeat(F.lit(""), width - len(r)))) for e, r in zip(every, [r for t in tables for r in t])]
    return rows.select("doc_id", F.inline(F.array(*every)))


def credit_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tables of the tax credit statement: two deductors with payments, a part without tables of its own, a collector."""
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.abs(F.round(F.col("c_acctbal") * 100).cast("long")).alias("c"))
    a, k = rupees(F.col("c") + 1), rupees(F.col("doc_id") * 10 + 5)
    head = ["Sr. No.", "Name of Deductor", "TAN of Deductor", "Total Amount Paid", "Total TDS Deducted", "Total TDS Deposited"]
    tables = [
        [head, ["1", "Acme salary office", "ABCD12345E", a, k, k], ["1", "192", "05-06-2024", "", k, k], ["2", "192", "05-07-2024", "", k, "0.00"], ["2", "Globex professional", "WXYZ54321K", k, k, ""], ["1", "194J", "01/02/2024", "", a]],
        [["PART B", "Details of tax for 15H"], ["1", "nobody counted here", "", k]],
        [["Sr. No.", "Name of Collector", "TAN of Collector", "Total Amount Paid", "Tax Collected"], ["", "before any collector", "", k], ["1", "Motor dealers", "MOTO11111D", a, k]],
    ]
    return _tabled(rows, tables)


def information_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("doc_id"), F.abs(F.round(F.col("c_acctbal") * 100).cast("long")).alias("c"))
    a, k = rupees(F.col("c") + 1), rupees(F.col("doc_id") * 10 + 5)
    tables = [
        [["Interest from savings bank", "", "Amount"], ["before a source", "01-04-2024", k], ["Reported by: First bank", "", ""], ["Savings account one", "02-04-2024", a, k], ["Savings account two", "", k]],
        [["Dividend", "", ""], ["Shares of acme", "", k], ["reported by Second registrar", "", ""], ["Shares of globex", "", a]],
        [["Something else", "", ""], ["short", "", k]],
    ]
    return _tabled(rows, tables)
