"""The ledger and invoice model projected from the star-schema tables, in integer paise."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPENING_C = 50_000_000
#: Rows of the ledger that a task of its windows holds, about; smaller ledgers are dealt out as the session says.
ROWS_A_TASK = 250_000

#: Narrations that reach every branch of the classifiers, and near misses.
NARRATIONS = [
    "NEFT CR-0042-ACME WORKS PVT LTD/Salary April", "Salary for march globex india", "IMPS-1234-JOHN TRADERS-HDFC0001", "acme technologies invoice payment",
    "Meesho payout week 12", "Savings interest credit", "INT.PD:01-04 TO 30-06", "Dividend credit infy", "Rent received flat 7", "Cash deposit at/BR01/CDM",
    "Expense claim reimb april", "Refund amazon order", "Paytm wallet transfer", "Razorpay settlement 887", "Client payment for project", "Pocketly loan disbursal",
    "True credits disbursal", "UPI/family member one/transfer", "Self transfer own account", "Unknown inward remit", "EMI payment home loan", "NACH debit bajaj",
    "nach/abc mandate", "nach/ 1 mandate", "Lazypay repay dues", "ECS return charges", "Cheque bounce penalty charge", "ATM withdrawal main road", "Cash wdl self",
    "LIC premium annual", "PPF deposit sbi", "Safe gold tuition fee", "Star health mediclaim", "TDS deducted on interest", "UPI/swiggy.food@okaxis/lunch",
    "UPI/zeptonow@ybl/order", "Zomato order 55", "Blinkit groceries", "Flipkart shopping", "Indian oil petrol", "Apollo pharmacy bill", "Udemy course books",
    "Electricity bescom bill", "Netflix subscription", "IRCTC rail ticket", "Uber ride", "Airtel broadband", "Zerodha mutual fund sip ", "Canva pro yearly",
    "House rent april", "RTGS-9981-GLOBEX TRADING CO/supply", "POS/4512/big bazaar", "PCI/0908/railway booking", "SWIFT foreign inward usd 500", "CHQ clearing 000123",
    "Dream11 contest", "Binance p2p bitcoin", "Late payment fee overdue charge", "Credit card bill hdfc cc", "MB:Received from Jane Stores", "MB:Sent to family member two",
    "Coffee beans premium", "Cloud solutions consulting fee",
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(index, values: list[str]):
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def dealt(rows: DataFrame, count: int, key) -> DataFrame:
    """Rows by a key, a large table in as many parts as its rows need, whatever the session's number is."""
    if count <= ROWS_A_TASK:
        return rows.repartition(key)
    return rows.repartition(max(-(-count // ROWS_A_TASK), int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))), key)


def by_account(rows: DataFrame, count: int) -> DataFrame:
    """A large ledger in as many parts as its rows need, so that what a task sorts and groups doesn't grow with the ledger.

    The session's number of parts is fixed, and where it is large they are merged by their packed bytes, a small part of what rows take in memory.
    """
    return rows if count <= ROWS_A_TASK else dealt(rows, count, F.col("account_id"))


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, txn_id, date, desc, type, amount_c: the ledger's rows as they lie in the orders, without a shuffle."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice")
    return orders.select(
        F.col("o_custkey").alias("account_id"),
        F.col("o_orderkey").alias("txn_id"),
        F.to_date("o_orderdate").alias("date"),
        pick(F.col("o_orderkey"), NARRATIONS).alias("desc"),
        F.when(F.col("o_orderkey") % 5 < 2, "CR").otherwise("DR").alias("type"),
        F.round(F.col("o_totalprice") * 100).cast("long").alias("amount_c"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """account_id, row_no, txn_id, date, desc, type, amount_c, balance_c: orders as an account's transactions."""
    rows = entries(spark, sf_dir)
    rows = by_account(rows, rows.count())
    order = Window.partitionBy("account_id").orderBy("date", "txn_id")
    signed = F.when(F.col("type") == "CR", F.col("amount_c")).otherwise(-F.col("amount_c"))
    running = F.sum(signed).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumns({"row_no": F.row_number().over(order).cast("long"), "balance_c": running + OPENING_C})


def noisy_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ledger with directions flipped, amounts misread and balances lost, as parsers do."""
    k = F.col("txn_id")
    return ledger(spark, sf_dir).withColumns(
        {
            "type": F.when(k % 17 == 0, F.when(F.col("type") == "CR", "DR").otherwise("CR")).otherwise(F.col("type")),
            "amount_c": F.when(k % 19 == 0, F.col("amount_c") + 12_345).otherwise(F.col("amount_c")),
            "balance_c": F.when(k % 23 != 0, F.col("balance_c")),
        }
    )


def half_up(numerator, denominator: int):
    """Integer division rounded half up, for non-negative numbers."""
    lifted = numerator + denominator // 2
    return ((lifted - lifted % denominator) / denominator).cast("long")


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as tax invoices: h, invoice_no, date, party, gstin, amounts in paise (`tax_c` is the sum of the three heads), account."""
    line = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey", "l_extendedprice", "l_discount", "l_tax")
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    customer = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    supplier = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    n1 = F.round(F.col("l_extendedprice") * 100).cast("long") * (100 - F.round(F.col("l_discount") * 100).cast("long"))
    # lines move with the amounts that a query uses, not with what these are worked out from
    line = line.withColumn("taxable_c", half_up(n1, 100)).withColumn("tax_c", half_up(F.col("taxable_c") * F.round(F.col("l_tax") * 100).cast("long"), 100))
    # orders meet their customers first: they are fewer than lines, which so move once
    placed = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = line.join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(placed, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.withColumn("h", F.expr("l_orderkey * 31 + l_linenumber * 7 + l_suppkey * 3 + l_partkey"))
    away = F.col("s_nationkey") != F.col("c_nationkey")
    half = ((F.col("tax_c") - F.col("tax_c") % 2) / 2).cast("long")
    valid = F.concat(
        F.lpad((1 + F.col("s_nationkey") % 24).cast("string"), 2, "0"), F.lit("ABCDE"), F.lpad((F.col("l_suppkey") % 10000).cast("string"), 4, "0"), F.lit("F1Z5")
    )
    parties = ["Acme software pvt ltd", "Grand hotel", "City pharma", "Fast courier", "Export house usd", "Steel works", "Interest advisors", "Plain trader"]
    rows = rows.withColumns(
        {
            "igst_c": F.when(away, F.col("tax_c")).otherwise(F.lit(0)),
            "cgst_c": F.when(away, F.lit(0)).otherwise(half),
            "gstin_raw": F.when(F.col("h") % 10 == 0, "").when(F.col("h") % 10 == 1, "BAD123").otherwise(valid),
            "party": pick(F.col("h"), parties),
            "invoice_no": F.concat_ws("-", F.lit("INV"), *[F.col(c).cast("string") for c in ("l_orderkey", "l_linenumber", "l_suppkey", "l_partkey")]),
            "date": F.to_date("o_orderdate"),
        }
    )
    rows = rows.withColumn("sgst_c", F.col("tax_c") - F.col("igst_c") - F.col("cgst_c"))
    return rows.select(
        "h", "invoice_no", "date", "party", "gstin_raw", "taxable_c", "cgst_c", "sgst_c", "igst_c", "tax_c", (F.col("taxable_c") + F.col("tax_c")).alias("total_c"), F.col("o_custkey").alias("account_id")
    )
