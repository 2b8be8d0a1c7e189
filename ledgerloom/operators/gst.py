"""Invoices, returns and reconciliation of purchase tax credit. Money in paise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R

GSTIN = r"^[0-9]{2}[A-Z]{5}[0-9]{4}[A-Z][0-9A-Z][Z][0-9A-Z]$"
# States by the first two digits of a registration, goods codes by keyword (the first wins), tax slabs.
STATES = {
    "01": "Jammu & Kashmir", "02": "Himachal Pradesh", "03": "Punjab", "04": "Chandigarh", "05": "Uttarakhand", "06": "Haryana",
    "07": "Delhi", "08": "Rajasthan", "09": "Uttar Pradesh", "10": "Bihar", "11": "Sikkim", "12": "Arunachal Pradesh", "13": "Nagaland",
    "14": "Manipur", "15": "Mizoram", "16": "Tripura", "17": "Meghalaya", "18": "Assam", "19": "West Bengal", "20": "Jharkhand",
    "21": "Odisha", "22": "Chhattisgarh", "23": "Madhya Pradesh", "24": "Gujarat", "26": "Dadra & Nagar Haveli", "27": "Maharashtra",
    "28": "Andhra Pradesh", "29": "Karnataka", "30": "Goa", "31": "Lakshadweep", "32": "Kerala", "33": "Tamil Nadu", "34": "Puducherry",
    "35": "Andaman & Nicobar", "36": "Telangana", "37": "Andhra Pradesh (New)",
}
HSN = {
    "restaurant": "9963", "hotel": "9963", "pizza": "9963", "food": "9963", "pharma": "3004", "medicine": "3004", "software": "8523",
    "it ": "8523", "tech": "8523", "consulting": "9983", "legal": "9982", "transport": "9965", "logistics": "9965", "courier": "9965",
    "interior": "9954", "construct": "9954", "builder": "9954", "retail": "9999", "wholesale": "9999", "cloth": "6203", "garment": "6203",
    "fashion": "6203", "machinery": "8431", "electric": "8544", "fertilizer": "3105", "steel": "7208", "cement": "2523",
}
SLABS = [0, 5, 12, 18, 28]
EXPORT = ["export", "swift", "foreign", "usd", "eur", "gbp", "paypal", "stripe", "wise", "remittance", "lut"]
EXEMPT = ["interest", "dividend", "salary", "wages", "rent received", "agricultural", "exempted", "nil rated"]
B2C_LARGE_C = 25_000_000


def slab(tax: Column, taxable: Column) -> Column:
    """The nearest slab of the rounded percentage, the lower one on ties; 18 without a taxable value."""
    rate = F.floor(tax * 100 / taxable + 0.5)
    out = F.when(F.coalesce(taxable, F.lit(0)) <= 0, F.lit(18))
    for low, high in zip(SLABS, SLABS[1:]):
        out = out.when(rate * 2 <= low + high, F.lit(low))
    return out.otherwise(F.lit(SLABS[-1]))


def derived(rows: DataFrame) -> DataFrame:
    """Validity of the registration, supply type, state, goods code, slab and nature of each invoice."""
    gstin = F.upper(F.trim(F.coalesce("gstin_raw", F.lit(""))))
    rows = rows.withColumn("gstin_valid", gstin.rlike(GSTIN))
    party = F.lower(F.coalesce("party", F.lit("")))
    states = F.create_map(*[F.lit(x) for pair in STATES.items() for x in pair])
    return rows.withColumns(
        {
            "supply_type": F.when(F.col("gstin_valid"), "B2B").otherwise("B2C"),
            "state": F.when(F.col("gstin_valid"), F.coalesce(F.try_element_at(states, F.substring(gstin, 1, 2)), F.lit("Unknown"))).otherwise("Unknown"),
            "hsn_code": R.first_match([(party.contains(k), v) for k, v in HSN.items()], F.lit("9999")),
            "gst_rate": slab(F.col("cgst_c") + F.col("sgst_c") + F.col("igst_c"), F.col("taxable_c")),
            "interstate": F.col("igst_c") > 0,
            "nature": F.when(R.contains_any(party, EXPORT), "export").when(R.contains_any(party, EXEMPT), "exempt").otherwise("taxable"),
            "itc_c": F.col("cgst_c") + F.col("sgst_c") + F.col("igst_c"),
        }
    )


def hsn_summary(rows: DataFrame) -> DataFrame:
    sums = [F.sum(c).alias(c) for c in ("total_c", "taxable_c", "cgst_c", "sgst_c", "igst_c")]
    return rows.groupBy("hsn_code").agg(*sums, F.count(F.lit(1)).alias("invoices"))


def by_state(rows: DataFrame) -> DataFrame:
    kept = rows.where("interstate")
    return kept.groupBy("state").agg(F.sum("taxable_c").alias("taxable_c"), F.sum("igst_c").alias("igst_c"), F.count(F.lit(1)).alias("invoices"))


def by_nature(rows: DataFrame) -> DataFrame:
    return rows.groupBy("nature").agg(*[F.sum(c).alias(c) for c in ("taxable_c", "igst_c", "cgst_c", "sgst_c")], F.count(F.lit(1)).alias("invoices"))


def outward(rows: DataFrame) -> DataFrame:
    """Table 4, 5 and totals of a sales return in one row."""
    b2b = F.col("gstin_valid")
    large = ~b2b & (F.col("total_c") > B2C_LARGE_C) & F.col("interstate")
    s = lambda c, w=F.lit(True): F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    return rows.agg(
        F.count(F.lit(1)).alias("invoices"), s("total_c").alias("declared_c"), s("total_c", b2b).alias("b2b_c"), s("total_c", ~b2b).alias("b2c_c"),
        F.count_if(b2b).alias("b2b"), F.count_if(large).alias("b2c_large"), F.count_if((F.col("gstin_raw") != "") & ~b2b).alias("gstin_invalid"),
        s("itc_c").alias("tax_c"),
    )


def set_off(heads: DataFrame) -> DataFrame:
    """Net tax after credit: integrated credit goes to its own head, then central, then state; others to their own only."""
    c = F.col
    zero = F.lit(0)
    h = heads.withColumn("igst_used", F.least(c("itc_igst_c"), c("out_igst_c")))
    h = h.withColumn("left1", c("itc_igst_c") - c("igst_used")).withColumn("igst_for_cgst_c", F.least(c("left1"), c("out_cgst_c")))
    h = h.withColumn("left2", c("left1") - c("igst_for_cgst_c")).withColumn("igst_for_sgst_c", F.least(c("left2"), c("out_sgst_c")))
    h = h.withColumns(
        {
            "net_igst_c": F.greatest(zero, c("out_igst_c") - c("itc_igst_c")),
            "net_cgst_c": F.greatest(zero, c("out_cgst_c") - c("igst_for_cgst_c") - c("itc_cgst_c")),
            "net_sgst_c": F.greatest(zero, c("out_sgst_c") - c("igst_for_sgst_c") - c("itc_sgst_c")),
        }
    )
    return h.withColumn("net_payable_c", c("net_igst_c") + c("net_cgst_c") + c("net_sgst_c")).drop("igst_used", "left1", "left2")


def number(c: Column | str) -> Column:
    """An invoice number or a registration, as both sides are compared."""
    return F.upper(F.coalesce(c, F.lit("")))


def entries(statement: DataFrame, register: DataFrame) -> DataFrame:
    """Invoices of both sides in one table, dealt by invoice number.

    Rows have row_no, invoice_no, gstin, itc_c; statement rows also itc_eligible.
    """
    given = ["row_no", "invoice_no", "gstin", "itc_c"]
    both = statement.select(*given, "itc_eligible", F.lit(True).alias("stated")).unionByName(register.select(*given, F.lit(None).cast("boolean").alias("itc_eligible"), F.lit(False).alias("stated")))
    return both.repartition(number("invoice_no")).withColumn("inv", number("invoice_no"))


def settled(entries: DataFrame, numbers: bool = False) -> DataFrame:
    """Each entry of both sides with its outcome: `status` is null for register rows that a statement row used.

    A register row is found by number and registration (the last one), else by number alone (the first one). All that
    is asked about an entry lies among the entries of its number, so entries dealt by `inv` move no more, and nothing
    is stored. `s_itc_c` and `r_itc_c` are the entry's own credit, as a statement's or a register's row.
    With `numbers` rows also carry both sides' invoice numbers as given, so that nobody need look them up again.
    """
    c = F.col
    gst = number("gstin").alias("gst")
    rows = entries.select("inv", gst, "stated", "itc_eligible", F.struct("row_no", gst, c("itc_c").alias("itc"), *(["invoice_no"] if numbers else [])).alias("own"))  # once in what is sorted
    same, of_number = Window.partitionBy("inv", "gst"), Window.partitionBy("inv")
    place = F.when(~c("stated"), c("own.row_no"))
    rows = rows.withColumns({"exact": F.max_by("own", place).over(same), "asked": F.max("stated").over(same)})
    rows = rows.withColumns({"loose": F.min_by("own", place).over(of_number), "missed": F.max(c("stated") & c("exact").isNull()).over(of_number)})
    used = (c("asked") & (c("own.row_no") == c("exact.row_no"))) | (c("missed") & (c("own.row_no") == c("loose.row_no")))
    rows = rows.withColumns({"hit": F.when(c("stated"), F.coalesce("exact", "loose")), "used": ~c("stated") & used})
    a, b = c("own.itc"), c("hit.itc")
    near = (F.abs(a - b) <= F.greatest(a, b) * 0.01) | (F.abs(a - b) <= 100)
    other = c("exact").isNull() & (c("hit.gst") != "") & (c("gst") != "") & (c("hit.gst") != c("gst"))
    status = (
        F.when(c("used"), None).when(~c("stated"), "In Purchase Register only").when(c("hit").isNull(), "In GSTR-2B only").when(other, "GSTIN Mismatch")
        .when(near, "Matched").otherwise("Amount Mismatch")
    )
    rows = rows.withColumn("status", status)
    is_ = lambda name: c("status") == name
    claim = F.when(is_("Matched"), a).when(is_("Amount Mismatch"), F.least(a, b)).when(is_("In GSTR-2B only") & c("itc_eligible"), a).otherwise(F.lit(0))
    diff = F.when(~c("stated"), -a).when(is_("Matched"), F.lit(0)).when(c("hit").isNull(), a).otherwise(a - b)
    named = [F.when(c("stated"), c("own.invoice_no")).alias("statement_no"), F.when(c("stated"), c("hit.invoice_no")).otherwise(c("own.invoice_no")).alias("register_no")] if numbers else []
    return rows.select(
        F.when(c("stated"), c("own.row_no")).alias("s_row"), F.when(c("stated"), c("hit.row_no")).otherwise(c("own.row_no")).alias("r_row"), "status", diff.alias("itc_diff_c"),
        claim.alias("claim_c"), F.when(c("stated"), a).alias("s_itc_c"), F.when(~c("stated"), a).alias("r_itc_c"), *named,
    )


def reconciled(entries: DataFrame, numbers: bool = False) -> DataFrame:
    """One row of each statement invoice, and one of each register row that no match used."""
    return settled(entries, numbers).where("status is not null").drop("r_itc_c")


def reconcile(statement: DataFrame, register: DataFrame, numbers: bool = False) -> DataFrame:
    """Statement invoices against the purchase register, see `entries` and `settled`."""
    return reconciled(entries(statement, register), numbers)


def credit_summary(recon: DataFrame) -> DataFrame:
    return recon.groupBy("status").agg(F.count(F.lit(1)).alias("invoices"), F.sum("claim_c").alias("claim_c"), F.sum(F.abs("itc_diff_c")).alias("diff_c"))


def credit_position(settled: DataFrame) -> DataFrame:
    """The settled entries in one row: credit on both sides, claimable and at risk, match rate, risk level.

    At risk are the differences of mismatched amounts, all credit of mismatched registrations, and what stands in the
    register only.
    """
    rows = settled.withColumnRenamed("s_itc_c", "s_itc")
    is_ = lambda name: F.col("status") == name
    total = lambda c, w: F.coalesce(F.sum(F.when(w, c)), F.lit(0))
    only = is_("In Purchase Register only")
    out = rows.agg(
        F.count("s_row").alias("statement_rows"), F.count_if(is_("Matched")).alias("matched"), F.count_if(is_("GSTIN Mismatch")).alias("gstin_mismatches"),
        total(F.col("s_itc"), F.col("s_row").isNotNull()).alias("statement_itc_c"), total(F.col("claim_c"), is_("Matched")).alias("matched_itc_c"),
        total(F.abs("itc_diff_c"), is_("Amount Mismatch")).alias("mismatch_loss_c"), total(F.col("s_itc"), is_("GSTIN Mismatch")).alias("blocked_c"),
        total(F.col("claim_c"), is_("In GSTR-2B only")).alias("only_statement_c"), total(-F.col("itc_diff_c"), only).alias("only_register_c"),
        F.coalesce(F.sum("r_itc_c"), F.lit(0)).alias("register_itc_c"),
    )
    out = out.withColumns({"claimable_c": F.col("matched_itc_c") + F.col("only_statement_c"), "at_risk_c": F.col("mismatch_loss_c") + F.col("blocked_c") + F.col("only_register_c")})
    level = F.when((F.col("at_risk_c") == 0) & (F.col("gstin_mismatches") == 0), "Low").when(F.col("at_risk_c") * 10 < F.col("statement_itc_c"), "Medium").otherwise("High")
    rate = F.round(F.col("matched") * 100.0 / F.greatest("statement_rows", F.lit(1)), 1)
    return out.withColumns({"match_rate": rate, "risk_level": level}).withColumn("filing_ready", F.col("risk_level") == "Low")


def monthly_return(sales_and_purchases: DataFrame, ledger: DataFrame) -> DataFrame:
    """The assembled return of each account: tax on sales, credit, what is payable, counts, bank totals and months.

    Rows have account_id, sold, bought, nature and the three heads; the ledger account_id, type, amount_c, date.
    """
    heads = ("igst", "cgst", "sgst")
    taxed = F.col("sold") & (F.col("nature") != "exempt")
    total = lambda c, w: F.coalesce(F.sum(F.when(w, F.col(c))), F.lit(0))
    sums = [total(f"{x}_c", taxed).alias(f"out_{x}_c") for x in heads] + [total(f"{x}_c", F.col("bought")).alias(f"itc_{x}_c") for x in heads]
    counts = [F.count_if("sold").alias("sales"), F.count_if("bought").alias("purchases")]
    net = set_off(sales_and_purchases.groupBy("account_id").agg(*sums, *counts))
    known = F.col("date").isNotNull()
    bank = ledger.groupBy("account_id", F.when(known, F.date_format("date", "yyyy-MM")).alias("month")).agg(total("amount_c", F.col("type") == "CR").alias("cr"), total("amount_c", F.col("type") == "DR").alias("dr"))
    bank = bank.groupBy("account_id").agg(F.sum("cr").alias("bank_cr_c"), F.sum("dr").alias("bank_dr_c"), F.array_join(F.sort_array(F.collect_set("month")), ",").alias("months"))
    out = net.join(bank, "account_id", "full")
    zero = [c for c in net.columns if c != "account_id"] + ["bank_cr_c", "bank_dr_c"]
    out = out.fillna(0, zero).fillna("", ["months"])
    output = F.col("out_igst_c") + F.col("out_cgst_c") + F.col("out_sgst_c")
    credit = F.col("itc_igst_c") + F.col("itc_cgst_c") + F.col("itc_sgst_c")
    return out.select("account_id", "sales", "purchases", output.alias("output_tax_c"), credit.alias("itc_c"), "net_payable_c", "bank_cr_c", "bank_dr_c", "months")
