"""Invoice spreadsheets: column roles from their headers, and cells as amounts in paise."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import parse_amount_c, parse_date

# Words of each role, those of specific roles first, so that "invoice date" is a date and no number.
ROLES = {
    "igst": ["igst", "integrated"],
    "cgst": ["cgst", "central"],
    "sgst": ["sgst", "utgst", "state_tax"],
    "gstin": ["gstin", "gst_no", "gst_number"],
    "date": ["date"],
    "taxable": ["taxable", "basic_amount", "net_amount"],
    "total": ["total", "invoice_value", "gross", "bill_amount", "invoice_amount"],
    "party": ["customer", "party", "supplier", "buyer", "vendor", "name"],
    "eligible": ["eligible", "eligibility"],
    "description": ["description", "particular", "item", "hsn"],
    "invoice_no": ["invoice", "inv_no", "bill_no", "voucher", "document"],
}


def roles(columns: list[str]) -> dict[str, str]:
    """The column of each role: the first column, left to right, that the role's words fit and no role has taken."""
    plain = {c: re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in columns}
    found: dict[str, str] = {}
    for role, words in ROLES.items():
        for c in columns:
            if c not in found.values() and any(w in plain[c] for w in words):
                found[role] = c
                break
    return found


def cleaned(sheet: DataFrame) -> DataFrame:
    """Invoices in the model's columns: blanks are 0 or empty, a missing total is the sum, a missing value total / 1.18."""
    at = roles(sheet.columns)
    text = lambda r: F.trim(F.coalesce(F.col(f"`{at[r]}`").cast("string"), F.lit(""))) if r in at else F.lit("")
    known = lambda r: F.when(F.lower(text(r)).isin("nan", "none"), "").otherwise(text(r))
    money = lambda r: parse_amount_c(known(r))
    rows = sheet.select(
        known("invoice_no").alias("invoice_no"), parse_date(known("date")).alias("date"), F.when(known("party") == "", "Unknown").otherwise(known("party")).alias("party"),
        F.upper(known("gstin")).alias("gstin_raw"), money("taxable").alias("given_c"), money("cgst").alias("cgst_c"), money("sgst").alias("sgst_c"), money("igst").alias("igst_c"), money("total").alias("said_c"),
        (~F.lower(known("eligible")).isin("no", "ineligible", "blocked", "0", "false")).alias("itc_eligible"),
    )
    total = F.when(F.col("said_c") == 0, F.col("given_c") + F.col("cgst_c") + F.col("sgst_c") + F.col("igst_c")).otherwise(F.col("said_c"))
    rows = rows.withColumn("total_c", total)
    estimate = F.floor(F.col("total_c") / F.lit(1.18) + F.lit(0.5)).cast("long")
    return rows.withColumn("taxable_c", F.when((F.col("given_c") == 0) & (F.col("total_c") > 0), estimate).otherwise(F.col("given_c"))).drop("given_c", "said_c")
