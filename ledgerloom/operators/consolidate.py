"""Income, tax and worth of an account from several sources, with their order of preference."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
from ledgerloom.operators.engine import total


def bank(rows: DataFrame) -> DataFrame:
    """What the bank statement says, by the parser's categories."""
    cat, cr, dr = F.col("parser_category"), F.col("type") == "CR", F.col("type") == "DR"
    text = F.col("lowered")
    return rows.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("txns"),
        total(cr & (cat == "Salary")).alias("salary_c"),
        total(cr & (cat == "Interest")).alias("interest_c"),
        total(cr & cat.isin("Freelance Income", "Marketplace Income")).alias("business_c"),
        total(dr).alias("debits_c"),
        total(dr & (cat == "EMI/Loan Repayment")).alias("emi_c"),
        total(dr & cat.isin("Food", "Shopping", "Entertainment", "Travel", "Health", "Utilities")).alias("personal_c"),
        total(dr & cat.isin("UPI", "NEFT Sent", "Transfer")).alias("operating_c"),
        total(dr & R.contains_any(text, ["advance tax", "self assessment", "income tax", "tds"])).alias("advance_tax_c"),
        F.count_if(cr & (F.col("amount_c") >= 20_000_000)).alias("large_credits"),
        F.max_by("balance_c", "row_no").alias("closing_c"),
    )


def preferred(*sources: Column) -> Column:
    """The first source that is neither null nor zero, else zero."""
    return F.coalesce(*[F.nullif(s, F.lit(0)) for s in sources], F.lit(0))


def consolidate(statement: DataFrame, tax_form: DataFrame, information: DataFrame) -> DataFrame:
    """One row per account: `statement` from bank(), `tax_form` (declared_c, salary_tds_c, tds_c) and `information`
    (ais_salary_c, ais_interest_c, ais_dividend_c, ais_rent_c, ais_turnover_c, ais_invested_c), each optional per account."""
    j = statement.join(tax_form.withColumn("has_form", F.lit(True)), "account_id", "left").join(information.withColumn("has_ais", F.lit(True)), "account_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    j = j.withColumns(
        {
            "income_salary_c": preferred(F.col("ais_salary_c"), F.col("declared_c"), F.col("salary_c")),
            "income_interest_c": preferred(F.col("ais_interest_c"), F.col("interest_c")),
            "income_business_c": preferred(F.col("ais_turnover_c"), F.col("business_c")),
            "income_dividend_c": z("ais_dividend_c"),
            "income_rent_c": z("ais_rent_c"),
            "tax_credit_c": z("tds_c") + F.col("advance_tax_c"),
            "loans_c": F.col("emi_c") * 36,
        }
    )
    income = F.col("income_salary_c") + F.col("income_interest_c") + F.col("income_business_c") + F.col("income_dividend_c") + F.col("income_rent_c")
    form, ais = F.coalesce("has_form", F.lit(False)), F.coalesce("has_ais", F.lit(False))
    issues = [
        (form & (z("salary_tds_c") > 0) & (F.col("salary_c") == 0), "salary_not_in_bank"),
        (ais & (z("ais_interest_c") > 0) & (F.col("interest_c") == 0), "interest_not_in_bank"),
        (~ais & (F.col("large_credits") > 0), "high_value_no_ais"),
        (ais & (z("ais_turnover_c") > 0) & (F.abs(z("ais_turnover_c") - F.col("business_c")) > 5_000_000), "gst_mismatch"),
    ]
    gaps = [
        ((z("declared_c") > 0) & (F.col("salary_c") > 0) & (F.abs(z("declared_c") - F.col("salary_c")) > 100_000), "salary_mismatch"),
        ((z("ais_interest_c") > 0) & (F.col("interest_c") > 0) & (F.abs(z("ais_interest_c") - F.col("interest_c")) > 50_000), "interest_mismatch"),
    ]
    listed = lambda found: F.array_join(F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in found])), ",")
    severe = issues[2][0] | issues[3][0]
    reported = ais & ((z("ais_salary_c") + z("ais_interest_c") + z("ais_dividend_c") + z("ais_rent_c")) > 0)
    ready = F.when(~form & ~reported, "incomplete").when(severe, "review_needed").when(form, "ready").otherwise("partial")
    worth = F.coalesce("closing_c", F.lit(0)) + z("ais_invested_c") - F.col("loans_c")
    return j.select(
        "account_id", "income_salary_c", "income_interest_c", "income_business_c", income.alias("income_c"), "tax_credit_c",
        F.greatest(F.lit(0), F.col("income_business_c") - F.col("operating_c")).alias("net_profit_c"), (income - F.col("debits_c")).alias("surplus_c"),
        worth.alias("net_worth_c"), listed(gaps).alias("gaps"), listed(issues).alias("discrepancies"), ready.alias("filing_readiness"),
    )
