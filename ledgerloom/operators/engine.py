"""Per-account key figures: income, obligations, eligibility, stability, risk flags and health. Money in paise."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions import rules as R
CLASSES = [
    "salary", "business", "interest", "dividend", "rental", "loan_disbursal", "family_transfer", "self_transfer", "refund", "reimbursement",
    "non_income", "cash_deposit", "needs_verification",
]


def nearest(x: Column) -> Column:
    """The nearest whole number, halves up."""
    return F.floor(x + F.lit(0.5)).cast("long")


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def total(condition: Column) -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col("amount_c"))), F.lit(0))


#: Sums and extremes that go from days to months to accounts unchanged.
SUMS = ["txns", "flows", "cr_c", "dr_c", "real_c", "loans", "family_transfers", "emi_c", "bounces", "balance_sum_c", "balances", *[f"{c}_c" for c in CLASSES]]


def days(rows: DataFrame) -> DataFrame:
    """Per account, month and day: counts, sums by class and direction, lowest, highest and last known balance."""
    klass = lambda name: F.col("credit_class") == name
    dated = F.col("balance_c").isNotNull() & F.col("date").isNotNull()
    return rows.groupBy("account_id", "month", "date").agg(
        F.count(F.lit(1)).alias("txns"),
        F.count("flow").alias("flows"),
        total(F.col("flow") == "CR").alias("cr_c"),
        total(F.col("flow") == "DR").alias("dr_c"),
        total(F.col("credit_class").isin(R.TAXABLE)).alias("real_c"),
        F.count_if(klass("loan_disbursal")).alias("loans"),
        F.count_if(klass("family_transfer")).alias("family_transfers"),
        total((F.col("flow") == "DR") & F.col("is_emi")).alias("emi_c"),
        F.count_if((F.col("flow") == "DR") & F.col("is_bounce")).alias("bounces"),
        F.coalesce(F.sum("balance_c"), F.lit(0)).alias("balance_sum_c"),
        F.count("balance_c").alias("balances"),
        *[total(klass(c)).alias(f"{c}_c") for c in CLASSES],
        F.min("balance_c").alias("min_balance_c"),
        F.max("balance_c").alias("max_balance_c"),
        F.max_by("balance_c", F.when(dated, F.col("row_no"))).alias("eod_c"),
    )


def months(rows: DataFrame) -> DataFrame:
    """The same per account and month, and of its days: the last balance, the sum of last balances, negative days."""
    return months_of(days(rows))


def months_of(days: DataFrame) -> DataFrame:
    known = F.col("eod_c").isNotNull()
    return days.groupBy("account_id", "month").agg(
        *[F.sum(c).alias(c) for c in SUMS],
        F.min("min_balance_c").alias("min_balance_c"),
        F.max("max_balance_c").alias("max_balance_c"),
        F.max_by("eod_c", F.when(known, F.col("date"))).alias("month_end_c"),
        F.sum("eod_c").alias("eod_sum_c"),
        F.count("eod_c").alias("days"),
        F.count_if(F.col("eod_c") < 0).alias("negative_days"),
    )


def stability(n: Column, s: Column, top: Column, squares: Column, poor: Column) -> tuple[Column, Column]:
    """Coefficient of variation of monthly income without an outlying best month, plus 15 for each poor month; its label."""
    rest = ratio(s - top, n - 1)
    trim = (n > 3) & (rest > 0) & (top > rest * 1.5)
    k = F.when(trim, n - 1).otherwise(n)
    sum_ = F.when(trim, s - top).otherwise(s).cast("double")
    sq = F.when(trim, squares - top.cast("double") * top.cast("double")).otherwise(squares)
    mean = sum_ / k
    spread = F.sqrt(F.greatest(sq / k - mean * mean, F.lit(0.0)))
    cv = F.round(spread / mean * 100, 1)
    cv = F.when(s <= 0, F.lit(100.0)).otherwise(F.least(cv + poor * 15, F.lit(100.0)))
    label = F.when(s <= 0, "Volatile").when(cv < 25, "Stable").when(cv < 50, "Moderately Stable").otherwise("Volatile")
    return cv, label


def engine(rows: DataFrame) -> DataFrame:
    """One row per account. `rows` are enriched; days are pre-aggregated before any shuffle, so that a busy account spreads; months and accounts are grouped from days."""
    return figures(months(rows))


def figures(by_month: DataFrame) -> DataFrame:
    """The same from an account's months."""
    live = F.col("flows") > 0
    e = by_month.groupBy("account_id").agg(
        *[F.sum(c).alias(c) for c in SUMS if c not in ("cr_c", "dr_c", "real_c")],
        F.min("min_balance_c").alias("min_balance_c"),
        F.max("max_balance_c").alias("max_balance_c"),
        F.count_if(live).alias("n_months"),
        F.sum("cr_c").alias("total_cr_c"),
        F.sum("dr_c").alias("total_dr_c"),
        F.sum("real_c").alias("real_c"),
        F.max(F.when(live, F.col("real_c"))).alias("top_real_c"),
        F.sum(F.when(live, F.col("real_c").cast("double") * F.col("real_c").cast("double"))).alias("real_squares"),
        F.collect_list(F.when(live, F.col("real_c"))).alias("reals"),
        F.collect_list(F.when(F.col("dr_c") > 0, F.col("dr_c"))).alias("drs"),
        F.count_if(F.col("min_balance_c") < 0).alias("negative_months"),
        F.sum("negative_days").alias("negative_days"),
        F.sum("days").alias("days_tracked"),
    )
    e = e.where("n_months > 0")

    n = F.col("n_months")
    e = e.withColumns(
        {
            "avg_real_c": nearest(ratio(F.col("real_c"), n)),
            "avg_credit_c": nearest(ratio(F.col("total_cr_c"), n)),
            "avg_debit_c": nearest(ratio(F.col("total_dr_c"), n)),
            "monthly_emi_c": nearest(ratio(F.col("emi_c"), n)),
            "avg_balance_c": nearest(ratio(F.col("balance_sum_c"), F.col("balances"))),
            "poor_months": F.size(F.filter("reals", lambda v: v <= F.col("real_c") / F.col("n_months") * 0.1)),
            "spikes": F.when(F.size("drs") >= 3, F.size(F.filter("drs", lambda v: v > F.aggregate("drs", F.lit(0).cast("long"), lambda a, x: a + x) / F.size("drs") * 2.5))).otherwise(0),
        }
    )
    e = e.withColumn("base_c", F.when(F.col("avg_real_c") > 1000, F.col("avg_real_c")).otherwise(F.col("avg_credit_c")))
    e = e.withColumn("foir", nearest(ratio(F.col("monthly_emi_c"), F.col("base_c")) * 1000) / F.lit(10.0))
    e = e.withColumn("remaining_emi_c", F.greatest(F.lit(0), nearest(F.col("base_c") * R.FOIR_CAP / 100) - F.col("monthly_emi_c")))
    monthly_rate = R.INTEREST_RATE / 12
    annuity = (1 - (1 + monthly_rate) ** -R.TENURE_MONTHS) / monthly_rate
    cv, label = stability(n, F.col("real_c"), F.col("top_real_c"), F.col("real_squares"), F.col("poor_months"))
    against = F.when(F.col("real_c") > 0, F.col("real_c")).otherwise(F.col("total_cr_c"))
    e = e.withColumns(
        {
            "foir_status": F.when(F.col("foir") <= 35, "Healthy").when(F.col("foir") <= 50, "Moderate").otherwise("High Risk"),
            "loan_eligible_c": nearest(F.col("remaining_emi_c") * F.lit(annuity)),
            "stability_cv": cv,
            "income_stability": label,
            "loan_dep_pct": ratio(F.col("loan_disbursal_c"), against) * 100,
            "variable_c": F.greatest(F.lit(0), F.col("avg_debit_c") - F.col("monthly_emi_c")),
        }
    )
    dep = F.col("loan_dep_pct")
    good = F.col("avg_balance_c") >= F.col("base_c") * 0.5
    e = e.withColumns(
        {
            "loan_dependency": F.when((dep < 20) & (F.col("loans") <= 1), "Low").when((dep >= 50) | (F.col("loans") >= 5), "High").otherwise("Medium"),
            "credit_indicator": F.when((F.col("negative_months") == 0) & (F.col("foir") <= 35) & good, "Strong")
            .when((F.col("negative_months") <= 2) & (F.col("foir") <= 50), "Moderate")
            .otherwise("Needs Improvement"),
            "disposable_c": F.col("base_c") - F.col("monthly_emi_c") - F.col("variable_c"),
        }
    )
    e = e.withColumn("savings_rate", ratio(F.col("disposable_c"), F.col("base_c")) * 100)
    family = ratio(F.col("family_transfer_c"), F.col("total_cr_c")) * 100
    unverified = ratio(F.col("needs_verification_c"), F.col("total_cr_c")) * 100
    # Bounds, names and points of the risk flags.
    flags = [
        (F.col("loans") >= 3, "FREQUENT_LOAN_DISBURSALS", 20),
        ((family > 15) | (F.col("family_transfers") >= 4), "HIGH_FAMILY_TRANSFERS", 10),
        (F.col("cash_deposit_c") >= 20_000_000, "HEAVY_CASH_DEPOSITS", 10),
        ((F.col("base_c") > 0) & (F.col("avg_balance_c") < F.col("base_c") * 0.2), "LOW_AVERAGE_BALANCE", 20),
        (F.col("bounces") >= 1, "CHEQUE_BOUNCES", 20),
        (F.col("negative_days") >= 1, "NEGATIVE_BALANCE_DAYS", 20),
        (F.col("spikes") > 0, "SPENDING_SPIKE", 10),
        (unverified > 30, "LARGE_UNVERIFIED_CREDITS", 10),
    ]
    points = sum((F.when(c, F.lit(p)).otherwise(F.lit(0)) for c, _, p in flags), F.lit(0))
    e = e.withColumns({"risk_flags": F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k, _ in flags])), "risk_score": F.least(F.lit(100), points)})
    e = e.withColumn("risk_level", F.when(F.col("risk_score") >= 50, "High").when(F.col("risk_score") >= 20, "Medium").otherwise("Low"))
    # 20 points are a high severity, 10 a medium one
    named = F.array(*[F.when(c, F.struct(F.lit(k).alias("flag"), F.lit({20: "High", 10: "Medium"}[p]).alias("severity"))) for c, k, p in flags])
    e = e.withColumns({"severities": F.array_compact(named), "health_score": health(e)})
    score = F.col("health_score")
    return e.withColumn("health_grade", F.when(score >= 80, "Excellent").when(score >= 65, "Good").when(score >= 45, "Average").otherwise("Poor"))


def steps(value: Column, table: list[tuple[float, int]]) -> Column:
    """The points of the first bound that the value doesn't exceed."""
    out = F.when(value <= table[0][0], F.lit(table[0][1]))
    for bound, points in table[1:-1]:
        out = out.when(value <= bound, F.lit(points))
    return out.otherwise(F.lit(table[-1][1]))


def health(e: DataFrame) -> Column:
    income = F.when(F.col("avg_real_c") != 0, F.col("avg_real_c").cast("double")).otherwise(F.lit(100.0))
    cover = F.col("avg_balance_c") / income
    # Bounds and penalty points of the health score.
    penalty = (
        F.when(F.col("income_stability") == "Stable", 0).when(F.col("income_stability") == "Moderately Stable", 10).otherwise(25)
        + F.when(cover >= 1.0, 0).when(cover >= 0.5, 5).when(cover >= 0.2, 12).otherwise(20)
        + steps(F.col("negative_days"), [(0, 0), (2, 7), (5, 11), (999, 15)])
        + steps(F.col("foir"), [(35, 0), (40, 6), (50, 11), (60, 16), (999, 20)])
        + F.when(F.col("loan_dependency") == "Low", 0).when(F.col("loan_dependency") == "Medium", 6).otherwise(12)
        + steps(F.col("bounces"), [(0, 0), (1, 4), (3, 6), (999, 8)])
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), 100 - penalty))
