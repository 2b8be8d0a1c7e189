"""Report frames over the enriched ledger: long tables per account, ready to write or to nest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ledgerloom.functions import classify
from ledgerloom.functions import rules as R
from ledgerloom.operators import joins
from ledgerloom.operators.balances import audit_mismatches, end_of_day
from ledgerloom.operators.engine import CLASSES, engine, months, nearest, ratio, total


def top(rows: DataFrame, k: int, by: str, name: str) -> DataFrame:
    """The k largest of each account, ties by name."""
    order = Window.partitionBy("account_id").orderBy(F.desc(by), name)
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def month_ends(rows: DataFrame) -> DataFrame:
    """Last balance, sum and number of last balances of the days, per month."""
    daily = end_of_day(rows).withColumn("month", F.date_format("date", "yyyy-MM"))
    return daily.groupBy("account_id", "month").agg(
        F.max_by("eod_c", "date").alias("month_end_c"), F.sum("eod_c").alias("eod_sum_c"), F.count(F.lit(1)).alias("days")
    )


def monthly_summary(rows: DataFrame) -> DataFrame:
    """Income, expenses, savings and closing balance of every month with a credit or debit: one pass over the ledger."""
    saved = F.col("real_c") - F.col("dr_c")
    return months(rows).where("flows > 0").select(
        "account_id", "month", F.col("real_c").alias("income_c"), F.col("dr_c").alias("expenses_c"), saved.alias("savings_c"),
        F.coalesce("month_end_c", F.lit(0)).alias("closing_c"), (saved >= 0).alias("surplus"),
    )


def income_sources(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k largest senders of each account's credits."""
    sender = F.col("employer")
    word = F.get(F.filter(F.split(F.lower("desc"), r"\s+"), lambda w: (F.length(w) > 2) & ~w.rlike(r"^\d+$")), F.lit(0))
    credits = rows.where((F.col("type") == "CR") & (F.col("amount_c") != 0))
    named = credits.withColumn("sender", F.when(sender != "", sender).otherwise(F.coalesce(word, F.lit("unknown"))))
    out = named.groupBy("account_id", "sender").agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("credits"))
    return top(out, k, "total_c", "sender")


def salary_employers(rows: DataFrame) -> DataFrame:
    """Who pays each account's salaries: amount and number of credits of every employer that a narration names."""
    paid = rows.where((F.col("type") == "CR") & (F.col("credit_class") == "salary") & (F.col("employer") != ""))
    return paid.groupBy("account_id", "employer").agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("credits"))


def income_report(rows: DataFrame) -> DataFrame:
    """Income by class, employers, cash deposits and tax on sales of every account; an account without credits has zeros.

    Rows are summed per account, class and employer before the shuffle, and accounts are grouped from these sums.
    """
    named = F.when((F.col("type") == "CR") & (F.col("credit_class") == "salary"), F.nullif("employer", F.lit("")))
    large = (F.col("credit_class") == "cash_deposit") & (F.col("amount_c") >= R.HIGH_VALUE * 100)
    parts = rows.groupBy("account_id", "credit_class", named.alias("employer")).agg(
        F.sum("amount_c").alias("part_c"), F.count(F.lit(1)).alias("credits"), F.count_if(large).alias("large")
    )
    of = lambda c, k: F.coalesce(F.sum(F.when(F.col("credit_class") == k, F.col(c))), F.lit(0))
    out = parts.groupBy("account_id").agg(
        *[of("part_c", k).alias(f"{k}_c") for k in (*R.TAXABLE, "cash_deposit")],
        *[of("credits", k).alias(f"{k}_credits") for k in ("salary", "business", "cash_deposit")],
        F.count("employer").alias("employers"),
        F.sum("large").alias("large_cash_deposits"),
    )
    return out.withColumns(
        {
            "much_cash": F.col("cash_deposit_c") >= R.ANNUAL_CASH * 100,
            "gst_estimate_c": nearest(F.col("business_c") * F.lit(R.GST_RATE)),
            "gst_threshold_crossed": F.col("business_c") >= R.GST_THRESHOLD * 100,
        }
    )


def spending(rows: DataFrame) -> DataFrame:
    """Debits that are expenses, with their category and merchant; sources of loans never are."""
    debits = rows.where((F.col("type") == "DR") & (F.col("amount_c") != 0) & ~F.col("is_loan"))
    return debits.withColumn("category", classify.spend_category(F.col("narrated_category"), F.col("parser_category")))


def category_totals(rows: DataFrame) -> DataFrame:
    return spending(rows).groupBy("account_id", "category").agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("debits"))


def top_merchants(rows: DataFrame, k: int = 15) -> DataFrame:
    out = spending(rows).where("merchant not in ('unknown', 'other')").groupBy("account_id", "merchant")
    return top(out.agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("debits")), k, "total_c", "merchant")


def cash_flow(rows: DataFrame) -> DataFrame:
    """Average balances over the last 3, 6 and 12 months and all, months in surplus, net flow, and the trend of month ends."""
    m = rows.groupBy("account_id", "month").agg(
        total(F.col("type") == "CR").alias("cr_c"),
        F.sum(F.when(F.coalesce(F.col("type") != "CR", F.lit(True)), F.col("amount_c")).otherwise(0)).alias("dr_c"),
        F.sum("balance_c").alias("sum_c"),
        F.count("balance_c").alias("n"),
        F.max_by("balance_c", F.when(F.col("balance_c").isNotNull(), F.struct("date", "row_no"))).alias("eom_c"),
    )
    back = Window.partitionBy("account_id").orderBy(F.desc("month"))
    on = Window.partitionBy("account_id").orderBy("month")
    whole = Window.partitionBy("account_id")
    known = F.col("eom_c").isNotNull()
    m = m.withColumns({"recent": F.row_number().over(back), "at": F.sum(known.cast("int")).over(on), "ends": F.sum(known.cast("int")).over(whole), "mean_cr": F.avg("cr_c").over(whole)})
    early = known & (F.col("at") <= F.floor(F.col("ends") / 2))
    late = known & (F.col("at") > F.floor(F.col("ends") / 2))
    over = lambda k: ratio(F.sum(F.when(F.col("recent") <= k, F.col("sum_c"))), F.sum(F.when(F.col("recent") <= k, F.col("n"))))
    mean = lambda c: ratio(F.sum(F.when(c, F.col("eom_c"))), F.count_if(c))
    out = m.groupBy("account_id").agg(
        over(3).alias("abb_3m"), over(6).alias("abb_6m"), over(12).alias("abb_12m"), ratio(F.sum("sum_c"), F.sum("n")).alias("abb_overall"),
        F.count_if(F.col("cr_c") >= F.col("dr_c")).alias("surplus_months"), F.count_if(F.col("cr_c") < F.col("dr_c")).alias("deficit_months"),
        ratio(F.sum(F.col("cr_c") - F.col("dr_c")), F.count(F.lit(1))).alias("avg_net"),
        F.count_if(F.col("cr_c") > F.col("mean_cr") * 1.25).alias("high_months"),
        F.count_if((F.col("cr_c") > 0) & (F.col("cr_c") < F.col("mean_cr") * 0.75)).alias("low_months"),
        F.max("ends").alias("ends"), mean(early).alias("early"), mean(late).alias("late"),
    )
    trend = (
        F.when(F.col("ends") < 2, "Insufficient data")
        .when(F.col("ends") < 4, "Stable")
        .when(F.col("late") > F.col("early") * 1.1, "Improving")
        .when(F.col("late") < F.col("early") * 0.9, "Declining")
        .otherwise("Stable")
    )
    return out.withColumn("trend", trend).drop("ends", "early", "late")


def compliance(rows: DataFrame) -> DataFrame:
    """High values, cash, days of much cash, a year's cash, days of large credits and amounts just below a threshold."""
    c = 100
    high, near = F.col("amount_c") >= R.HIGH_VALUE * c, F.col("amount_c").between(R.STRUCTURING[0] * c, R.STRUCTURING[1] * c - 1)
    counts = rows.groupBy("account_id").agg(F.count_if(high).alias("high_value"), F.count_if("is_cash").alias("cash"), F.count_if(near).alias("structured"))
    deposit = F.col("is_cash") & (F.col("is_cdm") | (F.col("type") == "CR"))
    days = rows.groupBy("account_id", "date").agg(total(deposit).alias("cash_c"), total(F.col("type") == "CR").alias("cr_c"))
    per = days.groupBy("account_id").agg(
        F.count_if(F.col("cash_c") > R.DAILY_CASH * c).alias("daily_breaches"), F.sum("cash_c").alias("annual_cash_c"), F.count_if(F.col("cr_c") >= R.STR_DAY * c).alias("str_days")
    )
    return counts.join(per, "account_id").withColumn("form_61a", F.col("annual_cash_c") >= R.ANNUAL_CASH * c)


def tax_return(rows: DataFrame) -> DataFrame:
    """Deductions with their caps, large credits, tax paid, and the form that the income asks for."""
    text, debit = F.col("lowered"), (F.col("type") == "DR") & (F.col("amount_c") > 0)
    s80c = R.mentions(text, R.S80C) & ~R.mentions(text, R.S80C_EXCLUDED)
    s80d = R.mentions(text, R.S80D)
    out = rows.groupBy("account_id").agg(
        F.least(total(debit & s80c), F.lit(R.CAP_80C * 100)).alias("s80c_c"),
        F.least(total(debit & ~s80c & s80d), F.lit(R.CAP_80D * 100)).alias("s80d_c"),
        total(debit & ~s80c & ~s80d & R.mentions(text, R.TDS)).alias("tds_c"),
        F.count_if((F.col("type") == "CR") & (F.col("amount_c") >= 10_000_000)).alias("large_credits"),
        total(F.col("credit_class") == "business").alias("business_c"),
        total(F.col("credit_class") == "rental").alias("rental_c"),
        total(F.col("credit_class") == "salary").alias("salary_c"),
    )
    form = F.when(F.col("business_c") > 0, "ITR-3").when(F.col("rental_c") > 0, "ITR-2").when(F.col("salary_c") > 0, "ITR-1").otherwise("verify")
    return out.withColumn("form", form)


def obligations(rows: DataFrame) -> DataFrame:
    """Loan instalments, card payments and returned payments of each account."""
    text, debit = F.col("lowered"), (F.col("type") == "DR") & (F.col("amount_c") != 0)
    returned = R.contains_any(text, ["ecs", "nach", "mandate", "si "])
    card = debit & R.mentions(text, R.CARD_PAYMENT)
    return rows.groupBy("account_id").agg(
        F.count_if(debit & F.col("is_emi")).alias("emis"), total(debit & F.col("is_emi")).alias("emi_c"),
        F.count_if(F.col("is_bounce") & ~returned).alias("bounces"), F.count_if(F.col("is_bounce") & returned).alias("ecs_returns"),
        F.count_if(card).alias("card_payments"), total(card).alias("card_c"),
    )


def emi_months(rows: DataFrame) -> DataFrame:
    debit = (F.col("type") == "DR") & (F.col("amount_c") != 0)
    card = R.mentions(F.col("lowered"), R.CARD_PAYMENT)
    out = rows.where(debit).groupBy("account_id", "month").agg(total(F.col("is_emi")).alias("emi_c"), F.count_if(card).alias("cards"))
    pattern = F.when(F.col("cards") > 1, "Multiple").when(F.col("cards") == 1, "Single")
    return out.where((F.col("emi_c") > 0) | (F.col("cards") > 0)).withColumn("card_pattern", pattern)


def lenders(rows: DataFrame, k: int = 8) -> DataFrame:
    """The k lenders that each account's instalments go to most, named by the first keyword that fits."""
    named = R.first_match([(R.mentions(F.col("lowered"), [word]), word) for word in R.EMI if len(word) > 4], F.lit(None).cast("string"))
    debits = rows.where((F.col("type") == "DR") & (F.col("amount_c") != 0) & F.col("is_emi")).withColumn("lender", named).where("lender is not null")
    return top(debits.groupBy("account_id", "lender").agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("debits")), k, "total_c", "lender")


def destinations(rows: DataFrame, k: int = 10) -> DataFrame:
    """The k counterparties that most of each account's debits go to, without cash and own accounts."""
    debits = rows.where((F.col("type") == "DR") & (F.col("amount_c") != 0) & ~R.contains_any(F.col("lowered"), ["atm", "cash", "self", "own account"]))
    out = debits.withColumn("destination", F.col("merchant")).groupBy("account_id", "destination")
    return top(out.agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("debits")), k, "total_c", "destination")


def audit_scores(rows: DataFrame) -> DataFrame:
    """Balance mismatches, bounces and duplicates of each account, the score they leave of 100, and instalments as a share of credits."""
    emi = (F.col("type") == "DR") & F.col("is_emi")
    out = rows.groupBy("account_id").agg(
        F.count_if((F.col("flow") == "DR") & F.col("is_bounce")).alias("bounces"), F.count_if(emi).alias("emis"), total(emi).alias("emi_c"), total(F.col("flow") == "CR").alias("total_cr_c")
    )
    for found, name in ((audit_mismatches(rows), "mismatches"), (joins.duplicate_suspects(rows), "duplicates")):
        out = out.join(found.groupBy("account_id").agg(F.count(F.lit(1)).alias(name)), "account_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    lost = F.least(F.col("mismatches") * 5, F.lit(30)) + F.least(F.col("bounces") * 10, F.lit(30)) + F.least(F.col("duplicates") * 3, F.lit(15))
    share = F.when(F.col("total_cr_c") > 0, F.bround(F.col("emi_c") * 100.0 / F.col("total_cr_c"), 1)).otherwise(0.0)
    return out.withColumns({"emi_to_income": share, "reconciliation_score": F.greatest(F.lit(100) - lost, F.lit(0))})


def supplies(rows: DataFrame) -> DataFrame:
    """Monthly outward supplies estimated from credits: nil, export, to businesses, to consumers."""
    text = F.col("lowered")
    kind = (
        F.when(R.mentions(text, R.INTEREST), "nil")
        .when(R.mentions(text, R.FOREIGN), "export")
        .when(R.mentions(text, R.B2B_SELLERS) | R.mentions(text, R.B2B_GATEWAYS), "b2b")
        .when(F.col("amount_c") >= 10_000, "b2c")
    )
    sold = rows.where((F.col("type") == "CR") & F.col("credit_class").isin(["business", "dividend", "interest", "rental"]) & ~R.mentions(text, R.SALARY))
    return sold.withColumn("kind", kind).where("kind is not null").groupBy("account_id", "month", "kind").agg(F.sum("amount_c").alias("total_c"), F.count(F.lit(1)).alias("credits"))


def modes(rows: DataFrame) -> DataFrame:
    out = rows.groupBy("account_id", "mode").agg(
        F.count(F.lit(1)).alias("txns"), total(F.col("type") == "CR").alias("cr_c"), F.sum(F.when(F.col("type") == "CR", 0).otherwise(F.col("amount_c"))).alias("dr_c")
    )
    return out.withColumn("share", F.col("txns") * F.lit(100.0) / F.sum("txns").over(Window.partitionBy("account_id")))


def red_flags(rows: DataFrame) -> DataFrame:
    text = F.col("lowered")
    game, late = R.mentions(text, R.GAMBLING), R.mentions(text, R.PENALTY)
    return rows.groupBy("account_id").agg(F.count_if(game).alias("gambling"), total(game).alias("gambling_c"), F.count_if(late).alias("penalties"), total(late).alias("penalty_c"))


def flag_scores(rows: DataFrame) -> DataFrame:
    """The red flags with circular flows, and their score: 15 points per circular flow, 10 per gambling row, 5 per penalty, 100 at most."""
    out = red_flags(rows).join(joins.circular_counts(rows), "account_id", "left").withColumn("circular", F.coalesce("circular", F.lit(0)))
    return out.withColumn("flag_score", F.least(F.col("circular") * 15 + F.col("gambling") * 10 + F.col("penalties") * 5, F.lit(100)))


def search(rows: DataFrame, word: str) -> DataFrame:
    """Rows whose narration, date, parser's category, amount or balance holds the word."""
    word = word.lower()
    held = [F.lower(F.col("desc")), F.col("date").cast("string"), F.format_string("%.2f", F.col("amount_c") / 100), F.format_string("%.2f", F.col("balance_c") / 100)]
    if "parser_category" in rows.columns:
        held.append(F.lower("parser_category"))
    hit: Column = F.lit(False)
    for column in held:
        hit = hit | F.coalesce(column.contains(word), F.lit(False))
    return rows.where(hit)


def search_totals(found: DataFrame, size: int = 100) -> DataFrame:
    """Of found rows, in one row: how many, how many with an amount, debits, credits (whatever isn't a debit), and pages of `size`."""
    live = F.col("amount_c") != 0
    debit = F.coalesce(F.col("type") == "DR", F.lit(False))
    out = found.agg(F.count(F.lit(1)).alias("found"), F.count_if(live).alias("amounts"), total(live & debit).alias("debit_c"), total(live & ~debit).alias("credit_c"))
    pages = F.greatest(F.lit(1), F.ceil(F.col("found") / F.lit(size)).cast("int"))
    return out.withColumns({"total_c": F.col("debit_c") + F.col("credit_c"), "pages": pages})


def search_page(found: DataFrame, page: int, size: int = 100) -> DataFrame:
    """One page of found rows, in the ledger's order; a number beyond the pages means the nearest one."""
    last = max(1, -(-found.count() // size))
    page = max(1, min(page, last))
    return found.orderBy("account_id", "row_no").offset((page - 1) * size).limit(size)


def first_rows(rows: DataFrame, condition: Column, k: int) -> DataFrame:
    """The first k rows of each account that meet the condition, in the ledger's order."""
    order = Window.partitionBy("account_id").orderBy("row_no")
    return rows.where(condition).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def ranked(frame: DataFrame, by: Column, name: str) -> DataFrame:
    """A report's rows numbered within each account, largest first, ties by name."""
    order = Window.partitionBy("account_id").orderBy(by.desc(), F.col(name))
    return frame.withColumn("rank", F.row_number().over(order))


def negative_days(rows: DataFrame) -> DataFrame:
    """The days of each account that ended below zero."""
    return end_of_day(rows).where("eod_c < 0")


def narratives(engine_rows: DataFrame, cash: DataFrame) -> DataFrame:
    """A sentence on each account's compliance risk, from the engine's level, score and reasons, and a year's cash."""
    rows = engine_rows.join(cash, "account_id")
    reasons = lambda k: F.array_join(F.slice("risk_flags", 1, k), "; ")
    score = F.concat(F.lit("("), F.col("risk_score").cast("string"), F.lit("/100)"))
    rupees = F.format_number(F.bround(F.col("annual_cash_c") / 100, 0), 0)
    # The three sentences.
    said = (
        F.when(F.col("risk_level") == "Low", F.concat(F.lit("LOW compliance risk "), score, F.lit(". No major triggers. Cash total Rs"), rupees, F.lit(" within Rs10L limit.")))
        .when(F.col("risk_level") == "Medium", F.concat(F.lit("MEDIUM compliance risk "), score, F.lit(". Triggers: "), reasons(2), F.lit(". Enhanced due diligence recommended.")))
        .otherwise(F.concat(F.lit("HIGH compliance risk "), score, F.lit(". Triggers: "), reasons(3), F.lit(". Immediate review required before sanction.")))
    )
    return rows.select("account_id", said.alias("narrative"))


def dashboard(rows: DataFrame) -> dict[str, DataFrame]:
    """Every report of a ledger by name, each with one schema whatever the rows; an empty ledger gives empty frames."""
    e = engine(rows)
    return {
        "engine": e, "monthly_summary": monthly_summary(rows), "income": income_sources(rows), "expense": category_totals(rows), "merchants": top_merchants(rows),
        "cashflow": cash_flow(rows), "compliance": compliance(rows), "itr": tax_return(rows), "obligations": obligations(rows), "emi_months": emi_months(rows), "lenders": lenders(rows),
        "destinations": destinations(rows), "audit": audit_scores(rows), "gstr1": supplies(rows), "payment_modes": modes(rows), "red_flags": flag_scores(rows), "balance_kpis": month_ends(rows),
        "negative_days": negative_days(rows),
    }


def totals(rows: DataFrame) -> DataFrame:
    """The dashboard's head in one row, zeros for an empty ledger."""
    return rows.agg(
        F.count(F.lit(1)).alias("txns"), F.count_distinct("account_id").alias("accounts"), total(F.col("flow") == "CR").alias("cr_c"), total(F.col("flow") == "DR").alias("dr_c"),
        total(F.col("credit_class").isin(R.TAXABLE)).alias("real_c"), total(F.col("credit_class") == "loan_disbursal").alias("loans_c"), total(F.col("credit_class") == "family_transfer").alias("family_c"),
    )


def income_breakdown(rows: DataFrame) -> DataFrame:
    """account_id, credit_class, amount (whole rupees), share_bp (hundredths of a per cent) of each class of income above zero.

    Amounts add up to the account's income in whole rupees: what rounding gains or loses goes to the largest class. Shares add
    up to 10,000: each is rounded down, and those that lost most get one more. Ties go to the first class in `TAXABLE`.
    """
    place = F.array_position(F.array(*[F.lit(c) for c in R.TAXABLE]), F.col("credit_class"))
    of = rows.where(F.col("credit_class").isin(R.TAXABLE)).groupBy("account_id", "credit_class").agg(F.sum("amount_c").alias("c")).where("c > 0").withColumn("place", place)
    account = Window.partitionBy("account_id")
    whole = F.sum("c").over(account)
    rounded = lambda c: F.call_function("div", c + 50, F.lit(100).cast("long"))
    of = of.withColumns({"rupees": rounded(F.col("c")), "all_c": whole}).withColumns(
        {
            "drift": rounded(F.col("all_c")) - F.sum("rupees").over(account),
            "largest": F.row_number().over(account.orderBy(F.desc("c"), "place")),
            "floor_bp": F.call_function("div", F.col("c") * 10_000, F.col("all_c")),
            "rest": (F.col("c") * 10_000) % F.col("all_c"),
        }
    )
    of = of.withColumns({"lacking": 10_000 - F.sum("floor_bp").over(account), "turn": F.row_number().over(account.orderBy(F.desc("rest"), "place"))})
    amount = F.col("rupees") + F.when(F.col("largest") == 1, F.col("drift")).otherwise(0)
    return of.select("account_id", "credit_class", amount.alias("amount"), (F.col("floor_bp") + F.when(F.col("turn") <= F.col("lacking"), 1).otherwise(0)).alias("share_bp"))


def consistency(e: DataFrame) -> DataFrame:
    """account_id, errors, warnings (lists of names) of the engine's figures."""
    classes = sum((F.col(f"{c}_c") for c in CLASSES if c != "non_income"), F.lit(0))
    errors = [(~F.col("foir").between(0, 200), "foir"), (~F.col("loan_dep_pct").between(0, 100), "loan_dependency"), (F.col("loan_eligible_c") < 0, "eligible"), (F.col("remaining_emi_c") < 0, "capacity")]
    warnings = [
        (F.abs(F.col("emi_c") / F.col("n_months") - F.col("monthly_emi_c")) > 5_000, "emi"), ((F.col("total_cr_c") > 0) & (F.col("total_dr_c") > 0) & (classes * 100 > F.col("total_cr_c") * 105), "classes"),
        (F.col("txns") < 3, "few rows"), (F.col("balances") < F.col("txns"), "balances"),
    ]
    named = lambda checks: F.array_compact(F.array(*[F.when(c, F.lit(k)) for c, k in checks]))
    return e.select("account_id", named(errors).alias("errors"), named(warnings).alias("warnings"))


def observed(checked: DataFrame) -> tuple[DataFrame, Observation]:
    """The frame of `consistency`, and how many accounts it had, failed and warned, counted while it is written: no second pass."""
    seen = Observation()
    counts = [F.count(F.lit(1)).alias("accounts"), F.count_if(F.size("errors") > 0).alias("failed"), F.count_if(F.size("warnings") > 0).alias("warned")]
    return checked.observe(seen, *counts), seen
