"""Balance continuity: repair, cleaning, filling, validation and audit. All windows run within one account."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Phrases of page furniture that end a narration.
JUNK = ["rbi mandate", "important information", "account no.", "kotak mahindra bank", "statement generated"]


def by_row():
    """An account's rows in their order."""
    return Window.partitionBy("account_id").orderBy("row_no")


def to_here():
    return by_row().rowsBetween(Window.unboundedPreceding, Window.currentRow)


def signed(kind: str = "type", amount: str = "amount_c") -> Column:
    return F.when(F.col(kind) == "CR", F.col(amount)).otherwise(-F.col(amount))


def hundredth(amount: Column) -> Column:
    """One per cent, rounded half up, in paise."""
    lifted = amount + 50
    return ((lifted - lifted % 100) / 100).cast("long")


def row_problems() -> Column:
    """What a row lacks, as an array: date, amount (none or zero), balance, and a direction."""
    found = [
        (F.col("date").isNull(), F.lit("missing date")),
        (F.coalesce(F.col("amount_c"), F.lit(0)) == 0, F.lit("missing amount")),
        (F.col("balance_c").isNull(), F.lit("missing balance")),
        (~F.coalesce(F.col("type").isin("CR", "DR"), F.lit(False)), F.concat(F.lit("invalid type: "), F.coalesce("type", F.lit("None")))),
    ]
    return F.array_compact(F.array(*[F.when(c, said) for c, said in found]))


def repair_types(rows: DataFrame) -> DataFrame:
    """Adds fixed_type: the direction that the change of balance shows, where it shows one and the row isn't type_locked."""
    prev = F.lag("balance_c").over(by_row())
    amount, delta = F.col("amount_c"), F.col("balance_c") - F.col("prev_c")
    tolerance = F.greatest(F.lit(100), hundredth(amount))
    later = F.when(F.abs(delta - amount) <= tolerance, "CR").when(F.abs(delta + amount) <= tolerance, "DR")
    first = F.when(F.abs(F.col("balance_c") - amount) <= tolerance, "CR").when(F.col("balance_c") >= amount, "CR").when(F.col("balance_c") + amount >= 0, "DR")
    shown = F.when(F.col("row_no") == 1, first).otherwise(later)
    free = amount != 0
    if "type_locked" in rows.columns:
        free = free & ~F.coalesce("type_locked", F.lit(False))
    return rows.withColumn("prev_c", prev).withColumn("fixed_type", F.coalesce(F.when(free, shown), "type"))


def clean_narration(desc: Column) -> Column:
    text = F.trim(F.regexp_replace(F.coalesce(desc, F.lit("")), r"\s+", " "))
    for phrase in JUNK:
        at = F.locate(phrase, F.lower(text))
        text = F.when(at > 11, F.trim(F.substring(text, F.lit(1), at - 1))).otherwise(text)
    return F.trim(F.substring(text, 1, 200))


def deduplicate(rows: DataFrame) -> DataFrame:
    """The first row, by row_no, of each set that agrees on date, amount, type, narration and balance; narrations cleaned."""
    keys = ["account_id", "date", "amount_c", "type", F.trim(F.coalesce("desc", F.lit(""))), "balance_c"]
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy("row_no"))
    return rows.withColumn("nth", nth).where("nth = 1").drop("nth").withColumn("desc", clean_narration(F.col("desc")))


def fill_balances(rows: DataFrame, opening: Column) -> DataFrame:
    """Adds filled_c: a lost balance is the last known one plus the signed amounts since, or the opening one plus all."""
    island = F.count("balance_c").over(to_here())
    rows = rows.withColumn("island", island)
    within = Window.partitionBy("account_id", "island")
    since = F.sum(F.when(F.col("balance_c").isNull(), signed()).otherwise(0)).over(within.orderBy("row_no").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("filled_c", F.coalesce(F.max("balance_c").over(within), opening, F.lit(0)) + since)


def validate(rows: DataFrame, opening: Column) -> DataFrame:
    """Adds status (verified, swapped, amount_fixed, unverified; uncheckable rows count as verified), new_type, new_amount_c."""
    prev = F.when(F.col("row_no") == 1, opening).otherwise(F.lag("balance_c").over(by_row()))
    rows = rows.withColumn("prev_c", prev)
    amount, balance, before = F.col("amount_c"), F.col("balance_c"), F.col("prev_c")
    up = F.col("type") == "CR"
    expected = before + F.when(up, amount).otherwise(-amount)
    swapped = before - F.when(up, amount).otherwise(-amount)
    moved = F.abs(balance - before)
    checkable = before.isNotNull() & balance.isNotNull() & (amount != 0) & F.col("type").isin("CR", "DR")
    status = (
        F.when(~F.coalesce(checkable, F.lit(False)), "verified")
        .when(F.abs(expected - balance) <= 50, "verified")
        .when(F.abs(swapped - balance) <= 50, "swapped")
        .when((F.col("row_no") > 1) & (moved > 0) & (F.abs(moved - amount) > 100), "amount_fixed")
        .otherwise("unverified")
    )
    rows = rows.withColumns({"status": status, "checkable": F.coalesce(checkable, F.lit(False))})
    turned = F.when(F.col("type") == "CR", "DR").otherwise("CR")
    by_move = F.when(balance > before, "CR").otherwise("DR")
    fixed = F.col("status") == "amount_fixed"
    return rows.withColumns(
        {
            "new_type": F.when(F.col("status") == "swapped", turned).when(fixed, by_move).otherwise(F.col("type")),
            "new_amount_c": F.when(fixed, moved).otherwise(amount),
        }
    )


def validation_summary(validated: DataFrame) -> DataFrame:
    out = validated.groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if("checkable").alias("checkable"),
        F.count_if(F.col("status").isin("swapped", "amount_fixed")).alias("auto_fixed"),
        F.count_if(F.col("status") == "unverified").alias("unverified"),
    )
    score = (F.col("total") - F.col("unverified")) * F.lit(100.0) / F.col("total")
    colour = F.when(F.col("unverified") == 0, "green").when(score >= 95, "green").when(score >= 85, "yellow").otherwise("red")
    return out.withColumns({"score": score, "badge_color": colour})


def verify(rows: DataFrame) -> DataFrame:
    """Per account: fields that are missing, continuity errors beyond 1.00, percentages, and the closing balance's check."""
    expected = F.lag("balance_c").over(by_row()) + signed()
    off = F.coalesce(F.abs(expected - F.col("balance_c")) > 100, F.lit(False)) & F.col("type").isin("CR", "DR")
    out = rows.withColumn("off", off).groupBy("account_id").agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("balance_c").isNull()).alias("missing_balance"),
        F.count_if(F.coalesce(F.col("amount_c"), F.lit(0)) == 0).alias("missing_amount"),
        F.count_if("off").alias("continuity_errors"),
        F.min_by("balance_c", "row_no").alias("opening_c"),
        F.max_by("balance_c", "row_no").alias("closing_c"),
        F.sum(F.when(F.col("type") == "CR", F.col("amount_c")).otherwise(0)).alias("credits_c"),
        F.sum(F.when(F.col("type") == "DR", F.col("amount_c")).otherwise(0)).alias("debits_c"),
    )
    n = F.col("total")
    continuity = F.when(n > 1, (n - 1 - F.col("continuity_errors")) * F.lit(100.0) / (n - 1)).otherwise(100.0)
    fields = (n - F.greatest("missing_balance", "missing_amount")) * F.lit(100.0) / n
    return out.withColumns({"continuity_pct": continuity, "fields_pct": fields}).withColumn("overall", (F.col("continuity_pct") + F.col("fields_pct")) / 2)


def audit_mismatches(rows: DataFrame) -> DataFrame:
    """Rows whose balance is off by more than 2.00 from the row before, unless more than a day lies between them."""
    order = Window.partitionBy("account_id").orderBy("date", "row_no")
    rows = rows.withColumns({"prev_c": F.lag("balance_c").over(order), "prev_date": F.lag("date").over(order)})
    gap = F.coalesce(F.datediff("date", "prev_date") > 1, F.lit(False))
    expected = F.col("prev_c") + signed()
    off = F.abs(expected - F.col("balance_c"))
    return rows.where((F.col("amount_c") != 0) & ~gap & (off > 200)).withColumns({"expected_c": expected, "diff_c": off})


def end_of_day(rows: DataFrame) -> DataFrame:
    """The last known balance of each account and day."""
    known = rows.where(F.col("balance_c").isNotNull() & F.col("date").isNotNull())
    return known.groupBy("account_id", "date").agg(F.max_by("balance_c", "row_no").alias("eod_c"))


def inferred_opening(rows: DataFrame) -> DataFrame:
    """Per account what the balance was before its first row, where that row tells and the result isn't negative."""
    first = rows.groupBy("account_id").agg(F.min_by(F.struct("type", "amount_c", "balance_c"), "row_no").alias("f"))
    before = F.col("f.balance_c") - F.when(F.col("f.type") == "CR", F.col("f.amount_c")).otherwise(-F.col("f.amount_c"))
    return first.select("account_id", before.alias("opening_c")).where((F.col("opening_c") >= 0))
