"""Range joins as equi-joins on buckets, and interval self-joins."""

from __future__ import annotations

import math
from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: A bucket's width as a factor: wider than any two amounts within one per cent can lie apart.
WIDTH = math.log(1.02)
#: Amounts in paise below which each amount is a bucket of its own.
SMALL_C = 300


def first_within_percent(left: DataFrame, right: DataFrame, left_c: str, right_c: str, keys: list[str], order: str) -> DataFrame:
    """For each left row the first right row, by `order`, of the same keys whose amount is within one per cent.

    Left rows carry `left_id`; amounts are in paise. Below 1.00 the tolerance is 0.01 of a rupee, as it is relative to
    at least one rupee; small amounts are their own buckets. Each right row stands in the few buckets that its matches
    can lie in, so the join stays an equi-join and left rows, of which there are more, move once.
    """
    wide = lambda c: F.floor(F.log(F.greatest(c, F.lit(1)).cast("double")) / WIDTH).cast("long")
    bucket = lambda c: F.when(c < SMALL_C, -c).otherwise(wide(c))
    amount = F.col(right_c)
    few = F.array_distinct(F.transform(F.sequence(amount - 4, amount + 4), bucket))
    near_by = F.when(amount < SMALL_C + 10, few).otherwise(F.array(*[wide(amount) + d for d in (-1, 0, 1)]))
    # exploded, though it is one: else the amount's own expression is worked out again for each use of the bucket
    looked = left.where(F.col(left_c) > 0).withColumn("bucket", F.explode(F.array(bucket(F.col(left_c)))))
    given = right.where(amount > 0).withColumn("bucket", F.explode(near_by))
    near = F.abs(F.col(right_c) - F.col(left_c)) <= F.greatest(F.col(left_c), F.lit(100)) * 0.01
    found = looked.join(given, [*keys, "bucket"]).where(near)
    return found.groupBy("left_id").agg(F.min_by(F.struct(*[c for c in given.columns if c not in (*keys, "bucket")]), order).alias("match"))


def circular_flows(rows: DataFrame, least_c: int = 500_000, days: int = 8) -> DataFrame:
    """Credits that leave again within `days` active days as a debit of the same amount (less than 1.00 apart).

    Pairs carry both narrations for a similarity test. The amount's rupee bucket makes an equi-join of the pairing.
    """
    dated = rows.where("date is not null").withColumn("day", F.dense_rank().over(Window.partitionBy("account_id").orderBy("date")))
    rupees = F.floor(F.col("amount_c") / 100)
    credits = dated.where((F.col("type") == "CR") & (F.col("amount_c") >= least_c)).select(
        "account_id", F.col("day").alias("cr_day"), F.col("date").alias("credit_date"), F.col("desc").alias("credit_desc"), F.col("amount_c").alias("cr_c"),
        F.col("row_no").alias("cr_row"), F.explode(F.array(*[rupees + d for d in (-1, 0, 1)])).alias("bucket"),
    )
    debits = dated.where(F.col("type") == "DR").select(
        "account_id", F.col("day").alias("dr_day"), F.col("date").alias("debit_date"), F.col("desc").alias("debit_desc"), F.col("amount_c").alias("dr_c"), F.col("row_no").alias("dr_row"), rupees.alias("bucket")
    )
    close = F.col("dr_day").between(F.col("cr_day"), F.col("cr_day") + days - 1) & (F.abs(F.col("dr_c") - F.col("cr_c")) < 100)
    return credits.join(debits, ["account_id", "bucket"]).where(close).drop("bucket")


def is_round_lot():
    return (F.col("cr_c") >= 5_000_000) & (F.col("cr_c") % 500_000 == 0)


def round_lot(pairs: DataFrame) -> DataFrame:
    """The pairs whose credit is a large round amount, one per dates and rounded amount."""
    kept = pairs.where(is_round_lot())
    return kept.select("account_id", "credit_date", "debit_date", F.bround(F.col("cr_c") / 100, 0).alias("amount")).distinct()


def circular_counts(rows: DataFrame) -> DataFrame:
    """Per account its circular flows, one per dates and rounded amount: alike narrations, or a large round amount."""
    pairs = similar(circular_flows(rows), F.col("credit_desc"), F.col("debit_desc"), -1.0)
    kept = pairs.where((F.col("similarity") > 0.45) | is_round_lot())
    flows = kept.select("account_id", "credit_date", "debit_date", F.bround(F.col("cr_c") / 100, 0).alias("amount")).distinct()
    return flows.groupBy("account_id").agg(F.count(F.lit(1)).alias("circular"))


def same_day_groups(rows: DataFrame) -> DataFrame:
    """Rows that share account, date, type and rounded amount with another: suspects of a double entry."""
    keyed = rows.withColumn("rounded", F.bround(F.col("amount_c") / 100, 0))
    group = Window.partitionBy("account_id", "date", "type", "rounded")
    return keyed.withColumn("alike", F.count(F.lit(1)).over(group)).where("alike > 1")


def similar(pairs: DataFrame, left: str, right: str, least: float) -> DataFrame:
    """Pairs whose narrations' first 30 characters are alike: twice the matching characters over both lengths."""

    @F.pandas_udf("double")
    def alike(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([SequenceMatcher(None, x or "", y or "").ratio() for x, y in zip(a, b)])

    cut = lambda c: F.lower(F.substring(F.coalesce(c, F.lit("")), 1, 30))
    return pairs.withColumn("similarity", alike(cut(left), cut(right))).where(F.col("similarity") > least)


def duplicate_suspects(rows: DataFrame, least: float = 0.70) -> DataFrame:
    """Groups of same-day rows in which two narrations are alike; each such group's rows once."""
    groups = same_day_groups(rows)
    keys = ["account_id", "date", "type", "rounded"]
    texts = groups.select(*keys, F.lower(F.substring(F.coalesce("desc", F.lit("")), 1, 30)).alias("text")).groupBy(*keys, "text").agg(F.count(F.lit(1)).alias("n"))
    a, b = texts.alias("a"), texts.alias("b")
    pairs = a.join(b, keys).where("a.text < b.text").select(*keys, F.col("a.text").alias("x"), F.col("b.text").alias("y"))
    found = similar(pairs, "x", "y", least).select(*keys).unionByName(texts.where("n > 1").select(*keys)).distinct()
    return groups.join(found, keys, "left_semi")
