"""Differences between two readings of the same ledgers, row by row, repeats counted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def differences(old: DataFrame, new: DataFrame, columns: list[str]) -> DataFrame:
    """`columns`, added, removed, unchanged: how often each distinct row is in one reading only, and in both.

    That is `exceptAll` either way and `intersectAll` in one grouping: each side's rows are counted before they are
    shuffled, so a row that repeats a thousand times moves once. Nulls equal nulls.
    """
    side = lambda frame, a, b: frame.select(*columns, F.lit(a).cast("long").alias("old"), F.lit(b).cast("long").alias("new"))
    both = side(old, 1, 0).unionByName(side(new, 0, 1)).groupBy(*columns).agg(F.sum("old").alias("old"), F.sum("new").alias("new"))
    zero = F.lit(0).cast("long")
    return both.select(*columns, F.greatest(F.col("new") - F.col("old"), zero).alias("added"), F.greatest(F.col("old") - F.col("new"), zero).alias("removed"), F.least("old", "new").alias("unchanged"))


def summary(found: DataFrame, key: str) -> DataFrame:
    """Per ledger how many rows came, went and stayed."""
    return found.groupBy(key).agg(*[F.sum(c).alias(c) for c in ("added", "removed", "unchanged")])
