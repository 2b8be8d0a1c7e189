"""Several statements of one holder: read together, reported one by one and as one, in one pass."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators import engine


def read_statements(spark: SparkSession, paths: list[str]) -> DataFrame:
    """Transactions of several files or folders, whatever columns each has; `source_account` is the file's name without its ending."""
    name = F.regexp_replace(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1), r"\.[A-Za-z0-9.]+$", "")
    frames = [spark.read.parquet(p).select("*", name.alias("source_account")) for p in paths]
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def scopes(days: DataFrame, group: Column) -> DataFrame:
    """Days of every account and, under `together <group>`, of all accounts of a group; an account's own group is one level of the same pass.

    Of a group's accounts the last one with a balance on a day has that day's last balance.
    """
    keyed = days.withColumns({"scope_group": group.cast("string"), "own_eod": F.when(F.col("eod_c").isNotNull(), F.col("account_id"))})
    sets = [["scope_group", "account_id", "month", "date"], ["scope_group", "month", "date"]]
    summed = keyed.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in sets[0]]).agg(
        *[F.sum(c).alias(c) for c in engine.SUMS],
        F.min("min_balance_c").alias("min_balance_c"),
        F.max("max_balance_c").alias("max_balance_c"),
        F.max_by("eod_c", "own_eod").alias("eod_c"),
        F.grouping("account_id").alias("all"),
    )
    scope = F.when(F.col("all") == 1, F.concat(F.lit("together "), F.col("scope_group"))).otherwise(F.col("account_id").cast("string"))
    return summed.withColumn("account_id", scope).drop("scope_group", "all")


def figures(rows: DataFrame, group: Column) -> DataFrame:
    """The engine's figures of each account and of each group of accounts together; `rows` are enriched and read once."""
    return engine.figures(engine.months_of(scopes(engine.days(rows), group)))
