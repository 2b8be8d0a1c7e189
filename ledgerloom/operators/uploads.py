"""Uploads told apart by their content, and results kept by it for a time.

A document's digest doesn't depend on the order or the partitioning of its rows: rows are hashed one by one, hashes are
gathered by their first digits, each part is sorted and hashed, and the document's digest is the hash of its parts in
order. Rows that repeat count as often as they stand there. A part holds a share of a document's hashes, so a
long document is spread over many groups.

Results lie in a folder for each time of storing, with their digests; what is older than the time to live is not read
and can be removed by whole folders. A folder is complete or not read: Spark writes `_SUCCESS` last.

Defined results: nulls are values of their own; an upload without rows has no digest; empty tables give empty ones.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import removed, stored

#: Hexadecimal digits of a row's hash that name its part.
PART_DIGITS = 2


def row_hash(columns: list[str]):
    """The hash of a row's values in the order of `columns`; a null differs from every text."""
    cell = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("-"))
    return F.md5(F.concat_ws("|", *[cell(c) for c in columns]))


def digests(rows: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """key, digest, rows of every document."""
    hashed = rows.select(key, row_hash(columns).alias("h"))
    parts = hashed.groupBy(key, F.substring("h", 1, PART_DIGITS).alias("part")).agg(F.md5(F.array_join(F.sort_array(F.collect_list("h")), "")).alias("h"), F.count(F.lit(1)).alias("rows"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("part", "h"))), lambda p: p["h"]), "")
    return parts.groupBy(key).agg(F.md5(joined).alias("digest"), F.sum("rows").alias("rows"))


def first_of_each(found: DataFrame, key: str) -> DataFrame:
    """Documents with `counted`: whether they are the first, by `key`, of their content."""
    first = found.groupBy("digest").agg(F.min(key).alias("first"))
    return found.join(first, "digest").withColumn("counted", F.col(key) == F.col("first")).drop("first")


def together(found: DataFrame, group: list[str]) -> DataFrame:
    """One digest for several documents, whatever their order: the hash of their sorted digests."""
    return found.groupBy(*group).agg(F.md5(F.array_join(F.sort_array(F.collect_list("digest")), "|")).alias("digest"), F.count(F.lit(1)).alias("documents"))


class Results:
    """Stored results by digest, below a folder that all machines reach; times are seconds."""

    def __init__(self, spark: SparkSession, folder: str, lives: int = 1800):
        self.spark, self.folder, self.lives = spark, folder.rstrip("/"), lives

    def _stored(self) -> dict[int, str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.folder)
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        if not files.exists(path):
            return {}
        found = {int(s.getPath().getName().removeprefix("at=").split("-")[0]): s.getPath() for s in files.listStatus(path) if s.isDirectory() and s.getPath().getName().startswith("at=")}
        whole = lambda p: files.exists(self.spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))
        return {at: p.toString() for at, p in found.items() if whole(p)}

    def put(self, results: DataFrame, now: int) -> None:
        """Store results, which have a column `digest`."""
        results.write.mode("overwrite").parquet(f"{self.folder}/at={now}")

    def fresh(self, now: int) -> DataFrame | None:
        """What was stored less than the time to live ago; the latest of each digest."""
        live = {at: p for at, p in self._stored().items() if now - at < self.lives}
        if not live:
            return None
        frames = [self.spark.read.parquet(p).withColumn("stored_at", F.lit(at).cast("long")) for at, p in sorted(live.items())]
        every = frames[0]
        for frame in frames[1:]:
            every = every.unionByName(frame, allowMissingColumns=True)
        last = every.groupBy("digest").agg(F.max("stored_at").alias("stored_at"))
        return every.join(last, ["digest", "stored_at"], "left_semi")

    def expire(self, now: int) -> int:
        """Remove what is too old; how many folders went."""
        old = [p for at, p in self._stored().items() if now - at >= self.lives]
        for p in old:
            removed(self.spark, p)
        return len(old)

    def through(self, rows: DataFrame, found: DataFrame, key: str, compute: Callable[[DataFrame], DataFrame], now: int) -> DataFrame:
        """Results of all documents: stored ones by digest, others by `compute` on the rows of one document of each content.

        `compute` gets rows with a column `digest` and keeps it; what it gives is stored.
        """
        known, first = self.fresh(now), first_of_each(found, key).where("counted").select(key, "digest")
        lacking = stored(first.join(known.select("digest").distinct(), "digest", "left_anti") if known is not None else first)
        if not lacking.isEmpty():
            self.put(compute(rows.join(lacking, key)), now)
            known = self.fresh(now)
        if known is None:
            return compute(rows.join(lacking, key)).withColumn("stored_at", F.lit(now).cast("long"))
        return known.join(found.select("digest").distinct(), "digest", "left_semi")
