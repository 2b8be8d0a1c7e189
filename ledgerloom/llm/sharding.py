"""Contiguous shards of equal bytes, by prefix sums of sizes; DataFrame operations only.

All rows stand in one global order: by a digest of the text, then by id, so that equal texts follow each other. The order
is dealt out by ranges, sizes are added up within each range, and the ranges' totals, of which there are as many as
ranges, give each range its place. A row belongs to the shard in which the middle of its bytes falls, so a shard differs
from an equal share by less than half a row at either end. Shards hold the texts in a mixed but repeatable order.

A text that a third of all rows share is dealt out by its ids, and rows that share even those by their place of reading,
so no range is larger than others. Texts are read once; only ids, sizes and digests are moved.

Defined results: a null text has no bytes and stands where an empty one does; null ids come first; rows that repeat
id and text each have a slot of their own. Fewer rows than shards leave shards empty; an empty table gives no rows.
Other columns are kept if they are named in `keep`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed

#: Bytes that a row takes besides its text.
ROW_BYTES = 8


def shard_by_bytes(docs: DataFrame, shards: int, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """id, size, text_crc32, shard (from 0), slot (from 0 in each shard, gapless) and the columns in `keep`."""
    text = F.coalesce(text_col, F.lit(""))
    digest = F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")
    read = docs.select(
        F.col(id_col).alias("__id"), (F.octet_length(text) + F.lit(ROW_BYTES)).cast("long").alias("__size"), F.crc32(text).alias("__crc32"), digest.alias("__digest"),
        F.monotonically_increasing_id().alias("__read"), *[F.col(c) for c in keep],
    )
    ordered = checkpointed(read).repartitionByRange("__digest", "__id", "__read")
    placed = checkpointed(ordered.withColumn("__range", F.spark_partition_id()))

    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    totals = placed.groupBy("__range").agg(F.sum("__size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    shift = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    everything = F.sum("bytes").over(Window.partitionBy())
    starts = totals.select("__range", shift("bytes").alias("__bytes_before"), shift("rows").alias("__rows_before"), everything.alias("__total"))

    inside = Window.partitionBy("__range").orderBy("__digest", "__id", "__read")
    upto = F.sum("__size").over(inside.rowsBetween(Window.unboundedPreceding, 0))
    numbered = placed.join(F.broadcast(starts), "__range")
    numbered = numbered.withColumns({"__end": F.col("__bytes_before") + upto, "__nth": F.col("__rows_before") + F.row_number().over(inside) - 1})
    twice_middle = (2 * F.col("__end") - F.col("__size")).cast("decimal(20,0)")
    shard = F.call_function("div", twice_middle * F.lit(shards), (2 * F.col("__total")).cast("decimal(20,0)"))
    numbered = checkpointed(numbered.withColumn("shard", shard.cast("int")))

    firsts = numbered.groupBy("shard").agg(F.min("__nth").alias("__first"))
    out = numbered.join(F.broadcast(firsts), "shard")
    slot = (F.col("__nth") - F.col("__first")).alias("slot")
    return out.select(F.col("__id").alias(id_col), F.col("__size").alias("size"), F.col("__crc32").alias("text_crc32"), "shard", slot, *keep)
