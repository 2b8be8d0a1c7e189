"""Helpers shared by the corpus operators: table reading, checkpoints, Arrow text buffers, bounded samples."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import stored as checkpointed

__all__ = ["bounded_batches", "bounded_sample", "bounded_texts", "checkpointed", "held_out", "row_blocks", "table", "text_buffer"]

CHUNK_BYTES = 1 << 20
#: Text that a model scores at a time: its arrays of numbers are some sixty times as large, in each worker.
SCORE_BYTES = 1 << 18
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    """The named columns of a table; whatever other columns the files hold is left out at the scan."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def bounded_batches(spark: SparkSession) -> None:
    """Hand texts to Python in Arrow batches bounded in rows and bytes: Spark's own default is by rows alone."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def text_buffer(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and its row offsets, without a copy; nulls are empty rows."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    body = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return body, ends.astype(np.int64)


def row_blocks(offsets: np.ndarray, limit: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of whole rows of about `limit` bytes; a longer row stands alone."""
    first, n = 0, len(offsets) - 1
    while first < n:
        last = int(np.searchsorted(offsets, offsets[first] + limit, side="right")) - 1
        last = min(max(last, first + 1), n)
        yield first, last
        first = last


def held_out(column: str, folds: int, fold: int):
    """True for rows whose crc32 of the id's decimal text falls into the held-out fold."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % folds == fold, F.lit(False))


def bounded_sample(df: DataFrame, key: str, most: int, rows: int | None = None, seed: int = 7) -> DataFrame:
    """About `most` rows at most, chosen by a hash of the key; all rows if there are fewer.

    The count is a job of its own unless it is given. The share kept is 0.9 * most / count, so that the size stays below `most` but
    for chance; callers that collect also cut at `most`.
    """
    rows = df.count() if rows is None else rows
    if rows <= most:
        return df
    share = 0.9 * most / rows
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1 << 30)) < int(share * (1 << 30)))


def bounded_texts(rows: DataFrame, group: str, text: str, most_rows: int, most_bytes: int) -> DataFrame:
    """Whole texts for training, a fair share of them for each group: about `most_rows` and `most_bytes` in all at most.

    Per group, distinct texts are counted and weighed first; those chosen by a hash of the text are so many that a
    group keeps within its share of rows and bytes (all, if they are few). Every text of up to its group's share of
    bytes has the same chance, whatever its length; repeated rows count once. A row that an overlong text or chance
    brings over the share in bytes is left out, in the order of the hash, so the bounds hold. Returns `group`, `text`.
    """
    rows = rows.select(group, text).where(F.col(group).isNotNull() & F.col(text).isNotNull())
    rows = rows.withColumns({"__hash": F.xxhash64(F.lit(7), text), "__bytes": F.octet_length(text).cast("long")})
    some = F.avg(F.least("__bytes", F.lit(most_bytes))).alias("__mean")
    weighed = checkpointed(rows.groupBy(group).agg(F.approx_count_distinct("__hash").alias("__texts"), some))
    groups = max(weighed.count(), 1)
    each_rows, each_bytes = max(most_rows // groups, 1), max(most_bytes // groups, 1)
    share = F.least(0.9 * each_rows / F.col("__texts"), 0.9 * each_bytes / (F.col("__texts") * F.greatest("__mean", F.lit(1.0))), F.lit(1.0))
    weighed = weighed.select(group, (share * (1 << 30)).cast("long").alias("__share"))
    rows = rows.where(F.col("__bytes") <= each_bytes)
    chosen = rows.join(F.broadcast(weighed), group).where(F.pmod("__hash", F.lit(1 << 30)) < F.col("__share"))
    chosen = chosen.groupBy(group, "__hash").agg(F.first(text).alias(text), F.first("__bytes").alias("__bytes"))
    order = Window.partitionBy(group).orderBy("__hash")
    held = chosen.withColumns({"__nth": F.row_number().over(order), "__sum": F.sum("__bytes").over(order)})
    return held.where((F.col("__nth") <= each_rows) & (F.col("__sum") <= each_bytes)).orderBy(group, "__hash").select(group, text)
