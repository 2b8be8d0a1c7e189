"""Report frames and transactions as files, one folder a frame, with Spark's own writers."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.functions.parsing import guarded


def safe_cells(frame: DataFrame) -> DataFrame:
    """Text columns guarded against being read as formulas."""
    return frame.select(*[guarded(F.col(f"`{n}`")).alias(n) if kind == "string" else F.col(f"`{n}`") for n, kind in frame.dtypes])


def write_reports(frames: dict[str, DataFrame], folder: str, form: str = "parquet") -> None:
    """Each frame under folder/name; for csv, arrays and maps as JSON and text cells guarded."""
    for name, frame in frames.items():
        if form == "csv":
            nested = [n for n, kind in frame.dtypes if kind.startswith(("array", "map", "struct"))]
            frame = safe_cells(frame.withColumns({n: F.to_json(n) for n in nested}) if nested else frame)
            frame.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            frame.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def ingest_stream(pages: DataFrame, parse, folder: str, checkpoint: str, once: bool = True):
    """A stream of statement pages, each batch parsed by `parse` into folder/batch=number; batches hold whole documents.

    A batch that is tried again overwrites its own folder, so every batch counts once.
    """

    def batch(frame: DataFrame, number: int) -> None:
        parse(frame).write.mode("overwrite").parquet(f"{folder}/batch={number}")

    writer = pages.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


MANIFEST = "_MANIFEST.json"


def _path(spark: SparkSession, place: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(place)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def write_book(frames: dict[str, DataFrame], folder: str, edition: str | None = None) -> str:
    """All reports as one edition: folder/edition=<name>/report=<report>/, and a manifest written last, as the mark of a whole edition.

    Readers see an edition only once its manifest stands there, under its final name: whatever breaks before leaves
    the last whole edition in place.
    """
    spark = next(iter(frames.values())).sparkSession
    edition = edition or uuid.uuid4().hex
    place = f"{folder}/edition={edition}"
    for name, frame in frames.items():
        frame.write.parquet(f"{place}/report={name}")
    manifest = {"edition": edition, "reports": {name: frame.schema.jsonValue() for name, frame in frames.items()}}
    files, draft = _path(spark, f"{place}/.draft")
    stream = files.create(draft, True)
    stream.write(bytearray(json.dumps(manifest).encode()))
    stream.close()
    if not files.rename(draft, _path(spark, f"{place}/{MANIFEST}")[1]):
        raise RuntimeError(f"the edition {edition} was written by another job")
    return edition


def editions(spark: SparkSession, folder: str) -> list[str]:
    """Whole editions, the latest last."""
    files, top = _path(spark, folder)
    if not files.exists(top):
        return []
    found = []
    for s in files.listStatus(top):
        mark = _path(spark, f"{s.getPath().toString()}/{MANIFEST}")[1]
        if s.getPath().getName().startswith("edition=") and files.exists(mark):
            found.append((files.getFileStatus(mark).getModificationTime(), s.getPath().getName().removeprefix("edition=")))
    return [name for _, name in sorted(found)]


def read_book(spark: SparkSession, folder: str, edition: str | None = None) -> dict[str, DataFrame]:
    """The reports of one whole edition, the latest if none is named."""
    known = editions(spark, folder)
    if not known or edition not in (None, *known):
        raise FileNotFoundError(f"no whole edition in {folder}")
    place = f"{folder}/edition={edition or known[-1]}"
    manifest = json.loads(_text(spark, f"{place}/{MANIFEST}"))
    return {name: spark.read.parquet(f"{place}/report={name}") for name in manifest["reports"]}


def _text(spark: SparkSession, place: str) -> str:
    files, path = _path(spark, place)
    stream = files.open(path)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def upload_documents(rows: DataFrame, key: str, names: DataFrame, parse_ms: int = 0) -> DataFrame:
    """One JSON document an upload: its transactions in order, their count, its file name and the time of parsing in seconds.

    `names` has the key and `filename` of every upload; one without transactions has an empty list.
    """
    shown = F.struct("row_no", F.struct(F.col("date").cast("string").alias("date"), "desc", "type", (F.col("amount_c") / 100).alias("amount"), (F.col("balance_c") / 100).alias("balance")).alias("t"))
    listed = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(shown)), lambda x: x["t"]).alias("transactions"))
    whole = names.join(listed, key, "left").withColumn("transactions", F.coalesce("transactions", F.from_json(F.lit("[]"), listed.schema["transactions"].dataType.simpleString())))
    document = F.struct("transactions", F.size("transactions").alias("count"), F.lit(parse_ms / 1000).alias("parse_time"), "filename")
    return whole.select(key, F.to_json(document).alias("document"))
