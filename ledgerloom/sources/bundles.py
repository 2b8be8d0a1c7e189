"""Statements as files of text, read through Spark's data source interface, in batches or as a stream.

A bundle is a text file of documents, each ended by a record separator; a document is a line `Document: <id>` and its
pages, with a form feed between two. `write_bundles` makes such files; `register` adds the format `statement_bundles` to a
session, so that `spark.read.format("statement_bundles").load(folder)` and `spark.readStream...` give pages.

One task reads one file, a block at a time, and hands on pages as Arrow batches, so what it holds is a block and its
longest document. Files are opened by pyarrow, by their place or uri; executors must be able to reach them. A stream's
offset is the modification time and name of the last file, so files are to be moved into the folder when whole.

Defined results: an empty folder has no pages; an empty page is a page; a document without the first line has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

FORMAT = "statement_bundles"
SCHEMA = "doc_id string, page_no int, text string, bundle string"
DOCUMENT_END, PAGE_END, TITLE = "\x1e", "\f", "Document: "
BLOCK_BYTES = 1 << 20
BATCH_BYTES = 4 << 20


def write_bundles(pages: DataFrame, folder: str, bundles: int | None = None) -> None:
    """Pages (doc_id, page_no, text) as files of whole documents."""
    texts = F.transform(F.sort_array(F.collect_list(F.struct("page_no", F.coalesce("text", F.lit("")).alias("text")))), lambda p: p["text"])
    whole = pages.groupBy("doc_id").agg(F.concat(F.lit(TITLE), F.col("doc_id").cast("string"), F.lit("\n"), F.array_join(texts, PAGE_END)).alias("value"))
    whole = whole.select("value")
    (whole.repartition(bundles) if bundles else whole).write.option("lineSep", DOCUMENT_END).text(folder)


def placed(path: str):
    """The file system of a path or uri, and the path there."""
    from pyarrow import fs

    path = path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def listed(path: str) -> list[tuple[int, str, int]]:
    """Data files below a folder, or the file itself: modification time, path, size; oldest first."""
    from pyarrow import fs

    files, at = placed(path)
    info = files.get_file_info(at)
    found = files.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
    hidden = lambda f: f.path[len(at) :].lstrip("/").startswith(("_", ".")) or f.base_name.startswith(("_", "."))
    return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == fs.FileType.File and not hidden(f))


def documents(path: str) -> Iterator[str]:
    """The documents of one file, in order."""
    files, at = placed(path)
    held = b""
    with files.open_input_stream(at) as stream:
        while block := stream.read(BLOCK_BYTES):
            *whole, rest = block.split(DOCUMENT_END.encode())
            if whole:
                yield (held + whole[0]).decode(errors="replace")
                yield from (w.decode(errors="replace") for w in whole[1:])
                held = rest
            else:
                held += rest
    if held.strip():
        yield held.decode(errors="replace")


class Bundle(InputPartition):
    def __init__(self, path: str):
        self.path = path


def pages_of(bundle: Bundle) -> Iterator[pa.RecordBatch]:
    rows, size = ([], [], []), 0
    kinds = (pa.string(), pa.int32(), pa.string())

    def batch() -> pa.RecordBatch:
        cells = [pa.array(c, k) for c, k in zip(rows, kinds)] + [pa.array([bundle.path] * len(rows[0]), pa.string())]
        return pa.RecordBatch.from_arrays(cells, names=["doc_id", "page_no", "text", "bundle"])

    for text in documents(bundle.path):
        name, body = None, text
        if text.startswith(TITLE):
            first, _, body = text.partition("\n")
            name = first.removeprefix(TITLE).strip()
        for k, page in enumerate(body.split(PAGE_END)):
            for column, cell in zip(rows, (name, k + 1, page)):
                column.append(cell)
        size += len(text)
        if size >= BATCH_BYTES:
            yield batch()
            rows, size = ([], [], []), 0
    if rows[0]:
        yield batch()


class BundleReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[InputPartition]:
        return [Bundle(path) for _, path, _ in sorted(listed(self.path), key=lambda f: -f[2])]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return iter(()) if partition is None else pages_of(partition)


class BundleStream(DataSourceStreamReader):
    """New files since the last offset; each file is one task of its batch."""

    def __init__(self, path: str):
        self.path = path

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = listed(self.path)
        return {"time": found[-1][0], "path": found[-1][1]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        after, last = (start["time"], start["path"]), (end["time"], end["path"])
        return [Bundle(path) for time, path, _ in listed(self.path) if after < (time, path) <= last]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        return pages_of(partition)

    def commit(self, end: dict) -> None:
        pass


class StatementBundles(DataSource):
    """Option `path`: a folder of bundles, or one."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return BundleReader(self.options["path"])

    def streamReader(self, schema) -> DataSourceStreamReader:
        return BundleStream(self.options["path"])


def register(spark: SparkSession) -> None:
    spark.dataSource.register(StatementBundles)
