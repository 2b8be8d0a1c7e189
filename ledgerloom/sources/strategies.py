"""Which way of reading gets the most out of a statement: ruled tables, aligned text, placed words, or lines.

Every way gives the same columns. What each gets from a document is scored by the rows whose printed balance follows from
the one before, then by all its rows, then by those with a balance (of a single row no balance follows), then by the order of
`WAYS`; the best one is kept. Documents of one layout are read
best in one way, so what won is remembered by the layout's fingerprint (the words of the first lines), and documents
whose fingerprint is known are read in that way alone.

Each way is one pass over its input, restricted to its documents before anything is parsed; all windows stay within a
document. A document that nothing reads has no rows.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.operators.lineage import stored
from ledgerloom.sources import statements, tables

WAYS = ["table", "relaxed", "words", "lines"]
COLUMNS = ["doc_id", "row_no", "date", "desc", "type", "amount_c", "balance_c"]
#: Lines of the first page that tell a layout.
TITLE_LINES = 6


def aligned_cells(pages: DataFrame) -> DataFrame:
    """Lines of text cut where two spaces or more, a tab or a bar stand: rows of three cells and more."""
    cut = pages.select("doc_id", "page_no", F.posexplode(F.split(F.coalesce("text", F.lit("")), r"\r?\n")).alias("at", "line"))
    cut = cut.withColumn("cells", F.split(F.trim("line"), r"\s*\|\s*|\t|\s{2,}")).where(F.size("cells") >= 3)
    place = F.row_number().over(Window.partitionBy("doc_id").orderBy("page_no", "at"))
    return cut.select("doc_id", place.cast("long").alias("row_no"), "cells")


def fingerprint(first_page: Column) -> Column:
    """A digest of the letters of the first lines: numbers and dates of a document don't matter."""
    lines = F.slice(F.split(F.lower(F.coalesce(first_page, F.lit(""))), r"\r?\n"), 1, TITLE_LINES)
    return F.md5(F.trim(F.regexp_replace(F.array_join(lines, " "), "[^a-z]+", " ")))


def fingerprints(pages: DataFrame) -> DataFrame:
    return pages.where("page_no = 1").select("doc_id", fingerprint(F.col("text")).alias("layout"))


def scored(found: DataFrame, tolerance_c: int = 50) -> DataFrame:
    """doc_id, way, rows, follow, printed: rows read, those whose balance is the one before plus or minus the amount, and those with a balance."""
    delta = F.col("balance_c") - F.lag("balance_c").over(Window.partitionBy("doc_id", "way").orderBy("row_no"))
    signed = F.when(F.col("type") == "CR", F.col("amount_c")).otherwise(-F.col("amount_c"))
    follows = F.coalesce(F.abs(delta - signed) <= tolerance_c, F.lit(False))
    return found.withColumn("follows", follows).groupBy("doc_id", "way").agg(F.count(F.lit(1)).alias("rows"), F.count_if("follows").alias("follow"), F.count("balance_c").alias("printed"))


def best(scores: DataFrame) -> DataFrame:
    place = F.array_position(F.array(*[F.lit(w) for w in WAYS]), F.col("way"))
    return scores.groupBy("doc_id").agg(F.max_by(F.struct("way", "rows", "follow"), F.struct("follow", "rows", "printed", -place)).alias("won")).select("doc_id", "won.*")


def learned(won: DataFrame, layouts: DataFrame) -> DataFrame:
    """layout, way: the way that won most often for each fingerprint."""
    place = F.array_position(F.array(*[F.lit(w) for w in WAYS]), F.col("way"))
    times = won.join(layouts, "doc_id").groupBy("layout", "way").agg(F.count(F.lit(1)).alias("times"))
    return times.groupBy("layout").agg(F.max_by("way", F.struct("times", -place)).alias("way"))


def read(pages: DataFrame, cells: DataFrame | None = None, words: DataFrame | None = None, known: DataFrame | None = None, banks: statements.Banks = statements.BANKS) -> tuple[DataFrame, DataFrame]:
    """Transactions with the way they were read, and what won where (doc_id, way, rows, follow).

    `pages` are doc_id, page_no, text; `cells` doc_id, row_no, cells of ruled tables; `words` doc_id, page_no, text, x0, x1,
    top. `known` is layout, way as `learned` gives it.
    """
    layouts = fingerprints(pages)
    tried = layouts.join(known, "layout", "left") if known is not None else layouts.withColumn("way", F.lit(None).cast("string"))
    tried = stored(tried.select("doc_id", F.col("way").alias("said")))
    ways: dict[str, tuple[DataFrame, Callable[[DataFrame], DataFrame]]] = {
        "relaxed": (pages, lambda p: tables.generic(aligned_cells(p))),
        "lines": (pages, lambda p: statements.transactions(p, banks)),
    }
    if cells is not None:
        ways["table"] = (cells, tables.generic)
    if words is not None:
        ways["words"] = (words, lambda w: tables.generic(tables.word_cells(w)))
    parts = []
    for way, (source, parse) in ways.items():
        mine = tried.where(F.col("said").isNull() | (F.col("said") == way)).select("doc_id")
        parts.append(parse(source.join(mine, "doc_id", "left_semi")).select(*COLUMNS).withColumn("way", F.lit(way)))
    found = stored(reduce(DataFrame.unionByName, parts))
    won = stored(best(scored(found)))
    return found.join(won.select("doc_id", "way"), ["doc_id", "way"], "left_semi"), won
