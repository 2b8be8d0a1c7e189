"""How far the sources of each language differ in their terms: exact joint tables of counts, priced cell by cell.

A term has one count in each group (a source of a language), so with an indicator column for every group and count
level, the terms are a 0/1 matrix, and the product of its transpose with itself holds, for every two groups, the table
of how many terms have count a in one and b in the other. What two groups differ by is a function of a and b alone, so
each cell of that table is priced once and weighted by its terms.

The product is blocked: terms are dealt into blocks by their hash, groups into tiles by their number, and one task
multiplies the columns of two tiles over one block. The indicator columns are sparse (one in each group for a term), so
a block's product is a count of pairs of level numbers, in integers, exact. Sums over blocks are sums over all terms, so
only they leave a task; terms that two tiles of a block don't hold have level 0 in both groups and are added at the end.
No source or language meets whole in one task, and blocks are as many as kept terms need.

Defined results: null text, language or source count as ''. A group without kept terms has count 0 for each term; a
language without kept terms has distances of 0. Ties go to the smaller item in byte order. Repeated rows count again.
An empty table has no rows. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, checkpointed
from ledgerloom.llm.words import byte_class, chunks, words_of

LETTERS = ~byte_class((0x00, 0x40), (0x5B, 0x60), (0x7B, 0x7F))
CHUNK_BYTES = 8 << 20
SCALE = 1_000_000_000
#: Terms of a block and groups of a tile, about; cells of one joint table that a task holds as a dense array.
BLOCK_TERMS, TILE_GROUPS, MOST_DENSE = 1 << 14, 64, 1 << 20


def term_counts(docs: DataFrame, lang: str = "lang", source: str = "source", text: str = "text") -> DataFrame:
    """lang, source, term, n (occurrences), df (rows that hold it); a group that occurs has one row of term null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "source", "term", "n", "df"]
        for chunk in chunks(batches, 2, CHUNK_BYTES):
            chunk = chunk.combine_chunks()
            first, second, texts = (chunk.column(k).chunk(0) for k in range(3))
            a, b = first.dictionary_encode(), second.dictionary_encode()
            group, own = pd.factorize(a.indices.to_numpy(zero_copy_only=False).astype(np.int64) * len(b.dictionary) + b.indices.to_numpy(zero_copy_only=False))
            langs, sources = a.dictionary.take(pa.array(own // len(b.dictionary))), b.dictionary.take(pa.array(own % len(b.dictionary)))
            zeros = pa.array(np.zeros(len(own), np.int64))
            yield pa.RecordBatch.from_arrays([langs, sources, pa.nulls(len(own), pa.string()), zeros, zeros], names=names)
            words = words_of(texts, ~LETTERS)
            if not len(words.text):
                continue
            coded = words.text.dictionary_encode()
            size = len(coded.dictionary)
            word = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            each, pairs = pd.factorize(words.row * size + word)
            times = np.bincount(each)
            which, found = pd.factorize(group[pairs // size] * size + pairs % size)
            n = np.bincount(which, weights=times).astype(np.int64)
            df = np.bincount(which)
            for k in range(0, len(found), 1 << 16):
                some = found[k : k + (1 << 16)]
                of, term = pa.array(some // size), coded.dictionary.take(pa.array(some % size)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([langs.take(of), sources.take(of), term, pa.array(n[k : k + (1 << 16)]), pa.array(df[k : k + (1 << 16)])], names=names)

    bounded_batches(docs.sparkSession)
    known = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(k) for k, c in (("lang", lang), ("source", source), ("text", text))])
    counted = known.mapInArrow(run, "lang string, source string, term string, n long, df long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def _wide(c: Column) -> Column:
    return c.cast("decimal(19,0)")


def level(n: Column, total: Column, terms: Column) -> Column:
    """1 + floor(SCALE * (n + 2) / (total + 2 * terms)), exactly."""
    return F.lit(1) + F.call_function("div", F.lit(SCALE).cast("decimal(10,0)") * _wide(n + 2), _wide(total + 2 * terms))


def price(p: Column, q: Column) -> Column:
    return F.call_function("div", _wide(p - q) * _wide(p - q), _wide(p + q))


def levels(n: np.ndarray, whole: int) -> np.ndarray:
    """`level` for counts of one group, `whole` = total + 2 * terms: three digits at a time, so that products fit."""
    out, rest = np.zeros(len(n), np.int64), n.astype(np.int64) + 2
    out, rest = rest // whole, rest % whole
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // whole, rest % whole
    return out + 1


def prices(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) ** 2 // (p + q)


def joint(a: np.ndarray, b: np.ndarray, n_a: int, n_b: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Product of the indicator columns of two groups: the level numbers of its cells and how many terms have both."""
    key = a * n_b + b
    if n_a * n_b <= MOST_DENSE:
        times = np.bincount(key)
        cell = np.flatnonzero(times)
        return cell // n_b, cell % n_b, times[cell]
    cell, times = np.unique(key, return_counts=True)
    return cell // n_b, cell % n_b, times


def block_sums(rows: pa.Table, tile: int) -> pa.Table:
    """For two tiles over one block: the priced joint table of each two groups, summed, and how many terms it is of."""
    number, n, whole = (rows.column(k).to_numpy() for k in ("number", "n", "whole"))
    lang, left, right = (rows.column(k)[0].as_py() for k in ("lang", "left", "right"))
    term = rows.column("term").combine_chunks().dictionary_encode()
    terms, term = len(term.dictionary), term.indices.fill_null(-1).to_numpy(zero_copy_only=False)
    held, groups = np.argsort(number, kind="stable"), {}
    for part in np.split(held, np.flatnonzero(np.diff(number[held])) + 1):
        column = np.zeros(terms, np.int64)
        column[term[part][term[part] >= 0]] = n[part][term[part] >= 0]
        known, column = np.unique(column, return_inverse=True)
        groups[int(number[part[0]])] = (column, levels(known, int(whole[part[0]])))
    out = {k: [] for k in SUMS.names}
    for i, (a, p) in groups.items():
        for j, (b, q) in groups.items():
            if i < j and i // tile == left and j // tile == right:
                x, y, times = joint(a, b, len(p), len(q))
                for k, v in zip(SUMS.names, (lang, i, j, int((prices(p[x], q[y]) * times).sum()), terms)):
                    out[k].append(v)
    return pa.table(out, schema=SUMS)


SUMS = pa.schema([("lang", pa.string()), ("i", pa.int64()), ("j", pa.int64()), ("value", pa.int64()), ("terms", pa.int64())])


def audit_sources(
    docs: DataFrame, least_df: int = 10, top: int = 10, lang: str = "lang", source: str = "source", text: str = "text", tile: int = TILE_GROUPS
) -> DataFrame:
    """lang, source, part, item, value, rank: distances of every two sources of a language, and each source's most overused terms."""
    counted = checkpointed(term_counts(docs, lang, source, text))
    words = counted.where("term is not null")
    kept = words.groupBy("lang", "term").agg(F.sum("n").alias("n_lang"), F.sum("df").alias("df")).where(F.col("df") >= least_df).drop("df")
    kept = checkpointed(words.drop("df").join(kept, ["lang", "term"]))

    # one row a group: its number, its count of kept terms, its language's, and how many terms the language keeps
    mine = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    per_lang = kept.groupBy("lang", "term").agg(F.first("n_lang").alias("n")).groupBy("lang").agg(F.sum("n").alias("lang_total"), F.count(F.lit(1)).alias("terms"))
    groups = counted.where("term is null").select("lang", "source").join(mine, ["lang", "source"], "left").join(per_lang, "lang", "left").na.fill(0)
    groups = checkpointed(groups.withColumn("number", (F.row_number().over(Window.partitionBy("lang").orderBy("source")) - 1).cast("long")))

    # blocked product: each group's terms go to the tile pairs of its tile; every group is in every block, with or without terms
    whole = F.col("total") + 2 * F.col("terms")
    known = kept.join(groups, ["lang", "source"])
    most = groups.agg(F.coalesce(F.max("terms"), F.lit(0)).alias("terms"), F.coalesce(F.max("number"), F.lit(0)).alias("number")).first()
    blocks, tiles = most.terms // BLOCK_TERMS + 1, most.number // tile + 1
    last = F.floor(F.max("number").over(Window.partitionBy("lang")) / tile)
    ends = groups.withColumns({"tile": F.floor(F.col("number") / tile), "last": last}).select("lang", "source", "tile", "last")
    pairs = ends.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("last"))))
    pairs = pairs.select("lang", "source", F.least("tile", "other").cast("long").alias("left"), F.greatest("tile", "other").cast("long").alias("right"))
    dealt = known.select("lang", "source", "term", "n", "number", whole.alias("whole"), F.pmod(F.xxhash64("term"), F.lit(blocks)).alias("block"))
    unsaid = groups.select("lang", "source", F.lit(None).cast("string").alias("term"), F.lit(0).cast("long").alias("n"), "number", whole.alias("whole"))
    dealt = dealt.unionByName(unsaid.where("whole > 0").withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))))
    dealt = dealt.join(pairs, ["lang", "source"]) if tiles > 1 else dealt.withColumns({"left": F.lit(0).cast("long"), "right": F.lit(0).cast("long")})
    ddl = "lang string, i long, j long, value long, terms long"
    sums = dealt.groupBy("lang", "block", "left", "right").applyInArrow(lambda rows: block_sums(rows, tile), ddl)
    sums = sums.groupBy("lang", "i", "j").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"), F.sum("terms").alias("seen"))
    mirrored = sums.unionByName(sums.select("lang", F.col("j").alias("i"), F.col("i").alias("j"), "value", "seen"))

    a = groups.select("lang", "source", F.col("number").alias("i"), F.col("total").alias("total_a"), "terms")
    b = groups.select("lang", F.col("source").alias("item"), F.col("number").alias("j"), F.col("total").alias("total_b"))
    both = a.join(b, "lang").where("i != j").join(mirrored, ["lang", "i", "j"], "left").na.fill(0, ["seen"])
    zero = F.lit(0).cast("long")
    unseen = price(level(zero, F.col("total_a"), F.col("terms")), level(zero, F.col("total_b"), F.col("terms"))) * (F.col("terms") - F.col("seen"))
    value = F.when(F.col("terms") > 0, (F.coalesce("value", F.lit(0)) + unseen).cast("long")).otherwise(0)
    pair = both.select("lang", "source", F.lit("pair").alias("part"), "item", value.cast("long").alias("value"))

    p, q = level(F.col("n"), F.col("total"), F.col("terms")), level(F.col("n_lang"), F.col("lang_total"), F.col("terms"))
    over = known.withColumns({"p": p, "q": q}).where("p > q")
    term = over.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), price(F.col("p"), F.col("q")).alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), "item"))
    term = term.withColumn("rank", rank).where(F.col("rank") <= top)
    return pair.withColumn("rank", rank).unionByName(term)
