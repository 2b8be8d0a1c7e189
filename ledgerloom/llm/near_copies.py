"""Near copies by word shingles: texts whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

A set-similarity join; sets are compared whole, by 32-bit hashes of their shingles. Shingles have one global order, rare ones first; two sets of that
similarity share one of the first |x| - ceil(0.8 |x|) + 1 shingles of each, so pairs that share such a prefix shingle
(and whose sizes and positions allow the similarity) are all candidates there are. The order comes from counts of
hashed shingles over all texts; any order is right, rare first keeps common lines out of the prefixes.

Candidates are compared in two rounds, so that a large group of near copies isn't compared pair by pair: first each
set with one member of each of its prefix groups, then within each group only sets that are not yet connected. Each set
has a sketch, the parities of how many of its shingles fall into each of 1,024 slots; two sketches differ in no more
slots than the sets do in shingles. Pairs whose sketches differ by too much are dropped where they meet: no similar pair
is lost, and only the rest (those that are similar, or nearly) move on with their sets.

Texts of fewer than five words have one shingle of all their words. Null texts, empty ones and ones of white space
alone count as equal. A component is named by its smallest id (null if it has none); repeated rows and ids each count.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, checkpointed
from ledgerloom.llm.components import components, row_links

SHINGLE = 5
SEED = 42
#: Bits of the table of shingle counts, and parts in which it is summed.
COUNT_BITS = 21
PARTS = 64
MOST_COUNT = 65_535
#: Slots of a set's sketch.
SKETCH_BITS = 1024
#: Rows that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 500_000
#: The same for the centres of prefix groups, whose rows are wider: the driver holds each broadcast several times over.
MOST_CENTRES = 200_000


def shingles(text: str) -> np.ndarray:
    """The text's distinct shingles as sorted hashes."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    return np.unique(np.array([xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(SHINGLE)))], np.uint64))


def set_key(found: np.ndarray) -> int:
    from xxhash import xxh64_intdigest

    return int(np.uint64(xxh64_intdigest(found.tobytes(), SEED)).view(np.int64)) if len(found) else 0


def sketch(found: np.ndarray) -> np.ndarray:
    """Parities of the set's shingles by slot, 64 slots to a number."""
    odd = np.bincount((found & np.uint64(SKETCH_BITS - 1)).astype(np.int64), minlength=SKETCH_BITS) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64)


def _may_differ(n: Column, a: Column, m: Column, b: Column) -> Column:
    """Whether the sketches a and b of sets of n and m shingles allow the similarity: such sets differ by (n + m) / 9 shingles at most."""
    return 9 * reduce(add, [F.bit_count(a[k].bitwiseXOR(b[k])) for k in range(SKETCH_BITS // 64)]) <= n + m


def prefix(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles in the global order, one of which each similar set shares; no other set is similar to one of three or fewer."""
    n = len(found)
    if n <= 3:
        return found[:0]
    order = np.lexsort((found, counts[found >> np.uint64(64 - COUNT_BITS)]))
    return found[order[: n - (4 * n + 4) // 5 + 1]]


def shingle_counts(docs: DataFrame, text_col: str) -> np.ndarray:
    """How often shingles of each hash prefix occur in all texts."""
    width = (1 << COUNT_BITS) // PARTS

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << COUNT_BITS, np.int64)
        for batch in batches:
            found = [shingles(t.as_py() or "") >> np.uint64(64 - COUNT_BITS) for t in batch.column(0)]
            counts += np.bincount(np.concatenate(found).astype(np.int64), minlength=len(counts)) if found else 0
        if counts.any():
            short = np.minimum(counts, MOST_COUNT).astype(np.uint16)
            parts = [short[k * width : (k + 1) * width].tobytes() for k in range(PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(PARTS), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(given: pa.Table) -> pa.Table:
        summed = sum(np.frombuffer(x.as_py(), np.uint16).astype(np.int64) for x in given["counts"])
        return pa.table({"part": given["part"][:1], "counts": pa.array([np.minimum(summed, MOST_COUNT).astype(np.uint16).tobytes()], pa.binary())})

    out = np.zeros((PARTS, width), np.uint16)
    for r in docs.select(text_col).mapInArrow(run, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, counts binary").collect():
        out[r.part] = np.frombuffer(r.counts, np.uint16)
    return out.ravel()


def _few(rows: DataFrame, most: int = MOST_BROADCAST) -> DataFrame:
    rows = checkpointed(rows)
    return F.broadcast(rows) if rows.count() <= most else rows


def _alike(docs: DataFrame, leaves: DataFrame, id_col: str, text_col: str, pairs: DataFrame) -> DataFrame:
    """Of pairs (u, v) of set keys those with a similarity of 0.8 or more; only texts of theirs, one of each set, are read into sets again.

    Sets travel as sorted 32-bit hashes, half as large as the shingles' own: of two sets of n shingles, some n * n / 2**32
    unequal ones meet by chance, less than a hundred-thousandth of a set at the length of the longest books.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or "") for t in batch.column(0)]
            short = [np.unique((x >> np.uint64(32)).astype(np.uint32)).tobytes() for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([set_key(x) for x in found], pa.int64()), pa.array(short, pa.binary())], names=["fp", "grams"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_py(), np.uint32), np.frombuffer(y.as_py(), np.uint32)
                near.append(9 * len(np.intersect1d(a, b, assume_unique=True)) >= 4 * (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["u", "v"]).filter(pa.array(near, pa.bool_()))

    pairs = checkpointed(pairs)
    if pairs.isEmpty():
        return pairs
    keys = checkpointed(pairs.select(F.col("u").alias("fp")).unionByName(pairs.select(F.col("v").alias("fp"))).distinct())
    firsts = _few(leaves.join(keys, "fp").select(F.struct("first_id").alias("first")).distinct())
    own = docs.select(F.struct(id_col).alias("own"), F.col(text_col).alias("text")).join(firsts, F.col("own").eqNullSafe(F.col("first")), "left_semi").select("text")
    sets = own.mapInArrow(run, "fp long, grams binary").join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, "fp", "left_semi")
    sets = checkpointed(sets.groupBy("fp").agg(F.first("grams").alias("grams")))
    a, b = sets.select(F.col("fp").alias("u"), F.col("grams").alias("x")), sets.select(F.col("fp").alias("v"), F.col("grams").alias("y"))
    return checkpointed(pairs.join(a, "u").join(b, "v").select("u", "v", "x", "y").mapInArrow(compare, "u long, v long"))


def _may_be_alike(n, at, m, to):
    """Whether sizes allow the similarity, and what follows the shared shingle in both, were it the first one."""
    return (5 * n >= 4 * m) & (5 * m >= 4 * n) & (9 * F.least(n - at, m - to) >= 4 * (n + m))


def shingle_links(docs: DataFrame, leaves: DataFrame, prefixes: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For distinct sets (fp, first_id, n, sketch) and their prefixes (fp, n, prefix): edges (u, v) that connect exactly the sets connected by similar pairs."""
    given = prefixes.where(F.size("prefix") > 0).select("fp", F.col("n").cast("int").alias("n"), F.posexplode("prefix").alias("at", "token"))
    # most shingles of a prefix are in no other one: all move once, and those leave where they are counted
    counted = given.withColumn("sets", F.count(F.lit(1)).over(Window.partitionBy("token")))
    shared = checkpointed(counted.where("sets > 1").drop("sets"))
    sketches = leaves.select("fp", F.col("n").cast("int").alias("n"), "sketch")

    centre = F.min_by(F.struct("fp", "n", "at"), F.xxhash64("fp", "token")).alias("centre")
    centres = _few(shared.groupBy("token").agg(centre), MOST_CENTRES)
    may = _may_be_alike(F.col("n"), F.col("at"), F.col("centre.n"), F.col("centre.at"))
    first = shared.join(centres, "token").where(may & (F.col("fp") != F.col("centre.fp")))
    first = first.select(F.greatest("fp", "centre.fp").alias("u"), F.least("fp", "centre.fp").alias("v")).distinct()
    for end in ("u", "v"):
        first = first.join(sketches.select(F.col("fp").alias(end), F.col("n").alias(f"n_{end}"), F.col("sketch").alias(f"sketch_{end}")), end)
    first = first.where(_may_differ(F.col("n_u"), F.col("sketch_u"), F.col("n_v"), F.col("sketch_v"))).select("u", "v")
    links = _alike(docs, leaves, id_col, text_col, first)

    tied = components(links)
    roots = _few(tied.select(F.col("u").alias("fp"), F.col("v").alias("root")))
    named = shared.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    apart = _few(named.groupBy("token").agg(F.min("root").alias("a"), F.max("root").alias("b"), F.count(F.lit(1)).alias("sets")).where("a != b and sets > 2").select("token"))
    named = named.join(apart, "token", "left_semi").join(sketches.select("fp", "sketch"), "fp")
    # of a pair the smaller set shares 8 / 9 of its own shingles, so that of its prefix a shorter part does: no sets meet on what lies behind that in both
    other = named.where(9 * (F.col("n") - F.col("at")) >= 8 * F.col("n")).select("token", *[F.col(c).alias(f"other_{c}") for c in ("fp", "n", "at", "root", "sketch")])
    may = _may_be_alike(F.col("n"), F.col("at"), F.col("other_n"), F.col("other_at")) & _may_differ(F.col("n"), F.col("sketch"), F.col("other_n"), F.col("other_sketch"))
    smaller = (F.col("other_n") < F.col("n")) | ((F.col("other_n") == F.col("n")) & (F.col("other_fp") < F.col("fp")))
    rest = named.join(other, "token").where(smaller & (F.col("root") != F.col("other_root")) & may)
    rest = rest.select(F.greatest("fp", "other_fp").alias("fp"), F.least("fp", "other_fp").alias("other_fp"))
    return links.unionByName(_alike(docs, leaves, id_col, text_col, rest.select(F.col("fp").alias("u"), F.col("other_fp").alias("v")).distinct()))


def _linked(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (id, fp) with their sets' keys, the first id of each set, and the links of `shingle_links`."""
    kind = docs.schema[id_col].dataType.simpleString()
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(shingle_counts(docs, text_col))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [shingles(t.as_py() or "") for t in batch.column(1)]
            firsts = pa.array([prefix(x, shared.value).view(np.int64) for x in found], pa.list_(pa.int64()))
            sizes = pa.array([len(x) for x in found], pa.int64())
            odd = pa.array([sketch(x) for x in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(x) for x in found], pa.int64()), sizes, odd, firsts], names=["id", "fp", "n", "sketch", "prefix"])

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long, n long, sketch array<long>, prefix array<long>")
    rows = checkpointed(rows)
    leaves = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first_id"), F.first("n").alias("n"), F.first("sketch").alias("sketch")))
    prefixes = rows.groupBy("fp").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix"))  # they are long, and not stored again
    return rows.select("id", "fp"), leaves.select("fp", "first_id"), shingle_links(docs, leaves, prefixes, id_col, text_col)


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Links (u, v) of ids that connect the rows of each component of `near_copies`."""
    return row_links(*_linked(docs, id_col, text_col))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, component_id (the smallest id reachable over pairs of similarity 0.8 or more). Any type that has an order can be the id."""
    rows, leaves, links = _linked(docs, id_col, text_col)
    tied = components(links)
    roots = tied.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(tied.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = leaves.join(roots, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("fp", "least_id")
    of = leaves.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    of = of.repartition(F.xxhash64("fp"))  # by another key, so that both sides of the join are shuffled and a hot set can be split
    return rows.join(of, "fp").select(F.col("id").alias(id_col), "component_id")
