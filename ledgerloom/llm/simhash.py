"""Near duplicates by SimHash fingerprints joined in a binary trie.

Equal fingerprints are one trie leaf. Two fingerprints within `BUDGET` = 2 bits agree in at least one of three blocks
of bits, so three tries are built, each with another block on top; below each value of that block node pairs are
traversed together, one bit a level, adding up differing bits and dropping a pair once it exceeds the budget. A block
value with many fingerprints is split into pairs of subtrees, and a subtree pair that is still large into pairs of
salted parts, so no task holds more than a bounded group and no pair is lost. Each task passes on a spanning forest
of its links, which keeps every connection, and components are found on those.

Null texts, empty ones and ones of white space alone have fingerprint zero. Repeated rows and ids each count as rows
of their own; a component is named by its smallest id (null if it has none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, checkpointed
from ledgerloom.llm.components import components, row_links

BUDGET = 2
SHINGLE = 3
SEED = 42
#: (shift left to bring the block on top, bits of the block)
BLOCKS = ((0, 22), (22, 21), (43, 21))
#: Fingerprints below one block value, and in one subtree pair, beyond which they are split.
MOST_IN_GROUP = 4000
MOST_PAIRS = 1 << 21


def fingerprint(text: str, shingle: int = SHINGLE) -> int:
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        hashes = [xxh64_intdigest(b" ".join(words), SEED)]
    else:
        hashes = [xxh64_intdigest(b" ".join(t), SEED) for t in zip(*(words[i:] for i in range(shingle)))]
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 15):
        part = np.array(hashes[i : i + (1 << 15)], dtype="<u8")
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row its id and fingerprint, as a signed long of the same bits."""
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.array([fingerprint(t.as_py() or "", shingle) for t in batch.column(1)], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["id", "fp"])

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, fp long")


def trie_links(value: np.ndarray, a_first, a_last, b_first, b_last, depth: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions of linked values. `value` is sorted within each range; ranges share the bits above `depth`."""
    zero = np.zeros(len(a_first), np.int8)
    stack = [(depth, np.asarray(a_first), np.asarray(a_last), np.asarray(b_first), np.asarray(b_last), zero)]
    while stack:
        depth, al, ah, bl, bh, d = stack.pop()
        while len(al):
            alone = (ah - al == 1) & (bh - bl == 1)
            if alone.any():
                i, j = al[alone], bl[alone]
                near = (np.bitwise_count(value[i] ^ value[j]) <= BUDGET) & (i != j)
                if near.any():
                    yield i[near], j[near]
                al, ah, bl, bh, d = (x[~alone] for x in (al, ah, bl, bh, d))
            if depth == 64 or not len(al):
                break
            if len(al) > MOST_PAIRS:
                half = len(al) // 2
                stack.append((depth, *(x[half:] for x in (al, ah, bl, bh, d))))
                al, ah, bl, bh, d = (x[:half] for x in (al, ah, bl, bh, d))
                continue
            ones = np.concatenate([[0], np.cumsum((value >> np.uint64(63 - depth)) & np.uint64(1))]).astype(np.int64)
            am, bm = ah - (ones[ah] - ones[al]), bh - (ones[bh] - ones[bl])
            same = (al == bl) & (ah == bh)
            made = [(al, am, bl, bm, d), (am, ah, bm, bh, d), (al, am, bm, bh, d + 1)]
            made.append(tuple(x[~same] for x in (am, ah, bl, bm, d + 1)))
            kept = []
            for x in made:
                ok = (x[0] < x[1]) & (x[2] < x[3]) & (x[4] <= BUDGET) & ~((x[0] == x[2]) & (x[1] - x[0] == 1))
                kept.append(tuple(y[ok] for y in x))
            al, ah, bl, bh, d = (np.concatenate(x) for x in zip(*kept))
            depth += 1


def forest(n: int, links: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
    """Of n positions, the smallest that each is linked to, directly or not."""
    root = np.arange(n)
    for i, j in links:
        while True:
            a, b = root[i], root[j]
            apart = a != b
            if not apart.any():
                break
            i, j = i[apart], j[apart]
            low, high = np.minimum(a[apart], b[apart]), np.maximum(a[apart], b[apart])
            np.minimum.at(root, high, low)
            while (root != (up := root[root])).any():
                root = up
    return root


def _slab(key: np.ndarray, side: np.ndarray, value: np.ndarray, shift: np.ndarray) -> pa.RecordBatch:
    """Links of whole groups: rows in the order of key, side and value."""
    firsts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    lasts = np.append(firsts[1:], len(key))
    split = firsts + np.add.reduceat(side == 0, firsts)
    own = split == lasts
    b_first, b_last = np.where(own, firsts, split), np.where(own, lasts, lasts)
    root = forest(len(value), trie_links(value, firsts, split, b_first, b_last, 0))
    tied = np.flatnonzero(root != np.arange(len(value)))
    back = lambda at: ((value[at] >> shift[at]) | (value[at] << ((64 - shift[at]) & np.uint64(63)))).view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(back(tied)), pa.array(back(root[tied]))], names=["u", "v"])


def _join_groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[list[np.ndarray]] = []
    rows = 0
    for batch in batches:
        held.append([batch.column(i).to_numpy(zero_copy_only=False) for i in range(4)])
        rows += batch.num_rows
        if rows < 1 << 18:
            continue
        key, side, value, shift = (np.concatenate(x) for x in zip(*held))
        whole = int(np.searchsorted(key == key[-1], True)) if key[0] != key[-1] else 0
        if whole:
            yield _slab(key[:whole], side[:whole], value[:whole].view(np.uint64), shift[:whole].astype(np.uint64))
            held, rows = [[x[whole:] for x in (key, side, value, shift)]], len(key) - whole
    if rows:
        key, side, value, shift = (np.concatenate(x) for x in zip(*held))
        yield _slab(key, side, value.view(np.uint64), shift.astype(np.uint64))


def link_forest(fps: DataFrame) -> DataFrame:
    """For distinct fingerprints `fp`: edges (u, v) that connect exactly those within the bit budget of each other."""
    tries = []
    for k, (shift, bits) in enumerate(BLOCKS):
        turned = F.col("fp") if not shift else F.shiftleft("fp", shift).bitwiseOR(F.shiftrightunsigned("fp", 64 - shift))
        tries.append(fps.select(F.lit(k).alias("k"), F.lit(shift).alias("shift"), turned.alias("value"), F.lit(bits).alias("bits")))
    rows = tries[0].unionByName(tries[1]).unionByName(tries[2])
    rows = rows.withColumn("block", F.expr("shiftrightunsigned(value, 64 - bits)"))

    sizes = rows.groupBy("k", "block").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    rows = rows.join(sizes, ["k", "block"])
    rows = rows.withColumn("m", F.when(F.col("n") <= MOST_IN_GROUP, 0).otherwise(F.least(F.lit(10), F.ceil(F.log2(F.col("n") / MOST_IN_GROUP)).cast("int") + 1)))
    sub = F.expr("cast(case when m = 0 then 0 else shiftrightunsigned(shiftleft(value, bits), 64 - m) end as int)")
    flips = F.expr(
        "case when m = 0 then array(0) else concat(array(0), transform(sequence(0, m - 1), i -> shiftleft(1, i)), "
        "case when m < 2 then cast(array() as array<int>) else flatten(transform(sequence(0, m - 2), i -> transform(sequence(i + 1, m - 1), j -> shiftleft(1, i) | shiftleft(1, j)))) end) end"
    )
    rows = rows.withColumn("sub", sub).withColumn("flip", F.explode(flips))
    rows = rows.withColumn("other", F.col("sub").bitwiseXOR(F.col("flip")))
    rows = rows.withColumn("low", F.least("sub", "other")).withColumn("side", F.when(F.col("sub") <= F.col("other"), 0).otherwise(1))
    rows = rows.withColumn("group", F.xxhash64("k", "block", "low", "flip")).select("group", "side", "value", "shift", "flip")

    large = rows.groupBy("group").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 2 * MOST_IN_GROUP)
    large = large.select("group", F.ceil(F.col("n") / MOST_IN_GROUP).cast("int").alias("parts"))
    rows = rows.join(large, "group", "left")
    salted = F.expr(
        """case when parts is null then array(struct(0L as pair, side as at))
        when flip != 0 then transform(sequence(0, parts - 1), o -> struct(
            cast(if(side = 0, pmod(hash(value), parts) * parts + o, o * parts + pmod(hash(value), parts)) as long) as pair, side as at))
        else transform(sequence(0, parts - 1), o -> struct(
            cast(least(pmod(hash(value), parts), o) * parts + greatest(pmod(hash(value), parts), o) as long) as pair,
            if(pmod(hash(value), parts) <= o, 0, 1) as at)) end"""
    )
    rows = rows.select("group", "value", "shift", F.explode(salted).alias("s"))
    rows = rows.select(F.xxhash64("group", "s.pair").alias("key"), F.col("s.at").alias("side"), "value", "shift", F.expr("value ^ (-9223372036854775807L - 1L)").alias("rank"))
    ordered = rows.repartition("key").sortWithinPartitions("key", "side", "rank").select("key", "side", "value", "shift")
    return ordered.mapInArrow(_join_groups, "u long, v long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Per row: id, fingerprint (16 hex digits), component_id (the smallest id reachable over links). Any type that has an order can be the id."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    leaves = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    tied = components(link_forest(leaves.select("fp")))
    roots = tied.select(F.col("u").alias("fp"), F.col("v").alias("root")).unionByName(tied.select(F.col("v").alias("fp"), F.col("v").alias("root")).distinct())
    linked = leaves.join(roots, "fp")
    named = linked.join(linked.groupBy("root").agg(F.min("first_id").alias("least_id")), "root").select("fp", "least_id")
    of = leaves.join(named, "fp", "left").select("fp", F.coalesce("least_id", "first_id").alias("component_id"))
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    of = of.repartition(F.xxhash64("fp"))  # by another key, so that both sides of the join are shuffled and a hot fingerprint can be split
    return rows.join(of, "fp").select(F.col("id").alias(id_col), hexed.alias("fingerprint"), "component_id")


def near_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Links (u, v) of ids that connect the rows of each component of `near_duplicates`."""
    rows = checkpointed(fingerprints(docs, id_col, text_col, shingle))
    leaves = checkpointed(rows.groupBy("fp").agg(F.min("id").alias("first_id")))
    return row_links(rows, leaves, link_forest(leaves.select("fp")))
