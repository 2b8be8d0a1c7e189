"""Phrases whose words occur together, found by dynamic itemset counting.

The corpus is written once as `CYCLE` shards, and each step scans one of them, round and round. Words are counted from
the first step; a longer phrase is counted from the step after both its shorter parts (all but its last and all but
its first word) have reached the least count so far, and until it has seen every shard once, so lengths are counted side
by side in the same scans instead of one length after the other.

What has reached the least count is kept as a filter of fixed size: a slot holds the step at which it was first set,
and a phrase has reached at the latest step of its three slots. All tasks of a step read the same filter and slots never
change once set, so every phrase has one first step that all tasks agree on. A slot shared by chance only lets more
phrases be counted. Counts of a step travel as arrays of hashes, dealt out by the hash, and are added up bucket by
bucket; equal hashes only raise a count. So the steps leave out no phrase that reaches the least count; a last scan
counts those that may by their words, exactly.

Defined results: null and empty texts have no words; a null language is `und`; repeated rows count again. Words are
whole, whatever their length, and phrases end at the ends of pieces and texts. A language without candidates has no
rows; an empty table has none. Other columns are not read.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, checkpointed
from ledgerloom.llm.words import byte_class, chunks, words_of
from ledgerloom.operators.lineage import removed, shared_folder

CYCLE = 4
SPACES = byte_class((0x20, 0x20), (0x09, 0x09))
BREAKS = byte_class((0x0A, 0x0D), *[(ord(c), ord(c)) for c in ".,;:!?"])
#: Bytes of text that a task counts at once.
CHUNK_BYTES = 8 << 20
#: Bytes of shards for each bucket of hashes; slots of the filter for each bucket, and in all at most.
BUCKET_BYTES, BUCKET_SLOTS, MOST_SLOTS = 4 << 20, 1 << 17, 1 << 25
NEVER = 255
#: Parts that the ranking of one language is first dealt into.
RANK_PARTS = 256
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9))
_TURN = np.uint64(31)


def fold(first: np.ndarray, word: np.ndarray) -> np.ndarray:
    """Hashes of phrases from those of all words but the last, and of the last."""
    h = first * _MIX[0] + word
    h = (h ^ (h >> _TURN)) * _MIX[1]
    return h ^ (h >> _TURN)


def placed(h: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket and the 32 bits that stand for the hash within it."""
    bucket = h >> np.uint64(64 - bits) if bits else np.zeros(len(h), np.uint64)
    return bucket.astype(np.int64), (h >> np.uint64(32 - bits)).astype(np.uint32)


def slots_of(rest: np.ndarray, slots: int) -> np.ndarray:
    """Three slots of a bucket for each hash, as rows."""
    wide = rest.astype(np.uint64)
    parts = [wide, wide * _MIX[0] >> np.uint64(40), wide * _MIX[1] >> np.uint64(37)]
    return np.stack([(p % np.uint64(slots)).astype(np.int64) for p in parts])


def reached(filters: np.ndarray, h: np.ndarray, bits: int) -> np.ndarray:
    """The step from which each hash is in the filter (a row of slots for each bucket), or NEVER."""
    bucket, rest = placed(h, bits)
    return filters[bucket, slots_of(rest, filters.shape[1])].max(axis=0) if len(h) else np.zeros(0, np.uint8)


def phrases(texts: pa.Array, langs: pa.Array, filters: dict[int, np.ndarray], bits: int, step: int, longest: int, spelled: bool) -> Iterator[dict]:
    """For each length the distinct phrases of a chunk: hash, count, first step, step reached, and with `spelled` their words and language."""
    from xxhash import xxh64_intdigest

    words = words_of(texts, SPACES, BREAKS)
    if not len(words.text):
        return
    lang = langs.dictionary_encode()
    names = lang.dictionary.to_pylist()
    coded = words.text.dictionary_encode()
    n_words = len(coded.dictionary)
    both = lang.indices.to_numpy(zero_copy_only=False)[words.row].astype(np.int64) * n_words + coded.indices.to_numpy(zero_copy_only=False)
    word, own = pd.factorize(both)
    seeds = [xxh64_intdigest(x) for x in names]
    spell, spoken = coded.dictionary.take(pa.array(own % n_words)), own // n_words
    single = np.array([xxh64_intdigest(w, seed=seeds[k]) for w, k in zip(spell.to_pylist(), spoken.tolist())], np.uint64)

    at, gram, h, start, text = np.arange(len(word)), word, single, np.zeros(len(own), np.uint8), spell
    for n in range(1, longest + 1):
        since = reached(filters[n], h, bits) if n in filters else np.full(len(h), NEVER, np.uint8)
        out = {"length": n, "h": h, "n": np.bincount(gram, minlength=len(h)), "start": start, "reached": since}
        yield out | ({"text": text, "lang": spoken, "names": names} if spelled else {})
        if n == longest or not len(at):
            return
        in_reach = since[gram] <= step
        pair = np.flatnonzero((at[1:] == at[:-1] + 1) & in_reach[1:] & in_reach[:-1])
        pair = pair[words.piece[at[pair]] == words.piece[at[pair] + n]]
        code, found = pd.factorize(gram[pair] * len(own) + word[at[pair] + n])
        some = np.zeros(len(found), np.int64)
        some[code[::-1]] = pair[::-1]
        before, last = found // len(own), found % len(own)
        start = np.maximum(since[before], since[gram[some + 1]])
        if spelled:
            text, spoken = pc.binary_join_element_wise(text.take(pa.array(before)), spell.take(pa.array(last)), pa.scalar(" ", pa.large_string())), spoken[before]
        at, gram, h = at[pair], code, fold(h[before], single[last])


def _column(batch: pa.Table, k: int) -> pa.Array:
    held = batch.column(k).combine_chunks()
    return held.combine_chunks() if isinstance(held, pa.ChunkedArray) else held


def added(table: pa.Table, step: int, slots: int, least: int) -> pa.Table:
    """One bucket's counts with those of the step: sums, the filter's slots, how many reached the least count by this step.

    Phrases that have seen every shard are forgotten: what reached the least count is in the slots.
    """
    out = []
    for length in sorted(set(table["length"].to_pylist())):
        rows = table.filter(pc.equal(table["length"], length)).to_pylist()
        block = next((np.frombuffer(zlib.decompress(r["slots"]), np.uint8).copy() for r in rows if r["slots"]), np.full(slots, NEVER, np.uint8))
        rest = np.concatenate([np.frombuffer(r["rest"], np.uint32) for r in rows])
        n = np.concatenate([np.frombuffer(r["n"], np.uint32) for r in rows])
        start = np.concatenate([np.frombuffer(r["start"], np.uint8) for r in rows])
        order = np.argsort(rest, kind="stable")
        rest, n, start = rest[order], n[order], start[order]
        first = np.flatnonzero(np.append(True, rest[1:] != rest[:-1])) if len(rest) else np.zeros(0, np.int64)
        if len(rest):
            n = np.minimum(np.add.reduceat(n.astype(np.int64), first), np.iinfo(np.uint32).max).astype(np.uint32)
            rest, start = rest[first], np.minimum.reduceat(start, first)
        enough = rest[n >= least]
        where = slots_of(enough, slots)
        new = int((block[where].max(axis=0) == NEVER).sum()) if len(enough) else 0
        flat = where.ravel()
        block[flat[block[flat] == NEVER]] = step + 1
        kept = start.astype(np.int64) > step + 1 - CYCLE
        cells = [table["bucket"][0].as_py(), length, rest[kept].tobytes(), n[kept].tobytes(), start[kept].tobytes(), zlib.compress(block.tobytes(), 1), new]
        out.append(dict(zip(STATE_NAMES, cells)))
    return pa.Table.from_pylist(out, schema=STATE)


STATE = pa.schema([("bucket", pa.int64()), ("length", pa.int32()), ("rest", pa.binary()), ("n", pa.binary()), ("start", pa.binary()), ("slots", pa.binary()), ("new", pa.int64())])
STATE_NAMES = STATE.names
STATE_DDL = "bucket long, length int, rest binary, n binary, start binary, slots binary, new long"


def _scan(shard: DataFrame, filters, bits: int, step: int, longest: int) -> DataFrame:
    """Counts of the phrases that are counted in this step, as arrays for each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches, 1, CHUNK_BYTES):
            for found in phrases(_column(chunk, 1), _column(chunk, 0), filters.value, bits, step, longest, spelled=False):
                counted = found["start"].astype(np.int64) > step - CYCLE
                bucket, rest = placed(found["h"][counted], bits)
                order = np.argsort(bucket, kind="stable")
                n, start = found["n"][counted].astype(np.uint32)[order], found["start"][counted][order]
                rest, cut = rest[order], np.searchsorted(bucket[order], np.arange((1 << bits) + 1))
                held = [b for b in range(1 << bits) if cut[b] < cut[b + 1]]
                piece = lambda x: pa.array([x[cut[b] : cut[b + 1]].tobytes() for b in held], pa.binary())
                empty = pa.nulls(len(held), pa.binary())
                cells = [pa.array(held, pa.int64()), pa.array([found["length"]] * len(held), pa.int32()), piece(rest), piece(n), piece(start), empty, pa.nulls(len(held), pa.int64())]
                yield pa.RecordBatch.from_arrays(cells, schema=STATE)

    return shard.mapInArrow(run, STATE_DDL)


def _adder(step: int, slots: int, least: int):
    return lambda table: added(table, step, slots, least)


def _spelled(docs: DataFrame, filters, bits: int, step: int, longest: int) -> DataFrame:
    """Exact counts (lang, length, phrase, n) of all phrases in the filters; length 0 counts all words of a language."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["lang", "length", "phrase", "n"]
        for chunk in chunks(batches, 1, CHUNK_BYTES):
            for found in phrases(_column(chunk, 1), _column(chunk, 0), filters.value, bits, step, longest, spelled=True):
                lang = pa.array(found["names"], pa.string())
                if found["length"] == 1:
                    total = np.bincount(found["lang"], weights=found["n"], minlength=len(lang)).astype(np.int64)
                    yield pa.RecordBatch.from_arrays([lang, pa.array([0] * len(lang), pa.int32()), pa.array([""] * len(lang), pa.string()), pa.array(total)], names=names)
                kept = np.flatnonzero(found["reached"] <= step)
                for k in range(0, len(kept), 1 << 16):
                    some = kept[k : k + (1 << 16)]
                    cells = [lang.take(pa.array(found["lang"][some])), pa.array(np.full(len(some), found["length"], np.int32))]
                    cells += [found["text"].take(pa.array(some)).cast(pa.string()), pa.array(found["n"][some].astype(np.int64))]
                    yield pa.RecordBatch.from_arrays(cells, names=names)

    return docs.mapInArrow(run, "lang string, length int, phrase string, n long").groupBy("lang", "length", "phrase").agg(F.sum("n").alias("n"))


def phrase_counts(docs: DataFrame, longest: int = 3, least: int = 10, lang: str = "lang", text: str = "text") -> DataFrame:
    """lang, length, phrase, n: every phrase of up to `longest` words that occurs `least` times; length 0 has the number of words."""
    spark: SparkSession = docs.sparkSession
    bounded_batches(spark)
    folder = f"{shared_folder(spark)}/phrases-{uuid.uuid4().hex}"
    rows = docs.select(F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"), F.coalesce(text, F.lit("")).alias("text"))
    rows.withColumn("shard", F.pmod(F.monotonically_increasing_id(), F.lit(CYCLE)).cast("int")).write.partitionBy("shard").parquet(f"{folder}/shards")
    shards = spark.read.schema("lang string, text string, shard int").parquet(f"{folder}/shards")
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/shards")
    size = path.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(path).getLength()
    bits = max(4, (max(size // BUCKET_BYTES, 1) - 1).bit_length())
    slots = max(min(BUCKET_SLOTS, MOST_SLOTS >> bits), 8)

    filters = {n: np.full((1 << bits, slots), NEVER, np.uint8) for n in range(1, longest + 1)}
    state, new, step = None, {}, 0
    while step < CYCLE or any(new.get((n, s)) for n in range(1, longest) for s in range(step - CYCLE + 1, step + 1)):
        shared = spark.sparkContext.broadcast({n: filters[n] for n in range(1, longest)})
        counts = _scan(shards.where(F.col("shard") == step % CYCLE).select("lang", "text"), shared, bits, step, longest)
        counts = counts if state is None else counts.unionByName(state)
        out = f"{folder}/state-{step}"
        counts.groupBy("bucket").applyInArrow(_adder(step, slots, least), STATE_DDL).write.parquet(out)
        if step:
            removed(spark, f"{folder}/state-{step - 1}")
        shared.destroy()
        state = spark.read.schema(STATE_DDL).parquet(out)
        for r in state.select("bucket", "length", "slots", "new").collect():
            filters[r.length][r.bucket] = np.frombuffer(zlib.decompress(r.slots), np.uint8)
            new[r.length, step + 1] = new.get((r.length, step + 1), 0) + r.new
        step += 1
    shared = spark.sparkContext.broadcast(filters)
    found = checkpointed(_spelled(shards.select("lang", "text"), shared, bits, step, longest).where((F.col("n") >= least) | (F.col("length") == 0)))
    shared.destroy()
    removed(spark, folder)
    return found


def _wide(c: Column) -> Column:
    return c.cast("decimal(18,0)")


def collocations(counts: DataFrame, strong: int = 50, top: int = 2000) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of the best phrases of each language, from `phrase_counts`.

    A phrase scores by its weakest cut. One that lies in a longer phrase with `strong` % of its count is left out.
    """
    parts = counts.where("length > 0").select("lang", F.col("phrase").alias("part"), F.col("n").alias("count"))
    words = F.split("phrase", " ")
    longer = counts.where("length > 1").withColumns({"words": words, "a": F.col("n")}).select("lang", "phrase", "length", "words", "a")
    cuts = longer.select("lang", "phrase", "length", "words", "a", F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    said = lambda first, n: F.array_join(F.slice("words", first, n), " ")
    cuts = cuts.select("lang", "phrase", "length", "a", "k", said(1, F.col("k")).alias("first"), said(F.col("k") + 1, F.col("length") - F.col("k")).alias("rest"))
    cuts = cuts.join(parts.withColumnsRenamed({"part": "first", "count": "l"}), ["lang", "first"]).join(parts.withColumnsRenamed({"part": "rest", "count": "r"}), ["lang", "rest"])
    million = F.lit(1_000_000).cast("decimal(7,0)")
    score = F.call_function("div", million * _wide(F.col("a")) * F.col("a").cast("decimal(13,0)"), _wide(F.col("l")) * _wide(F.col("r")))
    cuts = cuts.withColumn("score", score)
    best = cuts.groupBy("lang", "phrase", "length", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))

    spans = F.expr("flatten(transform(sequence(2, length - 1), m -> transform(sequence(1, length - m + 1), i -> array_join(slice(words, i, m), ' '))))")
    inside = longer.where("length > 2").select("lang", "a", F.explode(spans).alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("a").alias("longer"))
    left = best.join(inside, ["lang", "phrase"], "left").where(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(strong) * F.col("a")))

    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase")]
    left = left.select("lang", "phrase", "a", F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), F.col("cut.score").alias("score"))
    dealt = left.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    dealt = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
    ranked = dealt.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    totals = counts.where("length = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def mine_collocations(docs: DataFrame, longest: int = 3, least: int = 10, strong: int = 50, top: int = 2000, lang: str = "lang", text: str = "text") -> DataFrame:
    return collocations(phrase_counts(docs, longest, least, lang, text), strong, top)
