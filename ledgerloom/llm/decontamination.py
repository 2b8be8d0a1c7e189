"""Benchmark decontamination by winnowing, in DataFrame operations only.

A text's fingerprints are the smallest `GRAM`-word hashes of its windows of `WINDOW` such grams, hence of its stretches
of `SPAN` = 13 words; neighbouring windows mostly share their minimum, and each run of equal minima is kept once, with
the stretches it stands for. Equal stretches have equal fingerprints, so joining the two sides' fingerprints finds
every shared stretch of `SPAN` words or more; each find is then extended: the 13 words of its run's stretches are
compared, and overlapping hits add up to whole shared passages. Items too short for a window are looked up by all
grams of their own length.

Defined results: a null or empty text has no words, is never hit and has no items. Repeated documents and ids each
give a row; repeated benchmark items each count, null item ids never do. Words longer than any limit are words still.
The benchmark side is broadcast only when its windows take at most `MOST_BROADCAST` bytes; else both joins shuffle, of
the documents' side only ids, places and fingerprints. The items of one window, and of one document, are one list.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import checkpointed

SPAN = 13
GRAM = 8
WINDOW = SPAN - GRAM + 1
#: Bytes of windows, words and item ids included, that a broadcast may hold.
MOST_BROADCAST = 64 << 20
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """ASCII lower-cased words; no words for a null."""
    return F.array_remove(F.split(F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER), BETWEEN), "")


def _shifted(column: str, by: int) -> Column:
    return F.slice(F.col(column), by + 1, 1 << 30)


def with_fingerprints(rows: DataFrame) -> DataFrame:
    """`mins`: for each stretch of 13 words its smallest gram hash (empty for fewer words)."""
    rows = rows.withColumn("h", F.transform("words", lambda w: F.xxhash64(w)))
    n = 1
    while n < GRAM:
        rows = rows.withColumn("h", F.zip_with("h", _shifted("h", n), lambda a, b: F.xxhash64(a, b)))
        n *= 2
    rows = rows.withColumn("h", F.zip_with("h", _shifted("h", 1), lambda a, b: F.least(a, b)))
    rows = rows.withColumn("h", F.zip_with("h", _shifted("h", 1), lambda a, b: F.least(a, b)))
    rows = rows.withColumn("h", F.zip_with("h", _shifted("h", 3), lambda a, b: F.least(a, b)))
    return rows.withColumn("mins", F.expr(f"slice(h, 1, greatest(size(words) - {SPAN - 1}, 0))")).drop("h")


def _windows(benchmark: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """Distinct windows of the items: found (hash), len, window (words), items (ids as strings)."""
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), words_of(F.col(item_text)).alias("words"))
    items = items.where("item is not null and size(words) > 0").withColumn("len", F.least(F.size("words"), F.lit(SPAN)))
    cut = items.select("item", "len", "words", F.explode(F.expr("sequence(1, size(words) - len + 1)")).alias("at"))
    cut = cut.select("item", "len", F.expr("slice(words, at, len)").alias("window"))
    distinct = cut.groupBy("len", "window").agg(F.collect_set("item").alias("items"))
    return distinct.select(F.xxhash64("len", "window").alias("found"), "len", "window", "items")


def with_runs(rows: DataFrame) -> DataFrame:
    """`runs` in place of `mins`: the winnowed fingerprints, each with the stretches (`from` to `to`, from 1) whose minimum it is."""
    starts = "filter(sequence(1, size(mins)), i -> i = 1 or mins[i - 1] != mins[i - 2])"
    rows = rows.withColumn("starts", F.expr(f"if(size(mins) = 0, cast(array() as array<int>), {starts})"))
    runs = "transform(starts, (s, k) -> struct(s as from, coalesce(get(starts, k + 1), size(mins) + 1) - 1 as to, mins[s - 1] as print))"
    return rows.withColumn("runs", F.expr(runs)).drop("starts", "mins")


def _near(rows: DataFrame, keys: DataFrame, bounded: bool) -> DataFrame:
    """Stretches whose fingerprint an item has, and one row of each document in any case."""
    window = F.expr(f"slice(words, at, {SPAN})").alias("window")
    at = F.explode(F.expr("sequence(run.from, run.to)")).alias("at")
    each = rows.select("id", "same", "n_words", "words", F.posexplode_outer("runs").alias("pos", "run")).withColumn("first", F.coalesce(F.col("pos"), F.lit(0)) == 0)
    if bounded:
        found = each.join(F.broadcast(keys.withColumn("hit", F.lit(True))), F.col("run.print") == F.col("print"), "left").where("hit or first")
        places = F.expr("if(hit, sequence(run.from, run.to), array(cast(null as int)))")
        found = found.select("id", "same", "n_words", "words", "first", "hit", F.posexplode(places).alias("nth", "at"))
        return found.select("id", "same", "n_words", (F.col("first") & (F.col("nth") == 0)).alias("first"), "at", F.when(F.col("at").isNotNull(), window).alias("window"))
    found = each.where("run is not null").select("id", "same", "run").join(keys, F.col("run.print") == F.col("print")).select("id", "same", at)
    found = found.groupBy("id", "same").agg(F.collect_set("at").alias("ats")).withColumnsRenamed({"id": "id2", "same": "same2"})
    back = rows.join(found, F.col("id").eqNullSafe(F.col("id2")) & (F.col("same") == F.col("same2")), "left")
    return back.select("id", "same", "n_words", "words", F.posexplode_outer("ats").alias("pos", "at")).select(
        "id", "same", "n_words", (F.coalesce(F.col("pos"), F.lit(0)) == 0).alias("first"), "at", window
    )


def _near_short(rows: DataFrame, windows: DataFrame, lengths: list[int], bounded: bool) -> DataFrame:
    """Runs of the lengths of short items whose hash one of those items has."""
    keys = windows.where(F.col("len") < SPAN).select("len", "found")
    grams = [
        F.when(F.col("n_words") >= n, F.expr(f"transform(sequence(1, n_words - {n - 1}), i -> struct({n} as len, i as at, xxhash64({n}, slice(words, i, {n})) as found))"))
        for n in lengths
    ]
    every = F.flatten(F.array_compact(F.array(*grams)))
    each = rows.select("id", "same", "n_words", "words", F.explode(every).alias("g")).select("id", "same", "n_words", "words", "g.*")
    found = each.join(F.broadcast(keys) if bounded else keys, ["len", "found"], "left_semi")
    return found.select("id", "same", "n_words", F.lit(False).alias("first"), "at", F.expr("slice(words, at, len)").alias("window"))


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text"
) -> DataFrame:
    """Per document: id, n_words, spans (hit words from and to, counted from 1, merged), n_hit, item_ids (sorted as strings)."""
    windows = checkpointed(_windows(benchmark, item_id, item_text))
    taken = F.octet_length(F.array_join("window", "")) + 16 * F.col("len") + F.octet_length(F.array_join("items", "")) + 16 * F.size("items") + 64
    size = windows.agg(F.coalesce(F.sum(taken), F.lit(0)), F.sort_array(F.collect_set(F.when(F.col("len") < SPAN, F.col("len"))))).first()
    bounded, short = size[0] <= MOST_BROADCAST, size[1]
    keys = with_fingerprints(windows.where(F.col("len") == SPAN).select(F.col("window").alias("words"))).select(F.explode("mins").alias("print")).distinct()

    rows = docs.select(F.col(id_col).alias("id"), words_of(F.col(text_col)).alias("words"))
    rows = rows.withColumn("n_words", F.size("words")).withColumn("same", F.xxhash64("words"))
    near = _near(with_runs(with_fingerprints(rows)), keys, bounded)
    if short:
        near = near.unionByName(_near_short(rows, windows, short, bounded))
    near = near.withColumn("found", F.when(F.col("window").isNotNull(), F.xxhash64(F.size("window"), "window")))
    known = windows.select("found", F.col("window").alias("item_window"), "items")
    hits = near.join(F.broadcast(known) if bounded else known, "found", "left")
    hit = F.col("window") == F.col("item_window")
    ends = F.struct(F.col("at").alias("from"), (F.col("at") + F.size("window") - 1).alias("to"))
    summed = hits.groupBy("id", "same", "n_words").agg(
        F.sum(F.col("first").cast("int")).alias("copies"),
        F.collect_set(F.when(hit, ends)).alias("hits"),
        F.collect_set(F.when(hit, F.col("items"))).alias("items"),
    )
    spans = F.expr(
        """aggregate(sort_array(hits), cast(array() as array<struct<from: int, to: int>>), (s, x) ->
        if(size(s) > 0 and x.from <= element_at(s, -1).to + 1,
           concat(slice(s, 1, size(s) - 1), array(struct(element_at(s, -1).from as from, greatest(element_at(s, -1).to, x.to) as to))),
           concat(s, array(struct(x.from as from, x.to as to)))))"""
    )
    summed = summed.withColumn("spans", spans).withColumn("copy", F.explode(F.expr("sequence(1, copies)")))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.to - s.from + 1)")
    return summed.select(
        F.col("id").alias(id_col), F.col("n_words").cast("long").alias("n_words"), "spans", n_hit.alias("n_hit"), F.sort_array(F.array_distinct(F.flatten("items"))).alias("item_ids")
    )
