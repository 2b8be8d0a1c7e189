"""A corpus pipeline: toxicity, language, near duplicates, benchmark passages, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of their input.
`run` writes each stage's result as Parquet in the cluster's shared folder and reads it again for the next; once the
next is written, a stage's folder is deleted.

Every decision is a row's own. Rows are named by their id and a hash of their text (`KEY`), nulls included, so rows
that repeat an id with other texts are judged apart; of rows that repeat id and text one stays. Null and empty texts:
the first stage scores them as texts without words, the second rejects them (no letter). Texts of any length are taken
whole. Empty tables pass through every stage as empty tables.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import reduce

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm import near_copies, simhash
from ledgerloom.llm.common import checkpointed, held_out, table
from ledgerloom.llm.components import components
from ledgerloom.llm.decontamination import decontaminate
from ledgerloom.llm.language_id import identify, train_languages
from ledgerloom.llm.packing import pack
from ledgerloom.llm.toxicity import toxicity_scores, train_toxicity
from ledgerloom.operators.lineage import removed, shared_folder

TOXIC_FROM = 0.5
#: A text of which the best language knows less than this share of its n-grams is in none of the learned languages.
LEAST_COVERAGE = 0.05
#: With fewer n-grams than this, unknown ones are no evidence: one rare word or a name can hold them all.
LEAST_GRAMS = 20
#: Words of a shingle in the near-duplicate stage.
SHINGLE = 5
#: Keys that a broadcast may hold; more are joined by a shuffle.
MOST_BROADCAST = 500_000
KEY = "__row_key"


def keyed(docs: DataFrame) -> DataFrame:
    """The rows with their name: id and a hash of the text, in that order; nulls are values of it like any other."""
    return docs.withColumn(KEY, F.struct(F.col("doc_id").alias("id"), F.xxhash64("text").alias("hash")))


def without(docs: DataFrame, keys: DataFrame) -> DataFrame:
    """The rows of keyed `docs` whose key isn't among `keys`."""
    keys = checkpointed(keys.select(KEY).distinct())
    return docs.join(F.broadcast(keys) if keys.count() <= MOST_BROADCAST else keys, KEY, "left_anti")


def one_of_each(docs: DataFrame, links: list[DataFrame]) -> DataFrame:
    """Of keyed `docs` the rows of the smallest key of each group, once; a group is what all of `links` connect.

    Each of `links` has pairs (u, v) of keys. Components are found once, over all of them, and this works on copies
    alone. Rows that repeat a key are reduced to one within each task before they are shuffled, so a hot row costs no
    more than any other.
    """
    pairs = checkpointed(reduce(DataFrame.unionByName, links).distinct())
    tied = components(pairs.select(F.xxhash64("u").alias("u"), F.xxhash64("v").alias("v")))
    names = pairs.select(F.explode(F.array("u", "v")).alias(KEY)).distinct()
    named = names.withColumn("u", F.xxhash64(KEY)).join(tied, "u", "left")
    named = checkpointed(named.select(KEY, F.coalesce("v", "u").alias("group")))
    least = named.groupBy("group").agg(F.min(KEY).alias("least"))
    left = without(docs, named.join(least, "group").where(F.col(KEY) != F.col("least")))

    repeated = checkpointed(docs.groupBy(KEY).agg(F.count(F.lit(1)).alias("times")).where("times > 1").select(KEY))
    if repeated.isEmpty():
        return left
    many = F.broadcast(repeated) if repeated.count() <= MOST_BROADCAST else repeated
    single, columns = left.join(many, KEY, "left_anti"), [c for c in docs.columns if c != KEY]
    first = left.join(many, KEY, "left_semi").groupBy(KEY).agg(F.first(F.struct(*columns)).alias("row"))
    return single.unionByName(first.select(KEY, "row.*"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = table(spark, sf_dir, "labels", "doc_id", "toxic")
    model = train_toxicity(docs, labels.where(~held_out("doc_id", 5, 0)))
    scored = toxicity_scores(docs, model, keep=tuple(docs.columns), name="__toxicity")
    return scored.where(F.col("__toxicity") < TOXIC_FROM).select(*docs.columns)


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train_languages(docs.where(~held_out("doc_id", 3, 1)))
    found = identify(docs, model, keep=tuple(docs.columns), prefix="__")
    known = (F.col("__coverage") >= LEAST_COVERAGE) | (F.col("__grams") < LEAST_GRAMS)
    return found.where((F.col("__lang_pred") != "und") & known).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, that of the smallest id.

    Links are those of the SimHash join (two bits at most) and, as most copies whose sets of shingles are similar to 0.8
    or more differ by more bits, those of an exact similarity join of the shingles.
    """
    rows = keyed(docs)
    links = [simhash.near_links(rows, KEY, shingle=SHINGLE), near_copies.near_links(rows, KEY)]
    return one_of_each(rows, links).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate(keyed(docs), table(spark, sf_dir, "benchmark", "item_id", "text"), KEY)
    return without(keyed(docs), found.where((F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))).select(*docs.columns)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    pieces = pack(docs, public_tokenizers.path("byte_bpe_50k.json"))
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("language_id", keep_known_languages),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("packing", packed),
]

#: SQL can express neither the trained models nor the fingerprints' hash; tests hold the pipeline against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for k, (name, stage) in enumerate(STAGES):
        out = f"{folder}/{k}-{name}"
        stage(spark, docs, sf_dir).write.parquet(out)
        if before:
            removed(spark, before)
        docs, before = spark.read.parquet(out), out
    return docs
