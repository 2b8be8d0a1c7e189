import random
from collections import Counter

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from ledgerloom.llm.packing import Encoder
from tests.llm.test_classifiers import BAD, say
from tests.llm.test_decontamination import brute as brute_hits
from ledgerloom.llm.simhash import fingerprint
from tests.llm.test_simhash import brute_fingerprint


def brute_near_copies(docs):
    """Ids that stay: the smallest of each group over two fingerprint bits or a similarity of 0.8."""
    assert all(fingerprint(t, 3) == brute_fingerprint(t) for t in list(docs.values())[:20])

    def least(ids, linked):
        group = {i: i for i in ids}
        for n, i in enumerate(ids):
            for j in ids[:n]:
                if group[i] != group[j] and linked(i, j):
                    a, b = group[i], group[j]
                    group = {k: min(a, b) if g in (a, b) else g for k, g in group.items()}
        return sorted(set(group.values()))

    prints = {i: fingerprint(t, 5) for i, t in docs.items()}
    words = {i: t.encode().lower().split() for i, t in docs.items()}
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(len(w) - 4, 1))} for i, w in words.items()}
    near = lambda i, j: (prints[i] ^ prints[j]).bit_count() <= 2 or 10 * len(sets[i] & sets[j]) >= 8 * len(sets[i] | sets[j])
    return set(least(sorted(docs), near))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(11)
    out = str(tmp_path_factory.mktemp("tables"))
    items = [(i, say(rng, "xx", 30)) for i in range(5)]
    docs = [(i, say(rng, rng.choice(["xx", "yy", "zz"]), rng.choice([60, 120]))) for i in range(400)]
    toxic = set(range(0, 400, 8))
    for i in toxic:
        words = docs[i][1].split()
        for _ in range(4):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        docs[i] = (i, " ".join(words))
    docs += [(1000 + k, docs[1][1]) for k in range(40)]
    long = docs[3][1].split()
    docs += [(1100 + k, " ".join(long[:-k])) for k in range(1, 6)]
    docs += [(2000 + k, items[k][1] + " " + say(rng, "xx", 20)) for k in range(5)]
    docs += [(3000, None), (3001, "12 34"), (3002, "")]
    rows = [(i, t, "xx", "s", len(t or ""), "kept") for i, t in docs]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string").repartition(3).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    spark.createDataFrame([(i, int(i in toxic), 1) for i in range(400)], "doc_id long, toxic int, quality int").write.parquet(f"{out}/labels.parquet")
    return out, dict(docs), toxic, items


def test_stages_and_result(spark, folder):
    path, docs, toxic, items = folder
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "simhash_near_dedup", "benchmark_decontamination", "packing"]
    frame = spark.read.parquet(f"{path}/documents.parquet")
    columns, left = frame.columns, [frame]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, left[-1], path).cache()
        assert out.columns == columns
        left.append(out)
    ids = [{r.doc_id for r in f.select("doc_id").collect()} for f in left]
    assert len(ids[0] - ids[1] - toxic) <= 2 and len(toxic & ids[1]) <= 2
    assert ids[1] - ids[2] == {i for i in (3000, 3001, 3002) if i in ids[1]}
    kept = sorted(ids[2])
    assert ids[3] == brute_near_copies({i: docs[i] for i in kept}) and not any(i >= 1000 and i < 2000 for i in ids[3])
    hit = {k for k, n, h, _ in brute_hits([(i, docs[i]) for i in ids[3]], items) if h and 20 * h >= n}
    assert ids[4] == ids[3] - hit and hit >= {2000, 2001, 2002, 2003, 2004}
    encoder = Encoder(corpus_pipeline.public_tokenizers.path("byte_bpe_50k.json"))
    packed = Counter()
    for r in corpus_pipeline.packed(spark, left[-1], path).collect():
        packed[r.doc_id] += r.length
    assert packed == {i: len(encoder.ids(docs[i])) + 1 for i in ids[4]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, path).collect()} == ids[4]


def test_repeated_ids_and_null_ids(spark, folder):
    path, *_ , items = folder
    other, third, hit = "other words stand here now", "third text of the same id", items[0][1]
    rows = [(1, "a b c d e", "x"), (1, "a b c d e", "x"), (2, "a b c d e", "y"), (1, other, "x"), (3, third, "x"), (3, hit, "x"), (None, "no id", "x"), (None, "no id", "x"), (None, third, "z"), (None, None, "x"), (5, None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, score string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.drop_near_copies(spark, df, path).collect())
    assert got == sorted([(-1, "no id"), (-1, ""), (-1, third), (1, "a b c d e"), (1, other), (3, hit)])
    left = sorted((-1 if r.doc_id is None else r.doc_id, r.text or "") for r in corpus_pipeline.drop_contaminated(spark, df, path).collect())
    assert left == sorted((-1 if i is None else i, t or "") for i, t, _ in rows if t != hit)


def test_empty_tables_and_odd_columns(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").withColumn("component_id", F.lit("c")).withColumn("n_words", F.lit(None).cast("int"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs.where("false"), path)
        assert out.columns == docs.columns and out.collect() == []
        assert stage(spark, docs.where("doc_id < 40 or doc_id >= 3000"), path).columns == docs.columns
    assert corpus_pipeline.packed(spark, docs.where("false"), path).collect() == []


def test_a_hostile_text_does_not_stop_the_job(spark, folder):
    path, *_ = folder
    docs = spark.read.parquet(f"{path}/documents.parquet").where("doc_id = 1").withColumn("text", F.concat(F.repeat(F.lit(" "), 1_100_000), "text"))
    for _, stage in corpus_pipeline.STAGES[2:]:
        docs = stage(spark, docs, path)
    assert docs.count() > 500


def test_texts_too_short_for_evidence_stay(spark, folder):
    path, *_ = folder
    rows = [(9000, "A.", "xx"), (9001, "Qx", "xx"), (9002, "Wq zj", "xx"), (9003, "1.", "xx"), (9004, "", "xx"), (9005, "wqzj pfgb vwxk hjqz " * 9, "xx")]
    docs = spark.read.parquet(f"{path}/documents.parquet").select("doc_id", "text", "lang").where("doc_id < 400")
    kept = corpus_pipeline.keep_known_languages(spark, docs.unionByName(spark.createDataFrame(rows, docs.schema)), path)
    assert sorted(r.doc_id for r in kept.where("doc_id >= 9000").collect()) == [9000, 9001, 9002]
