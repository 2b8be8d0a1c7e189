"""The registered corpus queries on the smallest tables: contract columns, SQL where there is some, planted facts."""

import os

import duckdb
import pytest

from ledgerloom.llm.queries import oracle_sql, queries

DATA = "/root/testdata/sf0.001"
COLUMNS = {
    "op1_token_counts": ["doc_id bigint", "n_bytes bigint", "n_tokens bigint", "over_limit boolean"],
    "op2_language_id": ["doc_id bigint", "held_out boolean", "lang_pred string", "score double"],
    "op3_html_extraction": ["page_id bigint", "url string", "text string", "n_chars bigint"],
    "op4_top_k": ["query_id bigint", "rank int", "vec_id bigint", "score bigint"],
    "op5_quality": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op6_url_filter": ["page_id bigint", "host string", "path string", "rule string", "verdict string"],
    "op7_toxicity": ["doc_id bigint", "held_out boolean", "score double", "predicted int"],
    "op8_decontamination": ["doc_id bigint", "n_words bigint", "n_hit bigint", "n_items bigint", "items_sha256 string", "contaminated boolean"],
    "op9_simhash": ["doc_id bigint", "fingerprint string", "component_id bigint"],
    "op10_packing": ["doc_id bigint", "start bigint", "length bigint", "ids_crc32 bigint", "doc_tokens bigint", "sequence_id bigint", "offset bigint"],
    "op11_collocations": ["lang string", "rank bigint", "phrase string", "a bigint", "l bigint", "r bigint", "n bigint", "score bigint"],
    "op12_sharding": ["doc_id bigint", "size bigint", "text_crc32 bigint", "law string", "shard int", "slot bigint", "grown_shard int"],
    "op13_divergence": ["lang string", "source string", "part string", "item string", "value bigint", "rank int"],
}


@pytest.mark.parametrize("name", list(COLUMNS))
def test_columns_and_rows(spark, name):
    out = queries()[name](spark, DATA).cache()
    kinds = [f"{c} {k}" for c, k in out.dtypes]
    assert kinds[: len(COLUMNS[name])] == COLUMNS[name]
    documents, pages = (spark.read.parquet(f"{DATA}/{t}.parquet").count() for t in ("documents", "pages"))
    if name not in ("op4_top_k", "op10_packing", "op11_collocations", "op13_divergence"):
        assert out.count() == (pages if "page_id" in out.columns else documents)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql(spark, tmp_path, name):
    duck = duckdb.connect()
    for file in os.listdir(DATA):
        duck.execute(f"create view {file.split('.')[0]} as select * from '{DATA}/{file}'")
    queries()[name](spark, DATA).write.parquet(f"{tmp_path}/out")
    duck.execute(f"create table want as {oracle_sql()[name]}")
    duck.execute(f"create table got as select * from '{tmp_path}/out/*.parquet'")
    names = ", ".join(f'"{r[0]}"' for r in duck.execute("describe want").fetchall())
    for a, b in (("want", "got"), ("got", "want")):
        assert duck.execute(f"select {names} from {a} except all select {names} from {b} limit 3").fetchall() == []


def test_held_out_accuracy(spark):
    data = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{data}/documents.parquet").select("doc_id", "lang")
    found = queries()["op2_language_id"](spark, data).join(docs, "doc_id").where("held_out")
    assert found.where("lang = lang_pred").count() >= 0.99 * found.count()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    scored = queries()["op5_quality"](spark, data).join(labels, "doc_id").where("held_out")
    assert scored.where("predicted = quality").count() >= 0.9 * scored.count()
