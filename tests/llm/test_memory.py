"""What long stages hold in memory and on disk."""

import corpus_pipeline
import public_tokenizers

from ledgerloom.llm import near_copies, simhash
from ledgerloom.llm.components import components
from ledgerloom.llm.packing import Encoder


def test_the_library_is_not_loaded_beside_the_faster_engine():
    encoder = Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert len(encoder.ids("plain words")) and "library" not in vars(encoder)


def test_rounds_of_components_leave_no_garbage_behind(spark, monkeypatch):
    from ledgerloom.llm import components as module

    calls, released = [], module.released
    monkeypatch.setattr(module, "released", lambda s: (calls.append(1), released(s)))
    chain = spark.createDataFrame([(i, i + 1) for i in range(40)], "u long, v long")
    assert {tuple(r) for r in components(chain).collect()} == {(i, 0) for i in range(1, 41)}
    assert len(calls) >= 2


def test_near_copies_find_components_twice_at_most(spark, monkeypatch):
    """Each round of components leaves the driver thousands of tasks to remember, where a shuffle has hundreds of parts."""
    calls = []

    def counted(edges, find=components):
        calls.append(1)
        return find(edges)

    for module in (corpus_pipeline, near_copies, simhash):
        monkeypatch.setattr(module, "components", counted)
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join(words), " ".join([*words, "more"]), "quite another text of some words", " ".join(words[:-1]), "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    kept = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert sorted(r.doc_id for r in kept.collect()) == [0, 3, 5]
    assert len(calls) == 2


def test_links_connect_the_rows_of_each_component(spark):
    words = [f"w{i}" for i in range(60)]
    texts = [" ".join(words), " ".join([*words, "more"]), "a b c d e f", "a b c d e f", "another one", "", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    for links, named in ((near_copies.near_links, near_copies.near_copies), (simhash.near_links, simhash.near_duplicates)):
        tied = {r.u: r.v for r in components(links(docs)).collect()}
        assert {r.doc_id: r.component_id for r in named(docs).collect()} == {i: tied.get(i, i) for i in range(len(texts))}
        assert links(docs.where("false")).collect() == []
