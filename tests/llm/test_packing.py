import json
import os
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerloom.llm.packing import Encoder, merges_alone, pack

os.environ["TOKENIZERS_PARALLELISM"] = "false"
PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def library_ids(text):
    return [*LIBRARY.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_are_the_librarys():
    library, own = LIBRARY, Encoder(PATH)
    rng = random.Random(3)
    points = [rng.randrange(0x20, 0x3000) for _ in range(4000)] + [0x1F600, 0x85, 0xA0, 0x2003, 0x180E]
    for at in range(0, len(points), 50):
        text = "".join(map(chr, points[at : at + 50])) + " it's <|endoftext|> 12\n\n  x"
        assert own.ids(text).tolist() == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("length,most_open,parts", [(32, 4, 3), (64, 1, 5), (2048, 32, 2)])
def test_every_id_once_without_gaps(spark, length, most_open, parts):
    rng = random.Random(length)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "gamma", "é", "12"]) for _ in range(rng.choice([0, 1, 5, 20, 90, 400])))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (1002, "word " * 3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(parts, "doc_id")
    got = pack(df, PATH, length=length, most_open=most_open, merge_fan=2).collect()
    docs, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        ids = np.frombuffer(r.ids, dtype="<u4").tolist()
        assert len(ids) == r.length > 0
        docs[r.doc_id].append((r.start, ids, r.doc_tokens))
        sequences[r.sequence_id].append((r.offset, r.length))
    for key, text in rows:
        pieces = sorted(docs[key])
        want = library_ids(text)
        assert [i for _, ids, _ in pieces for i in ids] == want
        assert [s for s, _, _ in pieces] == np.cumsum([0, *(len(ids) for _, ids, _ in pieces)])[:-1].tolist()
        assert {n for _, _, n in pieces} == {len(want)}
    short = 0
    for placed in sequences.values():
        at = 0
        for offset, n in sorted(placed):
            assert offset == at
            at += n
        assert at <= length
        short += at < length
    assert short <= -(-parts // 2)


def test_repeated_ids_and_empty_tables(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "c")], "doc_id long, text string")
    assert sum(r.length for r in pack(df, PATH).collect()) == 2 * len(library_ids("a b")) + len(library_ids("c"))
    assert pack(df.where("false"), PATH).collect() == []


@pytest.mark.parametrize("text", [" " * 2_000_000, "x" + "\n\t" * 600_000 + "y", "a" * 100_000], ids=["spaces", "lines", "letters"])
def test_very_long_runs(text):
    assert np.array_equal(Encoder(PATH).ids(text), np.array(LIBRARY.encode(text, add_special_tokens=False).ids))


def test_very_long_runs_are_packed(spark):
    rows = [(1, " " * 1_100_000), (2, "plain words")]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string"), PATH).collect()
    for key, text in rows:
        pieces = sorted((r.start, r.ids) for r in got if r.doc_id == key)
        assert np.array_equal(np.concatenate([np.frombuffer(x, "<u4") for _, x in pieces]), np.array(library_ids(text)))


def test_settings_that_merges_do_not_cover():
    with open(PATH, encoding="utf-8") as f:
        spec = json.load(f)
    assert merges_alone(spec)
    for change in ({"normalizer": {"type": "Lowercase"}}, {"pre_tokenizer": {"type": "Whitespace"}}, {"added_tokens": [dict(spec["added_tokens"][0], lstrip=True)]}):
        assert not merges_alone(spec | change)
    assert not merges_alone(spec | {"model": spec["model"] | {"ignore_merges": True}})
