import random

import corpus_pipeline
import pytest

from ledgerloom.llm import near_copies


def brute_sets(texts):
    out = []
    for t in texts:
        w = (t or "").lower().split()
        out.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    return out


def brute_roots(texts):
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = brute_sets(texts)
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(texts))]


def edited(rng, words, vocabulary, edits):
    words = list(words)
    for _ in range(edits):
        at = rng.randrange(len(words))
        words[at : at + rng.choice([0, 1])] = [rng.choice(vocabulary)]
    return words


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(200)]
    line = [rng.choice(vocabulary) for _ in range(12)]
    out = []
    for k in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([4, 8, 9, 30, 90, 200]))]
        out += [" ".join(base), " ".join(base + line), " ".join(edited(rng, base, vocabulary, 1)), " ".join(edited(rng, base, vocabulary, len(base) // 40 + 1))]
    chain = [rng.choice(vocabulary) for _ in range(150)]
    for _ in range(60):
        chain = edited(rng, chain, vocabulary, 2)
        out.append(" ".join(chain))
    hub = [rng.choice(vocabulary) for _ in range(150)]
    out += [" ".join(edited(rng, hub, vocabulary, 3)) for _ in range(40)]
    out += [out[3]] * 20 + [None, "", " ", "One two", "one two", "one"]
    rng.shuffle(out)
    return out


def test_components_are_those_of_all_pairs(spark, texts):
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    got = {r.doc_id - 100: r.component_id - 100 for r in near_copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_roots(texts)
    assert near_copies.near_copies(df.where("false")).collect() == []


def test_stage_keeps_one_of_each_group_of_near_copies(spark, texts):
    df = spark.createDataFrame([(100 + i, t) for i, t in enumerate(texts)], "doc_id long, text string").repartition(5)
    kept = {r.doc_id - 100 for r in corpus_pipeline.drop_near_copies(spark, df, "").collect()}
    assert kept == set(brute_roots(texts))


def test_shingles_of_all_texts_are_counted(spark):
    docs = spark.range(12_000).selectExpr("id as doc_id", "concat('word', id) as text")
    assert int(near_copies.shingle_counts(docs, "text").sum()) == 12_000


def test_sketches_differ_by_no_more_than_sets_do():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    sets = [near_copies.shingles(" ".join(edited(rng, base, vocabulary, k % 9))) for k in range(60)] + [near_copies.shingles(""), near_copies.shingles("one")]
    for a in sets:
        for b in sets:
            apart = (near_copies.sketch(a) ^ near_copies.sketch(b)).view("uint8")
            assert int(near_copies.np.unpackbits(apart).sum()) <= len(near_copies.np.setxor1d(a, b))


def test_unlike_sets_of_a_large_group_do_not_move_pair_by_pair(spark, monkeypatch):
    """400 copies with so many edits that few are similar: they share shingles of their prefixes, and meet, but most pairs stop there."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(5_000)]
    base = [rng.choice(vocabulary) for _ in range(150)]
    texts = [" ".join(edited(rng, base, vocabulary, rng.choice([1, 2, 3, 3, 4]))) for _ in range(400)]
    moved, alike = [], near_copies._alike

    def counted(docs, leaves, id_col, text_col, pairs):
        moved.append(pairs.count())
        return alike(docs, leaves, id_col, text_col, pairs)

    monkeypatch.setattr(near_copies, "_alike", counted)
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    got = {r.doc_id: r.component_id for r in near_copies.near_copies(df).collect()}
    assert [got[i] for i in range(len(texts))] == brute_roots(texts)
    assert sum(moved) < 10 * len(texts)
