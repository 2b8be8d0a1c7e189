import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from ledgerloom.llm import simhash
from ledgerloom.llm.components import components


def brute_fingerprint(text):
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    words = [w for w in text.split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * counts[b] > len(shingles))


def roots(values):
    """Smallest position that each is linked to, over all pairs."""
    root = list(range(len(values)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(values)):
        for j in range(i):
            if bin(values[i] ^ values[j]).count("1") <= 2:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    return [find(i) for i in range(len(values))]


def test_fingerprints():
    for text in ["", None, " \n", "One", "one two", "A b C d", "a a a a a", "É é\u00a0x y z", "w " * 50000]:
        assert simhash.fingerprint(text or "") == brute_fingerprint(text)


def clusters(rng):
    values = {rng.getrandbits(64) for _ in range(150)}
    for _ in range(6):
        centre = rng.getrandbits(64)
        for _ in range(60):
            x = centre
            for _ in range(rng.randint(0, 3)):
                x ^= 1 << rng.randrange(64)
            values.add(x)
        chain = centre
        for _ in range(8):
            chain ^= (1 << rng.randrange(64)) | (1 << rng.randrange(64))
            values.add(chain)
    return sorted(values | {0, 1, 2**64 - 1, 2**63})


@pytest.mark.parametrize("most", [4000, 20, 3])
def test_links_connect_what_pairs_connect(spark, monkeypatch, most):
    """Also where groups are split into subtree pairs and salted parts."""
    monkeypatch.setattr(simhash, "MOST_IN_GROUP", most)
    values = clusters(random.Random(most))
    signed = np.array(values, dtype=np.uint64).view(np.int64).tolist()
    df = spark.createDataFrame([(v,) for v in signed], "fp long")
    tied = components(simhash.link_forest(df)).collect()
    at = {v: i for i, v in enumerate(signed)}
    groups, want = {}, roots(values)
    label = list(range(len(values)))
    for r in tied:
        label[at[r.u]] = at[r.v]
    for i in range(len(values)):
        groups.setdefault(want[i], set()).add(label[i])
    assert all(len(g) == 1 for g in groups.values())
    assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_documents(spark):
    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(words) for _ in range(120)) for _ in range(12)]
    texts = base + [base[0]] * 30 + [b + " end" for b in base[:6]] + [None, "", "  ", "one two", "One Two"]
    rows = [(100 + i, t, "x") for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, fp string").repartition(5)
    got = {r.doc_id: r for r in simhash.near_duplicates(df).collect()}
    values = [brute_fingerprint(t) for t in texts]
    assert len(got) == len(rows)
    for i, root in enumerate(roots(values)):
        assert got[100 + i].fingerprint == f"{values[i]:016x}"
        assert got[100 + i].component_id == 100 + root
    assert simhash.near_duplicates(df.where("false")).collect() == []


def test_null_and_repeated_ids(spark):
    df = spark.createDataFrame([(None, "a b c"), (7, "a b c"), (7, "a b c"), (None, "q r s t")], "doc_id long, text string")
    got = sorted(((r.doc_id or -1), (r.component_id or -1)) for r in simhash.near_duplicates(df).collect())
    assert got == [(-1, -1), (-1, 7), (7, 7), (7, 7)]


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 200)] + [(1000, 1000 + i) for i in range(1, 300)] + [(5000, 5001), (5001, 5000), (6000, 6000)]
    got = components(spark.createDataFrame(edges, "u long, v long")).where(F.col("u") != F.col("v")).collect()
    want = {i: 0 for i in range(1, 201)} | {1000 + i: 1000 for i in range(1, 300)} | {5001: 5000}
    assert {r.u: r.v for r in got} == want
