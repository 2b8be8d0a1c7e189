import math
import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.llm import topk
from ledgerloom.llm.topk import top_k


def brute(rows, k=10):
    ok = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in ok:
        if q % 100 == 0:
            found = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in ok if i != q and len(a) == len(b))[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


def vectors(rng, n, dim):
    return [(i, [rng.choice([rng.gauss(0, 1), 0.0, 0.5]) for _ in range(dim)]) for i in range(n)]


@pytest.mark.parametrize("seed,n,dim,blocks", [(1, 900, 16, 64), (2, 350, 3, 4096), (3, 1500, 40, 128)])
def test_brute_force(spark, monkeypatch, seed, n, dim, blocks):
    monkeypatch.setattr(topk, "QUERY_ROWS", 4)
    monkeypatch.setattr(topk, "CANDIDATE_ROWS", blocks)
    monkeypatch.setattr(topk, "LEAST_ROWS", 32)
    rng = random.Random(seed)
    rows = vectors(rng, n, dim)
    rows[5] = (5, None)
    rows[6] = (6, [None] * dim)
    rows[7] = (7, [float("nan")] * dim)
    rows[8] = (8, [float("inf")] + [0.0] * (dim - 1))
    rows[9] = (9, [1.0] * (dim + 1))
    rows[10] = (None, [1.0] * dim)
    rows[20] = (20, rows[21][1])
    rows += [(n + 1, rows[0][1]), (n + 2, rows[0][1]), (n + 2, rows[0][1]), (n + 3, [1e7] * dim)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df, F.col("vec_id") % 100 == 0).collect())
    assert got == brute(rows)


def test_few_rows_and_none(spark):
    df = spark.createDataFrame([(0, [1.0, 2.0], "a"), (1, [0.5, 0.25], "b"), (1, [0.5, 0.25], "b")], "vec_id long, embedding array<float>, score string")
    assert [(r.rank, r.vec_id) for r in top_k(df, F.col("vec_id") == 0).orderBy("rank").collect()] == [(1, 1), (2, 1)]
    assert top_k(df.where("false"), F.col("vec_id") == 0).collect() == []
    assert top_k(df, F.col("vec_id") == 99).collect() == []
    assert top_k(df.where("vec_id = 0"), F.col("vec_id") == 0).collect() == []


def test_scores_beyond_doubles(spark):
    df = spark.createDataFrame([(0, [1e13 + 0.5, 3.0]), (1, [2.0**20, 1.0]), (2, [-(2.0**20), 1.0])], "vec_id long, embedding array<double>")
    rows = [tuple(r) for r in df.collect()]
    hold = lambda s: max(-(2**63), min(2**63 - 1, s))
    want = [(q, r, i, hold(s)) for q, r, i, s in brute(rows)]
    assert sorted(tuple(r) for r in top_k(df, F.col("vec_id") == 0).collect()) == want


def test_clusters_are_pruned_and_survivors_told(spark):
    rng = random.Random(4)
    centres = [[rng.gauss(0, 1) for _ in range(32)] for _ in range(8)]
    rows = [(i, [x + rng.gauss(0, 0.15) for x in centres[rng.randrange(8)]]) for i in range(3000)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)
    got = top_k(df, F.col("vec_id") % 100 == 0, report=True).collect()
    assert sorted((r.query_id, r.rank, r.vec_id, r.score) for r in got) == brute(rows)
    assert sum({r.query_id: r.scored for r in got}.values()) < 0.05 * 30 * 2999


def test_a_repeated_row_is_a_candidate_each_time(spark):
    rng = random.Random(5)
    rows = vectors(rng, 150, 6) + [(77, [3.0] * 6)] * 40 + [(100, [1.0] * 6)] * 30
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in top_k(df.where("vec_id != 100"), F.col("vec_id") % 100 == 0).collect())
    assert got == brute([x for x in rows if x[0] != 100])
