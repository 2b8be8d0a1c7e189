import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import divergence
from ledgerloom.llm.divergence import audit_sources

SCHEMA = "lang string, source string, text string, term string, n long"


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(a, b, t, "clash", 1) for a, b, t in rows], SCHEMA).repartition(parts)


def brute(rows, least=10, top=10):
    rows = [tuple(x or "" for x in r) for r in rows]
    n, df, groups = Counter(), Counter(), {(a, b) for a, b, _ in rows}
    for a, b, t in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t))
        n.update((a, b, w) for w in found)
        df.update((a, w) for w in set(found))
    out = []
    for lang, source in groups:
        kept = sorted(w for (a, w), d in df.items() if a == lang and d >= least)
        others = [b for a, b in groups if a == lang]
        count = {b: {w: n[lang, b, w] for w in kept} for b in others}
        whole = {w: sum(c[w] for c in count.values()) for w in kept}
        p = lambda c: {w: 1 + 1_000_000_000 * (c[w] + 2) // (sum(c.values()) + 2 * len(kept)) for w in kept}  # noqa: B023,E731
        f = lambda x, y: (x - y) ** 2 // (x + y)
        mine, all_ = p(count[source]), p(whole)
        pair = [(-sum(f(mine[w], q) for w, q in p(count[b]).items()), b.encode()) for b in others if b != source]
        term = [(-f(mine[w], all_[w]), w.encode()) for w in kept if count[source][w] > 0 and mine[w] > all_[w]]
        out += [(lang, source, "pair", b.decode(), -v, k + 1) for k, (v, b) in enumerate(sorted(pair))]
        out += [(lang, source, "term", w.decode(), -v, k + 1) for k, (v, w) in enumerate(sorted(term)[:top])]
    return sorted(out)


def case(seed, sources=6):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + i)}" for i in range(26)] + ["Éa", "éa", "日本", "THE", "the", "x" * 300]
    rows = [(rng.choice(["en", "en", "de", None]), rng.choice([f"s{min(int(rng.expovariate(0.5)), sources)}", None]), rng.choice([" ", "3", "_", "\n"]).join(rng.choices(vocabulary, k=rng.randint(0, 25)))) for _ in range(200)]
    rows += [("fr", "a", "rare words only"), ("fr", "b", None), ("en", "wordless", "123 !"), ("es", "one", "solo " * 50)]
    return rows + [("es", "one", "solo y mal")] * 12 + [("en", "s0", "the the hot copy")] * 100


@pytest.mark.parametrize("seed,block,tile", [(1, 1 << 14, 64), (2, 5, 64), (3, 7, 2), (4, 1 << 14, 3)])
def test_brute_force(spark, monkeypatch, seed, block, tile):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", block)
    rows = case(seed)
    got = audit_sources(frame(spark, rows), tile=tile).collect()
    assert sorted((r.lang, r.source, r.part, r.item, r.value, r["rank"]) for r in got) == brute(rows)


def test_joint_tables_are_products_of_indicator_columns():
    import numpy as np

    rng = np.random.default_rng(1)
    for size in (7, 400_000):
        a, b = rng.integers(0, 5, 300), rng.integers(0, 7, 300)
        product = np.eye(5, dtype=int)[a].T @ np.eye(7, dtype=int)[b]
        x, y, times = divergence.joint(a, b, 5, max(7, size))
        assert {(i, j): t for i, j, t in zip(x, y, times)} == {(i, j): product[i, j] for i, j in np.argwhere(product)}


def test_levels_are_exact_for_large_counts():
    import numpy as np

    n, whole = 8_999_999_999_999, 9_000_000_000_000_007
    assert divergence.levels(np.array([n, 0, 17]), whole).tolist() == [1 + 1_000_000_000 * (c + 2) // whole for c in (n, 0, 17)]


def test_empty_table(spark):
    assert audit_sources(frame(spark, [])).collect() == []
