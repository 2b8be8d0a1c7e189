import random
import re
from collections import Counter

import pytest

from ledgerloom.llm import collocations
from ledgerloom.llm.collocations import mine_collocations, phrase_counts


def pieces(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [re.findall(r"[^\x20\x09]+", p) for p in re.split(r"[.,;:!?\x0A-\x0D]", lowered)]


def counted(docs, longest):
    f, n = Counter(), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for words in pieces(text):
            n[lang] += len(words)
            for m in range(1, longest + 1):
                for i in range(len(words) - m + 1):
                    f[lang, tuple(words[i : i + m])] += 1
    return f, n


def brute(docs, longest=3, least=10, strong=50, top=2000):
    f, n = counted(docs, longest)
    found = {k: a for k, a in f.items() if len(k[1]) > 1 and a >= least}
    out = {}
    for (lang, p), a in found.items():
        longer = [b for (other, q), b in found.items() if other == lang and len(q) > len(p) and any(q[i : i + len(p)] == p for i in range(len(q)))]
        if any(100 * b >= strong * a for b in longer):
            continue
        cuts = [(1_000_000 * a * a // (f[lang, p[:k]] * f[lang, p[k:]]), k, f[lang, p[:k]], f[lang, p[k:]]) for k in range(1, len(p))]
        score, _, left, right = min(cuts)
        out.setdefault(lang, []).append((-score, -a, " ".join(p).encode(), left, right))
    return sorted((lang, k + 1, p.decode(), -a, left, right, n[lang], -s) for lang, rows in out.items() for k, (s, a, p, left, right) in enumerate(sorted(rows)[:top]))


def case(seed, rows=120):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "Wort", "Éa", "éa", "naïve", "x" * 40, "日本", "a-b", "(q)"] + [f"w{i}" for i in range(12)]
    fixed = ["new york city", "New  York", "of the", "à la carte", "\tbig data", "one two three four"]
    say = lambda: rng.choice([" ", "  ", "\t", ", ", ".", "\n", "!\r\n"]).join(rng.choice([rng.choice(vocabulary), rng.choice(fixed)]) for _ in range(rng.randint(0, 30)))
    docs = [(rng.choice(["en", "en", "de", None, "und"]), say()) for _ in range(rows)]
    docs += [("en", None), (None, ""), ("fr", " .,\t\n"), ("en", "new york city " * 300), ("en", "x" * 30000 + " end"), ("en", "the " * 50)]
    return docs + [("de", "same line here again")] * 40


def frame(spark, docs, parts=3):
    return spark.createDataFrame([(i, t, k, 1) for i, (k, t) in enumerate(docs)], "doc_id long, text string, lang string, n int").repartition(parts)


@pytest.mark.parametrize("seed,longest,top", [(1, 3, 2000), (2, 3, 7), (3, 4, 2000)])
def test_brute_force(spark, seed, longest, top):
    docs = case(seed)
    got = mine_collocations(frame(spark, docs), longest=longest, top=top).collect()
    assert sorted(tuple(r) for r in got) == brute(docs, longest, top=top)


def test_full_filters_and_small_chunks_change_nothing(spark, monkeypatch):
    monkeypatch.setattr(collocations, "MOST_SLOTS", 1)
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 200)
    docs = case(4, 60)
    got = phrase_counts(frame(spark, docs, 5)).where("length > 0").collect()
    f, _ = counted(docs, 3)
    assert {(r.lang, tuple(r.phrase.split(" "))): r.n for r in got} == {k: a for k, a in f.items() if a >= 10}


def test_exact_beyond_64_bits(spark):
    big = 9_000_000_000
    rows = [("en", 0, "", 10 * big), ("en", 1, "a", big), ("en", 1, "b", big + 7), ("en", 2, "a b", big - 1)]
    got = collocations.collocations(spark.createDataFrame(rows, "lang string, length int, phrase string, n long")).collect()
    assert [(r.score, r.l, r.r, r.n) for r in got] == [(1_000_000 * (big - 1) ** 2 // (big * (big + 7)), big, big + 7, 10 * big)]


def test_empty_table(spark):
    assert mine_collocations(spark.createDataFrame([], "doc_id long, text string, lang string")).collect() == []
    assert mine_collocations(frame(spark, [("en", None), (None, " ")])).collect() == []
