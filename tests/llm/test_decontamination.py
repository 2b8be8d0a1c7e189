import random
import re

import pytest

from ledgerloom.llm import decontamination
from ledgerloom.llm.decontamination import decontaminate


def words(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = words(text)
        n = min(len(w), 13)
        if item is not None:
            for i in range(len(w) - n + 1 if n else 0):
                windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = []
    for key, text in docs:
        w = words(text)
        hit, found = set(), set()
        for n in {len(k) for k in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    found |= windows[tuple(w[i : i + n])]
        out.append((key or -1, len(w), len(hit), tuple(sorted(found))))
    return sorted(out)


def case(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(40)] + ["É", "é", "Wort", "İx", "k\u212a"]
    say = lambda n: rng.choice([" ", ", ", "\n"]).join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, say(rng.choice([1, 2, 7, 12, 13, 14, 30, 60]))) for i in range(25)] + [(3, say(20)), (900, None), (901, "!!"), (None, say(15))]
    docs = [(i, say(rng.choice([0, 1, 5, 12, 13, 50]))) for i in range(30)]
    for i in range(30):
        text = rng.choice(items)[1] or ""
        parts = text.split()
        cut = rng.randrange(max(1, len(parts)))
        docs.append((100 + i, say(rng.randint(0, 30)) + " " + rng.choice([str.upper, str])(" ".join(parts[cut:] if i % 3 else parts)) + " " + say(rng.randint(0, 30))))
    docs += [(500, None), (501, ""), (502, items[7][1] * 3), (502, items[7][1] * 3), (502, "other text of one id"), (None, items[6][1]), (503, say(4000))]
    return docs, items


@pytest.mark.parametrize("seed,most", [(1, 100_000), (2, 100_000), (3, 0)])
def test_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(decontamination, "MOST_BROADCAST", most)
    docs, items = case(seed)
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    b = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate(d, b).collect()
    assert sorted((r.doc_id or -1, r.n_words, r.n_hit, tuple(r.item_ids)) for r in got) == brute(docs, items)
    for r in got:
        assert sum(s.to - s["from"] + 1 for s in r.spans) == r.n_hit


def test_empty_tables_and_extra_columns(spark):
    d = spark.createDataFrame([(1, "a b", "x")], "doc_id long, text string, words string")
    b = spark.createDataFrame([(1, "a b", 0)], "item_id long, text string, items int")
    assert decontaminate(d.where("false"), b).collect() == []
    none = decontaminate(d, b.where("false")).collect()
    assert [(r.n_words, r.n_hit, r.item_ids) for r in none] == [(2, 0, [])]
    assert [(r.n_hit, r.item_ids) for r in decontaminate(d, b).collect()] == [(2, ["1"])]


def test_main_path_is_native(spark):
    d = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    b = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    plan = decontaminate(d, b)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_fingerprints_are_one_for_each_run_of_equal_minima(spark):
    rng = random.Random(9)
    rows = [(i, [f"w{rng.randrange(500)}" for _ in range(n)]) for i, n in enumerate((0, 5, 13, 14, 3000))]
    df = decontamination.with_fingerprints(spark.createDataFrame(rows, "id int, words array<string>"))
    for full, thin in zip(df.orderBy("id").collect(), decontamination.with_runs(df).orderBy("id").collect()):
        spread = [r.print for r in thin.runs for _ in range(r["from"], r.to + 1)]
        assert spread == full.mins and [r["from"] for r in thin.runs] == [1, *[r.to + 1 for r in thin.runs][:-1]][: len(thin.runs)]
        assert all(a.print != b.print for a, b in zip(thin.runs, thin.runs[1:]))
    assert len(thin.runs) < 0.4 * len(full.mins)
