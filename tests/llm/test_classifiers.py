import random
from collections import Counter

import numpy as np
import pytest

from ledgerloom.llm import labelled
from ledgerloom.llm.common import bounded_texts
from ledgerloom.llm.language_id import identify, learn, train_languages
from ledgerloom.llm.quality import quality_scores, train_quality
from ledgerloom.llm.subword import LOWER, fit
from ledgerloom.llm.toxicity import toxicity_scores, train_toxicity

SYLLABLES = {"xx": ["ka", "lo", "mi", "tu", "re"], "yy": ["sch", "ung", "der", "ein", "ber"], "zz": ["qué", "ño", "ción", "ar", "os"]}
BAD = ["gromf", "blurgh", "snazzik"]


def say(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def corpus(seed, n):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        text = say(rng, lang, rng.choice([5, 20, 150]))
        toxic, good = i % 4 == 0, i % 3 != 0
        parts = text.split()
        if toxic:
            for _ in range(3):
                word = rng.choice(BAD) + rng.choice(["", "s", "er", "!"])
                parts.insert(rng.randrange(len(parts) + 1), word)
        if not good:
            parts = [p + rng.choice(["###", "%%%"]) for p in parts] if i % 2 else [p for p in parts for _ in range(6)]
        rows.append((i, " ".join(parts), lang, int(toxic), int(good)))
    return rows


@pytest.fixture(scope="module")
def frames(spark):
    rows = corpus(1, 700)
    docs = spark.createDataFrame([(i, t, lang) for i, t, lang, *_ in rows], "doc_id long, text string, lang string").repartition(3).cache()
    labels = spark.createDataFrame([(i, x, q) for i, _, _, x, q in rows], "doc_id long, toxic int, quality int").cache()
    return rows, docs, labels


def test_toxicity_on_rows_not_learned_from(frames):
    rows, docs, labels = frames
    scored = {r.doc_id: r.score for r in toxicity_scores(docs, train_toxicity(docs, labels.where("doc_id < 500"))).collect()}
    held = [(scored[i], x) for i, _, _, x, _ in rows if i >= 500]
    assert np.mean([(s >= 0.5) == x for s, x in held]) > 0.97


def test_misspellings_share_vectors():
    rows = corpus(3, 500)
    model = fit([r[1] for r in rows], np.array([r[3] for r in rows]), case=LOWER, focus=1.0, word_dropout=0.4)
    texts = ["kalo mitu gromfing reka", "kalo mitu reka lomi", "", "GROMF"]
    ends = np.cumsum([0, *(len(t) for t in texts)])
    p = model.probabilities(np.frombuffer("".join(texts).encode(), np.uint8), ends)
    assert p[0] > 30 * p[1] and p[3] > 0.5 and p[2] < 0.5, p


def test_quality_on_rows_not_learned_from(frames):
    rows, docs, labels = frames
    scored = {r.doc_id: r.score for r in quality_scores(docs, train_quality(docs, labels.where("doc_id < 500"))).collect()}
    held = [(scored[i], q) for i, _, _, _, q in rows if i >= 500]
    assert np.mean([(s >= 0.7) == q for s, q in held]) > 0.97


def score_by_definition(model, text):
    """The logit of one text from its words and n-grams, read as Python bytes."""
    raw = text.encode()
    if model.case is LOWER:
        raw = raw.lower()
    words = raw.split()

    def bucket(gram):
        h = 0
        for i, c in enumerate(gram):
            h = (h * 0x01000193 + c) % 2**32 if i else c
        h = h * (0x85EBCA6B + 2 * len(gram)) % 2**32
        return (h ^ h >> 15) >> 12

    def own(word):
        h = sum(c * pow(0x9E3779B97F4A7C15, min(i + 1, 63) + 1, 2**64) for i, c in enumerate(word)) % 2**64
        return h * 0xD6E8FEB86659FD93 % 2**64 >> 44

    scores = []
    for i, w in enumerate(words):
        padded = b" " + w + b" "
        grams = [model.weight[bucket(padded[a : a + n])] for n in (3, 4, 5, 6) for a in range(len(padded) - n + 1)]
        s = float(np.mean(grams)) if grams else 0.0
        if model.weight[own(w)] != 0:
            s = (s + float(model.weight[own(w)])) / 2
        if model.repeats and i and words[i - 1] == w:
            s = (s + float(model.weight[1 << 20])) / 2
        scores.append(s)
    if not scores:
        return model.bias
    w = np.exp((model.focus or 0) * (np.array(scores) - max(scores)))
    return model.bias + float(w @ scores / w.sum())


def test_scores_are_those_of_the_definition(frames):
    rows, docs, labels = frames
    texts = [t for _, t, *_ in rows[:25]] + ["", " ", "a", "a a a", "kalo kalo  gromf\tGROMF gromf", "ñ!"]
    raw = [t.encode() for t in texts]
    body, ends = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    for model in (train_toxicity(docs, labels), train_quality(docs, labels)):
        got = model.logits(body, ends)
        assert [float(x) for x in got] == pytest.approx([score_by_definition(model, t) for t in texts], abs=1e-4)
        assert len(set(np.round(got, 3))) > 10


def test_a_repeated_word_keeps_its_own_vector():
    rng = random.Random(6)
    texts, labels = [], []
    for k in range(300):
        words = [rng.choice(["kalo", "mitu", "reka", "lomi", "turelo", "kami"]) for _ in range(20)]
        at = rng.randrange(19)
        words[at] = words[at + 1] = "gromf" if k % 3 == 0 else "blurgh"
        texts.append(" ".join(words))
        labels.append(float(k % 3 == 0))
    model = fit(texts, np.array(labels), repeats=True, epochs=30, reach=1000.0)
    raw = [b"kalo gromf gromf mitu", b"kalo blurgh blurgh mitu"]
    p = model.probabilities(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert p[0] > 0.7 > 0.3 > p[1]


def test_scores_do_not_depend_on_batches(frames, spark):
    _, docs, labels = frames
    model = train_toxicity(docs, labels)
    a = {r.doc_id: r.score for r in toxicity_scores(docs, model).collect()}
    b = {r.doc_id: r.score for r in toxicity_scores(docs.coalesce(1).orderBy("doc_id"), model).collect()}
    assert a == b


def test_languages_on_rows_not_learned_from(frames):
    rows, docs, _ = frames
    model = train_languages(docs.where("doc_id < 400"))
    got = {r.doc_id: r for r in identify(docs, model).collect()}
    held = [(got[i].lang_pred, lang) for i, _, lang, *_ in rows if i >= 400]
    assert np.mean([a == b for a, b in held]) > 0.99
    assert all(0 <= r.score <= 1 and 0 <= r.coverage <= 1 for r in got.values())


def ways(lang_no):
    """A made-up language: its syllables are its number's."""
    return [f"{chr(97 + lang_no % 26)}{v}{chr(97 + lang_no // 26)}{c}" for v in "aeiou" for c in "rstn"]


def test_more_languages_than_a_mask_word_and_a_rare_one(spark):
    rng = random.Random(8)
    rows = []
    for k in range(70):
        for _ in range(2 if k == 69 else 12 if k else 2000):
            rows.append((len(rows), " ".join("".join(rng.choice(ways(k)) for _ in range(2)) for _ in range(60 if k != 69 else 200)), f"l{k:02d}"))
    rows.append((len(rows), " ".join(w for _ in range(4000) for w in rng.sample(ways(3), 4)), "l03"))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(4)
    model = train_languages(docs, most_rows=700)
    assert len(model.languages) == 70 and model.masks.shape[1] == 2
    tests = [(k, " ".join("".join(rng.choice(ways(k)) for _ in range(2)) for _ in range(40)), "s") for k in range(70)]
    got = identify(spark.createDataFrame(tests, "doc_id long, text string, score string"), model).collect()
    assert all(r.lang_pred == f"l{r.doc_id:02d}" for r in got)


def test_filter_holds_every_language_of_an_n_gram_and_counts_by_definition():
    rows = corpus(5, 300)
    model = learn([r[1] for r in rows], [r[2] for r in rows])
    known = {}
    for name in model.languages:
        counts = Counter()
        for _, text, lang, *_ in rows:
            raw = b" " + text.encode().lower() + b" "
            if lang == name:
                counts.update(raw[i : i + 5] for i in range(len(raw) - 4))
        known[name] = {g for g, n in counts.items() if n >= 3}
    texts = ["kalo mitu schung", "ño", "", "derein qué 12"] + [r[1] for r in rows[:30]]
    raw = [t.encode() for t in texts]
    shares, grams = model.shares(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    for t, share, n in zip(raw, shares, grams):
        padded = b" " + t.lower() + b" "
        inside = [padded[i : i + 5] for i in range(len(padded) - 4)]
        assert n == len(inside)
        for name, got, rate in zip(model.languages, share, model.false_rate):
            exact = sum(g in known[name] for g in inside) / max(len(inside), 1)
            assert got >= (exact - rate) / (1 - rate) - 1e-9 and abs(got - exact) < 0.03


def test_training_texts_are_whole_bounded_and_of_all_lengths(spark):
    rows = [(k % 2, f"{k} " + "word " * (20_000 if k % 10 == 0 else 20)) for k in range(400)] + [(0, "same text")] * 3000 + [(None, "x"), (1, None)]
    df = spark.createDataFrame(rows, "label int, text string")
    got = bounded_texts(df, "label", "text", 100, 2 << 20).collect()
    assert all((r.label, r.text) in set(rows) for r in got)
    assert max(Counter(r.label for r in got).values()) <= 50 and sum(len(r.text) for r in got) <= 2 << 20
    assert any(len(r.text) > 90_000 for r in got) and len({r.text for r in got}) == len(got) > 30
    assert bounded_texts(df.where("false"), "label", "text", 100, 1000).collect() == []


def test_two_scripts_of_many_characters():
    rng = random.Random(2)
    zh, ja = [chr(0x4E00 + i) for i in range(600)], [chr(0x3042 + i) for i in range(70)] + [chr(0x4E00 + i) for i in range(300, 600)]
    write = lambda chars: "".join(rng.choice(chars) for _ in range(80))
    model = learn([write(c) for _ in range(300) for c in (zh, ja)], ["zh", "ja"] * 300)
    raw = [write(c).encode() for _ in range(50) for c in (zh, ja)]
    shares, _ = model.shares(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]))
    assert np.mean([model.languages[i] == want for i, want in zip(shares.argmax(axis=1), ["zh", "ja"] * 50)]) > 0.95


EDGES = [(1, None, "s"), (2, "", "s"), (3, "  \n", "s"), (4, "123 !?", "s"), (5, "kalo " * 60000, "s"), (5, "kalo", None), (None, "kalomi", "s")]


def test_edges(spark, frames):
    _, docs, labels = frames
    df = spark.createDataFrame(EDGES, "doc_id long, text string, score string")
    langs = identify(df, train_languages(docs), keep=("score",), prefix="p_").collect()
    assert len(langs) == len(EDGES)
    assert {r.doc_id: r.p_lang_pred for r in langs if r.doc_id in (1, 2, 3, 4)} == dict.fromkeys((1, 2, 3, 4), "und")
    for train, score in ((train_toxicity, toxicity_scores), (train_quality, quality_scores)):
        rows = score(df, train(docs, labels), keep=("text", "score"), name="p").collect()
        assert len(rows) == len(EDGES) and all(0 <= r.p <= 1 for r in rows)
        assert score(df.where("false"), train(docs, labels), name="p").collect() == []


def test_without_labels(spark, frames):
    _, docs, labels = frames
    none = train_toxicity(docs, labels.where("false"))
    assert len({r.score for r in toxicity_scores(docs, none).collect()}) == 1
    assert train_toxicity(docs, labels.where("toxic = 1")).probabilities(np.zeros(0, np.uint8), np.array([0, 0]))[0] > 0.5
    assert {r.lang_pred for r in identify(docs, learn([], [])).collect()} == {"und"}


def test_sample_is_bounded(frames):
    _, docs, labels = frames
    from ledgerloom.llm.common import bounded_sample

    assert bounded_sample(labels, "doc_id", 100).count() <= 140
    assert bounded_sample(labels, "doc_id", 10_000).count() == 700
    model = labelled.train(docs, labels, "toxic", 200, case=LOWER, focus=1.0)
    assert model.weight.any()
