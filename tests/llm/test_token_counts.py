import random

import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from ledgerloom.llm.token_counts import PrefixCounter, longest_prefix, token_counts

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["hello", "the", "日本語", "  ", "   ", "\n", "a", "▁", "\t", "é", "🙂", "<s>", "\u00a0", "<0x0A>", "ing", "tion", "     ", "123", "//", "=="]


@pytest.fixture(scope="module")
def library():
    return SentencePieceProcessor(model_file=PATH)


@pytest.fixture(scope="module")
def counter():
    return PrefixCounter(PATH)


def texts(n, seed):
    rng = random.Random(seed)
    return ["".join(rng.choice(PARTS) + rng.choice(["", " "]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def test_counts_are_the_librarys(library, counter):
    for text in texts(1500, 1):
        assert counter.count(text) == len(library.encode(text)), text


def test_every_prefix_has_its_exact_count(library, counter):
    for text in texts(150, 2):
        assert counter.prefixes(text) == [len(library.encode(text[:i])) for i in range(len(text) + 1)], text


def test_runs_of_spaces(library, counter):
    for n in [*range(70), 500, 3001]:
        for text in (" " * n, " " * n + "word", "word" + " " * n):
            assert counter.count(text) == len(library.encode(text))


def test_long_words_and_texts(library, counter):
    for text in ("x" * 5000, "ab" * 3000 + " " + "日" * 2000, "word " * 20000):
        assert counter.count(text) == len(library.encode(text))


def test_budget_questions(library, counter):
    text = "Prefix tables answer truncation questions without encoding the text again"
    counts = counter.prefixes(text)
    for budget in (0, 1, 5, 9, 100):
        best = max(i for i in range(len(text) + 1) if len(library.encode(text[:i])) <= budget)
        assert longest_prefix(counts, budget) == best


def test_rows(spark, library):
    rows = [(1, "hello world", "x"), (2, None, "y"), (3, "", "z"), (3, "same id", "z"), (None, "no id", None), (1, "hello world", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = token_counts(df, PATH, budgets=(1, 100), prefixes=True).collect()
    assert len(got) == len(rows)
    want = sorted(((r[0] or 0), len((r[1] or "").encode()), len(library.encode(r[1] or ""))) for r in rows)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got) == want
    assert all(len(r.fits) == 2 and r.prefix_tokens[-1] == r.n_tokens for r in got)
    assert token_counts(df.where("false"), PATH).collect() == []


def test_prefixes_of_a_long_word_after_spaces_take_linear_time():
    import time

    counter = PrefixCounter(PATH)
    text = "a  " + "".join(chr(97 + i * i % 26) for i in range(60_000))
    began = time.process_time()
    counts = counter.prefixes(text)
    assert time.process_time() - began < 10 and counts[-1] == counter.count(text) and len(counts) == len(text) + 1
