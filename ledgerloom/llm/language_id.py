"""Language identification with language bitmasks in one bit-sliced Bloom filter.

Each slot holds one bit per language, in as many mask words of 64 as there are languages; the languages that know an
n-gram are the bits set in all its slots. A text's popcount per language, as a share of its n-grams and freed of the
filter's false positives, decides. Learning takes whole texts within `TRAIN_ROWS` rows and `TRAIN_BYTES` bytes in all,
an equal share of both for each language, so that a rare language is learned at any size. An n-gram goes to every
language that has it `LEAST` times or more.

An n-gram is `GRAM` bytes: five letters of Latin script, two or three of Cyrillic or Greek, and a character of Chinese
with two thirds of the next, where single characters already tell much.

Null texts and texts without a letter are `und` with score 0, as is every text where no language was learned. Ties go
to the first language in alphabetical order. Texts are taken whole; rows are neither merged nor dropped; an empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SCORE_BYTES, bounded_batches, bounded_texts, row_blocks, text_buffer
from ledgerloom.llm.subword import LOWER, spread

#: Most texts, and most bytes of text, that all languages together are learned from.
TRAIN_ROWS = 4000
TRAIN_BYTES = 24 << 20
#: Languages of one mask word.
WORD = 64
GRAM = 5
SLOT_BITS = 20
LEAST = 3
HASHES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def gram_hashes(text: np.ndarray) -> np.ndarray:
    """A hash of the `GRAM` bytes from each position."""
    n = len(text) - GRAM + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(GRAM):
        h = (h << np.uint64(8)) | text[k : k + n]
    return h


def slots(h: np.ndarray, k: int) -> np.ndarray:
    return ((h * np.uint64(HASHES[k])) >> np.uint64(64 - SLOT_BITS)).astype(np.int64)


@dataclass
class LanguageFilter:
    languages: list[str]
    masks: np.ndarray  # slots x mask words
    false_rate: np.ndarray

    def shares(self, body: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per row and language, the corrected share of the row's n-grams that the language knows; per row, its n-grams."""
        text, marks = spread(body, offsets, LOWER)
        h = gram_hashes(text)
        at = [slots(h, k) for k in range(len(HASHES))]
        first = np.minimum(marks[:-1], len(h))
        last = np.clip(marks[1:] + 2 - GRAM, first, len(h))
        out = np.zeros((len(first), len(self.languages)))
        for i in range(len(self.languages)):
            if i % WORD == 0:
                word = self.masks[:, i // WORD]
                known = word[at[0]] & word[at[1]]
            hits = np.concatenate([[0], np.cumsum((known >> np.uint64(i % WORD)) & np.uint64(1))]).astype(np.int64)
            out[:, i] = hits[last] - hits[first]
        rate = self.false_rate
        return np.clip((out / np.maximum(last - first, 1)[:, None] - rate) / (1 - rate), 0, 1), last - first


def learn(texts: list[str], languages: list[str]) -> LanguageFilter:
    names = sorted(set(languages))
    size = 1 << SLOT_BITS
    found: list[tuple[np.ndarray, np.ndarray]] = []
    for name in names:
        keys, counts = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        raw = [t.encode() for t, x in zip(texts, languages) if x == name]
        ends = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
        body = np.frombuffer(b"".join(raw), np.uint8)
        for a, b in row_blocks(ends):
            text, _ = spread(body, ends[a : b + 1], LOWER)
            more, n = np.unique(gram_hashes(text), return_counts=True)
            both, where = np.unique(np.concatenate([keys, more]), return_inverse=True)
            counts = np.bincount(where, weights=np.concatenate([counts, n])).astype(np.int64)
            keys = both
        found.append((keys, counts))
    masks = np.zeros((size, max(1, -(-len(names) // WORD))), np.uint64)
    fill = np.zeros(len(names))
    for i, (keys, counts) in enumerate(found):
        own = keys[counts >= LEAST]
        bit = np.uint64(1 << (i % WORD))
        for k in range(len(HASHES)):
            masks[np.unique(slots(own, k)), i // WORD] |= bit
        fill[i] = ((masks[:, i // WORD] & bit) != 0).mean()
    return LanguageFilter(names, masks, fill ** len(HASHES))


def train_languages(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", most_rows: int = TRAIN_ROWS, most_bytes: int = TRAIN_BYTES) -> LanguageFilter:
    """`docs` must already leave out what may not be learned from."""
    given = docs.select(F.col(text_col).alias("text_value"), F.col(lang_col).alias("lang_value"))
    rows = bounded_texts(given, "lang_value", "text_value", most_rows, most_bytes).toArrow()
    return learn(rows["text_value"].to_pylist(), rows["lang_value"].to_pylist())


def identify(
    docs: DataFrame, model: LanguageFilter, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), prefix: str = ""
) -> DataFrame:
    """The id, the columns of `keep`, lang_pred, score, coverage and grams for every row.

    The score is the winner's part of all languages' corrected shares, coverage its share itself, of so many n-grams as
    grams says: where they are few, a low coverage is no evidence. A prefix keeps the four names apart from those of
    kept columns.
    """
    names = list(dict.fromkeys([id_col, *keep]))
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("__letters")
    given = docs.select(*names, *([] if text_col in names else [text_col]), letters)
    at = given.columns.index(text_col)
    made = [prefix + x for x in ("lang_pred", "score", "coverage", "grams")]
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            body, offsets = text_buffer(batch.column(at))
            read = np.array(batch.columns[-1].to_pylist(), dtype=bool) & bool(model.languages)
            found = [model.shares(body, offsets[a : b + 1]) for a, b in row_blocks(offsets, SCORE_BYTES)] if model.languages else []
            shares = np.concatenate([x for x, _ in found]) if found else np.zeros((len(read), 1))
            grams = np.concatenate([x for _, x in found]) if found else np.zeros(len(read))
            best, top = shares.argmax(axis=1), np.where(read, shares.max(axis=1), 0.0)
            lang = [model.languages[b] if ok else "und" for b, ok in zip(best, read)]
            score = top / np.maximum(shares.sum(axis=1), 1e-12)
            out = [pa.array(lang, pa.string()), pa.array(score), pa.array(top), pa.array(grams.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], *out], names=[*names, *made])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(names)])
    return given.mapInArrow(run, f"{kinds}, `{made[0]}` string, `{made[1]}` double, `{made[2]}` double, `{made[3]}` long")
