"""Exact token counts of every prefix, by dynamic programming over byte-pair pieces.

The last piece of an encoded prefix fixes the rest: if prefix `i` ends in piece `t`, its encoding is that of prefix
`i - len(t)` followed by `t`, and `t` is the one candidate whose merge with the piece before it leaves both standing.
So one pass over a word gives the count at each of its prefixes. No piece spans from a letter into a following space,
hence words are independent, their tables add up, and the table of a word is kept for its next occurrence.

Defined results: null and empty texts have 0 tokens; texts of any length are taken whole and in linear time; rows are
never merged or dropped, so repeated rows and repeated ids each give a row; an empty table gives an empty result.
Input columns other than the named ones are left out of the result unless they are asked for by `keep`.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches

MARK = "▁"
KEPT_WORDS = 600_000
KEPT_LENGTH = 48
ONE = (1,)


class PrefixCounter:
    """Token counts at prefixes for a byte-pair model with byte fallback and a leading space mark."""

    def __init__(self, model_path: str):
        from sentencepiece import SentencePieceProcessor
        from sentencepiece import sentencepiece_model_pb2 as pb

        model = pb.ModelProto()
        with open(model_path, "rb") as f:
            model.ParseFromString(f.read())
        spec = model.normalizer_spec
        if model.trainer_spec.model_type != 2 or spec.precompiled_charsmap or spec.remove_extra_whitespaces:
            raise ValueError("a byte-pair model without text normalisation is needed")
        pieces = {p.piece for p in model.pieces if p.type == 1}
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece goes on past a space")
        spec.add_dummy_prefix = False
        self._split = SentencePieceProcessor(model_proto=model.SerializeToString()).encode_as_pieces
        self.pieces = {p for p in pieces if self._split(p) == [p]}
        lengths = defaultdict(set)
        for p in self.pieces:
            lengths[p[-2:]].add(len(p))
        self.lengths = {end: tuple(sorted(ns | {1}, reverse=True)) for end, ns in lengths.items() if len(end) > 1}
        self._stand: dict[tuple[str, str], bool] = {}
        self._runs: dict[int, int] = {}
        self._words: dict[str, bytes | list[int]] = {}
        self._bare: dict[str, bool] = {}

    def _stands(self, left: str, right: str) -> bool:
        """Whether the two pieces, side by side, are not merged; a character without a piece merges with nothing."""
        free = left not in self.pieces or right not in self.pieces
        known = self._stand[left, right] = free or self._split(left + right) == [left, right]
        return known

    def table(self, word: str) -> tuple[list[int], bool]:
        """Counts at all prefixes of the mark and a word without spaces; whether the mark stands alone at its end."""
        counts, first = self._prefixes(word)
        return counts, first[-1] == MARK

    def _prefixes(self, word: str) -> tuple[list[int], list[str]]:
        """Of all prefixes of the mark and a word without spaces, the counts and the first pieces."""
        text = MARK + word
        last, counts, first = [""], [0], [""]
        pieces, lengths, stand = self.pieces, self.lengths, self._stand
        if len(stand) >= 2 * KEPT_WORDS:
            stand.clear()
        for i in range(1, len(text) + 1):
            for n in lengths.get(text[i - 2 : i], ONE):
                if n > i:
                    continue
                piece = text[i - n : i]
                if n > 1 and piece not in pieces:
                    continue
                if n == i:
                    break
                known = stand.get((last[i - n], piece))
                if known or known is None and self._stands(last[i - n], piece):
                    break
            last.append(piece)
            first.append(piece if i == n else first[i - n])
            counts.append(counts[i - n] + (1 if n > 1 or piece in pieces else len(piece.encode())))
        return counts, first

    def run(self, n: int) -> int:
        """Tokens of n space marks: all their pieces have one score, so merges go leftmost first."""
        if n not in self._runs:
            self._runs[n] = len(self._split(MARK * n))
        return self._runs[n]

    def word(self, word: str):
        """The kept table of a word: one byte a prefix where counts fit."""
        if (known := self._words.get(word)) is None:
            counts, bare = self.table(word)
            known = bytes(counts) if counts[-1] < 256 and max(counts) < 256 else counts
            if len(word) <= KEPT_LENGTH:
                if len(self._words) >= KEPT_WORDS:
                    self._words.clear()
                    self._bare.clear()
                self._words[word] = known
                if bare:
                    self._bare[word] = True
        return known

    def _stands_bare(self, word: str) -> bool:
        if len(word) > KEPT_LENGTH:
            return self.table(word)[1]
        self.word(word)
        return word in self._bare

    def count(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        words = text.split(" ")
        look = self.word
        if "" not in words:
            return sum([look(w)[-1] for w in words])
        total, spaces = 0, 0
        for w in words:
            spaces += 1
            if w:
                n = look(w)[-1]
                if spaces > 1:
                    n += self.run(spaces) - 1 if self._stands_bare(w) else self.run(spaces - 1)
                total, spaces = total + n, 0
        return total + (self.run(spaces) if spaces else 0)

    def prefixes(self, text: str) -> list[int]:
        """Token count of text[:i] for i from 0 to its length."""
        out, total, spaces = [0], 0, 1
        for i, w in enumerate(text.replace(MARK, " ").split(" ") if text else []):
            if i:
                spaces += 1
                out.append(total + self.run(spaces))
            if w:
                counts, first = self._prefixes(w)
                for j in range(2, len(counts)):
                    more = 0 if spaces == 1 else self.run(spaces) - 1 if first[j] == MARK else self.run(spaces - 1)
                    out.append(total + counts[j] + more)
                total, spaces = out[-1], 0
        return out


@lru_cache(maxsize=2)
def counter_of(model_path: str) -> PrefixCounter:
    """One counter a worker process, so that the tasks it runs one after another share the tables of words."""
    return PrefixCounter(model_path)


def longest_prefix(counts: list[int], budget: int) -> int:
    """The longest prefix, in characters, of at most `budget` tokens, from the counts at all prefixes."""
    return max(i for i, n in enumerate(counts) if n <= budget)


def token_counts(
    docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", budgets: tuple[int, ...] = (), prefixes: bool = False
) -> DataFrame:
    """Per row: id, n_bytes, n_tokens; with `budgets` also `fits` (longest prefix for each budget), with `prefixes` all counts."""
    fields = "n_bytes long, n_tokens long" + ", fits array<long>" * bool(budgets) + ", prefix_tokens array<int>" * prefixes
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = counter_of(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(2).to_pylist()]
            columns = [batch.column(0), batch.column(1)]
            if budgets or prefixes:
                tables = [counter.prefixes(t) for t in texts]
                columns.append(pa.array([t[-1] for t in tables], pa.int64()))
                if budgets:
                    columns.append(pa.array([[longest_prefix(t, b) for b in budgets] for t in tables], pa.list_(pa.int64())))
                if prefixes:
                    columns.append(pa.array(tables, pa.list_(pa.int32())))
            else:
                columns.append(pa.array([counter.count(t) for t in texts], pa.int64()))
            names = ["id", "n_bytes", "n_tokens"] + ["fits"] * bool(budgets) + ["prefix_tokens"] * prefixes
            yield pa.RecordBatch.from_arrays(columns, names=names)

    bounded_batches(docs.sparkSession)
    given = docs.select(
        F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text")
    )
    return given.mapInArrow(run, f"id {kind}, {fields}").withColumnRenamed("id", id_col)
