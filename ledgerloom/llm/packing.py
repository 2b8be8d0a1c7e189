"""Bounded-space online packing of documents into fixed token windows.

Each partition keeps a fixed number of open windows. What a document has beyond whole windows goes to the open window
it fits best. When it fits none, the fullest is topped up with its first ids and emitted, and the rest is placed anew.
At the end of a partition the open windows are merged into full ones and one tail; tails of many partitions are merged
by group, so padding is at most one window for each group of `merge_fan` partitions.

Which rows share a partition is decided by the scan, so a task that runs again packs the same rows the same way; what
it made is checkpointed before the tails are taken from it. Null and empty texts are the end id alone; repeated rows
and ids give pieces of their own; an empty table gives no piece. Texts are taken whole at any length.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import bounded_batches, checkpointed

#: The pattern that splits text before the merges of byte-level vocabularies, as their libraries state it.
BYTE_LEVEL_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Settings of a tokenizer .json under which its ids are those of ranked byte merges; with others only the library is used.
PLAIN_MODEL = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "byte_fallback": False, "ignore_merges": False}
PLAIN_SPLIT = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}


def merges_alone(spec: dict) -> bool:
    """Whether a tokenizer .json says nothing but byte-level merges: no normaliser, no flags on special strings."""
    split, model = spec.get("pre_tokenizer") or {}, spec["model"]
    unset = not any(spec.get(x) for x in ("normalizer", "truncation", "padding"))
    special = all(not any(t.get(x) for x in ("single_word", "lstrip", "rstrip", "normalized")) for t in spec["added_tokens"])
    same = lambda given, wanted: all((given.get(k) or None) == (v or None) for k, v in wanted.items())
    return unset and special and same(split, PLAIN_SPLIT) and same(model, PLAIN_MODEL)


def byte_level_encoding(spec: dict):
    """The vocabulary of a byte-level tokenizer .json as ranks, whose ids are the same and come several times faster."""
    import tiktoken

    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    shown = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
    ranks = {bytes(shown[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in special}
    return tiktoken.Encoding("byte-level", pat_str=BYTE_LEVEL_PATTERN, mergeable_ranks=ranks, special_tokens=special)


class Encoder:
    """The ids that the tokenizer library gives, by the faster engine where the .json allows it and the text suits it."""

    def __init__(self, path: str):
        self.path = path
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.fast = byte_level_encoding(spec) if merges_alone(spec) else None

    @cached_property
    def library(self):
        """Loaded where it is needed: it takes as much of a worker's memory as the engine."""
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(self.path)
        library.no_truncation()
        library.no_padding()
        return library

    def ids(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False)
            except ValueError:  # its regex engine gives up on very long runs of white space, which the library reads
                pass
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")


class Packer:
    """Open windows of one partition; pieces are (row, start, ids)."""

    def __init__(self, length: int, most_open: int, first_sequence: int):
        self.length, self.most_open, self.sequence = length, most_open, first_sequence
        self.open: list[tuple[int, list]] = []
        self.sealed: list[tuple] = []

    def seal(self, pieces: list) -> None:
        offset = 0
        for row, start, ids in pieces:
            self.sealed.append((row, start, ids, self.sequence, offset))
            offset += len(ids)
        self.sequence += 1

    def add(self, row, start: int, ids: np.ndarray) -> None:
        size = self.length
        whole = len(ids) // size * size
        for i in range(0, whole, size):
            self.seal([(row, start + i, ids[i : i + size])])
        start, ids = start + whole, ids[whole:]
        while len(ids):
            gaps = [size - n for n, _ in self.open]
            fits = [i for i, gap in enumerate(gaps) if gap >= len(ids)]
            if fits:
                i = min(fits, key=gaps.__getitem__)
                n, pieces = self.open[i]
                pieces.append((row, start, ids))
                if n + len(ids) == size:
                    self.seal(self.open.pop(i)[1])
                else:
                    self.open[i] = (n + len(ids), pieces)
                return
            if len(self.open) < self.most_open:
                self.open.append((len(ids), [(row, start, ids)]))
                return
            i = min(range(len(gaps)), key=gaps.__getitem__)
            self.seal(self.open.pop(i)[1] + [(row, start, ids[: gaps[i]])])
            start, ids = start + gaps[i], ids[gaps[i] :]

    def merge(self) -> list:
        """Merge the open windows, fullest first, the emptiest cut to top up the others; the pieces of the tail."""
        left = sorted(self.open, key=lambda w: -w[0])
        self.open = []
        while len(left) > 1:
            n, pieces = left.pop(0)
            while n < self.length and left:
                m, more = left.pop()
                row, start, ids = more.pop()
                take = min(len(ids), self.length - n)
                pieces.append((row, start, ids[:take]))
                n += take
                if take < len(ids):
                    more.append((row, start + take, ids[take:]))
                if more:
                    left.append((m - take, more))
            if n < self.length:
                return pieces
            self.seal(pieces)
        return left[0][1] if left else []


SCHEMA = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, tail boolean"


def pack(
    docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", length: int = 2048, end_id: int = 1, most_open: int = 32, merge_fan: int = 64
) -> DataFrame:
    """Per piece: id, start in its document, length, ids (little-endian uint32), doc_tokens, sequence_id, offset there."""
    kind = docs.schema[id_col].dataType.simpleString()

    def batch(ids_of, pieces: list, tail: bool) -> pa.RecordBatch:
        rows, starts, ids, sequences, offsets = zip(*pieces) if pieces else ((),) * 5
        names = ["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "tail"]
        return pa.RecordBatch.from_arrays(
            [
                pa.array([r[0] for r in rows], ids_of),
                pa.array(starts, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([x.tobytes() for x in ids], pa.binary()),
                pa.array([r[1] for r in rows], pa.int64()),
                pa.array(sequences, pa.int64()),
                pa.array(offsets, pa.int64()),
                pa.array([tail] * len(rows), pa.bool_()),
            ],
            names=names,
        )

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(tokenizer_path)
        packer = Packer(length, most_open, TaskContext.get().partitionId() << 32)
        end = np.array([end_id], dtype="<u4")
        ids_of = None
        for given in batches:
            ids_of = given.column(0).type
            for key, text in zip(given.column(0).to_pylist(), given.column(1)):
                ids = np.concatenate([encoder.ids(text.as_py() or ""), end])
                packer.add((key, len(ids)), 0, ids)
                if len(packer.sealed) >= 4096:
                    yield batch(ids_of, packer.sealed, False)
                    packer.sealed = []
        if ids_of is not None:
            tail = packer.merge()
            yield batch(ids_of, packer.sealed, False)
            yield batch(ids_of, [(row, start, ids, TaskContext.get().partitionId(), 0) for row, start, ids in tail], True)

    def again(key: tuple, tails: pa.Table) -> pa.Table:
        packer = Packer(length, 1, (1 << 62) | (key[0].as_py() << 32))
        rows = tails.sort_by([("sequence_id", "ascending"), ("piece", "ascending")]).to_pylist()
        for r in rows:
            packer.add((r["id"], r["doc_tokens"]), r["start"], np.frombuffer(r["ids"], dtype="<u4"))
        if packer.open:
            packer.seal(packer.open.pop()[1])
        return pa.Table.from_batches([batch(tails.schema.field("id").type, packer.sealed, True)])

    bounded_batches(docs.sparkSession)
    given = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    made = checkpointed(given.mapInArrow(first, f"id {kind}, {SCHEMA}"))
    tails = made.where("tail").withColumn("piece", F.monotonically_increasing_id())
    merged = tails.groupBy(F.floor(F.col("sequence_id") / merge_fan).alias("merge_group")).applyInArrow(again, f"id {kind}, {SCHEMA}")
    return made.where("not tail").unionByName(merged).drop("tail").withColumnRenamed("id", id_col)
