"""Fit a subword model on a bounded sample of labelled documents and score every document with it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import SCORE_BYTES, bounded_batches, bounded_sample, bounded_texts, checkpointed, row_blocks, text_buffer
from ledgerloom.llm.subword import Model, fit

#: Most bytes of text that the training sample holds, half of them of each label; texts are taken whole or not at all.
TRAIN_BYTES = 12 << 20
#: How far the bias goes from the sample's odds of the labels, on a log scale, to those of all labelled rows.
ODDS_SHARE = 0.7


def train(
    docs: DataFrame, labels: DataFrame, label: str, most_rows: int, id_col: str = "doc_id", text_col: str = "text", most_bytes: int = TRAIN_BYTES, **settings
) -> Model:
    """A model from `most_rows` labelled documents and `most_bytes` of their texts at most, half of each label where there are enough.

    Labelled ids are chosen by a hash and then distinct texts of theirs by another, so an id or a text that repeats
    counts once; the model's bias is then moved towards the odds of the labels among all labelled rows. Labels other
    than 0 and 1 and null ids are left out; of several labels of one id the larger counts, of several documents of one
    id each is used. `docs` and `labels` must leave out what may not be learned from.
    """
    given = labels.where(F.col(label).isin(0, 1) & F.col(id_col).isNotNull()).select(id_col, F.col(label).alias("label_value"))
    counts = dict(given.groupBy("label_value").count().collect())
    parts = [bounded_sample(given.where(F.col("label_value") == k), id_col, most_rows // 2, counts.get(k, 0)) for k in (0, 1)]
    chosen = parts[0].unionByName(parts[1]).groupBy(id_col).agg(F.max("label_value").alias("label_value"))
    found = docs.select(id_col, F.col(text_col).alias("text_value")).join(F.broadcast(checkpointed(chosen)), id_col)
    rows = bounded_texts(found, "label_value", "text_value", most_rows, most_bytes).toArrow()
    model = fit(rows["text_value"].to_pylist(), np.array(rows["label_value"].to_pylist(), dtype=float), **settings)
    used = [sum(x == k for x in rows["label_value"].to_pylist()) for k in (0, 1)]
    if all(counts.get(k) and used[k] for k in (0, 1)):
        model.bias += ODDS_SHARE * float(np.log(counts[1] / counts[0]) - np.log(used[1] / used[0]))
    return model


def scores(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    """The id, the columns of `keep`, and the probability of label 1 for every row; null texts count as empty."""
    names = list(dict.fromkeys([id_col, *keep]))
    given = docs.select(*names, *([] if text_col in names else [text_col]))
    at = given.columns.index(text_col)
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            body, offsets = text_buffer(batch.column(at))
            found = [shared.value.probabilities(body, offsets[a : b + 1]) for a, b in row_blocks(offsets, SCORE_BYTES)]
            out = np.concatenate(found) if found else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(out)], names=[*names, name])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in given.schema.fields[: len(names)])
    return given.mapInArrow(run, f"{kinds}, `{name}` double")
