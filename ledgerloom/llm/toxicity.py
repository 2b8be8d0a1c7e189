"""Toxicity by subword bags averaged into a linear softmax, trained jointly.

A few insults make a long text toxic, so the average over a text's words is weighted by their own evidence (`FOCUS`);
misspellings not seen in training share most of their n-grams with ones that were. Null and empty texts have no words
and score as the model's bias; texts are scored whole; rows are neither merged nor dropped; without labels of both
kinds the score is one constant; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.llm import labelled
from ledgerloom.llm.subword import LOWER, Model

TRAIN_ROWS = 3000
FOCUS = 1.0


def train_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", most_rows: int = TRAIN_ROWS) -> Model:
    return labelled.train(docs, labels, label, most_rows, case=LOWER, focus=FOCUS, word_dropout=0.3, epochs=20, reach=1000.0)


def toxicity_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    return labelled.scores(docs, model, keep=keep, name=name)
