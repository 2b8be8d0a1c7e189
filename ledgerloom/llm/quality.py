"""Text quality by learned hashed word and character n-gram vectors, averaged per document, with a softmax output.

Case is kept, and a word that repeats the one before it has the vector of repetition besides its own, so shouting and
stuttering can be learned. Null and empty texts have no words and score as the model's bias; texts are scored whole; rows are neither
merged nor dropped; without labels of both kinds the score is one constant; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ledgerloom.llm import labelled
from ledgerloom.llm.subword import PLAIN, Model

TRAIN_ROWS = 3000


def train_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", most_rows: int = TRAIN_ROWS) -> Model:
    return labelled.train(docs, labels, label, most_rows, case=PLAIN, repeats=True)


def quality_scores(docs: DataFrame, model: Model, keep: tuple[str, ...] = (), name: str = "score") -> DataFrame:
    return labelled.scores(docs, model, keep=keep, name=name)
