"""Toxicity: a linear classifier on character n-gram indicators scaled by naive Bayes log-count ratios.

Defined results: null and empty texts get the score of a text without n-grams; a repeated row is scored again; labels
that are null, repeated or without a document are handled as nbsvm.fit_on_spark says; a text of any length is scored whole; texts
with the same n-grams tie at the same score, and a score at the threshold is predicted as 1; an empty table gives an empty
result; without labels of both classes
every score is the smoothed share of label 1; further columns are ignored by `toxicity` and kept by `drop_toxic`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_names
from .nbsvm import Settings, fit_on_spark, score

SETTINGS = Settings(kinds=(("char", (4, 5, 6)),), bits=20, per_class=4000, cost=0.03, least_count=4)
THRESHOLD = 0.3


def train(docs: DataFrame, labels: DataFrame, learn, settings: Settings = SETTINGS):
    """learn: a function from a column name to the condition under which a row's label may be learnt."""
    return fit_on_spark(docs, labels, "toxic", settings, learn)


def toxicity(docs: DataFrame, model, settings: Settings = SETTINGS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns keep, score (higher: toxic is likelier) and predicted."""
    scored = score(docs, model, settings, list(keep))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, model, settings: Settings = SETTINGS) -> DataFrame:
    """The rows of docs that aren't rejected, with all their columns."""
    name = new_names(docs, "toxicity")[0]
    return score(docs, model, settings, docs.columns, name).where(F.col(name) < THRESHOLD).select(*docs.columns)
