"""Quality classifier: naive Bayes support vectors on word and short character n-gram indicators.

Indicators are scaled by the classes' log-count ratios, and a linear hinge-loss model is fitted to them by dual
coordinate descent; a logistic curve fitted to held-aside margins turns margins into scores.

Defined results: null and empty texts get the score of a text without n-grams; a repeated row is scored again; labels
that are null, repeated or without a document are handled as nbsvm.fit_on_spark says; a text of any length is scored whole; texts
with the same n-grams tie at the same score, and a score at the threshold is predicted as 1; an empty table gives an empty
result; without labels of both classes
every score is the smoothed share of label 1; further columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .nbsvm import Settings, fit_on_spark, score

SETTINGS = Settings(kinds=(("word", (1, 2)), ("char", (1, 2, 3))), per_class=4000, cost=0.01)
THRESHOLD = 0.5


def train(docs: DataFrame, labels: DataFrame, learn, settings: Settings = SETTINGS):
    """learn: a function from a column name to the condition under which a row's label may be learnt."""
    return fit_on_spark(docs, labels, "quality", settings, learn)


def quality(docs: DataFrame, model, settings: Settings = SETTINGS, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs' columns keep, score (higher: good quality is likelier) and predicted."""
    scored = score(docs, model, settings, list(keep))
    return scored.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))
