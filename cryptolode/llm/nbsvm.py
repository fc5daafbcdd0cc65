"""Linear text classifiers on n-gram indicators scaled by naive Bayes log-count ratios (NB-SVM).

The model is fitted in one task on a bounded sample of labelled rows (Settings.per_class of each class, chosen by a hash
of their id) and has a fixed number of weights, so its broadcast has a fixed size; scoring reads every whole text.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import new_names
from .hashing import char_ngrams, word_ngrams

FEATURES: dict[str, Callable[[str, tuple[int, ...], int], np.ndarray]] = {"char": char_ngrams, "word": word_ngrams}


@dataclasses.dataclass(frozen=True)
class Settings:
    """kinds: n-gram orders by kind of n-gram. bits: log2 of the number of weights. per_class: the sample's bound.
    least_count: n-grams in fewer texts of the sample have no weight."""

    kinds: tuple[tuple[str, tuple[int, ...]], ...]
    bits: int = 18
    per_class: int = 4000
    smoothing: float = 1.0
    cost: float = 0.01
    epochs: int = 8
    least_count: int = 1
    folds: int = 3
    seed: int = 5


class Indicators:
    """Distinct hashed n-grams of texts, found without sorting by a table of last positions."""

    def __init__(self, settings: Settings) -> None:
        self.settings = settings
        self.last = np.zeros(1 << settings.bits, np.int32)

    def __call__(self, text: str | None) -> np.ndarray:
        s = self.settings
        index = np.concatenate([FEATURES[kind](text or "", orders, s.bits) for kind, orders in s.kinds])
        order = np.arange(len(index), dtype=np.int32)
        self.last[index] = order
        return index[self.last[index] == order]


def log_count_ratios(rows: list[np.ndarray], y: np.ndarray, s: Settings) -> np.ndarray:
    counts = np.full((2, 1 << s.bits), s.smoothing)
    for index, label in zip(rows, y, strict=True):
        counts[int(label > 0), index] += 1
    share = counts / counts.sum(axis=1, keepdims=True)
    ratios = np.log(share[1] / share[0]).astype(np.float32)
    ratios[counts.sum(axis=0) < s.least_count + 2 * s.smoothing] = 0
    return ratios


def dual_coordinate_descent(rows: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, s: Settings) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear hinge-loss model on indicators scaled by ratios: for one row after another, the
    exact step of its dual variable within [0, cost]; rows of the rarer class cost more, in proportion."""
    w = np.zeros(len(ratios), np.float32)
    bias = 0.0
    alpha = np.zeros(len(rows))
    share = max((y > 0).mean(), 1e-9)
    most = np.where(y > 0, 0.5 / share, 0.5 / max(1 - share, 1e-9)) * s.cost
    norms = [float(ratios[i] @ ratios[i]) + 1.0 for i in rows]
    rng = np.random.default_rng(s.seed)
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            index = rows[i]
            x = ratios[index]
            gradient = y[i] * (float(w[index] @ x) + bias) - 1.0
            new = min(max(alpha[i] - gradient / norms[i], 0.0), most[i])
            if new != alpha[i]:
                step = (new - alpha[i]) * y[i]
                w[index] += np.float32(step) * x
                bias += step
                alpha[i] = new
    return w * ratios, bias


def platt(margins: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the chance of label 1 given the margin, by Newton's method on the weighted log loss."""
    a, b = 1.0, 0.0
    t = (y > 0).astype(float)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -30, 30)))
        g = weight * (p - t)
        h = weight * p * (1 - p) + 1e-9
        grad = np.array([(g * margins).sum() + 1e-2 * (a - 1), g.sum()])
        hess = np.array([[(h * margins * margins).sum() + 1e-2, (h * margins).sum()], [(h * margins).sum(), h.sum() + 1e-6]])
        step = np.linalg.solve(hess, grad)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-8:
            break
    return max(a, 1e-3), b


def fit(texts: list[str | None], labels: list[int], weights: list[float], s: Settings) -> np.ndarray:
    """The model as one float array: the weights, then bias, slope and intercept. The curve is fitted to the margins that
    each fold's rows get from a model of the others; the final weights come from all rows."""
    find = Indicators(s)
    rows = [find(t).astype(np.int32) for t in texts]
    y = np.where(np.array(labels) > 0, 1.0, -1.0)
    weight = np.array(weights)
    if len(rows) < 8 or len(set(y)) < 2:  # nothing to tell apart: the share of label 1 for any text
        share = (weight[y > 0].sum() + 0.5) / (weight.sum() + 1.0) if len(rows) else 0.5
        return np.concatenate([np.zeros(1 << s.bits), [0.0, 1.0, np.log(share / (1 - share))]])
    margins = np.zeros(len(rows))
    for fold in range(s.folds):
        part = np.arange(len(rows)) % s.folds == fold
        own = [r for r, out in zip(rows, part, strict=True) if not out]
        if len(set(y[~part])) < 2:
            continue
        w, bias = dual_coordinate_descent(own, y[~part], log_count_ratios(own, y[~part], s), s)
        for i in np.flatnonzero(part):
            margins[i] = w[rows[i]].sum() + bias
    seen = margins != 0
    slope, intercept = platt(margins[seen], y[seen], weight[seen]) if seen.any() and len(set(y[seen])) == 2 else (1.0, 0.0)
    w, bias = dual_coordinate_descent(rows, y, log_count_ratios(rows, y, s), s)
    return np.concatenate([w, [bias, slope, intercept]])


def fit_on_spark(docs: DataFrame, labels: DataFrame, label: str, s: Settings, learn) -> np.ndarray:
    """Fit on the rows of labels (doc_id, label) where learn(id column name) holds: s.per_class rows of each class at
    most, by the order of a hash of the id. Labels other than 0 and 1 are ignored; of several for one id the largest
    counts; ids without a document are passed over."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label")).where("label in (0, 1) and doc_id is not null")
    known = known.groupBy("doc_id").agg(F.max("label").alias("label")).where(learn("doc_id"))
    sizes = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}  # two rows
    ids = [r for y in (0, 1) for r in known.where(F.col("label") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(s.per_class).collect()]
    weight = {y: n / max(1, min(n, s.per_class)) for y, n in sizes.items()}
    spark = docs.sparkSession
    chosen = spark.createDataFrame([(r["doc_id"], r["label"], weight[r["label"]]) for r in ids], "id long, label int, weight double")
    sample = docs.select(F.col("doc_id").cast("long").alias("id"), "text").join(F.broadcast(chosen), "id")  # 2 * per_class rows at most

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted({(id, text or "", label, weight) for b in batches for id, text, label, weight in zip(*(c.to_pylist() for c in b.columns), strict=True)})
        np.random.default_rng(s.seed).shuffle(rows)
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        model = fit([str(t) for t in columns[1]], [int(x) for x in columns[2]], [float(x) for x in columns[3]], s)
        yield pa.RecordBatch.from_arrays([pa.array([model.astype("<f4").tobytes()], pa.binary())], ["model"])

    row = sample.repartition(1).mapInArrow(train, "model binary").first()
    return np.frombuffer(row["model"], "<f4") if row else fit([], [], [], s)


def score(docs: DataFrame, model: np.ndarray, s: Settings, keep: list[str], name: str = "score") -> DataFrame:
    """docs' columns `keep` and a score from 0 to 1 of each whole text; null text is empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of a fixed size, by s.bits
    text = new_names(docs, "text")[0]
    rows = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias(text))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, m = Indicators(s), shared.value
        w, (bias, slope, intercept) = m[:-3].astype(np.float64), m[-3:]
        for batch in batches:
            margins = np.array([w[find(t.as_py())].sum() + bias for t in batch.column(len(keep))])
            out = 1 / (1 + np.exp(-np.clip(slope * margins + intercept, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.float64())], [*keep, name])

    return rows.mapInArrow(scored, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), f"`{name}` double"]))
