"""Language identification by a bidirectional gated recurrent network over bytes.

The network reads a text's UTF-8 bytes in segments, forwards and backwards, and gives every byte a distribution over the
languages; a document's distribution is the mean over all its bytes. It is written in numpy and trained by
backpropagation through time, in one task, on a bounded sample of labelled rows; its weights are a few thousand numbers.

Defined results: null texts and texts without a letter are `und` with score 0; a repeated row is labelled again; a text of
any length is read whole, in segments between which the network's state starts anew; of languages with the same share the
first by name is named; rows without a lang teach nothing; if no language could be learnt every text is `und`; an empty
table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import dataclasses
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .common import materialize, new_names
from .hashing import batches_of

ASCII_LETTER = re.compile("[A-Za-z]")
UNDETERMINED = "und"
#: Ids of the sample that are broadcast, at most; more (of hundreds of languages) are joined by a shuffle.
MOST_BROADCAST = 200_000


def has_letter(text: str) -> bool:
    return bool(ASCII_LETTER.search(text)) or any(map(str.isalpha, text))


@dataclasses.dataclass(frozen=True)
class Settings:
    """hidden: units of each direction. length: bytes of a segment. per_lang: rows of a language in the sample, at most;
    their texts are learnt from whole. together: segments that are run at once."""

    hidden: int = 8
    length: int = 64
    per_lang: int = 250
    steps: int = 400
    batch: int = 256
    rate: float = 0.02
    together: int = 2048
    seed: int = 3


def segments(texts: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes as (length, n), each segment from one text and the last of a text padded; bytes used of each; its text."""
    sizes = np.array([len(t) for t in texts])
    parts = -(-sizes // length)
    out = np.zeros(int(parts.sum()) * length, np.uint8)
    begin = np.cumsum(parts) - parts
    for t, at in zip(texts, begin, strict=True):
        out[at * length : at * length + len(t)] = np.frombuffer(t, np.uint8)
    owner = np.repeat(np.arange(len(texts)), parts)
    used = np.minimum(length, sizes[owner] - (np.arange(len(owner)) - begin[owner]) * length)
    return np.ascontiguousarray(out.reshape(-1, length).T), used, owner


class Network:
    """Weights by name: for each direction an input table (gates by byte), recurrent weights and their bias, and the
    output weights. Arrays have units first and segments last. Gates in order: reset, update, new."""

    def __init__(self, weights: dict[str, np.ndarray]) -> None:
        self.w = weights

    @classmethod
    def new(cls, langs: int, s: Settings) -> Network:
        rng, h = np.random.default_rng(s.seed), s.hidden
        w = {}
        for d in "fb":
            w[f"in_{d}"] = rng.normal(0, 0.3, (3 * h, 256))
            w[f"rec_{d}"] = rng.normal(0, 0.5 / np.sqrt(h), (3 * h, h))
            w[f"bias_{d}"] = np.zeros((h, 1))
            w[f"out_{d}"] = rng.normal(0, 0.3, (langs, h))
        w["out_bias"] = np.zeros((langs, 1))
        return cls({k: v.astype(np.float32) for k, v in w.items()})

    def run(self, x: np.ndarray, d: str, keep: list | None = None) -> list[np.ndarray]:
        """Hidden states at each byte, in the order of the bytes; keep gets what backpropagation needs."""
        into, rec, bias, out = self.w[f"in_{d}"], self.w[f"rec_{d}"], self.w[f"bias_{d}"], self.w[f"out_{d}"]
        n = out.shape[1]
        h = np.zeros((n, x.shape[1]), np.float32)
        states: list[np.ndarray] = []
        for row in x if d == "f" else x[::-1]:
            g, r = np.take(into, row, axis=1), rec @ h
            gates = g[: 2 * n]
            gates += r[: 2 * n]
            gates *= 0.5
            np.tanh(gates, out=gates)
            gates *= 0.5
            gates += 0.5
            linear = r[2 * n :]
            linear += bias
            new = gates[:n] * linear
            new += g[2 * n :]
            np.tanh(new, out=new)
            after = h - new
            after *= gates[n:]
            after += new
            if keep is not None:
                keep.append((h, gates, linear, new))
            h = after
            states.append(h)
        return states if d == "f" else states[::-1]

    def chances(self, forward: np.ndarray, backward: np.ndarray) -> np.ndarray:
        p = self.w["out_f"] @ forward + self.w["out_b"] @ backward + self.w["out_bias"]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p /= p.sum(axis=0)
        return p

    def pooled(self, x: np.ndarray, used: np.ndarray) -> np.ndarray:
        """The sum over each segment's bytes of their distributions: (langs, segments)."""
        total = np.zeros((len(self.w["out_bias"]), x.shape[1]), np.float32)
        for t, (f, b) in enumerate(zip(self.run(x, "f"), self.run(x, "b"), strict=True)):
            total += self.chances(f, b) * (used > t)
        return total

    def gradients(self, x: np.ndarray, used: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
        """Of the mean log loss over bytes, by backpropagation through time."""
        grads = {k: np.zeros_like(v) for k, v in self.w.items()}
        kept: dict[str, list] = {"f": [], "b": []}
        states = {d: self.run(x, d, kept[d]) for d in "fb"}
        target = np.arange(len(self.w["out_bias"]))[:, None] == y
        errors = []
        for t in range(len(x)):
            e = (self.chances(states["f"][t], states["b"][t]) - target) * (used > t) / used.sum()
            grads["out_f"] += e @ states["f"][t].T
            grads["out_b"] += e @ states["b"][t].T
            grads["out_bias"] += e.sum(axis=1, keepdims=True)
            errors.append(e)
        for d in "fb":
            rec, out = self.w[f"rec_{d}"], self.w[f"out_{d}"]
            n = out.shape[1]
            dh = np.zeros((n, x.shape[1]), np.float32)
            rows, deltas = (x if d == "f" else x[::-1]), []
            errs = errors if d == "f" else errors[::-1]
            for t in range(len(x) - 1, -1, -1):
                h, gates, linear, new = kept[d][t]
                dh = dh + out.T @ errs[t]
                reset, update = gates[:n], gates[n:]
                dnew = dh * (1 - update) * (1 - new * new)
                dgates = np.concatenate([dnew * linear * reset * (1 - reset), dh * (h - new) * update * (1 - update)])
                dlinear = dnew * reset
                through = np.concatenate([dgates, dlinear])
                grads[f"rec_{d}"] += through @ h.T
                grads[f"bias_{d}"] += dlinear.sum(axis=1, keepdims=True)
                deltas.append(np.concatenate([dgates, dnew]))
                dh = dh * update + rec.T @ through
            flat = np.concatenate(deltas, axis=1)
            bytes_ = np.concatenate([rows[t] for t in range(len(x) - 1, -1, -1)])
            for unit in range(3 * n):
                grads[f"in_{d}"][unit] = np.bincount(bytes_, weights=flat[unit], minlength=256)
        return grads


def train(texts: list[bytes], labels: list[int], langs: int, s: Settings) -> Network:
    """Adam on batches that have all languages in equal parts, with a rate that falls to nothing. A batch's segments are any
    of documents that are drawn with equal chances, so that long ones don't outweigh the rest."""
    rng = np.random.default_rng(s.seed)
    net = Network.new(langs, s)
    x, used, owner = segments(texts, s.length)
    y = np.array(labels)[owner]
    parts = np.bincount(owner, minlength=len(texts))
    begin = np.cumsum(parts) - parts
    pools = [np.flatnonzero((np.array(labels) == k) & (parts > 0)) for k in range(langs)]
    first, second = ({k: np.zeros_like(v) for k, v in net.w.items()} for _ in range(2))
    for step in range(1, s.steps + 1):
        drawn = np.concatenate([rng.choice(p, max(1, s.batch // langs)) for p in pools if len(p)])
        pick = begin[drawn] + (rng.random(len(drawn)) * parts[drawn]).astype(int)
        grads = net.gradients(x[:, pick], used[pick], y[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        rate = s.rate * (1 - (step - 1) / s.steps)
        for k, g in grads.items():
            g = g / max(1.0, norm)
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.99 * second[k] + 0.01 * g * g
            net.w[k] -= (rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return net


def predict(net: Network, texts: list[bytes], s: Settings) -> np.ndarray:
    """The mean distribution over each text's bytes: (langs, texts)."""
    langs = len(net.w["out_bias"])
    out = np.zeros((langs, len(texts)))
    x, used, owner = segments(texts, s.length)
    for a in range(0, len(owner), s.together):
        part = slice(a, a + s.together)
        sums = net.pooled(x[:, part], used[part])
        for k in range(langs):
            out[k] += np.bincount(owner[part], weights=sums[k], minlength=len(texts))
    return out / np.maximum(1, [len(t) for t in texts])


def fit(docs: DataFrame, learn, s: Settings = Settings()) -> tuple[list[str], dict[str, np.ndarray]]:
    """Languages and weights, from the rows of docs (doc_id, text, lang) where learn(id column name) holds: for each
    language the s.per_lang rows that come first by a hash of the id. The languages themselves are few."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & learn("doc_id"))
    by = W.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    chosen = rows.select("lang", "doc_id").withColumn("nth", F.row_number().over(by)).where(F.col("nth") <= s.per_lang).select("doc_id", "lang").distinct()
    chosen = materialize(chosen, "language-sample")  # per_lang rows of each language
    sample = rows.join(F.broadcast(chosen) if chosen.count() <= MOST_BROADCAST else chosen, ["doc_id", "lang"])

    def learnt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = sorted({(lang, i or 0, text) for b in batches for i, lang, text in zip(*(b.column(c).to_pylist() for c in ("doc_id", "lang", "text")), strict=True) if text})
        langs = sorted({r[0] for r in got})
        if langs:
            net = train([r[2].encode() for r in got], [langs.index(r[0]) for r in got], len(langs), s)
            names = [*net.w]
            yield pa.RecordBatch.from_arrays([pa.array([langs]), pa.array([names]), pa.array([[list(net.w[k].shape) for k in names]]), pa.array([[net.w[k].astype("<f4").tobytes() for k in names]])], ["langs", "names", "shapes", "weights"])

    row = sample.repartition(1).mapInArrow(learnt, "langs array<string>, names array<string>, shapes array<array<long>>, weights array<binary>").first()
    if row is None:
        return [], {}
    return row["langs"], {k: np.frombuffer(b, "<f4").reshape(shape) for k, shape, b in zip(row["names"], row["shapes"], row["weights"], strict=True)}


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]], keep: tuple[str, ...] = ("doc_id",), s: Settings = Settings()) -> DataFrame:
    """docs' columns keep, lang_pred and score: the likeliest language of each whole text, and its share."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand numbers
    text = new_names(docs, "text")[0]
    rows = docs.select(*[docs[c] for c in keep], docs["text"].cast("string").alias(text))

    def labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, weights = shared.value
        net = Network(weights)
        for batch in batches:
            texts = batch.column(len(keep)).to_pylist()
            lang, score = [UNDETERMINED] * len(texts), [0.0] * len(texts)
            some = ((i, t) for i, t in enumerate(texts) if t and langs and has_letter(t))
            for part in batches_of(some, lambda r: len(r[1]), 2_000_000):
                chances = predict(net, [t.encode("utf-8", "surrogatepass") for _, t in part], s)
                for (i, _), k, p in zip(part, chances.argmax(axis=0), chances.max(axis=0), strict=True):
                    lang[i], score[i] = langs[k], min(1.0, float(p))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(lang), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return rows.mapInArrow(labelled, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[: len(keep)]), "lang_pred string, score double"]))
