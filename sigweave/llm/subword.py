"""A linear softmax over averaged vectors of hashed words and character n-grams.

Features are made on the executors; stochastic gradient descent runs on the driver, in numpy, over a
bounded sample.  What is sent out to score is one number per feature and class.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sigweave.llm.hashing import Chunk, chunks, mix
from sigweave.llm.tables import text_of


@dataclass(frozen=True)
class Settings:
    """``rows``: about so many training rows per class at most, whole texts.

    A row has at most ``buckets`` features, so classes x rows x buckets x 8 bytes bound what reaches the driver.
    """

    rows: int = 1_500
    buckets: int = 1 << 16
    grams: tuple[int, ...] = (2, 3, 4)
    lower: str = "all"
    pairs: bool = False  # also hashed pairs of neighbouring words
    dim: int = 16
    epochs: int = 12
    rate: float = 0.5
    seed: int = 7


def _features(chunk: Chunk, s: Settings) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``(document, bucket)`` of all words, word pairs and n-grams."""
    words = chunk.words()
    mask = np.uint64(s.buckets - 1)
    yield chunk.word_doc, (words & mask).astype(np.int64)
    if s.pairs and len(words) > 1:
        same = chunk.word_doc[1:] == chunk.word_doc[:-1]
        # A word that repeats the one before it is a feature of its own, whichever word it is.
        pair = np.where(words[1:] == words[:-1], np.uint64(1), words[:-1] * np.uint64(3) + words[1:])
        yield chunk.word_doc[1:][same], (mix(pair[same]) & mask).astype(np.int64)
    for n in s.grams:
        word, hashes = chunk.grams(n)
        yield chunk.word_doc[word], ((hashes ^ np.uint64(n)) & mask).astype(np.int64)


def _counted(s: Settings):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for text in frame["text"]:
                every = [b for c in chunks([text], s.lower) for _, b in _features(c, s)]
                ids, n = np.unique(np.concatenate(every), return_counts=True) if every else (np.empty(0, np.int64),) * 2
                rows.append((ids.astype(np.int32), (n / max(1, n.sum())).astype(np.float32)))
            yield pd.DataFrame({"label": frame["label"], "ids": [r[0] for r in rows], "weights": [r[1] for r in rows]})

    return run


@dataclass
class Model:
    classes: list[str]
    scores: np.ndarray  # buckets x classes: what a feature adds to a class
    bias: np.ndarray
    settings: Settings
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[str]) -> np.ndarray:
        total = np.zeros((len(texts), len(self.classes)))
        count = np.zeros(len(texts))
        for chunk in chunks(texts, self.settings.lower):
            for doc, bucket in _features(chunk, self.settings):
                count += np.bincount(doc, minlength=len(texts))
                for c in range(len(self.classes)):
                    total[:, c] += np.bincount(doc, weights=self.scores[bucket, c], minlength=len(texts))
        return total / np.maximum(count, 1)[:, None] + self.bias

    def probabilities(self, texts: list[str]) -> np.ndarray:
        return softmax(self.logits(texts) / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


Row = tuple[int, np.ndarray, np.ndarray]  # class, feature ids, weights


def descend(rows: list[Row], classes: int, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stochastic gradient descent, row by row: feature vectors, class vectors, biases.

    A row's gradient is scaled by its number of features, as the average divides it by that twice.
    """
    rng = np.random.default_rng(s.seed)
    vectors = rng.uniform(-0.5, 0.5, (s.buckets, s.dim)).astype(np.float32)
    weights, bias = np.zeros((classes, s.dim), np.float32), np.zeros(classes, np.float32)
    steps, done = max(1, s.epochs * len(rows)), 0
    for _ in range(s.epochs):
        for i in rng.permutation(len(rows)):
            label, ids, w = rows[i]
            rate = np.float32(s.rate * (1 - done / steps))
            done += 1
            hidden = w @ vectors[ids]
            z = weights @ hidden + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = weights.T @ p
            weights -= rate * np.outer(p, hidden)
            bias -= rate * np.float32(0.1) * p
            if len(ids):
                vectors[ids] -= (rate / max(float(w @ w), 1e-3)) * w[:, None] * back[None, :]
    return vectors, weights, bias


def held_out(key: Column, modulus: int, rest: int) -> Column:
    return F.crc32(key.cast("string").cast("binary")) % modulus == rest


def sampled(labelled: DataFrame, label: str, key: str, s: Settings) -> DataFrame:
    """About ``rows`` rows of each label, chosen by a hash of the key."""
    n = F.broadcast(labelled.groupBy(label).count().withColumnRenamed(label, "__of"))  # a row per class of the model
    chosen = labelled.join(n, labelled[label] == n["__of"])
    draw = F.pmod(F.xxhash64(F.lit(s.seed), key), F.lit(1 << 30)) / F.lit(float(1 << 30))
    return chosen.filter(draw * F.col("count") < s.rows).drop("__of", "count")


def fit(rows: DataFrame, s: Settings, classes: list[str] | None = None) -> Model | None:
    """The model of ``rows`` (label string, text); None if there are none.

    A fifth of the rows is kept from training and sets the temperature that makes the scores
    probabilities, and ``threshold``: the score that all but one in a hundred of them reach.
    """
    got = rows.select("label", text_of().alias("text")).mapInPandas(
        _counted(s), "label string, ids array<int>, weights array<float>"
    ).toArrow()
    labels = got.column("label").to_pylist()
    if not labels:
        return None
    classes = classes or sorted(set(labels))
    ids, weights = got.column("ids").combine_chunks(), got.column("weights").combine_chunks()
    data: list[Row] = [
        (classes.index(label), ids[i].values.to_numpy(), weights[i].values.to_numpy()) for i, label in enumerate(labels)
    ]
    # An order that does not depend on how the rows arrived.
    data.sort(key=lambda r: (r[0], len(r[1]), r[1].tobytes(), r[2].tobytes()))
    kept = [r for i, r in enumerate(data) if i % 5 == 4]
    vectors, weights, bias = descend([r for i, r in enumerate(data) if i % 5 != 4], len(classes), s)
    model = Model(classes, (vectors @ weights.T).astype(np.float32), bias.astype(np.float64), s)
    if kept:
        z = np.stack([w @ model.scores[i] + model.bias for _, i, w in kept]).astype(np.float64)
        y = np.array([r[0] for r in kept])
        loss = lambda t: -np.log(softmax(z / t)[np.arange(len(y)), y] + 1e-12).mean()
        model.temperature = float(min(np.geomspace(0.25, 20, 60), key=loss))
        model.threshold = float(np.quantile(softmax(z / model.temperature).max(axis=1), 0.01))
    return model


def predictor(model: Model, df: DataFrame):
    """A column function: struct of the likeliest class and of every class's probability."""
    sent = df.sparkSession.sparkContext.broadcast(model)
    kind = T.StructType([T.StructField("best", T.StringType()), T.StructField("p", T.ArrayType(T.DoubleType()))])

    @F.pandas_udf(kind)
    def predict(texts: pd.Series) -> pd.DataFrame:
        model = sent.value
        parts = [model.probabilities(texts.iloc[i : i + 512].tolist()) for i in range(0, len(texts), 512)]
        p = np.concatenate(parts) if parts else np.empty((0, len(model.classes)))
        return pd.DataFrame({"best": [model.classes[i] for i in p.argmax(axis=1)], "p": list(p)})

    return predict
