"""Quality classifier on supervised subword embeddings.

Features of a text are its words, its pairs of neighbouring words (a repeated word is one feature
of its own) and its character n-grams of 3 and 4 within words, all hashed into one table of
vectors. A document is the average of its features' vectors; a softmax layer turns it into class
probabilities. Vectors and layer are learned together by stochastic gradient descent in numpy.

With two classes the layer needs only the difference of its rows, so for scoring each vector is
folded into one number, and a document's score is the logistic of the average of its features'
numbers. The fold is exact.

Training reads labelled rows only, at most `per_class` of each class, chosen by hash among those not
held out, and of these the shortest texts that have `max_chars` characters together; these bounds
are the only sample. One
task trains, so neither texts nor features come to the driver. Scoring reads every whole text.

Defined cases: null text is empty; a text without words has no features and gets the score of the
layer's bias. Of the rows that repeat a labelled id one is trained on, chosen by hash of its text. Documents labelled both ways are not trained on. With fewer than two classes to
learn from every score is the share of class 1, or 0.5 without labels. Labels, language, source
and id are never inputs of a score. Other columns are ignored.

Scale: one pass over the documents, no shuffle; the model is a megabyte. The labels of the sample
are picked before any text is read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import fold, held_out

BITS = 18
NGRAMS = (3, 4)
_IS_SPACE = np.zeros(0x21, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)
_FOLD = np.uint32(0x2C1B3C6D)


def _bucket(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint32(15))) * _FOLD
    return (h ^ (h >> np.uint32(13))) & np.uint32((1 << BITS) - 1)


def features(text: str) -> np.ndarray:
    """Hashed features of a whole text, one entry for each occurrence."""
    chars = np.frombuffer(f" {text} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    space = _IS_SPACE[np.minimum(chars, 0x20)] & (chars <= 0x20)
    if space.all():
        return np.zeros(0, np.uint32)
    chars = np.where(space, np.uint32(1), chars)  # one mark for all word limits
    gaps = np.cumsum(space, dtype=np.int32)
    found = []
    for n in NGRAMS:
        count = len(chars) - n + 1
        if count <= 0:
            continue
        h = np.full(count, n * 0x01000193, np.uint32)
        for i in range(n):
            h = (h ^ chars[i:i + count]) * _ODD[i]
        # The limits may be an n-gram's first and last character, but not lie inside it.
        inner = gaps[n - 2:n - 2 + count] - gaps[:count] == 0
        letter = ~(space[:count] & space[n - 1:n - 1 + count]) if n > 2 else inner
        found.append(_bucket(h[inner & letter]))
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    lengths = ends - starts
    place = np.arange(len(chars), dtype=np.uint32) - np.repeat(np.concatenate(([0], starts)), np.diff(np.concatenate(([0], starts, [len(chars)])))).astype(np.uint32)
    value = np.where(space, np.uint32(0), (chars ^ (chars << np.uint32(7))) * (place * _ODD[2] | np.uint32(1)))
    words = np.add.reduceat(value, starts) * _ODD[0] + lengths.astype(np.uint32)
    found.append(_bucket(words))
    if len(words) > 1:
        pair = np.where(words[1:] == words[:-1], np.uint32(77), words[1:] * _ODD[1] ^ words[:-1])
        found.append(_bucket(pair * _ODD[3]))
    return np.concatenate(found)


@dataclass(frozen=True)
class Model:
    """One number per feature, and the bias; a document's logit is their average plus the bias."""
    weights: np.ndarray
    bias: float

    def score(self, text: str | None) -> float:
        hashed = features(text or "")
        logit = (float(self.weights[hashed].mean(dtype=np.float64)) if len(hashed) else 0.0) + self.bias
        return float(1 / (1 + np.exp(-np.clip(logit, -40, 40))))


def train(texts: list[str], labels: list[int], dim: int = 12, epochs: int = 6, rate: float = 0.4, seed: int = 7, whole: bool = False):
    """Embeddings and softmax layer by stochastic gradient descent, one document a step; the folded model,
    with `whole` also the vectors, the layer and its bias."""
    size = 1 << BITS
    classes = np.array(labels)
    share = float(classes.mean()) if len(classes) else 0.5
    if len(set(labels)) < 2:
        share = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(size, np.float32), float(np.log(share / (1 - share))))
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (size, dim)).astype(np.float32)
    layer = rng.uniform(-0.5, 0.5, (2, dim)).astype(np.float32)
    bias = np.zeros(2, np.float32)
    weight = np.where(classes == 1, 0.5 / share, 0.5 / (1 - share))
    docs = []
    for text in texts:
        ids, counts = np.unique(features(text), return_counts=True)
        docs.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    steps, done = epochs * len(docs), 0
    for _ in range(epochs):
        for i in rng.permutation(len(docs)):
            ids, part = docs[i]
            step = rate * (1 - done / steps) * weight[i]
            done += 1
            hidden = part @ vectors[ids] if len(ids) else np.zeros(dim, np.float32)
            logits = layer @ hidden + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[classes[i]] -= 1
            back = layer.T @ p
            layer -= np.float32(step) * np.outer(p, hidden).astype(np.float32)
            bias -= np.float32(step * 0.1) * p.astype(np.float32)
            if len(ids):
                # The mean's gradient, scaled as if all features moved together.
                vectors[ids] -= np.float32(step) * np.outer(part * min(len(ids), 200), back).astype(np.float32)
    difference = layer[1] - layer[0]
    model = Model((vectors @ difference).astype(np.float32), float(bias[1] - bias[0]))
    return (model, vectors, layer, bias) if whole else model


MAX_CHARS = 16_000_000


def training_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id",
                    text_col: str = "text", max_chars: int = MAX_CHARS) -> DataFrame:
    """(id, text, label) of at most per_class documents of each class, by hash of the id, none of them held out."""
    voted = labels.where(F.col(label).isin(0, 1) & (fold(F.col("doc_id")) != 1)).groupBy("doc_id").agg(
        F.min(label).alias("low"), F.max(label).alias("high")).where("low = high")
    order = F.xxhash64(F.col("doc_id").cast("string")), F.col("doc_id")
    sample = None
    for value in (0, 1):
        part = voted.where(F.col("low") == value).orderBy(*order).limit(per_class)
        sample = part if sample is None else sample.unionByName(part)
    # At most twice per_class ids: a broadcast of proven size.
    chosen = F.broadcast(sample.select(F.col("doc_id").alias("label_id"), F.col("low").cast("int").alias("label")))
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).join(
        chosen, F.col("id") == F.col("label_id"))
    # An id may repeat without bound: one row of each, combined before the shuffle, so the bound holds for rows too.
    rows = rows.groupBy("label_id", "label").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return whole_texts_within(rows.select(F.col("label_id").alias("id"), "x.text", "label"), "label", "id", max_chars)


def whole_texts_within(rows: DataFrame, side: str, key: str, max_chars: int) -> DataFrame:
    """All rows of each side, or its shortest texts that have at most max_chars characters together."""
    before = Window.partitionBy(side).orderBy(F.char_length("text"), F.xxhash64(F.col(key).cast("string")), key).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    return rows.withColumn("_upto", F.sum(F.char_length("text")).over(before)).where(F.col("_upto") <= max_chars).drop("_upto")


def training_rows(docs: DataFrame, labels: DataFrame, label: str, per_class: int, *args, **options) -> list[tuple[str, int]]:
    """The sample as (text, label), in the order of the ids as text."""
    rows = training_sample(docs, labels, label, per_class, *args, **options).collect()
    rows.sort(key=lambda r: (str(r["id"]), r["text"]))
    return [(r["text"], r["label"]) for r in rows]


def fit_quality(docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 1500, **options) -> Model:
    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for batch in batches for r in batch.to_pylist()]
        rows.sort(key=lambda r: (r["name"], r["text"]))
        model = train([r["text"] for r in rows], [r["label"] for r in rows])
        yield pa.RecordBatch.from_arrays([pa.array([model.weights.tobytes()]), pa.array([model.bias])], ["weights", "bias"])
    sample = training_sample(docs, labels, label, per_class, **options)
    sample = sample.select(F.col("id").cast("string").alias("name"), "text", "label")
    row = sample.repartition(1).mapInArrow(fit, "weights binary, bias double").first()
    if row is None:  # no task ran
        return train([], [])
    return Model(np.frombuffer(bytes(row["weights"]), np.float32), row["bias"])


def score_column(model: Model, text: Column) -> Column:
    """Score of each text, in Arrow batches."""
    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        return texts.map(model.score).astype("float64")
    return score(F.coalesce(text, F.lit("")))


def quality(docs: DataFrame, labels: DataFrame, cut: float = 0.5, id_col: str = "doc_id", text_col: str = "text",
            **options) -> DataFrame:
    """Per row: id, held_out, score, predicted."""
    model = fit_quality(docs, labels, id_col=id_col, text_col=text_col, **options)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.array([model.score(t.as_py()) for t in batch["text"]], np.float64)
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["held_out"], pa.array(scores), pa.array((scores >= cut).astype(np.int32))],
                ["id", "held_out", "score", "predicted"])
    rows = docs.select(F.col(id_col).alias("id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


def good_documents(docs: DataFrame, labels: DataFrame, cut: float = 0.5, text_col: str = "text", **options) -> DataFrame:
    """The rows of docs whose text scores at least `cut`, all columns as they were."""
    model = fit_quality(docs, labels, text_col=text_col, **options)
    return docs.where(score_column(model, F.col(text_col)) >= cut)
