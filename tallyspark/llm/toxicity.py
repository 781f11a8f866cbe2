"""Toxicity by multiple-instance learning: a document is a bag of sentences.

A sentence's probability is the logistic of the weights of its distinct words and of their first four and five
letters; a document is toxic if any of its sentences is,
so its score is the noisy-or 1 - prod(1 - p). Only documents carry labels: training maximises the likelihood of
the noisy-or, whose gradient credits the sentences that explain a document. The sentence probabilities then
locate what offends.

Training uses a bounded sample of labelled documents (SAMPLE of each class, by a hash of their ids, among those
of at most LONGEST characters) and a vocabulary from it; every document is scored over its whole text.

Defined results: null, empty and wordless texts score 0; a document with contradictory labels trains as toxic;
labels other than 0 and 1 and rows of labels without a document don't train; without both classes all score 0;
rows without an id aren't held out and don't train.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyspark.llm.common import map_slices, ship, table

SAMPLE = 1500
LONGEST = 40_000
#: A feature enters the vocabulary if at least 3 documents of the sample, and one in so many of it, have it.
LEAST = 400
THRESHOLD = 0.7
EPOCHS = 400
#: A weight stays 0 unless the likelihood's slope exceeds this (L1).
SPARSE = 5e-5
_TOKEN = re.compile(r"[^\W\d_]+|[.!?\n]")
_ENDS = (".", "!", "?", "\n")


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample(docs: DataFrame, labels: DataFrame, size: int = SAMPLE, longest: int = LONGEST) -> list[tuple[str, int]]:
    """Up to size texts of each class."""
    marks = labels.where("toxic in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    marks = marks.where(~held_out())
    fitting = docs.where(F.length("text") <= longest)
    rows = fitting.select("doc_id").distinct().join(marks, "doc_id").withColumn("h", F.xxhash64("doc_id"))
    picked = [r for y in (0, 1) for r in rows.where(F.col("toxic") == y).orderBy("h", "doc_id").limit(size).collect()]
    if not picked:
        return []
    ids = docs.sparkSession.createDataFrame([(r["doc_id"], r["toxic"], r["h"]) for r in picked], "doc_id long, toxic int, h long")
    texts = fitting.join(F.broadcast(ids), "doc_id").groupBy("doc_id", "toxic", "h").agg(F.min("text").alias("text"))  # 2 size ids at most
    return [(r["text"], r["toxic"]) for r in sorted(texts.collect(), key=lambda r: (r["toxic"], r["h"], r["doc_id"]))]


def features(word: str) -> list[str]:
    return [word, *("^" + word[:k] for k in (4, 5) if len(word) >= k)]


class Model:
    """weights: of the vocabulary's words and beginnings; bias: of every sentence."""

    def __init__(self, weights: dict[str, float], bias: float):
        self.weights = dict(weights)
        self.bias = bias
        self.known: dict[str, float] = {}

    def weight(self, word: str) -> float:
        """A word's weight with those of its first letters."""
        w = self.known.get(word)
        if w is None:
            if len(self.known) > 300_000:
                self.known.clear()
            w = self.known[word] = sum(self.weights.get(f, 0.0) for f in features(word))
        return w

    def sentences(self, text: str | None) -> np.ndarray:
        """The probability of each sentence that has words, in order."""
        tokens = _TOKEN.findall((text or "").lower())
        if not tokens:
            return np.empty(0)
        known = self.known.get
        z = [w if (w := known(t)) is not None else self.weight(t) for t in tokens]
        z = np.array(z)
        ends = np.isinf(z)  # the ends of sentences come as infinities
        z[ends] = 0.0
        group = np.cumsum(ends) - ends
        words = np.bincount(group, weights=~ends)
        of = np.flatnonzero(z)
        first = {(g, tokens[i]): i for g, i in zip(group[of].tolist(), of.tolist(), strict=True)}
        once = np.fromiter(first.values(), np.int64, len(first))
        sums = np.bincount(group[once], weights=z[once], minlength=len(words))[words > 0] + self.bias
        return 1.0 / (1.0 + np.exp(-np.clip(sums, -50.0, 50.0)))

    def score(self, text: str | None) -> float:
        p = np.minimum(self.sentences(text), 1 - 1e-12)
        return float(-np.expm1(np.log1p(-p).sum())) if len(p) else 0.0

    def locate(self, text: str | None, least: float = 0.5) -> list[tuple[int, int, float]]:
        """start, end (code points) and probability of the sentences of at least that probability."""
        if not text:
            return []
        spans, start = [], 0
        for m in re.finditer(r"[.!?\n]|\Z", text):
            piece = text[start : m.start()]
            if _TOKEN.search(piece):
                spans.append((start, m.end()))
            start = m.end()
        out = []
        for a, b in spans:
            p = self.sentences(text[a:b])
            if len(p) and p[0] >= least:
                out.append((a, b, float(p[0])))
        return out


def train(rows: list[tuple[str, int]], epochs: int = EPOCHS, least: int = LEAST, sparse: float = SPARSE, rate: float = 0.5) -> Model:
    """Proximal Adagrad on the whole sample's noisy-or likelihood, each class with half of the weight."""
    stop = {e: float("inf") for e in _ENDS}
    y = np.array([label for _, label in rows], np.float64)
    if len(set(y.tolist())) < 2:
        return Model(stop, -50.0)
    tokens = [_TOKEN.findall(text.lower()) for text, _ in rows]
    seen: dict[str, int] = {}
    for t in tokens:
        for f in {f for w in set(t) - stop.keys() for f in features(w)}:
            seen[f] = seen.get(f, 0) + 1
    vocabulary = {f: i for i, f in enumerate(sorted(f for f, c in seen.items() if c >= max(3, len(rows) // least)))}
    word, sentence, bag = [], [], []
    for d, t in enumerate(tokens):
        inside: set[str] = set()
        for w in t:
            if w in stop:
                inside = set()
                continue
            if not inside:
                bag.append(d)
            if w not in inside:
                inside.add(w)
                got = [vocabulary[f] for f in features(w) if f in vocabulary]
                word += got
                sentence += [len(bag) - 1] * len(got)
    word_, sentence_, bag_ = np.array(word, np.int32), np.array(sentence, np.int32), np.array(bag, np.int32)
    n, s, v = len(rows), len(bag), len(vocabulary)
    share = np.where(y == 1, 0.5 / (y == 1).sum(), 0.5 / (y == 0).sum())
    w, b = np.zeros(v), -4.0
    gw, gb = np.full(v, 1e-8), 1e-8
    for _ in range(epochs):
        z = np.clip(np.bincount(sentence_, weights=w[word_], minlength=s) + b, -30.0, 30.0)
        p = 1.0 / (1.0 + np.exp(-z))
        none = np.exp(np.bincount(bag_, weights=np.log1p(-np.minimum(p, 1 - 1e-12)), minlength=n))
        # the slope for a sentence: p in a clean bag; -p * none / (1 - none) in a toxic one
        factor = np.where(y == 1, -none / np.maximum(1.0 - none, 1e-9), 1.0) * share
        g = factor[bag_] * p
        dw, db = np.bincount(word_, weights=g[sentence_], minlength=v), g.sum()
        gw += dw * dw
        gb += db * db
        step = rate / np.sqrt(gw)
        w -= step * dw
        w = np.sign(w) * np.maximum(np.abs(w) - step * sparse, 0.0)
        b -= rate * db / np.sqrt(gb)
    return Model({f: float(w[i]) for f, i in vocabulary.items() if w[i]} | stop, float(b))


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, score, predicted, n_offending, worst_start, worst_end of each row of docs."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # no larger than the sample's vocabulary

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        scores, n, a, b = [], [], [], []
        for text in batch.column(1).to_pylist():
            scores.append(x := m.score(text))
            found = m.locate(text) if x >= threshold else []
            worst = max(found, key=lambda f: (f[2], -f[0]), default=(None, None, 0.0))
            n.append(len(found))
            a.append(worst[0])
            b.append(worst[1])
        arrays = [pa.array(scores, pa.float64()), pa.array([int(x >= threshold) for x in scores], pa.int32())]
        arrays += [pa.array(x, pa.int64()) for x in (n, a, b)]
        return pa.RecordBatch.from_arrays([batch.column(0), *arrays], names=["doc_id", "score", "predicted", "n_offending", "worst_start", "worst_end"])

    return map_slices(
        docs.select(F.col("doc_id").cast("long"), "text"), run,
        "doc_id long, score double, predicted int, n_offending long, worst_start long, worst_end long",
    )


def drop_toxic(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """docs without the rows that score at least the threshold."""
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        m = shared.value
        keep = [m.score(t) < threshold for t in batch.column(at).to_pylist()]
        return batch.filter(pa.array(keep, pa.bool_()))

    at = docs.columns.index("text")
    return map_slices(docs, run, docs.schema)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = train(sample(docs, table(spark, sf_dir, "labels")))
    out = score(docs, model).withColumn("held_out", held_out())
    return out.select("doc_id", "held_out", "score", "predicted", "n_offending", "worst_start", "worst_end")
