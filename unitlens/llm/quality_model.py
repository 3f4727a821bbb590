"""Quality classifier: subword embeddings trained with the labels, averaged per document, softmax on top.

A word's features are the word itself and the character 3- to 5-grams of the word between brackets, hashed into
``BUCKETS`` rows of an embedding table; a word that repeats the one before it adds a word of its own. A document is the mean of the vectors of all features of all its words. Table and
output layer are trained together by numpy stochastic gradient descent on a bounded sample. The output is linear in the
mean, so each different word has one logit, which a Python worker computes once and keeps.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from unitlens.llm.sampling import per_label
from unitlens.llm.storage import with_columns

BUCKETS, DIM, SIZES = 1 << 16, 16, (3, 4, 5)
#: Bounds of the training sample: documents of each label, characters of a document.
SAMPLE_PER_LABEL, SAMPLE_CHARS = 3_000, 30_000
EPOCHS, RATE = 4, 0.5
KEEP_WORDS = 800_000
AGAIN = "\0again"
CHUNK = 1 << 17
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    """The words, and the word ``AGAIN`` once for each that equals the one before it."""
    words = text.split() if text else []
    return words + [AGAIN] * sum(map(eq, words, words[1:]))


def word_features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(features, ends): the rows of each word, ``ends`` where each word's rows end."""
    sizes = np.fromiter(map(len, words), "i8", len(words)) + 2
    points = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    ends = np.cumsum(sizes)
    owner = np.repeat(np.arange(len(words)), sizes)
    left = ends[owner] - np.arange(len(points))  # characters to the end of the word, itself included
    features = [np.fromiter((zlib.crc32(w.encode("utf-8", "surrogatepass")) for w in words), "u8", len(words)) * _MULTIPLIER]
    owners = [np.arange(len(words))]
    rolling = np.zeros(len(points), "u8")
    for size in range(1, max(SIZES) + 1):
        rolling[:len(points) - size + 1] = (rolling[:len(points) - size + 1] + points[size - 1:] + np.uint64(size)) * _MULTIPLIER
        if size in SIZES:
            whole = left >= size
            features.append(rolling[whole] ^ (rolling[whole] >> np.uint64(31)))
            owners.append(owner[whole])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    rows = (np.concatenate(features)[order] >> np.uint64(40)).astype("i8") % BUCKETS
    return rows, np.cumsum(np.bincount(owner, minlength=len(words)))


@dataclass
class Model:
    """``logits``: the table times the output layer (row by label); ``bias``: the intercepts. Labels are 0 and 1."""

    logits: np.ndarray
    bias: np.ndarray

    def __post_init__(self) -> None:
        self._forget()

    def __getstate__(self) -> dict:
        return {"logits": self.logits, "bias": self.bias}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._forget()

    def _forget(self) -> None:
        self.index: dict[str, int] = {}
        self.sums, self.counts = np.zeros(1 << 12), np.zeros(1 << 12)

    def _learn(self, words: set[str]) -> None:
        if len(self.index) > KEEP_WORDS:
            raise AssertionError("forget before learning")
        new = list(words)
        for at in range(0, len(new), CHUNK):
            some = new[at:at + CHUNK]
            rows, ends = word_features(some)
            starts = np.concatenate([[0], ends[:-1]])
            first = len(self.index)
            while first + len(some) > len(self.sums):
                self.sums = np.concatenate([self.sums, np.zeros(len(self.sums))])
                self.counts = np.concatenate([self.counts, np.zeros(len(self.counts))])
            margin = self.logits[:, 1] - self.logits[:, 0]
            self.sums[first:first + len(some)] = np.add.reduceat(margin[rows], starts)
            self.counts[first:first + len(some)] = ends - starts
            self.index.update(zip(some, range(first, first + len(some)), strict=True))

    def scores(self, texts: list[str | None]) -> list[float]:
        """Probability of label 1; that of the labels alone for a text without words."""
        if len(self.index) > KEEP_WORDS:
            self._forget()
        cut = [words_of(t) for t in texts]
        self._learn(set().union(*cut).difference(self.index))
        out = []
        for words in cut:
            at = np.fromiter(map(self.index.__getitem__, words), "i8", len(words))
            mean = self.sums[at].sum() / self.counts[at].sum() if words else 0.0
            out.append(float(1 / (1 + np.exp(-(mean + self.bias[1] - self.bias[0])))))
        return out


def train_sgd(documents: list[tuple[np.ndarray, np.ndarray]], labels: list[int], weights: list[float]) -> Model:
    """From (features, counts) and the label of each document; ``weights`` by label."""
    rng = np.random.default_rng(0)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype("f4")
    out, bias = np.zeros((DIM, 2)), np.zeros(2)
    steps, done = EPOCHS * len(documents), 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(documents)):
            rows, counts = documents[i]
            rate = RATE * (1 - done / steps) * weights[labels[i]]
            done += 1
            share = (counts / counts.sum()).astype("f4") if len(counts) else counts.astype("f4")
            vectors = table[rows]
            mean = share @ vectors
            logit = mean @ out + bias
            p = np.exp(logit - logit.max())
            error = p / p.sum()
            error[labels[i]] -= 1
            back = out @ error
            out -= rate * np.outer(mean, error)
            bias -= 0.1 * rate * error
            table[rows] = vectors - (rate * DIM) * share[:, None] * back.astype("f4")
    return Model(table @ out, bias)


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Model:
    """Fit on the rows of ``docs`` whose id has a ``label`` of 0 or 1 in ``labels``, at most ``SAMPLE_PER_LABEL`` of each
    label and of at most ``SAMPLE_CHARS`` characters. The labels' shares among all labelled rows weigh the sample.
    Repeated labels count once, the greatest. Without labels every score is one half."""
    known = with_columns(labels, doc_id, label).where(f"{label} in (0, 1) and {doc_id} is not null") \
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(label).cast("int").alias("label"))
    counts, some = per_label(known, "label", "doc_id", SAMPLE_PER_LABEL, 2)
    if not counts:
        return Model(np.zeros((BUCKETS, 2)), np.zeros(2))
    # the sample's size is bounded by its parameters, whatever the tables' sizes
    rows = with_columns(docs, doc_id, text).select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")) \
        .join(F.broadcast(some), "doc_id").where(f"coalesce(length(text), 0) <= {SAMPLE_CHARS}") \
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(3 * SAMPLE_PER_LABEL).collect()
    documents, marks = [], []
    for r in rows:
        words = words_of(r.text)
        features, _ = word_features(words) if words else (np.zeros(0, "i8"), None)
        found, n = np.unique(features, return_counts=True)
        documents.append((found.astype("i4"), n.astype("i4")))
        marks.append(r.label)
    total, taken = sum(counts.values()), np.bincount(marks, minlength=2)
    weights = [counts.get(c, 0) / total * len(marks) / max(1, taken[c]) for c in (0, 1)]
    return train_sgd(documents, marks, weights)


def score(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with score (probability of label 1). A null text has no words."""
    rest = [c for c in docs.columns if c not in (text, "score")]

    def run(batches):
        for batch in batches:
            for some in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = model.scores(some.column(some.num_columns - 1).to_pylist())
                yield pa.RecordBatch.from_arrays([*some.columns[:-1], pa.array(found, pa.float64())], names=[*rest, "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("__text"))
    return slim.mapInArrow(run, slim.drop("__text").schema.add("score", "double"))
