"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the character 1- to 3-grams of the lower-cased text, hashed into ``BINS``; a feature's value is its share
of the text's n-grams times its inverse document frequency, counted over all training documents. Weights are trained
by follow-the-regularised-leader (per-coordinate steps, elastic net: the L1 part leaves weights at exactly zero, the L2
part shrinks the rest) on a bounded sample. A temperature fitted on sampled rows that training has not seen calibrates
the probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitlens.llm.sampling import per_label
from unitlens.llm.storage import with_columns

BINS, GRAMS, SCALE = 1 << 16, 3, 30.0
#: Bounds of the training sample: rows of each language, languages (the most frequent). A row is its whole text's n-gram counts.
SAMPLE_PER_LANGUAGE, MAX_LANGUAGES = 1_000, 200
EPOCHS, RATE, BETA, L1, L2 = 3, 0.5, 1.0, 0.02, 0.02
CHUNK = 1 << 19
UNKNOWN = "und"
#: Odd multipliers, one per place in an n-gram.
_MIX = np.array([0x9E3779B1, 0x85EBCA6B, 0xC2B2AE35], "u4")


def has_letter(text: str | None) -> bool:
    return any(c.isalpha() for c in text[:64]) or any(c.isalpha() for c in text[64:]) if text else False


def gram_bins(points: np.ndarray, size: int) -> np.ndarray:
    """The bin of the ``size``-gram at each place of an array of code points."""
    n = len(points) - size + 1
    mixed = np.full(n, size, "u4")
    for k in range(size):
        mixed = (mixed ^ points[k:k + n]) * _MIX[k]
        mixed ^= mixed >> np.uint32(15)
    return mixed & np.uint32(BINS - 1)


def _chunks(text: str):
    """(code points, sizes of grams to take): overlapping, so that every gram of the text is in one chunk."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    for at in range(0, len(points), CHUNK):
        for size in range(1, GRAMS + 1):
            some = points[at:at + CHUNK + size - 1]
            if len(some) >= size:
                yield gram_bins(some, size)


def bins_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bins, counts) of a text."""
    counts = np.zeros(BINS, "i8")
    for bins in _chunks(text):
        counts += np.bincount(bins, minlength=BINS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, lang, bins, counts) of the rows (doc_id, text, lang) whose text has a letter."""

    def run(batches):
        for batch in batches:
            texts = batch.column(1).to_pylist()
            some = [i for i, t in enumerate(texts) if has_letter(t)]
            found = [bins_of(texts[i]) for i in some]
            at = pa.array(some, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), batch.column(2).take(at), pa.array([b.astype("<u2").tobytes() for b, _ in found], pa.binary()),
                 pa.array([n.astype("<i8").tobytes() for _, n in found], pa.binary())], names=["doc_id", "lang", "bins", "counts"])

    slim = rows.select("doc_id", "text", "lang")
    kinds = dict(slim.dtypes)
    return slim.mapInArrow(run, f"doc_id {kinds['doc_id']}, lang {kinds['lang']}, bins binary, counts binary")


def document_frequencies(texts: DataFrame) -> tuple[int, np.ndarray]:
    """Number of texts and, by bin, of texts that have it. Summed by Spark; ``BINS`` numbers come back."""

    def run(batches):
        df, n = np.zeros(BINS + 1, "i8"), 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen = np.zeros(BINS, bool)
                for bins in _chunks(text):
                    seen[bins] = True
                df[:BINS] += seen
                n += 1
        df[BINS] = n
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype("i4")), pa.array(df[at])], names=["bin", "n"])

    rows = texts.mapInArrow(run, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()
    df = np.zeros(BINS + 1, "i8")
    df[[r.bin for r in rows]] = [r.n for r in rows]
    return int(df[BINS]), df[:BINS]


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train_ftrl(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, bins: int = BINS) -> np.ndarray:
    """Weights (bins + 1, classes) from (features, values, class) rows; the last row is the intercept's."""
    z, n = np.zeros((bins + 1, classes)), np.zeros((bins + 1, classes))
    rng = np.random.default_rng(0)

    def weights(z, n):
        w = -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / RATE + L2)
        return np.where(np.abs(z) > L1, w, 0.0)

    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, x, y = rows[i]
            at, x = np.append(at, bins), np.append(x, 1.0)
            w = weights(z[at], n[at])
            error = softmax(x @ w)
            error[y] -= 1
            g = x[:, None] * error
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / RATE * w
            n[at] = more
    return weights(z, n)


def fit_temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search over its logarithm."""
    if not len(y):
        return 1.0

    def loss(t):
        return -np.log(np.maximum(softmax(logits / np.exp(t))[np.arange(len(y)), y], 1e-300)).mean()

    low, high, gold = np.log(0.05), np.log(20.0), (np.sqrt(5) - 1) / 2
    for _ in range(40):
        a, b = high - gold * (high - low), low + gold * (high - low)
        low, high = (low, b) if loss(a) < loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


@dataclass(frozen=True)
class Model:
    """``weights``: by bin, idf and scale included, over the temperature; ``intercept`` likewise."""

    languages: list[str]
    weights: np.ndarray
    intercept: np.ndarray

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.languages or not has_letter(text):
            return UNKNOWN, 0.0
        total, n = np.zeros(len(self.languages)), 0
        for bins in _chunks(text):
            total += self.weights[bins].sum(axis=0, dtype="f8")
            n += len(bins)
        p = softmax(total / n + self.intercept)
        best = int(p.argmax())  # of equal ones the first by name
        return self.languages[best], float(p[best])


def fit(train: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> Model:
    """Fit on the rows of ``train`` that have a language and a letter. Document frequencies cover all of them; weights
    are fitted on the sample bounded by ``SAMPLE_PER_LANGUAGE`` and ``MAX_LANGUAGES``, of which every fifth document fits
    the temperature. Tasks count the n-grams of whole texts, however long; texts do not come to the driver. Without such
    rows the model has no language."""
    rows = with_columns(train, doc_id, text, lang).select(
        F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang")
    ).where("lang is not null and text is not null")
    _, some = per_label(rows, "lang", "doc_id", SAMPLE_PER_LANGUAGE, MAX_LANGUAGES)
    sample = gram_counts(some).orderBy(F.xxhash64("doc_id"), "doc_id").limit(2 * SAMPLE_PER_LANGUAGE * MAX_LANGUAGES).collect()
    languages = sorted({r.lang for r in sample})
    if not languages:
        return Model([], np.zeros((0, 0), "f4"), np.zeros(0))
    total, df = document_frequencies(rows.select("text"))
    idf = np.log((1 + total) / (1 + df)) + 1
    ready = []
    for r in sample:
        at, counts = np.frombuffer(r.bins, "<u2").astype("i8"), np.frombuffer(r.counts, "<i8")
        ready.append((at, SCALE * counts / counts.sum() * idf[at], languages.index(r.lang)))
    weights = train_ftrl([r for i, r in enumerate(ready) if i % 5], len(languages))
    kept = [r for i, r in enumerate(ready) if not i % 5]
    logits = np.array([x @ weights[at] + weights[-1] for at, x, _ in kept])
    t = fit_temperature(logits, np.array([y for *_, y in kept]))
    return Model(languages, (weights[:-1] * idf[:, None] * SCALE / t).astype("f4"), weights[-1] / t)


def predict(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text, with lang_pred and score (probability of lang_pred, 0 for ``und``). A
    text that is null or has no letter is ``und``."""
    rest = [c for c in docs.columns if c not in (text, "lang_pred", "score")]

    def run(batches):
        for batch in batches:
            found = [model.predict(t) for t in batch.column(batch.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array([x for x, _ in found], pa.string()),
                 pa.array([p for _, p in found], pa.float64())], names=[*rest, "lang_pred", "score"])

    slim = docs.select(*[F.col(f"`{c}`") for c in rest], F.col(text).alias("__text"))
    schema = slim.drop("__text").schema.add("lang_pred", "string").add("score", "double")
    return slim.mapInArrow(run, schema)


def bucket(doc_id: str, of: int) -> Column:
    """crc32 of the id as text, modulo ``of``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % of
