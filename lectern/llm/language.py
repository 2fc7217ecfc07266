"""Language identification: sparse multinomial logistic regression on character n-grams.

N-grams of one to three characters of the lower-cased letters (other characters are one space)
are hashed to a fixed number of buckets.  A text is the TF-IDF vector of its buckets,
``log(1 + count) * idf`` at length one, with document frequencies over all learnable rows.  The
weights are learned by follow-the-regularised-leader with elastic-net penalties, and a
temperature is fitted to rows of the sample that the weights haven't seen.

Weights are learned from a bounded sample: ``per_language`` rows of each language, those with the
smallest hash of the id.  Everything else covers all rows.

Texts that are null or hold no letter get ``und`` with score 0, and so does every text if there is
nothing to learn from.  Rows without an id are predicted but never learned from; equal texts get
equal answers, ties go to the language that sorts first.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.llm.common import batches_of, cut_lineage, only, residue

BUCKETS = 1 << 15
NO_LETTER = re.compile(r"[\W\d_]+")


def bucket_counts(text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
    """The buckets of a text's n-grams and how often each occurs; None without a letter."""
    letters = NO_LETTER.sub(" ", (text or "").lower()).strip()
    if not any(map(str.isalpha, letters)):
        return None
    codes = np.frombuffer(f" {letters} ".encode("utf-32-le", "surrogatepass"), np.uint32)
    spread = lambda x: (x * np.uint32(2654435761)) >> np.uint32(17)  # noqa: E731  the upper 15 bits
    two = codes[:-1] * np.uint32(8191) + codes[1:]
    three = two[:-1] * np.uint32(131071) + codes[2:]
    counts = np.bincount(spread(codes), minlength=BUCKETS)
    counts += np.bincount(spread(two + np.uint32(77)), minlength=BUCKETS)
    counts += np.bincount(spread(three + np.uint32(777)), minlength=BUCKETS)
    found = np.flatnonzero(counts)
    return found, counts[found]


def vector(counts: np.ndarray, found: np.ndarray, idf: np.ndarray) -> np.ndarray:
    x = np.log1p(counts) * idf[found]
    return x / max(float(np.sqrt(x @ x)), 1e-12)


@dataclass
class Model:
    """Weights by bucket and language."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def logits(self, text: str | None) -> np.ndarray | None:
        counted = bucket_counts(text)
        if counted is None:
            return None
        found, counts = counted
        return vector(counts, found, self.idf) @ self.weights[found] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        z = self.logits(text) if self.languages else None
        if z is None:
            return "und", 0.0
        p = softmax(z / self.temperature)
        best = int(np.argmax(p))
        return self.languages[best], float(p[best])


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]], languages: int, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-3, epochs: int = 3
) -> tuple[np.ndarray, np.ndarray]:
    """Per-coordinate FTRL-proximal; an example is (buckets, values, language).  The last bucket is the bias."""
    z, n = np.zeros((BUCKETS + 1, languages)), np.zeros((BUCKETS + 1, languages))

    def weights(rows):
        zs, ns = z[rows], n[rows]
        return np.where(np.abs(zs) <= l1, 0.0, -(zs - np.sign(zs) * l1) / ((beta + np.sqrt(ns)) / alpha + l2))

    order = np.random.default_rng(0)
    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            found, values, label = examples[k]
            rows, x = np.append(found, BUCKETS), np.append(values, 1.0)
            w = weights(rows)
            error = softmax(x @ w)
            error[label] -= 1
            g = x[:, None] * error
            sigma = (np.sqrt(n[rows] + g * g) - np.sqrt(n[rows])) / alpha
            z[rows] += g - sigma * w
            n[rows] += g * g
    w = weights(np.arange(BUCKETS + 1))
    return w[:-1].astype(np.float32), w[-1]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest log loss, on a grid of factors from 1/20 to 20."""

    def loss(t):
        z = logits / t
        z = z - z.max(axis=1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(z)), labels]))

    return min(np.geomspace(0.05, 20, 121), key=loss) if len(labels) else 1.0


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """In how many rows each bucket occurs, and the number of rows; tasks send one count a bucket."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS + 1, np.int64)
        for batch in batches:
            for text in batch.column("text").to_pylist():
                if (c := bucket_counts(text)) is not None:
                    total[c[0]] += 1
                    total[BUCKETS] += 1
        found = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array(total[found])], names=["bucket", "n"])

    out = np.zeros(BUCKETS + 1, np.int64)
    for row in texts.mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[row.bucket] = row.n
    return out[:BUCKETS], int(out[BUCKETS])


def learn(docs: DataFrame, label: str = "lang", learnable: Column | None = None, per_language: int = 500) -> Model:
    """A model from the learnable rows of ``docs`` (doc_id, text, label)."""
    rows = docs.filter(F.col(label).isNotNull() & F.col("text").isNotNull())
    rows = only(rows.filter(learnable) if learnable is not None else rows, doc_id="doc_id", text="text", lang=label)
    frequency, total = document_frequencies(rows.select("text"))
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("text"))
    sample = lambda df: df.withColumn("_k", F.row_number().over(first)).filter(F.col("_k") <= per_language)
    # ids first, so that texts of the chosen rows alone travel; then again, for rows that repeat
    ids = sample(rows.select("doc_id", "lang", F.xxhash64("text").alias("text"))).select("doc_id", "lang").distinct()
    chosen = sample(rows.join(ids, ["doc_id", "lang"]))
    idf = np.log((1 + total) / (1 + frequency)) + 0.1

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                if (c := bucket_counts(text)) is not None:
                    found, counts = c
                    values = vector(counts, found, idf).astype(np.float32)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang]), pa.array([found.astype("<u2").tobytes()]), pa.array([values.tobytes()])], names=["lang", "found", "x"]
                    )

    kept = chosen.orderBy("lang", "_k").select("lang", "text").mapInArrow(vectors, "lang string, found binary, x binary").collect()
    languages = sorted({r.lang for r in kept})
    examples = [(np.frombuffer(r.found, "<u2").astype(np.int64), np.frombuffer(r.x, np.float32).astype(np.float64), languages.index(r.lang)) for r in kept]
    if not examples:
        return Model([], idf, np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    fit, held = [e for k, e in enumerate(examples) if k % 5], examples[::5]
    weights, bias = fit_ftrl(fit or examples, len(languages))
    logits = np.array([x @ weights[found] + bias for found, x, _ in held])
    return Model(languages, idf, weights, bias, float(fit_temperature(logits, np.array([y for *_, y in held]))))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred and score of every row of ``docs`` (doc_id, text); the model has a fixed size a language."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, 1024):
            found = [shared.value.predict(t) for t in batch.column("text").to_pylist()]
            columns = [batch.column("doc_id"), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return only(docs, doc_id="doc_id", text="text").mapInArrow(predict, f"doc_id {kind}, lang_pred string, score double")


def language_rows(docs: DataFrame) -> DataFrame:
    """The registered query: learn from two folds of three, predict every row."""
    fold = residue("doc_id", 3)
    model = learn(docs, "lang", (fold != 1) & (fold != -1))
    return identify(docs, model).select("doc_id", (residue("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
