"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios.

A bounded sample of labelled rows gives, for each hashed n-gram, the log ratio of its document
frequencies under the two labels. The n-grams whose ratio is surest are kept, each present one
enters a logistic regression with its ratio as value, and the fitted weights (a few hundred KB
at most) are broadcast. Scoring is one pass over the texts without a shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved, shuffle_width, table

#: Labelled rows that take part in fitting, chosen by a hash of their id.
SAMPLE_ROWS = 10_000
NGRAMS = (3, 4, 5, 6)
BUCKET_BITS = 22
#: N-grams that get a weight at most.
FEATURES = 20_000
#: Code points that are hashed at a time; n-grams across the joint are kept.
BLOCK = 1 << 20


class ToxicityModel(NamedTuple):
    """Weights of hashed n-grams, to be added to bias where an n-gram occurs."""

    buckets: np.ndarray
    weights: np.ndarray
    bias: float


def ngram_buckets(text: str | None) -> Iterator[np.ndarray]:
    """Buckets of all n-grams of the lower-cased text, block by block, with repeats."""
    points = np.frombuffer(f" {text or ''} ".lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    for lo in range(0, len(points), BLOCK):
        part = points[lo : lo + BLOCK + NGRAMS[-1] - 1]
        h = part * np.uint32(0x9E3779B1)
        for n in range(2, NGRAMS[-1] + 1):
            if len(part) < n:
                break
            h = (h[:-1] ^ (h[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA6B) + part[n - 1 :] * np.uint32(0xC2B2AE35)
            if n in NGRAMS:
                yield (h ^ (h >> np.uint32(13))) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKET_BITS)


def _present(text: str | None, seen: np.ndarray) -> np.ndarray:
    """The distinct buckets of a text; seen is scratch space of one int32 a bucket."""
    parts = list(ngram_buckets(text))
    if not parts:
        return np.empty(0, np.uint32)
    idx = np.concatenate(parts)
    row = np.arange(len(idx), dtype=np.int32)
    seen[idx] = row
    return idx[seen[idx] == row]


class Counts(NamedTuple):
    """Rows and, of each bucket, rows that have it, for labels 0 and 1."""

    rows: np.ndarray
    df: np.ndarray


def count_buckets(rows: Iterator[tuple[str | None, int]]) -> Counts:
    """One pass over (text, label); memory is that of the buckets and of one text."""
    size = 1 << BUCKET_BITS
    seen, df, n = np.zeros(size, np.int32), np.zeros((2, size), np.float32), np.zeros(2)
    for text, label in rows:
        df[label, _present(text, seen)] += 1
        n[label] += 1
    return Counts(n, df)


def choose(counts: Counts) -> ToxicityModel:
    """The surest n-grams with their log-count ratios as weights, not fitted yet; none where one label has no rows."""
    (neg, pos), (df0, df1) = counts.rows, counts.df
    prior = float(np.log((pos + 1) / (neg + 2)))
    if not pos or not neg:
        return ToxicityModel(np.empty(0, np.int64), np.empty(0), prior)
    ratio = np.log((df1 + 1) / (pos + 2)) - np.log((df0 + 1) / (neg + 2))
    sure = np.abs(ratio) / np.sqrt(1 / (df1 + 1) + 1 / (df0 + 1))
    sure[counts.df.sum(0) < 4] = 0
    chosen = np.sort(np.argsort(-sure, kind="stable")[:FEATURES])
    chosen = chosen[sure[chosen] > 2]
    return ToxicityModel(chosen.astype(np.int64), ratio[chosen].astype(float), prior)


def features(text: str | None, number: np.ndarray) -> np.ndarray:
    """Places in the model of the n-grams that a text has; number maps a bucket to its place plus 1, or 0."""
    hit = [x[x > 0] for x in (number[b] for b in ngram_buckets(text))]
    return np.unique(np.concatenate(hit)) - 1 if hit else np.empty(0, np.int64)


def numbered(model: ToxicityModel) -> np.ndarray:
    """What features() looks buckets up in."""
    number = np.zeros(1 << BUCKET_BITS, np.int32)
    number[model.buckets] = np.arange(1, len(model.buckets) + 1)
    return number


def fit_weights(model: ToxicityModel, found: list[np.ndarray], labels: np.ndarray, l2: float = 1.0, steps: int = 150) -> ToxicityModel:
    """Logistic regression over rows of features(), each present n-gram having its ratio as value."""
    y = np.asarray(labels, float)
    if not len(model.buckets) or not len(y):
        return model
    row, col = np.repeat(np.arange(len(y)), [len(x) for x in found]), np.concatenate(found).astype(np.int64)
    ratio = model.weights
    value = ratio[col]
    w, b = np.zeros(len(ratio)), model.bias
    # accelerated gradient descent; the step is bounded by the largest curvature
    scale = np.bincount(row, value**2, len(y)).max() + 1
    rate = 1 / (0.25 * scale * np.sqrt(len(y)) + l2)
    ahead = w.copy()
    for k in range(steps):
        z = np.bincount(row, ahead[col] * value, len(y)) + b
        err = 1 / (1 + np.exp(-z)) - y
        grad = np.bincount(col, err[row] * value, len(w)) + l2 * ahead
        new = ahead - rate * grad
        ahead = new + k / (k + 3) * (new - w)
        w = new
        curve = np.maximum(np.exp(-np.abs(z)), 0.02).sum()
        b -= err.sum() / (0.25 * curve + 1)
    return ToxicityModel(model.buckets, w * ratio, float(b))


def fit_arrays(texts: list[str | None], labels: np.ndarray) -> ToxicityModel:
    """Fit on texts in memory; labels are 0 or 1. With one label only, or none, the bias alone decides."""
    model = choose(count_buckets(zip(texts, map(int, labels), strict=True)))
    number = numbered(model)
    return fit_weights(model, [features(t, number) for t in texts], labels)


def fit_toxicity(labelled: DataFrame, text_col: str = "text", label_col: str = "label") -> ToxicityModel:
    """Fit on at most SAMPLE_ROWS rows of (text, label); the caller bounds them, and no task holds more than one of their texts.

    The rows are written to the shared folder. One task counts n-grams text by text; then all
    tasks turn texts into places of the chosen n-grams, FEATURES a row at most, and one task fits
    weights to these. What comes to the driver has FEATURES weights at most. Rows without one of
    the two labels are left out; equal rows each count, in no order. Without rows the bias decides.
    """
    rows = labelled.select(F.col(f"`{text_col}`").cast("string").alias("t"), F.col(f"`{label_col}`").cast("int").alias("y")).filter("y in (0, 1)")
    rows = saved(rows, "labelled")

    def packed(model: ToxicityModel) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"b": [model.buckets.astype("<i8").tobytes()], "w": [model.weights.astype("<f8").tobytes()], "bias": [model.bias]})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield packed(choose(count_buckets((t.as_py(), y.as_py()) for batch in batches for t, y in zip(*batch.columns, strict=True))))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = numbered(sent.value)
        for batch in batches:
            found = [features(t.as_py(), number).astype(np.int32) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(found, pa.list_(pa.int32()))], ["y", "x"])

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, found = [], []
        for batch in batches:
            labels += batch.column(0).to_pylist()
            found += [x.values.to_numpy() for x in batch.column(1)]
        yield packed(fit_weights(sent.value, found, np.array(labels, int)))

    def model_of(df: DataFrame, run: Callable) -> ToxicityModel | None:
        got = df.mapInArrow(run, "b binary, w binary, bias double").first()
        return got and ToxicityModel(np.frombuffer(got.b, "<i8"), np.frombuffer(got.w, "<f8"), got.bias)

    model = model_of(rows.repartition(1), count) or fit_arrays([], np.empty(0))
    if len(model.buckets):
        sent = labelled.sparkSession.sparkContext.broadcast(model)
        placed = rows.repartition(shuffle_width(labelled.sparkSession)).mapInArrow(place, "y int, x array<int>")
        model = model_of(placed.repartition(1).sortWithinPartitions("y", "x"), fit)
    discard(rows)
    return model


def score_text(text: str | None, number: np.ndarray, model: ToxicityModel) -> float:
    """Probability of label 1; number is numbered(model)."""
    found = features(text, number)
    return float(1 / (1 + np.exp(-np.clip(model.weights[found].sum() + model.bias, -500, 500))))


def score_toxicity(df: DataFrame, model: ToxicityModel, text_col: str = "text") -> DataFrame:
    """df with score (0 to 1) and predicted (1 from 0.5 on) for every whole text.

    Null and empty texts get the score that the bias gives. Equal texts have equal scores, and
    repeated rows each have one. Of a very long text only the n-grams of one block, and what was
    found so far, are in memory.
    Other columns pass through; columns of those two names are replaced. An empty df gives no rows.
    """
    sent = df.sparkSession.sparkContext.broadcast(model)
    rest = [c for c in df.columns if c not in ("score", "predicted")]
    at = rest.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        number = numbered(model)
        for batch in batches:
            score = np.array([score_text(x.as_py(), number, model) for x in batch.column(at)], float)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*batch.schema.names, "score", "predicted"])

    plain = df.select(*(F.col(f"`{c}`").cast("string").alias(c) if c == text_col else F.col(f"`{c}`") for c in rest))
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in plain.schema)
    return plain.mapInArrow(run, f"{types}, score double, predicted int")


def training_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(text, label) of the labelled rows of the training folds, SAMPLE_ROWS of them at most.

    A row is of the training folds when crc32 of its id as text, mod 5, isn't 0. Of rows that
    share an id the one with the smallest text counts.
    """
    chosen = (
        labels.filter("doc_id is not null and toxic in (0, 1) and crc32(cast(cast(doc_id as string) as binary)) % 5 <> 0")
        .groupBy(F.col("doc_id").alias("k"))
        .agg(F.max("toxic").alias("label"))
        .orderBy(F.xxhash64(F.col("k").cast("string")), "k")
        .limit(SAMPLE_ROWS)
    )
    return docs.select("doc_id", "text").join(F.broadcast(chosen), F.col("doc_id") == F.col("k")).groupBy("k").agg(F.min("text").alias("text"), F.first("label").alias("label")).select("text", "label")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model that has seen the training folds' labels only."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(training_rows(docs, table(spark, sf_dir, "labels")))
    held_out = F.expr("coalesce(crc32(cast(cast(doc_id as string) as binary)) % 5 = 0, false)")
    return score_toxicity(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
