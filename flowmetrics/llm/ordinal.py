"""Ordinal quality classifier: cumulative-link regression on graded ratings.

P(grade <= k) = sigmoid(threshold_k - w . x) with one shared weight vector
over hashed words and ordered thresholds.  Features are the words, runs
of symbols and shapes present, weighted by inverse document frequency in the sample and scaled to unit
length.  From the link follow the expected grade and the tail probability
P(grade >= cut) by which documents are selected.

The fit sees a bounded sample, at most ``SAMPLE`` different labelled texts
chosen by a hash of the text; the weights (2**``BITS``) bound the broadcast.  All
documents are scored whole, where they are read.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import broadcast, materialize
from .textops import U64, Words, lists, mix, row_of, slices, word_table

BITS = 18
SAMPLE = 6000
STEPS = 150
DECAY = 1e-5


def word_byte(b: int) -> bool:
    return 65 <= b < 91 or 97 <= b < 123 or b > 127


def symbol_byte(b: int) -> bool:
    return 33 <= b < 127 and not word_byte(b) and not 48 <= b < 58 and chr(b) not in ".,;:!?'\"()-"


def presence(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket), sorted and distinct, and each row's number of words.

    Buckets are hashed words, runs of symbols, and shapes: the size of the
    text in half octaves and the share of its words that are new, in tenths.
    """
    words = Words.of(column, word_table(word_byte, fold_case=True))
    n = len(column)
    rows, codes = [], []
    for kind, found in ((0, words), (1, Words.of(column, word_table(symbol_byte)))):
        rows.append(row_of(np.arange(len(found.start)), found.first))
        codes.append(mix(found.hashes() + U64(kind)))
    count = np.diff(words.first)
    distinct = np.bincount((np.unique((rows[0].astype(U64) << U64(44)) | (codes[0] >> U64(20))) >> U64(44)).astype(np.int64), minlength=n)
    shapes = (np.floor(2 * np.log2(count + 1)), np.floor(10 * distinct / np.maximum(count, 1)))
    for kind, shape in enumerate(shapes):
        rows.append(np.arange(n))
        codes.append(mix(mix(shape.astype(U64) + U64(1000 * (kind + 1)))))
    both = np.unique((np.concatenate(rows).astype(U64) << U64(BITS)) | (np.concatenate(codes) >> U64(64 - BITS)))
    return (both >> U64(BITS)).astype(np.int64), (both & U64((1 << BITS) - 1)).astype(np.int64), count


def feature_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(grade, buckets) of (grade, text)."""
    for batch in batches:
        for lo, n in slices(batch.column(1)):
            part = batch.slice(lo, n)
            row, bucket, _ = presence(part.column(1))
            yield pa.RecordBatch.from_arrays([part.column(0), lists(bucket, np.searchsorted(row, np.arange(n + 1)), pa.int64())], schema=schema)


def sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class CumulativeLink:
    """weights, idf and thresholds of a fitted model; ``grades`` - 1 thresholds."""

    def __init__(self, grades: int):
        self.grades = grades
        self.weights = np.zeros(1 << BITS)
        self.idf = np.ones(1 << BITS)
        self.thresholds = np.linspace(-1, 1, grades - 1) if grades > 2 else np.zeros(grades - 1)

    def scaled(self, row: np.ndarray, bucket: np.ndarray, n: int) -> np.ndarray:
        value = self.idf[bucket]
        norm = np.sqrt(np.bincount(row, value * value, n))
        return value / norm[row]

    def fit(self, grade: np.ndarray, row: np.ndarray, bucket: np.ndarray) -> CumulativeLink:
        """Full-batch Adam on the mean negative log-likelihood."""
        n = len(grade)
        if not n:
            return self
        self.idf = np.log((n + 1) / (np.bincount(bucket, minlength=1 << BITS) + 1)) + 0.1
        value = self.scaled(row, bucket, n)
        free = np.concatenate([[self.thresholds[0]], np.log(np.diff(self.thresholds))])
        moment = [np.zeros(1 << BITS), np.zeros(len(free))]
        square = [np.zeros(1 << BITS), np.zeros(len(free))]
        for step in range(1, STEPS + 1):
            cuts = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
            score = np.bincount(row, self.weights[bucket] * value, n)
            edges = np.concatenate([[-np.inf], cuts, [np.inf]])
            upper, lower = (sigmoid(edges[grade + k] - score) for k in (1, 0))
            p = np.maximum(upper - lower, 1e-12)
            du, dl = upper * (1 - upper) / p, lower * (1 - lower) / p  # of log p by its two edges
            by_score = (du - dl) / n
            gradient = np.bincount(bucket, by_score[row] * value, 1 << BITS) + DECAY * self.weights
            by_cut = np.array([(dl[grade == k + 1].sum() - du[grade == k].sum()) / n for k in range(len(cuts))])
            by_free = np.array([by_cut[j:].sum() * (1 if j == 0 else np.exp(free[j])) for j in range(len(free))])
            for i, (x, g, rate) in enumerate(((self.weights, gradient, 0.5), (free, by_free, 0.1))):
                moment[i] = 0.9 * moment[i] + 0.1 * g
                square[i] = 0.99 * square[i] + 0.01 * g * g
                x -= rate * (moment[i] / (1 - 0.9**step)) / (np.sqrt(square[i] / (1 - 0.99**step)) + 1e-9)
        self.thresholds = np.cumsum(np.concatenate([free[:1], np.exp(free[1:])]))
        return self

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= 1), ..., P(grade >= grades - 1), one column each."""
        return sigmoid(score[:, None] - self.thresholds[None, :])


def score_batches(batches: Iterator[pa.RecordBatch], model, cut: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fitted: CumulativeLink = pickle.loads(model.value)
    for batch in batches:
        for lo, n in slices(batch.column(1)):
            part = batch.slice(lo, n)
            row, bucket, count = presence(part.column(1))
            tails = fitted.tails(np.bincount(row, fitted.weights[bucket] * fitted.scaled(row, bucket, n), n))
            any_word = count > 0
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(tails.sum(1)), pa.array(tails[:, cut - 1]), pa.array((tails[:, cut - 1] >= 0.5) & any_word)], schema=schema)


def _least(rows: DataFrame, sample: int) -> DataFrame:
    """At most ``sample`` of ``rows`` (digest, grade, ...), one of each digest and grade, those of the least digests."""
    pairs = rows.select("grade", "digest").distinct()
    # few rows go on to be sorted; the limit is hard
    share = min(1 << 20, -(-sample * (1 << 20) // max(1, pairs.count())))
    chosen = rows.where(F.pmod("digest", F.lit(1 << 20)) < share).dropDuplicates(["grade", "digest"])
    return chosen.orderBy("digest", "grade").limit(sample)


def sample_rated(docs: DataFrame, labels: DataFrame, grades: int, sample: int = SAMPLE) -> DataFrame:
    """The rows (text, grade) that ``fit`` takes of ``docs`` (doc_id, text) with the grades of ``labels`` (doc_id, grade).

    Only ids and hashes of the texts are joined and shuffled; the chosen
    texts, ``sample`` at most, are fetched where ``docs`` is read.
    """
    text = F.col("text").cast("string")
    hashed = docs.where(text.isNotNull()).select("doc_id", F.xxhash64(text).alias("digest"))
    marked = labels.select(F.col("doc_id").alias("of"), F.col("grade").cast("int").alias("grade")).where(f"grade between 0 and {grades - 1}")
    rated = hashed.join(marked, F.col("doc_id") == F.col("of")).groupBy("grade", "digest").agg(F.min("doc_id").alias("of"))
    chosen = _least(materialize(rated, "rated"), sample)
    found = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), (F.col("doc_id") == F.col("of")) & (F.xxhash64("text") == F.col("digest")))
    return found.dropDuplicates(["grade", "digest"]).select("text", "grade")


def fit(rated: DataFrame, grades: int, sample: int = SAMPLE) -> CumulativeLink:
    """Model of ``rated`` (text, grade from 0 to grades - 1); rows without grade or text, or off the scale, are ignored."""
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = rated.sparkSession
    rows = rated.select(F.col("grade").cast("int").alias("grade"), F.col("text").cast("string").alias("text")).where(f"text is not null and grade between 0 and {grades - 1}")
    # copies of a text count once a grade
    chosen = _least(rows.withColumn("digest", F.xxhash64("text")), sample).select("grade", "text")
    shape = spark.createDataFrame([], "grade int, buckets array<long>").schema
    arrow = to_arrow_schema(shape)
    found = chosen.mapInArrow(lambda it: feature_batches(it, arrow), shape).sort("grade", F.hash("buckets")).toArrow()
    buckets = found.column("buckets").combine_chunks()
    grade = found.column("grade").to_numpy().astype(np.int64)
    size = np.array(buckets.value_lengths()) if len(grade) else np.zeros(0, np.int64)
    return CumulativeLink(grades).fit(grade, np.repeat(np.arange(len(grade)), size), buckets.flatten().to_numpy().astype(np.int64))


def score(docs: DataFrame, model: CumulativeLink, cut: int) -> DataFrame:
    """doc_id, expected_grade, tail (P(grade >= cut)), selected (tail at least a half) per row of ``docs``.

    A text without letters (null and empty ones too) is scored by the
    thresholds alone and never selected.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    if not 0 < cut < model.grades:
        raise ValueError("the cut lies between grades")
    spark = docs.sparkSession
    shape = spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, expected_grade double, tail double, selected boolean").schema
    arrow = to_arrow_schema(shape)
    sent = broadcast(spark, model)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: score_batches(it, sent, cut, arrow), shape)
