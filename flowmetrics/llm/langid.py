"""Language identification, words first, backing off to character n-grams.

A known word scores each language by the log of its frequency there.  An
unseen word is scored by its longest character n-grams that are known in
any language (with word edges marked), trying five characters, then four,
and so on.  A text's language is the one with the largest sum.

The model is fitted on a bounded sample: about ``DOCS_PER_LANGUAGE``
different labelled texts of every language, chosen by a hash; at most
``WORDS_PER_LANGUAGE`` words a language and ``MAX_GRAMS`` n-grams are kept,
fewer with very many languages (``CELLS`` numbers in either table), which
bounds the broadcast and drops no language.  Every text is scored whole,
where it is read, without a shuffle.
"""

from __future__ import annotations

import math
import pickle
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from .store import broadcast

DOCS_PER_LANGUAGE = 2000
WORDS_PER_LANGUAGE = 20_000
MAX_GRAMS = 150_000
CELLS = 16_000_000
LONGEST = 5
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> list[str]:
    """Runs of letters (Unicode category L), lower-cased."""
    found = LETTERS.findall(text.lower())
    if text.isascii() or "".join(found).isalpha() or not found:
        return found
    # LETTERS lets numerals such as one half pass
    return "".join(c if c.isalpha() else " " for c in " ".join(found)).split()


def grams_of(word: str, n: int) -> list[str]:
    marked = f" {word} "
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """languages; words and grams: text -> row of their tables of log frequencies by language."""

    def __init__(self, counts: list[tuple[str, str, int]]):
        """counts: (language, word, occurrences)."""
        self.languages = sorted({x[0] for x in counts})
        at = {x: i for i, x in enumerate(self.languages)}
        words: dict = defaultdict(lambda: np.zeros(len(at)))
        grams: dict = defaultdict(lambda: np.zeros(len(at)))
        for language, word, n in counts:
            words[word][at[language]] += n
            for size in range(1, LONGEST + 1):
                for g in grams_of(word, size):
                    grams[g][at[language]] += n
        self.words, self.word_table = self._logs(words)
        kept = sorted(grams, key=lambda g: (len(g) > 1, -grams[g].sum(), g))[: min(MAX_GRAMS, CELLS // max(1, len(at)))]
        by_size = [{g: grams[g] for g in kept if len(g) == size} for size in range(LONGEST + 1)]
        self.grams, tables = {}, []
        for part in by_size:  # frequencies among n-grams of one length
            index, table = self._logs(part)
            base = sum(map(len, tables))
            self.grams |= {g: base + i for g, i in index.items()}
            tables.append(table)
        self.gram_table = np.concatenate(tables)

    def _logs(self, counts: dict) -> tuple[dict, np.ndarray]:
        table = np.array(list(counts.values())).reshape(len(counts), len(self.languages))
        return {x: i for i, x in enumerate(counts)}, np.log((table + 0.1) / (table.sum(0) + 0.1 * max(1, len(counts))))

    def vector(self, word: str) -> np.ndarray:
        if (row := self.words.get(word)) is not None:
            return self.word_table[row]
        for size in range(LONGEST, 0, -1):
            if known := [r for g in grams_of(word, size) if (r := self.grams.get(g)) is not None]:
                return self.gram_table[known].mean(0)
        return np.zeros(len(self.languages))


class Rows(dict):
    """Row of each word seen so far in a growing table of vectors; emptied beyond ``bound`` words."""

    def __init__(self, model: Model, bound: int = 300_000):
        self.model, self.bound = model, bound
        self.table = np.zeros((1024, len(model.languages)), np.float32)

    def __missing__(self, word: str) -> int:
        row = len(self)
        if row == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[row] = self.model.vector(word)
        self[word] = row
        return row

    def sums(self, words: list[str]) -> np.ndarray:
        if len(self) > self.bound:
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.table[rows].sum(0, dtype=np.float64)


def predict_batches(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    fitted: Model = pickle.loads(model.value)
    rows = Rows(fitted)
    for batch in batches:
        names, scores = [], []
        for text in batch.column(1):
            words = words_of(text.as_py() or "")
            if not words or not fitted.languages:
                names.append(UNKNOWN)
                scores.append(0.0)
                continue
            total = rows.sums(words)
            best = int(total.argmax())
            names.append(fitted.languages[best])
            scores.append(float(1 / np.exp((total - total[best]) / math.sqrt(len(words))).sum()))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(names, pa.string()), pa.array(scores, pa.float64())], schema=schema)


def fit(labelled: DataFrame, docs_per_language: int = DOCS_PER_LANGUAGE, words_per_language: int = WORDS_PER_LANGUAGE) -> Model:
    """Model of ``labelled`` (text, lang); rows without text or lang are ignored."""
    rows = labelled.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text is not null and lang is not null")
    rows = rows.withColumn("digest", F.xxhash64("text"))
    # one row a language; copies of a text count once
    sizes = rows.select("lang", "digest").distinct().groupBy("lang").count().collect()
    words_per_language = max(1, min(words_per_language, CELLS // max(1, len(sizes)) ** 2))
    if not sizes:
        return Model([])
    shares = labelled.sparkSession.createDataFrame([(r["lang"], min(1 << 20, math.ceil(docs_per_language / r["count"] * (1 << 20)))) for r in sizes], "lang string, share long")
    sample = rows.join(shares, "lang").where(F.pmod("digest", F.lit(1 << 20)) < F.col("share")).dropDuplicates(["lang", "digest"])
    words = sample.select("lang", F.explode(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1))).alias("word"))
    counts = words.groupBy("lang", "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))
    return Model([tuple(r) for r in counts.withColumn("rank", rank).where(F.col("rank") <= words_per_language).select("lang", "word", "n").orderBy("lang", "word").collect()])


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score (0 to 1) per row of ``docs`` (doc_id, text).

    The text alone decides.  Null, empty and letterless texts are ``und``
    with score 0, as is everything under a model without languages; ties go
    to the first language by name.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    shape = spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, lang_pred string, score double").schema
    arrow = to_arrow_schema(shape)
    sent = broadcast(spark, model)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: predict_batches(it, sent, arrow), shape)
