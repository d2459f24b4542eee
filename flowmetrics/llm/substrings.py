"""Substring deduplication by seed and extend.

Seeds: winnowed word-window fingerprints (Schleimer et al., "Winnowing").
With seeds of ``SEED`` words and ``LENGTH`` - SEED + 1 windows per choice,
any two equal runs of ``LENGTH`` words share a chosen seed.  Documents are
joined on seeds that occur in two documents at least; around each such seed
the match is extended both ways, which is decided for all documents of a
seed at once: every ``LENGTH``-word window around the seed is grouped with
its equals and compared with the earliest document that has it.  Windows
with an earlier holder overlap into the maximal repeats of the document;
their words are removed.

Scale: no pair of documents is ever formed, so a passage that a third of
all documents share costs one row per occurrence, combined before the
shuffle.  Documents equal as word sequences are judged by one of them; a
text is shuffled once, and only if it holds a shared seed is it kept.
Fingerprints have 64 bits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import materialize
from .textops import Words, grams, lists, row_of, slices, word_table

LENGTH = 50
SEED = 26
_LAST = (1 << 63) - 1


def winnow(hashes: np.ndarray, at: np.ndarray, first: np.ndarray, span: int) -> np.ndarray:
    """Indices into ``at`` chosen by winnowing: the rightmost least hash of every ``span`` consecutive seeds of a row."""
    chosen = []
    edges = np.searchsorted(at, first)
    for lo, hi in zip(edges[:-1], edges[1:]):
        n = hi - lo - span + 1
        if n > 0:
            view = np.lib.stride_tricks.sliding_window_view(hashes[lo:hi][::-1], span)
            place = hi - 1 - (np.arange(n) + view.argmin(1))
            chosen.append(np.unique(place))
    return np.concatenate(chosen) if chosen else np.zeros(0, np.int64)


def grouped(codes: np.ndarray, at: np.ndarray, first: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """Per row its distinct fingerprints and, for each, its places: one that recurs inside a document is one entry."""
    row = row_of(at, first)
    order = np.lexsort((at, codes, row))
    codes, row, at = codes[order], row[order], at[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    counts = np.searchsorted(row[begin], np.arange(len(first)))
    places = lists(at - first[row], np.append(begin, len(codes)), pa.int64())
    return lists(codes[begin].view(np.int64), counts, pa.int64()), pa.ListArray.from_arrays(pa.array(counts.astype(np.int32)), places)


def seed_batches(batches: Iterator[pa.RecordBatch], seed: int, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(rid, did, n_words, words_sha256, seeds) per document; columns 0-2 are rid, did, text."""
    table = word_table()
    for batch in batches:
        for lo, n in slices(batch.column(2)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(2), table)
            codes, at = grams(words.hashes(), words.first, seed)
            chosen = winnow(codes, at, words.first, length - seed + 1)
            shas = [hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in part.column(2).to_pylist()]
            seeds, places = grouped(codes[chosen], at[chosen], words.first)
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    part.column(1),
                    pa.array(np.diff(words.first), pa.int64()),
                    pa.array(shas),
                    seeds,
                    places,
                ],
                schema=schema,
            )


def window_batches(batches: Iterator[pa.RecordBatch], seed: int, length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(rid, did, distinct window fingerprints, their starts) for all windows that cover a shared seed."""
    table = word_table()
    for batch in batches:
        for lo, n in slices(batch.column(2)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(2), table)
            codes, at = grams(words.hashes(), words.first, length)
            wanted = np.zeros(len(words.start) + 1, np.int64)
            for i, places in enumerate(part.column(3).to_pylist()):
                begin, end = int(words.first[i]), int(words.first[i + 1])
                places = begin + np.array(places, np.int64)
                np.add.at(wanted, np.maximum(places + seed - length, begin), 1)
                np.add.at(wanted, np.minimum(places + 1, end), -1)
            use = np.cumsum(wanted)[at] > 0
            codes, at = codes[use], at[use]
            found, starts = grouped(codes, at, words.first)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), found, starts], schema=schema)


def removal_batches(batches: Iterator[pa.RecordBatch], length: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(rid, removed word ranges, n_removed, kept_sha256) from rid, text and the starts of repeated windows."""
    for batch in batches:
        rows = []
        for rid, text, starts in zip(*(batch.column(i).to_pylist() for i in range(3))):
            words = (text or "").encode().split()
            spans: list[list[int]] = []
            for s in sorted(starts):
                if spans and s <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], s + length)
                else:
                    spans.append([s, s + length])
            kept, at = [], 0
            for a, b in spans:
                kept += words[at:a]
                at = b
            kept += words[at:]
            rows.append((rid, [{"start": a, "end": b} for a, b in spans], len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        columns = list(zip(*rows)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema)], schema=schema)


def _arrow(spark, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], shape).schema)


def find_repeats(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_words, n_removed, kept_sha256, repeats array<struct<start,end>>.

    Words are runs without ASCII white space, unchanged.  A window of
    ``length`` words is repeated if it also occurs in a document with a
    smaller doc_id; documents of one doc_id do not remove from each other,
    and a null doc_id counts as the largest.  Null or empty text has no
    words; other columns are ignored; an empty table gives no row.
    """
    if not 0 < seed <= length:
        raise ValueError("a seed has between one word and the length of a window")
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64("doc_id", text).alias("rid"), F.coalesce(F.col("doc_id").cast("long"), F.lit(_LAST)).alias("did"), text.alias("text"), "doc_id")
    shape = "rid long, did long, n_words long, words_sha256 string, seed array<long>, place array<array<long>>"
    arrow = _arrow(spark, shape)
    found = materialize(keyed.select("rid", "did", "text").mapInArrow(lambda it: seed_batches(it, seed, length, arrow), shape), "seeds")
    facts = found.select("rid", "did", "n_words", "words_sha256")

    # equal word sequences: the smallest doc_id speaks for all, the others go as a whole
    copies = facts.where(F.col("n_words") >= length).groupBy(F.col("words_sha256").alias("sha")).agg(F.min("did").alias("earliest"), F.max("did").alias("latest"))
    copies = copies.where("earliest < latest")
    later = found.join(copies, found["words_sha256"] == copies["sha"], "left").withColumn("copied", F.coalesce(F.col("did") > F.col("earliest"), F.lit(False)))
    marked = materialize(later.select("rid", "did", "n_words", "words_sha256", "seed", "place", "copied"), "copies")

    seeds = marked.where("not copied").select("rid", "did", F.explode(F.arrays_zip("seed", "place")).alias("s")).select("rid", "did", F.col("s.seed").alias("seed"), F.col("s.place").alias("place"))
    shared = seeds.groupBy(F.col("seed").alias("common")).agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("common")
    places = seeds.join(shared, F.col("seed") == F.col("common")).groupBy(F.col("rid").alias("owner")).agg(F.array_distinct(F.flatten(F.collect_list("place"))).alias("places"))
    holders = materialize(keyed.join(places, F.col("rid") == F.col("owner")).select("rid", "did", "text", "places"), "holders")

    window_shape = "rid long, did long, code array<long>, start array<array<long>>"
    window_arrow = _arrow(spark, window_shape)
    windows = holders.mapInArrow(lambda it: window_batches(it, seed, length, window_arrow), window_shape)
    windows = windows.select("rid", "did", F.explode(F.arrays_zip("code", "start")).alias("w")).select("rid", "did", F.col("w.code").alias("code"), F.col("w.start").alias("start"))
    earliest = windows.groupBy(F.col("code").alias("same")).agg(F.min("did").alias("lo"), F.max("did").alias("hi")).where("lo < hi").select("same", "lo")
    repeated = windows.join(earliest, (F.col("code") == F.col("same")) & (F.col("did") > F.col("lo")))
    starts = repeated.groupBy(F.col("rid").alias("owner")).agg(F.array_distinct(F.flatten(F.collect_list("start"))).alias("starts"))

    cut_shape = "cut_rid long, repeats array<struct<start:long,end:long>>, n_cut long, cut_sha256 string"
    cut_arrow = _arrow(spark, cut_shape)
    once = holders.select("rid", "text").dropDuplicates(["rid"])
    cut = once.join(starts, F.col("rid") == F.col("owner")).select("rid", "text", "starts").mapInArrow(lambda it: removal_batches(it, length, cut_arrow), cut_shape)
    cut = materialize(cut, "repeats")

    nothing = hashlib.sha256(b"").hexdigest()
    # the id of a document is its key in every step, but a null id comes back as null
    doc_id = F.when(F.col("did") != _LAST, F.col("did")).cast(dict(docs.dtypes)["doc_id"])
    whole = F.expr("array(named_struct('start', 0L, 'end', n_words))")
    return marked.join(cut, F.col("rid") == F.col("cut_rid"), "left").select(
        doc_id.alias("doc_id"),
        "n_words",
        F.when(F.col("copied"), F.col("n_words")).otherwise(F.coalesce("n_cut", F.lit(0).cast("long"))).alias("n_removed"),
        F.when(F.col("copied"), F.lit(nothing)).otherwise(F.coalesce("cut_sha256", "words_sha256")).alias("kept_sha256"),
        F.when(F.col("copied"), whole).otherwise(F.coalesce("repeats", F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"))).alias("repeats"),
    )
