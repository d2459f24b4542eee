"""Near-duplicate documents by BagMinHash signatures, bands and verified multiset overlap.

A document is a bag of five-word shingles, weighted by their counts.
Weights are discretised into dyadic intervals [0,1), [1,2), [2,4), ...; each
(shingle, interval) has a Poisson process of its own whose rate is the
interval's width, and whose points carry a time, a register and a position
in the interval; a point counts if its position is below the weight (Ertl,
"BagMinHash").  The earliest point of a register is the same in two bags
with probability equal to their weighted Jaccard similarity.  Processes are
followed only up to a time by which every register has a point.

Signatures are cut into bands; documents with an equal band are candidates,
and a link needs a weighted Jaccard similarity of ``THRESHOLD`` on the bags
themselves.

Scale: documents with equal words are one node.  In a band bucket, members
are compared with hubs, not with each other: one hub first; then, while a
bucket still holds several components, eight, 64, ... of its members outside
the largest component.  A hub is compared with all members of other
components and then retires, so when a bucket is done every pair in it is
either compared or in one component: links are complete for the classes,
and a group of n near copies costs about n comparisons.  Shingles that no
other candidate bag holds bound a bag's similarity to any other from above:
bags that cannot reach the threshold leave before the buckets are compared,
and pairs that cannot are not formed.  Both cuts are exact.  Minima and counts
combine before the shuffle; joins are plain equi-joins that Spark splits on
skew.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .graph import link_buckets
from .store import materialize, scratch, set_aside
from .textops import U64, Words, frugal, grams, lists, mix, row_of, sequences, slices, word_table

SHINGLE = 5
THRESHOLD = 0.8
#: 64-bit words of the bits kept of a bag
BIT_WORDS = 16
BANDS = 24
ROWS = 6
_NONE = U64(0xFFFFFFFFFFFFFFFF)


def shingle_bag(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, shingle, count), sorted, of all rows; a row of fewer words than ``size`` is one shingle."""
    hashes = words.hashes()
    codes, at = grams(hashes, words.first, size)
    row = row_of(at, words.first)
    counts = np.diff(words.first)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        codes, row = np.concatenate([codes, sequences(hashes, words.first)[short]]), np.concatenate([row, short])
    order = np.lexsort((codes, row))
    codes, row = codes[order], row[order]
    new = np.ones(len(codes), bool)
    new[1:] = (codes[1:] != codes[:-1]) | (row[1:] != row[:-1])
    begin = np.flatnonzero(new)
    return row[begin], codes[begin], np.diff(np.append(begin, len(codes)))


def signatures(row: np.ndarray, codes: np.ndarray, counts: np.ndarray, n_rows: int, registers: int) -> np.ndarray:
    """n_rows x registers array of point ids (rows without shingles keep the highest value)."""
    best = np.full(n_rows * registers, _NONE, U64)
    weight = np.bincount(row, counts, n_rows)
    pending = np.flatnonzero(weight > 0)
    reach = np.log(registers) + 6.0
    while len(pending):
        use = np.zeros(n_rows, bool)
        use[pending] = True
        pick = use[row]
        until = np.divide(registers * reach, weight, out=np.zeros(n_rows), where=weight > 0)
        _follow(row[pick], codes[pick], counts[pick], until, registers, best)
        left = (best.reshape(n_rows, registers)[pending] == _NONE).any(1)
        pending, reach = pending[left], reach * 2
    return (best & U64(0xFFFFFFFF)).reshape(n_rows, registers)


def _follow(row, codes, counts, until, registers, best) -> None:
    level, low = 0, 0
    while len(row):
        high = max(1, 2 * low)
        width = high - low
        seed = mix(codes + U64(0x9E3779B97F4A7C15 * (level + 1) % (1 << 64)))
        _points(row, seed, counts, low, width, until, registers, best)
        more = counts > high
        row, codes, counts, low, level = row[more], codes[more], counts[more], high, level + 1


def _points(row, seed, counts, low, width, until, registers, best) -> None:
    """Enter the points of one interval's processes up to each row's time."""
    time = np.zeros(len(row))
    i = 0
    while len(row):
        i += 1
        draw = mix(seed + U64(0xD1B54A32D192ED03 * i % (1 << 64)))
        time = time - np.log(((draw >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53) / width
        alive = time <= until[row]
        row, seed, counts, time = row[alive], seed[alive], counts[alive], time[alive]
        where = mix(draw[alive] ^ U64(0x2545F4914F6CDD1D))
        register = (where >> U64(32)) % U64(registers)
        position = low + width * ((where & U64(0xFFFFFFFF)).astype(np.float64) * 2.0**-32)
        hit = position < counts
        key = (time[hit].astype(np.float32).view(np.uint32).astype(U64) << U64(32)) | (mix(where[hit]) >> U64(32))
        np.minimum.at(best, row[hit] * registers + register[hit].astype(np.int64), key)


@frugal
def signature_batches(batches: Iterator[pa.RecordBatch], shingle: int, bands: int, rows: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(rid, did, node, n_words, bands) of (rid, did, text)."""
    table = word_table(fold_case=True)
    for batch in batches:
        for lo, n in slices(batch.column(2)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(2), table)
            node = sequences(words.hashes(), words.first)
            row, codes, counts = shingle_bag(words, shingle)
            sig = signatures(row, codes, counts, n, bands * rows)
            keys = np.zeros((n, bands), U64)
            for band in range(bands):
                key = np.full(n, band + 1, U64)
                for j in range(rows):
                    key = mix(key * U64(0x9E3779B97F4A7C15) + sig[:, band * rows + j])
                keys[:, band] = key
            filled = np.bincount(row, minlength=n) > 0
            edges = np.concatenate([[0], np.cumsum(np.where(filled, bands, 0))])
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(node.view(np.int64)), pa.array(np.diff(words.first), pa.int64()), lists(keys[filled].ravel().view(np.int64), edges, pa.int64())], schema=schema)


@frugal
def bag_batches(batches: Iterator[pa.RecordBatch], shingle: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(node, bag, bits) of (node, text): one sorted 64-bit value per shingle occurrence, so bags compare as sets, and the bits that values set."""
    table = word_table(fold_case=True)
    for batch in batches:
        for lo, n in slices(batch.column(1)):
            part = batch.slice(lo, n)
            row, codes, counts = shingle_bag(Words.of(part.column(1), table), shingle)
            again = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            values = mix(np.repeat(codes, counts) + again.astype(U64) * U64(0x9E3779B97F4A7C15))
            rows = np.repeat(row, counts)
            values = values[np.lexsort((values, rows))]
            edges = np.searchsorted(rows, np.arange(n + 1))
            bits = np.zeros((n, BIT_WORDS), U64)
            np.bitwise_or.at(bits, (rows, (values >> U64(32)).astype(np.int64) % BIT_WORDS), U64(1) << (values >> U64(58)))
            words = lists(bits.ravel().view(np.int64), np.arange(n + 1) * BIT_WORDS, pa.int64())
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array([values[a:b].tobytes() for a, b in zip(edges[:-1], edges[1:])], pa.binary()), words], schema=schema)


@frugal
def similar_batches(batches: Iterator[pa.RecordBatch], threshold: float, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The pairs (a, b) of (a, b, bag_a, bag_b) whose weighted Jaccard similarity reaches the threshold."""
    for batch in batches:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            x, y = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
            small, large = sorted((len(x), len(y)))
            if small < threshold * large:
                keep.append(False)
                continue
            common = len(np.intersect1d(x, y, assume_unique=True))
            keep.append(common >= threshold * (len(x) + len(y) - common))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=schema)


@frugal
def value_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(node, value) of every value of (node, bag)."""
    for batch in batches:
        for node, bag in zip(batch.column(0).to_pylist(), batch.column(1)):
            values = np.frombuffer(bag.as_buffer(), np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(values), node, np.int64)), pa.array(values)], schema=schema)


def reachable(threshold: float):
    """Whether two bags can be links, by size, number of own values (held by no other bag) and bits.

    A bag lacks the other's own values, and a value for every bit that the
    other sets and it does not; both bound what they share, and so their
    similarity, from above.
    """

    def possible(fact: Column, other: Column) -> Column:
        def beyond(x: Column, y: Column) -> Column:
            apart = sum((F.bit_count(x["bits"][i].bitwiseAND(F.bitwise_not(y["bits"][i]))) for i in range(BIT_WORDS)), F.lit(0))
            return x["n"] - F.greatest(x["own"], apart)

        common = F.least(beyond(fact, other), beyond(other, fact))
        return common >= threshold * (fact["n"] + other["n"] - common)

    return possible


def _arrow(spark, shape: str) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(spark.createDataFrame([], shape).schema)


def _verify(pairs: DataFrame, bags: DataFrame, threshold: float) -> DataFrame:
    left = bags.select(F.col("node").alias("n1"), F.col("bag").alias("bag_a"))
    right = bags.select(F.col("node").alias("n2"), F.col("bag").alias("bag_b"))
    rows = pairs.join(right, F.col("b") == F.col("n2")).join(left, F.col("a") == F.col("n1")).select("a", "b", "bag_a", "bag_b")
    arrow = _arrow(pairs.sparkSession, "a long, b long")
    return materialize(rows.mapInArrow(lambda it: similar_batches(it, threshold, arrow), "a long, b long"), "links")


def _classes(keyed: DataFrame, found: DataFrame, threshold: float, shingle: int) -> DataFrame:
    """(node, component) of the nodes of ``found`` that links connect."""
    spark = keyed.sparkSession
    nodes = found.where("n_words > 0").groupBy("node").agg(F.min("rid").alias("speaker"), F.any_value("bands").alias("bands"))
    spread = materialize(nodes.select("node", "speaker", F.explode("bands").alias("key")), "bands")
    crowded = spread.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo < hi").select("k")
    members = materialize(spread.join(crowded, F.col("key") == F.col("k"), "left_semi"), "buckets")
    speakers = members.groupBy("speaker").agg(F.any_value("node").alias("node"))
    bag_shape = "node long, bag binary, bits array<long>"
    bag_arrow = _arrow(spark, bag_shape)
    texts = keyed.select("rid", "text").join(speakers, F.col("rid") == F.col("speaker")).select("node", "text")
    bags = materialize(texts.mapInArrow(lambda it: bag_batches(it, shingle, bag_arrow), bag_shape).dropDuplicates(["node"]), "bags")
    value_arrow = _arrow(spark, "node long, value long")
    values = bags.select("node", "bag").mapInArrow(lambda it: value_batches(it, value_arrow), "node long, value long")
    lonely = values.groupBy("value").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo = hi").groupBy(F.col("lo").alias("owner")).agg(F.count("*").alias("own"))
    facts = bags.select(F.col("node").alias("sized"), (F.octet_length("bag") / 8).cast("long").alias("n"), "bits").join(lonely, F.col("sized") == F.col("owner"), "left").select("sized", "n", F.coalesce("own", F.lit(0).cast("long")).alias("own"), "bits")
    # a bag whose own values alone keep it from the threshold links with none
    linkable = materialize(facts.where(F.col("n") - F.col("own") >= threshold * F.col("n")), "linkable")
    weighed = materialize(members.select("key", "node").join(linkable, F.col("node") == F.col("sized")).select("key", "node", F.struct("n", "own", "bits").alias("fact")), "weighed")
    return materialize(link_buckets(weighed, lambda pairs: _verify(pairs, bags, threshold), reachable(threshold)), "classes", stays=True)


def near_duplicates(docs: DataFrame, threshold: float = THRESHOLD, shingle: int = SHINGLE, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, class_id, class_size, kept, rid.

    class_id is the smallest doc_id of the class (null only if all are
    null), ``kept`` marks one row of each class: the smallest (doc_id, rid),
    nulls last; rows that are equal in doc_id and text are marked alike, see
    ``keep_one``.  Words are runs without ASCII white space, A-Z folded; a
    text of one to four words is one shingle; a null or empty text is in a
    class of its own and kept.  Other columns are ignored.
    """
    spark = docs.sparkSession
    text = F.col("text").cast("string")
    keyed = docs.select(F.xxhash64("doc_id", text).alias("rid"), F.col("doc_id").cast("long").alias("did"), text.alias("text"))
    shape = "rid long, did long, node long, n_words long, bands array<long>"
    arrow = _arrow(spark, shape)
    found = materialize(keyed.mapInArrow(lambda it: signature_batches(it, shingle, bands, rows, arrow), shape), "signatures")
    with scratch(spark):
        labels = _classes(keyed, found, threshold, shingle)

    named = labels.select(F.col("node").alias("named"), "component")
    worded = found.where("n_words > 0").join(named, F.col("node") == F.col("named"), "left").select("rid", "did", F.coalesce("component", "node").alias("component"))
    first = F.struct(F.col("did").isNull(), "did", "rid")
    classes = worded.groupBy(F.col("component").alias("c")).agg(F.min("did").alias("class_id"), F.count("*").alias("class_size"), F.min(first).alias("first"))
    out = worded.join(classes, F.col("component") == F.col("c")).select(F.col("did").alias("doc_id"), "class_id", "class_size", (first == F.col("first")).alias("kept"), "rid")
    wordless = found.where("n_words = 0").select(F.col("did").alias("doc_id"), F.col("did").alias("class_id"), F.lit(1).cast("long").alias("class_size"), F.lit(True).alias("kept"), "rid")
    return out.unionAll(wordless)


def keep_one(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` without near copies: one row of each class, same columns; equal rows stay once."""
    keepers = near_duplicates(docs, threshold).where("kept").select(F.col("rid").alias("_keeper")).distinct()
    inner, back = set_aside(docs, ("doc_id", "text"))
    keyed = inner.withColumn("_rid", F.xxhash64("doc_id", F.col("text").cast("string")))
    return keyed.join(keepers, F.col("_rid") == F.col("_keeper")).dropDuplicates(["_rid"]).select(*back)
