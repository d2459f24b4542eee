"""Exact Jaccard join of word-shingle sets, its links given as connected components.

A document is the set of its four-word shingles.  Two documents link when
100 * intersection >= ``PERCENT`` * union.

Index lists.  Shingles are put in one global order, rare ones first; a set
can only link with one that shares a shingle of its prefix.  Shingles that
one document alone has come first and need no list, and a set of which too
few shingles occur anywhere else links with nothing and leaves at once.  An
entry holds how many shingles of its set follow; both sets of a link must
have almost equally many left at their first common shingle, so lists are
cut into blocks by that number, and blocks that are not adjacent skip each
other.

Answers from answers.  Every set is first compared with one leader, the set
of the most common shingles in its lists.  A set similar to its leader is
then written as a difference: what it lacks of a reference (the leader, set
right by the majority of its followers) and what it has besides.  For two
followers x, y of one leader

    |x & y| = |reference| - |lacks(x) | lacks(y)| + |more(x) & more(y)|

so with f(x) = |lacks(x)| + PERCENT / (100 + PERCENT) * |x| they link, when
they share nothing of their differences, if and only if f(x) + f(y) <=
|reference|.  All such links are in the component of the follower with the
smallest f, found without forming pairs.  All other links of followers share
an element of their differences, and meet in lists of those; the lists of
shingles are only needed between followers of different leaders.  Wherever
several components still meet in a list, members are compared with hubs of
the list: one, then 8, 64, ...; a hub is compared with every member of other
components that the counts admit, and retires.  No link is lost, and a group
of n near copies takes about n comparisons.

Scale: occurrences are counted per block of documents and exchanged by hash
range, as distinct fingerprints rather than rows; shingles have 64 bits,
equal sets are one node of 128 bits; the corpus is read once.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .graph import components
from .interpolation import planes, thick, thin, unplanes
from .store import materialize
from .textops import U64, Words, frugal, grams, mix, sequences, slices, word_table

SHINGLE = 4
PERCENT = 85
BLOCK_WORDS = 2_000_000
SHARD_ENTRIES = 1 << 18
#: A set is written as a difference from its leader from this similarity on.
ATTACH = 0.5
HUBS_GROW = 8
#: Copies of a class's row, so that a class of very many documents is joined in several tasks.
SALTS = 16

BLOCK = "block long, doc_id array<{id}>, words array<int>, vocabulary binary, codes binary"
ASK = "block long, shard long, hashes binary, counts binary"
REPLY = "block long, shard long, repeated binary, counts binary"
SETS = "doc_id {id}, n_shingles long, node binary, shingles binary"
RELATED = "node binary, leader binary, n long, common long, leader_n long, lacks binary, more binary, size long"


def packed(codes: np.ndarray) -> bytes:
    """Codes as compressed byte planes, after their number."""
    return np.array([len(codes)], "<u8").tobytes() + pa.compress(planes(codes), codec="zstd", asbytes=True)


def unpacked(blob: bytes) -> np.ndarray:
    n = int(np.frombuffer(blob, "<u8", 1)[0])
    return unplanes(pa.decompress(blob[8:], decompressed_size=4 * n, codec="zstd", asbytes=True))


def arrow(df: DataFrame, shape: str) -> pa.Schema:
    return to_arrow_schema(df.sparkSession.createDataFrame([], shape).schema)


@frugal
def block_batches(batches: Iterator[pa.RecordBatch], block_words: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per block of documents, of (doc_id, text): words as codes into the block's vocabulary.

    ``hashes`` and ``own`` hold the vocabulary of each run of rows and the codes into it.
    """
    table = word_table(fold_case=True)
    ids, counts, hashes, own, size = [], [], [], [], 0

    def row() -> pa.RecordBatch:
        vocabulary = np.unique(np.concatenate(hashes))
        codes = np.concatenate([np.searchsorted(vocabulary, x).astype("<u4")[c] for x, c in zip(hashes, own)])
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        values = [pa.array([0], pa.int64()), one(pa.concat_arrays(ids)), one(pa.array(np.concatenate(counts), pa.int32())), pa.array([vocabulary.astype("<u8").tobytes()], pa.binary()), pa.array([packed(codes)], pa.binary())]
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema)], schema=schema)

    for batch in batches:
        for lo, n in slices(batch.column(1)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(1), table)
            ids.append(part.column(0))
            counts.append(np.diff(words.first))
            vocabulary, codes = np.unique(words.hashes(), return_inverse=True)
            hashes.append(vocabulary)
            own.append(codes.astype(np.int32))
            size += len(codes)
            if size >= block_words:
                yield row()
                ids, counts, hashes, own, size = [], [], [], [], 0
    if ids:
        yield row()


def sets_of(words, vocabulary: bytes, codes: bytes, shingle: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(row, shingle) of every document's set, sorted by shingle, then row, and the number of rows."""
    first = np.concatenate([[0], np.cumsum(np.asarray(words, np.int64))])
    hashes = np.frombuffer(vocabulary, "<u8")[unpacked(codes)]
    size = np.diff(first)
    short = np.flatnonzero((size > 0) & (size < shingle))
    few = sequences(hashes[np.repeat(size < shingle, size)], np.concatenate([[0], np.cumsum(size[short])])) if len(short) else np.zeros(0, U64)
    # a block is large: rows are narrow numbers, and each array goes as soon as it has served
    values = np.concatenate([grams(hashes, first, shingle)[0], few])
    del hashes
    row = np.concatenate([np.repeat(np.arange(len(size), dtype=np.int32), np.maximum(size - shingle + 1, 0)), short.astype(np.int32)])
    order = np.argsort(values, kind="stable")  # rows of one value ascend as before
    values = values[order]
    row = row[order]
    del order
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (row[1:] != row[:-1])
    return row[new], values[new], len(size)


def runs(values: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins, and the end."""
    new = np.ones(len(values), bool)
    new[1:] = values[1:] != values[:-1]
    return np.append(np.flatnonzero(new), len(values))


@frugal
def ask_batches(batches: Iterator[pa.RecordBatch], shingle: int, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Distinct shingles of each block by shard, and in how many of its documents each is.

    32 bits go besides the shard's.  Two shingles that share them count as
    one, which puts both a little later in the order, for all sets alike.
    """
    for batch in batches:
        for row in batch.to_pylist():
            _, values, _ = sets_of(row["words"], row["vocabulary"], row["codes"], shingle)
            if not len(values):
                continue
            begin = runs(values)
            distinct, count = values[begin[:-1]], np.diff(begin)
            edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits) if bits else np.zeros(1, U64)
            cut = np.append(np.searchsorted(distinct, edges), len(distinct))
            out = [(row["block"], i, distinct[a:b].astype("<u4").tobytes(), thin(count[a:b])) for i, (a, b) in enumerate(zip(cut[:-1].tolist(), cut[1:].tolist())) if a < b]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


@frugal
def reply_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Which of a block's shingles other documents have too, and in how many documents those are; rows come sorted by shard."""
    held: list[tuple] = []

    def answer() -> pa.RecordBatch:
        hashes = [np.frombuffer(r[2], "<u4") for r in held]
        distinct, code = np.unique(np.concatenate(hashes), return_inverse=True)
        total = np.bincount(code, np.concatenate([thick(r[3]) for r in held]), len(distinct)).astype(np.int64)
        replies = np.split(total[code], np.cumsum([len(h) for h in hashes])[:-1])
        rows = [(r[0], r[1], np.packbits(t > 1).tobytes(), thin(t[t > 1])) for r, t in zip(held, replies)]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][1] != row[1]:
                yield answer()
            held.append(row)
    if held:
        yield answer()


@frugal
def set_batches(batches: Iterator[pa.RecordBatch], shingle: int, percent: int, bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(doc_id, n_shingles, node, shingles) per document of answered blocks; node and shingles only of sets that may link.

    shingles: those that other documents have too, rare ones first.  node:
    the share of the set's own shingles (one byte, so that sets of common
    shingles are the smallest nodes) and a digest of the whole set.
    """
    for batch in batches:
        for b in range(batch.num_rows):
            of = {name: batch.column(name)[b] for name in batch.schema.names}
            row, values, n_rows = sets_of(of["words"].values.to_numpy(), of["vocabulary"].as_py(), of["codes"].as_py(), shingle)
            begin = runs(values) if len(values) else np.zeros(1, np.int64)
            distinct = values[begin[:-1]]
            edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits) if bits else np.zeros(1, U64)
            cut = np.append(np.searchsorted(distinct, edges), len(distinct))
            total = np.ones(len(distinct), np.int64)
            for r in of["replies"].as_py() or []:
                lo, hi = cut[r["shard"]], cut[r["shard"] + 1]
                total[lo + np.flatnonzero(np.unpackbits(np.frombuffer(r["repeated"], np.uint8), count=hi - lo))] = thick(r["counts"])
            total = np.repeat(total, np.diff(begin))
            n = np.bincount(row, minlength=n_rows)
            common = np.bincount(row, total > 1, n_rows).astype(np.int64)
            able = np.flatnonzero((n > 0) & (100 * common >= percent * n))
            pick = np.zeros(n_rows, bool)
            pick[able] = True
            pick = pick[row]
            row, values, total = row[pick], values[pick], total[pick]
            by_row = np.argsort(row, kind="stable")  # values stay sorted within a row
            row, values, total = row[by_row], values[by_row], total[by_row]
            edge = np.searchsorted(row, np.arange(n_rows + 1))
            nodes: list = [None] * n_rows
            shingles: list = [None] * n_rows
            for i in able.tolist():
                mine, often = values[edge[i] : edge[i + 1]], total[edge[i] : edge[i + 1]]
                nodes[i] = bytes([int(255 * (n[i] - common[i]) // n[i])]) + hashlib.md5(mine.astype("<u8").tobytes()).digest()
                shared = often > 1
                shingles[i] = mine[shared][np.lexsort((mine[shared], often[shared]))].astype("<u8").tobytes()
            yield pa.RecordBatch.from_arrays([of["doc_id"].values, pa.array(n, pa.int64()), pa.array(nodes, pa.binary()), pa.array(shingles, pa.binary())], schema=schema)


def shingle_sets(docs: DataFrame, shingle: int, percent: int, block_words: int) -> DataFrame:
    """``SETS`` of ``docs`` (doc_id, text), one row per row."""
    id_type = dict(docs.dtypes)["doc_id"]
    shape, out = BLOCK.format(id=id_type), SETS.format(id=id_type)
    block_arrow, ask_arrow, reply_arrow, out_arrow = (arrow(docs, s) for s in (shape, ASK, REPLY, out))
    blocks = docs.mapInArrow(lambda it: block_batches(it, block_words, block_arrow), shape).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "blocks")
    total = blocks.agg(F.sum(F.aggregate("words", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, int(total // SHARD_ENTRIES)).bit_length()
    asked = blocks.select("block", "words", "vocabulary", "codes").mapInArrow(lambda it: ask_batches(it, shingle, bits, ask_arrow), ASK)
    replies = asked.repartition(F.col("shard")).sortWithinPartitions("shard", "block").mapInArrow(lambda it: reply_batches(it, reply_arrow), REPLY)
    own = replies.groupBy(F.col("block").alias("to")).agg(F.collect_list(F.struct("shard", "repeated", "counts")).alias("replies"))
    answered = blocks.join(own, F.col("block") == F.col("to"), "left").select("doc_id", "words", "vocabulary", "codes", "replies")
    return materialize(answered.mapInArrow(lambda it: set_batches(it, shingle, percent, bits, out_arrow), out), "sets")


@frugal
def prefix_batches(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(key, node, n, left) of (node, n, shingles): the entries of each set's prefix, in its block of the list and the next."""
    width = -np.log(percent / 100 - 1e-6) if percent < 100 else 1e-6
    for batch in batches:
        keys, nodes, sizes, rest = [], [], [], []
        for i, (n, shingles) in enumerate(zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())):
            shingles = np.frombuffer(shingles, "<u8")
            own = n - len(shingles)
            prefix = n + (-percent * n // 100) + 1  # n - ceil(n * percent / 100) + 1
            left = n - np.arange(own, max(prefix, own))
            at = np.floor(np.log(left) / width).astype(np.int64).astype(U64)
            token = shingles[: len(left)]
            for step in (U64(0), U64(1)):
                keys.append(mix(token ^ mix(at + step + U64(1))))
                rest.append(left)
                nodes.append(np.full(len(left), i))
                sizes.append(np.full(len(left), n))
        if keys:
            at = pa.array(np.concatenate(nodes))
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)), batch.column(0).take(at), pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(rest), pa.int64())], schema=schema)


@frugal
def relate_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """``RELATED`` of (node, n, shingles, leader, leader_n, leader_shingles): overlap with the leader, and the difference."""
    for batch in batches:
        out = []
        for node, n, mine, leader, leader_n, other in zip(*(c.to_pylist() for c in batch.columns)):
            mine, other = np.frombuffer(mine, "<u8"), np.frombuffer(other, "<u8")
            common = np.intersect1d(mine, other, assume_unique=True)
            near = len(common) >= ATTACH * (n + leader_n - len(common))
            lacks, more = (np.setdiff1d(x, common, assume_unique=True).tobytes() if near else None for x in (other, mine))
            out.append((node, leader, n, len(common), leader_n, lacks, more, len(other)))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


@frugal
def element_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(leader, kind, element, node) of (leader, node, lacks, more); kind is 0 for what a set lacks, 1 for what it has besides."""
    for batch in batches:
        leaders, nodes = batch.column(0), batch.column(1)
        for kind in (0, 1):
            blobs = batch.column(2 + kind).to_pylist()
            values = np.frombuffer(b"".join(blobs), "<u8")
            at = pa.array(np.repeat(np.arange(len(blobs)), [len(x) // 8 for x in blobs]))
            yield pa.RecordBatch.from_arrays([leaders.take(at), pa.array(np.full(len(values), kind), pa.int32()), pa.array(values.view(np.int64)), nodes.take(at)], schema=schema)


@frugal
def correct_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(node, leader, n, size, lacks, more) about the reference, of the same about the leader and the elements to flip."""
    for batch in batches:
        out = []
        for node, leader, n, size, lacks, more, drop, add in zip(*(c.to_pylist() for c in batch.columns)):
            lacks, more = np.frombuffer(lacks, "<u8"), np.frombuffer(more, "<u8")
            drop, add = (np.array(x or [], np.int64).view("<u8") for x in (drop, add))
            now_lacks = np.concatenate([np.setdiff1d(lacks, drop), np.setdiff1d(add, more)])
            now_more = np.concatenate([np.setdiff1d(more, add), np.setdiff1d(drop, lacks)])
            out.append((node, leader, n, size - len(drop) + len(add), now_lacks.tobytes(), now_more.tobytes()))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _links(common: np.ndarray | int, n: int, m: int, percent: int) -> bool:
    return 100 * common >= percent * (n + m - common)


@frugal
def full_batches(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of (a, b, n_a, n_b, shingles_a, shingles_b)."""
    for batch in batches:
        keep = []
        for n, m, x, y in zip(*(batch.column(i).to_pylist() for i in range(2, 6))):
            keep.append(_links(len(np.intersect1d(np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8"), assume_unique=True)), n, m, percent))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=schema)


@frugal
def derived_batches(batches: Iterator[pa.RecordBatch], percent: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """The links (a, b) of (a, b, n_a, n_b, size, lacks_a, more_a, lacks_b, more_b): followers of one leader, by their differences."""
    for batch in batches:
        keep = []
        for n, m, size, *blobs in zip(*(batch.column(i).to_pylist() for i in range(2, 9))):
            lacks_a, more_a, lacks_b, more_b = (np.frombuffer(x, "<u8") for x in blobs)
            common = size - len(np.union1d(lacks_a, lacks_b)) + len(np.intersect1d(more_a, more_b, assume_unique=True))
            keep.append(_links(common, n, m, percent))
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], schema=schema)


PAIR = "a binary, b binary"


def _pairs_found(pairs: DataFrame, classes: DataFrame, followers: DataFrame, percent: int) -> DataFrame:
    """The links among pairs (a, b, derived)."""
    out = arrow(pairs, PAIR)
    sides = [classes.select(*(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "shingles"))) for s in "ab"]
    full = pairs.where("not derived").join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    full = full.select("a", "b", "n_a", "n_b", "shingles_a", "shingles_b").mapInArrow(lambda it: full_batches(it, percent, out), PAIR)
    sides = [followers.select(*(F.col(c).alias(f"{c}_{s}") for c in ("node", "n", "size", "lacks", "more"))) for s in "ab"]
    derived = pairs.where("derived").join(sides[0], F.col("a") == F.col("node_a")).join(sides[1], F.col("b") == F.col("node_b"))
    derived = derived.select("a", "b", "n_a", "n_b", "size_a", "lacks_a", "more_a", "lacks_b", "more_b").mapInArrow(lambda it: derived_batches(it, percent, out), PAIR)
    return materialize(full.unionAll(derived), "links")


def _ceiling(percent: int, n: Column, m: Column) -> Column:
    """Smallest overlap of a link between sets of sizes n and m."""
    return F.ceil(percent * (n + m) / (100 + percent) - F.lit(1e-9))


def settle(entries: DataFrame, labels: DataFrame, found, percent: int) -> DataFrame:
    """(node, component) once every pair that meets in a list and may link is compared or connected.

    entries: (key, node, n, leader, derived, left, lacks, more, size) rows of
    lists; a list of shingles (``derived`` false) compares followers of
    different leaders, one of differences those of its own leader.
    """
    facts = ["n", "leader", "derived", "left", "lacks", "more", "size"]
    several = 1
    while True:
        named = labels.select(F.col("node").alias("named"), "component")
        now = entries.join(named, F.col("node") == F.col("named"), "left").select("key", "node", *facts, F.coalesce("component", "node").alias("component"))
        lists = now.groupBy(F.col("key").alias("k")).agg(F.min("component").alias("c0"), F.max("component").alias("c1"), F.min("leader").alias("l0"), F.max("leader").alias("l1"), F.bool_and("derived").alias("d"), F.min("node").alias("least"), F.count("*").alias("members"))
        lists = lists.where("c0 < c1 and (d or l0 < l1)").select("k", "least", F.ceil(F.col("members") / several).alias("every"))
        now = materialize(now.join(lists, F.col("key") == F.col("k")).select("key", "node", *facts, "component", "least", "every"), "lists")
        if now.isEmpty():
            return labels
        picked = (F.col("node") == F.col("least")) | ((F.pmod(F.xxhash64("node", "key"), F.col("every")) == 0) if several > 1 else F.lit(False))
        hubs = now.where(picked).select(*(F.col(c).alias(f"h_{c}") for c in ("key", "node", "component", *facts)))
        need = _ceiling(percent, F.col("n"), F.col("h_n"))
        by_place = (F.col("leader") != F.col("h_leader")) & (F.least("left", "h_left") >= need)
        by_difference = F.col("size") - F.greatest("lacks", "h_lacks") + F.least("more", "h_more") >= need
        meets = now.join(hubs, (F.col("key") == F.col("h_key")) & (F.col("component") != F.col("h_component")) & (F.least("n", "h_n") >= need) & F.when(F.col("derived"), by_difference).otherwise(by_place))
        pairs = materialize(meets.select(F.least("node", "h_node").alias("a"), F.greatest("node", "h_node").alias("b"), "derived").distinct(), "pairs")
        links = found(pairs)
        if not links.isEmpty():
            labels = components(links.unionAll(labels.select(F.col("component").alias("a"), F.col("node").alias("b"))))
        entries = now.where(~picked).select("key", "node", *facts)
        several *= HUBS_GROW


def linked_classes(classes: DataFrame, percent: int) -> DataFrame:
    """(node, component) of the sets (node, n, shingles) that link with another; component is the smallest node."""
    shape = "key long, node binary, n long, left long"
    out = arrow(classes, shape)
    entries = classes.select("node", "n", "shingles").mapInArrow(lambda it: prefix_batches(it, percent, out), shape)
    entries = materialize(entries, "entries")
    lists = entries.groupBy(F.col("key").alias("k")).agg(F.min("node").alias("hub"), F.max("node").alias("last")).where("hub < last").select("k", "hub")
    entries = materialize(entries.join(lists, F.col("key") == F.col("k")).select("key", "node", "n", "left", "hub"), "index")

    # leaders, and every other set's difference from its own
    led = entries.groupBy("node").agg(F.min("hub").alias("leader")).where("leader < node")
    heads = classes.select(F.col("node").alias("head"), F.col("n").alias("leader_n"), F.col("shingles").alias("leader_shingles"))
    asked = led.join(classes.select(F.col("node").alias("of"), "n", "shingles"), F.col("node") == F.col("of")).join(heads, F.col("leader") == F.col("head"))
    related_arrow = arrow(classes, RELATED)
    related = asked.select("node", "n", "shingles", "leader", "leader_n", "leader_shingles").mapInArrow(lambda it: relate_batches(it, related_arrow), RELATED)
    related = materialize(related, "related")
    links = related.where(F.lit(100) * F.col("common") >= percent * (F.col("n") + F.col("leader_n") - F.col("common"))).select(F.col("leader").alias("a"), F.col("node").alias("b"))

    near = related.where("lacks is not null")
    element_shape = "leader binary, kind int, element long, node binary"
    element_arrow = arrow(classes, element_shape)
    elements = lambda df: df.select("leader", "node", "lacks", "more").mapInArrow(lambda it: element_batches(it, element_arrow), element_shape)
    # what most followers lack of their leader, or have besides, is corrected in the reference
    groups = near.groupBy(F.col("leader").alias("g")).agg(F.count("*").alias("members"))
    often = elements(near).groupBy("leader", "kind", "element").agg(F.count("*").alias("times"))
    flips = often.join(groups, F.col("leader") == F.col("g")).where("2 * times > members + 1").groupBy(F.col("leader").alias("g")).agg(F.collect_list(F.when(F.col("kind") == 0, F.col("element"))).alias("drop"), F.collect_list(F.when(F.col("kind") == 1, F.col("element"))).alias("add"))
    follower_shape = "node binary, leader binary, n long, size long, lacks binary, more binary"
    follower_arrow = arrow(classes, follower_shape)
    # many sets may follow one leader: its elements go to several tasks
    flips = flips.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = (F.col("leader") == F.col("g")) & (F.pmod(F.xxhash64("node"), F.lit(SALTS)).cast("int") == F.col("salt"))
    followers = near.join(flips, salted, "left").select("node", "leader", "n", "size", "lacks", "more", "drop", "add")
    followers = materialize(followers.mapInArrow(lambda it: correct_batches(it, follower_arrow), follower_shape), "followers")

    # followers that share nothing of their differences link through the one with the smallest f
    weight = F.octet_length("lacks") / 8 + F.lit(percent / (100 + percent)) * F.col("n")
    weighed = followers.select("node", "leader", "size", weight.alias("f"))
    centres = weighed.groupBy(F.col("leader").alias("g")).agg(F.min(F.struct("f", "node")).alias("centre"))
    star = weighed.join(centres, F.col("leader") == F.col("g")).where((F.col("node") != F.col("centre.node")) & (F.col("f") + F.col("centre.f") <= F.col("size") + F.lit(1e-9)))
    links = links.unionAll(star.select(F.col("centre.node").alias("a"), F.col("node").alias("b")))
    labels = components(links)

    sized = followers.select(F.col("node").alias("who"), "leader", "n", "size", (F.octet_length("lacks") / 8).cast("long").alias("lacks"), (F.octet_length("more") / 8).cast("long").alias("more"))
    able = sized.where(F.lit(100) * (F.col("size") - F.col("lacks") + F.col("more")) >= percent * F.col("n"))
    # a leader whose followers are all in one component needs no lists of differences
    state = sized.join(labels, F.col("who") == F.col("node"), "left").select("leader", F.coalesce("component", "who").alias("component"))
    mixed = state.groupBy(F.col("leader").alias("g")).agg(F.min("component").alias("c0"), F.max("component").alias("c1")).where("c0 < c1").select("g")
    differ = elements(followers.join(mixed, F.col("leader") == F.col("g"), "left_semi")).withColumnRenamed("leader", "of")
    none = F.lit(None).cast("long")
    differ = differ.join(able, F.col("node") == F.col("who")).select(F.xxhash64("of", "kind", "element").alias("key"), "node", "n", "leader", F.lit(True).alias("derived"), none.alias("left"), "lacks", "more", "size")
    marks = sized.select("who", F.col("leader").alias("led"))
    shared = entries.join(marks, F.col("node") == F.col("who"), "left").select("key", "node", "n", F.coalesce("led", "node").alias("leader"), F.lit(False).alias("derived"), "left", none.alias("lacks"), none.alias("more"), none.alias("size"))
    return settle(shared.unionAll(differ), labels, lambda pairs: _pairs_found(pairs, classes, followers, percent), percent)


def jaccard_components(docs: DataFrame, percent: int = PERCENT, shingle: int = SHINGLE, block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Words are runs without ASCII white space, A-Z folded; a text of fewer
    words than a shingle is one shingle, a null text or one without words has
    none and links with nothing.  component_id is the smallest doc_id
    reachable by links of at least ``percent``, null only if all are null.
    Repeated rows and equal texts link.  Ids may be of any ordered type;
    other columns are ignored; an empty table gives no row.
    """
    sets = shingle_sets(docs.select("doc_id", F.col("text").cast("string").alias("text")), shingle, percent, block_words)
    able = sets.where("node is not null")
    classes = materialize(able.groupBy("node").agg(F.first("n_shingles").alias("n"), F.first("shingles").alias("shingles"), F.min("doc_id").alias("least")), "classes")
    labels = linked_classes(classes, percent)
    named = classes.join(labels.select(F.col("node").alias("named"), "component"), F.col("node") == F.col("named"), "left").select("node", "least", F.coalesce("component", "node").alias("component"))
    smallest = named.groupBy(F.col("component").alias("c")).agg(F.min("least").alias("component_id"))
    ids = named.join(smallest, F.col("component") == F.col("c")).select(F.col("node").alias("named"), "component_id", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")
    linked = able.join(ids, (F.col("node") == F.col("named")) & (salt == F.col("salt"))).select("doc_id", "n_shingles", "component_id")
    return sets.where("node is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")).unionAll(linked)
