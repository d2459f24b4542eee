"""Language-model scores by deleted interpolation of n-gram frequencies.

P(w | v) mixes the maximum-likelihood estimates c(v w) / c(v) and c(w) / N
with 1 / (V + 1), with weights by the frequency bucket of the context v
(Jelinek and Mercer).  The weights are learned by expectation-maximisation
on a held-out slice of the training documents, each of whose occurrences is
first deleted from the counts.

Scale: counts cover the whole corpus and are never gathered in one place.
Documents are read once into blocks of about ``BLOCK_TOKENS`` tokens.  A
block asks for its distinct words and word pairs, as sorted fingerprints
cut into hash ranges ("shards"); a shard adds up the counts of all blocks
and answers each block in the order of its questions.  So the shuffle holds
distinct pairs per block rather than tokens, a word in every document is
one entry a block, and the memory of a task is bounded by the size of a
block or a shard, whose numbers grow with the corpus.  EM sees a histogram
of bounded size.  Fingerprints of words have 64 bits, those of pairs 48
bits besides the shard's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .store import materialize
from .textops import U64, Words, mix, slices, word_table

BLOCK_TOKENS = 2_000_000
SHARD_ENTRIES = 1 << 18
BUCKETS = 48
CELLS_PER_OCTAVE = 4
EM_STEPS = 100
HELD_SHARE = 16
END = U64(0x8D3C5E21F4A9B607)
BEGIN = U64(0x41C64E6DA3BC0074)

BLOCK = "block long, held boolean, doc_id array<{id}>, tokens array<int>, train array<boolean>, words binary, codes binary"
ASK = "block long, shard long, ones binary, one_counts binary, pairs binary, pair_counts binary"
REPLY = "block long, shard long, ones binary, pairs binary, n long, v long"


def thin(counts: np.ndarray) -> bytes:
    """Counts in a byte each; larger ones follow as (index, count)."""
    large = np.flatnonzero(counts > 254)
    head = np.array([len(counts), len(large)], "<u4").tobytes()
    return head + np.minimum(counts, 255).astype(np.uint8).tobytes() + large.astype("<u4").tobytes() + counts[large].astype("<u8").tobytes()


def thick(blob: bytes) -> np.ndarray:
    n, large = np.frombuffer(blob, "<u4", 2)
    out = np.frombuffer(blob, np.uint8, n, 8).astype(np.int64)
    at = np.frombuffer(blob, "<u4", large, 8 + n)
    out[at] = np.frombuffer(blob, "<u8", large, 8 + n + 4 * large).astype(np.int64)
    return out


def six(hashes: np.ndarray) -> bytes:
    """The low 48 bits of each fingerprint."""
    return np.ascontiguousarray(hashes.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def unsix(blob: bytes) -> np.ndarray:
    low = np.frombuffer(blob, np.uint8).reshape(-1, 6)
    out = np.zeros((len(low), 8), np.uint8)
    out[:, :6] = low
    return out.view("<u8").ravel()


def planes(codes: np.ndarray) -> bytes:
    """Codes as four byte planes, which compress better than words."""
    return np.ascontiguousarray(codes.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes()


def unplanes(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(4, -1).T).view("<u4").ravel().astype(np.int64)


class Gathering:
    """Documents on their way into a block."""

    def __init__(self, held: bool):
        self.held = held
        self.ids: list[pa.Array] = []
        self.tokens: list[np.ndarray] = []
        self.train: list[np.ndarray] = []
        self.hashes: list[np.ndarray] = []
        self.size = 0

    def add(self, ids: pa.Array, hashes: np.ndarray, tokens: np.ndarray, train: np.ndarray) -> None:
        for kept, x in ((self.ids, ids), (self.tokens, tokens), (self.train, train), (self.hashes, hashes)):
            kept.append(x)
        self.size += len(hashes)

    def row(self, schema: pa.Schema) -> pa.RecordBatch:
        words, codes = np.unique(np.concatenate(self.hashes), return_inverse=True)
        one = lambda x: pa.ListArray.from_arrays(pa.array([0, len(x)], pa.int32()), x)
        ids = pa.concat_arrays(self.ids)
        values = [pa.array([0], pa.int64()), pa.array([self.held]), one(ids), one(pa.array(np.concatenate(self.tokens), pa.int32())), one(pa.array(np.concatenate(self.train))), pa.array([words.astype("<u8").tobytes()], pa.binary()), pa.array([planes(codes)], pa.binary())]
        self.__init__(self.held)
        return pa.RecordBatch.from_arrays([v.cast(f.type) for v, f in zip(values, schema)], schema=schema)


def block_batches(batches: Iterator[pa.RecordBatch], block_tokens: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """One row per block, of (doc_id, text, train, held); tokens of a document end with ``END``."""
    table = word_table(fold_case=True)
    kinds = Gathering(False), Gathering(True)
    for batch in batches:
        for lo, n in slices(batch.column(1)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(1), table)
            counts = np.diff(words.first)
            hashes = np.insert(words.hashes(), words.first[1:], END)
            first = np.concatenate([[0], np.cumsum(counts + 1)])
            train, held = (part.column(i).to_numpy(zero_copy_only=False).astype(bool) for i in (2, 3))
            for kind in kinds:
                rows = np.flatnonzero(held == kind.held)
                if len(rows):
                    pick = np.repeat(held == kind.held, counts + 1)
                    kind.add(part.column(0).take(pa.array(rows)), hashes[pick], counts[rows] + 1, train[rows])
                    if kind.size >= block_tokens:
                        yield kind.row(schema)
            del first
    for kind in kinds:
        if kind.ids:
            yield kind.row(schema)


class Block:
    """Arrays of a block row: tokens by document, their pairs with the word before."""

    def __init__(self, tokens, train, words: bytes, codes: bytes):
        self.tokens = np.asarray(tokens, np.int64)
        self.words = np.frombuffer(words, "<u8")
        self.codes = unplanes(codes)
        self.of_train = np.repeat(np.asarray(train, bool), self.tokens)
        self.first = np.concatenate([[0], np.cumsum(self.tokens)])
        self.hashes = self.words[self.codes]
        before = np.empty_like(self.hashes)
        before[1:] = self.hashes[:-1]
        before[self.first[:-1]] = BEGIN
        self.pairs, self.pair_codes = np.unique(mix(before * U64(0x9E3779B97F4A7C15) + self.hashes), return_inverse=True)


def ask_batches(batches: Iterator[pa.RecordBatch], bits: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Questions of each block, by shard: (fingerprint, count in training) of words and pairs."""
    for batch in batches:
        for row in batch.to_pylist():
            block = Block(row["tokens"], row["train"], row["words"], row["codes"])
            ones = np.bincount(block.codes, block.of_train, len(block.words)).astype(np.int64)
            pairs = np.bincount(block.pair_codes, block.of_train, len(block.pairs)).astype(np.int64)
            edges = np.arange(1 << bits, dtype=U64) << U64(64 - bits) if bits else np.zeros(1, U64)
            cut_one = np.append(np.searchsorted(block.words, edges), len(block.words))
            cut_pair = np.append(np.searchsorted(block.pairs, edges), len(block.pairs))
            out = []
            for shard in np.flatnonzero((np.diff(cut_one) > 0) | (np.diff(cut_pair) > 0)).tolist():
                a, b, c, d = cut_one[shard], cut_one[shard + 1], cut_pair[shard], cut_pair[shard + 1]
                out.append((row["block"], shard, six(block.words[a:b]), thin(ones[a:b]), six(block.pairs[c:d]), thin(pairs[c:d])))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def reply_batches(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Total counts for every question; rows come sorted by shard.  n, v: training tokens and distinct words of the shard, once."""
    held: list[tuple] = []

    def answer():
        sums = []
        for key, count in ((2, 3), (4, 5)):
            hashes = [unsix(r[key]) for r in held]
            counts = np.concatenate([thick(r[count]) for r in held])
            distinct, code = np.unique(np.concatenate(hashes), return_inverse=True)
            total = np.bincount(code, counts, len(distinct)).astype(np.int64)
            sums.append((total, np.split(total[code], np.cumsum([len(h) for h in hashes])[:-1])))
        ones = sums[0][0]
        rows = [(r[0], r[1], thin(x), thin(y), int(ones.sum()) if not i else 0, int((ones > 0).sum()) if not i else 0) for i, (r, x, y) in enumerate(zip(held, sums[0][1], sums[1][1]))]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            if held and held[-1][1] != row[1]:
                yield answer()
            held.append(row)
    if held:
        yield answer()


def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, int, Block, np.ndarray, np.ndarray, np.ndarray]]:
    """(batch, row, block, c(w), c(v), c(v w)) per token of each answered block."""
    for batch in batches:
        for i in range(batch.num_rows):
            row = {name: batch.column(name)[i] for name in batch.schema.names}
            block = Block(row["tokens"].values.to_numpy(), row["train"].values.to_numpy(zero_copy_only=False), row["words"].as_py(), row["codes"].as_py())
            replies = sorted(row["replies"].as_py(), key=lambda r: r["shard"])
            ones = np.concatenate([thick(r["ones"]) for r in replies])
            pairs = np.concatenate([thick(r["pairs"]) for r in replies])[block.pair_codes]
            word = ones[block.codes]
            context = np.empty_like(word)
            context[1:] = word[:-1]
            end = np.searchsorted(block.words, END)
            context[block.first[:-1]] = ones[end]  # a document begins as often as one ends
            yield batch, i, block, word, context, pairs


def bucket_of(context: np.ndarray) -> np.ndarray:
    return np.minimum(np.floor(2 * np.log2(1 + context)), BUCKETS - 1).astype(np.int64)


def cell_batches(batches: Iterator[pa.RecordBatch], n: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Histogram of the held-out tokens: (bucket, cell of c(v w) / c(v), cell of c(w) / N, tokens), own occurrence deleted."""
    cell = lambda f: np.where(f > 0, np.floor(-CELLS_PER_OCTAVE * np.log2(np.maximum(f, 2.0**-200))), -1).astype(np.int64)
    for _, _, _, word, context, pairs in answered(batches):
        word, context, pairs = word - 1, context - 1, pairs - 1
        two = cell(np.where(context > 0, pairs / np.maximum(context, 1), 0))
        one = cell(word / max(n - 1, 1))
        key, count = np.unique(np.stack([bucket_of(context), two, one], 1), axis=0, return_counts=True)
        yield pa.RecordBatch.from_arrays([*(pa.array(key[:, j]) for j in range(3)), pa.array(count.astype(np.int64))], schema=schema)


def learn_weights(cells: np.ndarray, v: int) -> np.ndarray:
    """BUCKETS x 3 mixture weights (pair, word, uniform) by EM; cells: rows (bucket, two, one, tokens)."""
    middle = lambda c: np.where(c >= 0, 2.0 ** (-(c + 0.5) / CELLS_PER_OCTAVE), 0.0)
    bucket, tokens = cells[:, 0].astype(int), cells[:, 3].astype(float)
    parts = np.stack([middle(cells[:, 1]), middle(cells[:, 2]), np.full(len(cells), 1 / (v + 1))], 1)
    weights = np.full((BUCKETS, 3), 1 / 3)
    for _ in range(EM_STEPS):
        share = weights[bucket] * parts
        share *= (tokens / share.sum(1))[:, None]
        # one pseudo-token keeps a weight from vanishing
        sums = np.stack([np.bincount(bucket, share[:, j], BUCKETS) for j in range(3)], 1) + 1 / 3
        weights = sums / sums.sum(1, keepdims=True)
    weights[0] = [0, *(weights[0, 1:] / weights[0, 1:].sum())]  # a context that was never seen
    return weights


def score_batches(batches: Iterator[pa.RecordBatch], n: int, v: int, weights: np.ndarray, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for batch, i, block, word, context, pairs in answered(batches):
        pair, one, flat = weights[bucket_of(context)].T
        p = pair * pairs / np.maximum(context, 1) + one * word / max(n, 1) + flat / (v + 1)
        sums = lambda x: np.add.reduceat(x, block.first[:-1])
        columns = {
            "doc_id": batch.column("doc_id")[i].values,
            "n_tokens": pa.array(block.tokens),
            "n_known": pa.array(sums((word > 0).astype(np.int64))),
            "train_tokens": pa.array(np.full(len(block.tokens), n, np.int64)),
            "base_score": pa.array(sums(np.log10((word + 1) / (n + v + 1)))),
            "score": pa.array(sums(np.log10(p))),
        }
        yield pa.RecordBatch.from_arrays([columns[f.name].cast(f.type) for f in schema], schema=schema)


def score(docs: DataFrame, train: Column, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """doc_id, n_tokens, n_known, train_tokens, base_score, score per row of ``docs`` (doc_id, text).

    Learns from the rows where ``train`` holds.  A-Z folded; tokens are runs
    without ASCII white space, then one end.  A null or empty text is its
    end alone.  Repeated rows count and are scored each; a null doc_id stays
    null (it is not a training row if ``train`` is null for it); other
    columns are ignored; an empty table gives no row.  Without any training
    row every probability is the uniform one.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    id_type = dict(docs.dtypes)["doc_id"]
    schema = lambda shape: to_arrow_schema(spark.createDataFrame([], shape).schema)
    text = F.col("text").cast("string")
    learned = F.coalesce(train, F.lit(False))
    marked = docs.select("doc_id", text.alias("text"), learned.alias("train"), (learned & (F.pmod(F.xxhash64("doc_id", text), F.lit(HELD_SHARE)) == 0)).alias("held"))
    block_shape = BLOCK.format(id=id_type)
    block_arrow, ask_arrow, reply_arrow = schema(block_shape), schema(ASK), schema(REPLY)
    blocks = marked.mapInArrow(lambda it: block_batches(it, block_tokens, block_arrow), block_shape).withColumn("block", F.monotonically_increasing_id())
    blocks = materialize(blocks, "blocks")
    total = blocks.agg(F.sum(F.aggregate("tokens", F.lit(0).cast("long"), lambda a, x: a + x))).first()[0] or 0
    bits = max(0, int(total // SHARD_ENTRIES)).bit_length()
    asked = blocks.select("block", "tokens", "train", "words", "codes").mapInArrow(lambda it: ask_batches(it, bits, ask_arrow), ASK)
    replies = asked.repartition(F.col("shard")).sortWithinPartitions("shard", "block").mapInArrow(lambda it: reply_batches(it, reply_arrow), REPLY)
    replies = materialize(replies, "replies")
    n, v = (x or 0 for x in replies.agg(F.sum("n"), F.sum("v")).first())

    def joined(which: DataFrame) -> DataFrame:
        own = replies.groupBy(F.col("block").alias("to")).agg(F.collect_list(F.struct("shard", "ones", "pairs")).alias("replies"))
        return which.join(own, F.col("block") == F.col("to")).select("doc_id", "tokens", "train", "words", "codes", "replies")

    cell_shape = "bucket long, two long, one long, tokens long"
    cell_arrow = schema(cell_shape)
    held = joined(blocks.where("held")).mapInArrow(lambda it: cell_batches(it, n, cell_arrow), cell_shape)
    cells = held.groupBy("bucket", "two", "one").agg(F.sum("tokens").alias("tokens")).toPandas().sort_values(["bucket", "two", "one"]).to_numpy()
    weights = learn_weights(cells.reshape(-1, 4), v)
    if not n:
        weights[:] = [0, 0, 1]
    out_shape = f"doc_id {id_type}, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    out_arrow = schema(out_shape)
    return joined(blocks).mapInArrow(lambda it: score_batches(it, n, v, weights, out_arrow), out_shape)
