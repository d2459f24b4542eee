"""Packing documents into fixed windows by the sum-of-squares rule.

Tokens come from a public tokenizer file whose path is a parameter.  Each
document (its ids, then one end id) is cut into whole windows plus a rest;
rests are placed online: of all fill levels that have an open window and
room, and of a new window, take the one that leaves the smallest sum of
squared counts of partially filled windows per level, the counts kept in a
level array (Csirik et al., "On the sum-of-squares algorithm for bin
packing"); ties go to the fullest window.

Scale: pieces are dealt evenly to blocks of about ``block_pieces`` pieces,
each an online stream of its own whose state is the level array and the
open windows, so the number of blocks grows with the input and the state of
a task does not.  The windows that a block leaves open at its end are
concatenated and cut again, so each block pads one window at most.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator
from itertools import chain, filterfalse
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import materialize
from .textops import frugal, slices

CAPACITY = 2048
END_ID = 1
BLOCK_PIECES = 8192
#: bytes of text tokenised at once
SLICE = 1 << 22
PIECE = "doc_id {id}, start long, length long, doc_tokens long, ids binary"


class TokenCache:
    """Ids of many texts at once, each distinct part encoded once while it is held, bounded.

    Texts are lower-cased and split as the tokenizer does it (``SPLIT``), all
    texts of a batch in one array of characters; equal parts are brought
    together by Arrow's dictionary encoding and their ids gathered by part
    number.  The last id of each part carries the end mark, so many new parts
    are encoded in one call and told apart by it.  Texts that normalisation
    could change in another way are encoded whole.
    """

    #: Parts that are held, and characters in them.
    BOUND = 400_000
    CHARACTERS = 1 << 24
    #: How the tokenizer file splits a lower-cased text.
    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Controls that Python counts as white space and the tokenizer does not, letters lower-cased by context, special tokens.
    ODD = ("\x1c", "\x1d", "\x1e", "\x1f", "\u0130", "\u03a3", "<|")
    SPACE, LETTER, NUMERAL, OTHER = range(4)

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, models, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        model = json.loads(self.tokenizer.to_str())["model"]
        # the same model without its own cache: every part comes once
        self.tokenizer.model = models.BPE(vocab=model["vocab"], merges=[tuple(m) for m in model["merges"]], cache_capacity=0, end_of_word_suffix=model["end_of_word_suffix"])
        # for parts that are lower-cased and split already
        self.inner = Tokenizer(self.tokenizer.model)
        self.inner.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True
        self.kinds = np.full(0x110000, self.OTHER, np.uint8)
        # all characters but the surrogates, which no text holds
        characters = "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))
        for kind, pattern in ((self.SPACE, r"\s+"), (self.LETTER, r"\p{L}+"), (self.NUMERAL, r"\p{N}+")):
            for run in regex.finditer(pattern, characters):
                low, high = (x + 0x800 if x >= 0xD800 else x for x in run.span())
                self.kinds[low:high] = kind
        self.clear()

    def clear(self) -> None:
        self.numbers: dict[str, int] = {}
        self.characters = 0
        self.ids, self.first = np.zeros(1 << 16, "<u4"), np.zeros(self.BOUND + 1, np.int64)

    def encode(self, text: str, inner: bool = False) -> np.ndarray:
        tokenizer = self.inner if inner else self.tokenizer
        return np.array(tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")

    def splits(self, text: str) -> bool:
        """Whether lower-casing and splitting is all that the tokenizer does to a text."""
        return (text.isascii() or is_normalized("NFC", text)) and not any(x in text for x in self.ODD)

    def texts(self, texts: list[str]) -> list[bytes]:
        """Ids of each text."""
        plain = [self.splits(t) for t in texts]
        ids, stops = self.plain_ids([t.lower() for t, ok in zip(texts, plain) if ok])
        blob, edges, out = ids.tobytes(), iter(zip([0, *(stops * 4).tolist()], (stops * 4).tolist())), []
        for text, ok in zip(texts, plain):
            if ok:
                low, high = next(edges)
                out.append(blob[low:high])
            else:
                out.append(self.encode(text).tobytes())
        return out

    def plain_ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all lower-cased texts, and where those of each text stop."""
        joined = " ".join(texts) + " "
        points = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kinds = self.kinds[points]
        begins = self.begins(points, kinds)
        solid = kinds != self.SPACE
        parts = self.part_array(joined, points, solid, begins)
        # parts whose first character comes before the blank after a text
        until = np.searchsorted(begins, np.cumsum([len(t) + 1 for t in texts], dtype=np.int64))
        coded = parts.dictionary_encode()
        known = self.known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())[coded.indices.to_numpy()]
        lo, n = self.first[known], self.first[known + 1] - self.first[known]
        stops = np.concatenate([[0], np.cumsum(n)])
        ids = self.ids[np.arange(stops[-1]) + np.repeat(lo - stops[:-1], n)]
        return ids, stops[until]

    def begins(self, points: np.ndarray, kinds: np.ndarray) -> np.ndarray:
        """Where parts begin: at a change of kind, at each numeral, behind a short form."""
        new = np.empty(len(kinds), bool)
        new[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=new[1:])
        mark = np.flatnonzero(points == ord("'"))
        # an apostrophe alone in its run, before letters, takes the letters of a short form
        mark = mark[new[mark] & (kinds[mark + 1] == self.LETTER)]
        next_, after = points[mark + 1], points[np.minimum(mark + 2, len(points) - 1)]
        is_ = lambda x, letters: np.isin(x, [ord(c) for c in letters])
        one = is_(next_, "stmd")
        two = (is_(next_, "rv") & is_(after, "e")) | (is_(next_, "l") & is_(after, "l"))
        short = mark[one | two]
        stop = short + np.where(one[one | two], 2, 3)
        new |= kinds == self.NUMERAL
        new[short + 1] = False
        new[stop] = True
        return np.flatnonzero(new & (kinds != self.SPACE))

    @staticmethod
    def part_array(joined: str, points: np.ndarray, solid: np.ndarray, begins: np.ndarray) -> pa.Array:
        """The parts, which are what is left between white space, end to end."""
        raw = np.frombuffer(joined.encode(), np.uint8)
        before = np.zeros(len(points) + 1, np.int64)
        if len(raw) == len(points):
            np.cumsum(solid, out=before[1:])
            raw = raw[solid]
        else:
            width = np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000)
            np.cumsum(width * solid, out=before[1:])
            raw = raw[np.repeat(solid, width)]
        offsets = np.append(before[begins], len(raw)).astype(np.int32)
        return pa.StringArray.from_buffers(len(begins), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw)))

    def known(self, parts: list[str]) -> np.ndarray:
        """The number of each part, new ones encoded."""
        if len(self.numbers) + len(parts) > self.BOUND or self.characters > self.CHARACTERS:
            self.clear()
            if len(parts) > self.BOUND:
                self.first = np.zeros(len(parts) + 1, np.int64)
        new = list(filterfalse(self.numbers.__contains__, parts))
        for lo in range(0, len(new), 8192):
            self.encode_parts(new[lo : lo + 8192])
        return np.fromiter(map(self.numbers.__getitem__, parts), np.int64, len(parts))

    def encode_parts(self, parts: list[str]) -> None:
        joined = " ".join(parts)
        ids = self.encode(joined, True)
        stops = np.flatnonzero(self.ends[ids]) + 1
        if len(stops) != len(parts):
            own = [self.encode(part, True) for part in parts]
            ids, stops = np.concatenate(own), np.cumsum([len(x) for x in own])
        count = len(self.numbers)
        used = self.first[count]
        while used + len(ids) > len(self.ids):
            self.ids = np.concatenate([self.ids, np.zeros_like(self.ids)])
        self.ids[used : used + len(ids)] = ids
        self.first[count + 1 : count + 1 + len(parts)] = used + stops
        self.characters += len(joined)
        self.numbers.update(zip(parts, range(count, count + len(parts))))


def worker_cache(path: str) -> TokenCache:
    """The cache of this Python worker, which serves one task after another; its bounds keep it small."""
    import sys
    from types import ModuleType

    held = vars(sys.modules.setdefault("_llm_token_caches", ModuleType("_llm_token_caches")))
    if path not in held:
        held[path] = TokenCache(path)
    return held[path]


@frugal
def tokenize_pieces(batches: Iterator[pa.RecordBatch], path: str, capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Whole windows and the rest of each document, with their ids."""
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    cache = worker_cache(path)
    end = np.array([END_ID], "<u4").tobytes()
    for batch in batches:
        for lo, size in slices(batch.column(1), SLICE):
            part = batch.slice(lo, size)
            ids, start, length, total, row = [], [], [], [], []
            for i, blob in enumerate(cache.texts([t or "" for t in part.column(1).to_pylist()])):
                blob += end
                n = len(blob) // 4
                for a in range(0, n, capacity):
                    row.append(i)
                    start.append(a)
                    length.append(min(capacity, n - a))
                    total.append(n)
                    ids.append(blob[4 * a : 4 * (a + capacity)])
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row, pa.int32())), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(total, pa.int64()), pa.array(ids, pa.binary())], schema=schema)


class SumOfSquares:
    """Level array of open windows; ``place`` returns the window for a size and its offset."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.levels = np.zeros(capacity + 1, np.int64)
        self.open: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.made = 0

    def place(self, size: int) -> tuple[int, int, bool]:
        """(window, offset, whether it is full now)."""
        full, n = self.capacity, self.levels
        if size >= full:
            self.made += 1
            return self.made - 1, 0, True
        best, level = 2 * n[size] + 1, 0
        here = n[1 : full - size]
        if len(here):
            gain = np.where(here > 0, n[1 + size : full] - here, full << 20)
            at = len(gain) - 1 - int(np.argmin(gain[::-1]))
            if 2 * gain[at] + 2 <= best:
                best, level = 2 * gain[at] + 2, at + 1
        if n[full - size] and 1 - 2 * n[full - size] <= best:
            level = full - size
        if level:
            window = self.open[level].pop()
            n[level] -= 1
        else:
            window, self.made = self.made, self.made + 1
        if level + size < full:
            self.open[level + size].append(window)
            n[level + size] += 1
        return window, level, level + size == full


@frugal
def pack_blocks(batches: Iterator[pa.RecordBatch], capacity: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by block; each block is packed as one online stream."""
    out: list[tuple] = []
    block, rule, held = None, None, {}

    def flush():
        rows = [piece for window in sorted(held) for piece in held[window]]
        held.clear()
        window, offset = rule.made, 0
        for doc, start, length, total, ids in rows:
            while length:
                take = min(length, capacity - offset)
                out.append((doc, start, take, zlib.crc32(ids[: 4 * take]), total, (block << 32) + window, offset))
                start, length, ids, offset = start + take, length - take, ids[4 * take :], offset + take
                if offset == capacity:
                    window, offset = window + 1, 0

    def emit():
        cols = list(zip(*out)) if out else [[]] * len(schema)
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema)], schema=schema)

    for batch in batches:
        for b, doc, start, length, total, ids in zip(*(c.to_pylist() for c in batch.columns)):
            if b != block:
                if rule:
                    flush()
                block, rule = b, SumOfSquares(capacity)
            window, offset, full = rule.place(length)
            held.setdefault(window, []).append((doc, start, length, total, ids))
            if full:
                offset = 0
                for d, s, n, t, x in held.pop(window):
                    out.append((d, s, n, zlib.crc32(x), t, (block << 32) + window, offset))
                    offset += n
        if len(out) >= 4096:
            yield emit()
    if rule:
        flush()
    yield emit()


def pack(docs: DataFrame, tokenizer: str, capacity: int = CAPACITY, block_pieces: int = BLOCK_PIECES) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text) and their places in sequences.

    Returns one row per piece: doc_id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset.  Null text is empty (its end id alone is packed);
    repeated rows are documents of their own; a null doc_id stays null; other
    columns are ignored; an empty table gives no row.
    """
    id_type = dict(docs.dtypes)["doc_id"]
    spark = docs.sparkSession
    from pyspark.sql.pandas.types import to_arrow_schema

    shape = spark.createDataFrame([], PIECE.format(id=id_type)).schema
    arrow = to_arrow_schema(shape)
    pieces = docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: tokenize_pieces(it, tokenizer, capacity, arrow), shape)
    pieces = materialize(pieces.withColumn("no", F.monotonically_increasing_id()), "pieces")
    blocks = max(1, -(-pieces.count() // block_pieces))
    result = spark.createDataFrame([], f"doc_id {id_type}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long").schema
    out = to_arrow_schema(result)
    return (
        pieces.withColumn("block", F.pmod(F.xxhash64("no"), F.lit(blocks)))
        .repartition(blocks, "block")
        .sortWithinPartitions("block", "doc_id", "start", "no")
        .select("block", "doc_id", "start", "length", "doc_tokens", "ids")
        .mapInArrow(lambda it: pack_blocks(it, capacity, out), result)
    )
