"""Benchmark decontamination with a generalised suffix automaton.

The normalised words of all benchmark items form one suffix automaton
(Blumer et al.).  Documents are streamed through it word by word, tracking
the longest suffix of what was read that occurs in an item; a length of at
least ``span`` words marks the last ``span`` words as hit.  Items shorter
than ``span`` count as whole.  Documents are scanned where they are read,
with no shuffle.

Scale: an automaton holds at most ``max_words`` item words, which bounds
what is broadcast; a larger benchmark is dealt to several automata, and the
documents pass through one after another, each pass written to the shared
folder.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import broadcast, materialize, set_aside
from .textops import Words, frugal, slices, word_table

SPAN = 10
MAX_WORDS = 1_000_000
MAX_COVERAGE = 0.5


def word_byte(b: int) -> bool:
    """Digits, lower-cased letters and everything outside ASCII."""
    return 48 <= b < 58 or 65 <= b < 91 or 97 <= b < 123 or b > 127


@dataclass
class Automaton:
    """Suffix automaton over several word sequences.

    step[s]: word -> state; link, size: suffix link and longest length;
    owners[s]: items in which the state's strings occur; short[s]: (length,
    item) of items shorter than ``span`` that end in s.
    """

    span: int
    step: list[dict] = field(default_factory=lambda: [{}])
    link: list[int] = field(default_factory=lambda: [-1])
    size: list[int] = field(default_factory=lambda: [0])
    owners: list[set] = field(default_factory=lambda: [set()])
    short: dict = field(default_factory=dict)

    def _state(self, size: int, step: dict, link: int, owners: set) -> int:
        self.step.append(step)
        self.link.append(link)
        self.size.append(size)
        self.owners.append(owners)
        return len(self.step) - 1

    def _split(self, p: int, q: int, word: int) -> int:
        """State for the strings of q that are at most size[p]+1 long."""
        clone = self._state(self.size[p] + 1, dict(self.step[q]), self.link[q], set())
        self.link[q] = clone
        while p >= 0 and self.step[p].get(word) == q:
            self.step[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: int) -> int:
        q = self.step[last].get(word)
        if q is not None:
            return q if self.size[q] == self.size[last] + 1 else self._split(last, q, word)
        state = self._state(self.size[last] + 1, {}, 0, set())
        p = last
        while p >= 0 and word not in self.step[p]:
            self.step[p][word] = state
            p = self.link[p]
        if p >= 0:
            q = self.step[p][word]
            self.link[state] = q if self.size[q] == self.size[p] + 1 else self._split(p, q, word)
        return state

    def add(self, words: list[int], item: int) -> None:
        last = 0
        for word in words:
            last = self._extend(last, word)
            self.owners[last].add(item)
        if 0 < len(words) < self.span:
            self.short.setdefault(last, []).append((len(words), item))

    def freeze(self, items: list[list[int]]) -> None:
        """Spread owners up the links, and find each state's ancestors of interest."""
        ends: dict[int, list] = {}  # where splits may have moved short items: walk them again
        for i, words in enumerate(items):
            if 0 < len(words) < self.span:
                s = 0
                for w in words:
                    s = self.step[s][w]
                ends.setdefault(s, []).append((len(words), i))
        self.short = ends
        order = sorted(range(1, len(self.step)), key=self.size.__getitem__)
        for s in reversed(order):
            if self.size[s] >= self.span and self.size[self.link[s]] >= self.span:
                self.owners[self.link[s]] |= self.owners[s]
        self.window = [0] * len(self.step)  # the ancestor that holds the last ``span`` words
        self.above = [-1] * len(self.step)  # the nearest ancestor in which a short item ends
        for s in order:
            up = self.link[s]
            self.window[s] = self.window[up] if self.size[up] >= self.span else s
            self.above[s] = up if up in ends else self.above[up]
        self.owners = [tuple(x) if self.size[s] >= self.span else () for s, x in enumerate(self.owners)]

    def scan(self, words: list[int]) -> tuple[list[tuple[int, int]], set[int]]:
        """Hit ranges of a run of known words, and the items with an occurring window."""
        step, link, size, span = self.step, self.link, self.size, self.span
        state = length = 0
        ranges, found = [], set()
        for i, w in enumerate(words, 1):
            while w not in step[state] and state:
                state = link[state]
                length = size[state]
            state = step[state].get(w, 0)
            length = length + 1 if state else 0
            if length >= span:
                ranges.append((i - span, i))
                found.update(self.owners[self.window[state]])
            if self.short:
                s = state if state in self.short else self.above[state]
                while s > 0:
                    for n, item in self.short[s]:
                        if n <= length:
                            ranges.append((i - n, i))
                            found.add(item)
                    s = self.above[s]
        return ranges, found


def build(items: list[tuple[str, list[int]]], span: int):
    """(names, sorted vocabulary, automaton, shortest window) of (name, word fingerprints)."""
    vocabulary = np.unique(np.array([w for _, ws in items for w in ws], np.uint64))
    coded = [np.searchsorted(vocabulary, np.array(ws, np.uint64)).tolist() for _, ws in items]
    auto = Automaton(span)
    for i, ws in enumerate(coded):
        auto.add(ws, i)
    auto.freeze(coded)
    return [n for n, _ in items], vocabulary, auto, min([span, *(len(ws) for ws in coded if ws)])


@frugal
def scan_batches(batches: Iterator[pa.RecordBatch], model, text_at: int, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Append this automaton's hit ranges (merged word ranges) and items to the columns hit and items."""
    names, vocabulary, auto, least = pickle.loads(model.value)
    table = word_table(word_byte, fold_case=True)
    for batch in batches:
        for lo, n in slices(batch.column(text_at)):
            part = batch.slice(lo, n)
            words = Words.of(part.column(text_at), table)
            hashes = words.hashes()
            code = np.minimum(np.searchsorted(vocabulary, hashes), max(0, len(vocabulary) - 1))
            known = vocabulary[code] == hashes if len(vocabulary) else np.zeros(len(hashes), bool)
            bounded = np.concatenate([[False], known, [False]])
            edge = np.diff(bounded.astype(np.int8))
            runs = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)], 1)
            runs = runs[runs[:, 1] - runs[:, 0] >= least]  # a run may pass a row's end: cut below
            hits = [[] for _ in range(n)]
            items = [set() for _ in range(n)]
            for a, b in runs.tolist():
                row = int(np.searchsorted(words.first, a, side="right")) - 1
                while a < b:
                    stop = min(b, int(words.first[row + 1]))
                    if stop - a >= least:
                        ranges, found = auto.scan(code[a:stop].tolist())
                        base = a - int(words.first[row])
                        hits[row] += [(x + base, y + base) for x, y in ranges]
                        items[row] |= found
                    a, row = stop, row + 1
            old_hits, old_items = part.column("hit").to_pylist(), part.column("items").to_pylist()
            merged = [merge([*((h["start"], h["end"]) for h in old), *new]) for old, new in zip(old_hits, hits)]
            columns = {
                "n_words": pa.array(np.diff(words.first), pa.int64()),
                "hit": pa.array([[{"start": x, "end": y} for x, y in r] for r in merged], schema.field("hit").type),
                "items": pa.array([[*old, *(names[i] for i in new)] for old, new in zip(old_items, items)], schema.field("items").type),
            }
            yield pa.RecordBatch.from_arrays([columns.get(f.name, part.column(f.name) if f.name in part.schema.names else None) for f in schema], schema=schema)


def merge(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


@frugal
def fingerprints(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """(item, word fingerprints) of each benchmark item."""
    table = word_table(word_byte, fold_case=True)
    for batch in batches:
        words = Words.of(batch.column(1), table)
        codes = pa.array(words.hashes().view(np.int64))
        yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.string()), pa.ListArray.from_arrays(pa.array(words.first.astype(np.int32)), codes)], schema=schema)


def find_hits(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, max_words: int = MAX_WORDS) -> DataFrame:
    """``docs`` (with text) plus n_words long, hit array<struct<start,end>> (word ranges) and items array<string>.

    Lower-cases A-Z; words are runs of digits, letters a-z and non-ASCII.
    Null or empty text has no words and no hits; null items have no words;
    repeated items count once per item id; a null item id is named "null";
    an empty benchmark hits nothing.  Input columns called n_words, hit or
    items are replaced.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    shape = "item string, words array<bigint>"
    arrow = to_arrow_schema(spark.createDataFrame([], shape).schema)
    source = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")), F.col("text").cast("string"))
    items = materialize(source.mapInArrow(lambda it: fingerprints(it, arrow), shape), "items")
    total = items.agg(F.sum(F.size("words"))).first()[0] or 0
    parts = max(1, -(-total // max_words))
    docs = docs.drop("n_words", "hit", "items")
    out = docs.withColumns({"n_words": F.lit(0).cast("long"), "hit": F.expr("cast(array() as array<struct<start:bigint,end:bigint>>)"), "items": F.expr("cast(array() as array<string>)")})
    schema = out.schema
    arrow_out = to_arrow_schema(schema)
    for part in range(parts):
        own = items.where(F.pmod(F.xxhash64("item", "words"), F.lit(parts)) == part).orderBy("item", "words")
        model = broadcast(spark, build([(r.item, [w % (1 << 64) for w in r.words]) for r in own.toLocalIterator()], span))
        at = out.columns.index("text")
        out = out.mapInArrow(lambda it, m=model, i=at: scan_batches(it, m, i, arrow_out), schema)
        if part + 1 < parts:
            out = materialize(out, f"hits-{part}")
    return out


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of ``find_hits`` rows."""
    items = F.array_sort(F.array_distinct("items"))
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    return found.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size(items).cast("long").alias("n_items"),
        F.sha2(F.array_join(items, ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


@frugal
def cut_batches(batches: Iterator[pa.RecordBatch], text_at: int, hit_at: int, keep: list[int], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    table = word_table(word_byte, fold_case=True)
    for batch in batches:
        for lo, n in slices(batch.column(text_at)):
            part = batch.slice(lo, n)
            hits = part.column(hit_at).to_pylist()
            texts = part.column(text_at).to_pylist()
            words = Words.of(part.column(text_at), table)
            for row, ranges in enumerate(hits):
                if ranges:
                    whole, base, first = texts[row].encode(), int(words.offsets[row]), int(words.first[row])
                    kept, at = [], 0
                    for r in ranges:
                        kept.append(whole[at : int(words.start[first + r["start"]]) - base])
                        at = int(words.end[first + r["end"] - 1]) - base
                    texts[row] = b"".join([*kept, whole[at:]]).decode()
            columns = [pa.array(texts, pa.string()) if i == text_at else part.column(i) for i in keep]
            yield pa.RecordBatch.from_arrays(columns, schema=schema)


def decontaminate(docs: DataFrame, benchmark: DataFrame, span: int = SPAN, max_coverage: float = MAX_COVERAGE) -> DataFrame:
    """``docs`` without contaminated spans, and without documents of which more than ``max_coverage`` is hit.

    Same columns, whatever they are called; other rows stay as they are.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    docs, back = set_aside(docs, ("doc_id", "text"))
    found = find_hits(docs, benchmark, span)
    n_hit = F.aggregate("hit", F.lit(0).cast("long"), lambda n, r: n + r["end"] - r["start"])
    found = found.where(n_hit <= max_coverage * F.col("n_words"))
    names = found.columns
    keep = [names.index(c) for c in docs.columns]
    arrow = to_arrow_schema(docs.schema)
    return found.mapInArrow(lambda it: cut_batches(it, names.index("text"), names.index("hit"), keep, arrow), docs.schema).select(*back)
