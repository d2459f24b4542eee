"""Secret scans with one combined deterministic automaton.

All rule patterns are compiled together: Thompson construction, subset
construction over byte classes, minimisation by partition refinement, into
one transition array.  A text is scanned once, byte by byte, for all rules;
accepting states name the rules that have a match ending there.  From such
an end, the rule's reversed automaton gives the leftmost start and its own
forward automaton the longest end, so spans are leftmost, longest and
non-overlapping per rule.

No rule matches across a newline (checked when compiling), so lines are
scanned side by side: one array step advances every line of a batch by one
byte.  Documents are scanned where they are read; the automaton's size
depends on the rules alone.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from re import _constants as C
from re import _parser as parser

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from .store import broadcast
from .textops import slices, text_bytes

NEWLINE = 10


@dataclass(frozen=True)
class Rule:
    """kind, pattern (bytes, no newline), and the least length of what ``part`` leaves of a match.

    ``value``: pattern of the part before the value; the least length then
    holds for the rest of the match.
    """

    kind: str
    pattern: str
    least: int = 1
    lead: str = ""


#: The first three are the base rules, in the order of their kinds; the others are added.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""[A-Za-z_]+["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24,}", 24),
    Rule("github", r"gh[opsu]_[A-Za-z0-9]+", 40),
    Rule("google", r"AIza[A-Za-z0-9_-]+", 39),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]+", 20),
    Rule("jwt", r"eyJ[A-Za-z0-9_.-]+", 60),
    Rule("private_key", r"-----BEGIN\x20(?:RSA\x20|EC\x20|DSA\x20|OPENSSH\x20)?PRIVATE\x20KEY-----"),
)
BASE = ("assign", "access", "hex")


class Nfa:
    """Epsilon and byte-set edges; ``reverse`` compiles the mirrored pattern."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.edges: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.edges.append([])
        return len(self.eps) - 1

    def build(self, items, start: int, reverse: bool, fold: bool) -> int:
        for op, arg in reversed(list(items)) if reverse else items:
            start = self._one(op, arg, start, reverse, fold)
        return start

    def _set(self, chars: set[int], start: int) -> int:
        end = self.state()
        self.edges[start].append((frozenset(chars), end))
        return end

    def _one(self, op, arg, start: int, reverse: bool, fold: bool) -> int:
        if op is C.LITERAL:
            both = {arg, ord(chr(arg).swapcase())} if fold and chr(arg).isalpha() else {arg}
            return self._set(both, start)
        if op is C.IN:
            chars: set[int] = set()
            for kind, x in arg:
                chars |= {x} if kind is C.LITERAL else set(range(x[0], x[1] + 1))
            return self._set(chars, start)
        if op is C.SUBPATTERN:
            return self.build(arg[3], start, reverse, fold or bool(arg[1] & re.IGNORECASE))
        if op is C.BRANCH:
            end = self.state()
            for branch in arg[1]:
                begin = self.state()
                self.eps[start].append(begin)
                self.eps[self.build(branch, begin, reverse, fold)].append(end)
            return end
        if op is C.MAX_REPEAT:
            least, most, body = arg
            for _ in range(least):
                start = self.build(body, start, reverse, fold)
            if most is C.MAXREPEAT:
                loop, end = self.state(), self.state()
                self.eps[start].append(loop)
                self.eps[loop].append(end)
                self.eps[self.build(body, loop, reverse, fold)].append(loop)
                return end
            end = self.state()
            self.eps[start].append(end)
            for _ in range(most - least):
                start = self.build(body, start, reverse, fold)
                self.eps[start].append(end)
            return end
        raise ValueError(f"not supported in a rule: {op}")

    def closure(self, states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


@dataclass
class Dfa:
    """step[state, class of byte]; state 0 is the start, ``dead`` (or -1) leads nowhere; accept: bits of rules."""

    classes: np.ndarray
    step: np.ndarray
    accept: np.ndarray
    dead: int

    @classmethod
    def compile(cls, patterns: list[str], anchored: bool, reverse: bool = False) -> Dfa:
        nfa = Nfa()
        start = nfa.state()
        ends: dict[int, int] = {}
        for bit, pattern in enumerate(patterns):
            begin = nfa.state()
            nfa.eps[start].append(begin)
            ends[nfa.build(parser.parse(pattern), begin, reverse, False)] = 1 << bit
        sets = {chars for edges in nfa.edges for chars, _ in edges}
        kinds: dict[tuple, int] = {}
        classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
        sample = [int(np.flatnonzero(classes == k)[0]) for k in range(len(kinds))]
        first = nfa.closure({start})
        number, rows, order = {first: 0}, [], [first]
        for now in order:
            row = []
            for byte in sample:
                to = {t for s in now for chars, t in nfa.edges[s] if byte in chars}
                to = nfa.closure(to if anchored else to | {start})
                if to not in number:
                    number[to] = len(order)
                    order.append(to)
                row.append(number[to])
            rows.append(row)
        accept = np.array([sum(ends.get(s, 0) for s in states) for states in order], np.int64)
        return cls(classes, *cls._minimal(np.array(rows, np.int32), accept))

    @staticmethod
    def _minimal(step: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
        """Refine the partition by acceptance until every block's steps agree (Moore)."""
        block = np.unique(accept, return_inverse=True)[1]
        while True:
            finer = np.unique(np.column_stack([block, block[step]]), axis=0, return_inverse=True)[1].ravel()
            if finer.max() == block.max():
                break
            block = finer
        speaker = np.unique(block, return_index=True)[1]
        # renumber: the start first, accepting states last
        rank = np.lexsort((speaker != speaker[block[0]], accept[speaker] > 0))
        new = np.empty_like(rank)
        new[rank] = np.arange(len(rank))
        step, accept = new[block[step[speaker[rank]]]].astype(np.int32), accept[speaker[rank]]
        loops = np.flatnonzero((step == np.arange(len(step))[:, None]).all(1) & (accept == 0))
        return step, accept, int(loops[0]) if len(loops) else -1

    def longest(self, data: bytes) -> int:
        """Length of the longest prefix of ``data`` that is accepted, or -1."""
        state, best = 0, -1
        for i, b in enumerate(data, 1):
            state = self.step[state, self.classes[b]]
            if state == self.dead:
                break
            if self.accept[state]:
                best = i
        return best


@dataclass
class Scanner:
    """The combined automaton of some rules, and each rule's own two for its span."""

    rules: tuple[Rule, ...]
    both: Dfa
    forward: list[Dfa]
    backward: list[Dfa]

    @classmethod
    def compile(cls, rules: tuple[Rule, ...]) -> Scanner:
        patterns = [r.pattern for r in rules]
        both = Dfa.compile(patterns, anchored=False)
        if both.step[:, both.classes[NEWLINE]].any():
            raise ValueError("a rule matches across a newline")
        return cls(rules, both, [Dfa.compile([p], True) for p in patterns], [Dfa.compile([p], True, reverse=True) for p in patterns])

    def ends(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(line, end, rule bits) of every accepting step; lines are byte ranges of ``data``."""
        order = np.argsort(begin - stop, kind="stable")
        start, size = begin[order], (stop - begin)[order]
        coded = self.both.classes[data]
        width = self.both.step.shape[1]
        flat = (self.both.step * width).ravel()  # states are kept multiplied by the width
        accepting = int(np.argmax(self.both.accept > 0)) * width
        state = np.zeros(len(start), np.int32)
        lines, places, states = [], [], []
        done, active = 0, len(start)
        while True:
            active = int(np.searchsorted(-size[:active], -done, side="left"))
            if active < 16:
                break
            state = flat[state[:active] + coded[start[:active] + done]]
            done += 1
            if (state >= accepting).any():
                hit = np.flatnonzero(state >= accepting)
                lines.append(hit)
                places.append(start[hit] + done)
                states.append(state[hit])
        step = flat.tolist()
        for i in range(active):  # the few longest lines, one by one
            s = int(state[i])
            for at, c in enumerate(coded[start[i] + done : start[i] + size[i]].tolist(), int(start[i]) + done + 1):
                s = step[s + c]
                if s >= accepting:
                    lines.append([i])
                    places.append([at])
                    states.append([s])
        if not lines:
            return (np.zeros(0, np.int64),) * 3
        lines, places, states = (np.concatenate(x).astype(np.int64) for x in (lines, places, states))
        return order[lines], places, self.both.accept[states // width]

    def spans(self, data: np.ndarray, begin: np.ndarray, stop: np.ndarray) -> list[tuple[int, int, int]]:
        """(start, rule, end) of all kept matches in byte positions of ``data``, sorted."""
        line, place, bits = self.ends(data, begin, stop)
        found = []
        for number, rule in enumerate(self.rules):
            own = np.flatnonzero(bits >> number & 1)
            own = own[np.lexsort((place[own], line[own]))]
            until = 0  # where this rule's last match ended
            for at, end in zip(line[own].tolist(), place[own].tolist()):
                if end <= until:
                    continue
                low = max(until, int(begin[at]))
                back = self.backward[number].longest(data[low:end][::-1].tobytes())
                if back < 0:
                    continue
                first = end - back
                match = data[first : int(stop[at])].tobytes()
                match = match[: self.forward[number].longest(match)]
                until = first + len(match)
                lead = re.match(rule.lead.encode(), match).end() if rule.lead else 0
                if len(match) - lead >= rule.least:
                    found.append((first, number, until))
        return sorted(found)


def scan_batches(batches: Iterator[pa.RecordBatch], model, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    scanner: Scanner = pickle.loads(model.value)
    for batch in batches:
        for lo, n in slices(batch.column(1), 1 << 22):
            part = batch.slice(lo, n)
            data, offsets = text_bytes(part.column(1))
            breaks = np.flatnonzero(data == NEWLINE)
            begin = np.sort(np.concatenate([offsets[:-1], breaks + 1]))
            stop = np.append(begin[1:], offsets[-1])
            stop = stop - (np.isin(stop - 1, breaks) & (stop > begin))
            rows: list[list] = [[] for _ in range(n)]
            for first, number, end in scanner.spans(data, begin, stop):
                row = int(np.searchsorted(offsets, first, side="right")) - 1
                rows[row].append((first - int(offsets[row]), number, end - int(offsets[row])))
            out = []
            for row, spans in enumerate(rows):
                if spans:  # byte to code-point positions
                    own = data[offsets[row] : offsets[row + 1]]
                    points = np.concatenate([[0], np.cumsum((own & 0xC0) != 0x80)])
                    spans = [{"kind": scanner.rules[k].kind, "start": int(points[a]), "end": int(points[b])} for a, k, b in spans]
                out.append(spans)
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, schema.field("spans").type)], schema=schema)


def find_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id and spans array<struct<kind,start,end>> (code points, end exclusive, by start, then rule) per row of ``docs``.

    Null and empty texts have no spans; repeated rows are scanned each; a
    null doc_id stays null; other columns are ignored.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    spark = docs.sparkSession
    model = broadcast(spark, Scanner.compile(rules))
    shape = spark.createDataFrame([], f"doc_id {dict(docs.dtypes)['doc_id']}, spans array<struct<kind:string,start:long,end:long>>").schema
    arrow = to_arrow_schema(shape)
    return docs.select("doc_id", F.col("text").cast("string")).mapInArrow(lambda it: scan_batches(it, model, arrow), shape)


def digest(found: DataFrame) -> DataFrame:
    """Counts and digests of ``find_secrets`` rows."""
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id",
        *[count(k).alias(f"n_{k}") for k in BASE],
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
        F.size("spans").cast("long").alias("n_spans"),
    )
