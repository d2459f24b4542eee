"""Merkle manifest of a table: leaf coordinates by bitmap rank, levels by keyed slot arrays.

Every row is a leaf, the SHA-256 of its fields; the leaves of a group (one
language) ascend by doc_id and every eight become the node above.

Coordinates.  doc_ids of a group become bitmap words of 64 ids, merged by
bitwise or; only words with an id exist.  A popcount directory holds the
number of rows before each word.  The place of a row is then its word's
entry plus the bits below its own: the rows themselves are never sorted.
Rows that share a doc_id, which a bitmap cannot tell apart, and rows without
one are counted by (doc_id, leaf) and placed through the same directory;
rows that are wholly equal are counted, not moved.

Levels.  The leaves of a block of 8^4 places go to one task as an array of
slots keyed by place and are reduced four levels at once; the blocks' nodes
are the slots of the next round, so a group of n leaves takes log n / log
4096 shuffles and no task holds more than a block.  Siblings come back down
the same rounds: a block gets the path above it and hands each slot its own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame
from pyspark.sql.pandas.types import to_arrow_schema

from .store import materialize

FAN = 8
#: Levels that one task reduces, and the slots of its block.
LEVELS = 4
SLOTS = FAN**LEVELS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*fields: Column) -> Column:
    """Lowercase hex SHA-256 of the fields, each ``-`` if null, else its UTF-8 byte count, a colon and the value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)).cast("binary"), 256)


def lower_ascii(text: Column) -> Column:
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def height(n: int) -> int:
    """Levels above n nodes."""
    levels = 0
    while n > 1:
        n, levels = -(-n // FAN), levels + 1
    return levels


def counted_before(df: DataFrame, order: list[str], count: str, name: str) -> DataFrame:
    """``df`` with ``before``, the sum of ``count`` over the rows earlier in ``order`` (nulls first).

    Rows are dealt to ranges of the order; a task adds up its own range and
    the sums of the ranges, one number each, are added up once more.
    """
    spread = df.repartitionByRange(*(F.col(c).asc_nulls_first() for c in order)).sortWithinPartitions(*(F.col(c).asc_nulls_first() for c in order))
    schema = df.selectExpr("*", "0 as _range", "0L as _own").schema
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        at, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            own = batch.column(batch.schema.get_field_index(count)).to_numpy(zero_copy_only=False)
            ends = total + np.cumsum(own)
            columns = [*batch.columns, pa.array(np.full(batch.num_rows, at), pa.int32()), pa.array(ends - own, pa.int64())]
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    ranked = materialize(spread.mapInArrow(run, schema), name)
    sums = ranked.groupBy("_range").agg(F.sum(count).alias("_sum"))
    # one row per range
    offsets = sums.selectExpr("_range as _at", "sum(_sum) over (order by _range) - _sum as _offset")
    return ranked.join(F.broadcast(offsets), F.col("_range") == F.col("_at")).select(*df.columns, (F.col("_own") + F.col("_offset")).alias("before"))


def leaves(docs: DataFrame, fields=FIELDS, group: str = "lang", row_id: str = "doc_id", text: str = "text") -> DataFrame:
    """id, g, leaf, changed: the leaf of every row, and that of the row with its text lower-cased where 3 divides the CRC-32 of its id."""
    rid = F.col(row_id).cast("long")
    tampered = F.crc32(F.col(row_id).cast("string").cast("binary")) % 3 == 0
    other = [lower_ascii(F.col(f)) if f == text else F.col(f) for f in fields]
    # "-" for null sorts before "=" of every name, and names stay in the order of their bytes
    g = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    return docs.select(rid.alias("id"), g.alias("g"), F.unhex(digest(*(F.col(f) for f in fields))).alias("leaf"), F.when(tampered, F.unhex(digest(*other))).alias("changed"))


def coordinates(rows: DataFrame) -> DataFrame:
    """``rows`` (id, g, leaf, changed) with place, its rank by (id, leaf) in its group from 0, nulls first, and n, the group's size."""
    word = F.shiftright("id", 6)
    words = rows.select("g", word.alias("word"), F.expr("shiftleft(1L, cast(id & 63 as int))").alias("bit")).groupBy("g", "word").agg(F.bit_or("bit").alias("bits"), F.count("*").alias("rows"))
    directory = counted_before(words, ["g", "word"], "rows", "directory")
    groups = directory.groupBy(F.col("g").alias("of")).agg(F.min("before").alias("start"), F.sum("rows").alias("n"))
    ranks = directory.join(groups, F.col("g") == F.col("of")).select(F.col("g").alias("rg"), F.col("word").alias("rw"), "bits", (F.col("rows") == F.bit_count("bits")).alias("single"), (F.col("before") - F.col("start")).alias("base"), "n")
    below = F.expr("bit_count(bits & ~shiftleft(-1L, cast(id & 63 as int)))")
    found = rows.withColumn("word", word).join(ranks, (F.col("g") == F.col("rg")) & F.col("word").eqNullSafe(F.col("rw")))
    found = materialize(found.select("g", "word", "id", "leaf", "changed", "n", "base", F.when(F.col("single"), F.col("base") + below).alias("place")), "places")
    shape = ["g", "id", "leaf", "changed", "n", "place"]
    shared = found.where("place is null").groupBy("g", "word", "id", "leaf", "changed", "n", "base").agg(F.count("*").alias("copies"))
    if found.where("place is null").isEmpty():
        return found.select(*shape)
    counted = counted_before(shared, ["g", "word", "id", "leaf"], "copies", "shared")
    first = counted.groupBy(F.col("g").alias("fg"), F.col("word").alias("fw")).agg(F.min("before").alias("first"))
    spread = counted.join(first, (F.col("g") == F.col("fg")) & F.col("word").eqNullSafe(F.col("fw"))).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("i"))
    spread = spread.withColumn("place", F.col("base") + F.col("before") - F.col("first") + F.col("i"))
    return found.where("place is not null").select(*shape).unionAll(spread.select(*shape))


def node(children: list[bytes]) -> bytes:
    return hashlib.sha256(b"".join(children)).hexdigest().encode()


def tiers(table: pa.Table) -> list[list[bytes]]:
    """Nodes of a block (slot, hash, n), level by level up to its single top."""
    slots: list = [b""] * table.num_rows
    for slot, h in zip(table.column("slot").to_pylist(), table.column("hash").to_pylist()):
        slots[slot] = h.hex().encode()
    out = [slots]
    for _ in range(min(LEVELS, height(table.column("n")[0].as_py()))):
        last = out[-1]
        out.append([node(last[i : i + FAN]) for i in range(0, len(last), FAN)])
    return out


def paths_below(levels: list[list[bytes]], above: tuple[bytes, ...]) -> list[tuple[bytes, ...]]:
    """Siblings of every slot (left, right, level by level up to the root) from those of the block's top."""
    paths = [above]
    for tier in reversed(levels[:-1]):
        below = []
        for i in range(len(tier)):
            run = i - i % FAN
            below.append((b"".join(tier[run:i]), b"".join(tier[i + 1 : run + FAN]), *paths[i // FAN]))
        paths = below
    return paths


def fold(h: bytes, path: tuple[bytes, ...]) -> bytes:
    """The root that a leaf and its siblings give."""
    for i in range(0, len(path), 2):
        h = hashlib.sha256(path[i] + h + path[i + 1]).hexdigest().encode()
    return h


def _blocks(nodes: DataFrame) -> DataFrame:
    return nodes.withColumns({"block": F.shiftright("place", 3 * LEVELS), "slot": (F.col("place") % SLOTS).cast("int")})


def ascend(nodes: DataFrame) -> list[DataFrame]:
    """Rounds of (g, place, hash, n), from ``nodes`` up to one node per group."""

    def reduce(table: pa.Table) -> pa.Table:
        top = tiers(table)[-1][0]
        n = -(-table.column("n")[0].as_py() // SLOTS)
        return pa.table({"g": [table.column("g")[0].as_py()], "place": pa.array([table.column("block")[0].as_py()], pa.int64()), "hash": [bytes.fromhex(top.decode())], "n": pa.array([n], pa.int64())})

    rounds = [nodes]
    while (rounds[-1].agg(F.max("n")).first()[0] or 0) > 1:
        blocks = _blocks(rounds[-1].select("g", "place", "hash", "n")).select("g", "block", "slot", "hash", "n")
        rounds.append(materialize(blocks.groupBy("g", "block").applyInArrow(reduce, "g string, place long, hash binary, n long"), "nodes"))
    return rounds


def descend(rounds: list[DataFrame], paths: DataFrame, emit, shape: str, keep: list[str]) -> DataFrame:
    """``emit`` over the blocks of the lowest round; paths: (g, place, path, subroot) of the top round's nodes."""
    path_shape = "g string, place long, path array<binary>, subroot string"

    def hand_down(nodes: pa.Table, above: pa.Table) -> pa.Table:
        place = nodes.column("block")[0].as_py() * SLOTS
        down = paths_below(tiers(nodes), tuple(above.column("path")[0].as_py()))
        m = len(down)
        return pa.table({"g": nodes.column("g").slice(0, 1).take([0] * m), "place": pa.array(range(place, place + m), pa.int64()), "path": pa.array([list(p) for p in down], pa.list_(pa.binary())), "subroot": above.column("subroot").slice(0, 1).take([0] * m)})

    for level in reversed(range(len(rounds) - 1)):
        lowest = level == 0
        children = _blocks(rounds[level]).select("g", "block", "slot", "hash", "n", *(keep if lowest else []))
        above = paths.withColumnRenamed("place", "block")
        met = children.groupBy("g", "block").cogroup(above.groupBy("g", "block"))
        if lowest:
            return met.applyInArrow(emit, shape)
        paths = materialize(met.applyInArrow(hand_down, path_shape), "paths")
    # every group is a single leaf
    children = rounds[0].select(F.col("g").alias("cg"), "hash", "n", F.lit(0).cast("long").alias("block"), F.lit(0).alias("slot"), *keep)
    met = children.withColumnRenamed("cg", "g").groupBy("g", "block").cogroup(paths.withColumnRenamed("place", "block").groupBy("g", "block"))
    return met.applyInArrow(emit, shape)


def manifest(docs: DataFrame, fields=FIELDS, group: str = "lang", row_id: str = "doc_id", text: str = "text", proofs: bool = False) -> DataFrame:
    """One row per row of ``docs``: doc_id, lang, place, leaf, subroot, root, proof_sha256, folded_root, verified, and with ``proofs`` the proof itself.

    Digests are lowercase hex.  place: the leaf's place in its group from 0,
    by doc_id, then leaf; rows without doc_id come first, and wholly equal
    rows take consecutive places.  A null group is a group of its own and
    the first.  proof: for each level up to the root the siblings left and
    right of the node, joined.  folded_root: the root that the leaf, with
    the text's A-Z lower-cased where 3 divides the unsigned CRC-32 of the
    decimal doc_id, gives with those siblings; verified: it equals the root.
    Ids are integers; empty texts and null fields are part of the leaf; other
    columns are ignored, whatever their names; an empty table gives no row.
    """
    spark = docs.sparkSession
    rows = materialize(leaves(docs, fields, group, row_id, text), "leaves")
    shape = f"{row_id} long, {group} string, place long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean, proof array<string>"
    columns = [c.strip().split()[0] for c in shape.split(",")][: None if proofs else -1]
    if rows.isEmpty():
        return spark.createDataFrame([], shape).select(*columns)
    placed = coordinates(rows).withColumnRenamed("leaf", "hash")
    rounds = ascend(placed)
    tops = rounds[-1].select("g", F.col("hash").alias("subroot"), F.lit(1).cast("long").alias("one"))
    tops = counted_before(tops, ["g"], "one", "subroots")
    groups = tops.count()
    upper = ascend(tops.select(F.lit("").alias("g"), F.col("before").alias("place"), F.col("subroot").alias("hash"), F.lit(groups).cast("long").alias("n"), F.col("g").alias("name")))
    root = upper[-1].first()["hash"].hex()
    start = spark.createDataFrame([("", 0, [], "")], "g string, place long, path array<binary>, subroot string")

    def name_paths(nodes: pa.Table, above: pa.Table) -> pa.Table:
        found = paths_below(tiers(nodes), tuple(above.column("path")[0].as_py()))
        slots = nodes.column("slot").to_pylist()
        return pa.table({"g": nodes.column("name"), "place": pa.array([0] * len(slots), pa.int64()), "path": pa.array([list(found[s]) for s in slots], pa.list_(pa.binary())), "subroot": [h.hex() for h in nodes.column("hash").to_pylist()]})

    paths = materialize(descend(upper, start, name_paths, "g string, place long, path array<binary>, subroot string", ["name"]), "paths")
    arrow = to_arrow_schema(spark.createDataFrame([], shape).schema)

    def prove(nodes: pa.Table, above: pa.Table) -> pa.Table:
        found = paths_below(tiers(nodes), tuple(above.column("path")[0].as_py()))
        out: dict[str, list] = {name: [] for name in arrow.names}
        g, subroot = nodes.column("g")[0].as_py(), above.column("subroot")[0].as_py()
        first = nodes.column("block")[0].as_py() * SLOTS
        for rid, slot, h, changed in zip(*(nodes.column(c).to_pylist() for c in ("id", "slot", "hash", "changed"))):
            path = found[slot]
            folded = fold((h if changed is None else changed).hex().encode(), path).decode()
            values = (rid, g[1:] if g[0] == "=" else None, first + slot, h.hex(), subroot, root, hashlib.sha256(b"".join(path)).hexdigest(), folded, folded == root, [p.decode() for p in path] if proofs else None)
            for name, v in zip(arrow.names, values):
                out[name].append(v)
        return pa.table([pa.array(out[f.name], f.type) for f in arrow], schema=arrow)

    return descend(rounds, paths, prove, shape, ["id", "changed"]).select(*columns)
