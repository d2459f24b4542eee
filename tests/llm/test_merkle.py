"""Merkle manifest against trees built in plain Python."""

import hashlib
import random
import re
import zlib

import pytest

from flowmetrics.llm import merkle

COLUMNS = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def leaf_of(row):
    return h("".join("-" if row[f] is None else f"{len(str(row[f]).encode())}:{row[f]}" for f in merkle.FIELDS))


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h("".join(levels[-1][i : i + 8])) for i in range(0, len(levels[-1]), 8)])
    return levels


def siblings(levels, i):
    out = []
    for tier in levels[:-1]:
        run = i - i % 8
        out.append(("".join(tier[run:i]), "".join(tier[i + 1 : run + 8])))
        i //= 8
    return out


def brute(rows):
    langs = sorted({r["lang"] for r in rows}, key=lambda lang: (lang is not None, (lang or "").encode()))
    groups = [sorted(((r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r), r) for r in rows if r["lang"] == lang), key=lambda t: t[:3]) for lang in langs]
    trees = [tree([t[2] for t in group]) for group in groups]
    top = tree([t[-1][0] for t in trees])
    out = []
    for k, group in enumerate(groups):
        for i, (_, _, leaf, row) in enumerate(group):
            path = siblings(trees[k], i) + siblings(top, k)
            folded = leaf
            if row["doc_id"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 3 == 0:
                folded = leaf_of({**row, "text": row["text"] and re.sub("[A-Z]", lambda m: m[0].lower(), row["text"])})
            for left, right in path:
                folded = h(left + folded + right)
            out.append((row["doc_id"], leaf, trees[k][-1][0], top[-1][0], h("".join(a + b for a, b in path)), folded, folded == top[-1][0]))
    return sorted(out, key=str)


def found(docs):
    return sorted((tuple(r) for r in merkle.manifest(docs).select(*COLUMNS).collect()), key=str)


def test_odd_rows(docs):
    assert found(docs) == brute([r.asDict() for r in docs.collect()])


def test_deep_tree_shared_and_extreme_ids(spark):
    rng = random.Random(3)
    ids = [None, 5, 5, -3, 70, 2**62, -(2**63), 2**63 - 1, *range(-5, 90)]
    rows = [(rng.choice(ids), rng.choice("ab"), rng.choice([None, "", "en", "é"]), rng.choice([None, 3]), rng.choice(["T", None, "", "AbC é"])) for _ in range(300)]
    rows += [(1000 + i, "s", "big", 1, "tA" * (i % 5)) for i in range(4099)] + [(1, "s", "lone", 1, "X")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").repartition(5)
    assert found(df) == brute([r.asDict() for r in df.collect()])


def test_proof_rebuilds_root(docs):
    for row in merkle.manifest(docs, proofs=True).collect():
        path = [p.encode() for p in row.proof]
        assert merkle.fold(row.leaf.encode(), path).decode() == row.root
        assert hashlib.sha256(b"".join(path)).hexdigest() == row.proof_sha256


def test_one_row_is_its_own_root(docs):
    (row,) = merkle.manifest(docs.where("doc_id = 0"), proofs=True).collect()
    assert row.leaf == row.subroot == row.root and row.proof == [] and row.place == 0


def test_extra_columns_and_empty_table(docs, clashing, empty):
    import pyspark.sql.functions as F

    more = clashing.withColumns({c: F.lit("x") for c in ("id", "g", "leaf", "place", "word", "bits", "n", "hash", "block", "slot")})
    assert found(more) == found(docs)
    assert merkle.manifest(empty).collect() == []


@pytest.mark.parametrize("n", [0, 1, 2, 8, 9, 64, 65, 4096, 4097])
def test_height(n):
    assert merkle.height(n) == len(tree(["x"] * max(n, 1))) - 1
