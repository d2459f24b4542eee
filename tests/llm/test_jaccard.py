"""Jaccard join against all pairs, on ordinary rows and on families of near copies made to need each kind of link."""

import random
import re

from flowmetrics.llm import jaccard

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text, k=4):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def brute(rows, percent=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(d, least.get(find(i), d))
    return sorted(((d, len(sets[i]), least.get(find(i))) for i, (d, _) in enumerate(rows)), key=str)


def found(df, **options):
    return sorted((tuple(r) for r in jaccard.jaccard_components(df, **options).collect()), key=str)


def table(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(3)


def words_of(rng, n, size=5000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def edited(rng, words, edits):
    out = list(words)
    for _ in range(edits):
        out[rng.randrange(len(out))] = f"e{rng.randrange(10**9)}"
    return out


def test_odd_rows(docs, rows):
    assert found(docs, block_words=500) == brute([(r[0], r[1]) for r in rows])


def test_extra_columns_and_empty_table(docs, clashing, empty):
    import pyspark.sql.functions as F

    more = clashing.withColumns({c: F.lit("x") for c in ("block", "shard", "shingles", "leader", "named", "n", "hub", "a", "b")})
    assert found(more) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert found(empty) == []


def test_string_ids(spark):
    text = " ".join(f"w{i}" for i in range(60))
    df = spark.createDataFrame([("b", text), ("a", text + " more"), ("c", "else where")], "doc_id string, text string")
    assert found(df) == [("a", 58, "a"), ("b", 57, "a"), ("c", 1, "c")]


def families(rng):
    rows = []
    base = words_of(rng, 100)
    # a family without its base: copies at 0.847 of each other, linked only through overlapping edits
    rows += [edited(rng, base, 1) for _ in range(60)]
    # longer, without a base: copies that share none of their edits link all the same
    long = words_of(rng, 260)
    rows += [edited(rng, long, rng.randint(2, 5)) for _ in range(50)]
    # with its base, edits of all sizes, equal replacements
    third = words_of(rng, 150)
    rows += [third] + [edited(rng, third, rng.randint(1, 9)) for _ in range(60)]
    for _ in range(30):
        out = list(third)
        for at in rng.sample(range(150), 6):
            out[at] = f"again{at % 5}"
        rows.append(out)
    # a chain of cuts: neighbours link, the ends are far apart
    chain = words_of(rng, 400)
    rows += [chain[:n] for n in range(400, 60, -9)]
    # unlike sets that share a frequent passage
    passage = words_of(rng, 40)
    rows += [words_of(rng, 30) + passage + words_of(rng, rng.randint(1, 30)) for _ in range(40)]
    # documents put together from a pool of passages: every shingle is common, few link
    pool = [words_of(rng, 25) for _ in range(8)]
    rows += [sum(rng.sample(pool, 4), []) for _ in range(40)]
    rows += [words_of(rng, rng.randint(1, 80), 40) for _ in range(60)]
    return rows


def test_families(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(w)) for i, w in enumerate(families(rng))]
    rng.shuffle(rows)
    assert found(table(spark, rows), block_words=3000) == brute(rows)


def test_other_threshold(spark):
    rng = random.Random(9)
    rows = [(i, " ".join(w)) for i, w in enumerate(families(rng)[::2])]
    assert found(table(spark, rows), percent=60) == brute(rows, 60)


def test_group_of_equal_sets(spark):
    rows = [(i, "One same text of many equal copies " + ("x " if i % 2 else "X\n")) for i in range(500)]
    assert found(table(spark, rows)) == brute(rows)


def test_very_long_text(spark):
    rng = random.Random(4)
    long = words_of(rng, 40000, 10**6)
    rows = [(1, " ".join(long)), (2, " ".join(edited(rng, long, 300))), (3, " ".join(long[:30000])), (4, None)]
    assert found(table(spark, rows), block_words=10000) == brute(rows)


def test_sets_of_a_block_take_little_memory():
    import tracemalloc

    import pyarrow as pa

    rng = random.Random(1)
    texts = [" ".join(str(rng.randrange(20000)) for _ in range(400)) for _ in range(500)]
    schema = pa.schema([("block", pa.int64()), ("doc_id", pa.list_(pa.int64())), ("words", pa.list_(pa.int32())), ("vocabulary", pa.binary()), ("codes", pa.binary())])
    batch = pa.RecordBatch.from_arrays([pa.array(range(500), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    (block,) = (b.to_pylist()[0] for b in jaccard.block_batches(iter([batch]), 1 << 40, schema))
    tracemalloc.start()
    row, values, n = jaccard.sets_of(block["words"], block["vocabulary"], block["codes"], 4)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # the result has 12 bytes a word, and 8 before sorting
    assert n == 500 and len(row) == len(values) and most < 40 * 400 * 500
