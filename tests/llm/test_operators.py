"""Each operator against brute force on a small table with nulls, empty and long texts, ties and repeated rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pytest

from flowmetrics.llm import bagminhash, dealing, decontaminate, interpolation, langid, lines, ordinal, outliers, packing, queries, secrets, store, substrings
from flowmetrics.llm.graph import link_buckets
from flowmetrics.llm.textops import lists

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LAST = 1 << 62
LETTERS = "abcdefghijklmnopqrstuvwxyz"


def fold(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def collected(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, tuple)) else (False, "", str(x)) for x in t))


def ordered(rows):
    return sorted(rows, key=lambda t: tuple((x is None, str(type(x)), x) if not isinstance(x, (list, tuple)) else (False, "", str(x)) for x in t))


def similarity(a, b):
    common = sum((a & b).values())
    return common / (sum(a.values()) + sum(b.values()) - common)


def bag(text):
    words = WORD.findall(fold(text))
    return Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else Counter()


def classes(n, linked):
    parent = list(range(n))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(n):
        for j in range(i):
            if linked(i, j):
                parent[find(i)] = find(j)
    return [find(i) for i in range(n)]


def test_near_duplicates(rows, docs):
    bags = [bag(r[1]) for r in rows]
    group = classes(len(rows), lambda i, j: bool(bags[i] and bags[j]) and similarity(bags[i], bags[j]) >= 0.8)
    least = defaultdict(lambda: None)
    for r, g in zip(rows, group):
        if r[0] is not None and (least[g] is None or r[0] < least[g]):
            least[g] = r[0]
    sizes = Counter(group)
    want = ordered((r[0], least[g], sizes[g] if bags[i] else 1) for i, (r, g) in enumerate(zip(rows, group)))
    assert collected(bagminhash.near_duplicates(docs), "doc_id", "class_id", "class_size") == want


def test_keep_one_of_each_class(rows, docs, clashing):
    kept = bagminhash.keep_one(docs).collect()
    assert len(kept) == len({(r.doc_id, r.text) for r in kept})
    bags = [bag(r.text) for r in kept]
    assert all(similarity(a, b) < 0.8 for i, a in enumerate(bags) for b in bags[:i] if a and b)
    assert {r[1] for r in rows if not bag(r[1])} <= {r.text for r in kept}
    assert bagminhash.keep_one(clashing).columns == clashing.columns


def test_signature_agreement_estimates_weighted_similarity():
    import pyarrow as pa

    from flowmetrics.llm.textops import Words, word_table

    a = "x y " * 30 + " ".join(f"w{i}" for i in range(60))
    b = "x y " * 20 + " ".join(f"w{i}" for i in range(45))
    row, codes, counts = bagminhash.shingle_bag(Words.of(pa.array([a, b]), word_table()), 5)
    sig = bagminhash.signatures(row, codes, counts, 2, 4096)
    assert abs((sig[0] == sig[1]).mean() - similarity(bag(a), bag(b))) < 0.04


def test_bucket_links_are_complete(spark):
    """One bucket of 40 nodes with links only between neighbours of one parity: hubs must find every component."""
    from flowmetrics.llm.graph import link_buckets

    members = spark.createDataFrame([(1, i) for i in range(40)], "key long, node long")
    labels = dict(link_buckets(members, lambda pairs: pairs.where("abs(a - b) = 2")).collect())
    assert {labels[i] for i in range(0, 40, 2)} == {0} and {labels[i] for i in range(1, 40, 2)} == {1}


def test_language_model(rows, docs):
    learned = lambda r: r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 != 2
    tokens = [WORD.findall(fold(r[1])) + ["\n"] for r in rows]
    counts = Counter(w for r, ws in zip(rows, tokens) if learned(r) for w in ws)
    n, v = sum(counts.values()), len(counts)
    want = ordered((r[0], len(ws), sum(counts[w] > 0 for w in ws), n, round(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in ws), 6)) for r, ws in zip(rows, tokens))
    got = interpolation.score(docs, queries._fold(7) != 2, block_tokens=3000)
    got = got.withColumn("base", F.round("base_score", 6)).cache()
    assert collected(got, "doc_id", "n_tokens", "n_known", "train_tokens", "base") == want
    assert got.where("score >= 0 or score is null or isnan(score)").isEmpty()
    total = got.agg(F.sum("score"), F.sum("base_score")).first()
    assert total[0] > total[1]


def test_language_model_probabilities_add_up():
    weights = interpolation.learn_weights(np.array([[4, 3, 20, 50], [4, -1, 18, 30], [0, -1, 12, 9]]), 100)
    assert np.allclose(weights.sum(1), 1) and (weights >= 0).all() and weights[0, 0] == 0


def test_secrets(rows, docs):
    assign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    want = []
    for r in rows:
        text = r[1] or ""
        spans = [(m.start(), 0, m.end()) for m in assign.finditer(text) if len(m[2]) >= 6]
        spans += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        spans += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        want.append((r[0], *(sum(k == kind for _, kind, _ in spans) for k in range(3)), sha(",".join(f"{secrets.BASE[k]}:{a}:{b}" for a, k, b in sorted(spans)))))
    assert collected(secrets.digest(secrets.find_secrets(docs)), "doc_id", "n_assign", "n_access", "n_hex", "base_sha256") == ordered(want)


def test_added_secret_rules():
    scanner = secrets.Scanner.compile(secrets.RULES)
    text = b"ghp_" + b"Z" * 40 + b" x\nxoxb-" + b"1" * 20 + b"\n-----BEGIN RSA PRIVATE KEY-----\nAIzashort"
    cuts = np.cumsum([0] + [len(x) + 1 for x in text.split(b"\n")])
    spans = scanner.spans(np.frombuffer(text, np.uint8), cuts[:-1], cuts[1:] - 1)
    assert [secrets.RULES[k].kind for _, k, _ in spans] == ["github", "slack", "private_key"]


def test_a_rule_across_lines_is_refused():
    with pytest.raises(ValueError):
        secrets.Scanner.compile((secrets.Rule("x", r"a[\n]b"),))


def test_substrings(rows, docs, clashing):
    first = {}
    for r in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        words = WORD.findall(r[1] or "")
        for i in range(len(words) - 49):
            first.setdefault(tuple(words[i : i + 50]), LAST if r[0] is None else r[0])
    want = []
    for r in rows:
        words = WORD.findall(r[1] or "")
        gone = set()
        for i in range(len(words) - 49):
            if first[tuple(words[i : i + 50])] < (LAST if r[0] is None else r[0]):
                gone |= set(range(i, i + 50))
        want.append((r[0], len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone))))
    assert collected(substrings.find_repeats(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)
    assert collected(substrings.find_repeats(clashing), "doc_id", "n_words", "n_removed", "kept_sha256") == ordered(want)


@pytest.mark.parametrize("max_words", [1_000_000, 40])
def test_benchmark_hits(spark, rows, docs, max_words):
    token = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    source = token.findall(fold(rows[41][1]))
    items = [(1, " ".join(source[5:40])), (2, " ".join(source[20:33]).upper()), (3, "two words"), (4, None), (5, ""), (6, "one"), (2, "a b c a b c a b c a b"), (None, " ".join(source[50:61]))]
    windows = defaultdict(set)
    for item, text in items:
        words = token.findall(fold(text))
        size = min(10, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            windows[tuple(words[i : i + size])].add("null" if item is None else str(item))
    want = []
    for r in rows:
        words, hit, found = token.findall(fold(r[1])), set(), set()
        for size in {len(w) for w in windows}:
            for i in range(len(words) - size + 1):
                if (key := tuple(words[i : i + size])) in windows:
                    hit |= set(range(i, i + size))
                    found |= windows[key]
        want.append((r[0], len(words), len(hit), len(found), sha(",".join(sorted(found))), bool(hit)))
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.digest(decontaminate.find_hits(docs, benchmark, max_words=max_words))
    assert collected(got, "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated") == ordered(want)


def test_decontaminate_cuts_spans(spark, docs):
    benchmark = spark.createDataFrame([(1, "alpha beta gamma delta")], "item_id long, text string")
    texts = [(1, "Keep this, alpha  BETA gamma\ndelta! and this é"), (2, "alpha beta gamma delta"), (3, None), (4, "clean")]
    got = decontaminate.decontaminate(spark.createDataFrame(texts, "doc_id long, text string"), benchmark, max_coverage=0.6)
    assert collected(got, "doc_id", "text") == [(1, "Keep this, ! and this é"), (3, None), (4, "clean")]


def test_language_id(spark, docs, empty):
    labelled = [("the house and the garden", "en"), ("das haus und der garten", "de"), (None, "en"), ("x", None)] * 3
    model = langid.fit(spark.createDataFrame(labelled, "text string, lang string"))
    asked = [(1, "The garden"), (2, "der gartenhaus"), (3, None), (4, "12 %"), (5, ""), (None, "und das")]
    got = langid.predict(spark.createDataFrame(asked, "doc_id long, text string"), model)
    assert collected(got, "doc_id", "lang_pred") == [(1, "en"), (2, "de"), (3, "und"), (4, "und"), (5, "und"), (None, "de")]
    assert got.where("score < 0 or score > 1").isEmpty()
    assert langid.predict(docs, langid.fit(empty)).where("lang_pred != 'und'").isEmpty()


def test_lines(rows, docs):
    table = lines.line_table()
    spaced = bytes(np.where(table == 0, 32, table).astype(np.uint8))
    seen, places = {}, []
    for r in sorted(rows, key=lambda r: LAST if r[0] is None else r[0]):
        for i, line in enumerate((r[1] or "").split("\n")):
            if normal := lines.normal_form(line.encode(), spaced):
                places.append((normal, seen.setdefault(normal, (r[0], r[1], i)), r, i))
    got = {(r.doc_id, r.n_lines): r for r in lines.repeated_lines(docs).collect()}
    for normal, first, r, i in places:  # equal lines: all but the first occurrence go
        if first != (r[0], r[1], i):
            assert i in got[(r[0], r[1].count("\n") + 1)].removed
    assert sum(r.n_removed for r in got.values()) >= sum(first != (r[0], r[1], i) for _, first, r, i in places) - 80


def test_fuzzy_lines(spark):
    base = [f"word{i}x" for i in range(300)]
    near = [*base[:150], "other", *base[151:]]
    texts = [(1, " ".join(base)), (2, " ".join(near)), (3, "quite another line"), (4, "Quite, another LINE!\nkeep 1\nkeep 2"), (5, "!!!\n!!!")]
    table = spark.createDataFrame(texts, "doc_id long, text string")
    got = dict(collected(lines.repeated_lines(table, distance=5, blocks=8), "doc_id", "removed"))
    assert got == {1: [], 2: [0], 3: [], 4: [0, 2], 5: []}
    assert collected(lines.drop_repeated_lines(table.where("doc_id > 2")), "doc_id", "text") == [(3, "quite another line"), (4, "keep 1"), (5, "!!!\n!!!")]


def planted(rng, vocabulary, words, change):
    """Pairs (line, near line) of about ``words`` words, near by ``change`` of a list of words."""
    for _ in range(40):
        line = [rng.choice(vocabulary) for _ in range(words)]
        yield " ".join(line), " ".join(change(list(line)))


def test_near_lines_of_any_length(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choice("abcdefghijklmnoprstuv") for _ in range(rng.randint(3, 8))) for _ in range(3000)]

    def one_word(line):  # a short word for a short word, in the middle
        at = min(range(1, len(line) - 1), key=lambda i: len(line[i]))
        line[at] = "zzz"
        return line

    def one_letter(line):
        at = rng.randrange(len(line))
        line[at] = line[at][:1] + "q" + line[at][2:]
        return line

    plans = [(3, one_letter), (4, one_letter), (10, one_word), (20, one_word), (40, one_word), (100, one_word)]
    pairs = [(words, a, b) for words, change in plans for a, b in planted(rng, vocabulary, words, change) if a != b]

    def edits(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    pairs = [(words, a, b) for words, a, b in pairs if edits(a, b) <= 0.1 * max(len(a), len(b))]
    texts = [(2 * i + k, x) for i, pair in enumerate(pairs) for k, x in enumerate(pair[1:])]
    got = dict(collected(lines.repeated_lines(spark.createDataFrame(texts, "doc_id long, text string")), "doc_id", "removed"))
    assert not any(got[2 * i] for i in range(len(pairs)))  # unlike lines stay
    found, planned = Counter(), Counter(words for words, _, _ in pairs)
    for i, (words, _, _) in enumerate(pairs):
        found[words] += got[2 * i + 1] == [0]
    assert min(planned.values()) >= 20
    assert all(found[words] >= 0.95 * n for words, n in planned.items()), (found, planned)


def test_one_edit_keys_meet():
    rng = random.Random(3)
    for _ in range(300):
        line = "".join(rng.choice("abé ") for _ in range(rng.randint(9, 19)))
        at = rng.randrange(len(line))
        for other in (line[:at] + line[at + 1 :], line[:at] + "x" + line[at:], line[:at] + "x" + line[at + 1 :]):
            assert set(lines.one_edit_keys(line)) & set(lines.one_edit_keys(other))


def test_band_keys_do_not_depend_on_the_batch():
    normals = [x.encode() for x in ("one line of words here", "a second line, not like it", "ünï cödé " * 30, "z" * 18)] * 3000
    together = lines.band_keys(normals, 4)
    assert all((together[i] == lines.band_keys([normals[i]], 4)[0]).all() for i in (0, 1, 2, 3, 5000, 11999))


def test_lengths_and_bits_keep_every_near_pair():
    rng = random.Random(9)
    pairs = []
    for _ in range(400):
        line = [rng.choice("abcdeé ü") for _ in range(rng.choice([1, 3, 10, 19, 20, 90, 400]))]
        near = list(line)
        for _ in range(len(line) // 10):  # edits at most; the longer of both is as long as the line
            at = rng.randrange(len(near))
            near[at : at + rng.randint(0, 1)] = rng.choice([[], ["x"], ["ß"]])
        pairs += ["".join(line), "".join(near)]
    sizes = np.array([len(x) for x in pairs])
    bits, key = lines.gram_bits(pairs), 12345 << lines.LENGTH_BITS
    keys = lines.with_length(np.full(len(pairs), key), sizes)
    assert set(keys >> lines.LENGTH_BITS) == {12345}
    at = np.arange(0, len(pairs), 2)
    rows = [pa.array(keys), pa.array(np.arange(len(pairs))), pa.array(sizes), lists(bits.ravel(), np.arange(len(pairs) + 1) * lines.BIT_WORDS, pa.int64())]
    assert lines.near_lengths(0.9)(rows, at, at + 1).all()
    assert lines.near_bits(0.9)(rows, at, at + 1).all()
    long = at[(sizes[at] >= 90) & (sizes[np.roll(at, -1)] >= 90)]
    assert lines.near_bits(0.9)(rows, long, (long + 2) % len(pairs)).mean() < 0.5  # unlike lines


def test_within_counts_edits_as_a_table_does():
    rng = random.Random(21)
    for _ in range(600):
        line = [rng.choice("abé ") for _ in range(rng.choice([0, 1, 5, 40, 90]))]
        near = list(line)
        for _ in range(rng.randint(0, 12)):
            at = rng.randint(0, len(near))
            near[at : at + rng.randint(0, 2)] = rng.choice([[], ["b"], ["ß", "a"]])
        row = list(range(len(near) + 1))
        for i, x in enumerate(line, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(near, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        for most in {0, max(row[-1] - 1, 0), row[-1], row[-1] + 1, 9}:
            assert lines.within("".join(line), "".join(near), most) == (row[-1] <= most)


def test_letter_counts_tell_long_lines_apart():
    rng = random.Random(4)
    line = lambda letters: "".join(rng.choice(letters) for _ in range(1500))
    texts = [line("abcdefgh"), line("abcdijkl")]
    texts += [texts[0][:700] + "xyz" * 49 + texts[0][847:], "e" * 1500, "e" * 1350]  # 147 and 150 edits
    runs, at = np.arange(len(texts) + 1), np.array([0, 0, 3])
    rows = [None, pa.array(runs[:-1]), pa.array([len(x) for x in texts]), lists(lines.gram_bits(texts).ravel(), runs * lines.BIT_WORDS, pa.int64())]
    rows.append(lists(lines.letter_counts(texts), runs * lines.LETTERS, pa.int8()))
    assert lines.near_facts(0.9)(rows, at, np.array([1, 2, 4])).tolist() == [False, True, True]
    # long lines may set every bit
    rows[3] = lists(np.full(len(texts) * lines.BIT_WORDS, -1), runs * lines.BIT_WORDS, pa.int64())
    assert lines.near_bits(0.9)(rows, at, np.array([1, 2, 4])).all()
    assert lines.near_facts(0.9)(rows, at, np.array([1, 2, 4])).tolist() == [False, True, True]


def test_intermediate_tables_go(spark, tmp_path, monkeypatch):
    rng = random.Random(6)
    text = " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(40))
    table = spark.createDataFrame([(i, f"{text} {i % 3}\nown {'xyzu'[i % 4] * 20}") for i in range(40)], "doc_id long, text string")
    monkeypatch.setattr(store, "shared_dir", lambda _: tmp_path.as_uri())
    lines.repeated_lines(table).collect()
    assert {x.name.split("-")[0] for x in tmp_path.iterdir()} == {"lines", "repeated"}
    bagminhash.near_duplicates(table).collect()
    assert {x.name.split("-")[0] for x in tmp_path.iterdir()} == {"lines", "repeated", "signatures", "classes"}


def test_written_tables_leave_no_shuffle_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "shared_dir", lambda _: tmp_path.as_uri())
    disk = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    files = lambda: {x for x in disk.getAllFiles().mkString("\n").split("\n") if "shuffle_" in x}
    before = files()
    counts = spark.range(0, 20000, 1, 4).groupBy((F.col("id") % 7).alias("k")).agg(F.collect_list("id").alias("ids"))
    table = store.materialize(counts, "counts")
    assert not files() - before
    assert table.count() == 7


def test_unlike_lines_that_meet_are_not_compared(spark, monkeypatch):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(n))
    common, near = words(12), words(30)
    texts = [f"{common} {words(18)}" for _ in range(60)] + [f"{common} {words(32)}" for _ in range(60)] + [near, f"{near} z"]
    compared = []

    def watched(members, verify, *more):
        return link_buckets(members, lambda pairs: compared.append(pairs.count()) or verify(pairs), *more)

    monkeypatch.setattr(lines, "link_buckets", watched)
    got = dict(collected(lines.repeated_lines(spark.createDataFrame(enumerate(texts), "doc_id long, text string")), "doc_id", "removed"))
    assert [i for i, gone in got.items() if gone] == [121]
    assert sum(compared) <= 10  # 103 without lengths and bits


def test_few_edits_and_many_agree_with_within():
    rng = random.Random(12)
    pairs = []
    for size in (0, 1, 7, 63, 64, 65, 129, 300):
        for _ in range(60):
            line = [rng.choice("abcé ") for _ in range(size)]
            near = list(line)
            for _ in range(rng.randint(0, 14)):
                at = rng.randint(0, len(near))
                near[at : at + rng.randint(0, 2)] = rng.choice([[], ["x"], ["ß", "a"]])
            pairs.append(("".join(line), "".join(near), rng.randint(0, 20)))
    want = [lines.within(*pair) for pair in pairs]
    assert lines.within_many(pairs) == want
    assert all(linked for pair, linked in zip(pairs, want) if lines.few_edits(*pair))
    assert lines.few_edits("one word of many in a line", "one other word of many in a line", 6)


def test_dealt_columns_come_back_by_key():
    rng = np.random.default_rng(3)
    parts = [[rng.integers(0, 2**64, n, dtype=np.uint64), np.arange(n)] for n in (5, 0, 300_000, 7)]
    schema = pa.schema([("bucket", pa.int64()), ("c0", pa.binary()), ("c1", pa.binary())])
    batches = list(dealing.deal(iter(parts), 256, schema))
    assert sum(len(b) for b in batches) <= 2 * 256  # a row a bucket and run, not one a key
    rows = pa.Table.from_batches(batches).sort_by("bucket").to_batches(max_chunksize=100)
    got = [(bucket, *pair) for bucket, columns in dealing.gathered(iter(rows), (np.uint64, np.int64)) for pair in zip(*(c.tolist() for c in columns))]
    assert sorted(got) == sorted((k >> 56, k, v) for part in parts for k, v in zip(*(c.tolist() for c in part)))


def test_lines_meet_in_packed_keys():
    sizes = [30, 31, 200, 30, 40, 40]
    keys = lines.with_length(np.array([7, 7, 7, 8, 9, 9]) << lines.LENGTH_BITS, np.array(sizes)).view(np.uint64)
    nodes = np.array([1, 2, 3, 4, 2, 1])
    schema = pa.schema([("bucket", pa.int64()), ("c0", pa.binary()), ("c1", pa.binary())])
    met = pa.schema([("key", pa.int64()), ("node", pa.int64())])
    batches = lines.bucket_batches(dealing.deal(iter([[keys, nodes]] * 2), 256, schema), lines.near_lengths(0.9), (np.uint64, np.int64), met, lines.LENGTH_BITS)
    rows = [tuple(x.values()) for b in batches for x in b.to_pylist()]
    assert sorted(node for _, node in rows) == [1, 1, 2, 2]  # the third is too long, the fourth alone
    assert len({key for key, _ in rows}) == 1  # both keys have the same lines


def test_simhash_of_more_words_than_a_counter_holds():
    rng = np.random.default_rng(8)
    counts = [0, 1, 255, 256, 2000, 3]
    hashes, first = rng.integers(0, 2**64, sum(counts), dtype=np.uint64), np.cumsum([0, *counts])
    got = lines.simhash(hashes, first)
    for i, (lo, hi) in enumerate(zip(first[:-1], first[1:])):
        words = hashes[lo:hi].copy()
        before = np.append(np.zeros(min(1, hi - lo), np.uint64), words[:-1])
        bits = np.unpackbits(lines.mix(words + before * np.uint64(0x9E3779B97F4A7C15)).view(np.uint8).reshape(-1, 8), axis=1)
        assert got[i].tobytes() == np.packbits(2 * bits.sum(0, dtype=int) > hi - lo).tobytes()


def test_block_keys_meet_within_the_distance():
    rng = np.random.default_rng(1)
    for _ in range(200):
        x = rng.integers(0, 2**63, dtype=np.uint64)
        y = x
        for bit in rng.choice(64, 3, replace=False):
            y ^= np.uint64(1) << np.uint64(bit)
        keys = lines.block_keys(np.array([x, y], np.uint64), 6, 3)
        assert (keys[0] == keys[1]).any()


def test_ordinal(spark, docs, empty):
    rated = [("vile trash vile stuff", 0), ("so so text of words", 1), ("fine prose about gardens", 2), (None, 1), ("x", None), ("y", 7)] * 8
    model = ordinal.fit(spark.createDataFrame(rated, "text string, grade int"), grades=3)
    assert (np.diff(model.thresholds) > 0).all()
    asked = [(1, "vile trash vile stuff"), (2, "so so text of words"), (3, "fine prose about gardens"), (4, None), (5, "12")]
    got = collected(ordinal.score(spark.createDataFrame(asked, "doc_id long, text string"), model, cut=2), "doc_id", "expected_grade", "selected")
    assert got[0][1] < got[1][1] < got[2][1] and [g[2] for g in got] == [False, False, True, False, False]
    assert ordinal.score(docs, ordinal.fit(empty.withColumn("grade", F.lit(1)), 3), 1).count() == docs.count()


def test_packing(rows, docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    pieces = packing.pack(docs, queries.tokenizer_path(), capacity=64, block_pieces=50).toPandas()
    ids = [np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4") for r in rows]
    assert pieces.length.sum() == sum(map(len, ids))
    by_doc = defaultdict(list)
    for r, x in zip(rows, ids):
        by_doc[r[0]].append(x)
    for p in pieces.itertuples():
        doc = None if p.doc_id != p.doc_id else int(p.doc_id)
        cuts = [x[p.start : p.start + p.length].tobytes() for x in by_doc[doc] if len(x) == p.doc_tokens]
        assert p.ids_crc32 in {zlib.crc32(c) for c in cuts}
    placed = pieces.sort_values(["sequence_id", "offset"])
    assert (placed.groupby("sequence_id").length.cumsum() - placed.length == placed.offset).all()
    full = pieces.groupby("sequence_id").length.sum()
    assert full.max() <= 64 and (full < 64).sum() <= -(-len(pieces) // 50) + 1


def test_sum_of_squares_takes_the_least_sum():
    rng = np.random.default_rng(3)
    rule = packing.SumOfSquares(32)
    for size in rng.integers(1, 32, 500):
        before = rule.levels.copy()
        options = {}
        for level in [0, *np.flatnonzero(before[:-1])]:
            after = before.copy()
            after[level] -= level > 0
            if level + size < 32:
                after[level + size] += 1
            if level + size <= 32:
                options[int(level)] = int((after[1:32] ** 2).sum())
        rule.place(int(size))
        assert int((rule.levels[1:32] ** 2).sum()) == min(options.values())


def test_quality_counts(rows, docs):
    want = []
    for r in rows:
        text = r[1] or ""
        words = WORD.findall(text)
        count = Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)}
        own = [x for x in text.split("\n") if WORD.search(x)]
        want.append((r[0], len(words), sum(map(len, words)), len(re.findall("[#*$%&|<>]", text)), len(own) - len(set(own)), len(covered), len(words) < 50 or 100 * len(covered) > 50 * len(words)))
    got = outliers.assess(docs)
    assert collected(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == ordered(want)
    assert got.where("kept and base_failed").isEmpty()


def test_repeats_by_words_equal_repeats_by_hash(spark):
    """The exact path, taken on hash clashes, gives the same counts."""
    rng = np.random.default_rng(5)
    texts = [" ".join(rng.choice(list("abc"), n)) for n in (4, 9, 30, 80)]
    df = spark.createDataFrame([(t,) for t in texts], "text string").withColumn("w", F.split("text", " "))
    for t, (got,) in zip(texts, df.select(outliers._repeat_words(F.col("w"))).collect()):
        words = t.split(" ")
        count = Counter(zip(words, words[1:], words[2:]))
        assert got == len({i + k for i in range(len(words) - 2) if count[tuple(words[i : i + 3])] > 1 for k in range(3)})


def test_outliers_are_rejected_per_group(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 8))) for _ in range(300)]
    texts = [(i, " ".join(rng.choice(vocabulary, 80)), "en", "s") for i in range(300)]
    texts += [(1000 + i, " ".join(w + "###" for w in rng.choice(vocabulary, 80)), "en", "s") for i in range(30)]
    got = outliers.assess(spark.createDataFrame(texts, "doc_id long, text string, lang string, source string"))
    kept = {r.doc_id for r in got.where("kept").collect()}
    assert kept == set(range(300))


def test_chi_square_tail():
    assert abs(outliers.chi2_tail(outliers.chi2_quantile(0.01, 4), 4) - 0.01) < 1e-9
    assert abs(outliers.chi2_quantile(0.05, 4) - 9.4877) < 1e-3


def test_empty_tables(spark, empty):
    assert bagminhash.near_duplicates(empty).isEmpty()
    assert interpolation.score(empty, F.lit(True)).isEmpty()
    assert secrets.find_secrets(empty).isEmpty()
    assert substrings.find_repeats(empty).isEmpty()
    assert decontaminate.find_hits(empty, empty.select(F.col("doc_id").alias("item_id"), "text")).isEmpty()
    assert lines.repeated_lines(empty).isEmpty()
    assert packing.pack(empty, queries.tokenizer_path()).isEmpty()
    assert outliers.assess(empty).isEmpty()


def test_clashing_columns(clashing):
    n = clashing.count()
    assert bagminhash.near_duplicates(clashing).count() == n
    assert interpolation.score(clashing, queries._fold(7) != 2).count() == n
    assert lines.repeated_lines(clashing).count() == n


@pytest.mark.parametrize("stage", [bagminhash.keep_one, lines.drop_repeated_lines, outliers.keep_regular, decontaminate.decontaminate])
def test_stages_keep_clashing_columns(docs, clashing, stage):
    more = clashing.withColumns({c: F.lit("x") for c in ("_rid", "_keeper", "_owner", "_removed", "g_lang", "size", "end")})
    rest = [docs.where("length(text) < 200").select(F.col("doc_id").alias("item_id"), "text").limit(3)] if stage is decontaminate.decontaminate else []
    got, plain = stage(more, *rest), stage(docs, *rest)
    assert got.columns == more.columns
    own = docs.columns
    rows = [r.asDict() for r in got.collect()]
    assert all(v == "x" for r in rows for c, v in r.items() if c not in own)
    assert ordered(tuple(r[c] for c in own) for r in rows) == collected(plain, *own)


def test_letterless_texts_are_undetermined(spark):
    model = langid.fit(spark.createDataFrame([("the house", "en"), ("das haus", "de")], "text string, lang string"))
    odd = ["½ ²", "Ⅷ ⅷ", "①②", "12 %", "_ _"]
    got = langid.predict(spark.createDataFrame([(i, t) for i, t in enumerate([*odd, "the½house"])], "doc_id long, text string"), model)
    assert [r.lang_pred for r in got.orderBy("doc_id").collect()] == ["und"] * len(odd) + ["en"]
    assert langid.words_of("Ab½cD 1e_f") == ["ab", "cd", "e", "f"]


def test_every_language_is_learned(spark):
    name = lambda i: "wort" + LETTERS[i // 26] + LETTERS[i % 26]
    many = [(f"{name(i)} {name(i)}x", f"l{i:03}") for i in range(130)]
    copies = [("immer nur derselbe text", "copied")] * 5000
    model = langid.fit(spark.createDataFrame(many + copies, "text string, lang string"), docs_per_language=50)
    assert model.languages == sorted({lang for _, lang in many} | {"copied"})
    got = langid.predict(spark.createDataFrame([(0, "derselbe text"), (1, name(128))], "doc_id long, text string"), model)
    assert collected(got, "doc_id", "lang_pred") == [(0, "copied"), (1, "l128")]


def test_ordinal_sample_has_a_hard_limit(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(ordinal.CumulativeLink, "fit", lambda self, grade, row, bucket: seen.append(grade) or self)
    rows = [("one text that holds a third of all rows", 2)] * 1000 + [(f"text number {i} word{i}", i % 2) for i in range(2000)]
    ordinal.fit(spark.createDataFrame(rows, "text string, grade int"), grades=3, sample=300)
    assert 200 <= len(seen[0]) <= 300 and (seen[0] == 2).sum() <= 1


def test_ordinal_sample_is_chosen_by_ids_and_hashes(spark):
    texts = [(i, f"text number {i % 150} word") for i in range(300)] + [(5, "another text of id 5"), (None, "no id"), (7, None), (300, "unrated")]
    grades = [(i, i % 4) for i in range(300)] + [(5, 1), (5, 0), (None, 1), (9, None), (999, 1)]
    docs, labels = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(grades, "doc_id long, grade int")
    pairs = {(t, g) for i, t in texts for j, g in grades if i is not None and i == j and t is not None and g is not None and g < 3}
    got = [tuple(r) for r in ordinal.sample_rated(docs, labels, grades=3).collect()]
    assert len(got) == len(set(got)) and set(got) == pairs
    few = {tuple(r) for r in ordinal.sample_rated(docs, labels, grades=3, sample=40).collect()}
    assert len(few) <= 40 and few <= pairs
    # what is exchanged holds no text but that of chosen rows, behind the broadcast join
    plan = ordinal.sample_rated(docs, labels, grades=3)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_token_cache_equals_the_tokenizer():
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    cache = packing.TokenCache(queries.tokenizer_path())
    cache.BOUND = 40  # cleared over and over; one batch holds more parts
    rng = random.Random(5)
    bits = ["'", "'s", "'re", "'l", "ll", "s", "t", "ve", "m", "B", "é", "ß", "中", "文", "1", "²", "½", "٣", " ", "\n", "_", "-", "..", "́", "İ", "<|", "\x1f", "\x00", "​", "😀", "Σ", "\x85", "\t"]
    for _ in range(20):
        texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(30))) for _ in range(rng.choice([0, 1, 60]))]
        got = [np.frombuffer(x, "<u4").tolist() for x in cache.texts(texts)]
        assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


MEMORY = """
import random, sys
sys.path.insert(0, {root!r})
import pyarrow as pa
from flowmetrics.llm import packing, queries

def held():
    return sum(int(x.split()[1]) for x in open("/proc/self/smaps_rollup") if x.startswith("Anonymous:")) / 1024

rng = random.Random(4)
vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(3, 9))) for _ in range(150000)]
texts = [" ".join(rng.choices(vocabulary, k=600)) for _ in range(8000)]
path = queries.tokenizer_path()
packing.worker_cache(path)
schema = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()), ("ids", pa.binary())])
batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
before = held()
for _ in packing.tokenize_pieces(iter([batch]), path, 2048, schema):
    pass
del _
print("held", held() - before)
"""


def test_an_idle_worker_hands_memory_back():
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    said = subprocess.run([sys.executable, "-c", MEMORY.format(root=root)], capture_output=True, text=True, timeout=120)
    assert "held" in said.stdout, said.stderr
    assert float(said.stdout.split("held")[1]) < 20
