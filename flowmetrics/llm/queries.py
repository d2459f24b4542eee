"""Registered queries of the training-data operators: op1 to op13, with production parameters over whole tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from . import bagminhash, decontaminate, interpolation, jaccard, langid, lines, merkle, ordinal, outliers, packing, secrets, substrings, whitening
from .store import documents

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def _fold(parts: int) -> Column:
    """Remainder of the CRC-32 of the doc_id as text."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % parts


def op1_bagminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes: doc_id, class_id, class_size, kept."""
    return bagminhash.near_duplicates(documents(spark, sf_dir)).drop("rid")


def op2_interpolated_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every text, learned outside fold 2 of 7."""
    learned = _fold(7) != 2
    scored = interpolation.score(documents(spark, sf_dir).select("doc_id", "text"), learned)
    return scored.select("doc_id", (_fold(7) == 2).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets by one combined automaton: counts, digest of the base spans, all spans."""
    return secrets.digest(secrets.find_secrets(documents(spark, sf_dir)))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words inside 50-word windows that an earlier document has."""
    return substrings.find_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and items of the benchmark inside documents."""
    found = decontaminate.find_hits(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return decontaminate.digest(found)


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every text, learned outside fold 1 of 3."""
    docs = documents(spark, sf_dir)
    model = langid.fit(docs.where(_fold(3) != 1))
    return langid.predict(docs, model).select("doc_id", (_fold(3) == 1).alias("held_out"), "lang_pred", "score")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated and near-repeated lines: doc_id, n_lines, n_removed, removed line numbers."""
    return lines.repeated_lines(documents(spark, sf_dir)).drop("rid")


def op8_ordinal_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected grade and selection of every document; toxic is grade 0, low quality 1, good 2."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    grade = F.when(F.col("toxic") == 1, 0).otherwise(1 + F.col("quality"))
    rated = ordinal.sample_rated(docs, labels.select("doc_id", grade.alias("grade")), grades=3)
    return ordinal.score(docs, ordinal.fit(rated, grades=3), cut=2)


def op9_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Places of all documents' tokens in sequences of 2048."""
    return packing.pack(documents(spark, sf_dir), tokenizer_path())


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base rule and robust multivariate outliers per language and source."""
    stats = outliers.statistics(documents(spark, sf_dir).select("doc_id", "text", "lang", "source")).drop("text")
    return outliers.judge(stats).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "distance")


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Merkle leaves, roots and proofs of all documents; every third one tampered with."""
    return merkle.manifest(documents(spark, sf_dir)).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified", "lang", "place")


def op12_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose four-word shingle sets have a similarity of 0.85 or more."""
    return jaccard.jaccard_components(documents(spark, sf_dir))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors on their eight leading components, each scaled to variance one; deviation is null beyond 64 bits."""
    white = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return white.withColumn("deviation", F.col("deviation").try_cast("long"))


QUERIES = {f.__name__: f for f in (op1_bagminhash, op2_interpolated_lm, op3_secret_scan, op4_substring_dedup, op5_decontaminate, op6_language_id, op7_line_dedup, op8_ordinal_quality, op9_pack, op10_quality_rules, op11_merkle_manifest, op12_ngram_jaccard, op13_embedding_whitening)}

def _merkle_sql(levels: int = 7, upper: int = 3) -> str:
    """Trees level by level: 8**levels leaves a language and 8**upper languages at most."""
    field = "coalesce(CAST(strlen(CAST({0} AS VARCHAR)) AS VARCHAR) || ':' || CAST({0} AS VARCHAR), '-')".format
    leaf = lambda text: "sha256(" + " || ".join([*map(field, ("doc_id", "source", "lang", "n_chars")), field(text)]) + ")"
    shifts = ", ".join(["-1"] * 8)
    parts = [
        f"""WITH d AS (
  SELECT *, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS low FROM documents
), crc AS (
  SELECT *, xor(list_reduce(list_prepend(4294967295, flatten(list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: [CAST(ascii(c) AS BIGINT), {shifts}]))),
    lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END) END), 4294967295) % 3 = 0 AS tampered FROM d
), l0 AS (
  SELECT doc_id, lang, {leaf("text")} AS leaf, CASE WHEN tampered THEN {leaf("low")} ELSE {leaf("text")} END AS changed FROM crc
), n0 AS (
  SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, leaf AS h, [] :: VARCHAR[] AS lefts, [] :: VARCHAR[] AS rights FROM l0
)"""
    ]
    at, group = "n0", "lang"

    def rise(i: int) -> None:
        # one level: nodes by place, runs of eight, every leaf with its siblings there; a single node stays
        nonlocal at
        parts.append(f"""t{i} AS (SELECT DISTINCT {group} AS g, p, h FROM {at}), c{i} AS (SELECT g, count(*) AS n FROM t{i} GROUP BY g),
r{i} AS (SELECT g, p // 8 AS q, list(h ORDER BY p) AS hs FROM t{i} GROUP BY g, p // 8),
x{i} AS (
  SELECT a.* EXCLUDE (p, h, lefts, rights), p // 8 AS p, CASE WHEN n = 1 THEN h ELSE sha256(array_to_string(hs, '')) END AS h,
    CASE WHEN n = 1 THEN lefts ELSE list_append(lefts, array_to_string(hs[1:p % 8], '')) END AS lefts,
    CASE WHEN n = 1 THEN rights ELSE list_append(rights, array_to_string(hs[p % 8 + 2:], '')) END AS rights
  FROM {at} a JOIN c{i} ON a.{group} IS NOT DISTINCT FROM c{i}.g JOIN r{i} ON a.{group} IS NOT DISTINCT FROM r{i}.g AND a.p // 8 = r{i}.q
)""")
        at = f"x{i}"

    for i in range(levels):
        rise(i)
    parts.append(f"""ranks AS (SELECT lang AS of, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS rank FROM (SELECT DISTINCT lang FROM l0)),
u AS (SELECT {at}.* EXCLUDE (p), h AS subroot, rank AS p, 0 AS whole FROM {at} JOIN ranks ON lang IS NOT DISTINCT FROM of)""")
    at, group = "u", "whole"
    for i in range(levels, levels + upper):
        rise(i)
    folds = "list_reduce(list_prepend({'l': changed, 'r': ''}, list_transform(range(1, len(lefts) + 1), lambda i: {'l': lefts[i], 'r': rights[i]})), lambda a, b: {'l': sha256(b.l || a.l || b.r), 'r': ''}).l"
    proof = "sha256(array_to_string(list_transform(range(1, len(lefts) + 1), lambda i: lefts[i] || rights[i]), ''))"
    parts.append(f"f AS (SELECT *, {folds} AS folded_root, {proof} AS proof_sha256 FROM {at})")
    place = "row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1"
    return ",\n".join(parts) + f"\nSELECT doc_id, leaf, subroot, h AS root, proof_sha256, folded_root, folded_root = h AS verified, lang, {place} AS place FROM f"


ORACLE = {
    "op11_merkle_manifest": _merkle_sql(),
    "op4_substring_dedup": r"""
WITH d AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 49], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d)
), hits AS (
  SELECT doc_id, i FROM windows JOIN (SELECT s, min(doc_id) AS earliest FROM windows GROUP BY s HAVING min(doc_id) < max(doc_id)) USING (s) WHERE doc_id > earliest
), gone AS (
  SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
       sha256(array_to_string(CASE WHEN ps IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(ps, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id)
""",
    "op5_decontaminate": r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), wanted AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i:i + 9], ' ') AS s
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)
), places AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS s
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM wanted))
), hits AS (
  SELECT doc_id, i, n, item_id FROM places JOIN wanted USING (n, s)
), words AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
""",
}
