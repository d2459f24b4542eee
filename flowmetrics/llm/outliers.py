"""Quality rules by robust multivariate outliers, in DataFrame functions only.

Counts per document give a base rule and a vector of transformed
statistics.  Per language and source, a minimum-covariance-determinant
estimate (Rousseeuw and Van Driessen, FastMCD) is fitted by concentration
steps: distances under the present estimate, the closest share of the
documents, their mean and covariance, and again.  Two deterministic starts
(median with MAD scales, median with floor scales) run side by side and the
smaller determinant stays.  A document whose Mahalanobis distance exceeds a
chi-square quantile is rejected.

A group of fewer than ``MIN_GROUP`` documents takes the estimate of its
language, and that of the whole table below it; a table with fewer than
``MIN_FIT`` documents has the base rule only.  Every statistic has a floor
on its standard deviation, so one that hardly varies (no symbols in most
texts) rejects by size, not by rarity.

Scale: texts are parsed once, into a table of small numbers.  A
concentration step is one aggregation with map-side sums per group and
distance bin (``BINS`` at most), so groups of any size combine before the
shuffle; the closest share is taken in whole bins.  Estimates are one row a
group, joined by Spark's own choice of broadcast (under its size limit) or
skew-split sort-merge join.  Statistics are rounded to 1/1024 and summed as
decimals, so results do not depend on the order of rows.
"""

from __future__ import annotations

import math
from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from .store import materialize, set_aside

WORD_GAP = r"[\x20\x09-\x0D]+"
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "[#*$%&|<>]"
MIN_WORDS = 50
MAX_REPEAT = 0.5
#: Standard-deviation floors: log mean word length, log symbols per 100 words, root share of repeated lines, root share of repeated words.
STATS = {"x_length": 0.12, "x_symbols": 0.4, "x_lines": 0.15, "x_repeats": 0.15}
SHARE = 0.75
STEPS = 6
BINS = 256
UNIT = 1024
MIN_GROUP = 200
MIN_FIT = 20
TAIL = 1e-12
KEYS = ("level", "g_lang", "g_source")


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once (a lambda's argument is bound, an expression would be repeated)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(positions: Column) -> Column:
    """Words covered by 3-word windows that start at the sorted ``positions``."""

    def count(p):
        gaps = F.transform(p, lambda x, j: F.least(F.coalesce(F.get(p, j + 1) - x, F.lit(3)), F.lit(3)))
        return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

    return _let(positions, count)


def _repeat_words(words: Column) -> Column:
    """Words inside 3-word windows that occur twice or more in ``words``.

    Sorts 40 hash bits with 24 position bits, then compares the words of
    equal neighbours; a text with a clash of different windows, or with more
    positions than fit, is sorted by the words themselves.
    """
    starts = lambda w: F.sequence(F.lit(0), F.size(w) - 3)
    window = lambda w, i: F.array(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))
    high = lambda e: F.shiftrightunsigned(e, 24)
    place = lambda e: e.bitwiseAND(F.lit((1 << 24) - 1)).cast("int")

    def by_hash(w):
        coded = F.transform(starts(w), lambda i: F.shiftleft(high(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2))), 24).bitwiseOR(i.cast("long")))

        def twins(s):
            return F.filter(s, lambda e, j: (high(F.get(s, j + 1)) == high(e)) | (high(F.get(s, j - 1)) == high(e)))

        def counted(t):
            clash = F.exists(
                F.sequence(F.lit(1), F.greatest(F.size(t) - 1, F.lit(1))),
                lambda j: (high(F.get(t, j)) == high(F.get(t, j - 1))) & (window(w, place(F.get(t, j))) != window(w, place(F.get(t, j - 1)))),
            )
            return F.when(F.size(t) == 0, F.lit(0).cast("long")).when(clash, by_words(w)).otherwise(_covered(F.sort_array(F.transform(t, place))))

        return _let(_let(F.sort_array(coded), twins), counted)

    def by_words(w):
        pairs = F.array_sort(F.transform(starts(w), lambda i: F.struct(window(w, i).alias("g"), i.alias("i"))))

        def twins(s):
            return F.filter(s, lambda e, j: (F.get(s, j + 1)["g"] == e["g"]) | (F.get(s, j - 1)["g"] == e["g"]))

        return _covered(F.sort_array(F.transform(_let(pairs, twins), lambda e: e["i"])))

    return _let(words, lambda w: F.when(F.size(w) < 4, F.lit(0).cast("long")).when(F.size(w) >= (1 << 24), by_words(w)).otherwise(by_hash(w)))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with its counts, the base rule and the transformed statistics.

    Null text counts as empty.  Columns of these names are replaced.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    trimmed = F.btrim(text, F.lit(SPACES))
    words = F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, WORD_GAP))
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    facts = F.struct(
        _let(words, lambda x: F.struct(F.size(x).cast("long").alias("n_words"), F.length(F.array_join(x, "")).cast("long").alias("word_chars"), _repeat_words(x).alias("n_repeat_words"))).alias("w"),
        F.regexp_count(text, F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"))).alias("l"),
    )
    out = docs.withColumn("_facts", facts)
    part = F.col("_facts")
    w = part["w"]
    out = out.withColumns(
        {
            "n_words": w["n_words"],
            "word_chars": w["word_chars"],
            "n_symbols": part["n_symbols"],
            "n_dup_lines": part["l"]["n_dup_lines"],
            "n_lines": part["l"]["n_lines"],
            "n_repeat_words": w["n_repeat_words"],
        }
    ).drop("_facts")
    n = F.greatest(F.col("n_words"), F.lit(1))
    units = lambda x: F.round(x * UNIT).cast("long")
    return out.withColumns(
        {
            "base_failed": (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 100 * MAX_REPEAT * F.col("n_words")),
            "x_length": units(F.log(F.greatest(F.col("word_chars"), F.lit(1)) / n)),
            "x_symbols": units(F.log1p(100 * F.col("n_symbols") / n)),
            "x_lines": units(F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)))),
            "x_repeats": units(F.sqrt(F.col("n_repeat_words") / n)),
        }
    )


def chi2_tail(x: float, dof: int) -> float:
    """P(chi-square > x) for an even number of degrees of freedom."""
    return math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))


def chi2_quantile(tail: float, dof: int) -> float:
    low, high = 0.0, 1e4
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_tail(mid, dof) > tail else (low, mid)
    return (low + high) / 2


def _group_key() -> Column:
    return F.struct(*KEYS)


def _levels(stats: DataFrame) -> DataFrame:
    """Each document that passes the base rule, in its source, its language and the table."""
    null = F.lit(None).cast("string")
    group = lambda level, lang, source: F.struct(F.lit(level).alias("level"), lang.alias("g_lang"), source.alias("g_source"))
    # a null language or source is a group of its own
    lang, source = F.to_json(F.struct("lang")), F.to_json(F.struct("source"))
    return stats.where(~F.col("base_failed")).select(F.explode(F.array(group(0, lang, source), group(1, lang, null), group(2, null, null))).alias("g"), *STATS).select("g.*", *STATS)


def _medians(long: DataFrame) -> DataFrame:
    """Median bin of ``v`` per group and statistic, from counts per value."""
    counts = long.groupBy(*KEYS, "stat", "v").agg(F.count("*").alias("n"))
    group = [*KEYS, "stat"]
    run = Window.partitionBy(*group).orderBy("v")
    whole = Window.partitionBy(*group)
    return counts.withColumns({"upto": F.sum("n").over(run), "all": F.sum("n").over(whole)}).where(2 * F.col("upto") >= F.col("all")).groupBy(*group).agg(F.min("v").alias("m"))


def _same_group(a: DataFrame, b: DataFrame) -> Column:
    return reduce(lambda x, y: x & y, [a[k].eqNullSafe(b[k]) for k in KEYS])


def _estimate(table: DataFrame) -> DataFrame:
    """Adds the inverse covariance (q_i_j, by Cholesky) and log determinant to means m_i and covariances v_i_j."""
    p = len(STATS)
    chol: dict[tuple[int, int], str] = {}
    for i in range(p):
        for j in range(i + 1):
            rest = F.col(f"v_{j}_{i}")
            for k in range(j):
                rest = rest - F.col(f"l_{i}_{k}") * F.col(f"l_{j}_{k}")
            table = table.withColumn(f"l_{i}_{j}", F.sqrt(F.greatest(rest, F.lit(1e-9))) if i == j else rest / F.col(f"l_{j}_{j}"))
            chol[i, j] = f"l_{i}_{j}"
    for i in range(p):  # the inverse of the triangle
        for j in range(i + 1):
            if i == j:
                value = 1 / F.col(chol[i, i])
            else:
                value = -reduce(lambda a, b: a + b, [F.col(chol[i, k]) * F.col(f"k_{k}_{j}") for k in range(j, i)]) / F.col(chol[i, i])
            table = table.withColumn(f"k_{i}_{j}", value)
    logdet = 2 * reduce(lambda a, b: a + b, [F.log(F.col(chol[i, i])) for i in range(p)])
    kept = [f"k_{i}_{j}" for i in range(p) for j in range(i + 1)]
    return table.withColumn("logdet", logdet).select(*KEYS, *([c for c in ("start", "size") if c in table.columns]), *[f"m_{i}" for i in range(p)], *kept, "logdet")


def _distance() -> Column:
    """Squared Mahalanobis distance under the joined estimate."""
    p = len(STATS)
    centred = [F.col(x) / F.lit(float(UNIT)) - F.col(f"m_{i}") for i, x in enumerate(STATS)]
    rows = [reduce(lambda a, b: a + b, [F.col(f"k_{i}_{j}") * centred[j] for j in range(i + 1)]) for i in range(p)]
    return reduce(lambda a, b: a + b, [r * r for r in rows])


def fit(stats: DataFrame) -> DataFrame:
    """One estimate per (lang, source) found in ``stats``: keys g_lang, g_source, means, inverse triangle."""
    p, names = len(STATS), list(STATS)
    floors = list(STATS.values())
    rows = materialize(_levels(stats), "mcd-rows")
    stack = F.explode(F.array(*[F.struct(F.lit(i).alias("stat"), F.col(x).alias("v")) for i, x in enumerate(names)]))
    long = rows.select(*KEYS, stack.alias("s")).select(*KEYS, "s.*")
    centre = materialize(_medians(long).withColumnRenamed("m", "centre"), "mcd-centre")
    spread = _medians(long.join(centre, _same_group(long, centre) & (long["stat"] == centre["stat"])).select(*[long[k] for k in KEYS], long["stat"], F.abs(long["v"] - centre["centre"]).alias("v")))
    both = centre.join(spread.withColumnRenamed("m", "mad"), [centre[k].eqNullSafe(spread[k]) for k in (*KEYS, "stat")]).select(*[centre[k] for k in (*KEYS, "stat")], "centre", "mad")
    wide = both.groupBy(*KEYS).agg(*[F.max(F.when(F.col("stat") == i, F.col("centre") / UNIT)).alias(f"m_{i}") for i in range(p)], *[F.max(F.when(F.col("stat") == i, F.col("mad") / UNIT)).alias(f"s_{i}") for i in range(p)])
    wide = wide.withColumn("start", F.explode(F.array(F.lit(0), F.lit(1))))
    for i in range(p):
        for j in range(i, p):
            scale = F.when(F.col("start") == 0, F.pow(1.4826 * F.col(f"s_{i}"), 2)).otherwise(F.lit(0.0)) + floors[i] ** 2
            wide = wide.withColumn(f"v_{i}_{j}", scale if i == j else F.lit(0.0))
    estimate = materialize(_estimate(wide), "mcd-0")
    inner = chi2_quantile(1 - SHARE, p)
    consistency = SHARE / (1 - chi2_tail(inner, p + 2))
    number = lambda x: x.cast("decimal(38,0)")
    products = [(i, j) for i in range(p) for j in range(i, p)]
    for step in range(1, STEPS + 1):
        placed = rows.join(estimate, _same_group(rows, estimate)).select(*[rows[k] for k in KEYS], "start", *names, F.least(F.floor(16 * F.log2(1 + _distance())), F.lit(BINS - 1)).alias("bin"))
        sums = placed.groupBy(*KEYS, "start", "bin").agg(
            F.count("*").alias("n"),
            *[F.sum(number(F.col(x))).alias(f"s_{i}") for i, x in enumerate(names)],
            *[F.sum(number(F.col(names[i]) * F.col(names[j]))).alias(f"p_{i}_{j}") for i, j in products],
        )
        run = Window.partitionBy(*KEYS, "start").orderBy("bin")
        whole = Window.partitionBy(*KEYS, "start")
        near = sums.withColumns({"before": F.sum("n").over(run) - F.col("n"), "size": F.sum("n").over(whole)}).where(F.col("before") < SHARE * F.col("size"))
        moment = near.groupBy(*KEYS, "start").agg(F.max("size").alias("size"), F.sum("n").cast("double").alias("n"), *[F.sum(f"s_{i}").cast("double").alias(f"s_{i}") for i in range(p)], *[F.sum(f"p_{i}_{j}").cast("double").alias(f"p_{i}_{j}") for i, j in products])
        moment = moment.withColumns({f"m_{i}": F.col(f"s_{i}") / F.col("n") / UNIT for i in range(p)})
        moment = moment.withColumns(
            {f"v_{i}_{j}": consistency * F.greatest(F.col(f"p_{i}_{j}") / F.col("n") / UNIT**2 - F.col(f"m_{i}") * F.col(f"m_{j}"), F.lit(0.0) if i == j else F.lit(float("-inf"))) + (floors[i] ** 2 if i == j else 0.0) for i, j in products}
        )
        estimate = materialize(_estimate(moment), f"mcd-{step}")
    best = estimate.groupBy(*KEYS).agg(F.min_by(F.struct(*[c for c in estimate.columns if c not in KEYS]), F.struct("logdet", "start")).alias("e")).select(*KEYS, "e.*")
    # each source takes the estimate of the narrowest group that is large enough
    values = [c for c in best.columns if c not in KEYS]
    sources = stats.select(F.to_json(F.struct("lang")).alias("g_lang"), F.to_json(F.struct("source")).alias("g_source")).distinct()
    null = F.lit(None).cast("string")
    above = [F.struct(F.lit(n).alias("level"), (F.col("g_lang") if n < 2 else null).alias("o_lang"), (F.col("g_source") if n < 1 else null).alias("o_source")) for n in range(3)]
    wanted = sources.withColumn("o", F.explode(F.array(*above))).select("g_lang", "g_source", "o.*")
    best = best.withColumnsRenamed({"level": "b_level", "g_lang": "b_lang", "g_source": "b_source"})
    usable = best.where(F.col("size") >= F.when(F.col("b_level") == 2, MIN_FIT).otherwise(MIN_GROUP))
    joined = wanted.join(usable, (F.col("level") == F.col("b_level")) & F.col("o_lang").eqNullSafe(F.col("b_lang")) & F.col("o_source").eqNullSafe(F.col("b_source")))
    chosen = joined.groupBy("g_lang", "g_source").agg(F.min_by(F.struct("level", *values), F.col("level")).alias("e")).select("g_lang", "g_source", "e.*")
    return materialize(chosen, "mcd-chosen")


def judge(stats: DataFrame, tail: float = TAIL) -> DataFrame:
    """Rows of ``statistics`` (with lang and source) plus level, distance and kept; see ``assess``."""
    stats = materialize(stats.drop("distance", "kept", "level", "g_lang", "g_source"), "statistics")
    estimate = fit(stats)
    keyed = stats.withColumns({"d_lang": F.to_json(F.struct("lang")), "d_source": F.to_json(F.struct("source"))})
    joined = keyed.join(estimate, (F.col("d_lang") == F.col("g_lang")) & (F.col("d_source") == F.col("g_source")), "left")
    limit = chi2_quantile(tail, len(STATS))
    distance = F.when(F.col("g_lang").isNotNull(), _distance())
    scored = joined.withColumn("distance", distance).withColumn("kept", ~F.col("base_failed") & ~F.coalesce(F.col("distance") > limit, F.lit(False)))
    return scored.select(*stats.columns, "level", "distance", "kept")


def assess(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """``docs`` with counts, base_failed, distance double (null without an estimate) and kept boolean.

    Needs text, lang and source; null text is empty and fails the base rule;
    null languages and sources are groups of their own; repeated rows are
    judged alike, each; an empty table stays empty.  Columns of the result's
    names in the input are replaced.
    """
    return judge(statistics(docs), tail)


def keep_regular(docs: DataFrame, tail: float = TAIL) -> DataFrame:
    """The rows of ``docs`` that ``assess`` keeps, with the columns of ``docs``, whatever the others are called."""
    inner, back = set_aside(docs, ("text", "lang", "source"))
    return assess(inner, tail).where("kept").select(*back)
