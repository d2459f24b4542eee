"""Time-range behaviour operators.

The reference answers "did the same party do X within N after this
contact?" with correlated EXISTS or a join on the party followed by a
``MAX(CASE ...)`` range test.  Both pair every subject with every candidate
of the same party, which is quadratic in a hot party.  Here the same
question is a *sweep*:

* subjects and candidates are unioned into one stream keyed by party;
* a running ``min`` over the rows *after* each subject (descending order,
  unbounded-preceding frame, O(n)) gives the first candidate strictly later
  than the subject, from which EXISTS for any look-ahead window follows;
* a party with more than ``part_rows`` rows is cut into parts along time:
  its rows are counted per time cell (combined before the shuffle), cells
  are dealt to parts of about that size, and a part's subjects fall back on
  the first candidate of the parts after it, known from the same counts.

No pairs are emitted, no candidate is copied, and a party with a third of
all rows is spread over as many tasks as its rows fill.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType

MICROS_PER_SECOND = 1_000_000
MICROS_PER_DAY = 86_400 * MICROS_PER_SECOND
#: Rows of one key from which the sweep cuts it into parts of about this size.
PART_ROWS = 1_000_000
#: Time cells, the finest cuts of a key, per look-ahead window.
CELLS_PER_WINDOW = 64


def ts_micros(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_micros(c.cast("timestamp"))


def micros_of(df: DataFrame, name: str) -> Column:
    """Microsecond position of a timestamp column.

    ``timestamp_ntz`` (wall clock) is measured from the wall-clock epoch, so
    positions - and therefore N-hour windows - do not shift with the
    session time zone or across daylight-saving changes; ``timestamp``
    columns use their instant.
    """
    if isinstance(df.schema[name].dataType, TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ '1970-01-01 00:00:00', `{name}`)")
    return ts_micros(name)


def day_number(c: str | Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.unix_date(c.cast("date")).cast("long")


def _candidates(candidate_sets: Sequence, dedupe: bool) -> tuple[DataFrame, list[str]]:
    """One stream (_ek, _eq, _c0, _c1, ...) of all candidate sets, and the flags' names."""
    names = [n for flags, *_ in candidate_sets for n in (flags if isinstance(flags, Mapping) else [flags])]
    stream = None
    for flags, frame, ck, cp in candidate_sets:
        ck = F.col(ck) if isinstance(ck, str) else ck
        own = flags if isinstance(flags, Mapping) else {flags: F.lit(True)}
        tags = [F.coalesce(own[n], F.lit(False)).alias(f"_c{i}") if n in own else F.lit(False).alias(f"_c{i}") for i, n in enumerate(names)]
        part = frame.where(ck.isNotNull() & cp.isNotNull()).select(ck.alias("_ek"), cp.alias("_eq"), *tags)
        stream = part if stream is None else stream.unionByName(part)
    if dedupe:
        stream = stream.groupBy("_ek", "_eq").agg(*[F.bool_or(f"_c{i}").alias(f"_c{i}") for i in range(len(names))])
    return stream, names


def _guide(loads: DataFrame, flags: int, cell: int, part_rows: int) -> DataFrame:
    """Cuts of the keys with more than ``part_rows`` rows: (_gk, _cuts), one row per such key.

    _cuts: per part, in order, its first cell and, per flag, the first
    position of a candidate in any later part.
    """
    heads = [F.min(F.when(F.col(f"_c{i}"), F.col("_eq"))).alias(f"_h{i}") for i in range(flags)]
    cells = loads.groupBy("_ek", F.floor(F.col("_eq") / F.lit(cell)).alias("_cell")).agg(F.count(F.lit(1)).alias("_n"), *heads)
    whole = Window.partitionBy("_ek")
    before = whole.orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("*", F.sum("_n").over(whole).alias("_total"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    cells = cells.where(F.col("_total") > part_rows).withColumn("_part", F.floor(F.col("_before") / F.lit(part_rows)))
    parts = cells.groupBy("_ek", "_part").agg(F.min("_cell").alias("start"), *[F.min(f"_h{i}").alias(f"_h{i}") for i in range(flags)])
    later = whole.orderBy(F.col("_part").desc()).rowsBetween(Window.unboundedPreceding, -1)
    carry = F.array(*[F.min(f"_h{i}").over(later) for i in range(flags)]).alias("carry")
    parts = parts.select("_ek", "_part", "start", carry)
    return parts.groupBy(F.col("_ek").alias("_gk")).agg(F.sort_array(F.collect_list(F.struct("start", "carry"))).alias("_cuts"))


def sweep_stream(
    subjects: DataFrame, key: str | Column, pos: Column, candidate_sets: Sequence, width: int, lo: int = 0,
    dedupe: bool = False, part_rows: int | None = PART_ROWS, contained: bool = False,
) -> tuple[DataFrame, list[str]]:
    """Subjects and candidates in one stream, dealt to groups (_ek, _part); see ``first_after_many``."""
    key = F.col(key) if isinstance(key, str) else key
    cands, names = _candidates(candidate_sets, dedupe)
    s = subjects.select("*", key.alias("_ek"), (pos + F.lit(lo)).alias("_eq"), F.lit(False).alias("_cand"))
    u = s.unionByName(cands.withColumn("_cand", F.lit(True)), allowMissingColumns=True)
    # a subject without a key or position never matches: dealt by a hash, such rows do not meet in one window
    lost = F.xxhash64(*subjects.columns)
    unplaced = F.col("_ek").isNull() | F.col("_eq").isNull()
    nothing = F.array(*[F.lit(None).cast("long") for _ in names])
    if part_rows is None:
        return u.select("*", F.when(unplaced, lost).otherwise(F.lit(0)).alias("_part"), nothing.alias("_carry")), names
    cell = max(1, width // CELLS_PER_WINDOW)
    loads = cands
    if not contained:
        no = [F.lit(False).alias(f"_c{i}") for i in range(len(names))]
        loads = loads.unionByName(s.where(~unplaced).select("_ek", "_eq", *no))
    u = u.join(_guide(loads, len(names), cell, part_rows), F.col("_ek") == F.col("_gk"), "left")
    here = F.floor(F.col("_eq") / F.lit(cell))
    # rows before the first cut go to the first part
    part = F.greatest(F.size(F.filter("_cuts", lambda c: c["start"] <= here)), F.lit(1))
    u = u.withColumn("_part", F.when(unplaced, lost).when(F.col("_cuts").isNull(), F.lit(0)).otherwise(part.cast("long")))
    carried = F.when(F.col("_cuts").isNotNull() & ~unplaced, F.get("_cuts", F.col("_part").cast("int") - 1)["carry"]).otherwise(nothing)
    return u.withColumn("_carry", carried).drop("_gk", "_cuts"), names


def first_after_many(
    subjects: DataFrame,
    key: str | Column,
    pos: Column,
    candidate_sets: Sequence,
    width: int,
    lo: int = 0,
    dedupe: bool = False,
    part_rows: int | None = PART_ROWS,
    contained: bool = False,
) -> DataFrame:
    """Add, per candidate set, the first position of a candidate of the same key strictly after ``pos + lo`` (NULL if none).

    Each candidate set is ``(flag, frame, key, position)``; ``flag`` may be
    a mapping from names to conditions on the frame's rows, which then share
    its scan.  Positions are integers (``micros_of`` or ``day_number``); NULL
    keys or positions never match (SQL equality).  All sets are answered by
    one window sort; every subject row is kept, with all its columns.
    ``width`` is the widest look-ahead the caller tests and only sets how
    finely a hot key may be cut.  ``contained``: subjects are rows of the
    candidates' population, so that counting those alone bounds a key.
    ``part_rows=None`` leaves keys whole, for keys with a known bound.
    ``dedupe`` makes one candidate per position first (worth its shuffle for
    day positions, where many events share a day).
    """
    stream, names = sweep_stream(subjects, key, pos, candidate_sets, width, lo, dedupe, part_rows, contained)
    # at one position subjects come first, so candidates at the subject's own position do not count
    w = Window.partitionBy("_ek", "_part").orderBy(F.col("_eq").desc(), F.col("_cand").asc()).rowsBetween(
        Window.unboundedPreceding, -1
    )
    nexts = [F.min(F.when(F.col("_cand") & F.col(f"_c{i}"), F.col("_eq"))).over(w).alias(f"_enext{i}") for i in range(len(names))]
    found = stream.select("*", *nexts).where(~F.col("_cand"))
    placed = F.col("_ek").isNotNull() & F.col("_eq").isNotNull()
    return found.select(
        *subjects.columns,
        *[F.when(placed, F.coalesce(f"_enext{i}", F.get("_carry", F.lit(i)))).alias(n) for i, n in enumerate(names)],
    )


def exists_after_many(
    subjects: DataFrame,
    key: str | Column,
    pos: Column,
    lo: int,
    hi: int,
    candidate_sets: Sequence,
    dedupe: bool = True,
    part_rows: int | None = PART_ROWS,
    contained: bool = False,
) -> DataFrame:
    """Several EXISTS flags that share key and window, answered by ONE sweep.

    Each flag: a candidate with the same key has position in ``(pos + lo,
    pos + hi]``.  Parameters as in ``first_after_many``.
    """
    if hi <= lo:
        raise ValueError("need lo < hi")
    found = first_after_many(subjects, key, pos, candidate_sets, hi - lo, lo, dedupe, part_rows, contained)
    names = found.columns[len(subjects.columns):]
    return found.select(*subjects.columns, *[F.coalesce(F.col(n) <= pos + F.lit(hi), F.lit(False)).alias(n) for n in names])


def exists_after(
    subjects: DataFrame,
    candidates: DataFrame,
    key: str | Column,
    pos: Column,
    cand_key: str | Column,
    cand_pos: Column,
    lo: int,
    hi: int,
    name: str,
    dedupe: bool = True,
    part_rows: int | None = PART_ROWS,
    contained: bool = False,
) -> DataFrame:
    """Add boolean ``name``: a candidate with the same key has position in ``(pos + lo, pos + hi]``."""
    return exists_after_many(subjects, key, pos, lo, hi, [(name, candidates, cand_key, cand_pos)], dedupe, part_rows, contained)


def exists_within_ts(
    subjects: DataFrame,
    candidates: DataFrame,
    key: str,
    ts: str,
    name: str,
    max_seconds: int,
    min_seconds: int = 0,
    cand_key: str | None = None,
    cand_ts: str | None = None,
    part_rows: int | None = PART_ROWS,
    contained: bool = False,
) -> DataFrame:
    """Candidate of the same key at ``ts + min < t <= ts + max`` (seconds)."""
    return exists_after(
        subjects,
        candidates,
        key,
        micros_of(subjects, ts),
        cand_key or key,
        micros_of(candidates, cand_ts or ts),
        min_seconds * MICROS_PER_SECOND,
        max_seconds * MICROS_PER_SECOND,
        name,
        dedupe=False,
        part_rows=part_rows,
        contained=contained,
    )


def exists_within_ts_many(
    subjects: DataFrame, key: str, ts: str, max_seconds: int, min_seconds: int,
    candidate_sets: Sequence, part_rows: int | None = PART_ROWS, contained: bool = False,
) -> DataFrame:
    """Several timestamp-window EXISTS flags in one sweep: ``(flag, frame, key, ts)`` sets."""
    sets = [(n, f, k, micros_of(f, t)) for n, f, k, t in candidate_sets]
    return exists_after_many(
        subjects, key, micros_of(subjects, ts), min_seconds * MICROS_PER_SECOND, max_seconds * MICROS_PER_SECOND, sets,
        dedupe=False, part_rows=part_rows, contained=contained,
    )


def exists_within_days_many(
    subjects: DataFrame, key: str, day: str, days: int, candidate_sets: Sequence[tuple[str, DataFrame, str, str]]
) -> DataFrame:
    """Several inclusive day-window EXISTS flags in one sweep."""
    sets = [(n, f, k, day_number(d)) for n, f, k, d in candidate_sets]
    return exists_after_many(subjects, key, day_number(day), -1, days, sets)


def exists_within_days(
    subjects: DataFrame,
    candidates: DataFrame,
    key: str,
    day: str,
    name: str,
    days: int,
    cand_key: str | None = None,
    cand_day: str | None = None,
) -> DataFrame:
    """Candidate of the same key with date in ``[day, day + days]`` (inclusive)."""
    return exists_after(
        subjects, candidates, key, day_number(day), cand_key or key, day_number(cand_day or day), -1, days, name
    )


def repeat_contacts(
    subjects: DataFrame,
    identifiers: Mapping[str, str],
    contacts: DataFrame,
    by_channel: Mapping[str, tuple[str, Column]],
    contact_id: str = "contact_id",
    ts: str = "ts",
    endpoint: str = "endpoint",
    min_seconds: int = 30 * 60,
    max_seconds: int = 3 * 86_400,
    keep: Sequence[str] = (),
    part_rows: int | None = PART_ROWS,
) -> DataFrame:
    """Did the customer come back on any channel, by any identifier?  One row per subject contact.

    ``subjects`` (contact_id, ts, one column per identifier) may hold a
    contact several times, once per value of an identifier; ``identifiers``
    maps a label to its column.  ``contacts`` (contact_id, ts, endpoint) are
    the candidates.  A candidate counts when its endpoint equals one of the
    subject's identifiers and its time lies in ``(ts + min, ts + max]``;
    being later than ``min_seconds`` (not negative) it is never the subject
    itself.  ``by_channel`` maps a flag to (identifier label, condition on the
    candidate).  Returns contact_id, the columns to ``keep`` (equal in all
    rows of a contact), ``repeat_any`` and the flags.

    The OR over identifiers is an explode of (contact, identifier), so one
    sweep with conditional minima answers every channel and identifier.
    """
    if min_seconds < 0:
        raise ValueError("a repeat is later than its contact")
    pairs = F.array(*[F.struct(F.lit(label).alias("label"), F.col(c).cast("string").alias("value")) for label, c in identifiers.items()])
    each = subjects.select(contact_id, ts, *keep, F.explode(pairs).alias("_i")).select(contact_id, ts, *keep, F.col("_i.label").alias("_label"), F.col("_i.value").alias("_value"))
    each = each.where(F.col("_value").isNotNull() | (F.col("_label") == next(iter(identifiers))))
    flags = {"repeat_any": F.lit(True)} | {name: cond for name, (_, cond) in by_channel.items()}
    found = exists_after_many(
        each, "_value", micros_of(each, ts), min_seconds * MICROS_PER_SECOND, max_seconds * MICROS_PER_SECOND,
        [(flags, contacts, endpoint, micros_of(contacts, ts))], dedupe=False, part_rows=part_rows, contained=True,
    )
    wanted = {name: F.col(name) & (F.col("_label") == label) for name, (label, _) in by_channel.items()}
    return found.groupBy(contact_id, *keep).agg(
        F.bool_or("repeat_any").alias("repeat_any"), *[F.bool_or(c).alias(n) for n, c in wanted.items()]
    )


def visit_attribution(
    subjects: DataFrame, key: str, day: str, visits: tuple[DataFrame, str, str], outcomes: Mapping[str, tuple[DataFrame, str, str]],
    days: int = 7, part_rows: int | None = PART_ROWS,
) -> DataFrame:
    """Days from each subject to its first later visit and outcomes, and the flags that follow from them.

    ``visits`` and ``outcomes`` are (frame, key, day).  Adds ``visit_after``
    (days to the first visit on or after the subject's day, NULL if none),
    ``visited`` (within ``days``), ``visited_same_day`` and one flag per
    outcome (within ``days``), all from one sweep.
    """
    sets = [(n, f, k, day_number(d)) for n, (f, k, d) in {"visit_after": visits, **outcomes}.items()]
    found = first_after_many(subjects, key, day_number(day), sets, days, -1, dedupe=True, part_rows=part_rows)
    distance = lambda n: F.col(n) - day_number(day)
    within = lambda n, most: F.coalesce(distance(n) <= most, F.lit(False))
    return found.select(
        *subjects.columns,
        distance("visit_after").cast("int").alias("visit_after"),
        within("visit_after", days).alias("visited"),
        within("visit_after", 0).alias("visited_same_day"),
        *[within(n, days).alias(n) for n in outcomes],
    )


def latest_by(df: DataFrame, key: str, ts: str, value: str, tiebreak: str | None = None, name: str | None = None) -> DataFrame:
    """The value of the latest row per key (``QUALIFY ROW_NUMBER() = 1``).

    ``max_by`` over ``struct(ts, tiebreak)`` is a hash aggregate with a
    partial (map-side) step, so a hot key collapses before the shuffle; the
    tiebreak makes ties deterministic (G18).
    """
    order = F.struct(F.col(ts), F.col(tiebreak)) if tiebreak else F.col(ts)
    return df.groupBy(key).agg(F.max_by(F.col(value), order).alias(name or value))


def flag_sums(df: DataFrame, by: Sequence[str], flags: Sequence[str]) -> DataFrame:
    """Sum 0/1 flags per group (``SUM(flag)`` after ``MAX(CASE ...)``)."""
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.col(f).cast("long")).alias(f) for f in flags]
    )
