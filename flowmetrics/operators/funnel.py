"""Funnel and conversion operators.

Stage membership is computed per entity (one row per account per side,
pre-aggregated before any join), so joins never fan out and a hot account
collapses in the map-side partial aggregate.  Where the reference's
semantics *do* depend on join fan-out (full-outer journey rows, G12), the
fan-out is reproduced as integer multiplicities instead of materialised
row pairs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.core import classify, col, count_if, pct, week_label

# --- fixed values that must equal the documented definitions -------------
PENDING_STATUSES = ("BOOKED", "RESCHEDULED", "STARTED", "ON_SITE", "ON_ROUTE", "PAUSED")
COMPLETED_VARIANT = "Completed - Install & Leave"
# -------------------------------------------------------------------------


def normalise_status(primary: str | Column, fallback: str | Column) -> Column:
    """Outcome from ``COALESCE(primary, fallback)`` (NULL => Pending)."""
    s = F.coalesce(col(primary), col(fallback))
    return classify(
        [
            ((F.upper(s) == "COMPLETED") | (s == COMPLETED_VARIANT), "Completed"),
            (F.upper(s) == "ABORTED", "Aborted"),
            (F.upper(s) == "CANCELLED", "Cancelled"),
            (s.isin(*PENDING_STATUSES), "Pending"),
            (s.isNull(), "Pending"),
        ],
        "Other",
    )


def is_completed(primary: str | Column, fallback: str | Column) -> Column:
    s = F.coalesce(col(primary), col(fallback))
    return (F.upper(s) == "COMPLETED") | (s == COMPLETED_VARIANT)


def first_touch(*cols: str | Column, sentinel: str = "9999-12-31") -> Column:
    """Earliest of several dates; NULL when all are missing.

    Spark's ``least`` skips NULLs (the warehouse's returns NULL), so the
    sentinel only marks "none" and is mapped back to NULL.
    """
    s = F.lit(sentinel).cast("date")
    m = F.least(*[F.coalesce(col(c).cast("date"), s) for c in cols])
    return F.when(m != s, m)


def stage_counts(flags: DataFrame, stages: Sequence[tuple[str, Column]]) -> DataFrame:
    """A10: ``(stage_number, stage_name, customers, pct_of_start, conversion_from_prev)``.

    ``flags`` has one row per entity; each stage is a boolean over it.  One
    global aggregate computes every stage count; ``stack`` turns it into
    rows (J19); ``first``/``lag`` run over the handful of stage rows.
    """
    agg = flags.agg(*[F.sum(cond.cast("long")).alias(f"s{i}") for i, (_, cond) in enumerate(stages, 1)])
    args = ", ".join(f"{i}, '{name}', coalesce(s{i}, 0)" for i, (name, _) in enumerate(stages, 1))
    rows = agg.selectExpr(f"stack({len(stages)}, {args}) as (stage_number, stage_name, customers)")
    w = Window.orderBy("stage_number")
    return rows.select(
        "stage_number",
        "stage_name",
        F.col("customers").cast("long").alias("customers"),
        pct(F.col("customers"), F.first("customers").over(w)).alias("pct_of_start"),
        pct(F.col("customers"), F.lag("customers").over(w)).alias("conversion_from_prev"),
    ).orderBy("stage_number")


def journey_weights(
    offers: DataFrame,
    waiting: DataFrame,
    bookings: DataFrame,
    key: str = "billing_account_id",
    channel: str = "offer_channel",
    outcome: str = "outcome",
    dims: Sequence[str] = (),
    offer_dims: Sequence[str] = (),
    booking_dims: Sequence[str] = (),
) -> DataFrame:
    """Rows of ``offers FULL JOIN waiting FULL JOIN bookings`` as weights.

    Returns ``(key, entry_path, offer_channel, booked, outcome, weight, *dims)``
    where ``weight`` is the number of joined rows the reference would
    produce for that combination: offers are counted per (key, channel),
    waiting-list rows and bookings per key (and outcome), then the three
    small aggregates are joined on the key and multiplied.
    """
    o = offers.groupBy(key, channel, *offer_dims).agg(F.count(F.lit(1)).alias("_no"))
    w = waiting.groupBy(key, *dims).agg(F.count(F.lit(1)).alias("_nw"))
    b = bookings.groupBy(key, outcome, *booking_dims).agg(F.count(F.lit(1)).alias("_nb"))
    left = o.join(w, key, "full").select(
        key,
        # Entry tests the waiting-list key (a NULL-keyed row is "Direct"), as documented.
        F.when(F.col("_nw").isNotNull() & F.col(key).isNotNull(), "Waiting List").otherwise("Direct").alias("entry_path"),
        F.col(channel).alias("offer_channel"),
        (F.coalesce("_no", F.lit(1)) * F.coalesce("_nw", F.lit(1))).alias("_nl"),
        *dims,
        *offer_dims,
    )
    j = left.join(b, key, "full")
    return j.select(
        key,
        F.coalesce("entry_path", F.lit("Direct")).alias("entry_path"),
        "offer_channel",
        # "booked" tests the booking's key, as the documented CASE does: a
        # booking whose key is NULL joins nothing and counts as not booked.
        (F.col("_nb").isNotNull() & F.col(key).isNotNull()).alias("booked"),
        F.col(outcome).alias("outcome"),
        (F.coalesce("_nl", F.lit(1)) * F.coalesce("_nb", F.lit(1))).cast("long").alias("weight"),
        *dims,
        *offer_dims,
        *booking_dims,
    )


def conversion_stats(weights: DataFrame) -> DataFrame:
    """Booking, completion-of-booked and end-to-end rates per entry x channel."""

    def wsum(cond: Column) -> Column:
        return F.sum(F.when(cond, F.col("weight")).otherwise(F.lit(0))).cast("long")

    agg = weights.groupBy("entry_path", F.coalesce("offer_channel", F.lit("No Offer")).alias("offer_channel")).agg(
        F.sum("weight").cast("long").alias("total_customers"),
        wsum(F.col("booked")).alias("booked_count"),
        wsum(F.col("outcome") == "Completed").alias("completed_count"),
        wsum(F.col("outcome") == "Aborted").alias("aborted_count"),
        wsum(F.col("outcome") == "Cancelled").alias("cancelled_count"),
        wsum(F.col("outcome") == "Pending").alias("pending_count"),
    )
    return agg.select(
        "entry_path",
        "offer_channel",
        "total_customers",
        "booked_count",
        pct("booked_count", "total_customers").alias("booking_rate_pct"),
        "completed_count",
        pct("completed_count", "booked_count").alias("completion_rate_of_booked_pct"),
        pct("completed_count", "total_customers").alias("end_to_end_completion_pct"),
        "aborted_count",
        "cancelled_count",
        "pending_count",
    ).orderBy("entry_path", "offer_channel")


def calendar_bucket(c: str | Column) -> Column:
    """First day of the part of an ISO week that lies in one month.

    Week label and month of a date are those of its bucket, and the bucket
    of the earliest of several dates is the earliest of their buckets; so
    dates may be reduced to buckets before they are joined or compared.
    """
    c = col(c).cast("date")
    return F.greatest(F.trunc(c, "week"), F.trunc(c, "month"))


def bucket_labels(bucket: str, week: str, month: str, missing: str = "N/A") -> list[Column]:
    """Week label and month of a calendar bucket."""
    return [F.coalesce(week_label(bucket), F.lit(missing)).alias(week), F.coalesce(F.date_format(bucket, "yyyy-MM"), F.lit(missing)).alias(month)]


def funnel_with_dims(
    waiting: DataFrame,
    offers: DataFrame,
    bookings: DataFrame,
    key: str = "billing_account_id",
) -> DataFrame:
    """Distinct accounts per funnel stage and filter dimensions.

    ``waiting`` (key, registration_date), ``offers`` (key, offer_channel,
    offer_date), ``bookings`` (key, booking_date, appointment_date,
    outcome).  The dimensions are weeks and months, so each side is first
    reduced to distinct calendar buckets per account: what meets in the
    joins of an account is bounded by the calendar, however many rows it
    has.  An account is then counted once per cell of the dimensions, where
    it is already partitioned by account, and the four stages are four
    counts of the cell: labels and stage rows are made from the result.
    """
    wl = waiting.select(key, calendar_bucket("registration_date").alias("_r")).distinct()
    o = offers.where(F.col(key).isNotNull()).select(key, "offer_channel", calendar_bucket("offer_date").alias("_o")).distinct()
    done = F.coalesce(F.col("outcome") == "Completed", F.lit(False))
    b = bookings.where(F.col(key).isNotNull()).select(key, calendar_bucket("booking_date").alias("_b"), calendar_bucket("appointment_date").alias("_a"), done.alias("_done"))
    b = b.groupBy(key, "_b", "_a").agg(F.bool_or("_done").alias("_done"))
    j = wl.join(o.withColumn("_offered", F.lit(True)), key, "left").join(b.withColumn("_booked", F.lit(True)), key, "left")
    # a week alone may hold two buckets, so the registration is grouped by its label
    cell = ["offer_channel", "_first", "_o", "registration_week", "_a"]
    j = j.withColumns({"_first": F.least("_r", "_o", "_b"), "registration_week": week_label("_r")}).where(F.col("_first").isNotNull())
    per_account = j.groupBy(key, *cell).agg(*[F.coalesce(F.bool_or(f), F.lit(False)).alias(f) for f in ("_offered", "_booked", "_done")])
    counts = [F.col(key).isNotNull(), F.col("_offered"), F.col("_booked"), F.col("_done")]
    cells = per_account.groupBy(*cell).agg(*[count_if(c).alias(f"_s{i}") for i, c in enumerate(counts, 1)])
    names = ["1. SMBP No Slots → Waitlist", "2. Offered Slot", "3. Booked", "4. Completed"]
    stages = [F.struct(F.lit(i).alias("number"), F.lit(n).alias("name"), F.col(f"_s{i}").alias("customers")) for i, n in enumerate(names, 1)]
    # every cell has its first stage, and each later one that an account reached
    taken = F.array_compact(F.array(stages[0], *[F.when(F.col(f"_s{i}") > 0, st) for i, st in enumerate(stages[1:], 2)]))
    return (
        cells.select(*cell, F.explode(taken).alias("_s"))
        .select(
            F.col("_s.number").alias("stage_number"),
            F.col("_s.name").alias("stage_name"),
            F.coalesce("offer_channel", F.lit("Not Yet Offered")).alias("offer_channel"),
            *bucket_labels("_first", "first_contact_week", "first_contact_month"),
            *bucket_labels("_o", "offer_week", "offer_month"),
            F.coalesce("registration_week", F.lit("N/A")).alias("registration_week"),
            *bucket_labels("_a", "appointment_week", "appointment_month"),
            F.col("_s.customers").alias("customers"),
        )
        .orderBy("stage_number", "offer_channel", "first_contact_week")
    )
