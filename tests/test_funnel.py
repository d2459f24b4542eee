"""Journey weights reproduce full-outer-join fan-out exactly (random data, NULL keys)."""

import random

from pyspark.sql import functions as F

from flowmetrics.operators.funnel import conversion_stats, journey_weights


def test_weights_equal_naive_full_outer_join(spark):
    rng = random.Random(5)
    keys = [None, 1, 2, 3, 4, 5, 6, 7, 8]
    offers = [(rng.choice(keys), rng.choice(["EMAIL", "SMBP", "LETTER", None])) for _ in range(60)]
    waiting = [(k,) for k in {rng.choice(keys) for _ in range(6)}] + [(None,)]
    bookings = [(rng.choice(keys), rng.choice(["Completed", "Aborted", "Pending", "Cancelled"])) for _ in range(40)]
    o = spark.createDataFrame(offers, "billing_account_id int, offer_channel string")
    w = spark.createDataFrame(waiting, "billing_account_id int")
    b = spark.createDataFrame(bookings, "billing_account_id int, outcome string")
    o.createOrReplaceTempView("t_offers")
    w.createOrReplaceTempView("t_wait")
    b.createOrReplaceTempView("t_book")
    naive = spark.sql(
        """
        select case when wl.billing_account_id is not null then 'Waiting List' else 'Direct' end as entry_path,
               coalesce(o.offer_channel, 'No Offer') as offer_channel,
               count(*) as total_customers,
               sum(case when b.billing_account_id is not null then 1 else 0 end) as booked_count,
               sum(case when b.outcome = 'Completed' then 1 else 0 end) as completed_count
        from t_offers o
        full outer join t_wait wl on o.billing_account_id = wl.billing_account_id
        full outer join t_book b on coalesce(o.billing_account_id, wl.billing_account_id) = b.billing_account_id
        group by 1, 2
        """
    )
    got = {
        (r.entry_path, r.offer_channel, r.total_customers, r.booked_count, r.completed_count)
        for r in conversion_stats(journey_weights(o, w, b)).collect()
    }
    exp = {tuple(r) for r in naive.collect()}
    assert got == exp


def test_weights_sum_to_joined_row_count(spark):
    o = spark.createDataFrame([(1, "EMAIL"), (1, "EMAIL"), (1, "SMBP"), (2, "EMAIL")], "billing_account_id int, offer_channel string")
    w = spark.createDataFrame([(1,), (3,)], "billing_account_id int")
    b = spark.createDataFrame([(1, "Completed"), (1, "Pending"), (4, "Aborted")], "billing_account_id int, outcome string")
    total = journey_weights(o, w, b).agg(F.sum("weight")).first()[0]
    # account 1: 3 offers x 2 bookings = 6; account 2: 1; account 3: 1; account 4: 1
    assert total == 9


def test_cohort_churn_multiplicities_equal_naive_left_join(spark):
    from flowmetrics.operators.cohort import cohort_churn

    rng = random.Random(9)
    accts = [(f"A{i}", rng.choice(["Opted In", "Opted Out", "Unknown"])) for i in range(30)]
    cancels = list({(rng.choice([None] + [f"A{i}" for i in range(40)]), rng.randrange(5), rng.choice(["x", "y"])) for _ in range(50)})
    a = spark.createDataFrame(accts, "account_number string, consent_status string")
    c = spark.createDataFrame(cancels, "account_number string, d int, reason string")
    a.createOrReplaceTempView("t_acc")
    c.createOrReplaceTempView("t_can")
    naive = spark.sql(
        """select consent_status, count(*) as n, sum(case when c.account_number is not null then 1 else 0 end) as churned
           from t_acc a left join (select distinct * from t_can) c on a.account_number = c.account_number
           group by consent_status"""
    )
    got = {(r.consent_status, r.active_at_period_start, r.churned_count) for r in cohort_churn(a, c.distinct(), "account_number", "consent_status").collect()}
    assert got == {tuple(r) for r in naive.collect()}


def test_seen_in_previous_days_equals_naive_exists(spark):
    import datetime as dt

    from flowmetrics.operators.flows import seen_in_previous_days

    rng = random.Random(13)
    base = dt.date(2024, 1, 1)
    rows = [(i, rng.choice([None, "p1", "p2", "p3"]), base + dt.timedelta(days=rng.randrange(0, 20))) for i in range(150)]
    df = spark.createDataFrame(rows, "id int, phone string, day date")
    got = {r.id: r.is_return for r in seen_in_previous_days(df, "phone", "day", lo=5, hi=1).collect()}
    exp = {
        i: p is not None and any(q == p and d - dt.timedelta(days=5) <= e <= d - dt.timedelta(days=1) for _, q, e in rows)
        for i, p, d in rows
    }
    assert got == exp


DIM_NAMES = [
    "offer_channel", "first_contact_week", "first_contact_month", "offer_week", "offer_month",
    "registration_week", "appointment_week", "appointment_month",
]


def test_funnel_with_dims_equals_naive_count_distinct(spark):
    """Deduplicating each side before the joins gives the same COUNT DISTINCT as the naive join."""
    import datetime as dt

    from flowmetrics.functions.core import week_label
    from flowmetrics.operators.funnel import first_touch, funnel_with_dims

    rng = random.Random(21)
    base = dt.date(2024, 1, 1)

    def day():
        return rng.choice([None, base + dt.timedelta(days=rng.randrange(0, 60))])

    wl = [(k, base + dt.timedelta(days=rng.randrange(0, 30))) for k in range(1, 12)] * 2
    offers = [(rng.randrange(0, 14), rng.choice(["EMAIL", "SMBP"]), day()) for _ in range(30)]
    books = [(rng.randrange(0, 14), day(), day(), rng.choice(["Completed", "Pending", None])) for _ in range(25)]
    w = spark.createDataFrame(wl, "billing_account_id int, registration_date date")
    o = spark.createDataFrame(offers, "billing_account_id int, offer_channel string, offer_date date")
    b = spark.createDataFrame(books, "billing_account_id int, booking_date date, appointment_date date, outcome string")

    k = "billing_account_id"
    j = (
        w.join(o.withColumn("_o", F.lit(True)), k, "left")
        .join(b.withColumn("_b", F.lit(True)), k, "left")
    )
    fc = first_touch("registration_date", "offer_date", "booking_date")
    month = lambda c: F.date_format(c, "yyyy-MM")
    dims = [
        F.coalesce(F.col("offer_channel"), F.lit("Not Yet Offered")).alias("offer_channel"),
        F.coalesce(week_label(fc), F.lit("N/A")).alias("first_contact_week"),
        F.coalesce(month(fc), F.lit("N/A")).alias("first_contact_month"),
        F.coalesce(week_label("offer_date"), F.lit("N/A")).alias("offer_week"),
        F.coalesce(month("offer_date"), F.lit("N/A")).alias("offer_month"),
        F.coalesce(week_label("registration_date"), F.lit("N/A")).alias("registration_week"),
        F.coalesce(week_label("appointment_date"), F.lit("N/A")).alias("appointment_week"),
        F.coalesce(month("appointment_date"), F.lit("N/A")).alias("appointment_month"),
    ]
    stages = F.array_compact(F.array(F.lit(1), F.when(F.col("_o"), 2), F.when(F.col("_b"), 3), F.when(F.col("outcome") == "Completed", 4)))
    naive = (
        j.where(fc.isNotNull())
        .select(k, *dims, F.explode(stages).alias("stage_number"))
        .groupBy("stage_number", *DIM_NAMES)
        .agg(F.count_distinct(k).alias("customers"))
    )
    cols = ["stage_number", *DIM_NAMES, "customers"]
    got = {tuple(r[c] for c in cols) for r in funnel_with_dims(w, o, b).collect()}
    exp = {tuple(r[c] for c in cols) for r in naive.collect()}
    assert got == exp and len(got) > 10
