"""The range-existence sweep equals a brute-force EXISTS on random data."""

import datetime as dt
import random

from pyspark.sql import functions as F

import pytest

from flowmetrics.operators.behaviour import (
    exists_after_many, exists_within_days, exists_within_ts, first_after_many, latest_by, repeat_contacts, sweep_stream, visit_attribution,
)


def _brute(subjects, candidates, lo, hi):
    out = {}
    for sid, k, t in subjects:
        out[sid] = k is not None and any(ck == k and t + lo < ct <= t + hi for ck, ct in candidates)
    return out


def test_sweep_matches_brute_force_timestamps(spark):
    rng = random.Random(7)
    base = dt.datetime(2024, 1, 1)
    keys = [None, "a", "b", "c", "hot"]
    subj = []
    for i in range(300):
        k = "hot" if i % 3 == 0 else rng.choice(keys)
        subj.append((i, k, base + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 10))))
    cands = [(rng.choice(keys[1:]), base + dt.timedelta(minutes=rng.randrange(0, 60 * 24 * 12))) for _ in range(400)]
    cands += [(k, t) for _, k, t in subj[:50] if k]  # exact ties with subjects
    s = spark.createDataFrame(subj, "sid int, k string, ts timestamp")
    c = spark.createDataFrame(cands, "k string, ts timestamp")
    for lo_s, hi_s, parts in [(0, 3 * 86400, None), (1800, 3 * 86400, 20), (0, 6 * 3600, 7), (0, 600, 1), (0, 600, 10**6)]:
        got = {r.sid: r.f for r in exists_within_ts(s, c, "k", "ts", "f", hi_s, lo_s, part_rows=parts).collect()}
        exp = _brute(
            [(i, k, t) for i, k, t in subj],
            cands,
            dt.timedelta(seconds=lo_s),
            dt.timedelta(seconds=hi_s),
        )
        assert got == exp, (lo_s, hi_s, parts)


def test_sweep_matches_brute_force_days(spark):
    rng = random.Random(11)
    base = dt.date(2024, 1, 1)
    subj = [(i, rng.choice(["x", "y", None]), base + dt.timedelta(days=rng.randrange(0, 30))) for i in range(200)]
    cands = [(rng.choice(["x", "y"]), base + dt.timedelta(days=rng.randrange(0, 40))) for _ in range(60)]
    s = spark.createDataFrame(subj, "sid int, k string, d date")
    c = spark.createDataFrame(cands, "k string, d date")
    for days in (0, 1, 7):
        got = {r.sid: r.f for r in exists_within_days(s, c, "k", "d", "f", days).collect()}
        exp = {i: k is not None and any(ck == k and d <= cd <= d + dt.timedelta(days=days) for ck, cd in cands) for i, k, d in subj}
        assert got == exp, days


def test_latest_by_breaks_ties_deterministically(spark):
    t = dt.datetime(2024, 1, 1)
    df = spark.createDataFrame([("p", t, 1, "A"), ("p", t, 2, "B"), ("q", t, 1, "C")], "k string, ts timestamp, id int, v string")
    got = {r.k: r.v for r in latest_by(df, "k", "ts", "v", tiebreak="id").collect()}
    assert got == {"p": "B", "q": "C"}


def test_next_in_order_matches_plain_lead(spark):
    from pyspark.sql import Window
    from pyspark.sql import functions as F

    from flowmetrics.operators.temporal import next_in_order

    rng = random.Random(3)
    base = dt.date(2019, 1, 1)
    rows = []
    for i in range(400):
        k = "hot" if i % 3 == 0 else rng.choice(["a", "b", "c"])
        rows.append((k, i, base + dt.timedelta(days=rng.randrange(0, 1500))))
    df = spark.createDataFrame(rows, "k string, id int, d date")
    got = {r.id: r.nxt for r in next_in_order(df, ["k"], ["d", "id"], "d", F.year("d"), "nxt").collect()}
    exp = {r.id: r.nxt for r in df.select("id", F.lead("d").over(Window.partitionBy("k").orderBy("d", "id")).alias("nxt")).collect()}
    assert got == exp


def test_multi_flag_sweep_equals_single_sweeps(spark):
    from flowmetrics.operators.behaviour import exists_within_ts_many

    rng = random.Random(17)
    base = dt.datetime(2024, 1, 1)
    subj = [(i, rng.choice(["a", "b", None]), base + dt.timedelta(minutes=rng.randrange(0, 9000))) for i in range(200)]
    cands = [(rng.choice(["a", "b"]), rng.choice(["V", "E", "C"]), base + dt.timedelta(minutes=rng.randrange(0, 9000))) for _ in range(300)]
    s = spark.createDataFrame(subj, "sid int, k string, ts timestamp_ntz")
    c = spark.createDataFrame(cands, "k string, ch string, ts timestamp_ntz")
    sets = [(f"f_{ch}", c.where(F.col("ch") == ch), "k", "ts") for ch in ("V", "E", "C")] + [("f_all", c, "k", "ts")]
    many = {r.sid: (r.f_V, r.f_E, r.f_C, r.f_all) for r in exists_within_ts_many(s, "k", "ts", 3 * 3600, 1800, sets).collect()}
    for idx, (name, frame, _, _) in enumerate(sets):
        single = {r.sid: r[name] for r in exists_within_ts(s, frame, "k", "ts", name, 3 * 3600, 1800).collect()}
        assert {sid: v[idx] for sid, v in many.items()} == single, name


def _hot(spark, n=3000):
    """One key with a third of all rows, one without key for another third, positions 0..9999."""
    rng = random.Random(23)
    keys = ["hot", None, *(f"k{i}" for i in range(40))]
    draw = lambda: (rng.choices(keys, [20, 20] + [0.5] * 40)[0], rng.randrange(10_000))
    subj = [(i, *draw()) for i in range(n)] + [(n, "hot", None), (n + 1, "hot", -500), (n + 2, "hot", 99_999), (n + 3, "alone", 1)]
    cand = [(*draw(), rng.choice("ab")) for _ in range(n)] + [("hot", None, "a")]
    return subj, cand, spark.createDataFrame(subj, "sid int, k string, p long"), spark.createDataFrame(cand, "k string, p long, kind string")


@pytest.mark.parametrize("part_rows, contained", [(100, False), (100, True), (17, False), (10**6, False), (None, False)])
def test_hot_key_is_cut_along_time(spark, part_rows, contained):
    subj, cand, s, c = _hot(spark)
    sets = [({"a": F.col("kind") == "a", "any": F.lit(True)}, c, "k", F.col("p"))]
    got = {r.sid: (r.a, r.any) for r in first_after_many(s, "k", F.col("p"), sets, 640, 5, part_rows=part_rows, contained=contained).collect()}
    exp = {}
    for sid, k, p in subj:
        later = [(q, kind) for ck, q, kind in cand if k is not None and p is not None and ck == k and q is not None and q > p + 5]
        exp[sid] = (min((q for q, kind in later if kind == "a"), default=None), min((q for q, _ in later), default=None))
    assert got == exp


def test_no_task_holds_the_hot_key(spark):
    _, _, s, c = _hot(spark, 6000)
    for part_rows, most in ((200, 600), (1000, 2500)):
        stream, _ = sweep_stream(s, "k", F.col("p"), [("f", c, "k", F.col("p"))], 640, part_rows=part_rows)
        sizes = [r["count"] for r in stream.groupBy("_ek", "_part").count().collect()]
        assert sum(sizes) > 8000 and max(sizes) <= most, (part_rows, max(sizes))


def test_flags_of_several_frames_share_a_sweep(spark):
    subj, cand, s, c = _hot(spark)
    sets = [("a", c.where("kind = 'a'"), "k", F.col("p")), ("b", c.where("kind = 'b'"), "k", F.col("p"))]
    got = {r.sid: (r.a, r.b) for r in exists_after_many(s, "k", F.col("p"), -1, 9, sets, part_rows=50).collect()}
    hit = lambda k, p, kind: k is not None and p is not None and any(ck == k and x == kind and q is not None and p - 1 < q <= p + 9 for ck, q, x in cand)
    assert got == {sid: (hit(k, p, "a"), hit(k, p, "b")) for sid, k, p in subj}


def test_repeat_contacts_match_brute_force(spark):
    rng = random.Random(31)
    base = dt.datetime(2024, 1, 1)
    ends = [None, "p1", "p2", "p3", "m1", "m2", "m3"]
    rows = [(i, rng.choice(ends), base + dt.timedelta(minutes=rng.randrange(0, 8000)), rng.choice(["VOICE", "EMAIL", "CHAT"])) for i in range(400)]
    mails = {i: rng.sample(ends[4:], rng.randint(0, 2)) for i, *_ in rows}
    subjects = [(i, e, t, m, "x") for i, e, t, _ in rows[:150] for m in (mails[i] or [None])]
    s = spark.createDataFrame(subjects, "contact_id int, phone string, ts timestamp_ntz, mail string, kept string")
    c = spark.createDataFrame(rows, "contact_id int, endpoint string, ts timestamp_ntz, channel string")
    flags = {"by_voice": ("phone", F.col("channel") == "VOICE"), "by_mail": ("mail", F.col("channel") == "EMAIL")}
    for parts in (None, 20):
        found = repeat_contacts(s, {"phone": "phone", "mail": "mail"}, c, flags, max_seconds=86_400, keep=["kept"], part_rows=parts)
        got = {r.contact_id: (r.kept, r.repeat_any, r.by_voice, r.by_mail) for r in found.collect()}
        exp = {}
        for i, e, t, _ in rows[:150]:
            later = [(x, ch) for j, x, u, ch in rows if j != i and x and t + dt.timedelta(minutes=30) < u <= t + dt.timedelta(days=1)]
            exp[i] = ("x", any(x == e or x in mails[i] for x, _ in later), any(x == e and ch == "VOICE" for x, ch in later), any(x in mails[i] and ch == "EMAIL" for x, ch in later))
        assert got == exp


def test_visit_attribution_gives_distance_and_flags(spark):
    rng = random.Random(37)
    day = lambda: dt.date(2024, 1, 1) + dt.timedelta(days=rng.randrange(40))
    subj = [(i, rng.choice(["x", "y", None]), day()) for i in range(120)]
    visits, done = [(rng.choice("xyz"), day()) for _ in range(12)], [(rng.choice("xyz"), day()) for _ in range(6)]
    s, v, d = spark.createDataFrame(subj, "sid int, k string, d date"), spark.createDataFrame(visits, "a string, vd date"), spark.createDataFrame(done, "a string, vd date")
    got = {r.sid: r for r in visit_attribution(s, "k", "d", (v, "a", "vd"), {"done": (d, "a", "vd")}, days=5).collect()}
    for sid, k, when in subj:
        after = min(((vd - when).days for a, vd in visits if a == k and vd >= when), default=None)
        finished = any(a == k and 0 <= (vd - when).days <= 5 for a, vd in done)
        r = got[sid]
        assert (r.visit_after, r.visited, r.visited_same_day, r.done) == (after, after is not None and after <= 5, after == 0, finished)
