"""The golden case, and random inputs against the rules' model."""
import random

from pyspark.sql import functions as F

from eventide.operators.upsert import conform_tracker, upsert
from eventide.schema import MANAGED_FIELDS

from models import TrackerModel

def test_golden_case(spark):
    ex = conform_tracker(spark.createDataFrame(
        [("Conferences", 1, 2, "Alpha", "u1", "Berlin", "Jun 1, 2026", "Jun 2, 2026", 2, "keep")],
        "sheet string,row_id long,row_no int,name string,website string,location string,start_date string,"
        "end_date string,days int,notes string"))
    inc = spark.createDataFrame(
        [(1, "alpha ", None, "Munich", None, None), (2, "Alpha", None, "Berlin", None, None),
         (3, "Other", "U1", None, None, "Jun 5, 2026"), (4, "Beta", "u9", None, "2026-07-01", None),
         (5, "beta", "u10", None, None, None)],
        "ord long,name string,website string,location string,start_date string,end_date string")
    r = upsert(ex, inc, "Conferences")
    snap = {x.name: x for x in r.snapshot.collect()}
    a = snap["Alpha"]
    assert (a.location, a.end_date, a.days, a.website, a.notes) == ("Munich", "Jun 5, 2026", 5, "u1", "keep")
    assert snap["Beta"].days is None and set(snap) == {"Alpha", "Beta"}
    c = r.counts.collect()[0]
    assert (c.added, c.updated) == (1, 2)


def random_case(spark, seed):
    rnd = random.Random(seed)
    names = ["Alpha", "alpha ", "Beta", "", "Gamma", "BETA"]
    urls = ["u1", "U1", "u2", "", "u3", "alpha"]
    vals = ["", "x", "y", " x "]
    dates = ["", "Jun 1, 2026", "2026-06-03", "June 5, 2026", "Jun 7 2026", "TBC"]
    existing = []
    for i in range(6):
        existing.append(dict(sheet="Conferences", row_id=100 + i, row_no=2 + i, name=rnd.choice(names[:3] + ["Delta"]),
                             website=rnd.choice(urls), category=rnd.choice(vals), cfp_date="", cfp_status=rnd.choice(vals),
                             location=rnd.choice(vals), start_date=rnd.choice(dates), end_date=rnd.choice(dates),
                             days=None, notes=f"n{i}"))
    events = []
    for i in rnd.sample(range(100), 14):
        events.append(dict(ord=i, name=rnd.choice(names), website=rnd.choice(urls), category=rnd.choice(vals),
                           cfp_date="", cfp_status=rnd.choice(vals), location=rnd.choice(vals),
                           start_date=rnd.choice(dates), end_date=rnd.choice(dates)))
    return existing, events


def test_random_against_model(spark):
    cols = ["sheet", "row_id", "row_no", "name", "website", "category", "cfp_date", "cfp_status", "location",
            "start_date", "end_date", "days", "notes"]
    ecols = ["ord", "name", "website", "category", "cfp_date", "cfp_status", "location", "start_date", "end_date"]
    for seed in range(4):
        existing, events = random_case(spark, seed)
        ex = conform_tracker(spark.createDataFrame([tuple(r[c] for c in cols) for r in existing],
                                                   "sheet string,row_id long,row_no int,name string,website string,"
                                                   "category string,cfp_date string,cfp_status string,location string,"
                                                   "start_date string,end_date string,days int,notes string"))
        inc = spark.createDataFrame([tuple(e[c] for c in ecols) for e in events],
                                    "ord long,name string,website string,category string,cfp_date string,"
                                    "cfp_status string,location string,start_date string,end_date string")
        res = upsert(ex, inc, "Conferences")
        want_rows, want_fresh, want_upd = TrackerModel(existing, MANAGED_FIELDS).run(events)
        got = {r.row_id: r for r in res.snapshot.collect()}
        for rid, w in want_rows.items():
            g = got[rid]
            for f in MANAGED_FIELDS + ["days"]:
                assert (g[f] or None) == (w[f] or None), (seed, rid, f)
        fresh = sorted(((r.name, r.website) for r in res.snapshot.collect() if r.row_id not in want_rows))
        assert fresh == sorted(want_fresh), seed
        c = res.counts.collect()[0]
        assert (c.added, c.updated) == (len(want_fresh), want_upd)


def test_upsert_twice_is_stable(spark):
    """With at most one input per existing row (the case where the reference's
    last-differing-value rule is idempotent), a second upsert changes nothing."""
    ex = conform_tracker(spark.range(0, 40).select(
        F.lit("Conferences").alias("sheet"), F.col("id").alias("row_id"), (F.col("id") + 2).cast("int").alias("row_no"),
        F.concat(F.lit("Event "), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("https://e.example/"), F.col("id").cast("string")).alias("website"),
        F.lit("Old town").alias("location"), F.lit("Jun 1, 2026").alias("start_date"),
        F.lit("Jun 2, 2026").alias("end_date"), F.lit(2).alias("days")))
    inc = spark.range(20, 70).select(
        F.col("id").alias("ord"), F.concat(F.lit(" event "), F.col("id").cast("string")).alias("name"),
        F.concat(F.lit("https://n.example/"), F.col("id").cast("string")).alias("website"),
        F.when(F.col("id") % 2 == 0, F.lit("New town")).otherwise(F.lit("")).alias("location"),
        F.when(F.col("id") % 3 == 0, F.lit("Jun 9, 2026")).otherwise(F.lit("")).alias("end_date"))
    first = upsert(ex, inc, "Conferences")
    c1 = first.counts.collect()[0]
    assert c1.added == 30 and c1.updated > 0
    second = upsert(first.snapshot, inc, "Conferences")
    c2 = second.counts.collect()[0]
    assert (c2.added, c2.updated) == (0, 0)
    cols = ["row_id", "name", "location", "start_date", "end_date", "website", "days"]
    a = sorted(tuple(r) for r in first.snapshot.select(*cols).collect())
    b = sorted(tuple(r) for r in second.snapshot.select(*cols).collect())
    assert a == b


def test_repeated_order_is_an_error(spark):
    import pytest

    inc = spark.createDataFrame([(1, "a"), (1, "b")], "ord long, name string")
    with pytest.raises(ValueError, match="same value twice"):
        upsert(conform_tracker(spark.createDataFrame([], "sheet string, row_id long, row_no long")), inc, "Conferences")
