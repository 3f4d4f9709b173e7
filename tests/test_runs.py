"""The composite runs on a small table, worked out by hand."""
from pyspark.sql import functions as F

from eventide.operators.upsert import conform_tracker
from eventide.plans.runs import conference_run, meetup_run, rule_scorer
from eventide.sources.registry import conform_raw

AS_OF = "2026-06-01"  # first week of the month, odd ISO week: both gates are open


def _tracker(spark):
    rows = [("Conferences", 1, 2, "Old Conf 2025", "https://o", "Oslo", "May 1, 2026", "", "keep me"),
            ("Conferences", 2, 3, "Alpha Conf", "https://a", "Berlin", "Sep 1, 2026", "", ""),
            ("Time Passed", 3, 2, "Gone Conf", "https://g", "Rome", "Jan 5, 2026", "Open", ""),
            ("Meet-ups", 4, 2, "Past Meetup", "https://m", "Munich", "May 2, 2026", "", ""),
            ("Meet-ups", 5, 3, "Next Meetup", "https://n", "Munich", "Jul 2, 2026", "", ""),
            ("Excluded", 6, 2, "Bad Conf", "", "", "", "", "")]
    return conform_tracker(spark.createDataFrame(
        rows, "sheet string, row_id long, row_no long, name string, website string, location string, start_date string, "
              "cfp_status string, notes string"))


def _raw(spark, kind):
    rows = [(1, 1, f"alpha {kind}", "", "Hamburg", "Sep 1, 2026", None), (1, 2, f"Bad {kind}", "https://b", "Berlin", "Sep 9, 2026", None),
            (1, 3, f"New {kind}", "https://new", "Munich", "Oct 1, 2026", "Jul 1, 2026"), (2, 1, f"NEW {kind}", "https://x", "Paris", "", None),
            (2, 2, f"Late {kind}", "https://l", "Berlin", "May 20, 2026", None), (2, 3, "Nothing of note", "https://z", "Berlin", "Aug 1, 2026", None)]
    df = spark.createDataFrame(rows, "source_rank int, ord long, name string, website string, raw_location string, "
                                     "raw_start_date string, cfp_date string").withColumn("source", F.lit("S"))
    return conform_raw(df)


def test_conference_run(spark):
    cand = spark.createDataFrame([(9, "Gone Conf", "", "Jan 6, 2027", "", "", "", "high", True, "seen")],
                                 "cand_id long, base_name string, name string, start_date string, end_date string, location string, "
                                 "website string, confidence string, future_edition_found boolean, evidence string")
    facts = spark.createDataFrame([("New Conf", 1, "Open", "Aug 1, 2026", "https://cfp", "high"),
                                   ("Alpha Conf", 2, "Open", "May 1, 2026", "", "high")],
                                  "key string, ord long, cfp_status string, cfp_deadline string, cfp_url string, confidence string")
    res = conference_run(_tracker(spark), _raw(spark, "Conf"), rule_scorer(["conf"], AS_OF), AS_OF, cand, facts)
    rows = {(r.sheet, r["name"]): r for r in res.tracker.collect()}
    assert set(rows) == {("Conferences", "Alpha Conf"), ("Conferences", "New Conf"), ("Conferences", "Gone Conf 2027"),
                         ("Time Passed", "Old Conf 2025"), ("Time Passed", "Gone Conf"), ("Time Passed", "Late Conf"),
                         ("Meet-ups", "Past Meetup"), ("Meet-ups", "Next Meetup"), ("Excluded", "Bad Conf")}
    assert rows["Time Passed", "Old Conf 2025"].notes == "keep me"
    alpha, new = rows["Conferences", "Alpha Conf"], rows["Conferences", "New Conf"]
    assert (alpha.location, alpha.row_id, alpha.website) == ("Hamburg", 2, "https://a")
    assert alpha.cfp_status == "Closed"  # open, but its deadline is over
    assert (new.website, new.location, new.cfp_status, new.cfp_date) == ("https://new", "Munich", "Open", "Aug 1, 2026")
    ids = [r.row_id for r in rows.values()]
    assert len(ids) == len(set(ids))
    counts = {(r.source, r.outcome): r.n for r in res.metrics.collect()}
    assert (counts["S", "blocked"], counts["S", "relevant"], counts["S", "rejected"]) == (1, 4, 1)
    assert {(r.sheet, r.rows) for r in res.routed.collect()} == {("Conferences", 3), ("Time Passed", 1)}


def test_meetup_run(spark):
    scorer = rule_scorer(["meetup"], AS_OF, type_rules=[("meetup", ["meetup"])])
    res = meetup_run(_tracker(spark), _raw(spark, "Meetup"), scorer, AS_OF,
                     rules=[("Munich", ["munich"]), ("Hamburg", ["hamburg"])])
    got = sorted((r.sheet, r["name"], r.location) for r in res.tracker.where("sheet = 'Meet-ups'").collect())
    assert got == [("Meet-ups", "New Meetup", "Munich"), ("Meet-ups", "Next Meetup", "Munich"), ("Meet-ups", "alpha Meetup", "Hamburg")]
    assert res.tracker.where("name = 'Past Meetup'").count() == 0
    carried = rule_scorer(["meetup"], AS_OF, carry_hints=True)(_raw(spark, "Meetup")).where("name = 'New Meetup'").collect()[0]
    dropped = rule_scorer(["meetup"], AS_OF)(_raw(spark, "Meetup")).where("name = 'New Meetup'").collect()[0]
    assert (carried.cfp_date, dropped.cfp_date) == ("Jul 1, 2026", None)
