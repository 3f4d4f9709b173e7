"""Calendars and replies are read once, and reduced before they are joined."""
from pyspark.sql import functions as F

from eventide.functions.jsonx import is_one_object
from eventide.operators.match import key_set
from eventide.sources.ical import scan_calendars, vevents
from eventide.sources.replies import discovered_events


def _optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _event(*lines):
    return "\r\n".join(["BEGIN:VEVENT", *lines, "END:VEVENT"])


def _calendars(spark):
    a = [_event("SUMMARY:One\\, two", "DTSTART;TZID=America/Los_Angeles:20240120T230000", "DTEND:20240122",
                "BEGIN:VALARM", "SUMMARY:alarm", "END:VALARM", "LOCATION:", "URL:https://a"),
         _event("SUMMARY;X=\"a:b\":Three", "DTSTART;VALUE=DATE:20240130", "DESCRIPTION:long", "  text"),
         _event("SUMMARY:Past", "DTSTART:20230101"), _event("SUMMARY:No start"), _event("DTSTART:20240120")]
    b = [_event("SUMMARY:three", "DTSTART:20240116T100000Z"), _event("SUMMARY:one, TWO", "DTSTART:20240117")]
    feeds = spark.createDataFrame([("a", "\r\n".join(a)), ("b", "\r\n".join(b)), ("unlisted", b[0])], "path string, value string")
    reg = spark.createDataFrame([("a", "A", "At A", 2), ("b", "B", "At B", 1)],
                                "path string, label string, default_location string, rank long")
    return feeds, reg


def test_calendars(spark):
    feeds, reg = _calendars(spark)
    first = {r["name"]: r for r in vevents(feeds).where("path = 'a'").collect()}
    assert set(first) == {"One, two", "Three", "Past", "No start", ""}
    assert (first["One, two"].tzid, first["One, two"].location, first["Three"].url) == ("America/Los_Angeles", "", "")
    assert first["No start"].dtstart is None and first["No start"].tzid == "" and first["No start"].dtend is None
    assert first["Three"].description == "long text" and first["Three"].dtstart == "20240130"
    got = scan_calendars(feeds, reg, "2024-01-15")
    assert sorted((r["name"], r.source, r.raw_location, r.raw_start_date) for r in got.collect()) == [
        ("one, TWO", "iCal (B)", "At B", "Jan 17, 2024"), ("three", "iCal (B)", "At B", "Jan 16, 2024")]


def test_an_event_is_cut_out_once_and_the_registry_meets_documents(spark):
    feeds, reg = _calendars(spark)
    plan = _optimized(scan_calendars(feeds, reg, "2024-01-15"))
    assert plan.count("BEGIN:([A-Z-]+)") == 1  # the filter on name and start reads what was found
    assert plan.index("Generate posexplode") < plan.index("Join Inner")  # the join lies below


def test_items_are_reduced_before_they_meet_the_known_names(spark):
    text = '{"events":[{"name":"New"},{"name":" known "},{"name":"NEW "},{"name":""},{"name":"Other"}]}'
    replies = spark.createDataFrame([(2, "discovery", 0, "b", text), (1, "discovery", 0, "a", '{"events":[{"name":"other"}]}')],
                                    "reply_id long, kind string, search_rank int, label string, text string")
    known = key_set(spark.createDataFrame([("Known",)], "n string"), "n")
    found = discovered_events(replies, known)
    assert sorted((r["name"], r.source) for r in found.collect()) == [("New", "Web discovery (b)"), ("other", "Web discovery (a)")]
    plan = _optimized(found.select("name"))
    assert plan.index("Join LeftAnti") < plan.index("Aggregate")  # the aggregate lies below


def test_one_strict_object(spark):
    mark = "EndOfTheOneObject"
    escaped = "\\u0045" + mark[1:]
    whole = ['{}', '{"a":[1,{"b":null}]}', f'{{"a":"{mark}"}}', f'{{"a":"{escaped}"}}', '{"a":"\\u00e9 ]"}']
    broken = ['{},{}', '{}] , [{}', '{} {}', '{"a":1}}', '{"a":1', '{"a":}', '{\'a\':1}', f'{{}},"{mark}"],[{{}}', f'{{}},"{escaped}"],[{{}}',
              f'{{}},"{mark}",{{}}', '[{}]', '{"a":1}, "b": {}', '{}, null, {}', "{}\n,[1],{}"]
    rows = spark.createDataFrame([(t, True) for t in whole] + [(t, False) for t in broken] + [(None, False)], "t string, want boolean")
    got = rows.select("t", "want", is_one_object(F.col("t")).alias("one")).collect()
    assert [(r.t, r.one) for r in got] == [(r.t, r.want) for r in got]
