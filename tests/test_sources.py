"""Sheet read, calendar scan and the two HTML engines."""
import datetime as dt

from pyspark.sql import functions as F

from eventide.sources.html import anchors_dom, anchors_native, cards_dom, headings_native
from eventide.sources.ical import scan_calendars
from eventide.sources.sheet import read_sheet


def test_sheet_golden(spark):
    rows = spark.createDataFrame(
        [("S", 1, ["", " Name ", "Website", "Notes"]), ("S", 2, ["", " Alpha "]), ("S", 3, ["", "", "u"]),
         ("S", 4, ["", "B", "u", "n", "extra"])], "sheet string, row_no int, cells array<string>")
    got = sorted(tuple(r) for r in read_sheet(rows, ["name", "website", "notes"]).collect())
    assert got == [("S", 2, "Alpha", "", ""), ("S", 4, "B", "u", "n")]


def _ics(events):
    body = "".join(events)
    return f"BEGIN:VCALENDAR\r\nVERSION:2.0\r\n{body}END:VCALENDAR\r\n"


def _ev(summary=None, start=None, loc=None):
    lines = ["BEGIN:VEVENT"]
    if summary:
        lines.append(f"SUMMARY:{summary}")
    if start:
        lines.append(f"DTSTART;VALUE=DATE:{start}")
    if loc:
        lines.append(f"LOCATION:{loc}")
    lines.append("END:VEVENT")
    return "\r\n".join(lines) + "\r\n"


def test_calendar_golden(spark):
    f1 = _ics([_ev("Early", "20260531"), _ev("Late", "20261129"), _ev("First day", "20260601"),
               _ev("Day 180", "20261128", "Berlin"), _ev(None, "20260610"), _ev("No start", None),
               _ev("Dup\\, Name", "20260615")])
    f2 = _ics([_ev("dup, name", "20260616"), _ev("Other", "20260617")])
    feeds = spark.createDataFrame([("f1", f1), ("f2", f2)], "path string, value string")
    reg = spark.createDataFrame([("f1", "One", "San Francisco, USA", 1), ("f2", "Two", "Munich, Germany", 2)],
                                "path string, label string, default_location string, rank int")
    out = {r.name: r for r in scan_calendars(feeds, reg, "2026-06-01").collect()}
    assert set(out) == {"First day", "Day 180", "Dup, Name", "Other"}
    assert out["Day 180"].raw_location == "Berlin" and out["First day"].raw_location == "San Francisco, USA"
    assert out["Dup, Name"].source == "iCal (One)" and out["Other"].raw_location == "Munich, Germany"
    assert out["First day"].raw_start_date == "Jun 01, 2026"


def test_dom_and_native_anchor_engines_agree(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    a = sorted((r.page_id, r.ord, r.href, r.text) for r in anchors_native(pages).collect())
    b = sorted((r.page_id, r.ord, r.href, r.text) for r in anchors_dom(pages).collect())
    assert a == b and len(a) > 0


def test_cards_dom_finds_heading_and_slug(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    cards = cards_dom(pages, heading_tag="h1")
    heads = {r.page_id: r.title for r in headings_native(pages).collect()}
    native_slug = {}
    for r in anchors_native(pages).where(F.col("href").rlike(r"^/[a-zA-Z0-9_-]{4,}$")).collect():
        if r.page_id not in native_slug or r.ord < native_slug[r.page_id][0]:
            native_slug[r.page_id] = (r.ord, r.href)
    got = cards.collect()
    assert got
    for c in got:
        assert c.title == heads[c.page_id]
        assert c.href == native_slug.get(c.page_id, (None, None))[1]
        assert len(c.card_text) > 0


def _pages(spark, *htmls):
    return spark.createDataFrame([(i, "https://h.example/p", h) for i, h in enumerate(htmls)], "page_id long, url string, html string")


def test_markup_that_pages_really_have(spark):
    from eventide.sources.html import anchors

    mixed = ("<p><a href='/one'>1</a> <a href=/two>2</a><!-- <a href=\"/gone\">x</a> -->"
             "<a href=\"/caf&eacute;\">caf&eacute;&nbsp;x</a><script>var s = '<a href=\"/no\">n</a>';</script>")
    plain = '<ul><li><a href="/x">X</a></li><li><a href="/y">Y</a></li></ul>'
    nested = '<a href="/a">A <a href="/b">B</a></a>'
    got = [(r.page_id, r.ord, r.href, r.text) for r in anchors(_pages(spark, mixed, plain, nested)).orderBy("page_id", "ord").collect()]
    assert got[:5] == [(0, 1, "/one", "1"), (0, 2, "/two", "2"), (0, 3, "/café", "café\xa0x"), (1, 1, "/x", "X"), (1, 2, "/y", "Y")]
    assert [(r[2]) for r in got[5:]] == ["/a", "/b"]


def test_deep_and_flat_pages_stay_linear(spark):
    unclosed = "<ul>" + "".join(f'<li><a href="/e/{i}">event {i}</a>' for i in range(5000))
    deep = "<div>" * 5000 + '<a href="/deep">d</a>'
    flat = "<div>" + "".join(f'<a href="/r2/{i}">name {i}</a> Jun {i % 28 + 1} Berlin ' for i in range(2000)) + "</div>"
    rows = anchors_dom(_pages(spark, unclosed, deep, flat)).collect()
    per = {}
    for r in rows:
        per.setdefault(r.page_id, []).append(r)
    assert [len(per[i]) for i in range(3)] == [5000, 1, 2000]
    assert all(r.parent_text == r.text for r in per[0])  # an item is closed by the next
    assert sum(len(r.parent_text) + len(r.parent_tight) + len(r.location) for r in per[2]) < 2000 * 1600


def test_listing_reads_around_the_name(spark):
    from eventide.sources.listing import scan_listing

    page = '<div>Jun 29-Jul 2 <a href="/r2/1">AI Summit</a> Berlin</div><div>Sep 17 <a href="/r2/2">AI Day</a> Munich</div>'
    got = [(r["name"], r.raw_start_date, r.raw_end_date, r.raw_location, r.website, list(r.ord))
           for r in scan_listing(_pages(spark, page), keep=["ai"], skip=["xx"]).orderBy("name").collect()]
    assert got == [("AI Day", "Sep 17", "Sep 17", "Munich", "https://h.example/r2/2", [0, 2]),
                   ("AI Summit", "Jun 29", "Jul 2", "Berlin", "https://h.example/r2/1", [0, 1])]


def test_listing_tests_the_whole_line(spark):
    from eventide.sources.listing import scan_listing

    far = " word" * 200
    page = (f'<div>Jun 1 <a href="/r2/1">AI Late Skip</a> Berlin{far} webinar</div>'
            f'<div><a href="/r2/2">Late Keep</a> Rome{far} genai</div><div><a href="/r2/3">AI Two</a> Oslo\u00a0\U0001f600{far}\n end</div>'
            '<div><a href="/other">AI Other</a></div><a href="/r2/4"> AI Top </a>'
            '<p>x <a href="/r2/5">AI In</a> <b><a href="/r2/6">AI Deep</a> Bern</b> Graz</p>')
    got = {r["name"]: (r.raw_location, r.card_text, list(r.ord))
           for r in scan_listing(_pages(spark, page), keep=["ai"], skip=["webinar"]).collect()}
    assert got == {"Late Keep": (f"Rome{far} genai", f"Late Keep Rome{far} genai", [0, 2]),
                   "AI Two": (f"Oslo\u00a0\U0001f600{far}", f"AI Two Oslo\u00a0\U0001f600{far}\n end", [0, 3]),
                   "AI Top": ("", "", [0, 5]), "AI In": ("AI Deep Bern Graz", "x AI In AI Deep Bern Graz", [0, 6]),
                   "AI Deep": ("Bern", "AI Deep Bern", [0, 7])}


def test_listing_hands_over_a_parent_once():
    import pandas as pd

    from eventide.sources.html import _listing_rows

    flat = "<div>" + "".join(f'<a href="/r2/{i}">name {i}</a> Jun {i % 28 + 1} Berlin ' for i in range(3000)) + "</div>"
    out, = _listing_rows("/r2/")([pd.DataFrame({"page_id": [1], "url": ["u"], "html": [flat]})])
    assert len(out) == 1 and len(out["anchors"][0]) == 3000 and len(out["parent_text"][0]) < len(flat)


def test_calendar_with_odd_properties(spark):
    ev = ("BEGIN:VEVENT\r\nBEGIN:VALARM\r\nDESCRIPTION:alarm\r\nSUMMARY:alarm\r\nEND:VALARM\r\n"
          'SUMMARY;ALTREP="http://x/y;z":Real name\r\nDTSTART;TZID=Pacific Standard Time:20260605T200000\r\n'
          "DESCRIPTION:own\r\nEND:VEVENT\r\n"
          "BEGIN:VEVENT\r\nSUMMARY:No zone\r\nDTSTART;TZID=Mars/Base:20260605T200000\r\nEND:VEVENT\r\n"
          'BEGIN:VEVENT\r\nSUMMARY:Quoted\r\nDTSTART;TZID="America/Los_Angeles":20260605T200000\r\nEND:VEVENT\r\n')
    feeds = spark.createDataFrame([("f", _ics([ev])), ("g", _ics([ev.replace("Real", "Other")]))], "path string, value string")
    reg = spark.createDataFrame([("f", "F", "X", 2), ("g", "G", "Y", 1)], "path string, label string, default_location string, rank int")
    got = {r.name: (r.raw_start_date, r.card_text, list(r.ord)) for r in scan_calendars(feeds, reg, "2026-06-01").collect()}
    assert got == {"Real name": ("Jun 06, 2026", "own", [2, 1]), "Other name": ("Jun 06, 2026", "own", [1, 1]),
                   "No zone": ("Jun 05, 2026", "", [1, 2]), "Quoted": ("Jun 06, 2026", "", [1, 3])}
