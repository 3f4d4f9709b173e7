"""Calendar files read from byte ranges equal the whole documents."""
import pytest

from eventide.sources import ical
from eventide.sources.ical import read_calendars, vevents


def calendar(n):
    lines = ["BEGIN:VCALENDAR", "VERSION:2.0", "DESCRIPTION:no event END:VEVENT"]
    for i in range(n):
        lines += ["BEGIN:VEVENT", f"SUMMARY:Event {i} é漢", f"DTSTART:202401{1 + i % 28:02d}T100000Z",
                  "DESCRIPTION:a long text that is fol", " ded" + "x" * (i % 40),
                  *(["BEGIN:VALARM", "SUMMARY:alarm", "END:VALARM"] if i % 3 == 0 else []), "END:VEVENT"]
    return "\r\n".join([*lines, "BEGIN:VEVENT", "SUMMARY:never ends", "END:VCALENDAR", ""])


@pytest.fixture
def small_splits(spark):
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in before:
        spark.conf.set(k, "700")
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def test_ranges_equal_documents(spark, tmp_path, small_splits):
    text = calendar(400)
    (tmp_path / "a.ics").write_bytes(text.encode())
    (tmp_path / "b.ics").write_bytes(b"BEGIN:VEVENT\nSUMMARY:first\nEND:VEVENT")
    (tmp_path / "c.ics").write_bytes(b"")
    read = read_calendars(spark, str(tmp_path))
    assert read.rdd.getNumPartitions() > 20
    got = [(r.path.rsplit("/", 1)[1], r.name, r.dtstart, r.description)
           for r in sorted(read.collect(), key=lambda r: (r.path, r.pos))]
    docs = spark.createDataFrame([("a.ics", text), ("b.ics", "BEGIN:VEVENT\nSUMMARY:first\nEND:VEVENT"), ("c.ics", "")],
                                 "path string, value string")
    want = [(r.path, r.name, r.dtstart, r.description)
            for r in sorted(vevents(docs).collect(), key=lambda r: (r.path, r.pos))]
    assert got == want and len(got) == 401


def test_scan_names_its_key(spark, tmp_path):
    (tmp_path / "feed=7").mkdir()
    (tmp_path / "feed=7" / "x.ics").write_bytes(calendar(30).encode())
    reg = spark.createDataFrame([(7, "Seven", "Here", 1)], "feed int, label string, default_location string, rank long")
    out = ical.scan_calendars(read_calendars(spark, str(tmp_path)), reg, "2024-01-10", key="feed").collect()
    assert {r.source for r in out} == {"iCal (Seven)"} and {r.raw_location for r in out} == {"Here"}
    assert len(out) == len({r.name for r in out}) > 0
