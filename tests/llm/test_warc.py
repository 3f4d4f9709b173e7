"""Archives read back give the pages; broken archives give states, not errors."""
import gzip
import hashlib
import random

import pytest
from pyspark.sql import functions as F

from eventide.llm import warc
from eventide.session import scratch_path


@pytest.mark.parametrize("size", [0, 1, 4095, 4096, 4097, 50_000])
def test_chunked_round_trip(size):
    data = random.Random(size).randbytes(size)
    assert warc.unchunked(warc.chunked(data)) == data


def test_broken_chunks():
    assert warc.unchunked(b"5\r\nabc") is None and warc.unchunked(b"zz\r\n") is None and warc.unchunked(b"") is None


@pytest.fixture(scope="module")
def pages(spark):
    r = random.Random(1)
    rows = [(i, "p%d " % i + "é漢\r\n\r\nWARC/1.1\r\n" * r.randrange(0, 4000)) for i in range(12)]
    rows += [(20 + i, "copy" * 400) for i in range(9)] + [(40, "short"), (41, "short"), (50, None), (None, "no id"), (51, "")]
    rows += [(60, "twice" * 300), (60, "twice" * 300)]
    return spark.createDataFrame(rows, "page_id long, html string").withColumn("payload", F.lit("clash")).repartition(3)


def test_round_trip(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path, segment_bytes=3000)
    got = warc.read_pages(spark, path).collect()
    rows = pages.collect()
    assert len(got) == len(rows) and all(r["state"] == "ok" for r in got)
    by = {}
    for r in rows:
        by.setdefault(r["page_id"], r["html"] or "")
    last = {}
    for i, h in by.items():
        if i is not None and len(h.encode()) >= 1000:
            last[h] = max(i, last.get(h, i))
    for r in got:
        body = by[r["page_id"]].encode()
        assert r["payload_bytes"] == len(body) and r["payload_digest"] == hashlib.sha1(body).hexdigest()
        winner = last.get(by[r["page_id"]], r["page_id"])
        assert (r["record_type"], r["refers_to"]) == (("response", None) if winner == r["page_id"] else ("revisit", winner))
        assert r["payload"] == (body if r["record_type"] == "response" else None)


def test_revisits_name_a_record_of_the_archive(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages, path)
    got = warc.read_records(spark, path).where("record_type <> 'continuation'").collect()
    full = {(r["target"], r["digest"]) for r in got if r["record_type"] == "response"}
    revisits = [(r["refers_to"], r["digest"]) for r in got if r["record_type"] == "revisit"]
    assert len(revisits) == 8 and set(revisits) <= full
    assert len({r["record_id"] for r in got}) == len(got)


def test_empty_table(spark, pages):
    path = scratch_path(spark, "warc-test")
    warc.write_archives(pages.limit(0), path)
    assert warc.read_pages(spark, path).count() == 0


def test_segments_are_verified(spark, tmp_path):
    recs = warc.page_records(1, b"x" * 9000, hashlib.sha1(b"x" * 9000).hexdigest(), None, "a", 2000)
    other = warc.page_records(2, b"y" * 9000, hashlib.sha1(b"y" * 9000).hexdigest(), None, "b", 2000)
    third = warc.page_records(3, b"z" * 5000, "00", None, "c", 2000)
    whole = recs[::-1] + other[:2] + other[3:] + third  # out of order; one segment missing; a wrong digest
    (tmp_path / "a.warc.gz").write_bytes(b"".join(gzip.compress(r + warc.END) for r in whole))
    states = {r["page_id"]: (r["state"], len(r["payload"] or b"")) for r in warc.read_pages(spark, str(tmp_path)).collect()}
    assert states == {1: ("ok", 9000), 2: ("gap", 0), 3: ("digest", 0)}


def test_cut_record(spark, tmp_path):
    rec = warc.page_records(1, b"x" * 900, hashlib.sha1(b"x" * 900).hexdigest(), None, "a")[0]
    (tmp_path / "a.warc.gz").write_bytes(gzip.compress(rec[:-50]))
    assert [r["state"] for r in warc.read_pages(spark, str(tmp_path)).collect()] == ["cut"]


def test_a_member_for_each_record():
    import gzip
    import time

    records = [warc.page_records(i, b"x" * 50, "d", None, str(i))[0] + warc.END for i in range(20_000)]
    content = b"".join(gzip.compress(r, 1) for r in records)
    start = time.time()
    assert [m for m in warc._members(content)] == records and time.time() - start < 20
    assert list(warc._members(b"")) == [b""] and list(warc._members(b"plain")) == [b"plain"]
