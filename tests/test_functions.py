"""Golden cases of the scalar functions (FIXTURES.md section 3)."""
import datetime as dt

from pyspark.sql import functions as F

from eventide.functions import dates as D
from eventide.functions import text as X
from eventide.functions.jsonx import reply_json
from eventide.operators import cfp as C
from eventide.operators.rules import first_rule


def one_col(spark, values, fn, typ="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {typ}")
    return [r[0] for r in df.orderBy("i").select(fn(F.col("v"))).collect()]


def test_parse_date_golden(spark):
    june29 = ["Jun 29, 2026", "June 29, 2026", "Jun 29 2026", "29 Jun 2026", "2026-06-29",
              " Jun 29, 2026", "Jun  29, 2026"]
    assert one_col(spark, june29, D.parse_date) == [dt.date(2026, 6, 29)] * len(june29)
    assert one_col(spark, ["jun 05, 2026", "JUN 5, 2026"], D.parse_date) == [dt.date(2026, 6, 5)] * 2
    assert one_col(spark, ["2026-6-9", "9 jun 2026"], D.parse_date) == [dt.date(2026, 6, 9)] * 2
    assert one_col(spark, ["May 5, 2026"], D.parse_date) == [dt.date(2026, 5, 5)]
    assert one_col(spark, ["Sept 5, 2026", "TBC", "", "Feb 30, 2026", "Jun 29, 26", None],
                   D.parse_date) == [None] * 6


def test_days_golden(spark):
    df = spark.createDataFrame([("Jun 29, 2026", "Jul 2, 2026"), ("2026-07-10", "2026-07-08"),
                                ("Jun 29 2026", "Jun 30 2026"), ("", "2026-07-08")], "s string, e string")
    assert [r[0] for r in df.select(D.days_span("s", "e")).collect()] == [4, 1, None, None]


def test_year_inference_golden(spark):
    got = one_col(spark, ["Jun 29", "Dec 1", "Nov 30", "Feb 29"], lambda c: D.infer_year(c, "2026-12-01"))
    assert got == [dt.date(2027, 6, 29), dt.date(2026, 12, 1), dt.date(2027, 11, 30), None]


def test_ical_date_golden(spark):
    df = spark.createDataFrame([("20260605", None), ("20260605T010000Z", None),
                                ("20260605T200000", "America/Los_Angeles"), ("20260605T200000", None)],
                               "v string, tz string")
    got = [r[0] for r in df.select(D.ical_date("v", "tz")).collect()]
    assert got == [dt.date(2026, 6, 5), dt.date(2026, 6, 5), dt.date(2026, 6, 6), dt.date(2026, 6, 5)]


def test_strip_year_and_weeks(spark):
    got = one_col(spark, ["Foo Con 2026", "Foo 2026 Berlin", "Foo2026", "1999 Foo"], D.strip_year)
    assert got == ["Foo Con", "Foo Berlin", "Foo2026", "1999 Foo"]
    got = one_col(spark, [dt.date(2026, 12, 28), dt.date(2027, 1, 4), dt.date(2027, 1, 11)], D.odd_iso_week, "date")
    assert got == [True, True, False]
    got = one_col(spark, [dt.date(2026, 1, 7), dt.date(2026, 1, 8)], D.first_run_of_month, "date")
    assert got == [True, False]


def test_past_future_unknown(spark):
    got = one_col(spark, ["Jan 1, 2020", "Jan 1, 2030", "TBC"], lambda c: D.is_past(D.parse_date(c), "2026-01-01"))
    assert got == [True, False, False]
    got = one_col(spark, ["Jan 1, 2020", "Jan 1, 2030", "TBC"], lambda c: D.is_future(D.parse_date(c), "2026-01-01"))
    assert got == [False, True, True]


def test_date_range_split_golden(spark):
    from eventide.plans.catalogue import split_listing

    texts = ["Jun 29-Jul 2", "Jul 8-10", "Jun 23-24", "Sep 17", "Jul 8 - 10"]
    df = spark.createDataFrame([(i, f"{t} Alpha Conf San Francisco", "Alpha Conf") for i, t in enumerate(texts)],
                               "i int, parent_text string, name string")
    got = [(r.start_part, r.end_part, r.location) for r in split_listing(df).orderBy("i").collect()]
    assert got == [("Jun 29", "Jul 2", "San Francisco"), ("Jul 8", "Jul 10", "San Francisco"),
                   ("Jun 23", "Jun 24", "San Francisco"), ("Sep 17", "Sep 17", "San Francisco"),
                   ("Jul 8", "Jul 8", "San Francisco")]


def test_keywords_golden(spark):
    assert one_col(spark, ["Committee lunch"], lambda c: X.contains_any(c, ["tee"])) == [True]
    assert one_col(spark, ["Paid workshop"], lambda c: X.contains_any(c, ["ai"])) == [True]
    assert one_col(spark, ["AI for marketing"], lambda c: X.keep_skip(c, ["ai"], ["marketing"])) == [False]
    assert one_col(spark, ["Paid workshop"], lambda c: X.contains_any(c, ["ai"], whole_word=True)) == [False]


def test_flags_keys_labels(spark):
    got = one_col(spark, [" Yes ", "off", "", None, "ON", "y"], lambda c: X.lenient_flag(c, True))
    assert got == [True, False, True, True, True, True]
    assert one_col(spark, ["\t Alpha Conf \n"], X.norm_key) == ["alpha conf"]
    df = spark.createDataFrame([("Jun 1, 2026", "Jun 2, 2026"), ("", "Jun 2, 2026"), ("", "")], "s string, e string")
    got = [r[0] for r in df.select(X.date_range_label("s", "e")).collect()]
    assert got == ["Jun 1, 2026 – Jun 2, 2026", "Jun 2, 2026", "unknown"]
    assert one_col(spark, ["San Francisco"], X.city_key) == ["sanfrancisco"]


def test_cfp_golden(spark):
    texts = ["submit now", "submit now and cfp closed", "call for papers, submissions closed",
             "submissions closed", "submissions are closed", "", None]
    assert one_col(spark, texts, C.cfp_text_state) == ["Open", "Closed", "Open", "Closed", "Check site",
                                                         "Check site", "Check site"]
    df = spark.createDataFrame([("Open", "Jan 1, 2020"), ("Open", "soon"), ("Unknown", "Jan 1, 2020")],
                               "s string, d string")
    assert [r[0] for r in df.select(C.cfp_sanity("s", "d", "2026-01-01")).collect()] == ["Closed", "Open", "Unknown"]
    df = spark.createDataFrame([("Closed", "Open"), ("Check site", "Open"), (None, "Open")], "raw string, m string")
    assert [r[0] for r in df.select(C.cfp_precedence("raw", "m")).collect()] == ["Closed", "Open", "Open"]


def test_city_rules_golden(spark):
    locs = ["Menlo Park, CA", "Berlin, Germany", "MÜNCHEN", "94 Baker Street, London", "Paris", ""]
    assert one_col(spark, locs, first_rule) == ["San Francisco", "Berlin", "Munich", "San Francisco", None, None]


def test_reply_json_golden(spark):
    cases = [("Here: ```json {\"events\":[]} ``` done", {"events": []}, "ok"),
             ('note {"a":1} end', {"a": 1}, "ok"),
             ('{"k": 69', {"k": 69}, "repaired"),
             ('{"events":[{"name":"A","x":1},{"name":"B","x"', {"events": [{"name": "A", "x": 1}, {"name": "B"}]},
              "repaired"),
             ('{"events":[{"name":"A"},{"name":"Bo', {"events": [{"name": "A"}, {}]}, "repaired"),
             ('{"a":1} and {"b":2}', None, "failed"),
             ("no object", None, "failed")]
    import json

    tail = '{"events":[{"name":"A"},{"tags":[' + ",".join(f'"t{i}"' for i in range(300)) + ',"cut'
    cases += [(tail, {"events": [{"name": "A"}, {"tags": [f"t{i}" for i in range(300)]}]}, "repaired"),
              ('{"a":"x\\"y","b":[1,2', {"a": 'x"y', "b": [1, 2]}, "repaired"), ('{"a":1,"b":-', {"a": 1}, "repaired"),
              ('{"a":1,"b"', {"a": 1}, "repaired"), ('{"a":1,"b":', {"a": 1}, "repaired"), ("{", {}, "repaired"),
              ('{"a"', None, "failed"), ('{"a":1}]{"b":2}', None, "failed"), ('{"a":1}}{"b":2}', None, "failed"),
              ('{"a":1},"x":{"b":2}', None, "failed"), ('{"a":1,"a":2}', {"a": 2}, "ok"), (None, None, "failed"), ("", None, "failed"),
              ("```\n{\"a\":1}\n```\n```json\n{\"b\":22}\n```", {"b": 22}, "ok"), ('{"a":1,"b":tru', {"a": 1}, "repaired")]
    df = spark.createDataFrame([(i, t) for i, (t, _, _) in enumerate(cases)], "i int, t string")
    got = [(r[0]["json"], r[0]["parse_state"]) for r in df.orderBy("i").select(reply_json("t")).collect()]
    for (text, obj, state), (out, st) in zip(cases, got):
        assert st == state and (json.loads(out) if out else None) == obj, text


def test_classifier_reply_strict(spark):
    from eventide.sources.replies import classifier_replies

    cases = [(1, '```json {"relevant": true, "name": "A"} ```'), (2, '{"relevant": true} and {"x":1}'),
             (3, '{"relevant": false}'), (4, "no"), (5, '{"relevant": true}, {"relevant": false}'),
             (6, '```\njson\n{"relevant": true}\n```'), (7, '{"relevant":true}]{"relevant":false}'),
             (8, '{"relevant":true}}{"relevant":false}')]
    df = spark.createDataFrame(cases, "req_id long, text string")
    got = {r.req_id: (None if r.reply is None else r.reply.relevant) for r in classifier_replies(df).collect()}
    assert got == {1: True, 2: None, 3: False, 4: None, 5: None, 6: None, 7: None, 8: None}
    scores = spark.createDataFrame([(1, '{"fit_score": "85"}'), (2, '{"fit_score": 85.5}'), (3, '{"fit_score": 7}'),
                                    (4, '{"fit_score": "high"}')], "req_id long, text string")
    assert [r.reply.fit_score for r in classifier_replies(scores).orderBy("req_id").collect()] == [85, 85, 7, None]
