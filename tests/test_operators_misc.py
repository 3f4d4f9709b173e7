"""Smaller operators: P11 cap before block, M5 source registry, R3 fold, J4 rule tables."""
import pytest
from pyspark.sql import functions as F

from eventide.operators.classify import classify_batch
from eventide.operators.match import key_set
from eventide.operators.route import route_meetups
from eventide.operators.rules import first_rule_from_table, rules_table
from eventide.sources import registry as REG


def test_cap_counts_blocked_rows(spark):
    """Q8: the arrival-order cap is applied before the block list, so blocked
    rows use up the cap."""
    raw = spark.createDataFrame([(1, 1, "Blocked A", ""), (1, 2, "Keep B", ""), (2, 1, "Keep C", "")],
                                "source_rank int, ord long, name string, website string")
    names = key_set(spark.createDataFrame([("blocked a",)], "name string"), "name")
    urls = key_set(spark.createDataFrame([], "website string"), "website")
    scorer = lambda df: df.withColumn("relevant", F.lit(True))
    relevant, blocked, _ = classify_batch(raw.withColumn("source", F.lit("s")), scorer, names, urls, cap=2)
    assert [r.name for r in relevant.collect()] == ["Keep B"] and blocked.count() == 1


def test_source_registry_modes(spark):
    REG._REGISTRY.clear()

    @REG.source("feeds", rank=1, modes=("meetup",))
    def feeds(spark, cfg):
        return spark.createDataFrame([("A", 1)], "name string, ord long")

    @REG.source("listing", rank=2, modes=("conference",))
    def listing(spark, cfg):
        return spark.createDataFrame([("B", 1)], "name string, ord long")

    out = REG.collect_sources(spark, {}, "meetup").collect()
    assert [(r.name, r.source_rank) for r in out] == [("A", 1)]
    assert REG.collect_sources(spark, {}, "conference").columns == [f.name for f in REG.RAW_EVENT.fields]
    REG._REGISTRY.clear()


def test_failing_sources_are_left_out(spark):
    def good(spark, cfg):
        return spark.createDataFrame([("A", 1), ("B", 2)], "name string, ord long")

    def breaks_off(spark, cfg):
        return good(spark, cfg).withColumn("name", F.expr("if(ord = 2, raise_error('late'), name)"))

    def raises(spark, cfg):
        raise OSError("no answer")

    def clashes(spark, cfg):
        return spark.sql("SELECT 'x' AS name, 'y' AS name")

    bad = [REG.Source("late", 1, breaks_off), REG.Source("off", 3, raises), REG.Source("twice", 4, clashes)]
    failed = {}
    got = REG.collect_sources(spark, {}, "meetup", [*bad, REG.Source("good", 2, good)], lambda s, e: failed.update({s.name: e}))
    assert sorted((r.name, r.source_rank) for r in got.collect()) == [("A", 2), ("B", 2)]
    assert set(failed) == {"late", "off", "twice"} and isinstance(failed["off"], OSError)
    none = REG.collect_sources(spark, {}, "meetup", bad, lambda s, e: None)
    assert none.count() == 0 and none.columns == got.columns
    with pytest.raises(OSError):
        REG.collect_sources(spark, {}, "meetup", bad)


def test_demo_fold(spark):
    ev = spark.createDataFrame([("meetup", "Jun 01, 2030", "Menlo Park, CA", True, None, 1),
                                ("meetup", "Jun 01, 2030", "Berlin", True, None, 2),
                                ("meetup", "Jun 01, 2030", "Paris", True, None, 3)],
                               "event_type string, start_date string, location string, demo_suitable boolean, "
                               "hint_demo_suitable boolean, ord long").withColumn("fit_score", F.lit("7"))
    a = {r.ord: r.sheet for r in route_meetups(ev, "2026-01-01").collect()}
    b = {r.ord: r.sheet for r in route_meetups(ev, "2026-01-01", include_demos=False).collect()}
    assert a == {1: "SF Product Demos", 2: "Meet-ups"} and b == {1: "Meet-ups", 2: "Meet-ups"}


def test_rule_table(spark):
    locs = spark.createDataFrame([(1, "Menlo Park, CA"), (2, "MÜNCHEN"), (3, "Paris"), (4, "94 Baker Street, London"),
                                  (4, "Berlin")], "id int, loc string")
    own = rules_table(spark)
    many = spark.range(2000).select((F.col("id") + 100).cast("int").alias("priority"), F.lit("L").alias("label"),
                                    F.concat(F.lit("no such place "), F.col("id")).alias("needle"))
    odd = spark.createDataFrame([(50, "L3", ""), (50, "B", "paris"), (50, "A", "PAR")], "priority int, label string, needle string")
    want = [(1, "San Francisco"), (2, "Munich"), (3, None), (4, "Berlin"), (4, "San Francisco")]
    for rules, third in ((own, None), (own.unionByName(many), None), (own.unionByName(odd), "A")):
        got = sorted(((r.id, r.label) for r in first_rule_from_table(locs, "loc", rules).collect()), key=str)
        assert got == sorted([(i, third if i == 3 else x) for i, x in want], key=str)
    assert first_rule_from_table(locs, "loc", own.limit(0)).where("label is not null").count() == 0


def test_outcome_counts_observed_in_flight(spark):
    from pyspark.sql import Observation

    raw = spark.createDataFrame([(1, 1, "A", ""), (1, 2, "B", ""), (1, 3, "C", "")],
                                "source_rank int, ord long, name string, website string").withColumn("source", F.lit("s"))
    empty = key_set(spark.createDataFrame([], "name string"), "name")
    scorer = lambda df: df.withColumn(
        "relevant", F.when(F.col("ord") == 1, F.lit(True)).when(F.col("ord") == 2, F.lit(False)))
    obs = Observation("classify")
    _, _, scored = classify_batch(raw, scorer, empty, key_set(spark.createDataFrame([], "website string"), "website"),
                                  observation=obs)
    scored.write.format("noop").mode("overwrite").save()
    assert obs.get == {"relevant": 1, "rejected": 1, "failed": 1}
