"""Hot keys: one key holds a third of all rows. Results must stay exact."""
import random

from pyspark.sql import functions as F

from eventide.operators.dedup import first_wins, greedy_two_key
from eventide.operators.editions import next_editions
from eventide.operators.upsert import conform_tracker, upsert

from models import kept_by_two_keys


def test_first_wins_hot_key(spark):
    n = 3000
    df = spark.range(n).select(F.col("id").alias("ord"),
                               F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(F.col("id").cast("string")).alias("k"))
    out = {r.k: r.ord for r in first_wins(df.repartition(16), ["k"], ["ord"]).collect()}
    assert out["hot"] == 0 and len(out) == 1 + n - n // 3


def test_greedy_hot_empty_name(spark):
    rnd = random.Random(3)
    rows = [(i, "" if i % 3 == 0 else f"n{rnd.randint(0, 300)}", f"u{rnd.randint(0, 500)}" if i % 2 else "")
            for i in range(900)]
    df = spark.createDataFrame(rows, "ord long, name string, url string").repartition(8)
    got = sorted(r.ord for r in greedy_two_key(df, "name", "url", "ord").collect())
    assert got == kept_by_two_keys(rows)


def test_upsert_hot_match(spark):
    ex = conform_tracker(spark.range(100).select(
        F.lit("Conferences").alias("sheet"), F.col("id").alias("row_id"), (F.col("id") + 2).cast("int").alias("row_no"),
        F.concat(F.lit("E"), F.col("id").cast("string")).alias("name"), F.lit("Old").alias("location")))
    inc = spark.range(1, 901).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, F.lit("E7")).otherwise(F.concat(F.lit("N"), F.col("id").cast("string"))).alias("name"),
        F.concat(F.lit("L"), F.col("id").cast("string")).alias("location"))
    res = upsert(ex, inc, "Conferences")
    snap = {r.name: r for r in res.snapshot.collect()}
    assert snap["E7"].location == "L900"          # last differing value among 300 hits
    c = res.counts.collect()[0]
    assert (c.added, c.updated) == (600, 300)


def test_editions_hot_base(spark):
    past = spark.range(600).select(
        F.col("id").alias("row_id"),
        F.when(F.col("id") % 3 == 0, F.lit("Hot Conf 2024")).otherwise(
            F.concat(F.lit("Conf "), F.col("id").cast("string"), F.lit(" 2024"))).alias("name"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 50).cast("int")), "MMM dd, yyyy").alias("start_date"),
        F.lit("cat").alias("category"), F.lit("loc").alias("location"), F.lit("w").alias("website"))
    cand = spark.range(3000).select(
        F.col("id").alias("cand_id"), F.lit("Hot Conf").alias("base_name"), F.lit("").alias("name"),
        F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (F.col("id") % 400).cast("int")), "MMM dd, yyyy").alias("start_date"),
        F.lit("").alias("end_date"), F.lit("").alias("location"), F.lit("").alias("website"),
        F.lit("high").alias("confidence"), F.lit(True).alias("future_edition_found"), F.lit("").alias("evidence"))
    out = next_editions(past, cand, "2024-03-01").collect()
    # every hot row links to the first candidate on or after as_of that is later than its own start
    assert len(out) == 200 and all(r.start_date == "Mar 01, 2024" for r in out)
    assert all(r.cand_id == 60 for r in out)


def test_hot_key_split_without_aqe(spark):
    """With AQE skew splitting off, the explicit split gives the same rows."""
    from eventide.operators.common import hot_key_join
    from eventide.operators.match import match_existing

    big = spark.range(3000).select(F.col("id").alias("ord"),
                                   F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise(
                                       F.concat(F.lit("k"), (F.col("id") % 50).cast("string"))).alias("k"))
    small = spark.createDataFrame([("hot", 1), ("k1", 2), ("k7", 3)], "k2 string, v int")
    on = F.col("k") == F.col("k2")
    for how in ("inner", "left", "left_anti", "left_semi"):
        plain = sorted(tuple(r) for r in big.join(small, on, how).collect())
        split = sorted(tuple(r) for r in hot_key_join(big, small, on, "k", "k2", how, hot_rows=100, force=True).collect())
        assert plain == split, how
    old = spark.conf.get("spark.sql.adaptive.skewJoin.enabled")
    try:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", "false")
        ex = conform_tracker(spark.createDataFrame([("Conferences", 1, 2, "hot", "u")],
                                                   "sheet string, row_id long, row_no int, name string, website string"))
        inc = big.select("ord", F.col("k").alias("name"), F.lit("").alias("website"))
        got = match_existing(inc, ex).where(F.col("match_row_id").isNotNull()).count()
        assert got == 1000
    finally:
        spark.conf.set("spark.sql.adaptive.skewJoin.enabled", old)


def test_rows_without_a_key_are_spread(spark):
    """Blank URLs make NULL keys; a left join must not send them to one task."""
    from eventide.operators.common import hot_key_join

    old = spark.conf.get("spark.sql.adaptive.enabled")
    old_broadcast = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        big = spark.range(4000).selectExpr("id as ord", "if(id % 4 = 0, concat('u', id % 40), null) as k")
        small = spark.range(20).selectExpr("concat('u', id) as sk", "id as v")
        for how in ("left", "left_anti"):
            got = hot_key_join(big, small, F.col("k") == F.col("sk"), "k", "sk", how)
            want = big.join(small, F.col("k") == F.col("sk"), how)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))
            per_task = [r["n"] for r in got.where("k is null").groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect()]
            assert sum(per_task) == 3000 and max(per_task) < 1500
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", old)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old_broadcast)
