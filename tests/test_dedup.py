"""W5 against a sequential model; first-wins rules; partitioning invariance."""
import random

from pyspark.sql import functions as F

import pytest

from eventide.operators.common import order_key
from eventide.operators.dedup import first_wins, greedy_two_key, last_wins

from models import kept_by_two_keys


def test_w5_golden(spark):
    cases = [([(1, "n1", "u1"), (2, "n1", "u2"), (3, "n2", "u2")], [1, 3]),
             ([(1, "", "u1"), (2, "", "u2")], [1]),
             ([(1, "x", ""), (2, "y", "x")], [1])]
    for data, want in cases:
        df = spark.createDataFrame(data, "ord long, name string, url string")
        assert sorted(r.ord for r in greedy_two_key(df, "name", "url", "ord").collect()) == want


def test_w5_random_against_model(spark):
    rnd = random.Random(7)
    keys = ["a", "b", "c", "", " A", "u", "v", None]
    for _ in range(6):
        data = [(i, rnd.choice(keys), rnd.choice(keys)) for i in rnd.sample(range(1000), 40)]
        df = spark.createDataFrame(data, "ord long, name string, url string").repartition(5)
        got = sorted(r.ord for r in greedy_two_key(df, "name", "url", "ord").collect())
        assert got == kept_by_two_keys(data)


def test_first_wins_is_partition_independent(spark):
    data = [(i, f"k{i % 7}", i * 3 % 11) for i in range(200)]
    df = spark.createDataFrame(data, "ord long, key string, v int")
    a = sorted(tuple(r) for r in first_wins(df, ["key"], ["ord"]).collect())
    b = sorted(tuple(r) for r in first_wins(df.repartition(13, "v"), ["key"], ["ord"]).collect())
    assert a == b and len(a) == 7 and all(r[0] < 7 for r in a)


def test_w5_needs_a_unique_order(spark):
    rows = [(0, 0, "a", ""), (1, 0, "a", "u1"), (1, 1, "b", "u2"), (2001, 0, "a", "u1"), (2001, 1, "a", "u2")]
    df = spark.createDataFrame(rows, "page long, pos long, name string, url string")
    with pytest.raises(ValueError, match="same value twice"):
        greedy_two_key(df, "name", "url", "page")
    kept = greedy_two_key(df.withColumn("ord", order_key("page", "pos")), "name", "url", "ord")
    assert sorted((r.page, r.pos) for r in kept.collect()) == [(0, 0), (1, 1)]


def test_order_keys_have_no_limit(spark):
    big = 2_000_000
    rows = [(1, big, "x", "u"), (2, 0, "x", "v"), (10**13, 5, "y", "")]
    df = spark.createDataFrame(rows, "page long, pos long, name string, url string").withColumn("ord", order_key("page", "pos"))
    assert sorted(r.page for r in greedy_two_key(df, "name", "url", "ord").collect()) == [1, 10**13]


def _kept(df, **options):
    return sorted(r.ord for r in greedy_two_key(df, "name", "website", "ord", **options).select("ord").collect())


def test_chain_of_100000_rows(spark):
    """Each row shares its name with the row before and its URL with the next."""
    df = spark.range(100_000).selectExpr("id as ord", "concat('n', cast((id + 1) div 2 as string)) as name",
                                         "concat('u', cast(id div 2 as string)) as website")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got = _kept(df.repartition(5))
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert got == list(range(0, 100_000, 2)) and jobs < 60


def test_components_in_tasks_of_a_few_rows(spark):
    """Many chains and stars, far more rows than a task may walk, some larger."""
    r = random.Random(6)
    rows = []
    for chain in range(60):
        rows += [(f"n{chain}_{(i + 1) // 2}", f"u{chain}_{i // 2}") for i in range(r.randint(2, 12))]
    rows += [("hot", f"h{i}") for i in range(60)] + [(f"x{i % 7}", f"y{i % 11}") for i in range(90)] + [("", "")] * 5
    r.shuffle(rows)
    data = [(i, n, u) for i, (n, u) in enumerate(rows)]
    df = spark.createDataFrame(data, "ord long, name string, website string").repartition(6)
    want = kept_by_two_keys(data)
    for size in (3, 20, 10_000):
        assert _kept(df, task_rows=size) == want


def test_late_rows_equal_early_ones(spark):
    r = random.Random(11)
    rows = [(i, r.choice(["a", "B ", None, ""]), r.choice([1, 2, None]), "x" * r.randint(0, 50)) for i in range(300)]
    df = spark.createDataFrame(rows, "ord long, name string, page int, payload string").repartition(4)
    for pick in (first_wins, last_wins):
        for keys, order in ((["name"], ["ord"]), (["name", "page"], ["page", "ord"]), ([F.lower("name")], ["payload", "ord"])):
            early, late = pick(df, keys, order), pick(df, keys, order, late=True)
            assert sorted(map(str, early.collect())) == sorted(map(str, late.collect()))
    plan = first_wins(df, ["name"], ["ord"], late=True)._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate"):].splitlines()
    assert "payload" not in aggregate[0] and "payload" not in aggregate[1]


def test_common_names_need_no_components(spark, monkeypatch):
    """Names held by many rows, each with a URL of its own, are settled by
    aggregates, however many rows there are; chains beside them are walked."""
    from eventide.operators import dedup

    calls = []
    monkeypatch.setattr(dedup, "components", lambda pairs: calls.append(1))
    r = random.Random(3)
    rows = [(f"name {i % 9}", f"u{i}" if i % 4 else "") for i in range(400)]
    rows += [("p", "q"), ("p", "s"), ("t", "s"), ("t", ""), ("", "q")]
    r.shuffle(rows)
    data = [(i, n, u) for i, (n, u) in enumerate(rows)]
    df = spark.createDataFrame(data, "ord long, name string, website string").repartition(4)
    assert _kept(df, task_rows=5) == kept_by_two_keys(data)
    assert _kept(df, task_rows=5, stored=True) == kept_by_two_keys(data)
    assert not calls
