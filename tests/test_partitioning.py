"""Property: the number of shuffle partitions and AQE do not change results."""
import pytest

from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["upsert_snapshot", "greedy_dedup", "edition_link", "side_event_scan", "digest"])
def test_results_independent_of_partitioning(spark, name):
    base = sorted(tuple(str(x) for x in r) for r in queries()[name](spark, SF).collect())
    old = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "37")
        spark.conf.set("spark.sql.adaptive.enabled", "false")
        other = sorted(tuple(str(x) for x in r) for r in queries()[name](spark, SF).collect())
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    assert base == other and len(base) > 0
