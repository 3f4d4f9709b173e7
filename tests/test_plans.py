"""Plan guard: no catalogue query pairs rows (no nested-loop or cartesian join)."""
from __spark_entry__ import queries

SF = "/root/testdata/sf0.001"
STREAMING = {"incremental", "first_seen"}


def test_no_pairwise_joins(spark):
    bad = {}
    for name, fn in queries().items():
        if name in STREAMING:
            continue
        plan = fn(spark, SF)._jdf.queryExecution().executedPlan().toString()
        hits = [n for n in ("BroadcastNestedLoopJoin", "CartesianProduct") if n in plan]
        if hits:
            bad[name] = hits
    assert bad == {}
