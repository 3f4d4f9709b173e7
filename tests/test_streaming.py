"""Streaming micro-batches equal sequential batch upserts; replay is a no-op."""
from pyspark.sql import functions as F

from eventide.operators.upsert import empty_tracker, replace_sheet, upsert
from eventide.plans.catalogue import _weekly_incoming, land_week, stage_weeks
from eventide.session import scratch_path
from eventide.streaming.incremental import SnapshotStore, init_store, run_incremental, upsert_batch

SF = "/root/testdata/sf0.001"
COLS = ["row_id", "name", "location", "start_date", "website", "days"]


def test_stream_equals_sequential_batches(spark):
    root = scratch_path(spark, "t-incr")
    schema, weeks = stage_weeks(spark, SF, f"{root}/staging")
    store = init_store(spark, f"{root}/tracker", empty_tracker(spark))
    for w in weeks:
        land_week(spark, schema, f"{root}/staging", w, f"{root}/landing")
        got = run_incremental(spark, f"{root}/landing", schema, store, "Meet-ups", f"{root}/ckpt")
    inc = _weekly_incoming(spark, SF)
    t = empty_tracker(spark)
    for w in sorted(r.week for r in inc.select("week").distinct().collect()):
        batch = inc.where(F.col("week") == w).drop("week")
        t = replace_sheet(t, "Meet-ups", upsert(t, batch, "Meet-ups").snapshot)
        t = spark.createDataFrame(t.collect(), t.schema)
    a = sorted(tuple(r) for r in got.select(*COLS).collect())
    b = sorted(tuple(r) for r in t.select(*COLS).collect())
    assert a == b and len(a) > 0
    # replaying an applied batch id changes nothing
    before = store.latest()
    upsert_batch(store, "Meet-ups", f"{root}/ckpt")(inc.limit(5).drop("week"), 0)
    assert store.latest() == before
    # the first batch of another stream is new data
    fresh = inc.limit(1).drop("week").withColumn("name", F.lit("Only here")).withColumn("website", F.lit("only.example"))
    upsert_batch(store, "Meet-ups", f"{root}/other")(fresh, 0)
    assert store.read().where("name = 'Only here'").count() == 1
    assert isinstance(store, SnapshotStore)


def _batch(spark, rows):
    return spark.createDataFrame(rows, "ord long, name string, website string").selectExpr(
        "*", "'City' as location", "'Jan 02, 2026' as start_date")


def test_commit_writes_touched_slots_only(spark):
    """Slots of ten rows: a batch of one update and one insert rewrites two of them."""
    root = scratch_path(spark, "t-slots")
    store = init_store(spark, root, empty_tracker(spark), slot_rows=10)
    run = upsert_batch(store, "Meet-ups", "a")
    run(_batch(spark, [(i, f"name {i}", f"u{i}.example") for i in range(95)]), 0)
    first = store.latest()
    assert len(first.slots) == 10 and store.read().count() == 95
    change = _batch(spark, [(1, "NAME 33", ""), (2, "brand new", "new.example")]).withColumn("location", F.lit("Elsewhere"))
    run(change, 1)
    second = store.latest()
    moved = {s for s in second.slots if second.slots[s] != first.slots.get(s)}
    assert len(moved) == 2 and set(second.slots) == set(first.slots)
    rows = {r.name: r.location for r in store.read().collect()}
    assert len(rows) == 96 and rows["name 33"] == rows["brand new"] == "Elsewhere" and rows["name 34"] == "City"
    assert store.read(first).count() == 95  # the old state is still there
    assert store.read(sheets=["Conferences"]).count() == 0 and store.read(sheets=["Meet-ups"]).count() == 96


def test_second_writer_starts_again(spark, monkeypatch):
    """A commit that slips in between base and publish is not lost."""
    root = scratch_path(spark, "t-race")
    store = init_store(spark, root, empty_tracker(spark))
    other = SnapshotStore(spark, root)
    plain, calls = SnapshotStore.commit, []

    def slow(self, query, batch_id, base, plan):
        calls.append(query)
        if calls == ["a"]:
            upsert_batch(other, "Meet-ups", "b")(_batch(spark, [(1, "from b", "b.example")]), 0)
        return plain(self, query, batch_id, base, plan)

    monkeypatch.setattr(SnapshotStore, "commit", slow)
    upsert_batch(store, "Meet-ups", "a")(_batch(spark, [(1, "from a", "a.example"), (2, "from b", "c.example")]), 0)
    assert calls == ["a", "b", "a"]
    assert sorted((r.row_id, r.name) for r in store.read().collect()) == [(1, "from b"), (2, "from a")]
    assert store.latest().version == 2 and store.latest().applied == {"a": 0, "b": 0}


def test_unreadable_snapshot_is_an_error(spark, tmp_path):
    import pytest

    from eventide.operators.upsert import load_tracker, save_tracker

    assert load_tracker(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        load_tracker(spark, str(tmp_path / "none"), must_exist=True)
    save_tracker(empty_tracker(spark), str(tmp_path / "t"))
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "part-0.parquet").write_bytes(b"no parquet file")
    with pytest.raises(Exception):
        load_tracker(spark, str(tmp_path / "bad")).count()


def test_first_seen_is_determined(spark):
    """The earliest row of a name is kept, in one batch or many, and a name is
    free again after the delay."""
    from eventide.streaming.incremental import first_seen

    rows = [(i, f" Name{i % 4} ", f"2024-01-{1 + i // 8:02d} {i % 8:02d}:00:00") for i in range(200)]
    df = spark.createDataFrame(rows, "ord long, name string, t string").selectExpr("ord", "name", "timestamp(t) scraped_at")
    root = scratch_path(spark, "t-first")
    for day in range(1, 26):
        df.where(F.dayofmonth("scraped_at") == day).repartition(3).write.mode("append").parquet(f"{root}/in/d{day:02d}")

    def run(n, files):
        stream = (spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).option("recursiveFileLookup", "true")
                  .parquet(f"{root}/in"))
        q = (first_seen(stream, delay="40 days").writeStream.format("parquet").option("path", f"{root}/out{n}")
             .option("checkpointLocation", f"{root}/c{n}").trigger(availableNow=True).start())
        q.awaitTermination()
        return sorted(r.ord for r in spark.read.schema(df.schema).parquet(f"{root}/out{n}").collect())

    assert run(1, 1000) == [0, 1, 2, 3]


def test_hot_name_sends_a_row_per_task(spark):
    """A task hands on the first row of each name and its latest row."""
    import pandas as pd

    from eventide.streaming.incremental import _first_rows

    frames = [pd.DataFrame({"_name_key": ["hot"] * 500 + ["b"], "scraped_at": pd.date_range("2024-01-02", periods=501, freq="s")[::-1],
                            "ord": range(k, k + 501)}) for k in (0, 600)]
    out = pd.concat(_first_rows("scraped_at", "ord")(iter(frames)))
    assert len(out) == 3 and out["scraped_at"].max() == frames[0]["scraped_at"].max()
    assert sorted(out["ord"].tolist()) == [0, 499, 500]


def test_batch_of_one_file_is_spread(spark, monkeypatch):
    """A batch that lies in one partition is upserted by all cores."""
    from eventide.streaming import incremental

    seen = []
    plain = incremental.upsert
    monkeypatch.setattr(incremental, "upsert", lambda t, batch, *a, **k: seen.append(batch) or plain(t, batch, *a, **k))
    store = init_store(spark, scratch_path(spark, "t-spread"), empty_tracker(spark))
    upsert_batch(store, "Meet-ups", "a")(_batch(spark, [(i, f"name {i}", "") for i in range(400)]).coalesce(1), 0)
    assert store.read().count() == 400
    assert seen[0].groupBy(F.spark_partition_id()).count().count() > 1
