"""Incremental curation with Structured Streaming.

I1: newly landed event files are read as a stream; every micro-batch is one
"run" that upserts into the tracker. The tracker lies in a shared folder, cut
into slots: the rows of one named table whose ids fall into one range of
``slot_rows``. A commit is a small file that lists the folder of each slot. A
micro-batch works out its change plan, rewrites the slots that the plan touches
into a folder of its own and publishes the next commit, which names the new
folders and, for the rest, the old ones; so what is written follows the batch,
not the tracker. Commits are numbered, and a number is published once: a writer
that comes second works its batch out again on the new state. A batch is known
by the stream it belongs to and its number in it: replaying a committed batch is
a no-op, while the first batch of a stream that was started anew is new data. A
batch that died before its commit is redone, so executor or driver loss never
leaves a half-applied upsert.

I2: first-seen dedup of names across runs with bounded state: a keyed state
that the watermark over ``scraped_at`` ends, behind a map-side minimum.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupStateTimeout

from ..functions.text import norm_key
from ..operators.upsert import apply_changes, conform_tracker, empty_tracker, upsert
from ..schema import TRACKER
from ..session import file_names, publish, write_table

SLOT_ROWS = 65_536


@dataclass(frozen=True)
class Commit:
    """A published state: the folder of each slot, and the last batch of each stream."""
    version: int
    slots: dict[str, str] = field(default_factory=dict)
    applied: dict[str, int] = field(default_factory=dict)
    slot_rows: int = SLOT_ROWS


def _sheet_code(sheet: Column) -> Column:
    return F.lower(F.hex(F.xxhash64(F.coalesce(sheet, F.lit("")))))


class SnapshotStore:
    """The tracker under ``root`` (a shared folder). ``slot_rows`` is fixed by
    the first commit."""

    def __init__(self, spark: SparkSession, root: str, slot_rows: int = SLOT_ROWS):
        self.spark, self.root, self.slot_rows = spark, root.rstrip("/"), slot_rows
        self.commits = f"{self.root}/commits"

    def latest(self) -> Commit | None:
        """The newest commit, or None."""
        names = file_names(self.spark, self.commits)
        if not names:
            return None
        text = self.spark.read.text(f"{self.commits}/{names[-1]}", wholetext=True).first()["value"]  # one small file
        return Commit(**json.loads(text))

    def applied(self, query: str, batch_id: int) -> bool:
        last = self.latest()
        return last is not None and batch_id <= last.applied.get(query, -1)

    def _read(self, folders: list[str]) -> DataFrame:
        if not folders:
            return empty_tracker(self.spark)
        return self.spark.read.schema(TRACKER).parquet(*sorted(folders))

    def read(self, commit: Commit | None = None, sheets: list[str] | None = None) -> DataFrame:
        """The tracker as of a commit (the newest by default), or some of its
        named tables, of which only their slots are read."""
        commit = commit or self.latest()
        if commit is None:
            raise RuntimeError(f"no committed snapshot under {self.root}")
        if sheets is None:
            return self._read(list(commit.slots.values()))
        given = self.spark.createDataFrame([(s,) for s in sheets], "sheet string")
        codes = {r["code"] for r in given.select(_sheet_code(F.col("sheet")).alias("code")).collect()}
        return self._read([d for slot, d in commit.slots.items() if slot.split("-")[0] in codes])

    def slot(self, slot_rows: int) -> Column:
        """Name of a row's slot, from its sheet and row_id."""
        return F.concat_ws("-", _sheet_code(F.col("sheet")), F.expr(f"row_id div {slot_rows}").cast("string"))

    def _write(self, rows: DataFrame, slot_rows: int) -> dict[str, str]:
        """Rows of whole slots, written; the folder of each slot."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        conform_tracker(rows).withColumn("slot", self.slot(slot_rows)).write.partitionBy("slot").parquet(folder)
        names = file_names(self.spark, folder)
        return {n.removeprefix("slot="): f"{folder}/{n}" for n in names}

    def _publish(self, commit: Commit) -> bool:
        text = json.dumps({"version": commit.version, "slots": commit.slots, "applied": commit.applied,
                           "slot_rows": commit.slot_rows})
        return publish(self.spark, f"{self.commits}/{commit.version:012d}", text)

    def create(self, tracker: DataFrame) -> bool:
        """Commit 0 with the whole tracker; False if there is one."""
        return self._publish(Commit(0, self._write(tracker, self.slot_rows), {}, self.slot_rows))

    def commit(self, query: str, batch_id: int, base: Commit, plan: DataFrame) -> bool:
        """Apply a plan worked out on ``base`` and publish the result; False if
        another commit came first. Only touched slots are read and written."""
        touched = [r["slot"] for r in plan.select(self.slot(base.slot_rows).alias("slot")).distinct().collect()]
        part = self._read([base.slots[s] for s in touched if s in base.slots])
        written = self._write(apply_changes(part, plan), base.slot_rows) if touched else {}
        rest = {s: d for s, d in base.slots.items() if s not in set(touched)}
        return self._publish(Commit(base.version + 1, rest | written, base.applied | {query: batch_id}, base.slot_rows))


def init_store(spark: SparkSession, root: str, tracker: DataFrame, slot_rows: int = SLOT_ROWS) -> SnapshotStore:
    """Store with ``tracker`` committed as version 0, unless it has commits."""
    store = SnapshotStore(spark, root, slot_rows)
    if store.latest() is None:
        store.create(tracker)
    return store


def upsert_batch(store: SnapshotStore, sheet: str, query: str):
    """foreachBatch function: one K1 upsert per micro-batch, idempotent by
    (query, batch id). ``query`` names the stream: its checkpoint folder, which
    a restart keeps and a new stream does not share."""

    def run(batch: DataFrame, batch_id: int) -> None:
        # a batch may have landed in a file or two: its rows are spread over all cores once
        spread = batch.repartition(batch.sparkSession.sparkContext.defaultParallelism, "ord")
        batch = write_table(spread, "batch")
        while True:
            base = store.latest()
            if base is None:
                raise RuntimeError(f"no committed snapshot under {store.root}")
            if batch_id <= base.applied.get(query, -1):
                return  # replayed batch
            plan = write_table(upsert(store.read(base), batch, sheet, stored=True).plan, "plan")
            if store.commit(query, batch_id, base, plan):
                return

    return run


def run_incremental(spark: SparkSession, landing: str, schema: T.StructType, store: SnapshotStore,
                    sheet: str, checkpoint: str, files_per_batch: int | None = None) -> DataFrame:
    """Drain everything landed since the last call (``availableNow``), one
    upsert per micro-batch (of ``files_per_batch`` files, or all that wait), and
    return the final snapshot."""
    reader = spark.readStream.schema(schema)
    stream = (reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)).parquet(landing)
    q = (stream.writeStream.foreachBatch(upsert_batch(store, sheet, checkpoint))
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return store.read()


def _first_rows(ts_col: str, order_col: str):
    """Per task, the first row of each name and one row with the latest time
    (which moves the watermark as the task's whole rows would)."""
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first = last = None
        for frame in frames:
            if not len(frame):
                continue
            top = frame.loc[[frame[ts_col].idxmax()]] if frame[ts_col].notna().any() else frame.iloc[:0]
            last = top if last is None or not len(last) or (len(top) and top[ts_col].iloc[0] > last[ts_col].iloc[0]) else last
            both = frame if first is None else pd.concat([first, frame])
            first = both.sort_values([ts_col, order_col]).drop_duplicates("_name_key")
        if first is not None:
            yield first
            yield last

    return run


def first_seen(stream: DataFrame, name_col: str = "name", ts_col: str = "scraped_at",
               delay: str = "7 days", order_col: str = "ord") -> DataFrame:
    """Keep the first row per name key within the watermark delay (state
    is bounded by the delay; exact all-time dedup stays with the known-name
    anti join, J2). Of a name's rows in one micro-batch the one with the
    smallest (time, order) is kept, whatever the partitions; a name is free
    again once the watermark has passed its first time by the delay. A task
    sends one row for each of its names to the state, however often it holds it
    (a task keeps its distinct names in memory)."""
    columns = list(stream.columns)
    hold = int(pd.Timedelta(delay).total_seconds() * 1000)

    def step(key, frames, state):
        if state.hasTimedOut:
            state.remove()
            return
        first = None
        for frame in frames:
            row = frame.sort_values([ts_col, order_col]).iloc[[0]]
            if first is None or (row[ts_col].iloc[0], row[order_col].iloc[0]) < (first[ts_col].iloc[0],
                                                                                 first[order_col].iloc[0]):
                first = row
        now = state.getCurrentWatermarkMs()
        if first is None or (state.exists and state.get[0] > now):
            return
        until = int(first[ts_col].iloc[0].timestamp() * 1000) + hold
        state.update((until,))
        state.setTimeoutTimestamp(max(until, now + 1))
        yield first[columns]

    keyed = stream.withColumn("_name_key", norm_key(name_col))
    return (keyed.mapInPandas(_first_rows(ts_col, order_col), keyed.schema)
            .withWatermark(ts_col, delay).groupBy("_name_key")
            .applyInPandasWithState(step, stream.schema, "until long", "append", GroupStateTimeout.EventTimeTimeout))
