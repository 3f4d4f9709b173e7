"""Tracker maintenance: match, fold, append, patch, delete.

``upsert`` reproduces the reference's per-event loop exactly, as set
operations:

* every incoming row is matched against the *old* table (J3);
* matched rows: per (row, field) the last incoming value that is non-empty
  and differs from the old value wins (A4, ``max_by`` over ``ord``); Days is
  recomputed by the last input that changed a date and yields a count;
* unmatched rows: greedy two-key dedup in input order (W5), appended after
  the last row with manual columns blank;
* ``updated`` counts inputs that changed something, ``added`` counts appends.

Nothing is collected; the result is a new snapshot DataFrame, a change list to
show (K8), and the whole plan, which can be stored and applied later
(:func:`apply_changes`) to the table or to the part of it that it touches.
"""

from __future__ import annotations

from functools import cached_property, reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import days_span, parse_date
from ..functions.text import strip_ws
from ..schema import MANAGED_FIELDS, MANUAL_FIELDS, TRACKER, TRACKER_COLUMNS
from ..session import write_table
from .common import require_unique, with_positions
from .dedup import greedy_two_key
from .match import match_existing

_EVENT_FIELDS = ["name", "website"] + MANAGED_FIELDS
_PLANNED = ["row_no", *TRACKER_COLUMNS]  # fields that a plan may set


def _blank(c):
    return F.coalesce(F.col(c) if isinstance(c, str) else c, F.lit(""))


def conform_tracker(df: DataFrame) -> DataFrame:
    """K5: give any frame the tracker schema (missing columns NULL), with the
    typed date twins recomputed."""
    cols = []
    for f in TRACKER.fields:
        if f.name in ("start_dt", "end_dt"):
            continue
        cols.append((F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name))
    out = df.select(*cols)
    return (out.withColumn("start_dt", parse_date("start_date"))
            .withColumn("end_dt", parse_date("end_date")))


def empty_tracker(spark) -> DataFrame:
    """K5: an empty table with the tracker schema."""
    return spark.createDataFrame([], TRACKER)


class UpsertResult:
    """An upsert worked out: the result frames are built when they are asked for.

    * ``snapshot``: all rows of the target sheet after the upsert;
    * ``changes``: K8 list (action, sheet, row_id, field, old, new), an insert by
      its name;
    * ``plan``: the same with every field of an insert, to be applied;
    * ``counts``: one row (added, updated).
    """

    def __init__(self, sheet: str, target: DataFrame, compared: DataFrame, per_row: DataFrame, appended: DataFrame):
        self._sheet, self._target, self._compared = sheet, target, compared
        self._per_row, self._appended = per_row, appended

    @cached_property
    def snapshot(self) -> DataFrame:
        updated = self._target.join(self._per_row, "row_id", "left")
        sel = []
        for f in TRACKER.fields:
            if f.name in MANAGED_FIELDS:
                sel.append(F.coalesce(F.col(f"_fin_{f.name}"), F.col(f.name)).alias(f.name))
            elif f.name == "days":
                sel.append(F.coalesce(F.col("_fin_days"), F.col("days")).alias("days"))
            elif f.name not in ("start_dt", "end_dt"):
                sel.append(F.col(f.name))
        return conform_tracker(updated.select(*sel)).unionByName(conform_tracker(self._appended))

    @cached_property
    def _updates(self) -> DataFrame:
        fields = MANAGED_FIELDS + ["days"]
        old = self._target.select("row_id", *[F.col(c).cast("string").alias(f"_o_{c}") for c in fields])
        cells = [F.struct(F.lit(c).alias("field"), F.col(f"_o_{c}").alias("old"),
                          F.col(f"_fin_{c}").cast("string").alias("new")) for c in fields]
        return (self._per_row.join(old, "row_id").select("row_id", F.explode(F.array(*cells)).alias("_c"))
                .where(F.col("_c.new").isNotNull())
                .select(F.lit("update").alias("action"), F.lit(self._sheet).alias("sheet"), "row_id", "_c.field", "_c.old", "_c.new"))

    @cached_property
    def changes(self) -> DataFrame:
        return self._updates.unionByName(self._appended.select(
            F.lit("insert").alias("action"), F.lit(self._sheet).alias("sheet"), "row_id", F.lit("name").alias("field"),
            F.lit(None).cast("string").alias("old"), F.col("name").alias("new")))

    @cached_property
    def plan(self) -> DataFrame:
        cells = [F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("new")) for f in _PLANNED]
        rows = (self._appended.select("row_id", F.explode(F.array(*cells)).alias("_c"))
                .where(F.coalesce("_c.new", F.lit("")) != ""))
        return self._updates.unionByName(rows.select(
            F.lit("insert").alias("action"), F.lit(self._sheet).alias("sheet"), "row_id", "_c.field",
            F.lit(None).cast("string").alias("old"), "_c.new"))

    @cached_property
    def counts(self) -> DataFrame:
        return (self._appended.select(F.lit(1).alias("_a"), F.lit(0).alias("_u"))
                .unionByName(self._compared.select(F.lit(0).alias("_a"), F.col("_changed").cast("int").alias("_u")))
                .agg(F.coalesce(F.sum("_a"), F.lit(0)).cast("long").alias("added"),
                     F.coalesce(F.sum("_u"), F.lit(0)).cast("long").alias("updated")))


def upsert(tracker: DataFrame, incoming: DataFrame, sheet: str,
           carry_manual: bool = False, dedup_case_fold: bool = True, stored: bool = False) -> UpsertResult:
    """K1 into one named table of ``tracker``.

    ``incoming`` needs ``ord`` (unique, arrival order) and any of the event
    fields; ``carry_manual=True`` keeps manual columns present on the input
    for appended rows (the reference writes them blank). A ``stored`` input is
    read again instead of written.
    """
    target = tracker.where(F.col("sheet") == sheet)
    given = _EVENT_FIELDS + (MANUAL_FIELDS if carry_manual else [])
    inc = incoming.select("ord", *[
        (F.col(c) if c in incoming.columns else F.lit(None)).cast("string").alias(c) for c in given])
    inc = inc if stored else write_table(inc, "upsert-in")
    require_unique(inc, "ord", "upsert")
    matched_all = write_table(match_existing(inc, target, "name", "website", "row_id", "row_no"), "upsert-matched")  # read twice
    matched = matched_all.where(F.col("match_row_id").isNotNull())
    unmatched = matched_all.where(F.col("match_row_id").isNull()).drop("match_row_id", "match_by")

    # ---- updates (A4) ------------------------------------------------------
    old = target.select(F.col("row_id").alias("match_row_id"),
                        *[strip_ws(_blank(c)).alias(f"_old_{c}") for c in MANAGED_FIELDS])
    m = matched.join(old, "match_row_id").withColumns({f"_new_{c}": strip_ws(_blank(c)) for c in MANAGED_FIELDS})
    changed = {c: (F.col(f"_new_{c}") != "") & (F.col(f"_new_{c}") != F.col(f"_old_{c}")) for c in MANAGED_FIELDS}
    m = m.withColumns({f"_chg_{c}": condition for c, condition in changed.items()})
    start_for_days = F.when(_blank("start_date") != "", F.col("start_date")).otherwise(F.col("_old_start_date"))
    end_for_days = F.when(_blank("end_date") != "", F.col("end_date")).otherwise(F.col("_old_end_date"))
    date_changed = F.col("_chg_start_date") | F.col("_chg_end_date")
    m = m.withColumns({"_changed": reduce(lambda a, b: a | b, [F.col(f"_chg_{c}") for c in MANAGED_FIELDS]),
                       "_days": F.when(date_changed, days_span(start_for_days, end_for_days))})
    aggs = [F.max_by(F.col(f"_new_{c}"), F.when(F.col(f"_chg_{c}"), F.col("ord"))).alias(f"_fin_{c}")
            for c in MANAGED_FIELDS]
    aggs.append(F.max_by(F.col("_days"), F.when(F.col("_days").isNotNull(), F.col("ord"))).alias("_fin_days"))
    per_row = m.where("_changed").groupBy(F.col("match_row_id").alias("row_id")).agg(*aggs)

    # ---- appends (W5 + K2) -------------------------------------------------
    fresh = greedy_two_key(unmatched, "name", "website", "ord", case_fold=dedup_case_fold, check_order=False,
                           stored=True)
    # row_no is positional within the sheet; row_id is unique across the tracker.
    # Both offsets are one-row aggregates, read as scalars.
    b = tracker.agg(F.coalesce(F.max(F.when(F.col("sheet") == sheet, F.col("row_no"))), F.lit(1)).alias("n"),
                    F.coalesce(F.max("row_id"), F.lit(0)).alias("i")).first()
    fresh = with_positions(fresh, "ord", "_pos", start=1)
    appended = fresh.select(
        F.lit(sheet).alias("sheet"),
        (F.lit(b["i"]) + F.col("_pos")).cast("long").alias("row_id"),
        (F.lit(b["n"]) + F.col("_pos")).cast("long").alias("row_no"),
        strip_ws(_blank("name")).alias("name"),
        *[_blank(c).alias(c) for c in MANAGED_FIELDS],
        strip_ws(_blank("website")).alias("website"),
        days_span(_blank("start_date"), _blank("end_date")).alias("days"),
        *[(_blank(c) if carry_manual else F.lit("")).alias(c) for c in MANUAL_FIELDS],
    )
    return UpsertResult(sheet, target, m, per_row, appended)


def apply_changes(tracker: DataFrame, plan: DataFrame) -> DataFrame:
    """K8: the tracker after a plan (action, sheet, row_id, field, old, new):
    updates set single fields of rows by id, inserts add rows, a field that is
    not planned being blank, and deletes drop rows. Ids that the tracker does
    not hold are updated nowhere, so a plan may be applied to a part of it. The
    plan's rows are folded by id in one aggregate and met in one join."""
    wide = plan.groupBy("row_id").agg(
        F.first("action").alias("_action"), F.first("sheet").alias("_sheet"),
        *[F.max(F.when(F.col("field") == f, F.col("new"))).alias(f"_new_{f}") for f in _PLANNED])
    kept = tracker.join(wide.where("_action <> 'insert'"), "row_id", "left").where("coalesce(_action, '') <> 'delete'")
    kept = kept.select(*[F.coalesce(F.col(f"_new_{c}").cast(tracker.schema[c].dataType), F.col(c)).alias(c)
                         if c in _PLANNED else F.col(c) for c in tracker.columns])
    blank = {f.name: F.lit("") for f in TRACKER.fields if f.dataType.simpleString() == "string"}
    added = wide.where("_action = 'insert'").select(
        F.col("_sheet").alias("sheet"), "row_id",
        *[F.coalesce(F.col(f"_new_{f}"), blank[f]).alias(f) if f in blank else F.col(f"_new_{f}").alias(f) for f in _PLANNED])
    return conform_tracker(kept).unionByName(conform_tracker(added))


def stale_changes(tracker: DataFrame, plan: DataFrame) -> DataFrame:
    """Updates of a stored plan whose row is gone or no longer holds the old
    value: (row_id, field, old, current)."""
    cells = tracker.select("row_id", F.explode(F.array(*[
        F.struct(F.lit(f).alias("field"), F.col(f).cast("string").alias("current")) for f in _PLANNED])).alias("_c"))
    updates = plan.where("action = 'update'").select("row_id", "field", "old")
    return (updates.join(cells.select("row_id", "_c.*"), ["row_id", "field"], "left")
            .where(F.coalesce("old", F.lit("")) != F.coalesce("current", F.lit(""))))


def replace_sheet(tracker: DataFrame, sheet: str, rows: DataFrame) -> DataFrame:
    """New snapshot of the whole tracker with one named table replaced."""
    return tracker.where(F.col("sheet") != sheet).unionByName(conform_tracker(rows))


def patch_cfp(tracker: DataFrame, patches: DataFrame) -> DataFrame:
    """K3: patch CFP date / status of rows by ``row_id``; only non-empty values
    are written. ``patches``: row_id, cfp_date, cfp_status."""
    p = patches.select("row_id", F.col("cfp_date").alias("_p_date"), F.col("cfp_status").alias("_p_status"))
    x = tracker.join(p, "row_id", "left")
    x = (x.withColumn("cfp_date", F.coalesce(F.nullif(_blank("_p_date"), F.lit("")), F.col("cfp_date")))
         .withColumn("cfp_status", F.coalesce(F.nullif(_blank("_p_status"), F.lit("")), F.col("cfp_status"))))
    return x.drop("_p_date", "_p_status").select(*tracker.columns)


def delete_rows(tracker: DataFrame, row_ids: DataFrame) -> DataFrame:
    """K4: remove rows by id (positions are moot: ids are surrogate keys)."""
    return tracker.join(row_ids.select("row_id").distinct(), "row_id", "left_anti").select(*tracker.columns)


def save_tracker(df: DataFrame, path: str) -> None:
    """K2/K5 sink: one tracker snapshot as Parquet partitioned by ``sheet``,
    so a read of one named table prunes to its partition."""
    conform_tracker(df).write.mode("overwrite").partitionBy("sheet").parquet(path)


def load_tracker(spark, path: str, sheets: list[str] | None = None, must_exist: bool = False) -> DataFrame:
    """Read a saved snapshot (optionally only some named tables: partition
    pruning), columns in tracker order. A path that is not there is an empty
    table, unless it ``must_exist`` (a commit names it); any other failure to
    read is raised."""
    from pyspark.errors import AnalysisException

    try:
        df = spark.read.schema(TRACKER).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND" or must_exist:
            raise
        return empty_tracker(spark)
    if sheets:
        df = df.where(F.col("sheet").isin(*sheets))
    return df.select(*[f.name for f in TRACKER.fields])
