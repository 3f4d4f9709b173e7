"""Fixed schemas of the curation tables."""

from __future__ import annotations

from pyspark.sql import types as T

S = T.StringType()

RAW_EVENT = T.StructType([
    T.StructField("name", S), T.StructField("source", S), T.StructField("category", S),
    T.StructField("raw_location", S), T.StructField("focus_city", S),
    T.StructField("raw_start_date", S), T.StructField("raw_end_date", S),
    T.StructField("website", S), T.StructField("card_text", S),
    T.StructField("cfp_status", S), T.StructField("cfp_date", S),
    T.StructField("hint_demo_suitable", T.BooleanType()),
    T.StructField("scraped_at", T.TimestampType()),
    T.StructField("source_rank", T.IntegerType()), T.StructField("ord", T.ArrayType(T.LongType())),
])

# The tracker's columns in sheet order (B..O), the pipeline-managed
# fields, and the manual fields that are never overwritten.
TRACKER_COLUMNS = ["name", "category", "cfp_date", "cfp_status", "location", "start_date",
                   "end_date", "website", "days", "notes", "assignee", "attendees",
                   "engagement", "comment"]
MANAGED_FIELDS = ["category", "cfp_date", "cfp_status", "location", "start_date", "end_date"]
MANUAL_FIELDS = ["notes", "assignee", "attendees", "engagement", "comment"]

TRACKER = T.StructType(
    [T.StructField("sheet", S), T.StructField("row_id", T.LongType()),
     T.StructField("row_no", T.LongType())]
    + [T.StructField(c, T.IntegerType() if c == "days" else S) for c in TRACKER_COLUMNS]
    + [T.StructField("start_dt", T.DateType()), T.StructField("end_dt", T.DateType())]
)

# The named tables of the tracker.
CONFERENCES = "Conferences"
MEETUPS = "Meet-ups"
EXCLUDED = "Excluded"
TIME_PASSED = "Time Passed"
SF_DEMOS = "SF Product Demos"
