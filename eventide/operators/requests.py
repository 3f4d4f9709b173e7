"""Request projection for a batch scorer or lookup service.

One text per row rendered from a template with native string functions; the
per-city fan-out is a generator (``explode`` of the fixed city list), not a
join.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import strip_year
from ..functions.text import city_key, date_range_label, default_fill, truncate
from ..vocab import MEETUP_CITIES

CLASSIFY_CHARS = 400


def cfp_requests(events: DataFrame, key: str = "key") -> DataFrame:
    """One CFP lookup per event: name, location or 'unknown', the date range
    label, website or 'unknown'."""
    text = F.format_string("CFP lookup | %s | %s | %s | %s",
                           F.col("name"), default_fill(F.col("location"), F.lit("unknown")),
                           date_range_label(F.col("start_date"), F.col("end_date")),
                           default_fill(F.col("website"), F.lit("unknown")))
    return events.select(F.concat(F.lit("cfp:"), F.col(key).cast("string")).alias("req_id"),
                         F.lit("cfp").alias("kind"), F.col(key).cast("string").alias("key"), text.alias("text"))


def city_requests(segments: DataFrame, cities=MEETUP_CITIES, segment: str = "segment") -> DataFrame:
    """One discovery request per (segment, city), with the compact city key."""
    x = segments.select(F.col(segment).alias("_seg"),
                        F.explode(F.array(*[F.lit(c) for c in cities])).alias("_city"))
    ck = city_key(F.col("_city"))
    return x.select(F.concat(F.lit("city:"), F.col("_seg"), F.lit(":"), ck).alias("req_id"),
                    F.lit("meetup").alias("kind"), F.concat(F.col("_seg"), F.lit("/"), ck).alias("key"),
                    F.format_string("Find %s meetups in %s (%s)", F.col("_seg"), F.col("_city"), ck).alias("text"))


def _request(df: DataFrame, kind: str, key: str, text) -> DataFrame:
    k = F.col(key).cast("string")
    return df.select(F.concat(F.lit(f"{kind}:"), k).alias("req_id"), F.lit(kind).alias("kind"), k.alias("key"),
                     text.alias("text"))


def classify_requests(events: DataFrame, key: str = "key", card_chars: int = CLASSIFY_CHARS) -> DataFrame:
    """One classification request per event: name, source, location, date,
    website and the first ``card_chars`` characters of its text (P14)."""
    return _request(events, "classify", key, F.format_string(
        "Classify | %s | %s | %s | %s | %s | %s", F.col("name"), F.col("source"),
        default_fill(F.col("location"), F.lit("unknown")), default_fill(F.col("start_date"), F.lit("unknown")),
        default_fill(F.col("website"), F.lit("unknown")), truncate(F.col("card_text"), card_chars)))


def edition_requests(archived: DataFrame, as_of, key: str = "key") -> DataFrame:
    """One next-edition lookup per archived event: its name without the year,
    the year to look for, location and website."""
    year = F.year(F.lit(str(as_of)).cast("date")).cast("string")
    return _request(archived, "edition", key, F.format_string(
        "Next edition | %s | after %s | %s | %s", strip_year(F.col("name")), year,
        default_fill(F.col("location"), F.lit("unknown")), default_fill(F.col("website"), F.lit("unknown"))))


def discovery_requests(segments: DataFrame, segment: str = "segment", known: str = "known") -> DataFrame:
    """One discovery request per segment with the block of known names."""
    return _request(segments, "discover", segment, F.format_string(
        "Find new %s events. Already known:\n%s", F.col(segment), F.col(known)))


def retry_requests(shortfalls: DataFrame, segment: str = "segment") -> DataFrame:
    """M7: a broader request for each segment that fell short of its target."""
    return _request(shortfalls.where("retry"), "retry", segment, F.format_string(
        "Find %d more %s events; search more widely.", F.col("short"), F.col(segment)))
