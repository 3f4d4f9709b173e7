"""Calendar (.ics) scan (S1, F7, F8, W2, P5, P13, P14) -- native text handling.

Calendars come in two forms. A table of documents has ``(path, value)`` rows, and
a document is one task's work (:func:`vevents`). Landed files are read event by
event (:func:`read_calendars`): Spark cuts a file into byte ranges and hands its
records, ended by ``BEGIN:VEVENT``, to as many tasks, so that one calendar of any
size is read by many. Every property is a ``regexp_extract``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dates import fmt_date, ical_date, in_lookahead
from ..functions.text import default_fill, let, strip_ws, truncate
from ..operators.common import order_key, sized_broadcast
from ..operators.dedup import first_wins
from ..vocab import SUMMARY_CARD_CHARS

_BLOCK_RE = r"(?s)BEGIN:VEVENT\r?\n(.*?)END:VEVENT"
_RECORD_RE = r"(?s)^\r?\n(.*?)END:VEVENT"  # of a record, which follows its BEGIN:VEVENT


# Parameters of a property; a quoted value may hold colons and semicolons.
_PARAMS = r'((?:;[^":\r\n]*(?:"[^"\r\n]*"[^":\r\n]*)*)?)'
# Components inside an event (alarms) have properties of their own.
_NESTED = r"(?s)BEGIN:([A-Z-]+)\r?\n.*?END:\1(?:\r?\n)?"


def _pattern(name: str) -> str:
    return rf"(?m)^{name}{_PARAMS}:([^\r\n]*)"


def _line(block, name: str):
    """The first ``NAME[;params]:value`` line, or '' when absent."""
    return F.regexp_extract(block, _pattern(name), 0)


def _value(line, name: str):
    """Value of a property's line, or NULL when it is absent."""
    return (F.when(line.startswith(f"{name}:"), F.substring(line, F.lit(len(name) + 2), F.length(line)))
            .when(line != "", F.regexp_extract(line, _pattern(name), 2)))


def _text(block, name: str, read=lambda c: c):
    """Stripped value of a property as ``read``, '' when absent."""
    return let(_line(block, name), lambda line: strip_ws(read(F.coalesce(_value(line, name), F.lit("")))))


def _time(block, name: str):
    """struct(value, tzid) of a DATE or DATE-TIME property."""
    def parts(line):
        params = F.regexp_extract(line, _pattern(name), 1)
        zone = F.when(line.startswith(f"{name};"), F.regexp_extract(params, r'TZID="?([^;:"]*)', 1)).otherwise(F.lit(""))
        return F.struct(_value(line, name).alias("value"), zone.alias("tzid"))

    return let(_line(block, name), parts)


def unescape_text(c):
    """iCal TEXT unescaping: \\n \\N -> newline, \\, \\; \\\\ -> literal."""
    s = F.replace(c, F.lit("\\\\"), F.lit("\u0000"))
    for a, b in (("\\n", "\n"), ("\\N", "\n"), ("\\,", ","), ("\\;", ";")):
        s = F.replace(s, F.lit(a), F.lit(b))
    return F.replace(s, F.lit("\u0000"), F.lit("\\"))


def vevents(feeds: DataFrame) -> DataFrame:
    """(path, pos, name, dtstart, tzid, dtend, end_tzid, location, url, description);
    other columns of the documents are kept after the path."""
    others = ["path", *[c for c in feeds.columns if c not in ("path", "value")]]
    unfolded = feeds.select(*others, F.regexp_replace("value", r"\r?\n[ \t]", "").alias("_v"))
    blocks = unfolded.select(*others, F.posexplode(F.regexp_extract_all("_v", F.lit(_BLOCK_RE), 1)).alias("pos", "_b"))
    return _event_fields(blocks.select(*others, (F.col("pos") + 1).cast("int").alias("pos"), "_b"))


def read_calendars(spark: SparkSession, path: str) -> DataFrame:
    """(path, pos, ...) as :func:`vevents`, from the calendar files under
    ``path``, which may be split; ``pos`` is an array that orders the events of a
    file: the start of their byte range and their place in it. An event ends
    with its first ``END:VEVENT``; one that never ends is left out. Columns of a
    partitioned folder are kept."""
    records = (spark.read.option("lineSep", "BEGIN:VEVENT").text(path)
               .withColumn("path", F.col("_metadata.file_path"))
               .withColumn("pos", F.array(F.col("_metadata.file_block_start"), F.monotonically_increasing_id())))
    body = F.regexp_extract(F.regexp_replace("value", r"\r?\n[ \t]", ""), _RECORD_RE, 1)
    return _event_fields(records.withColumn("_b", body).drop("value").where(F.col("_b") != ""))


def _event_fields(blocks: DataFrame) -> DataFrame:
    """Properties of the event blocks ``_b``; other columns are kept."""
    others = [c for c in blocks.columns if c != "_b"]
    b = F.col("_b")
    blocks = blocks.withColumn("_b", F.when(F.contains(b, F.lit("BEGIN:")), F.regexp_replace(b, _NESTED, "")).otherwise(b))
    # name and start are what a filter reads: a generator's output is found once, whatever reads it, and the other
    # properties of an event that a filter drops are not looked for
    blocks = blocks.select(*others, "_b", F.inline(F.array(F.struct(
        _text(b, "SUMMARY", unescape_text).alias("name"), _time(b, "DTSTART").alias("_start")))))
    end = _time(b, "DTEND")
    return blocks.select(
        *others, "name", F.col("_start.value").alias("dtstart"), F.col("_start.tzid").alias("tzid"),
        end["value"].alias("dtend"), end["tzid"].alias("end_tzid"),
        _text(b, "LOCATION", unescape_text).alias("location"), _text(b, "URL").alias("url"),
        _text(b, "DESCRIPTION", unescape_text).alias("description"))


def scan_calendars(feeds: DataFrame, registry: DataFrame, as_of, lookahead_days: int = 180, key: str = "path") -> DataFrame:
    """Upcoming named events of every feed; location defaults to the
    feed's; first-wins by lower-cased name across feeds in registry order.

    ``feeds`` are documents (path, value) or the events of
    :func:`read_calendars`; ``registry``: ``key`` (path, or another column of the
    events), label, default_location, rank (a small dimension).
    """
    rank = F.col("rank") if dict(registry.dtypes)["rank"].startswith("array") else order_key("rank")
    reg = sized_broadcast(registry.select(key, "label", "default_location", rank.alias("rank")))
    if "value" in feeds.columns:  # a registry too large to be sent meets the documents, not their many events
        ev = vevents(feeds.select(*{"path": 0, key: 0}, "value").join(reg, key)).withColumn("pos", order_key("pos"))
    else:
        ev = feeds.join(reg, key)
    start = ical_date(F.col("dtstart"), F.col("tzid"))
    end = ical_date(F.col("dtend"), F.col("end_tzid"))
    ev = (ev.where((F.col("name") != "") & let(start, lambda d: in_lookahead(d, as_of, lookahead_days)))
          .withColumn("_start", start).withColumn("_end", end))
    ev = first_wins(ev.withColumn("_nk", F.lower("name")), ["_nk"], ["rank", "pos"])
    return ev.select(
        "name", F.concat(F.lit("iCal ("), F.col("label"), F.lit(")")).alias("source"),
        default_fill(F.col("location"), F.col("default_location")).alias("raw_location"),
        fmt_date("_start").alias("raw_start_date"),
        F.coalesce(fmt_date("_end"), F.lit("")).alias("raw_end_date"),
        F.col("url").alias("website"), truncate(F.col("description"), SUMMARY_CARD_CHARS).alias("card_text"),
        F.concat("rank", "pos").alias("ord"))
