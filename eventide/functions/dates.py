"""Date column functions.

The reference reads the clock; every function here takes ``as_of`` (a date
literal or a Column) so results are reproducible. All parsing uses the
``try_`` forms: ANSI mode is on by default and one bad row must not fail a job.
"""

from __future__ import annotations

import datetime as _dt
import zoneinfo

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import _col, ColumnOrName, let

# The five accepted date formats, in the reference's order of
# preference, as (shape guard, Spark pattern). The guards reproduce the
# reference parser's widths: 1-2 digit day/month, exactly 4-digit year.
DATE_FORMATS = [
    (r"^[A-Za-z]{3} \d{1,2}, \d{4}$", "MMM d, yyyy"),    # Jun 29, 2026
    (r"^[A-Za-z]+ \d{1,2}, \d{4}$", "MMMM d, yyyy"),     # June 29, 2026
    (r"^\d{4}-\d{1,2}-\d{1,2}$", "yyyy-M-d"),            # 2026-06-29
    (r"^[A-Za-z]{3} \d{1,2} \d{4}$", "MMM d yyyy"),      # Jun 29 2026
    (r"^\d{1,2} [A-Za-z]{3} \d{4}$", "d MMM yyyy"),      # 29 Jun 2026
]
# The Days column accepts only the first three of them.
DAYS_FORMATS = DATE_FORMATS[:3]

LOOKAHEAD_DAYS = 180


def as_date(as_of) -> Column:
    """Literal date (``str`` / ``date``) or an existing Column."""
    if isinstance(as_of, Column):
        return as_of
    if isinstance(as_of, _dt.date):
        as_of = as_of.isoformat()
    return F.to_date(F.lit(as_of))


def squeeze_ws(c: ColumnOrName) -> Column:
    """Trim, and fold inner whitespace runs to one blank (the reference's format
    blanks match any whitespace run)."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"^\s+|\s+$", ""), r"\s+", " ")


def _parse(c: ColumnOrName, formats) -> Column:
    def any_shape(text):
        return let(squeeze_ws(text), lambda s: F.coalesce(
            *[F.when(s.rlike(guard), F.try_to_date(s, pat)) for guard, pat in formats]))

    # most texts have the first shape as they are (which no other format reads), or are blank
    guard, pat = formats[0]
    return let(c, lambda text: F.when(text.rlike(guard), F.try_to_date(text, pat))
               .when(F.length(text) > 0, any_shape(text)))


def parse_date(c: ColumnOrName) -> Column:
    """first of the five formats that fits, else NULL."""
    return _parse(c, DATE_FORMATS)


def parse_date_days(c: ColumnOrName) -> Column:
    """The three-format parser of the Days column."""
    return _parse(c, DAYS_FORMATS)


def days_span(start: ColumnOrName, end: ColumnOrName) -> Column:
    """inclusive day count, at least 1; NULL when either side does not parse."""
    # greatest() skips NULLs, so guard explicitly: no count unless both parse
    n = F.datediff(parse_date_days(end), parse_date_days(start))
    return let(n, lambda d: F.when(d.isNotNull(), F.greatest(d + 1, F.lit(1))))


def fmt_date(d: ColumnOrName) -> Column:
    """F8: ``%b %d, %Y`` (zero-padded day)."""
    return F.date_format(_col(d), "MMM dd, yyyy")


def infer_year(month_day: ColumnOrName, as_of) -> Column:
    """a year-less "MMM d" falls on or after ``as_of`` within 12 months:
    this year if that is not before ``as_of``, else next year; NULL if neither
    calendar date exists (Feb 29) or it lies more than 12 months ahead."""
    a = as_date(as_of)
    y = F.year(a)

    def on(md, year_col):
        # a text that is no word and number is not tried: each failure raises inside the parser
        return F.when(md.rlike(r"^\S+ \d+$"), F.try_to_date(F.concat(md, F.lit(", "), year_col.cast("string")), "MMM d, yyyy"))

    def pick(md):
        return let(F.array(on(md, y), on(md, y + 1)), lambda ds: F.when(ds[0] >= a, ds[0])
                   .when(ds[1] < F.add_months(a, 12), ds[1]))

    return let(squeeze_ws(month_day), pick)


def is_past(d: ColumnOrName, as_of) -> Column:
    """Strictly before ``as_of``; an unknown date is not past."""
    return F.coalesce(_col(d) < as_date(as_of), F.lit(False))


def is_future(d: ColumnOrName, as_of) -> Column:
    """On or after ``as_of``; an unknown date counts as future."""
    return F.coalesce(_col(d) >= as_date(as_of), F.lit(True))


def in_lookahead(d: ColumnOrName, as_of, days: int = LOOKAHEAD_DAYS) -> Column:
    """P5: as_of <= d <= as_of + days, both inclusive; NULL -> False."""
    a = as_date(as_of)
    return F.coalesce(_col(d).between(a, F.date_add(a, days)), F.lit(False))


def timestamp_day_range(df, col: str, as_of, days: int):
    """P5 on a stored timestamp column, stated so Parquet can skip row groups:
    ``to_date(col)`` in [as_of, as_of + days] <=> col in [as_of 00:00,
    as_of + days + 1 00:00). The bounds take the column's own type (TIMESTAMP
    or TIMESTAMP_NTZ), so the column is never cast and the filter is pushed."""
    a = as_date(as_of)
    kind = df.schema[col].dataType.simpleString()
    lo, hi = a.cast(kind), F.date_add(a, days + 1).cast(kind)
    return df.where((F.col(col) >= lo) & (F.col(col) < hi))


def strip_year(c: ColumnOrName) -> Column:
    """remove a stand-alone 20xx year and the blanks around it."""
    return F.regexp_replace(F.regexp_replace(_col(c), r"\s*\b(20\d{2})\b\s*", " "), r"^\s+|\s+$", "")


def first_run_of_month(d: ColumnOrName) -> Column:
    """the first weekly run of a month (day of month <= 7)."""
    return F.dayofmonth(_col(d)) <= 7


def odd_iso_week(d: ColumnOrName) -> Column:
    """ISO week number is odd (weeks 53 and 1 both fire)."""
    return F.weekofyear(_col(d)) % 2 == 1


def gate(rule: Column, force: bool | Column = False) -> Column:
    """a step runs when forced or when its calendar rule fires."""
    f = force if isinstance(force, Column) else F.lit(bool(force))
    return f | F.coalesce(rule, F.lit(False))


# Zone names of a common calendar program and their places.
WINDOWS_ZONES = {
    "Pacific Standard Time": "America/Los_Angeles", "Mountain Standard Time": "America/Denver",
    "Central Standard Time": "America/Chicago", "Eastern Standard Time": "America/New_York",
    "Atlantic Standard Time": "America/Halifax", "E. South America Standard Time": "America/Sao_Paulo",
    "GMT Standard Time": "Europe/London", "Greenwich Standard Time": "Atlantic/Reykjavik",
    "W. Europe Standard Time": "Europe/Berlin", "Central Europe Standard Time": "Europe/Budapest",
    "Romance Standard Time": "Europe/Paris", "Central European Standard Time": "Europe/Warsaw",
    "GTB Standard Time": "Europe/Bucharest", "FLE Standard Time": "Europe/Kiev", "Russian Standard Time": "Europe/Moscow",
    "Israel Standard Time": "Asia/Jerusalem", "Arabian Standard Time": "Asia/Dubai", "India Standard Time": "Asia/Kolkata",
    "China Standard Time": "Asia/Shanghai", "Singapore Standard Time": "Asia/Singapore",
    "Tokyo Standard Time": "Asia/Tokyo", "Korea Standard Time": "Asia/Seoul", "AUS Eastern Standard Time": "Australia/Sydney",
    "New Zealand Standard Time": "Pacific/Auckland", "UTC": "UTC",
}


def known_zone(tzid: ColumnOrName) -> Column:
    """The zone of a TZID, or NULL if the name is not known (an unknown zone
    would end the job)."""
    places = sorted(z for z in zoneinfo.available_timezones() if "/" in z) + ["UTC", "GMT"]
    names = F.create_map(*[F.lit(x) for pair in WINDOWS_ZONES.items() for x in pair])
    return let(F.trim(_col(tzid)), lambda t: F.when(t.isin(places), t).otherwise(names[t]))


def ical_date(value: ColumnOrName, tzid: ColumnOrName | None = None) -> Column:
    """iCal DATE / DATE-TIME text -> UTC calendar date.

    ``YYYYMMDD`` is a date; ``...Z`` is UTC; with a TZID parameter the local
    time is converted to UTC; a naive time, or one whose zone is not known, is
    taken as is.
    """
    tz = F.lit(None).cast("string") if tzid is None else known_zone(tzid)

    def body(v):
        ts = F.try_to_timestamp(F.substring(v, 1, 15), F.lit("yyyyMMdd'T'HHmmss"))
        return (F.when(v.rlike(r"^\d{8}$"), F.try_to_date(v, "yyyyMMdd"))
                .when(v.rlike(r"^\d{8}T\d{6}Z$"), F.to_date(ts))
                .when(v.rlike(r"^\d{8}T\d{6}$") & tz.isNotNull() & (tz != ""),
                      F.to_date(F.to_utc_timestamp(ts, tz)))
                .when(v.rlike(r"^\d{8}T\d{6}$"), F.to_date(ts)))

    return let(F.regexp_replace(_col(value), r"^\s+|\s+$", ""), body)
