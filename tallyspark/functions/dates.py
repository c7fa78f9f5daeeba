"""Date expressions."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyspark.constants import PRESET_NAMES

# Accepted date layouts, tried in order.  Each is guarded by a regex
# that requires a full date, so "2024" never becomes 2024-01-01.
# ISO dates (optionally with a time) use Spark's built-in string-to-timestamp
# cast, a hand-written parser; slash layouts are built from their parts.
# Both yield wall-clock (timestamp_ntz) values without the session time zone.
ISO_RX = r"^\d{4}-\d{1,2}-\d{1,2}([ T]\d{1,2}:\d{2}(:\d{2}(\.\d+)?)?)?$"
# layout regex with (year, month, day) groups
YEAR_FIRST = (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", (1, 2, 3))
MONTH_FIRST = (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 1, 2))
DAY_FIRST = (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", (3, 2, 1))

WEEKDAY_NAMES_FMT = "EEEE"
MONTH_NAMES_FMT = "MMMM"


def parse_date(c: Column, day_first: bool = False) -> Column:
    """Text -> timestamp_ntz; unparseable (or impossible, 31/02) -> NULL.

    ``05/01/2024`` is the 1st of May unless ``day_first``; a date that is
    impossible in the chosen order is read in the other one.
    """
    formats = [YEAR_FIRST, *((DAY_FIRST, MONTH_FIRST) if day_first else (MONTH_FIRST, DAY_FIRST))]
    s = F.trim(c.cast("string"))
    iso = F.when(s.rlike(ISO_RX), s.try_cast("timestamp_ntz"))
    parsed = []
    for rx, (y, m, d) in formats:
        part = [F.regexp_extract(s, rx, g).try_cast("int") for g in (y, m, d)]
        parsed.append(F.when(s.rlike(rx), F.try_make_timestamp_ntz(
            part[0], part[1], part[2], F.lit(0), F.lit(0), F.lit(0))))
    return F.coalesce(iso, *parsed)


def weekday(c: Column) -> Column:
    """Monday = 0 ... Sunday = 6."""
    return F.weekday(c)


def calendar_columns(c: Column) -> dict[str, Column]:
    """The calendar columns added to a transaction table."""
    wd = weekday(c)
    return {
        "año": F.year(c),
        "mes": F.month(c),
        "dia": F.dayofmonth(c),
        "dia_semana": wd,
        "dia_semana_nombre": F.date_format(c, WEEKDAY_NAMES_FMT),
        "mes_nombre": F.date_format(c, MONTH_NAMES_FMT),
        "trimestre": F.quarter(c),
        "es_fin_semana": F.coalesce(wd.isin(5, 6), F.lit(False)),
    }


def period_name(c: Column) -> Column:
    """``Jan 2024``."""
    return F.date_format(c, "MMM yyyy")


def date_range_label(start: Column, end: Column) -> Column:
    """Label for a date range in three shapes."""
    same_year = F.year(start) == F.year(end)
    same_month = same_year & (F.month(start) == F.month(end))
    return (F.when(same_month, F.concat(F.dayofmonth(start).cast("string"), F.lit("-"),
                                        F.dayofmonth(end).cast("string"), F.lit(" "),
                                        F.date_format(start, "MMMM yyyy")))
             .when(same_year, F.concat(F.date_format(start, "MMMM"), F.lit(" - "),
                                       F.date_format(end, "MMMM yyyy")))
             .otherwise(F.concat(F.date_format(start, "MMMM yyyy"), F.lit(" - "),
                                 F.date_format(end, "MMMM yyyy"))))


# Preset ranges relative to an "as of" instant (B15): name, start, end.

def preset_ranges(as_of: dt.datetime) -> list[tuple[str, dt.datetime, dt.datetime]]:
    d = dt.timedelta
    return [
        (PRESET_NAMES[0], as_of - d(days=7), as_of),
        (PRESET_NAMES[1], as_of - d(days=30), as_of),
        (PRESET_NAMES[2], as_of - d(days=90), as_of),
        (PRESET_NAMES[3], as_of - d(days=365), as_of),
        (PRESET_NAMES[4], dt.datetime(as_of.year, 1, 1), as_of),
        (PRESET_NAMES[5], dt.datetime(as_of.year - 1, 1, 1), dt.datetime(as_of.year - 1, 12, 31)),
    ]


def ts_lit(x: dt.datetime | dt.date) -> Column:
    """A wall-clock literal, independent of the Python and session time zones."""
    if not isinstance(x, dt.datetime):
        x = dt.datetime(x.year, x.month, x.day)
    return F.lit(x.isoformat(sep=" ")).cast("timestamp_ntz")


def in_range(c: Column, start: dt.datetime, end: dt.datetime) -> Column:
    return (c >= ts_lit(start)) & (c <= ts_lit(end))
