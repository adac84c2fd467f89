"""Dates, clocks, ages and seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from asofkit.functions.prob import _c


def clock_24h(text) -> Column:
    """'7:10 PM ET' -> '19:10'; NULL without a readable time."""
    t = _c(text)
    pat = r"(?i)(\d{1,2}):(\d{2})\s*(AM|PM)"
    h = F.regexp_extract(t, pat, 1).try_cast("int")
    pm = F.upper(F.regexp_extract(t, pat, 3)) == "PM"
    hour = h % 12 + F.when(pm, 12).otherwise(0)
    return F.when(h.isNotNull(), F.concat(F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), F.regexp_extract(t, pat, 2)))


def day_or_night(hhmm) -> Column:
    h = F.substring(_c(hhmm), 1, 2).try_cast("int")
    return F.when(h.isNotNull(), F.when(h < 17, "day").otherwise("night"))


def slate_date(ts_utc, zone: str = "America/New_York") -> Column:
    """Local calendar day of a UTC time."""
    return F.to_date(F.convert_timezone(F.lit("UTC"), F.lit(zone), _c(ts_utc)))


def age_years(on, born) -> Column:
    return F.datediff(_c(on), _c(born)) / 365.25


def season_of(date) -> Column:
    """Season a day belongs to: January and February count to the year before."""
    d = _c(date)
    return F.when(F.month(d) >= 3, F.year(d)).otherwise(F.year(d) - 1)


def postseason(date, month: int = 10) -> Column:
    return F.month(_c(date)) >= month
