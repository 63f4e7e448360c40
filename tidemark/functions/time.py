"""Zone conversion, session predicates, window bounds, bands and calendar slices.

Wall-clock columns are zone-less timestamps and instants are bigint microseconds, so nothing
here depends on the session time zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import MICROS, date_micros, floor_div, floored, ntz_micros

NEW_YORK = "America/New_York"
YEAR_SECONDS_CALENDAR = 365.25 * 86_400
YEAR_SECONDS_365 = 365.0 * 86_400
MINUTE_US = 60 * MICROS


def ntz_from_micros(us: Column) -> Column:
    return F.timestamp_add("MICROSECOND", us, F.expr("TIMESTAMP_NTZ'1970-01-01 00:00:00'"))


def parse_wall(text: Column, fmt: str, zone: str) -> Column:
    """Zone-less text in an explicit zone to UTC microseconds."""
    if not zone:
        raise ValueError("a source zone is required")
    wall = F.to_timestamp_ntz(text, F.lit(fmt))
    return ntz_micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def to_wall(us: Column, zone: str = NEW_YORK) -> Column:
    """UTC microseconds to the wall clock of a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(zone), ntz_from_micros(us))


def to_utc(wall: Column, zone: str = NEW_YORK) -> Column:
    """Wall clock of a zone to UTC microseconds."""
    return ntz_micros(F.convert_timezone(F.lit(zone), F.lit("UTC"), wall))


def session_date(us: Column, zone: str = NEW_YORK) -> Column:
    return F.to_date(to_wall(us, zone))


def wall_minute(us: Column, zone: str = NEW_YORK) -> Column:
    w = to_wall(us, zone)
    return F.hour(w) * 60 + F.minute(w)


def is_regular_minute(us: Column, zone: str = NEW_YORK) -> Column:
    """Weekday and 09:30 <= wall clock < 16:00."""
    m = wall_minute(us, zone)
    return (F.dayofweek(to_wall(us, zone)).between(2, 6)) & (m >= 570) & (m < 960)


def is_aligned(us: Column, minutes: int = 5) -> Column:
    return F.pmod(us, F.lit(minutes * MINUTE_US)) == 0


def aligned_origin(us: Column, minutes: int = 5) -> Column:
    """The instant itself when it is an aligned regular-session minute, otherwise null."""
    return F.when(is_regular_minute(us) & is_aligned(us, minutes), us)


def window_bounds(origin_us: Column, delay_s: int, minutes: int = 5) -> tuple[Column, Column]:
    end = origin_us - F.lit(delay_s * MICROS)
    return end - F.lit(minutes * MINUTE_US), end


def strict_window_origin(executed_us: Column, delay_s: int, minutes: int = 5) -> Column:
    """The one origin whose half-open window holds an execution; a boundary goes to the next."""
    step = minutes * MINUTE_US
    return (floor_div(executed_us + F.lit(delay_s * MICROS), step) + 1) * F.lit(step)


def expiry_close(df: DataFrame, calendar: DataFrame, expiry: str, fallback_minute: int) -> DataFrame:
    """Add ``expiry_close_us``: that session's close, or the regular close on other dates."""
    close = calendar.where(F.col("minutes") > 0).select(
        F.col("session_date").alias(expiry), F.col("close_us").alias("_close")
    )
    regular = date_micros(expiry) + F.lit(fallback_minute * MINUTE_US)
    return (
        df.join(close, expiry, "left")
        .withColumn("expiry_close_us", F.coalesce("_close", regular))
        .drop("_close")
    )


def tenor_years(
    close_us: Column, at_us: Column, year_seconds: float = YEAR_SECONDS_CALENDAR, floor_zero: bool = False
) -> Column:
    """Exact time to expiry in years; an expired contract reads non-positive unless floored."""
    t = (close_us - at_us) / F.lit(float(MICROS)) / F.lit(year_seconds)
    return floored(t, 0.0) if floor_zero else t


def band_id(minute: Column, width: int = 30) -> Column:
    return F.floor(minute / width).cast("bigint")


def session_tercile(minute: Column, first: int = 130, second: int = 260, closed: bool = False) -> Column:
    """FIRST, MIDDLE, LAST; ``closed`` puts a boundary minute in the earlier third."""
    lo = minute <= first if closed else minute < first
    mid = minute <= second if closed else minute < second
    return F.when(lo, "FIRST").when(mid, "MIDDLE").otherwise("LAST")


def band_key(asset: Column, minute: Column, grain: str) -> Column:
    """Calibration key: the asset alone or the asset with its 5, 30 or 60 minute band."""
    if grain == "asset":
        return asset
    return F.concat_ws("|", asset, F.concat(F.lit(grain + "m:"), band_id(minute, int(grain))))


def harmonics(minute: Column, length: float = 390.0) -> tuple[Column, Column]:
    a = F.lit(2.0 * math.pi / length) * minute
    return F.sin(a), F.cos(a)


def third_friday(day: Column) -> Column:
    """Third Friday of the month of a date."""
    return F.date_add(F.next_day(F.date_sub(F.trunc(day, "MM"), 1), "Fri"), 14)


def is_expiration_week(day: Column) -> Column:
    """The Monday-to-Friday week that ends on the third Friday."""
    f = third_friday(day)
    return (day >= F.date_sub(f, 4)) & (day <= f)


def day_part(minute: Column, length: Column, edge: int = 60) -> Column:
    return F.when(minute < edge, "open").when(minute >= length - edge, "close").otherwise("midday")


