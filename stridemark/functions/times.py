"""Column functions on dates and durations. Durations are whole seconds."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _group(text: Column, pattern: str, k: int) -> Column:
    return F.regexp_extract(text, pattern, k).try_cast("int")


def parse_duration(raw: Column) -> Column:
    """h:m:s, m:s or 3h24m17s in seconds; a trailing fraction is dropped. Null for statuses and what makes no sense."""
    s = F.regexp_replace(F.trim(F.coalesce(raw, F.lit(""))), r"[.,][0-9]+\s*$", "")
    letters, three, two = r"(?i)^([0-9]+)\s*h\s*([0-9]{1,2})\s*m\s*([0-9]{1,2})\s*s?$", r"^([0-9]{1,3})\s*:\s*([0-9]{1,3})\s*:\s*([0-9]{1,3})$", r"^([0-9]{1,3})\s*:\s*([0-9]{1,3})$"
    pick = lambda k: F.when(s.rlike(letters), _group(s, letters, k)).when(s.rlike(three), _group(s, three, k)).when(s.rlike(two), F.lit(0) if k == 1 else _group(s, two, k - 1))
    h, m, sec = pick(1), pick(2), pick(3)
    return F.when((sec <= 59) & (h + F.floor(m / 60) <= 99), (h * 3600 + m * 60 + sec).cast("bigint"))


def parse_date(raw: Column, order: str = "dmy", pivot: int = 26) -> Column:
    """ISO-like dates (a prefix is enough), yyyymmdd, and day-month-year in either order.

    Two-digit years over ``pivot`` are of the last century. Dates that don't exist, such as 31 February, are null.
    """
    s = F.trim(F.coalesce(raw, F.lit("")))
    iso, plain, short = r"^([0-9]{4})[-/.]([0-9]{1,2})[-/.]([0-9]{1,2})", r"^([0-9]{4})([0-9]{2})([0-9]{2})$", r"^([0-9]{1,2})[-/. ]([0-9]{1,2})[-/. ]([0-9]{2,4})\.?$"
    a, b, y = (_group(s, short, k) for k in (1, 2, 3))
    year = F.when(y < 100, y + F.when(y > pivot, 1900).otherwise(2000)).otherwise(y)
    day_first = (a <= 31) if order == "dmy" else (b > 12)
    date = lambda y, m, d: F.when((y > 0) & m.between(1, 12) & d.between(1, 31), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))
    return (
        F.when(s.rlike(iso), date(*(_group(s, iso, k) for k in (1, 2, 3))))
        .when(s.rlike(plain), date(*(_group(s, plain, k) for k in (1, 2, 3))))
        .when(s.rlike(short), F.when(day_first, date(year, b, a)).otherwise(date(year, a, b)))
    )


def clock(seconds: Column) -> Column:
    """h:mm:ss."""
    s = seconds.cast("bigint")
    return F.format_string("%d:%02d:%02d", F.floor(s / 3600), F.floor(s / 60) % 60, s % 60)


def to_seconds(text: Column) -> Column:
    """h:m:s or shorter in seconds; 0 for null or what is no time."""
    parts = F.split(F.coalesce(text, F.lit("")), ":")
    numbers = F.transform(parts, lambda x: F.coalesce(F.nullif(F.trim(x), F.lit("")), F.lit("0")).try_cast("double"))
    total = F.aggregate(numbers, F.lit(0.0), lambda acc, x: acc * 60 + x)
    return F.when(text.isNull() | (text == "") | F.exists(numbers, lambda x: x.isNull()) | (F.size(parts) > 3), F.lit(0.0)).otherwise(total)


def pace(seconds: Column, km: Column) -> Column:
    """Minutes and seconds a kilometre. Only minutes of the hour are shown, as in what this has to agree with."""
    p = F.round(seconds / km).cast("bigint")
    return F.when(seconds.isNotNull() & km.isNotNull() & (km != 0), F.format_string("%d:%02d", F.floor(p / 60) % 60, p % 60))


def clock_label(at: Column, zone: str, fallback_minutes: Column | int = 0, start_hour: int = 9) -> Column:
    """Wall clock in the event's time zone; minutes after the start hour where no time is known."""
    minutes = F.lit(fallback_minutes) if isinstance(fallback_minutes, int) else fallback_minutes
    return F.coalesce(F.date_format(F.from_utc_timestamp(at, zone), "HH:mm"), F.format_string("%02d:%02d", F.lit(start_hour) + F.floor(minutes / 60), minutes % 60))


def utc_of_wall(wall: Column, zone: str) -> Column:
    return F.to_utc_timestamp(wall, zone)


def before(now: Column, race_end: Column) -> Column:
    return now < race_end
