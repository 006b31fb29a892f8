"""Date and time expressions; the day they are asked on is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LAUNCH_DAYS = 60
ZONE = "Asia/Tokyo"
#: Date formats that are tried in turn.
FORMATS = ["yyyy-MM-dd'T'HH:mm:ssXX", "yyyy-MM-dd HH:mm:ssXX", "yyyy-MM-dd'T'HH:mm:ss", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "MMMM d, yyyy", "MMM d, yyyy", "MMMM d yyyy", "d MMM yyyy", "d MMMM yyyy", "d MMM, yyyy", "d MMMM, yyyy", "MMM d yyyy"]
STORE_FORMATS = ["MMM d, yyyy", "d MMM, yyyy", "yyyy"]


def local_day(ts: Column, zone: str = ZONE) -> Column:
    return F.to_date(F.from_utc_timestamp(ts, zone))


def next_local_midnight(as_of: Column, zone: str = ZONE) -> Column:
    """The UTC time at which the local day after ``as_of`` begins: rows from then on are hidden."""
    return F.to_utc_timestamp(F.date_add(local_day(as_of, zone), 1).cast("timestamp"), zone)


def review_timing(published: Column, released: Column, mode: str = "date") -> Column:
    """early, launch_window (0 to 60 days) or late; null if either is unknown.

    ``mode``: date compares dates; timestamp counts anything after midnight of
    day 60 as late; tokyo takes the local date.
    """
    day = local_day(published) if mode == "tokyo" else F.to_date(published)
    late = (published > F.date_add(released, LAUNCH_DAYS).cast("timestamp")) if mode == "timestamp" else (F.datediff(day, released) > LAUNCH_DAYS)
    return F.when(published.isNull() | released.isNull(), None).when(day < released, "early").when(late, "late").otherwise("launch_window")


def dates_match(a: Column, b: Column, tolerance: int = 90) -> Column:
    """Whether two dates are at most ``tolerance`` days apart; unknown ones match."""
    return F.coalesce(F.abs(F.datediff(a, b)) <= tolerance, F.lit(True))


def parse_moment(text: Column, fetched_at: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds, "10 days ago" or one of FORMATS; null if none fits.

    Digits below 1,000,000,000 are no time; a month counts 30 days, a year 365.
    """
    trimmed = F.trim(text)
    digits = trimmed.try_cast("bigint")
    seconds = F.when(digits > 10_000_000_000, F.floor(digits / 1000)).otherwise(digits)
    epoch = F.when(digits >= 1_000_000_000, F.timestamp_seconds(seconds))
    pattern = r"(\d+)\s+(minute|hour|day|week|month|year)s?\s+ago"
    unit = F.regexp_extract(F.lower(trimmed), pattern, 2)
    each = F.create_map(*[F.lit(x) for kv in {"minute": 60, "hour": 3600, "day": 86400, "week": 604800, "month": 2592000, "year": 31536000}.items() for x in kv])
    ago = F.regexp_extract(F.lower(trimmed), pattern, 1).try_cast("long") * F.try_element_at(each, unit)
    relative = F.timestamp_seconds(F.unix_timestamp(fetched_at) - ago)
    plain = F.regexp_replace(F.regexp_replace(trimmed, " ?UTC$", "+0000"), "Z$", "+0000")
    parsed = F.coalesce(*[F.try_to_timestamp(plain, F.lit(f)) for f in FORMATS])
    return F.when(trimmed.rlike(r"^\d+$"), epoch).when(unit != "", relative).otherwise(parsed)


def store_date(text: Column) -> Column:
    return F.coalesce(*[F.to_date(F.try_to_timestamp(F.trim(text), F.lit(f))) for f in STORE_FORMATS])


def guarded_release(old: Column, new: Column, today: Column) -> Column:
    """Upstream's rule: a released item never becomes unreleased, and a date never moves to an earlier day."""
    return F.when(new.isNull(), old).when(old.isNull(), new).when((old <= today) & (new > today), old).when(new < old, old).otherwise(new)


def scraped_release(old: Column, new: Column, least_days: int = 120) -> Column:
    """A scraped date replaces a known one only if it is at least ``least_days`` later."""
    return F.when(new.isNull(), old).when(old.isNull(), new).when(F.datediff(new, old) >= least_days, new).otherwise(old)


def quarter_key(day: Column) -> Column:
    return F.concat(F.year(day).cast("string"), F.lit("-Q"), F.quarter(day).cast("string"))


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_moment(text: Column) -> Column:
    """An ISO 8601 time; one without a zone is UTC, anything else null."""
    return F.try_to_timestamp(F.regexp_replace(F.trim(text), "Z$", "+00:00"))
