"""Scalar column expressions: coercion, ranks, time windows and spherical distance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Stand-ins for a missing rank, by consumer.
TABLE_RANK_SENTINEL = 1501.0
SAFE_RANK_SENTINEL = 9999.0
# Fixed value: mean Earth radius in kilometres.
EARTH_RADIUS_KM = 6371.0088

MICROS_PER_HOUR = 3_600_000_000


def col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def number(value: Column | str) -> Column:
    """Lenient double: unparsable text and NaN both become NULL."""
    return F.nullif(col(value).try_cast("double"), F.lit(float("nan")))


def flag(value: Column | str) -> Column:
    """Strict boolean: NULL and unparsable text are false, never true."""
    return F.coalesce(col(value).try_cast("boolean"), F.lit(False))


def reciprocal_rank(value: Column | str, missing: float = TABLE_RANK_SENTINEL) -> Column:
    """``1 / (rank + 1)``; missing ranks take the sentinel, negative ones count as zero."""
    return F.lit(1.0) / (F.greatest(F.coalesce(number(value), F.lit(missing)), F.lit(0.0)) + 1.0)


def safe_reciprocal(value: Column | str, missing: float = SAFE_RANK_SENTINEL) -> Column:
    """``1 / (1 + rank)`` without the clip at zero; a rank of -1 yields infinity."""
    shifted = F.lit(1.0) + F.coalesce(number(value), F.lit(missing))
    return F.when(shifted == 0.0, F.lit(float("inf"))).otherwise(F.lit(1.0) / shifted)


def micros(value: Column | str) -> Column:
    return F.unix_micros(col(value).cast("timestamp"))


def hours_between(start: Column | str, end: Column | str) -> Column:
    return (micros(end) - micros(start)) / F.lit(float(MICROS_PER_HOUR))


def plus_hours(start: Column | str, hours: Column) -> Column:
    return F.timestamp_micros(micros(start) + F.round(hours * F.lit(float(MICROS_PER_HOUR))).cast("long"))


def parse_time(value: Column | str) -> Column:
    """ISO-8601 text (also with a trailing ``Z``) or any timestamp; unparsable becomes NULL."""
    return F.trim(col(value).cast("string")).try_cast("timestamp")


# Alternative field names for window bounds, in order of preference.
START_FIELDS = ("time_coverage_start", "event_start_time", "start_time", "start_date")
END_FIELDS = ("time_coverage_end", "event_end_time", "end_time", "end_date")
DEFAULT_DURATION_HOURS = 24.0


def window_bounds(columns: Sequence[str]) -> tuple[Column, Column]:
    """Start and end of an event window from whichever of the known fields exist."""
    starts = [parse_time(F.nullif(F.col(c).cast("string"), F.lit(""))) for c in START_FIELDS if c in columns]
    ends = [parse_time(F.nullif(F.col(c).cast("string"), F.lit(""))) for c in END_FIELDS if c in columns]
    if not starts:
        raise ValueError("an event window needs one of the start fields: " + ", ".join(START_FIELDS))
    start = F.coalesce(*starts)
    hours = F.lit(DEFAULT_DURATION_HOURS)
    if "event_duration_hours" in columns:
        hours = F.coalesce(number("event_duration_hours"), hours)
    return start, F.coalesce(*ends, plus_hours(start, hours))


def intersection_hours(a_start, a_end, b_start, b_end) -> Column:
    return F.greatest(
        F.lit(0.0),
        (F.least(micros(a_end), micros(b_end)) - F.greatest(micros(a_start), micros(b_start)))
        / F.lit(float(MICROS_PER_HOUR)),
    )


def temporal_overlap(a_start, a_end, b_start, b_end) -> Column:
    """Struct of shared hours, share of the shorter window and share of the union."""
    shared = intersection_hours(a_start, a_end, b_start, b_end)
    a_hours, b_hours = hours_between(a_start, a_end), hours_between(b_start, b_end)
    return F.struct(
        shared.alias("intersection_hours"),
        (shared / F.least(a_hours, b_hours)).alias("overlap_ratio_min"),
        (shared / F.greatest(a_hours + b_hours - shared, F.lit(1e-12))).alias("overlap_ratio_union"),
    )


def haversine_km(lat1, lon1, lat2, lon2) -> Column:
    """Great-circle distance; NULL when any coordinate is missing or not finite."""
    phi1, lam1, phi2, lam2 = (F.radians(number(v)) for v in (lat1, lon1, lat2, lon2))
    half = F.pow(F.sin((phi2 - phi1) / 2.0), 2) + F.cos(phi1) * F.cos(phi2) * F.pow(
        F.sin((lam2 - lam1) / 2.0), 2
    )
    km = 2.0 * EARTH_RADIUS_KM * F.atan2(F.sqrt(half), F.sqrt(F.greatest(F.lit(0.0), F.lit(1.0) - half)))
    return F.nullif(km, F.lit(float("nan")))


def identity(columns: Sequence[str], event_key: str = "event_id") -> Column:
    """Physical-event identity: the event key, else the group, else the candidate itself."""
    present = [c for c in (event_key, "group_id", "candidate_id") if c in columns]
    if not present:
        raise ValueError("an event identity needs event, group or candidate ids")
    return F.coalesce(*[F.col(c).cast("string") for c in present])
