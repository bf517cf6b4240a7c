"""When an edition is delivered: zoned clock times, the next slot, and whether a late build still counts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def zone_offset(at: Column, zone: str) -> Column:
    """Seconds that the zone's clocks are ahead of UTC at an instant (the session's zone is UTC)."""
    return F.unix_timestamp(F.from_utc_timestamp(at, zone)) - F.unix_timestamp(at)


def local_date(at: Column, zone: str) -> Column:
    return F.to_date(F.from_utc_timestamp(at, zone))


def zoned_instant(day: Column, hour: int, minute: int, zone: str) -> Column:
    """The instant of a clock time of the zone on a day, across changes of its offset."""
    clock = F.to_timestamp(F.concat(F.date_format(day, "yyyy-MM-dd"), F.lit(f" {hour:02d}:{minute:02d}:00")), "yyyy-MM-dd HH:mm:ss")
    return F.to_utc_timestamp(clock, zone)


def next_slot(now: Column, hour: int, minute: int, zone: str, lead_seconds: int = 10) -> Column:
    today = zoned_instant(local_date(now, zone), hour, minute, zone)
    ahead = lambda s: F.timestamp_micros(F.unix_micros(now) + int(s * 1e6))
    return F.when(today < ahead(lead_seconds), zoned_instant(local_date(ahead(86400), zone), hour, minute, zone)).otherwise(today)


def slot_passed(now: Column, hour: int, minute: int, zone: str) -> Column:
    return now > zoned_instant(local_date(now, zone), hour, minute, zone)


def delivery_plan(now: Column, hour: int, minute: int, zone: str, grace_minutes: int = 180) -> Column:
    """struct(action, deliver_at, late_minutes, slot): schedule before the slot, now (in a minute) if it passed within
    the grace, else skip. In the ten seconds before a slot the action is schedule, for the slot of the next day."""
    slot = zoned_instant(local_date(now, zone), hour, minute, zone)
    late = F.floor((F.unix_micros(now) - F.unix_micros(slot)) / 6e7 + F.lit(0.5)).cast("long")
    passed = now > slot
    action = F.when(~passed, "schedule").when(late <= grace_minutes, "now").otherwise("skip")
    soon = F.timestamp_micros(F.unix_micros(now) + 60_000_000)
    at = F.when(action == "schedule", next_slot(now, hour, minute, zone)).when(action == "now", soon)
    return F.struct(action.alias("action"), at.alias("deliver_at"), F.when(passed, late).otherwise(0).alias("late_minutes"), slot.alias("slot"))
