"""Cron expressions and daily windows. A cron field is ``*``, values, ranges and steps; only a bare ``*`` is a wildcard."""

from __future__ import annotations

import re
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The fields with their lowest and highest value.
FIELDS = [("minute", 0, 59), ("hour", 0, 23), ("day", 1, 31), ("month", 1, 12), ("weekday", 0, 6)]


@dataclass(frozen=True)
class Field:
    values: tuple[int, ...]
    wildcard: bool


def parse(expression: str) -> dict[str, Field]:
    parts = expression.split()
    if len(parts) != len(FIELDS):
        raise ValueError("a cron expression has five fields")
    out = {}
    for (name, low, high), text in zip(FIELDS, parts, strict=True):
        values: set[int] = set()
        for item in text.split(","):
            m = re.fullmatch(r"(\*|\d+(?:-\d+)?)(?:/(\d+))?", item)
            if not m:
                raise ValueError(f"bad {name}: {item!r}")
            first, step = m[1], int(m[2] or 1)
            start, end = (low, high) if first == "*" else map(int, (first.split("-") * 2)[:2])
            if m[2] and "-" not in first:  # a single value with a step runs to the field's highest
                end = high
            if step < 1 or not low <= start <= end <= high:
                raise ValueError(f"{name} out of range: {item!r}")
            values.update(range(start, end + 1, step))
        out[name] = Field(tuple(sorted(values)), text == "*")
    return out


def matches_date(date: Column, cron: dict[str, Field]) -> Column:
    """Whether a date fits; with day and weekday both restricted, either may match."""
    day = F.dayofmonth(date).isin(*cron["day"].values)
    weekday = (F.dayofweek(date) - 1).isin(*cron["weekday"].values)
    if cron["day"].wildcard:
        fits = weekday
    elif cron["weekday"].wildcard:
        fits = day
    else:
        fits = day | weekday
    return F.month(date).isin(*cron["month"].values) & fits


#: Days that are searched for an occurrence, and days that a change of clocks may skip or the current day may lack.
HORIZON_DAYS = 366 * 8
SPARE_DAYS = 4


def occurrences(rows: DataFrame, expression: str, zone: str, count: int = 1) -> DataFrame:
    """``rows`` (with ``after_utc``) with ``times``, the next ``count`` times in UTC.

    Local times that a change of clocks skips do not occur; repeated ones occur once. Matching dates are looked up
    once for each distinct local date. A rule without so many occurrences within HORIZON_DAYS fails the job.
    """
    ZoneInfo(zone)
    cron = parse(expression)
    placed = rows.withColumn("__start", F.to_date(F.from_utc_timestamp("after_utc", zone)))
    days = placed.select("__start").distinct()
    matching = F.filter(F.sequence("__start", F.date_add("__start", HORIZON_DAYS)), lambda d: matches_date(d, cron))
    days = days.withColumn("__dates", F.slice(matching, 1, count + SPARE_DAYS))
    minutes = F.array(*(F.lit(h * 60 + m) for h in cron["hour"].values for m in cron["minute"].values))

    def utc(date: Column, minute: Column) -> Column:
        local = F.timestamp_seconds(F.unix_date(date) * 86400 + minute * 60)
        at = F.to_utc_timestamp(local, zone)
        return F.when(F.from_utc_timestamp(at, zone) == local, at)

    every = F.flatten(F.transform("__dates", lambda d: F.transform(minutes, lambda m: utc(d, m))))
    days = days.withColumn("__times", F.array_sort(F.array_compact(every)))
    later = F.slice(F.filter("__times", lambda t: t > F.col("after_utc")), 1, count)
    found = placed.join(days, placed["__start"].eqNullSafe(days["__start"]), "left").withColumn("times", later).drop("__start", "__dates", "__times")
    missing = F.col("after_utc").isNotNull() & (F.size("times") < count)
    return found.withColumn("times", F.when(missing, F.raise_error(F.lit(f"no such occurrence of {expression}"))).otherwise(F.col("times")))


def next_occurrences(rows: DataFrame, expression: str, zone: str) -> DataFrame:
    """``rows`` (with ``after_utc``) with ``next_utc``."""
    return occurrences(rows, expression, zone).withColumn("next_utc", F.get("times", F.lit(0))).drop("times")


def inside_window(at_utc: Column, zone: str, start: str, end: str) -> Column:
    """Whether a local time of day lies in a daily window, which may cross midnight."""
    clock = F.date_format(F.from_utc_timestamp(at_utc, zone), "HH:mm")
    if start < end:
        return (clock >= start) & (clock < end)
    return (clock >= start) | (clock < end)


def thread_cap(policy: Column, *ceilings: Column) -> Column:
    """The smallest of a policy's cap and all ceilings that are set."""
    return F.least(policy, *ceilings) if ceilings else policy
