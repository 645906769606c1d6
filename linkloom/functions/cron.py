"""Seven-field cron expressions (second minute hour day month weekday [year]) and their firing times as DataFrame work."""

from __future__ import annotations

import calendar
from collections.abc import Iterator
from dataclasses import dataclass, field
from datetime import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MONTHS = {m: i for i, m in enumerate("JAN FEB MAR APR MAY JUN JUL AUG SEP OCT NOV DEC".split(), 1)}
WEEKDAYS = {d: i for i, d in enumerate("SUN MON TUE WED THU FRI SAT".split(), 1)}  # Sunday is 1


class CronError(ValueError):
    """An expression that can't be read."""


def _number(text: str, names: dict[str, int], low: int, high: int) -> int:
    value = names.get(text.upper())
    if value is None:
        if not text.isdigit():
            raise CronError(f"not a number: {text!r}")
        value = int(text)
    if not low <= value <= high:
        raise CronError(f"{value} isn't in {low}..{high}")
    return value


def _values(text: str, low: int, high: int, names: dict[str, int] | None = None) -> list[int]:
    """The values that a field without L and W allows."""
    names, out = names or {}, set()
    for item in text.split(","):
        span, slash, step = item.partition("/")
        if span in ("*", "?"):
            first, last = low, high
        elif "-" in span:
            a, _, b = span.partition("-")
            first, last = _number(a, names, low, high), _number(b, names, low, high)
        else:
            first = _number(span, names, low, high)
            last = high if slash else first
        by = int(step) if slash and step.isdigit() and int(step) else 1 if not slash else None
        if by is None:
            raise CronError(f"bad step in {item!r}")
        if first <= last:
            out.update(range(first, last + 1, by))
        else:  # wraps round, as FRI-MON
            out.update((v - low) % (high - low + 1) + low for v in range(first, last + high - low + 2, by))
    return sorted(out)


@dataclass
class Cron:
    """The parsed fields. ``last_day``: L in the day field (with ``last_offset`` days before), ``near_weekday``: days with W, -1 for LW."""

    seconds: list[int]
    minutes: list[int]
    hours: list[int]
    days: list[int] | None
    months: list[int]
    weekdays: list[int] | None
    years: list[int] | None
    last_offset: list[int] = field(default_factory=list)
    near_weekday: list[int] = field(default_factory=list)
    last_weekdays: list[int] = field(default_factory=list)

    def on(self, year: int, month: int, day: int) -> bool:
        """Whether the expression fires on a date."""
        if month not in self.months or (self.years is not None and year not in self.years):
            return False
        size = calendar.monthrange(year, month)[1]
        weekday = calendar.weekday(year, month, day)  # Monday 0
        ours = (weekday + 1) % 7 + 1
        by_day = self.days is None and not self.last_offset and not self.near_weekday
        if self.days is not None and day in self.days:
            by_day = True
        by_day |= any(day == size - o for o in self.last_offset)
        for target in self.near_weekday:
            by_day |= day == self._nearest(year, month, size if target < 0 else min(target, size))
        by_week = self.weekdays is None and not self.last_weekdays
        if self.weekdays is not None and ours in self.weekdays:
            by_week = True
        by_week |= any(ours == w and day + 7 > size for w in self.last_weekdays)
        return by_day and by_week

    @staticmethod
    def _nearest(year: int, month: int, day: int) -> int:
        size, weekday = calendar.monthrange(year, month)[1], calendar.weekday(year, month, day)
        if weekday == 5:
            return day - 1 if day > 1 else day + 2
        if weekday == 6:
            return day + 1 if day < size else day - 2
        return day


def parse_cron(text: str) -> Cron:
    """Read an expression; ``?`` and ``*`` leave a field open, weekdays count from Sunday = 1, names are accepted."""
    parts = text.split()
    if len(parts) not in (6, 7):
        raise CronError(f"six or seven fields are needed: {text!r}")
    cron = Cron(_values(parts[0], 0, 59), _values(parts[1], 0, 59), _values(parts[2], 0, 23), None, _values(parts[4], 1, 12, MONTHS), None, _values(parts[6], 1970, 2199) if len(parts) == 7 and parts[6] not in ("*", "?") else None)
    plain = []
    for item in parts[3].upper().split(","):
        if item == "LW":
            cron.near_weekday.append(-1)
        elif item == "L" or item.startswith("L-"):
            cron.last_offset.append(_number(item[2:] or "0", {}, 0, 30))
        elif item.endswith("W"):
            cron.near_weekday.append(_number(item[:-1], {}, 1, 31))
        elif item not in ("*", "?"):
            plain.append(item)
    cron.days = _values(",".join(plain), 1, 31) if plain else None
    plain = []
    for item in parts[5].upper().split(","):
        if item == "L":
            plain.append("7")
        elif item.endswith("L") and len(item) > 1:
            cron.last_weekdays.append(_number(item[:-1], WEEKDAYS, 1, 7))
        elif item not in ("*", "?"):
            plain.append(item)
    cron.weekdays = _values(",".join(plain), 1, 7, WEEKDAYS) if plain else None
    return cron


def is_cron(text: str | None) -> bool:
    try:
        parse_cron(text or "")
    except CronError:
        return False
    return True


def cron_days(expressions: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """(cron, days, hours, minutes, seconds, error) of each distinct expression: the days of the span on which it fires, counted from ``start``, and its fields; error where it can't be read.

    Expressions are read in the tasks, each once."""
    distinct = expressions.select(F.col(column).alias("cron")).where(F.col(column).isNotNull()).distinct()
    span, first = (end.date() - start.date()).days + 1, start.toordinal()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for text in pdf["cron"]:
                try:
                    cron = parse_cron(text)
                    days = [d for d in range(span) if cron.on(*datetime.fromordinal(first + d).timetuple()[:3])]
                    rows.append((text, days, cron.hours, cron.minutes, cron.seconds, None))
                except CronError as error:
                    rows.append((text, None, None, None, None, str(error)))
            yield pd.DataFrame(rows, columns=["cron", "days", "hours", "minutes", "seconds", "error"])

    return distinct.mapInPandas(run, "cron string, days array<int>, hours array<int>, minutes array<int>, seconds array<int>, error string")


def cron_rejects(expressions: DataFrame, column: str) -> DataFrame:
    """(cron, error) of the distinct expressions that can't be read."""
    day = datetime(2000, 1, 1)
    return cron_days(expressions, column, day, day).where("error is not null").select("cron", "error")


def firings(expressions: DataFrame, column: str, start: datetime, end: datetime) -> DataFrame:
    """(cron, fires_at) for each distinct expression in ``column``: all its times in [start, end). Expressions that can't be read give none, see :func:`cron_rejects`."""
    made = cron_days(expressions, column, start, end).where("error is null")
    for part in ("days", "hours", "minutes", "seconds"):
        made = made.withColumn(part, F.explode(part))
    midnight = F.lit(datetime(start.year, start.month, start.day))
    at = midnight + F.make_dt_interval(F.col("days"), F.col("hours"), F.col("minutes"), F.col("seconds").cast("decimal(18,6)"))
    return made.select("cron", at.alias("fires_at")).where((F.col("fires_at") >= F.lit(start)) & (F.col("fires_at") < F.lit(end)))
