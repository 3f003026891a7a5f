"""Row filters: include and exclude patterns, recurrence rules, tags, freshness, availability, coalescing."""

from __future__ import annotations

import calendar
import datetime as dt
import functools
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from feedweave.config import SourceFilter
from feedweave.functions.scalars import AUDIO

_DAYS = {"MO": 2, "TU": 3, "WE": 4, "TH": 5, "FR": 6, "SA": 7, "SU": 1}
_FREQ = ("YEARLY", "MONTHLY", "WEEKLY", "DAILY")
_PARTS = {"FREQ", "INTERVAL", "BYDAY", "BYMONTHDAY", "BYMONTH", "UNTIL", "COUNT", "WKST"}


def title_pattern(f: SourceFilter) -> str | None:
    """One pattern for all of a source's include and exclude patterns; none if it has none.

    An exclude pattern that begins with ^ holds at the start only.  A title with a line feed inside never matches.
    """
    if not (f.include or f.exclude):
        return None
    out = "(?di)^"
    for p in f.exclude:
        out += f"(?!{p[1:]})" if p.startswith("^") else f"(?!.*{p})"
    if f.include:
        out += f"(?=.*(?:{'|'.join(f.include)}))"
    return out + ".*$"


def title_filter(df: DataFrame, f: SourceFilter, title: str = "title") -> DataFrame:
    pattern = title_pattern(f)
    return df if pattern is None else df.where(F.col(title).rlike(pattern))


@dataclass(frozen=True)
class Rule:
    """A recurrence rule whose parts column expressions can express: frequency, interval, days of the week (without a number),
    of the month, months, start, end.  Others are left to the calendar library, see on_schedule()."""

    freq: str
    interval: int = 1
    byday: tuple[str, ...] = ()
    bymonthday: tuple[int, ...] = ()
    bymonth: tuple[int, ...] = ()
    start: dt.date | None = None
    until: dt.date | None = None
    count: int | None = None

    @classmethod
    def parse(cls, text: str) -> Rule | None:
        """None for a malformed rule, and for one with other parts."""
        try:
            fields: dict[str, str] = {}
            start = None
            for line in text.replace("RRULE:", "").replace("\n", ";").split(";"):
                if line.upper().startswith("DTSTART"):
                    start = dt.datetime.strptime(line.split(":")[-1].split("=")[-1][:8], "%Y%m%d").date()
                elif line.strip():
                    k, v = line.split("=")
                    fields[k.strip().upper()] = v.strip().upper()
            if fields["FREQ"] not in _FREQ or set(fields) - _PARTS or any(c.isdigit() for c in fields.get("BYDAY", "")):
                return None
            if fields.get("WKST", "MO") != "MO":
                return None
            byday = tuple(d.strip()[-2:] for d in fields.get("BYDAY", "").split(",") if d)
            if any(d not in _DAYS for d in byday):
                return None
            ints = lambda k: tuple(int(x) for x in fields.get(k, "").split(",") if x)
            until = fields.get("UNTIL")
            interval = int(fields.get("INTERVAL", 1))
            if interval < 1:
                return None
            return cls(fields["FREQ"], interval, byday, ints("BYMONTHDAY"), ints("BYMONTH"), start, dt.datetime.strptime(until[:8], "%Y%m%d").date() if until else None, int(fields["COUNT"]) if "COUNT" in fields else None)
        except (KeyError, ValueError):
            return None

    def holds(self, day: Column) -> Column:
        """The rule has an occurrence on the day.

        Without a start, the rule starts on the day itself, so an interval or a missing BYDAY never excludes it.
        """
        day = day.cast("date")
        ok = F.lit(True)
        if self.byday:
            ok = ok & F.dayofweek(day).isin([_DAYS[d] for d in self.byday])
        if self.bymonthday:
            last = F.dayofmonth(F.last_day(day))
            ok = ok & F.greatest(*[(F.dayofmonth(day) == (n if n > 0 else last + 1 + n)).cast("int") for n in (*self.bymonthday, self.bymonthday[0])]).cast("boolean")
        if self.bymonth:
            ok = ok & F.month(day).isin(list(self.bymonth))
        if self.until:
            ok = ok & (day <= F.lit(self.until))
        if self.start is None:
            return F.coalesce(ok, F.lit(False))
        first = F.lit(self.start)
        ok = ok & (day >= first)
        if self.freq == "DAILY":
            ok = ok & (F.datediff(day, first) % self.interval == 0)
        elif self.freq == "WEEKLY":
            week = lambda x: F.date_trunc("week", x).cast("date")
            ok = ok & ((F.datediff(week(day), week(first)) / 7).cast("int") % self.interval == 0)
            if not self.byday:
                ok = ok & (F.dayofweek(day) == F.dayofweek(first))
        elif self.freq == "MONTHLY":
            ok = ok & (((F.year(day) - self.start.year) * 12 + F.month(day) - self.start.month) % self.interval == 0)
            if not (self.byday or self.bymonthday):
                ok = ok & (F.dayofmonth(day) == self.start.day)
        else:
            ok = ok & ((F.year(day) - self.start.year) % self.interval == 0)
            if not (self.byday or self.bymonthday):
                ok = ok & (F.month(day).isin(list(self.bymonth) or [self.start.month])) & (F.dayofmonth(day) == self.start.day)
        if self.count is not None:
            ok = ok & day.isin(self._first(self.count))
        return F.coalesce(ok, F.lit(False))

    def _first(self, n: int) -> list[dt.date]:
        """The first n occurrences of a rule with a start."""
        out, day = [], self.start
        while len(out) < n and day.year < self.start.year + 400:
            if self._on(day):
                out.append(day)
            day += dt.timedelta(days=1)
        return out

    def _on(self, day: dt.date) -> bool:
        days = {d: (n + 5) % 7 for d, n in _DAYS.items()}
        if self.byday and day.weekday() not in [days[d] for d in self.byday]:
            return False
        last = calendar.monthrange(day.year, day.month)[1]
        if self.bymonthday and day.day not in [n if n > 0 else last + 1 + n for n in self.bymonthday]:
            return False
        if self.bymonth and day.month not in self.bymonth or self.until and day > self.until:
            return False
        if self.freq == "DAILY":
            return (day - self.start).days % self.interval == 0
        if self.freq == "WEEKLY":
            monday = lambda d: d - dt.timedelta(days=d.weekday())
            return (monday(day) - monday(self.start)).days // 7 % self.interval == 0 and (bool(self.byday) or day.weekday() == self.start.weekday())
        if self.freq == "MONTHLY":
            return ((day.year - self.start.year) * 12 + day.month - self.start.month) % self.interval == 0 and (bool(self.byday or self.bymonthday) or day.day == self.start.day)
        return (day.year - self.start.year) % self.interval == 0 and (bool(self.byday or self.bymonthday) or (day.month in (self.bymonth or (self.start.month,)) and day.day == self.start.day))


@functools.lru_cache(1024)
def _started(text: str):
    """The rule of a text with DTSTART; it remembers its occurrences."""
    from dateutil.rrule import rrulestr

    return rrulestr(text, cache=True)


@functools.lru_cache(1 << 16)
def occurs(text: str, day: dt.date) -> bool:
    """The rule has an occurrence on the day; without DTSTART it starts on that day.  A malformed rule has none."""
    from dateutil.rrule import rrulestr

    start = dt.datetime.combine(day, dt.time())
    try:
        rule = _started(text) if "DTSTART" in text.upper() else rrulestr(text, dtstart=start)
        first = getattr(rule, "_dtstart", None)
        if first is not None and first.tzinfo is not None:
            start = start.replace(tzinfo=first.tzinfo)
        found = rule.after(start - dt.timedelta(microseconds=1), inc=True)
        return found is not None and found < (start + dt.timedelta(days=1)).replace(tzinfo=found.tzinfo)
    except (TypeError, ValueError):
        return False


def on_schedule(day: Column, rules: list[str]) -> Column:
    """Any of the rules has an occurrence on the day; a malformed rule has none.

    Rules of plain parts are column expressions.  Numbered weekdays, positions, days and weeks of the year, other starts of the
    week, hours and smaller units go to the calendar library, day by day (each day once in a worker).
    """
    out, rest = F.lit(False), []
    for text in rules:
        rule = Rule.parse(text)
        if rule is None:
            rest.append(text)
        else:
            out = out | rule.holds(day)
    if rest:

        @F.pandas_udf("boolean")
        def hit(days: pd.Series) -> pd.Series:
            return days.map(lambda d: d is not None and any(occurs(text, d) for text in rest)).astype(bool)

        out = out | hit(day.cast("date"))
    return out


def date_filter(df: DataFrame, rules: list[str], date: str = "pub_date") -> DataFrame:
    """Rows published on a day of any rule; without rules all rows, with rules none without a date."""
    return df.where(F.col(date).isNotNull() & on_schedule(F.col(date), rules)) if rules else df


def due(shows: DataFrame, today: dt.date, schedule: str = "schedule") -> DataFrame:
    """Shows without a schedule (an array of rules), and those with an occurrence today."""
    rules = [r[0] for r in shows.select(F.explode(schedule)).distinct().collect()]  # the rules of the configuration
    hits = F.array(*[F.lit(r) for r in rules if occurs(r, today)]).cast("array<string>")
    return shows.where((F.size(F.coalesce(F.col(schedule), F.array().cast("array<string>"))) == 0) | F.arrays_overlap(schedule, hits))


def has_tag(name: Column, slug: Column, tags: Column, wanted: list[str]) -> Column:
    """A name, slug or tag equals one of the wanted, whatever its case; blank ones are ignored, and none means all."""
    low = [w.strip().lower() for w in wanted if w.strip()]
    if not low:
        return F.lit(True)
    return F.lower(name).isin(low) | F.lower(slug).isin(low) | F.arrays_overlap(F.transform(tags, lambda t: F.lower(F.trim(t))), F.array(*[F.lit(x) for x in low]))


def fresh(fetched: Column, now: Column, hours: float, refresh: bool = False) -> Column:
    """Fetched not longer ago than this; never when a refresh is asked for."""
    if refresh:
        return F.lit(False)
    return F.coalesce(F.unix_micros(now.cast("timestamp")) - F.unix_micros(fetched.cast("timestamp")) <= int(hours * 3_600_000_000), F.lit(False))


def public(availability: Column) -> Column:
    return availability.isNull() | (availability == "public")


def first_value(*columns: str) -> Column:
    """The first that is not null."""
    return F.coalesce(*columns)


def first_filled(*columns: str) -> Column:
    """The first that is neither null nor empty; empty if none is."""
    return F.coalesce(*[F.nullif(F.col(c), F.lit("")) for c in columns], F.lit(""))


def first_enclosure(urls: Column) -> Column:
    """The first URL with an audio extension; null if there is none."""
    return F.get(F.filter(urls, lambda u: u.rlike(r"\.(" + "|".join(AUDIO) + ")")), F.lit(0))


def quarantine(df: DataFrame, ok: Column, reason: str) -> tuple[DataFrame, DataFrame]:
    """(rows that are fine, the others with a reason)."""
    flag = F.coalesce(ok, F.lit(False))
    return df.where(flag), df.where(~flag).withColumn("reason", F.lit(reason))


def enrich(episodes: DataFrame, info: DataFrame) -> DataFrame:
    """Fills date and image from info (id, pub_date, image, description) where either is missing.

    Where it is, info's date and image win, and its description fills an empty one.
    """
    i = info.select("id", *[F.col(c).alias(f"__{c}") for c in ("pub_date", "image", "description")])
    need = F.col("pub_date").isNull() | F.col("image").isNull()
    return (
        episodes.join(i, "id", "left")
        .withColumn("__need", need)
        .withColumn("pub_date", F.when(F.col("__need"), F.coalesce("__pub_date", "pub_date")).otherwise(F.col("pub_date")))
        .withColumn("image", F.when(F.col("__need"), F.coalesce("__image", "image")).otherwise(F.col("image")))
        .withColumn("description", F.when(F.col("__need") & (F.coalesce("description", F.lit("")) == ""), F.coalesce("__description", "description")).otherwise(F.col("description")))
        .drop("__need", "__pub_date", "__image", "__description")
    )


__all__ = ["Rule", "date_filter", "due", "enrich", "first_enclosure", "first_filled", "first_value", "fresh", "has_tag", "occurs", "on_schedule", "public", "quarantine", "title_filter", "title_pattern"]
