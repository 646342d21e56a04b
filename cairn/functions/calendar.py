"""Windows of time: dates, seasons that wrap the year, hours that wrap midnight, weekdays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]


def _wraps(value: Column, first: Column, last: Column) -> Column:
    """Inclusive at both ends; a window whose first comes after its last wraps around."""
    return F.when(first <= last, value.between(first, last)).otherwise((value >= first) | (value <= last))


def minute(time: Column) -> Column:
    """Minutes of a day from HH:MM; null where that is no time."""
    return F.when(time.rlike("^([01]?[0-9]|2[0-3]):[0-5][0-9]$"), F.split_part(time, F.lit(":"), F.lit(1)).cast("int") * 60 + F.split_part(time, F.lit(":"), F.lit(2)).cast("int"))


def in_hours(time: Column, first: Column, last: Column) -> Column:
    return _wraps(minute(time), minute(first), minute(last))


def month_day(date: Column) -> Column:
    return F.month(date) * 100 + F.day(date)


def in_season(date: Column, first: Column, last: Column) -> Column:
    """first and last are month * 100 + day."""
    return _wraps(month_day(date), first, last)


def weekday_bits(text: Column) -> Column:
    """A set of weekdays (bit 0 is Monday) from names, ranges that may wrap, and the words
    weekdays, weekends, daily; null where a token is none of these."""
    tokens = F.filter(F.split(F.lower(F.trim(text)), r"[,;|/\s]+"), lambda t: ~t.isin("", "none"))
    index = lambda t: F.array_position(F.array(*[F.lit(d) for d in DAYS]), F.substring(t, 1, 3)).cast("int") - 1

    def bits(t: Column) -> Column:
        a, b = index(F.split_part(t, F.lit("-"), F.lit(1))), index(F.split_part(t, F.lit("-"), F.lit(2)))
        some = F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(_wraps(d, a, b), F.pow(F.lit(2), d).cast("int")).otherwise(0))
        run = F.aggregate(some, F.lit(0), lambda s, x: s + x)
        one = F.when(index(t) >= 0, F.aggregate(F.transform(F.sequence(F.lit(0), F.lit(6)), lambda d: F.when(d == index(t), F.pow(F.lit(2), d).cast("int")).otherwise(0)), F.lit(0), lambda s, x: s + x))
        span = F.when((a >= 0) & (b >= 0), run)
        return F.when(t.isin("all", "daily", "everyday"), 127).when(t.isin("weekday", "weekdays"), 31).when(t.isin("weekend", "weekends"), 96).when(t.contains("-"), span).otherwise(one)

    return F.aggregate(tokens, F.lit(0), lambda s, t: s.bitwiseOR(bits(t)))


def has_weekday(bits: Column, date: Column) -> Column:
    """An empty set holds every day."""
    return (bits == 0) | (F.floor(bits / F.pow(F.lit(2), F.weekday(date))) % 2 == 1)


def active(date: Column, time: Column, window: Column) -> Column:
    """Whether a window holds a moment.  Parts of either that are null don't count."""
    yes = F.lit(True)
    when = lambda known, test: F.when(known, F.coalesce(test, yes)).otherwise(yes)
    w = window
    dates = when(w["from"].isNotNull(), w["from"] <= date) & when(w["to"].isNotNull(), date <= w["to"])
    season = when(w["season_from"].isNotNull() & w["season_to"].isNotNull(), in_season(date, w["season_from"], w["season_to"]))
    days = when(w["weekdays"].isNotNull(), has_weekday(w["weekdays"], date))
    hours = when(w["time_from"].isNotNull() & w["time_to"].isNotNull(), in_hours(time, w["time_from"], w["time_to"]))
    return F.when(date.isNull(), yes).otherwise(dates & season & days) & F.when(time.isNull(), yes).otherwise(hours)
