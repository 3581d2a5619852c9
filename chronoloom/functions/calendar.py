"""Calendar arithmetic over partial values, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def is_leap_year(y: Column) -> Column:
    return ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)


def month_length(y: Column, m: Column) -> Column:
    return F.day(F.last_day(F.make_date(y, m, F.lit(1))))


def day_of_year(d: Column) -> Column:
    return F.dayofyear(d)


def day_of_week(d: Column) -> Column:
    """Sunday is 0."""
    return F.dayofweek(d) - 1


def week_value(d: Column) -> Column:
    """`YYYYWnn`: ISO weeks, but for days that ISO gives to the next year's first week: those stay in this year as W53."""
    y, iso = F.year(d), F.extract(F.lit("YEAROFWEEK"), d)
    n = F.when(iso > y, 53).otherwise(F.weekofyear(d))
    return F.concat(F.least(y, iso).cast("string"), F.lit("W"), F.lpad(n.cast("string"), 2, "0"))


def week_thursday(y: Column, w: Column) -> Column:
    """The Thursday of a week: it lies in the year that the week counts to."""
    jan4 = F.make_date(y, F.lit(1), F.lit(4))
    return F.date_add(F.date_trunc("week", jan4).cast("date"), ((w - 1) * 7 + 3).cast("int"))


def nth_weekday(y: Column, m: Column, dow: Column, n: Column) -> Column:
    """The n-th weekday (Sunday 0) of a month; n = -1: the last one."""
    first = F.make_date(y, m, F.lit(1))
    ahead = F.pmod(dow - day_of_week(first), F.lit(7))
    end = F.last_day(first)
    back = F.pmod(day_of_week(end) - dow, F.lit(7))
    return F.when(n > 0, F.date_add(first, (ahead + (n - 1) * 7).cast("int"))).otherwise(F.date_sub(end, (back + (-n - 1) * 7).cast("int")))


def easter(y: Column) -> Column:
    """Easter Sunday, by the anonymous Gregorian rule."""
    div = lambda p, q: F.floor(p / q)
    a, b, c = y % 19, div(y, 100), y % 100
    d, e = div(b, 4), b % 4
    g = div(8 * b + 13, 25)
    h = (19 * a + b - d - g + 15) % 30
    i, k = div(c, 4), c % 4
    l = (32 + 2 * e + 2 * i - h - k) % 7  # noqa: E741
    m = div(a + 11 * h + 19 * l, 433)
    month = div(h + l - 7 * m + 90, 25)
    day = (h + l - 7 * m + 33 * month + 19) % 32
    return F.make_date(y.cast("int"), month.cast("int"), day.cast("int"))


def good_friday(y: Column) -> Column:
    return F.date_sub(easter(y), 2)


def compact(d: Column) -> Column:
    """A date as `YYYYMMDD`."""
    return F.date_format(d, "yyyyMMdd")


def offset(d: Column, n: Column, unit: str) -> Column:
    """The value n units from a date, no finer than the unit: D, W, M, Y, decade, century."""
    if unit == "D":
        return compact(F.date_add(d, n.cast("int")))
    if unit == "W":
        return week_value(F.date_add(d, (n * 7).cast("int")))
    if unit == "M":
        return F.date_format(F.add_months(F.trunc(d, "month"), n.cast("int")), "yyyyMM")
    y = F.year(d)
    if unit == "Y":
        return (y + n).cast("string")
    return F.floor((y + n * (10 if unit == "decade" else 100)) / (10 if unit == "decade" else 100)).cast("string")


def to_value(s: Column) -> Column:
    """Dates in several formats as `YYYYMMDD`, with `Thhmm` where there is a time; null if none fits.

    Two-digit years below 39 are 20xx; month and day change places where the month can't be one.
    """
    iso = F.regexp_extract(s, "^(\\d{4})-?(\\d{2})-?(\\d{2})", 0)
    slash = F.regexp_extract_all(s, F.lit("\\d+"), F.lit(0))
    is_slash = s.rlike("^\\d{1,2}[/.-]\\d{1,2}[/.-](\\d{4}|\\d{2})\\b")
    p, q, r = (F.get(slash, F.lit(k)).try_cast("int") for k in range(3))
    year = F.when(F.length(F.get(slash, F.lit(2))) == 4, r).when(r < 39, r + 2000).otherwise(r + 1900)
    month, day = F.when(p > 12, q).otherwise(p), F.when(p > 12, p).otherwise(q)
    time = F.regexp_extract(s, "[T ](\\d{2}):(\\d{2})", 0)
    clock = F.when(time != "", F.concat(F.lit("T"), F.regexp_replace(F.substring(time, 2, 5), ":", "")))
    days = F.when(iso != "", F.regexp_replace(iso, "-", "")).when(is_slash, F.format_string("%04d%02d%02d", year, month, day))
    return F.concat(days, F.coalesce(clock, F.lit("")))


#: unit: (letter, times)
UNITS = {"second": ("TS", 1), "minute": ("TM", 1), "hour": ("TH", 1), "day": ("D", 1), "week": ("D", 7), "fortnight": ("D", 14), "month": ("M", 1), "quarter": ("M", 3), "year": ("Y", 1), "decade": ("Y", 10), "century": ("Y", 100)}


def duration(n: Column, unit: Column) -> Column:
    """ISO duration; a number that is unknown (null) is X."""
    out = F.lit(None).cast("string")
    for name, (letter, times) in UNITS.items():
        count = F.coalesce((n * times).cast("string"), F.lit("X"))
        value = F.concat(F.lit("PT"), count, F.lit(letter[1])) if letter[0] == "T" else F.concat(F.lit("P"), count, F.lit(letter))
        out = F.when(unit == name, value).otherwise(out)
    return out
