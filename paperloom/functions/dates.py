"""Date and clock-time column expressions. Clock times are ``HH:mm`` strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from paperloom import fixed
from paperloom.functions.text import _col, ws_trim

_CLOCK = r"^(\d{1,2}):(\d{1,2})$"


def safe_date(c: Column | str) -> Column:
    """``Y-M-D`` text to DATE, NULL when it is no calendar date."""
    text = ws_trim(c)
    return F.when(text.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), F.try_to_date(text, "yyyy-M-d"))


def safe_clock(c: Column | str) -> Column:
    """``H:M`` text to ``HH:mm``, NULL when out of range."""
    text = ws_trim(c)
    hour = F.regexp_extract(text, _CLOCK, 1)
    minute = F.regexp_extract(text, _CLOCK, 2)
    ok = (hour != "") & (F.lpad(hour, 2, "0") <= "23") & (F.lpad(minute, 2, "0") <= "59")
    return F.when(ok, F.concat_ws(":", F.lpad(hour, 2, "0"), F.lpad(minute, 2, "0")))


def add_minutes(clock: Column | str, minutes: int) -> Column:
    """Clock arithmetic on ``HH:mm`` that wraps at midnight."""
    clock = _col(clock)
    total = F.pmod(
        F.substring(clock, 1, 2).cast("int") * 60 + F.substring(clock, 4, 2).cast("int") + minutes,
        F.lit(1440),
    )
    return F.format_string("%02d:%02d", F.floor(total / 60).cast("int"), F.pmod(total, F.lit(60)))


def compact_date(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyyMMdd")


def padded_date_label(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy年MM月dd日")


def date_label(d: Column | str) -> Column:
    return F.date_format(_col(d), "yyyy年M月d日")


def utc_stamp(ts: Column | str) -> Column:
    return F.date_format(_col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def clock_sort_key(clock: Column | str) -> Column:
    return F.coalesce(_col(clock), F.lit(fixed.NO_TIME_SORT_KEY))
