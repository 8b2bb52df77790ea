"""Date row expressions; an unparseable cell gives an empty text or 0."""

from __future__ import annotations

import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Env, Expr
from .values import moment

ISO = "yyyy-MM-dd"
#: Reference-time tokens and the patterns they stand for, longest first.
TOKENS = (
    ("January", "MMMM"), ("Monday", "EEEE"), ("2006", "yyyy"), ("-07:00", "XXX"), ("Z07:00", "XXX"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"),
    ("01", "MM"), ("02", "dd"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("15", "HH"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
)


def pattern_of(layout: str) -> str:
    """The date_format pattern for a layout written with the reference time."""
    out, plain, i = "", "", 0
    quote = lambda x: "'" + x.replace("'", "''") + "'" if x else ""
    while i < len(layout):
        token, fmt = next(((t, f) for t, f in TOKENS if layout.startswith(t, i)), (layout[i], None))
        if fmt is None:
            plain += token
        else:
            out, plain = out + quote(plain) + fmt, ""
        i += len(token)
    return out + quote(plain)


def _text(col: str, fn) -> Expr:
    return Expr(lambda env: F.coalesce(fn(moment(env.cell(col))).cast("string"), F.lit("")))


def _iso(d: Column) -> Column:
    return F.date_format(d, ISO)


def _days(env: Env, a: str, b: str) -> Column:
    micros = lambda c: F.unix_micros(moment(env.cell(c)).cast("timestamp"))
    return F.coalesce((micros(a) - micros(b)) / F.lit(86400e6), F.lit(0.0))


def diff_days(a: str, b: str) -> Expr:
    return Expr(lambda env: _days(env, a, b))


def diff_months(a: str, b: str) -> Expr:
    return Expr(lambda env: _days(env, a, b) / F.lit(30.44))


def diff_years(a: str, b: str) -> Expr:
    return Expr(lambda env: _days(env, a, b) / F.lit(365.25))


def add_days(col: str, days: int) -> Expr:
    return _text(col, lambda d: _iso(F.date_add(d.cast("date"), days)))


def add_months(col: str, months: int) -> Expr:
    """A day that the month lacks runs over into the next one."""
    return _text(col, lambda d: _iso(F.date_add(F.add_months(F.trunc(d.cast("date"), "MM"), months), F.day(d) - 1)))


def year(col: str) -> Expr:
    return _text(col, F.year)


def month(col: str) -> Expr:
    return _text(col, F.month)


def day(col: str) -> Expr:
    return _text(col, F.day)


def week(col: str) -> Expr:
    return _text(col, F.weekofyear)


def weekday(col: str) -> Expr:
    return _text(col, lambda d: F.date_format(d, "EEEE"))


def quarter(col: str) -> Expr:
    return _text(col, F.quarter)


def start_of_month(col: str) -> Expr:
    return _text(col, lambda d: _iso(F.trunc(d.cast("date"), "MM")))


def end_of_month(col: str) -> Expr:
    return _text(col, lambda d: _iso(F.last_day(d.cast("date"))))


def trunc(col: str, precision: str) -> Expr:
    """To the year, the month, or else the day."""
    unit = {"year": "YEAR", "month": "MM"}.get(precision)
    return _text(col, lambda d: _iso(F.trunc(d.cast("date"), unit) if unit else d))


def format_(col: str, layout: str) -> Expr:
    return _text(col, lambda d: F.date_format(d, pattern_of(layout)))


def age(col: str, ref: datetime.date | None = None) -> Expr:
    """Full years at ref (today), by the day of the year."""
    at = F.lit((ref or datetime.date.today()).strftime("%Y-%m-%d")).cast("date")
    return _text(col, lambda d: F.year(at) - F.year(d) - F.when(F.dayofyear(at) < F.dayofyear(d), 1).otherwise(0))


def between(col: str, start: str, end: str) -> Expr:
    """start <= col <= end; false where one of them can't be parsed."""
    return Expr(lambda env: F.coalesce(moment(env.cell(col)).between(moment(env.cell(start)), moment(env.cell(end))), F.lit(False)))
