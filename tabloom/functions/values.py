"""Cells as numbers, dates and truth values, and back to text."""

from __future__ import annotations

import math
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

WHITE = " \t\n\r\x0b\x0c"
_NUMBER = r"^[+-]?((\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?|(?i:inf|infinity|nan))$"
_INTEGER = r"^[+-]?\d+$"
#: The date layouts in the order in which they are tried, as Spark patterns with a guard on the text's form.
LAYOUTS = (
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$", None),
    (r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?$", None),
    (r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"),
    (r"^\d{2}\.\d{2}\.\d{4}$", "dd.MM.yyyy"),
    (r"^\d{2}/\d{2}/\d{4}$", "MM/dd/yyyy"),
    (r"^\d{1,2} [A-Z][a-z]{2} \d{4}$", "d MMM yyyy"),
    (r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$", "MMM d, yyyy"),
)


def trimmed(c: Column) -> Column:
    return F.btrim(c, F.lit(WHITE))


def number(c: Column) -> Column:
    """A double, or null where the trimmed cell isn't a decimal number, inf or nan."""
    t = trimmed(c)
    return F.when(t.rlike(_NUMBER), t.try_cast("double"))


def integer(c: Column) -> Column:
    t = trimmed(c)
    return F.when(t.rlike(_INTEGER), t.try_cast("bigint"))


def truth(c: Column) -> Column:
    t = F.lower(trimmed(c))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False)


def moment(c: Column) -> Column:
    """A timestamp without zone by the first layout that fits, or null; year 1's first day counts as null."""
    t = trimmed(c)
    clock = F.regexp_replace(F.substring(t, 1, 40), r"(Z|[+-]\d{2}:\d{2})$", "")
    tried = [F.when(t.rlike(form), (clock if fmt is None else F.try_to_timestamp(t, F.lit(fmt))).try_cast("timestamp_ntz")) for form, fmt in LAYOUTS]
    found = F.coalesce(*tried)
    return F.when(found > F.lit("0001-01-01").cast("timestamp_ntz"), found)


def shortest(x: Column) -> Column:
    """A double in its shortest decimal form without exponent."""
    s = x.cast("string")
    sign, whole, part, power = (F.regexp_extract(s, r"^(-?)(\d+)\.?(\d*)E(-?\d+)$", i) for i in range(1, 5))
    part = F.when(part == "0", "").otherwise(part)
    e = power.try_cast("int")
    digits = F.concat(whole, part)
    up = F.when(e >= F.length(part), F.concat(digits, F.repeat(F.lit("0"), e - F.length(part)))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.length(digits))))
    down = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
    plain = F.regexp_replace(s, r"\.0$", "")
    text = F.when(s.contains("E"), F.concat(sign, F.when(e >= 0, up).otherwise(down))).otherwise(plain)
    return F.when(F.isnan(x), "NaN").when(s == "Infinity", "+Inf").when(s == "-Infinity", "-Inf").when(x == 0, F.when(s.startswith("-"), "-0").otherwise("0")).otherwise(text)


def printed(x: float) -> str:
    """A double as shortest prints it, from Python."""
    if not math.isfinite(x):
        return "NaN" if math.isnan(x) else "+Inf" if x > 0 else "-Inf"
    s = repr(x)
    return (format(Decimal(s), "f") if "e" in s else s).removesuffix(".0")


def fixed(x: Column, precision: int) -> Column:
    """A double with that many decimals, rounded by its exact binary value."""
    return F.replace(F.format_number(x, max(precision, 0)), F.lit(","), F.lit(""))


def present(c: Column) -> Column:
    """The cell, or null where it is empty."""
    return F.nullif(c, F.lit(""))
