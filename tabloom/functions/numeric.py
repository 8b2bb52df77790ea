"""Numeric row expressions; a missing or unparseable operand is 0."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .expr import Env, Expr


def _x(env: Env, col: str) -> Column:
    return F.coalesce(env.number(col), F.lit(0.0))


def _fold(cols, op) -> Expr:
    return Expr(lambda env: reduce(op, [_x(env, c) for c in cols]) if cols else F.lit(0.0))


def _one(col: str, fn) -> Expr:
    return Expr(lambda env: fn(_x(env, col)))


def _ratio(a: str, b: str, fn) -> Expr:
    def made(env: Env) -> Column:
        x, y = _x(env, a), _x(env, b)
        return F.when(y == 0, F.lit(0.0)).otherwise(fn(x, F.when(y != 0, y)))

    return Expr(made)


def add(*cols: str) -> Expr:
    return _fold(cols, lambda a, b: a + b)


def sub(*cols: str) -> Expr:
    return _fold(cols, lambda a, b: a - b)


def mul(*cols: str) -> Expr:
    return _fold(cols, lambda a, b: a * b)


def div(a: str, b: str) -> Expr:
    return _ratio(a, b, lambda x, y: x / y)


def mod(a: str, b: str) -> Expr:
    """Remainder with the dividend's sign."""
    return _ratio(a, b, lambda x, y: x % y)


def pct(a: str, b: str) -> Expr:
    return _ratio(a, b, lambda x, y: x / y * 100)


def abs_(col: str) -> Expr:
    return _one(col, F.abs)


def neg(col: str) -> Expr:
    return _one(col, lambda x: -x)


def add_const(col: str, c: float) -> Expr:
    return _one(col, lambda x: x + F.lit(float(c)))


def mul_const(col: str, c: float) -> Expr:
    return _one(col, lambda x: x * F.lit(float(c)))


def min2(*cols: str) -> Expr:
    return _fold(cols, lambda a, b: F.least(a, b))


def max2(*cols: str) -> Expr:
    return _fold(cols, lambda a, b: F.greatest(a, b))


def round_(col: str, decimals: int) -> Expr:
    """Half away from zero, of the binary product with a power of ten."""
    p = F.lit(10.0**decimals)
    return _one(col, lambda x: F.signum(x) * half_up(F.abs(x) * p) / p)


def half_up(y: Column) -> Column:
    whole = F.floor(y).cast("double")
    return F.when(y >= 4503599627370496.0, y).otherwise(whole + F.when(y - whole >= 0.5, 1.0).otherwise(0.0))


def clamp(col: str, low: float, high: float) -> Expr:
    return _one(col, lambda x: F.least(F.greatest(x, F.lit(float(low))), F.lit(float(high))))
