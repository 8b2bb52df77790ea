"""Row expressions: built against a table's columns, evaluated by Spark."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import number


def quoted(name: str) -> Column:
    """A column by its exact name, dots and back-ticks included."""
    return F.col("`" + name.replace("`", "``") + "`")


#: Before the name of a column as its source has it, which a table carries until the cell is changed.
RAW = "__raw_"


class Env:
    """What a row expression sees: a table's cells; a missing column reads as empty.

    raws names the columns that the frame also has as the source has them, "text" or
    "number"; filters on those reach the source, and numbers aren't parsed again."""

    def __init__(self, names: list[str], raws: dict[str, str] | None = None):
        self.names, self.raws = names, raws or {}

    def cell(self, name: str) -> Column:
        return quoted(name) if name in self.names else F.lit("")

    def text(self, name: str) -> Column | None:
        """The source's text, null where the cell is empty for want of it."""
        return quoted(RAW + name) if self.raws.get(name) == "text" else None

    def missing(self, name: str) -> Column:
        """Whether the cell is empty."""
        text = self.text(name)
        if text is not None:
            return text.isNull() | (text == "")
        return quoted(RAW + name).isNull() if name in self.raws else self.cell(name) == ""

    def number(self, name: str) -> Column:
        """A double, or null where the cell isn't a number."""
        return quoted(RAW + name).cast("double") if self.raws.get(name) == "number" else number(self.cell(name))


class Expr:
    """A function of a row, as a Column once the table is known."""

    def __init__(self, build: Callable[[Env], Column]):
        self.build = build

    def __and__(self, other: Expr) -> Expr:
        return and_(self, other)

    def __or__(self, other: Expr) -> Expr:
        return or_(self, other)

    def __invert__(self) -> Expr:
        return not_(self)


def build(fn, env: Env) -> Column | None:
    """The Column of an Expr or Column; None for a plain Python function."""
    if isinstance(fn, Expr):
        return fn.build(env)
    if isinstance(fn, Column):
        return fn
    return None


def _column(fn, env: Env) -> Column:
    found = build(fn, env)
    if found is None:
        raise TypeError("and_, or_ and not_ take expressions or columns")
    return found


def and_(*fns) -> Expr:
    return Expr(lambda env: reduce(lambda a, b: a & b, [_column(f, env) for f in fns], F.lit(True)))


def or_(*fns) -> Expr:
    return Expr(lambda env: reduce(lambda a, b: a | b, [_column(f, env) for f in fns], F.lit(False)))


def not_(fn) -> Expr:
    return Expr(lambda env: ~_column(fn, env))
