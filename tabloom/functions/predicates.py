"""Predicates over cells; a missing column reads as empty."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from .expr import Expr, and_, not_, or_  # noqa: F401


def _of(col: str, on_cell, on_text=None) -> Expr:
    """A predicate of a cell, or of the source's text where the table still has it (a null is an empty cell)."""
    def made(env):
        text = env.text(col)
        return on_cell(env.cell(col)) if text is None or on_text is None else on_text(text)

    return Expr(made)


def eq(col: str, val: str) -> Expr:
    if not val:
        return Expr(lambda env: env.missing(col))
    return _of(col, lambda c: c == F.lit(val), lambda t: t.isNotNull() & (t == F.lit(val)))


def ne(col: str, val: str) -> Expr:
    if not val:
        return Expr(lambda env: ~env.missing(col))
    return _of(col, lambda c: c != F.lit(val), lambda t: t.isNull() | (t != F.lit(val)))


def _part(col: str, part: str, test) -> Expr:
    """A test that an empty cell fails unless part is empty."""
    return _of(col, test, (lambda t: t.isNotNull() & test(t)) if part else None)


def contains(col: str, sub: str) -> Expr:
    return _part(col, sub, lambda c: c.contains(F.lit(sub)))


def prefix(col: str, start: str) -> Expr:
    return _part(col, start, lambda c: c.startswith(F.lit(start)))


def suffix(col: str, end: str) -> Expr:
    return _part(col, end, lambda c: c.endswith(F.lit(end)))


def matches(col: str, pattern: str) -> Expr:
    """Unanchored; look-around and back-references are refused, as is an invalid pattern."""
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<", pattern):
        raise ValueError(f"pattern {pattern!r}: look-around and back-references aren't supported")
    re.compile(re.sub(r"\\[zpP](?:\{\w+\}|\w)?", ".", pattern))
    return Expr(lambda env: env.cell(col).rlike(pattern))


def empty(col: str) -> Expr:
    return eq(col, "")


def not_empty(col: str) -> Expr:
    return ne(col, "")
