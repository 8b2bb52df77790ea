"""Unpivot, pivot, explode on frames with a row order."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.values import trimmed


def parts(c: Column, sep: str) -> Column:
    """The trimmed, non-empty pieces between literal separators; the cell itself if none is left."""
    pieces = F.split(c, re.escape(sep)) if sep else F.array(c)
    kept = F.filter(F.transform(pieces, trimmed), lambda x: x != "")
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(c))


def melted(names: list[str], column, var: str, val: str) -> Column:
    """An array of (position, name, cell) for the named columns."""
    return F.array(*(F.struct(F.lit(i).alias("__p"), F.lit(n).alias(var), column(n).alias(val)) for i, n in enumerate(names)))
