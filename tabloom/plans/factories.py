"""Every operator as a function that makes a table step: ``select("a", "b")(table)``.

The names are those of the table's operators; ``transform_rows`` is ``transform``
over rows.  The same steps serve immutable and mutable tables.
"""

from __future__ import annotations

from ..table import OPERATORS


def _factory(name: str):
    def make(*args, **kwargs):
        return lambda table: getattr(table, name)(*args, **kwargs)

    make.__name__, make.__doc__ = name, f"A step that calls {name}."
    return make


globals().update({name: _factory(name) for name in OPERATORS})
transform_rows = _factory("transform")
__all__ = [*OPERATORS, "transform_rows"]
