"""A value or an error."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any


class Result:
    """Ok(value) or Err(error)."""

    def is_ok(self) -> bool:
        return isinstance(self, Ok)

    def is_err(self) -> bool:
        return not self.is_ok()

    def then(self, fn: Callable[[Any], Any]) -> Result:
        """fn's value or Result on an Ok; an exception becomes an Err."""
        if isinstance(self, Err):
            return self
        try:
            made = fn(self.value)
        except Exception as error:  # a step's failure is a value here
            return Err(error)
        return made if isinstance(made, Result) else Ok(made)

    def unwrap(self) -> Any:
        if isinstance(self, Err):
            raise self.error
        return self.value

    def unwrap_or(self, other: Any) -> Any:
        return self.value if isinstance(self, Ok) else other


@dataclass(frozen=True)
class Ok(Result):
    value: Any


@dataclass(frozen=True)
class Err(Result):
    error: Exception
