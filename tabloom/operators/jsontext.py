"""JSON as text: paths, flattening and rebuilding with numbers kept as written."""

from __future__ import annotations

import json


class _Number(str):
    """A number's own text."""


class PathError(ValueError):
    pass


def decode(text: str):
    """The first JSON value of a text; raises ValueError."""
    text = text.lstrip(" \t\r\n")
    value, _ = json.JSONDecoder(parse_float=_Number, parse_int=_Number, parse_constant=_refuse).raw_decode(text)
    return value


def _refuse(name):
    raise ValueError(f"invalid literal {name}")


def compact(value) -> str:
    """Compact JSON with sorted keys and <, >, & escaped."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{_string(k)}:{compact(value[k])}" for k in sorted(value, key=lambda k: k.encode())) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(compact, value)) + "]"
    if isinstance(value, _Number):
        return str(value)
    if isinstance(value, str):
        return _string(value)
    return json.dumps(value)


def _string(s: str) -> str:
    out = json.dumps(s, ensure_ascii=False)
    for c in "<>&\u2028\u2029":
        out = out.replace(c, f"\\u{ord(c):04x}")
    return out


def text(value) -> str:
    """A value as a cell: strings and numbers as they are, null empty, nested values as compact JSON."""
    if value is None:
        return ""
    if isinstance(value, str):
        return str(value)
    if isinstance(value, bool):
        return "true" if value else "false"
    return compact(value)


def parse_path(path: str) -> list[tuple[str, int | None]]:
    """Keys and optional indices of a path like .a.b[0].c."""
    if not path.startswith(".") or path == ".":
        raise PathError(f"path {path!r} must be a dot and a key")
    steps, rest = [], path[1:]
    while rest:
        if rest[0] == ".":
            raise PathError(f"path {path!r} has an empty key")
        size = min((i for i in (rest.find("."), rest.find("[")) if i >= 0), default=len(rest))
        key, rest, index = rest[:size], rest[size:], None
        if rest.startswith("["):
            inside, close, rest = rest[1:].partition("]")
            if not close or not inside.lstrip("+").isascii() or not inside.lstrip("+").isdigit():
                raise PathError(f"path {path!r} has a bad index")
            index = int(inside)
        steps.append((key, index))
        rest = rest.removeprefix(".")
    return steps


def follow(value, steps):
    for key, index in steps:
        if not isinstance(value, dict) or key not in value:
            return None
        value = value[key]
        if index is not None:
            if not isinstance(value, list) or index >= len(value):
                return None
            value = value[index]
    return value


def top_level(value, name: str) -> list[tuple[str, str]]:
    """(column, cell) of an object's keys or a list's places under a name; a scalar under the name itself."""
    if isinstance(value, dict):
        return [(f"{name}.{k}", text(v)) for k, v in value.items()]
    if isinstance(value, list):
        return [(f"{name}.{i}", text(v)) for i, v in enumerate(value)]
    return [(name, text(value))]


def flatten(value, prefix: str, sep: str, max_depth: int) -> list[tuple[str, str]]:
    """(column, cell) of all leaves; what lies deeper than max_depth (if over 0) stays JSON; empty containers stay text."""
    out: list[tuple[str, str]] = []
    todo = [(prefix, value, 0)]
    while todo:
        at, v, depth = todo.pop()
        nested = isinstance(v, dict | list)
        if not nested or (max_depth > 0 and depth > max_depth):
            if at or nested:
                out.append((at, text(v)))
        elif not v:
            if at:
                out.append((at, "{}" if isinstance(v, dict) else "[]"))
        else:
            items = list(v.items()) if isinstance(v, dict) else [(str(i), x) for i, x in enumerate(v)]
            todo += [((at + sep + k) if at else k, x, depth + 1) for k, x in reversed(items)]
    return out
