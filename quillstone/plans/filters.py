"""Filter trees over record columns and JSON bodies, as Column predicates.

A tree is a leaf ``{"path", "op", "value"}`` or a group ``{"all": [...]}`` or
``{"any": [...]}``. Paths are JSON pointers or ``$.a.b``. Promoted paths are typed
columns, so their predicates reach the Parquet scan; others read the JSON body as
a variant, in which an explicit null and a missing value differ.
"""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "neq", "in", "gt", "gte", "lt", "lte", "exists", "contains", "startswith")
MOST_DEPTH, MOST_NODES = 16, 100
_COMPARE = {"eq": operator.eq, "neq": operator.ne, "gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
_SEGMENT = re.compile(r"[A-Za-z0-9_-]+")


class FilterError(ValueError):
    pass


def segments(path: str) -> list[str]:
    """Segments of a JSON pointer (with ~0 and ~1) or of ``$.a.b``."""
    if path.startswith("$."):
        parts = path[2:].split(".")
    elif path.startswith("/"):
        parts = [p.replace("~1", "/").replace("~0", "~") for p in path[1:].split("/")]
    else:
        raise FilterError(f"not a path: {path!r}")
    for part in parts:
        if not _SEGMENT.fullmatch(part):
            raise FilterError(f"not a path segment: {part!r}")
    return parts


@dataclass(frozen=True)
class Paths:
    """Where paths live: ``columns`` by pointer, all others in the JSON text column ``body``."""

    columns: dict[str, str] = field(default_factory=dict)
    body: str | None = None

    def column(self, path: str) -> Column | None:
        wanted = "/" + "/".join(segments(path))
        for pointer, name in self.columns.items():
            if pointer.lower() == wanted.lower():
                return F.col(name)
        return None

    def variant(self, path: str) -> Column:
        if self.body is None:
            raise FilterError(f"unknown path: {path!r}")
        target = "$" + "".join(f"[{p}]" if p.isdigit() else f"['{p}']" for p in segments(path))
        return F.try_variant_get(F.try_parse_json(self.body), target, "variant")

    def typed(self, path: str, value) -> Column:
        """The value at ``path`` as the literal's type; null where it has another type."""
        column = self.column(path)
        if column is not None:
            return column
        kind = "boolean" if isinstance(value, bool) else "double" if isinstance(value, int | float) else "string"
        node = self.variant(path)
        shape = F.schema_of_variant(node)
        fits = {"boolean": shape == "BOOLEAN", "string": shape == "STRING", "double": shape.rlike("^(BIGINT|DOUBLE|FLOAT|DECIMAL)")}[kind]
        return F.when(fits, F.try_variant_get(node, "$", kind))


def _scalar(value):
    if not (value is None or isinstance(value, str | bool | int | float)):
        raise FilterError("a filter value is a scalar")
    if isinstance(value, float) and not math.isfinite(value):
        raise FilterError("a filter value is finite")
    return value


def _leaf(node: dict, paths: Paths) -> Column:
    op = str(node.get("op", "eq")).lower()
    if op not in OPS:
        raise FilterError(f"unknown operator: {op!r}")
    path, value = node["path"], node.get("value")
    column = paths.column(path)
    if op == "exists":
        there = column.isNotNull() if column is not None else paths.variant(path).isNotNull()
        return there if value is None or value else ~there
    if op == "in":
        if not isinstance(value, list | tuple):
            raise FilterError("in takes a list")
        tests = [_leaf({"path": path, "op": "eq", "value": _scalar(v)}, paths) for v in value]
        return functools.reduce(operator.or_, tests, F.lit(False)) if tests else F.lit(False)
    value = _scalar(value)
    if value is None:
        if op not in ("eq", "neq"):
            raise FilterError(f"{op} takes no null")
        null = F.is_variant_null(paths.variant(path)) if column is None else column.isNull()
        return null if op == "eq" else ~null
    if op in ("contains", "startswith"):
        if not isinstance(value, str):
            raise FilterError(f"{op} takes a string")
        text = paths.typed(path, value)
        return text.contains(value) if op == "contains" else text.startswith(value)
    if column is not None and isinstance(value, str) and op in ("gt", "gte", "lt", "lte") and path.startswith("/metadata"):
        raise FilterError("indexed strings have no ranges")
    return _COMPARE[op](paths.typed(path, value), F.lit(value))


def build(tree: dict | None, paths: Paths) -> Column:
    """The predicate of a tree; an empty group, like no tree, lets all rows pass."""
    count = 0

    def walk(node: dict, depth: int) -> Column | None:
        nonlocal count
        count += 1
        if depth > MOST_DEPTH or count > MOST_NODES:
            raise FilterError("the filter is too deep or too large")
        groups = [k for k in ("all", "any") if k in node]
        if not groups:
            if "path" not in node:
                raise FilterError(f"neither a group nor a leaf: {sorted(node)}")
            return _leaf(node, paths)
        parts = [p for child in node[groups[0]] if (p := walk(child, depth + 1)) is not None]
        return functools.reduce(operator.and_ if groups[0] == "all" else operator.or_, parts) if parts else None

    found = walk(tree, 1) if tree else None
    return F.lit(True) if found is None else found
