"""Conditions on edges: three-valued comparisons that never leak null, on dynamic values and as native columns."""

from __future__ import annotations

import operator
from collections.abc import Callable
from functools import reduce
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import is_empty, same

MISSING = object()
_ORDER = {"gt": operator.gt, "gte": operator.ge, "lt": operator.lt, "lte": operator.le}
OPERATORS = ("present", "absent", "eq", "ne", *_ORDER)


def holds(condition: dict | None, resolve: Callable[[str], Any], literal: Callable[[Any], Any]) -> bool:
    """Whether a condition tree holds; ``resolve`` gives MISSING for what is not there."""
    if condition is None:
        return True
    if "all" in condition:
        return all(holds(c, resolve, literal) for c in condition["all"])
    if "any" in condition:
        return any(holds(c, resolve, literal) for c in condition["any"])
    left, op = resolve(condition["from"]), condition["op"]
    if op in ("present", "absent"):
        there = left is not MISSING and not is_empty(left)
        return there if op == "present" else not there
    right = literal(condition.get("value"))
    if left is MISSING or right is MISSING:
        return False
    if op in ("eq", "ne"):
        return same(left, right) == (op == "eq")
    numbers = all(isinstance(x, (int, float)) and not isinstance(x, bool) for x in (left, right))
    return numbers and _ORDER[op](float(left), float(right))


# ------------------------------------------------------------------- native columns


def present(c: Column, kind: str = "string") -> Column:
    if kind == "string":
        return F.coalesce(c != "", F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False)) if kind == "array" else c.isNotNull()


def absent(c: Column, kind: str = "string") -> Column:
    return ~present(c, kind)


def compare(c: Column, op: str, value: Any) -> Column:
    """``eq ne gt gte lt lte`` against a value of the column's own type; null on either side is false."""
    other = value if isinstance(value, Column) else F.lit(value)
    if op in ("eq", "ne"):
        return F.coalesce(c == other if op == "eq" else c != other, F.lit(False))
    return F.coalesce(_ORDER[op](c.cast("double"), other.cast("double")), F.lit(False))


def all_of(*conditions: Column) -> Column:
    return reduce(operator.and_, conditions)


def any_of(*conditions: Column) -> Column:
    return reduce(operator.or_, conditions)
