"""Item schemas as predicates."""

from __future__ import annotations

from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import urls

_TYPES = {"string": T.StringType(), "int": T.LongType(), "float": T.DoubleType(), "bool": T.BooleanType()}


def struct_of(fields: dict[str, dict]) -> T.StructType:
    """H4: the typed form of an item schema; arrays and objects stay JSON text inside."""
    out = T.StructType()
    for name, spec in fields.items():
        kind = spec.get("type", "string")
        inner = T.ArrayType(T.StringType()) if kind == "array" else struct_of(spec["fields"]) if kind == "object" and spec.get("fields") else _TYPES.get(kind, T.StringType())
        out.add(name, inner)
    return out


def empty(c: Column, kind: str) -> Column:
    if kind == "string":
        return c.isNull() | (c == "")
    return c.isNull() | (F.size(c) == 0) if kind == "array" else c.isNull()


def rule(c: Column, kind: str, spec: Any) -> Column:
    """One rule as a predicate; rules other than required pass over missing values."""
    name, value = (spec, None) if isinstance(spec, str) else next(iter(spec.items()))
    if name == "required":
        return ~empty(c, kind)
    size = F.length(c) if kind == "string" else F.size(c) if kind == "array" else c
    tests = {"min": lambda: size >= value, "max": lambda: size <= value, "len": lambda: size == value, "url": lambda: urls.http_valid(c)}
    return c.isNull() | tests[name]()


def valid(fields: dict[str, dict], at: str = "") -> Column:
    """Whether typed columns satisfy a schema."""
    out = F.lit(True)
    for name, spec in fields.items():
        c, kind = F.col(f"{at}{name}"), spec.get("type", "string")
        for r in spec.get("rules") or []:
            out = out & F.coalesce(rule(c, kind, r), F.lit(False))
        if kind == "object" and spec.get("fields"):
            out = out & (c.isNull() | valid(spec["fields"], f"{at}{name}."))
    return out


def has_all(columns: list[str]) -> Column:
    """P10: every listed text column is present and not empty."""
    out = F.lit(True)
    for c in columns:
        out = out & F.coalesce(F.col(c) != "", F.lit(False))
    return out


def split_items(items: DataFrame, fields: dict[str, dict], data: str = "data") -> tuple[DataFrame, DataFrame]:
    """Valid items with their typed ``item``, and the others.

    Text that does not parse to the schema's types is invalid.
    """
    typed = items.withColumn("item", F.from_json(data, struct_of(fields), {"mode": "PERMISSIVE"}))
    wrong = F.lit(False)
    for name, spec in fields.items():
        if spec.get("type", "string") in ("int", "float", "bool"):
            wrong = wrong | (F.get_json_object(data, f"$.{name}").isNotNull() & F.col(f"item.{name}").isNull())
    ok = F.coalesce(valid(fields, "item.") & ~wrong, F.lit(False))
    return typed.filter(ok), typed.filter(~ok)


def sizes_within(media: Column, most: int) -> Column:
    """K8."""
    return F.forall(media, lambda m: (m["size"] >= 0) & (m["size"] <= most))
