"""Dynamic JSON values: emptiness, scalars, canonical text, hashes, templates and transforms; native column twins."""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import urls

LIMIT = 1 << 63


class RuleError(ValueError):
    """A row breaks a rule of its configuration."""


def is_empty(v: Any) -> bool:
    return v is None or (isinstance(v, (str, list, dict)) and len(v) == 0)


def scalar(v: Any) -> str:
    """The text of a string, number or boolean."""
    if isinstance(v, str):
        return v
    if isinstance(v, bool) or isinstance(v, (int, float)):
        return dumps(v)
    raise RuleError("value is not a scalar")


def _plain(v: Any) -> Any:
    if isinstance(v, float) and (math.isinf(v) or math.isnan(v)):
        return None
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v] if isinstance(v, list) else v


def dumps(v: Any) -> str:
    return json.dumps(_plain(v), ensure_ascii=False, separators=(",", ":"))


def canonical(v: Any) -> str:
    """JSON text with keys in order at every level; arrays keep theirs."""
    return json.dumps(_plain(v), ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def fingerprint(values: list[Any]) -> str:
    return sha256(canonical(values))


def same(a: Any, b: Any) -> bool:
    """Equality of JSON values: types count, so 1, 1.0, "1" and true differ from one another."""
    if type(a) is not type(b):
        return False
    if isinstance(a, list):
        return len(a) == len(b) and all(map(same, a, b))
    if isinstance(a, dict):
        return a.keys() == b.keys() and all(same(v, b[k]) for k, v in a.items())
    return a == b


def sample(key: str, ratio: float) -> bool:
    """Deterministic sampling: the first 53 bits of a digest below ``ratio``."""
    return int(hashlib.sha256(key.encode()).hexdigest()[:14], 16) >> 3 < ratio * 2**53


# ------------------------------------------------------------------------ templates

_HOLE = re.compile(r"\{([^{}]*)\}")


def template_parts(text: str) -> list[tuple[bool, str]]:
    """``(is a name, text)`` pieces of a template; braces must pair up and names must not be blank."""
    out, at = [], 0
    for m in _HOLE.finditer(text):
        if m.start() > at:
            out.append((False, text[at : m.start()]))
        if not m[1].strip():
            raise RuleError(f"empty template variable in {text!r}")
        out.append((True, m[1].strip()))
        at = m.end()
    out += [(False, text[at:])] if at < len(text) else []
    if any("{" in t or "}" in t for named, t in out if not named):
        raise RuleError(f"unbalanced braces in {text!r}")
    return out


def render(text: str, resolve: Callable[[str], Any]) -> Any:
    """A template over scalars, or element-wise over arrays of one length; null if any variable is."""
    parts = template_parts(text)
    values = {name: resolve(name) for named, name in parts if named}
    if any(v is None for v in values.values()):
        return None
    sizes = {len(v) for v in values.values() if isinstance(v, list)}
    if len(sizes) > 1:
        raise RuleError(f"arrays of different length in {text!r}")
    if not sizes:
        return "".join(scalar(values[t]) if named else t for named, t in parts)
    out = []
    for i in range(sizes.pop()):
        row = {k: v[i] if isinstance(v, list) else v for k, v in values.items()}
        out.append(None if any(v is None for v in row.values()) else "".join(scalar(row[t]) if named else t for named, t in parts))
    return out


def render_value(v: Any, resolve: Callable[[str], Any]) -> Any:
    """Templates in nested values; a lone ``{x}`` keeps the type of x."""
    if isinstance(v, list):
        return [render_value(x, resolve) for x in v]
    if isinstance(v, dict):
        return {k: render_value(x, resolve) for k, x in v.items()}
    if not isinstance(v, str):
        return v
    parts = template_parts(v)
    if len(parts) == 1 and parts[0][0]:
        return resolve(parts[0][1])
    missing = [t for named, t in parts if named and resolve(t) is None]
    if missing:
        raise RuleError(f"undefined template variable: {missing[0]}")
    return "".join(scalar(resolve(t)) if named else t for named, t in parts)


# ----------------------------------------------------------------------- transforms


def transform(v: Any, kind: str, argument: Any = None) -> Any:
    """One step of a pipeline, lifted over arrays; null stays null."""
    if v is None:
        return None
    if isinstance(v, list):
        return [transform(x, kind, argument) for x in v]
    if kind == "add":
        a = int(scalar(v)) if not isinstance(v, bool) and re.fullmatch(r"[+-]?\d+", scalar(v)) else None
        b = int(scalar(argument)) if not isinstance(argument, bool) and re.fullmatch(r"[+-]?\d+", scalar(argument)) else None
        if a is None or b is None:
            raise RuleError("add needs integers")
        if not -LIMIT <= a + b < LIMIT:
            raise RuleError("add overflows")
        return a + b
    text = scalar(v)
    if kind == "trim":
        return text.strip()
    if kind == "normalize_space":
        return " ".join(text.split())
    if kind == "lowercase":
        return text.lower()
    if kind == "uppercase":
        return text.upper()
    try:
        return urls.join(scalar(argument), text) if kind == "url_join" else urls.normalize(text)
    except urls.UrlError as e:
        raise RuleError(str(e)) from e


# ------------------------------------------------------------------- native columns


def trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def normalize_space(c: Column) -> Column:
    return trim(F.regexp_replace(c, r"(?U)\s+", " "))


def lowercase(c: Column) -> Column:
    return F.lower(c)


def uppercase(c: Column) -> Column:
    return F.upper(c)


def add(c: Column, n: int | Column) -> Column:
    """64-bit addition; overflow raises under ANSI."""
    return c.cast("long") + (F.lit(n).cast("long") if isinstance(n, int) else n.cast("long"))


def lift(c: Column, f: Callable[[Column], Column]) -> Column:
    return F.transform(c, f)


def fill(text: str, columns: dict[str, Column]) -> Column:
    """A template as one ``concat``; null if any variable is."""
    return F.concat(*[columns[t].cast("string") if named else F.lit(t) for named, t in template_parts(text)])


def fill_arrays(text: str, columns: dict[str, Column], arrays: list[str]) -> Column:
    """A template over arrays: element-wise, equal lengths asserted, scalars repeated."""
    first = columns[arrays[0]]
    equal = F.lit(True)
    for a in arrays[1:]:
        equal = equal & (F.size(columns[a]) == F.size(first))
    at = lambda i: {n: F.get(c, i) if n in arrays else c for n, c in columns.items()}
    return F.when(equal, F.transform(F.sequence(F.lit(1), F.size(first)), lambda i: fill(text, at(i - 1)))).otherwise(
        F.raise_error(F.lit("template arrays differ in length")).cast("array<string>")
    )


def null_if_empty(c: Column) -> Column:
    return F.when(c != "", c)


def first_non_empty(*columns: Column) -> Column:
    """The fallback chain of extractors."""
    return F.coalesce(*[null_if_empty(c) for c in columns])


def sampled(key: Column, ratio: float) -> Column:
    return F.conv(F.substring(F.sha2(key, 256), 1, 13), 16, 10).cast("long") < F.lit(int(ratio * (1 << 52)))


def child_id(parent: Column, print_: Column, occurrence: Column) -> Column:
    """Replay-stable id of a child row."""
    return F.sha2(F.concat_ws("\n", parent, print_, occurrence.cast("string")), 256)
