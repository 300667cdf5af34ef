"""Record filters: a small grammar, its syntax tree, and two evaluations as Catalyst expressions.

``mode="sql"`` compares as the store's SQL does (numbers by value, text by
code point, numbers sort below text); ``mode="memory"`` compares the rendered
text of scalars. Both are null-rejecting.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

OPS = ("eq", "contains", "gte", "lte", "numgte")


@dataclass(frozen=True)
class Filter:
    """One predicate; ``numgte`` holds if any of its paths is a number of at least the value."""

    op: str
    paths: tuple[str, ...]
    value: str


def parse_filter(spec: str) -> Filter:
    """``<path>[,<path>...]:<op>:<value>``; the value keeps later colons; paths start with ``$.``."""
    path, _, rest = spec.partition(":")
    op, sep, value = rest.partition(":")
    if op not in OPS:
        raise ValueError(f"unknown filter op {op!r} in {spec!r}")
    if not sep:
        raise ValueError(f"a filter needs a value: {spec!r}")
    paths = tuple(p.strip() for p in path.split(",")) if op == "numgte" else (path,)
    if not all(re.fullmatch(r"\$\.[^.]+(\.[^.]+)*", p) for p in paths):
        raise ValueError(f"a filter path starts with $. and names members: {spec!r}")
    if op == "numgte":
        float(value)
    return Filter(op, paths, value)


def parse_filters(specs: list[str] | None) -> list[Filter]:
    """All specs; blank ones are unset."""
    return [parse_filter(s) for s in specs or [] if s and s.strip()]


def member(data: Column, path: str) -> Column:
    """Text of the member at ``$.a.b``; strings bare, objects and arrays as JSON."""
    quoted = "$" + "".join(f"['{p}']" for p in path.removeprefix("$.").split("."))
    return F.get_json_object(data, quoted)


def raw_type(data: Column, path: str) -> Column:
    """``string``, ``number``, ``boolean``, ``array``, ``object`` or ``null`` of the member; null if it is missing."""
    text = F.get_json_object(data, "$" + "".join(f"['{p}']" for p in path.removeprefix("$.").split(".")))
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(data), "$" + "".join(f"['{p}']" for p in path.removeprefix("$.").split(".")), "variant"))
    return (
        F.when(kind.isNull(), None).when(kind == "STRING", "string").when(kind == "BOOLEAN", "boolean").when(kind == "VOID", "null")
        .when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").when(text.isNotNull(), "number")
    )


def _leading_number(value: str) -> float:
    m = re.match(r"\s*[+-]?(\d+\.?\d*([eE][+-]?\d+)?|\.\d+([eE][+-]?\d+)?)", value)
    return float(m[0]) if m else 0.0


def _ascii_lower(c: Column) -> Column:
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def predicate(f: Filter, data: Column, mode: str = "sql") -> Column:
    """One filter as a boolean expression that is never null."""
    path = f.paths[0]
    text, kind = member(data, path), raw_type(data, path)
    number = lambda c: c.try_cast("double")
    if f.op == "numgte":
        hits = [(raw_type(data, p) == "number") & (number(member(data, p)) >= float(f.value)) for p in f.paths]
        return F.coalesce(reduce(lambda a, b: a | F.coalesce(b, F.lit(False)), hits, F.lit(False)), F.lit(False))
    if mode == "memory":
        scalar = F.when(kind.isin("string", "number", "boolean"), text)
        test = {"eq": scalar == f.value, "contains": F.contains(F.lower(scalar), F.lit(f.value.lower())), "gte": scalar >= f.value, "lte": scalar <= f.value}[f.op]
        return F.coalesce(test, F.lit(False))
    if f.op == "eq":
        return F.coalesce((kind == "string") & (text == f.value), F.lit(False))
    shown = F.when(kind == "boolean", F.when(text == "true", "1").otherwise("0")).when(kind == "null", None).otherwise(text)
    if f.op == "contains":
        return F.contains(_ascii_lower(F.coalesce(shown, F.lit(""))), F.lit("".join(c.lower() if c.isascii() else c for c in f.value)))
    sign = (lambda a, b: a >= b) if f.op == "gte" else (lambda a, b: a <= b)
    # booleans are the integers 0 and 1 there, compared with a text bound: a number sorts below any text
    test = F.when(kind == "number", sign(number(text), F.lit(_leading_number(f.value)))).when(kind == "boolean", F.lit(f.op == "lte")).when(kind.isin("string", "array", "object"), sign(text, F.lit(f.value)))
    return F.coalesce(test, F.lit(False))


def typed_predicate(f: Filter, columns: dict[str, tuple[Column, str]], mode: str = "sql") -> Column | None:
    """The same predicate on typed columns that hold the members (path -> column, ``string`` or ``number``); None if one isn't held.

    Null where the JSON form is false, which a WHERE clause takes alike; such
    comparisons reach the scan.
    """
    if not all(p in columns for p in f.paths):
        return None
    c, kind = columns[f.paths[0]]
    if f.op == "numgte":
        hits = [columns[p][0] >= float(f.value) for p in f.paths if columns[p][1] == "number"]
        return reduce(lambda a, b: a | b, hits) if hits else F.lit(False)
    if kind == "number" and mode == "sql" and f.op in ("gte", "lte"):
        return c >= _leading_number(f.value) if f.op == "gte" else c <= _leading_number(f.value)
    if kind == "number" and mode == "sql" and f.op == "eq":
        return F.lit(False)
    text = c if kind == "string" else c.cast("string")
    if f.op == "contains":
        low = _ascii_lower(text) if mode == "sql" else F.lower(text)
        needle = "".join(x.lower() if x.isascii() else x for x in f.value) if mode == "sql" else f.value.lower()
        return F.contains(F.coalesce(low, F.lit("")) if mode == "sql" else low, F.lit(needle))
    return {"eq": text == f.value, "gte": text >= f.value, "lte": text <= f.value}[f.op]


def all_of(filters: list[Filter], data: Column, mode: str = "sql", columns: dict[str, tuple[Column, str]] | None = None) -> Column:
    """Conjunction; no filters match everything. Members held in typed ``columns`` are compared there."""
    tests = []
    for f in filters:
        t = typed_predicate(f, columns or {}, mode)
        tests.append(predicate(f, data, mode) if t is None else t)
    return reduce(lambda a, b: a & b, tests, F.lit(True))


def trust_label(trust: Column) -> Column:
    """Null and blank mean stable."""
    return F.when(trust.isNull() | (F.trim(trust) == ""), F.lit("stable")).otherwise(F.trim(trust))


# Trust labels from the strongest to the weakest.
TRUST_ORDER = ("stable", "provisional", "quarantined")


def trust_rank(trust: Column) -> Column:
    """0 for the strongest; unknown labels are weakest."""
    label = trust_label(trust)
    return F.when(label == TRUST_ORDER[0], 0).when(label == TRUST_ORDER[1], 1).when(label == TRUST_ORDER[2], 2).otherwise(3)


def weakest_trust(*trusts: Column) -> Column:
    """The label of the largest rank."""
    return F.greatest(*[F.struct(trust_rank(t).alias("rank"), trust_label(t).alias("label")) for t in trusts])["label"] if len(trusts) > 1 else trust_label(trusts[0])
