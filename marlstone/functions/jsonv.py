"""JSON values as data: canonical text, content hash, paths, pruning and field-level diff. Pure Python, used inside Arrow UDFs."""

from __future__ import annotations

import hashlib
import json
from typing import Any

MISSING = object()


def _number(x: float) -> str:
    """Shortest text that reads back as the same float, with a point or an exponent kept and no plus sign."""
    if x != x or x in (float("inf"), float("-inf")):
        return "null"
    text = repr(x)
    return text.replace("e+", "e")


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys; integers and floats keep apart."""
    if isinstance(value, dict):
        return "{" + ",".join(f"{json.dumps(k, ensure_ascii=False)}:{canonical(value[k])}" for k in sorted(value)) + "}"
    if isinstance(value, list):
        return "[" + ",".join(map(canonical, value)) + "]"
    if isinstance(value, float):
        return _number(value)
    return json.dumps(value, ensure_ascii=False)


def parse(text: str | None) -> Any:
    """The value of a JSON text; MISSING for null or malformed text."""
    if text is None:
        return MISSING
    try:
        return json.loads(text)
    except ValueError:
        return MISSING


def content_hash(value: Any, derived: list[str] | None = None) -> str:
    """SHA-256 of the canonical text, leaving out object paths that only restate other data."""
    for path in derived or []:
        value = without_path(value, path)
    return hashlib.sha256(canonical(value).encode()).hexdigest()


def without_path(value: Any, path: str) -> Any:
    """``value`` without the member at ``a.b.c``; unchanged if an object on the way is missing."""
    head, _, rest = path.removeprefix("$.").partition(".")
    if not isinstance(value, dict) or head not in value:
        return value
    if not rest:
        return {k: v for k, v in value.items() if k != head}
    return value | {head: without_path(value[head], rest)}


def at_path(value: Any, path: str) -> Any:
    """The member at ``$.a.b``, through objects only; MISSING if there is none."""
    for key in path.removeprefix("$.").split("."):
        if not isinstance(value, dict) or key not in value:
            return MISSING
        value = value[key]
    return value


def scalar_text(value: Any) -> str | None:
    """Text of a string, number or boolean; None for anything else."""
    if isinstance(value, str):
        return value
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, (int, float)):
        return canonical(value)
    return None


def diff(old: Any, new: Any) -> dict[str, dict[str, Any]]:
    """Dotted path -> {from, to} for each difference; objects are entered, all else is compared whole, the root is ``$``."""
    out: dict[str, dict[str, Any]] = {}
    work = [("", old, new)]
    while work:
        path, a, b = work.pop()
        if isinstance(a, dict) and isinstance(b, dict):
            work += [(f"{path}.{k}" if path else k, a.get(k), b.get(k)) for k in {*a, *b}]
        elif canonical(a) != canonical(b):
            out[path or "$"] = {"from": a, "to": b}
    return dict(sorted(out.items()))


def leaves(value: Any, path: str = "") -> list[tuple[str, Any]]:
    """(path, scalar) pairs in order of keys; array items share the path ``name[]``."""
    if isinstance(value, dict):
        return [x for k in sorted(value) for x in leaves(value[k], f"{path}.{k}" if path else k)]
    if isinstance(value, list):
        return [x for v in value for x in leaves(v, f"{path}[]")]
    return [(path or "$", value)]


def text_of(value: Any) -> str:
    """All strings and numbers of a value, separated by blanks."""
    return "".join(f"{scalar_text(v)} " for _, v in leaves(value) if isinstance(v, (str, int, float)) and not isinstance(v, bool))


def salvage(text: str | None) -> Any:
    """A JSON value out of prose: the text itself, what a code fence holds, or the first balanced object; MISSING if none."""
    if text is None:
        return MISSING
    whole = text.strip()
    if (v := parse(whole)) is not MISSING:
        return v
    if "```" in whole:
        inside = whole.split("```")[1]
        inside = inside[4:] if inside[:4].lower() == "json" else inside
        if (v := parse(inside.strip())) is not MISSING:
            return v
    start = whole.find("{")
    while start >= 0:
        try:
            return json.JSONDecoder().raw_decode(whole, start)[0]
        except ValueError:
            start = whole.find("{", start + 1)
    return MISSING


def kind(value: Any) -> str:
    """Logical type name of a value."""
    if value is None:
        return "null"
    for k, name in ((bool, "boolean"), ((int, float), "number"), (str, "string"), (list, "array")):
        if isinstance(value, k):
            return name
    return "object"
