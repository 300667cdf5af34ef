"""Declarative extraction: rule sets over HTML, text and JSON with transforms and a status for each field."""

from __future__ import annotations

import json
import re
from typing import Any

from marlstone.functions import dom, jsonv

KINDS = ("css", "regex", "json", "xpath", "const", "each")


def blank(v: Any) -> bool:
    """Null, white space or an empty list."""
    return v is None or isinstance(v, str) and not v.strip() or isinstance(v, list) and not v


def to_number(v: Any) -> float | int | None:
    """The first number in a text, commas as grouping; a sign counts only right before it. Numbers pass, booleans don't."""
    if isinstance(v, bool) or v is None:
        return None
    if isinstance(v, (int, float)):
        return v
    m = re.search(r"(?<![\w.])[-+]?\d[\d,]*(?:\.\d+)?|\d[\d,]*(?:\.\d+)?", str(v))
    return float(m[0].replace(",", "")) if m else None


def transform(v: Any, spec: dict[str, Any], base: str | None) -> Any:
    """One transform; lists item by item, but for default and pick, which take the list whole."""
    kind = spec["kind"]
    if kind == "default":
        return spec["value"] if blank(v) else v
    if isinstance(v, list):
        return [transform(x, spec, base) for x in v]
    if kind == "to_number":
        return to_number(v)
    if kind == "to_int":
        n = to_number(v)
        return int(n) if n is not None and abs(n) < 2**63 else None
    if kind == "to_bool":
        if isinstance(v, (int, float)):
            return bool(v)
        low = str(v).strip().lower() if v is not None else ""
        return True if low in ("true", "yes", "y", "1", "on") else False if low in ("false", "no", "n", "0", "off") else None
    if not isinstance(v, str):
        return v
    if kind in ("trim", "lower", "upper"):
        return {"trim": str.strip, "lower": str.lower, "upper": str.upper}[kind](v)
    if kind == "regex_replace":
        return re.sub(spec["pattern"], re.sub(r"\$(\d+)", r"\\\1", spec["with"]), v)
    if kind == "split":
        parts = [p.strip() for p in v.split(spec["sep"])]
        k = spec.get("index")
        return parts if k is None else parts[k] if -len(parts) <= k < len(parts) else None
    if kind == "to_markdown":
        return dom.markdown(dom.parse(v))
    if kind == "url_absolute":
        return dom.absolute(base, v)
    raise ValueError(f"unknown transform {kind!r}")


class RuleSet:
    """Field -> {rule, transforms}; checked and compiled once, then run over documents."""

    def __init__(self, rules: dict[str, dict[str, Any]], inside: bool = False):
        if not rules:
            raise ValueError("a rule set needs fields")
        self.rules = rules
        self.run: dict[str, Any] = {}
        for name, r in rules.items():
            kind = r.get("kind")
            if kind not in KINDS or inside and kind in ("json", "xpath"):
                raise ValueError(f"{name}: rule {kind!r} isn't known here")
            for t in r.get("transforms", ()):
                transform(None, t, None)
            self.run[name] = getattr(self, f"_{kind}")(r)
        if not inside and all(r["kind"] == "const" for r in rules.values()):
            raise ValueError("a rule set of constants extracts nothing")

    def _css(self, r):
        test, attr, html, every = dom.selector(r["selector"]), r.get("attr"), r.get("html"), r.get("all")

        def go(doc, root):
            found = dom.select(root(), test)
            values = [n.attrs.get(attr) if attr else "".join(c if isinstance(c, str) else c.html() for c in n.children) if html else n.text().strip() for n in found]
            values = [v for v in values if v is not None]
            return (values if every else values[0] if values else None), bool(values)

        return go

    def _regex(self, r):
        p, group = re.compile(r["pattern"]), r.get("group", 0)
        if group > p.groups:
            raise ValueError("no such group")
        return lambda doc, root: (m[group], True) if (m := p.search(doc)) else (None, False)

    def _json(self, r):
        if r["pointer"] and not r["pointer"].startswith("/"):
            raise ValueError("a pointer starts with /")
        keys = [k.replace("~1", "/").replace("~0", "~") for k in r["pointer"].split("/")[1:]]

        def go(doc, root):
            v = json.loads(doc)
            for k in keys:
                if isinstance(v, dict) and k in v:
                    v = v[k]
                elif isinstance(v, list) and k.isdigit() and int(k) < len(v):
                    v = v[int(k)]
                else:
                    return None, False
            return v, True

        return go

    def _xpath(self, r):
        run, every = dom.xpath(r["path"]), r.get("all")

        def go(doc, root):
            v = run(root())
            if not isinstance(v, list):
                return v, True
            return (v if every else v[0] if v else None), bool(v)

        return go

    def _const(self, r):
        return lambda doc, root: (r["value"], True)

    def _each(self, r):
        test, inner, box = dom.selector(r["selector"]), RuleSet(r["fields"], True), dom.selector(r["container"]) if r.get("container") else None

        def go(doc, root):
            top = root()
            tops = dom.select(top, box) if box else [top]
            items = [n for t in tops for n in dom.select(t, test)]
            return [inner.item(n) for n in items], bool(items) if not (box and tops and not items) else None

        return go

    def item(self, node: dom.Node) -> dict[str, Any]:
        """Fields of one container; a field that finds nothing is null."""
        return {name: self._value(name, node.html(), lambda: node)[0] for name in self.run}

    def _value(self, name: str, doc: str, root) -> tuple[Any, str]:
        try:
            v, found = self.run[name](doc, root)
        except (ValueError, RecursionError):
            return None, "error"
        for t in self.rules[name].get("transforms", ()):
            v = transform(v, t, self.base) if hasattr(self, "base") else transform(v, t, None)
        if found is None:
            return v, "container_empty"
        return v, "empty" if blank(v) or not found and self.rules[name]["kind"] != "const" and not self.rules[name].get("transforms") else "matched"

    def extract(self, doc: str | None, base: str | None = None) -> tuple[dict[str, Any], dict[str, str], dict[str, dict[str, int]]]:
        """(values, status of each field, counts of each inner field of ``each``)."""
        self.base, tree = base, []

        def root() -> dom.Node:
            if not tree:
                tree.append(dom.parse(doc))
            return tree[0]

        values, status, inner = {}, {}, {}
        for name in self.run:
            values[name], status[name] = self._value(name, doc or "", root)
            if self.rules[name]["kind"] == "each" and isinstance(values[name], list):
                for f in self.rules[name]["fields"]:
                    got = [x.get(f) for x in values[name]]
                    inner[f"{name}.{f}"] = {"items": len(got), "matched": sum(not blank(x) for x in got)}
        return values, status, inner


def induce(pages: list[str], least: float = 0.5) -> dict[str, Any] | None:
    """An ``each`` rule for the container that repeats most over pages of one template; None if nothing repeats.

    Containers are (tag, class) pairs met twice or more on a share of pages;
    slots are (tag, class) pairs below them with text, of at least two
    different values and enough support. The most slots win, then the most items.
    """
    trees = [dom.parse(p) for p in pages]
    best: tuple | None = None
    names = {(n.tag, c) for t in trees for n in t.walk() for c in n.classes()}
    for tag, cls in sorted(names):
        items = [[n for n in t.walk() if n.tag == tag and cls in n.classes()] for t in trees]
        if sum(len(x) >= 2 for x in items) < max(1, least * len(trees)):
            continue
        flat = [n for x in items for n in x]
        slots: dict[tuple[str, str], list[str]] = {}
        for n in flat:
            seen = set()
            for m in n.walk():
                k = (m.tag, m.classes()[0] if m.classes() else "")
                if m is not n and k not in seen and not m.elements() and (text := dom.squeezed(m.text())):
                    seen.add(k)
                    slots.setdefault(k, []).append(text)
        good = {k: v for k, v in slots.items() if len(v) >= least * len(flat) and len(set(v)) >= 2}
        if good and (best is None or (len(good), len(flat)) > best[0]):
            best = ((len(good), len(flat)), tag, cls, good)
    if best is None:
        return None
    _, tag, cls, good = best
    fields: dict[str, Any] = {}
    for t, c in sorted(good):
        name = re.sub(r"\W+", "_", c or t)
        while name in fields:
            name += "_2"
        fields[name] = {"kind": "css", "selector": f"{t}.{c}" if c else t}
    return {"items": {"kind": "each", "selector": f"{tag}.{cls}", "fields": fields}}


def draft_accepted(held: int, fields: int, rejections: list[str]) -> bool:
    """More than half of the fields hold and nothing rejects the draft."""
    return not rejections and 2 * held > fields


def values_text(values: dict[str, Any]) -> str:
    return jsonv.canonical(values)
