"""A small HTML tree: lenient parsing, selectors, paths, text, links and Markdown. Pure Python, used inside Arrow UDFs."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from html import escape
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

# Fixed values of HTML: elements without content, elements that one of their kind ends, and elements whose text isn't shown.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
CLOSES = {"p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "thead": {"tr", "td", "th"}, "tbody": {"thead", "tbody", "tr", "td", "th"}}
ENDS_P = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
SCOPES = {"li": {"ul", "ol"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table", "tr"}, "th": {"table", "tr"}}
HIDDEN = frozenset("script style noscript template head title".split())


@dataclass
class Node:
    """An element; children are nodes and texts."""

    tag: str
    attrs: dict[str, str] = field(default_factory=dict)
    children: list = field(default_factory=list)
    parent: "Node | None" = None

    def elements(self) -> list["Node"]:
        return [c for c in self.children if isinstance(c, Node)]

    def walk(self) -> Iterator["Node"]:
        """This element and all below it, in document order; no recursion, so depth doesn't matter."""
        work = [self]
        while work:
            n = work.pop()
            yield n
            work += [c for c in reversed(n.children) if isinstance(c, Node)]

    def text(self, hidden: frozenset = frozenset()) -> str:
        out, work = [], [self]
        while work:
            n = work.pop()
            if isinstance(n, str):
                out.append(n)
            elif n.tag not in hidden:
                work += reversed(n.children)
        return "".join(out)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def html(self) -> str:
        inner = "".join(escape(c, quote=False) if isinstance(c, str) else c.html() for c in self.children)
        head = "".join(f' {k}="{escape(v)}"' for k, v in self.attrs.items())
        return f"<{self.tag}{head}>" if self.tag in VOID else f"<{self.tag}{head}>{inner}</{self.tag}>"


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("#document")
        self.open = [self.root]

    def _close_to(self, tags: set[str], scope: set[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in tags:
                del self.open[k:]
                return
            if self.open[k].tag in scope or self.open[k].tag in ("table", "body", "html"):
                return

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in ENDS_P:
            self._close_to({"p"}, {"div", "article", "section", "li", "td", "th", "blockquote", "main"})
        if tag in CLOSES and tag != "p":
            self._close_to(CLOSES[tag], SCOPES.get(tag, set()))
        node = Node(tag, {k: v or "" for k, v in reversed(attrs)}, parent=self.open[-1])
        self.open[-1].children.append(node)
        if tag not in VOID:
            self.open.append(node)

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open[-1].tag == tag:
            self.open.pop()

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        kids = self.open[-1].children
        if kids and isinstance(kids[-1], str):
            kids[-1] += data
        else:
            kids.append(data)


def parse(html: str | None) -> Node:
    """The tree of any text; markup that doesn't close is closed."""
    b = _Builder()
    b.feed(html or "")
    b.close()
    return b.root


def squeezed(text: str) -> str:
    return " ".join(text.split())


# --- selectors -------------------------------------------------------------

_SIMPLE = re.compile(r"""\s*(?:(?P<tag>[a-zA-Z][\w-]*|\*)|\#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[\s*(?P<attr>[\w:-]+)\s*(?:(?P<op>[~|^$*]?=)\s*(?:"(?P<dq>[^"]*)"|'(?P<sq>[^']*)'|(?P<bare>[\w-]+))\s*)?\]|:(?P<pseudo>first-child|last-child|nth-child\(\s*\d+\s*\)|not\((?P<inner>[^()]+)\)))""")
Test = Callable[[Node], bool]


def _one(m: re.Match) -> Test:
    g = m.groupdict()
    if g["tag"]:
        return (lambda n: True) if g["tag"] == "*" else (lambda n, t=g["tag"].lower(): n.tag == t)
    if g["id"]:
        return lambda n, v=g["id"]: n.attrs.get("id") == v
    if g["cls"]:
        return lambda n, v=g["cls"]: v in n.classes()
    if g["attr"]:
        a, op = g["attr"].lower(), g["op"]
        v = next((g[k] for k in ("dq", "sq", "bare") if g[k] is not None), "")
        tests: dict[str | None, Callable[[str], bool]] = {None: lambda x: True, "=": lambda x: x == v, "~=": lambda x: v in x.split(), "|=": lambda x: x == v or x.startswith(v + "-"), "^=": lambda x: bool(v) and x.startswith(v), "$=": lambda x: bool(v) and x.endswith(v), "*=": lambda x: bool(v) and v in x}
        return lambda n: a in n.attrs and tests[op](n.attrs[a])
    if g["inner"]:
        inner = compound(g["inner"])
        return lambda n: not inner(n)
    p = g["pseudo"]
    if p == "last-child":
        return lambda n: n.parent is not None and n.parent.elements()[-1] is n
    k = 1 if p == "first-child" else int(re.search(r"\d+", p)[0])
    return lambda n: n.parent is not None and len(e := n.parent.elements()) >= k and e[k - 1] is n


def compound(text: str) -> Test:
    """A test for simple selectors written together."""
    at, tests = 0, []
    text = text.strip()
    while at < len(text):
        m = _SIMPLE.match(text, at)
        if not m or at and text[at].isspace():
            raise ValueError(f"selector not supported: {text!r}")
        tests.append(_one(m))
        at = m.end()
    if not tests:
        raise ValueError("empty selector")
    return lambda n: all(t(n) for t in tests)


def selector(text: str) -> Test:
    """A test for a selector list with descendant, child and sibling combinators; ValueError if it isn't supported."""
    lists = []
    for part in re.split(r",(?![^(\[]*[)\]])", text):
        tokens = [t for t in re.split(r"\s*([>+~])\s*(?![^\[(]*[\])])|\s+(?![^\[(]*[\])])", part.strip()) if t]
        steps = [compound(t) if t not in ">+~" else t for t in tokens]
        if not steps or isinstance(steps[-1], str) or isinstance(steps[0], str):
            raise ValueError(f"selector not supported: {text!r}")
        lists.append(steps)

    def holds(n: Node, steps: list) -> bool:
        if not steps[-1](n):
            return False
        rest = steps[:-1]
        if not rest:
            return True
        kind = rest.pop() if isinstance(rest[-1], str) else " "
        if kind == ">":
            return n.parent is not None and holds(n.parent, rest)
        if kind == " ":
            p = n.parent
            while p is not None:
                if holds(p, rest):
                    return True
                p = p.parent
            return False
        before = n.parent.elements() if n.parent else []
        before = before[: next((k for k, x in enumerate(before) if x is n), 0)]
        return any(holds(x, rest) for x in (before[-1:] if kind == "+" else before))

    return lambda n: any(holds(n, s) for s in lists)


def select(root: Node, test: Test) -> list[Node]:
    """Matching elements below ``root``, in document order."""
    return [n for n in root.walk() if n is not root and test(n)]


# --- paths -----------------------------------------------------------------

_STEP = re.compile(r"(//?)(@?[\w*:-]+(?:\(\))?)((?:\[[^\]]*\])*)")


def xpath(text: str) -> Callable[[Node], list | float | str]:
    """A compiled path of //, /, *, @a, text(), [n], [@a], [@a='v'] and [contains(@a,'v')], in count() or string(); ValueError beyond that."""
    whole = text.strip()
    m = re.fullmatch(r"(count|string)\((.*)\)", whole)
    inner = m[2] if m else whole
    steps, at = [], 0
    while at < len(inner):
        s = _STEP.match(inner, at)
        if not s:
            raise ValueError(f"path not supported: {text!r}")
        tests = []
        for c in re.findall(r"\[([^\]]*)\]", s[3]):
            if c.isdigit():
                tests.append(int(c))
            elif a := re.fullmatch(r"@([\w:-]+)(?:\s*=\s*['\"]([^'\"]*)['\"])?", c):
                tests.append(lambda n, k=a[1], v=a[2]: k in n.attrs and (v is None or n.attrs[k] == v))
            elif a := re.fullmatch(r"contains\(\s*@([\w:-]+)\s*,\s*['\"]([^'\"]*)['\"]\s*\)", c):
                tests.append(lambda n, k=a[1], v=a[2]: v in n.attrs.get(k, ""))
            else:
                raise ValueError(f"path not supported: {text!r}")
        steps.append((s[1], s[2], tests))
        at = s.end()
    if not steps:
        raise ValueError(f"path not supported: {text!r}")

    def run(root: Node) -> list | float | str:
        found: list = [root]
        for axis, name, tests in steps:
            new: list = []
            for n in found:
                if not isinstance(n, Node):
                    continue
                if name.startswith("@"):
                    new += [x.attrs[name[1:]] for x in (n.walk() if axis == "//" else [n]) if name[1:] in x.attrs]
                    continue
                if name == "text()":
                    new += [c for x in (n.walk() if axis == "//" else [n]) for c in x.children if isinstance(c, str)]
                    continue
                groups = [x.elements() for x in n.walk()] if axis == "//" else [n.elements()]
                for group in groups:
                    group = [x for x in group if name in ("*", x.tag)]
                    for t in tests:
                        group = group[t - 1 : t] if isinstance(t, int) else [x for x in group if t(x)]
                    new += group
            found = list({id(x): x for x in new}.values()) if all(isinstance(x, Node) for x in new) else new
        if m and m[1] == "count":
            return float(len(found))
        texts = [squeezed(x.text()) if isinstance(x, Node) else x.strip() for x in found]
        return (texts[0] if texts else "") if m else texts

    return run


# --- pages -----------------------------------------------------------------


def title(root: Node) -> str | None:
    """The first title, white space squeezed; None if there is none or it's blank."""
    return next((t for n in root.walk() if n.tag == "title" and (t := squeezed(n.text()))), None)


def visible_text(root: Node, most: int | None = None) -> str:
    """Shown text, white space squeezed; ``most`` letters at most where it's a signature."""
    text = squeezed(_spaced(root))
    return text if most is None else text[:most]


def _spaced(root: Node) -> str:
    out, work = [], [root]
    while work:
        n = work.pop()
        if isinstance(n, str):
            out.append(n)
        elif n.tag not in HIDDEN:
            block = n.tag in ENDS_P or n.tag in ("br", "li", "td", "th", "tr")
            if block:
                out.append(" ")
                work.append(" ")
            work += reversed(n.children)
    return "".join(out)


def absolute(base: str | None, link: str | None) -> str | None:
    """``link`` resolved against ``base``; unchanged if it is blank or can't be resolved."""
    if link is None or not link.strip():
        return link
    try:
        out = urljoin(base or "", link.strip())
        return out if urlsplit(out).scheme else link
    except ValueError:
        return link


def links(root: Node, base: str | None, same_host: bool = False) -> list[str]:
    """Absolute http(s) targets of anchors in order, each once, without fragments."""
    out: dict[str, None] = {}
    try:
        own = urlsplit(base or "").hostname
    except ValueError:
        own = None
    for n in root.walk():
        if n.tag == "a" and n.attrs.get("href", "").strip():
            url = (absolute(base, n.attrs["href"]) or "").split("#")[0]
            try:
                parts = urlsplit(url)
                if parts.scheme in ("http", "https") and parts.hostname and (not same_host or parts.hostname == own):
                    out.setdefault(url)
            except ValueError:
                continue
    return list(out)


def shape(root: Node) -> list[str]:
    """For each element its tag, sorted classes (build digests folded) and whether it has an id, in document order."""
    out = []
    for n in root.walk():
        if n.tag[0] != "#":
            kinds = "".join(f"{s}-#." if (s := hash_stem(c)) else f"{c}." for c in sorted(n.classes()))
            out.append(f"{n.tag}|{kinds}|{'#' * ('id' in n.attrs)}")
    return out


def hash_stem(name: str) -> str | None:
    """The stem of a class name that ends in a build digest: letters, a separator, six or more hex digits of which one is 0-9."""
    m = re.fullmatch(r"([A-Za-z]+)[-_](?=[0-9a-fA-F]*[0-9])[0-9a-fA-F]{6,}", name)
    return m[1] if m else None


# --- Markdown --------------------------------------------------------------

_SKIP = HIDDEN | {"nav", "footer", "header", "aside", "form", "button", "svg", "iframe", "select"}


def markdown(root: Node, skip: frozenset = frozenset(_SKIP)) -> str:
    """Headings, paragraphs, lists, quotes, code, tables, emphasis and links as Markdown."""
    text = _blocks(root, skip, 0)
    return re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip()


def _inline(node: Node, skip: frozenset) -> str:
    out = []
    for c in node.children:
        if isinstance(c, str):
            out.append(re.sub(r"\s+", " ", c))
            continue
        if c.tag in skip:
            continue
        inner = _inline(c, skip)
        body = inner.strip()
        if c.tag == "br":
            out.append("\n")
        elif c.tag in ("b", "strong") and body:
            out.append(f"**{body}**")
        elif c.tag in ("i", "em") and body:
            out.append(f"*{body}*")
        elif c.tag == "code" and body:
            out.append(f"`{c.text().strip()}`")
        elif c.tag == "a" and body and c.attrs.get("href"):
            out.append(f"[{body}]({c.attrs['href']})")
        elif c.tag == "img" and c.attrs.get("src"):
            out.append(f"![{c.attrs.get('alt', '')}]({c.attrs['src']})")
        else:
            out.append(inner)
    return "".join(out)


_BLOCK = ENDS_P | {"li", "tr", "td", "th", "body", "html", "tbody", "thead", "dt", "dd", "#document", "article", "figure"}


def _blocks(node: Node, skip: frozenset, depth: int) -> str:
    out, run = [], Node("span")

    def flush() -> None:
        text = _inline(run, skip).strip()
        run.children.clear()
        if text:
            out.append(f"\n\n{text}\n\n")

    for c in node.children:
        if isinstance(c, str) or c.tag not in _BLOCK and not any(x.tag in ENDS_P for x in c.walk()):
            if isinstance(c, str) or c.tag not in skip:
                run.children.append(c)
            continue
        flush()
        if c.tag in skip:
            continue
        if c.tag in ("h1", "h2", "h3", "h4", "h5", "h6"):
            text = squeezed(_inline(c, skip))
            out.append(f"\n\n{'#' * int(c.tag[1])} {text}\n\n" if text else "")
        elif c.tag in ("ul", "ol"):
            items = []
            for k, li in enumerate([x for x in c.elements() if x.tag == "li"]):
                body = re.sub(r"\n{2,}", "\n", _blocks(li, skip, depth + 1).strip())
                mark = f"{k + 1}. " if c.tag == "ol" else "- "
                items.append(mark + body.replace("\n", "\n  "))
            out.append("\n\n" + "\n".join(items) + "\n\n")
        elif c.tag == "pre":
            out.append(f"\n\n```\n{c.text().strip(chr(10))}\n```\n\n")
        elif c.tag == "blockquote":
            out.append("\n\n" + "\n".join(f"> {x}" for x in _blocks(c, skip, depth).strip().split("\n") if x.strip()) + "\n\n")
        elif c.tag == "table":
            out.append("\n\n" + table_markdown(c, skip) + "\n\n")
        elif c.tag == "hr":
            out.append("\n\n---\n\n")
        elif c.tag == "p" and not any(x.tag in ENDS_P for x in c.walk() if x is not c):
            out.append(f"\n\n{_inline(c, skip).strip()}\n\n")
        else:
            out.append("\n\n" + _blocks(c, skip, depth) + "\n\n")
    flush()
    return "".join(out)


def table_markdown(table: Node, skip: frozenset = frozenset(_SKIP)) -> str:
    """The first row as header, short rows padded, bars escaped."""
    rows = [[squeezed(_inline(c, skip)).replace("|", "\\|") for c in r.elements() if c.tag in ("td", "th")] for r in table.walk() if r.tag == "tr"]
    rows = [r for r in rows if r]
    if not rows:
        return ""
    n = max(map(len, rows))
    lines = ["| " + " | ".join(r + [""] * (n - len(r))) + " |" for r in rows]
    return "\n".join([lines[0], "|" + " --- |" * n, *lines[1:]])
