"""A tolerant HTML tree and a CSS selector engine, in the standard library only."""

from __future__ import annotations

import html as html_lib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from html.parser import HTMLParser

# HTML element classes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset(("script", "style"))
_CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul".split()
)
_SIBLINGS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table", "tbody", "thead", "tfoot"}),
             "td": ({"td", "th"}, {"tr"}), "th": ({"td", "th"}, {"tr"}), "option": ({"option"}, {"select", "datalist"})}


class Element:
    __slots__ = ("tag", "attrs", "parent", "children", "order", "index", "count")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Element | None, order: int) -> None:
        self.tag, self.attrs, self.parent, self.order = tag, attrs, parent, order
        self.children: list[Element | str] = []
        self.index = self.count = 0  # place among the parent's elements; number of own ones

    @property
    def elements(self) -> list[Element]:
        return [c for c in self.children if isinstance(c, Element)]

    def descendants(self) -> Iterator[Element]:
        stack = list(reversed(self.elements))
        while stack:
            e = stack.pop()
            yield e
            stack.extend(reversed(e.elements))

    def text(self) -> str:
        out, stack = [], [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack.extend(reversed(x.children))
        return "".join(out)

    def html(self) -> str:
        out: list[str] = []
        stack: list[Element | str | tuple[str]] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                out.append(x[0])
            elif isinstance(x, str):
                out.append(html_lib.escape(x, quote=False))
            else:
                attrs = "".join(f' {k}="{html_lib.escape(v)}"' for k, v in x.attrs.items())
                out.append(f"<{x.tag}{attrs}>")
                if x.tag not in VOID:
                    stack.append((f"</{x.tag}>",))
                    raw = x.tag in _RAW
                    stack.extend((c,) if raw and isinstance(c, str) else c for c in reversed(x.children))
        return "".join(out)

    def before(self) -> Element | None:
        if self.parent is None or not self.index:
            return None
        return self.parent.elements[self.index - 1]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Element("#document", {}, None, 0)
        self.open, self.count = [self.root], 0

    def _close(self, names: set[str] | frozenset[str], scope: set[str] | frozenset[str]) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag in names:
                del self.open[k:]
                return
            if self.open[k].tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in _CLOSES_P:
            self._close({"p"}, {"td", "th", "button", "body", "html"})
        if tag in _SIBLINGS:
            self._close(*_SIBLINGS[tag])
        self.count += 1
        parent = self.open[-1]
        unique: dict[str, str] = {}
        for k, v in attrs:
            unique.setdefault(k, v or "")
        e = Element(tag, unique, parent, self.count)
        e.index = parent.count
        parent.count += 1
        parent.children.append(e)
        if tag not in VOID:
            self.open.append(e)

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)

    def handle_endtag(self, tag: str) -> None:
        for k in range(len(self.open) - 1, 0, -1):
            if self.open[k].tag == tag:
                del self.open[k:]
                return

    def handle_data(self, data: str) -> None:
        self.open[-1].children.append(data)


def parse(text: str) -> Element:
    b = _Builder()
    b.feed(text)
    b.close()
    return b.root


# ------------------------------------------------------------------------ selectors


class SelectorError(ValueError):
    """The selector is malformed or uses what is not supported."""


class Simple:
    """One constraint of a compound: ``kind`` is tag, id, class, attr, not or a pseudo-class."""

    __slots__ = ("kind", "name", "op", "value", "flag")

    def __init__(self, kind: str, name: str = "", op: str = "", value: object = "", flag: str = "") -> None:
        self.kind, self.name, self.op, self.value, self.flag = kind, name, op, value, flag

    def matches(self, e: Element) -> bool:
        if self.kind == "tag":
            return self.name in ("*", e.tag)
        if self.kind == "id":
            return e.attrs.get("id") == self.name
        if self.kind == "class":
            return self.name in e.attrs.get("class", "").split()
        if self.kind == "attr":
            v = e.attrs.get(self.name)
            if v is None:
                return False
            want = self.value
            if self.flag == "i":
                v, want = v.lower(), want.lower()
            return {
                "": lambda: True, "=": lambda: v == want, "~=": lambda: want in v.split() and bool(want), "|=": lambda: v == want or v.startswith(want + "-"),
                "^=": lambda: bool(want) and v.startswith(want), "$=": lambda: bool(want) and v.endswith(want), "*=": lambda: bool(want) and want in v,
            }[self.op]()
        if self.kind == "not":
            return not any(chain_matches(c, e) for c in self.value)
        return _PSEUDO[self.name](e, self.value)


def _same_tag(e: Element) -> list[Element]:
    return [x for x in e.parent.elements if x.tag == e.tag]


def _nth(at: int, formula: tuple[int, int]) -> bool:
    a, b = formula
    return at == b if a == 0 else (at - b) % a == 0 and (at - b) // a >= 0


_PSEUDO: dict[str, Callable[[Element, object], bool]] = {
    "root": lambda e, _: e.parent is not None and e.parent.parent is None,
    "empty": lambda e, _: not any(isinstance(c, Element) or c for c in e.children),
    "first-child": lambda e, _: e.index == 0,
    "last-child": lambda e, _: e.index == len(e.parent.elements) - 1,
    "only-child": lambda e, _: len(e.parent.elements) == 1,
    "first-of-type": lambda e, _: _same_tag(e)[0] is e,
    "last-of-type": lambda e, _: _same_tag(e)[-1] is e,
    "only-of-type": lambda e, _: len(_same_tag(e)) == 1,
    "nth-child": lambda e, f: _nth(e.index + 1, f),
    "nth-last-child": lambda e, f: _nth(len(e.parent.elements) - e.index, f),
    "nth-of-type": lambda e, f: _nth(next(k for k, x in enumerate(_same_tag(e), 1) if x is e), f),
    "nth-last-of-type": lambda e, f: _nth(next(k for k, x in enumerate(reversed(_same_tag(e)), 1) if x is e), f),
}

#: A chain is its compounds and the combinators between them, from left to right.
Chain = tuple[list[list[Simple]], list[str]]
_NAME = re.compile(r"(?:[-\w]|[^\x00-\x7F]|\\.)+")


def _unescape(name: str) -> str:
    return re.sub(r"\\(.)", r"\1", name)


def _formula(text: str) -> tuple[int, int]:
    text = text.strip().lower().replace(" ", "")
    if text in ("odd", "even"):
        return 2, int(text == "odd")
    m = re.fullmatch(r"([+-]?\d*)n([+-]\d+)?", text)
    if m:
        a = m[1]
        return int(a + "1" if a in ("", "+", "-") else a), int(m[2] or 0)
    if re.fullmatch(r"[+-]?\d+", text):
        return 0, int(text)
    raise SelectorError(f"bad formula: {text}")


def _closing(text: str, at: int) -> int:
    depth, quote_ = 0, ""
    while at < len(text):
        c = text[at]
        if c == "\\":
            at += 1
        elif quote_:
            quote_ = "" if c == quote_ else quote_
        elif c in "\"'":
            quote_ = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
            if not depth:
                return at
        at += 1
    raise SelectorError(f"brackets do not close in {text!r}")


def _attribute(body: str) -> Simple:
    m = re.fullmatch(r"\s*([-\w:.]+)\s*(?:([~|^$*]?=)\s*(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|([^\s\"']+))\s*([iIsS])?\s*)?", body)
    if not m:
        raise SelectorError(f"bad attribute selector: [{body}]")
    value = next((x for x in m.group(3, 4, 5) if x is not None), "")
    return Simple("attr", m[1].lower(), m[2] or "", _unescape(value), (m[6] or "").lower())


@lru_cache(maxsize=512)
def compile_selector(text: str) -> tuple[Chain, ...]:
    """The comma-separated chains of a selector."""
    text = re.sub(r"/\*.*?\*/", " ", text, flags=re.S).strip()
    if not text:
        raise SelectorError("empty selector")
    chains: list[Chain] = []
    compounds: list[list[Simple]] = [[]]
    links: list[str] = []
    at = 0
    while at < len(text):
        c = text[at]
        if c.isspace() or c in ">+~,":
            m = re.compile(r"\s*([>+~,]?)\s*").match(text, at)
            at = m.end()
            if not compounds[-1] or (at >= len(text) and m[1]):
                raise SelectorError(f"misplaced {m[1] or 'space'!r} in {text!r}")
            if m[1] == ",":
                chains.append((compounds, links))
                compounds, links = [[]], []
            else:
                compounds.append([])
                links.append(m[1] or " ")
            continue
        own = compounds[-1]
        if c == "*":
            own.append(Simple("tag", "*"))
            at += 1
        elif c in "#.":
            m = _NAME.match(text, at + 1)
            if not m:
                raise SelectorError(f"a name expected at {at} in {text!r}")
            own.append(Simple("id" if c == "#" else "class", _unescape(m[0])))
            at = m.end()
        elif c == "[":
            end = _closing(text, at)
            own.append(_attribute(text[at + 1 : end]))
            at = end + 1
        elif c == ":":
            m = re.compile(r":([-a-zA-Z]+)").match(text, at)
            if not m:
                raise SelectorError(f"unknown pseudo at {at} in {text!r}")
            name, at = m[1].lower(), m.end()
            argument: object = ""
            if text[at : at + 1] == "(":
                end = _closing(text, at)
                inner, at = text[at + 1 : end], end + 1
                if name == "not":
                    own.append(Simple("not", "not", value=compile_selector(inner)))
                    continue
                argument = _formula(inner) if name.startswith("nth-") else inner
            if name not in _PSEUDO or name.startswith("nth-") != bool(argument):
                raise SelectorError(f"unsupported pseudo-class :{name}")
            own.append(Simple("pseudo", name, value=argument))
        else:
            m = _NAME.match(text, at)
            if not m or own:
                raise SelectorError(f"unexpected {c!r} in {text!r}")
            own.append(Simple("tag", _unescape(m[0]).lower()))
            at = m.end()
    if not compounds[-1]:
        raise SelectorError(f"incomplete selector {text!r}")
    chains.append((compounds, links))
    return tuple(chains)


def _related(e: Element, link: str) -> Iterator[Element]:
    """Elements on the left side of a combinator, nearest first."""
    if link in (" ", ">"):
        x = e.parent
        while x is not None and x.parent is not None:
            yield x
            if link == ">":
                return
            x = x.parent
    else:
        before = e.parent.elements[: e.index] if e.parent is not None else []
        yield from before[-1:] if link == "+" else reversed(before)


def chain_matches(chain: Chain, e: Element, k: int | None = None, known: dict[tuple[int, int], bool] | None = None) -> bool:
    """Whether an element matches a chain up to compound ``k``; ``known`` holds what was found for others of the page."""
    compounds, links = chain
    k = len(compounds) - 1 if k is None else k
    known = {} if known is None else known
    if (e.order, k) not in known:
        own = all(s.matches(e) for s in compounds[k])
        known[e.order, k] = own and (k == 0 or any(chain_matches(chain, x, k - 1, known) for x in _related(e, links[k - 1])))
    return known[e.order, k]


def select(root: Element, selector: str) -> list[Element]:
    """Matching elements in document order."""
    chains = [(c, {}) for c in compile_selector(selector)]
    return [e for e in root.descendants() if any(chain_matches(c, e, None, known) for c, known in chains)]


# ------------------------------------------------------------------ output suffixes


def split_output(expr: str) -> tuple[str, str, str]:
    """``selector, kind, attribute`` of an expression; kind is element, text or attr.

    The suffix starts at the last ``::`` outside quotes, brackets and comments.
    """
    at, depth, quote_, found = 0, 0, "", None
    while at < len(expr):
        c = expr[at]
        if c == "\\":
            at += 1
        elif quote_:
            quote_ = "" if c == quote_ else quote_
        elif expr.startswith("/*", at):
            at = expr.find("*/", at + 2) + 1
            if at <= 0:
                raise SelectorError("a comment does not end")
        elif c in "\"'":
            quote_ = c
        elif c in "([":
            depth += 1
        elif c in ")]":
            depth -= 1
        elif not depth and expr.startswith("::", at):
            found = at
            at += 1
        at += 1
    if found is None:
        return expr.strip(), "element", ""
    selector, suffix = expr[:found].strip(), expr[found + 2 :].strip()
    if suffix == "text":
        return selector, "text", ""
    m = re.fullmatch(r"attr\(\s*([^\s()]+)\s*\)", suffix)
    if not m:
        raise SelectorError(f"unknown output ::{suffix}")
    return selector, "attr", m[1].lower()


def output(e: Element, kind: str, attribute: str) -> object:
    if kind == "text":
        return e.text()
    if kind == "attr":
        return e.attrs.get(attribute)
    return {"html": e.html(), "text": e.text(), "attrs": dict(e.attrs)}
