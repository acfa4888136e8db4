"""A small tolerant HTML tree and a subset of CSS selectors, for use inside Arrow stages."""

from __future__ import annotations

import html as entities
import re

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([^\s=\"'<>/]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
# Fixed values of HTML: elements without content, with raw text, and what a start tag closes.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(["script", "style", "textarea", "title"])
_BLOCKS = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
_CLOSES = {"li": ("li", ("ul", "ol")), "option": ("option", ("select",)), "tr": ("tr", ("table",)), "td": ("td", ("tr",)), "th": ("th", ("tr",)), "dt": ("dt", ("dl",)), "dd": ("dd", ("dl",))}


class Node:
    """An element: tag, attributes (lower-case names), parent, and children (nodes and text)."""

    __slots__ = ("tag", "attrs", "parent", "children")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None):
        self.tag, self.attrs, self.parent, self.children = tag, attrs, parent, []

    def walk(self):
        """Elements below this one, in document order."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            n = stack.pop()
            yield n
            stack.extend(c for c in reversed(n.children) if isinstance(c, Node))

    def strings(self, skip: frozenset[str] = frozenset()):
        """Text pieces below this element; raw text of scripts and styles is never among them."""
        for c in self.children:
            if isinstance(c, str):
                if self.tag not in ("script", "style"):
                    yield c
            elif c.tag not in skip:
                yield from c.strings(skip)

    def text(self, separator: str = "", skip: frozenset[str] = frozenset()) -> str:
        """Stripped non-empty text pieces, joined."""
        return separator.join(s for s in (x.strip() for x in self.strings(skip)) if s)

    def inside(self, tag: str) -> bool:
        """Whether an ancestor has this tag."""
        p = self.parent
        while p is not None:
            if p.tag == tag:
                return True
            p = p.parent
        return False


def parse(source: str) -> Node:
    """The tree of a document under a node without tag; unclosed and misnested tags are tolerated."""
    root = Node("", {}, None)
    at, here, pos = root, root, 0

    def add_text(raw: str, decode: bool = True) -> None:
        if raw:
            here.children.append(entities.unescape(raw) if decode else raw)

    while True:
        m = _TOKEN.search(source, pos)
        if not m:
            add_text(source[pos:])
            return root
        add_text(source[pos : m.start()])
        pos = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            at = here
            while at is not None and at.tag != tag:
                at = at.parent
            if at is not None and at.parent is not None:
                here = at.parent
            continue
        if tag in _BLOCKS and here.tag == "p":
            here = here.parent
        elif tag in _CLOSES:
            close, stop = _CLOSES[tag]
            at = here
            while at is not None and at.tag != close and at.tag not in stop:
                at = at.parent
            if at is not None and at.tag == close:
                here = at.parent
        attrs: dict[str, str] = {}
        for a in _ATTRIBUTE.finditer(m[3]):
            value = a[2] or ""
            if value[:1] in "\"'":
                value = value[1:-1]
            attrs.setdefault(a[1].lower(), entities.unescape(value))
        node = Node(tag, attrs, here)
        here.children.append(node)
        if tag in VOID or m[3].rstrip().endswith("/") and tag not in _BLOCKS and tag not in RAW and tag != "a":
            continue
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(source, pos)
            raw = source[pos : end.start()] if end else source[pos:]
            if raw:
                node.children.append(raw if tag in ("script", "style") else entities.unescape(raw))
            pos = end.end() if end else len(source)
            continue
        here = node


_PART = re.compile(r"(\*|[a-zA-Z][\w-]*)?((?:[#.][\w-]+|\[[^\]]+\])*)")
_PIECE = re.compile(r"([#.])([\w-]+)|\[\s*([\w:-]+)\s*(?:([~|^$*]?=)\s*(\"[^\"]*\"|'[^']*'|[^\]\s]+))?\s*\]")


def compile_selector(selector: str) -> list[list[tuple[str, str, list[tuple]]]]:
    """A selector as alternatives of (combinator, tag, tests). ValueError if it is outside the subset.

    The subset: tag, ``*``, ``#id``, ``.class``, ``[attr]`` with ``= ~= |= ^= $= *=``, descendant, ``>`` and ``,``.
    """
    out = []
    for one in re.split(r",(?![^\[]*\])", selector):
        words = re.findall(r">|(?:\[[^\]]*\]|[^\s>])+", one.strip())
        if not words:
            raise ValueError(f"empty selector: {selector!r}")
        chain, combinator = [], " "
        for w in words:
            if w == ">":
                if not chain or combinator == ">":
                    raise ValueError(f"bad selector: {selector!r}")
                combinator = ">"
                continue
            m = _PART.fullmatch(w)
            if not m or not w:
                raise ValueError(f"bad selector: {selector!r}")
            tests = []
            for p in _PIECE.finditer(m[2] or ""):
                if p[1] == "#":
                    tests.append(("id", "=", p[2]))
                elif p[1] == ".":
                    tests.append(("class", "~=", p[2]))
                else:
                    value = p[5]
                    tests.append((p[3].lower(), p[4] or "", value.strip("\"'") if value else ""))
            chain.append((combinator, (m[1] or "*").lower(), tests))
            combinator = " "
        if combinator == ">":
            raise ValueError(f"bad selector: {selector!r}")
        out.append(chain)
    return out


def _fits(n: Node, tag: str, tests: list[tuple]) -> bool:
    if tag != "*" and n.tag != tag:
        return False
    for name, op, want in tests:
        have = n.attrs.get(name)
        if have is None:
            return False
        ok = {
            "": True, "=": have == want, "~=": want in have.split(), "|=": have == want or have.startswith(want + "-"),
            "^=": bool(want) and have.startswith(want), "$=": bool(want) and have.endswith(want), "*=": bool(want) and want in have,
        }[op]
        if not ok:
            return False
    return True


def _matches(n: Node | None, chain: list[tuple], i: int) -> bool:
    if n is None or not _fits(n, chain[i][1], chain[i][2]):
        return False
    if i == 0:
        return True
    if chain[i][0] == ">":
        return _matches(n.parent, chain, i - 1)
    p = n.parent
    while p is not None:
        if _matches(p, chain, i - 1):
            return True
        p = p.parent
    return False


def count_selected(root: Node, selector: list[list[tuple]]) -> int:
    """Elements that any alternative of a compiled selector matches."""
    return sum(any(_matches(n, chain, len(chain) - 1) for chain in selector) for n in root.walk())
