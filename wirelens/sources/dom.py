"""A small tree of a page's elements with the selectors that the sources need. p and li end where the next one begins."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from html.entities import html5
from html.parser import HTMLParser

import pyarrow as pa

#: Pages whose values are made before they become Arrow's.
PAGES = 64

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
CLOSES = {"p": ("p",), "li": ("li",)}
_PART = re.compile(r"(?P<tag>^[a-z][a-z0-9]*)|#(?P<id>[\w-]+)|\.(?P<cls>[\w-]+)|\[(?P<name>[\w-]+)(?:(?P<op>\^?=)\"(?P<value>[^\"]*)\")?\]")


class Node:
    def __init__(self, tag: str, attributes: dict[str, str | None], parent: Node | None):
        self.tag, self.attributes, self.parent, self.children = tag, attributes, parent, []

    def walk(self) -> Iterator[Node]:
        for child in self.children:
            if isinstance(child, Node):
                yield child
                yield from child.walk()

    def strings(self) -> Iterator[str]:
        for child in self.children:
            if isinstance(child, str):
                yield child
            elif child.tag not in ("script", "style"):
                yield from child.strings()

    def text(self) -> str:
        """The text of all parts, each stripped, joined by spaces."""
        return " ".join(" ".join(s.split()) for s in self.strings() if s.strip())

    def first_string(self) -> str:
        """The first text directly inside."""
        return next((" ".join(c.split()) for c in self.children if isinstance(c, str) and c.strip()), "")

    def find_all(self, tags: tuple[str, ...], direct: bool = False) -> list[Node]:
        nodes = [c for c in self.children if isinstance(c, Node)] if direct else self.walk()
        return [n for n in nodes if n.tag in tags]

    def siblings_before(self) -> list[Node]:
        own = [c for c in self.parent.children if isinstance(c, Node)] if self.parent else []
        return own[: own.index(self)] if self in own else []

    def matches(self, simple: str) -> bool:
        at = 0
        for m in _PART.finditer(simple):
            at = m.end()
            if m["tag"] and self.tag != m["tag"]:
                return False
            if m["id"] and self.attributes.get("id") != m["id"]:
                return False
            if m["cls"] and m["cls"] not in (self.attributes.get("class") or "").split():
                return False
            if m["name"]:
                value = self.attributes.get(m["name"])
                if m["name"] not in self.attributes or m["op"] == "=" and value != m["value"]:
                    return False
                if m["op"] == "^=" and not any(v.startswith(m["value"]) for v in (value or "").split() or [""]):
                    return False
        if at != len(simple):
            raise ValueError(f"unknown selector {simple!r}")
        return True

    def fits(self, parts: list[str]) -> bool:
        """Whether this node and what is around it fit a selector's parts, read from the last one back."""
        if not self.matches(parts[-1]):
            return False
        if len(parts) == 1:
            return True
        sign, rest = (parts[-2], parts[:-2]) if parts[-2] in (">", "~") else (" ", parts[:-1])
        if sign == ">":
            return self.parent is not None and self.parent.fits(rest)
        if sign == "~":
            return any(s.fits(rest) for s in self.siblings_before())
        node = self.parent
        while node is not None:
            if node.fits(rest):
                return True
            node = node.parent
        return False

    def select_all(self, selector: str) -> list[Node]:
        options = [option.split() for option in selector.split(",")]
        return [n for n in self.walk() if any(n.fits(o) for o in options)]

    def select(self, selector: str) -> Node | None:
        options = [option.split() for option in selector.split(",")]
        return next((n for n in self.walk() if any(n.fits(o) for o in options)), None)

    def ancestor(self, selector: str) -> Node | None:
        node = self.parent
        while node is not None and not node.matches(selector):
            node = node.parent
        return node

    def remove(self) -> None:
        if self.parent and self in self.parent.children:
            self.parent.children.remove(self)


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("", {}, None)
        self.nodes = [self.root]

    def handle_starttag(self, tag, attrs):
        if tag in CLOSES and self.at.tag in CLOSES[tag]:
            self.at = self.at.parent
        node = Node(tag, dict(attrs), self.at)
        self.nodes.append(node)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.nodes.append(Node(tag, dict(attrs), self.at))
        self.at.children.append(self.nodes[-1])

    def handle_endtag(self, tag):
        node = self.at
        while node.parent is not None and node.tag != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


_REFERENCE = re.compile(r"&(?:#(?:[0-9]+|[xX][0-9a-fA-F]+);|([A-Za-z][A-Za-z0-9]*;))?")


def ended_references(html: str) -> str:
    """html in which only character references with their semicolon are such: any other ampersand stands for itself."""
    return _REFERENCE.sub(lambda m: m[0] if len(m[0]) > 1 and (m[1] is None or m[1] in html5) else "&amp;" + m[0][1:], html)


@contextmanager
def parsed(html: str) -> Iterator[Node]:
    """A page's tree, taken apart afterwards: its nodes refer to each other, and would stay until they are collected."""
    builder = _Builder()
    try:
        builder.feed(html)
        builder.close()
        yield builder.root
    finally:
        for node in builder.nodes:
            node.parent, node.children = None, []
        builder.root = builder.at = None


def of_pages(value: Callable, kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """value of each row of columns, a few pages at a time, so that neither pages nor values are held as objects for a
    whole batch."""
    made = [pa.array([value(*row) for row in zip(*(c.slice(at, PAGES).to_pylist() for c in columns), strict=True)], kind) for at in range(0, len(columns[0]), PAGES)]
    return pa.concat_arrays(made) if made else pa.array([], kind)
