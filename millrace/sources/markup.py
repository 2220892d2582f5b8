"""A small element tree over the standard HTML parser, for parsers that need structure rather than text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
#: An opening tag closes these open elements, up to the container.
CLOSES = {"td": ("td", "th"), "th": ("td", "th"), "tr": ("td", "th", "tr"), "li": ("li",), "p": ("p",), "option": ("option",)}
CONTAINERS = frozenset(("table", "ul", "ol", "div", "body", "html", "select"))


class Node:
    def __init__(self, name: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.name, self.attrs, self.parent, self.children = name, attrs, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children if isinstance(c, str) or c.name not in ("script", "style"))

    def squeezed(self) -> str:
        return re.sub(r"\s+", " ", self.text()).strip()

    def all(self, *names: str) -> Iterator[Node]:
        for c in self.children:
            if not isinstance(c, str):
                if c.name in names:
                    yield c
                yield from c.all(*names)

    def closest(self, *names: str) -> Node | None:
        node = self
        while node is not None and node.name not in names:
            node = node.parent
        return node

    def lines(self, whole: tuple[str, ...] = ()) -> list[str]:
        """A squeezed line for each text below, and one for each element named in whole."""
        out = []
        for c in self.children:
            if isinstance(c, str):
                out.append(re.sub(r"\s+", " ", c).strip())
            elif c.name in whole:
                out.append(c.squeezed())
            elif c.name not in ("script", "style"):
                out += c.lines(whole)
        return [x for x in out if x]


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        for name in CLOSES.get(tag, ()):
            node = self.at
            while node.parent is not None and node.name != name and node.name not in CONTAINERS:
                node = node.parent
            if node.name == name:
                self.at = node.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_endtag(self, tag: str) -> None:
        node = self.at
        while node.parent is not None and node.name != tag:
            node = node.parent
        if node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def tree(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root
