"""A small lenient HTML reader for use inside tasks.

It knows the selectors the page operators need: tag, ``.class``, ``#id``, ``tag.class`` and
descendants of those.  A paragraph ends where the next block begins.
"""

from __future__ import annotations

import re
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "wbr"}
_ENDS_PARAGRAPH = {
    "p", "div", "ul", "ol", "li", "table", "article", "section", "header", "footer", "nav",
    "aside", "h1", "h2", "h3", "h4", "h5", "h6", "pre", "blockquote", "form", "hr", "main",
}


class Node:
    """An element with its children; text children are plain strings."""

    __slots__ = ("tag", "attrs", "children", "parent", "gone")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []
        self.gone = False

    def walk(self):
        """Elements below this one in document order."""
        stack = [c for c in reversed(self.children)]
        while stack:
            node = stack.pop()
            if isinstance(node, str) or node.gone:
                continue
            yield node
            stack.extend(reversed(node.children))

    def matches(self, simple: str) -> bool:
        tag, marks = re.match(r"([\w*-]*)(.*)", simple).groups()
        if tag not in ("", "*", self.tag):
            return False
        classes = self.attrs.get("class", "").split()
        return all(
            name in classes if kind == "." else self.attrs.get("id") == name
            for kind, name in re.findall(r"([.#])([^.#]+)", marks)
        )


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root", {}, None)

    def _close(self, tag: str, stop: set[str]) -> None:
        node = self.at
        while node.parent is not None and node.tag not in stop:
            if node.tag == tag:
                self.at = node.parent
                return
            node = node.parent

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in _ENDS_PARAGRAPH:
            self._close("p", {"div", "td", "article", "section", "body"})
        if tag == "li":
            self._close("li", {"ul", "ol"})
        node = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(node)
        if tag not in _VOID:
            self.at = node

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in _VOID:
            self._close(tag, set())

    def handle_endtag(self, tag: str) -> None:
        self._close(tag, set())

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def select(root: Node, selector: str) -> list[Node]:
    """Elements below the root that a selector names, in document order."""
    found: list[Node] = []
    for option in selector.split(","):
        steps = option.split()
        if not steps:
            continue
        for node in root.walk():
            if not node.matches(steps[-1]):
                continue
            left, above = steps[:-1], node.parent
            while left and above is not None:
                if above.matches(left[-1]):
                    left = left[:-1]
                above = above.parent
            if not left:
                found.append(node)
    return found


def text_of(node: Node, breaks: bool = False) -> str:
    """All text below an element; with breaks, ``<br>`` and paragraph ends become newlines."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item)
        elif not item.gone:
            if breaks and item.tag == "br":
                parts.append("\n")
            if breaks and item.tag == "p":
                stack.append("\n\n")
            stack.extend(reversed(item.children))
    return "".join(parts)


def stripped_strings(node: Node) -> str:
    """Text below an element with the ends of every text run stripped."""
    parts: list[str] = []
    stack: list[Node | str] = list(reversed(node.children))
    while stack:
        item = stack.pop()
        if isinstance(item, str):
            parts.append(item.strip())
        elif not item.gone:
            stack.extend(reversed(item.children))
    return "".join(parts)
