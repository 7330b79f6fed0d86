"""Selector extraction on one HTML page: the per-row helper of ``sources.html``.

A forgiving tree over the standard parser and the selector forms card configs use:
``tag``, ``.class``, ``#id``, ``[attr]``, ``[attr="v"]``, their compounds, and descendants.
"""

from __future__ import annotations

import re
from functools import lru_cache
from html.parser import HTMLParser

_VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
_CLOSES_SELF = {"li", "p", "option", "tr", "td", "th", "dt", "dd"}


class Node:
    __slots__ = ("tag", "attrs", "children", "parent")

    def __init__(self, tag: str, attrs: dict[str, str], parent: Node | None) -> None:
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.children: list[Node | str] = []

    def _below(self):
        """Nodes and texts in document order; a stack, as pages may nest to any depth."""
        stack = [iter(self.children)]
        while stack:
            child = next(stack[-1], None)
            if child is None:
                stack.pop()
                continue
            yield child
            if isinstance(child, Node):
                stack.append(iter(child.children))

    def walk(self):
        return (child for child in self._below() if isinstance(child, Node))

    def text(self, separator: str = "", strip: bool = False) -> str:
        texts = (child for child in self._below() if not isinstance(child, Node))
        return separator.join(t.strip() if strip else t for t in texts if not strip or t.strip())


class _Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.open = Node("", {}, None)

    def handle_starttag(self, tag, attrs):
        if tag in _CLOSES_SELF and self.open.tag == tag:
            self.open = self.open.parent
        node = Node(tag, {k: v or "" for k, v in attrs}, self.open)
        self.open.children.append(node)
        if tag not in _VOID:
            self.open = node

    def handle_endtag(self, tag):
        node = self.open
        while node is not None and node.tag != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.open = node.parent

    def handle_data(self, data):
        self.open.children.append(data)


def parse(html: str) -> Node:
    builder = _Builder()
    builder.feed(html)
    builder.close()
    return builder.root


_SIMPLE = re.compile(r"""([\w-]+)|\.([\w-]+)|\#([\w-]+)|\[\s*([\w-]+)\s*(?:=\s*["']?([^"'\]]*)["']?\s*)?\]""")


@lru_cache(maxsize=256)
def _steps(selector: str) -> list[list[tuple]]:
    steps = []
    for part in re.findall(r"""(?:\[[^\]]*\]|[^\s\[])+""", selector):
        if "".join(m.group(0) for m in _SIMPLE.finditer(part)) != part:
            return []  # a form outside the subset selects nothing
        steps.append([m.groups() for m in _SIMPLE.finditer(part)])
    return steps


def _fits(node: Node, tests: list[tuple]) -> bool:
    for tag, cls, ident, attr, value in tests:
        if tag and node.tag != tag.lower():
            return False
        if cls and cls not in node.attrs.get("class", "").split():
            return False
        if ident and node.attrs.get("id") != ident:
            return False
        if attr and (attr not in node.attrs or (value is not None and node.attrs[attr] != value)):
            return False
    return True


def _chain_fits(node: Node, steps: list[list[tuple]]) -> bool:
    if not steps or not _fits(node, steps[-1]):
        return False
    ancestor = node.parent
    for tests in reversed(steps[:-1]):
        while ancestor is not None and not _fits(ancestor, tests):
            ancestor = ancestor.parent
        if ancestor is None:
            return False
        ancestor = ancestor.parent
    return True


def select(node: Node, selector: str) -> list[Node]:
    steps = _steps(selector)
    return [n for n in node.walk() if _chain_fits(n, steps)]


def value_of(node: Node, spec: str) -> str | None:
    """Text of the first match of ``css``, or the attribute of ``css@attr``; '@attr' reads the node."""
    css, _, attr = spec.partition("@")
    found = [node] if not css.strip() else select(node, css.strip())[:1]
    if not found:
        return None
    value = found[0].attrs.get(attr.strip()) if attr else found[0].text()
    return (value or "").strip() or None


def extract(html: str, config: dict[str, list[str]]) -> list[dict[str, str | None]]:
    """Field values per item; every entry lists selectors in order, the first non-empty wins."""
    tree = parse(html)
    items: list[Node] = []
    for selector in config["item"]:
        items = items or select(tree, selector)
    fields = [f for f in config if f != "item"]
    rows = []
    for item in items:
        row = {}
        for field in fields:
            row[field] = next((v for v in (value_of(item, s) for s in config[field]) if v), None)
        rows.append(row)
    return rows


def balanced_object(text: str, start: int) -> str | None:
    """The ``{...}`` starting at ``start``, braces inside string literals ignored."""
    depth = 0
    for token in re.finditer(r'"(?:[^"\\]|\\.)*"|[{}]', text[start:]):
        if token.group() == "{":
            depth += 1
        elif token.group() == "}":
            depth -= 1
            if depth == 0:
                return text[start : start + token.end()]
        if depth == 0:
            return None
    return None
