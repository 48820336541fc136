"""HTML text to tokens and trees.

The grammar is deliberately small: no implied end tags, six entities, attributes without quotes stop at a slash, any
tag may close itself, and stray end tags are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style"))
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&apos;", "'"), ("&nbsp;", " "), ("&amp;", "&"))
_NAME = re.compile(r"(?:[^\W_]|[-:])+")
_ATTR = re.compile(r"\s*(?:(?P<end>>)|(?P<close>/>?)|(?P<name>[^\s=>/<]+)(?:\s*(?P<eq>=)\s*(?:\"(?P<dq>[^\"]*)\"?|'(?P<sq>[^']*)'?|(?P<bare>[^\s>/]*)))?|(?P<stray>.)|$)", re.S)
_END = re.compile(r"</([^\s>]*)[^>]*>?")


def unescape(s: str) -> str:
    if "&" in s:
        for a, b in _ENTITIES:
            s = s.replace(a, b)
    return s


@dataclass
class Token:
    kind: str  # start, end, text, comment, doctype
    name: str = ""
    data: str = ""
    attrs: dict[str, str] = field(default_factory=dict)
    closed: bool = False


def tokenize(html: str | None) -> Iterator[Token]:
    s = html or ""
    at, n = 0, len(s)
    low: str | None = None
    while at < n:
        if s[at] != "<":
            end = s.find("<", at)
            end = n if end < 0 else end
            yield Token("text", data=unescape(s[at:end]))
            at = end
        elif s.startswith("<!--", at):
            end = s.find("-->", at + 4)
            yield Token("comment", data=s[at + 4 :] if end < 0 else s[at + 4 : end])
            at = n if end < 0 else end + 3
        elif s[at : at + 9].lower() == "<!doctype":
            end = s.find(">", at)
            yield Token("doctype", name=re.sub("(?i)<!doctype", "", s[at:] if end < 0 else s[at:end]).strip())
            at = n if end < 0 else end + 1
        elif s.startswith("/", at + 1):
            m = _END.match(s, at)
            yield Token("end", name=m[1].lower())
            at = m.end()
        elif s[at + 1 : at + 2].isalpha():
            tag, at = _start(s, at + 1)
            yield tag
            if tag.name in RAW and not tag.closed:
                low = low or s.lower()
                if len(low) != n:  # lower case that changes lengths can't give offsets
                    m = re.compile("</" + re.escape(tag.name), re.I).search(s, at)
                    end = m.start() if m else -1
                else:
                    end = low.find("</" + tag.name, at)
                end = n if end < 0 else end
                yield Token("text", data=s[at:end])
                at = end
        else:
            yield Token("text", data="<")
            at += 1


def _start(s: str, at: int) -> tuple[Token, int]:
    m = _NAME.match(s, at)
    tag = Token("start", name=m[0].lower())
    at = m.end()
    while True:
        m = _ATTR.match(s, at)
        at = m.end()
        if m["name"]:
            value = next((m[g] for g in ("dq", "sq", "bare") if m[g] is not None), "")
            tag.attrs[m["name"].lower()] = unescape(value)
        elif not m["stray"]:
            tag.closed = m["close"] is not None
            return tag, at


class Node:
    """kind: document, element, text or comment."""

    __slots__ = ("attrs", "children", "data", "kind", "parent", "tag")

    def __init__(self, kind: str, tag: str = "", data: str = "", attrs: dict[str, str] | None = None) -> None:
        self.kind, self.tag, self.data = kind, tag, data
        self.attrs: dict[str, str] = attrs if attrs is not None else {}
        self.children: list[Node] = []
        self.parent: Node | None = None

    def append(self, child: Node) -> None:
        if child.parent is not None:
            child.parent.remove(child)
        child.parent = self
        self.children.append(child)

    def remove(self, child: Node) -> None:
        for i, c in enumerate(self.children):
            if c is child:
                del self.children[i]
                child.parent = None
                return

    def walk(self) -> Iterator[Node]:
        """This node and everything below, in document order."""
        todo = [self]
        while todo:
            node = todo.pop()
            yield node
            todo.extend(reversed(node.children))

    def text(self) -> str:
        return "".join(x.data for x in self.walk() if x.kind == "text")

    def by_tag(self, name: str) -> list[Node]:
        name = name.lower()
        return [x for x in self.walk() if x is not self and x.kind == "element" and (name == "*" or x.tag == name)]

    def by_id(self, value: str) -> Node | None:
        return next((x for x in self.walk() if x.kind == "element" and x.attrs.get("id") == value), None)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def elements(self) -> list[Node]:
        return [c for c in self.children if c.kind == "element"]

    def inner_html(self) -> str:
        return "".join(c.outer_html() for c in self.children)

    def outer_html(self) -> str:
        """Nothing is escaped again, and comments come out empty."""
        if self.kind == "text":
            return self.data
        if self.kind == "comment":
            return "<!---->"
        if self.kind == "document":
            return self.inner_html()
        attrs = "".join(f' {k}="{v}"' for k, v in self.attrs.items())
        return f"<{self.tag}{attrs}>{self.inner_html()}</{self.tag}>"


def parse(html: str | None) -> Node:
    document = Node("document")
    path = [document]
    for t in tokenize(html):
        if t.kind == "start":
            element = Node("element", tag=t.name, attrs=t.attrs)
            path[-1].append(element)
            if not t.closed and t.name not in VOID:
                path.append(element)
        elif t.kind == "end":
            opened = next((i for i in range(len(path) - 1, 0, -1) if path[i].tag == t.name), 0)
            if opened:
                del path[opened:]
        elif t.kind in ("text", "comment"):
            path[-1].append(Node(t.kind, data=t.data))
    return document


def title(document: Node) -> str:
    first = next(iter(document.by_tag("title")), None)
    return first.text().strip() if first is not None else ""


def node_rows(document: Node) -> Iterator[tuple]:
    """(node_id, parent_id, ord, depth, kind, tag, attrs, data, path): ids count in document order, the document is 0."""
    ids: dict[int, int] = {}
    paths: dict[int, list[int]] = {}
    for i, node in enumerate(document.walk()):
        ids[id(node)] = i
        up = node.parent if i else None
        paths[i] = [*paths[ids[id(up)]], i] if up is not None else [i]
    place: dict[int, int] = {id(c): k for node in document.walk() for k, c in enumerate(node.children)}
    for node in document.walk():
        i = ids[id(node)]
        top = i == 0
        yield i, None if top else ids[id(node.parent)], 0 if top else place[id(node)], len(paths[i]) - 1, node.kind, node.tag or None, dict(node.attrs), node.data if node.kind in ("text", "comment") else None, paths[i]
