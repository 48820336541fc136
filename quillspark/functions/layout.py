"""Boxes, lines and display lists of a styled tree, with a text measure that depends on nothing but lengths."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

from quillspark.functions.css import Styled, color, value

_BLOCK_LEVEL = frozenset(("block", "list-item", "table", "flex", "grid"))
TOP, RIGHT, BOTTOM, LEFT = range(4)
_SIDE = ("top", "right", "bottom", "left")


def text_width(text: str, size: float, bold: bool) -> float:
    return len(text) * size * (0.55 if bold else 0.5)


def line_height(size: float) -> float:
    return size * 1.2


@dataclass
class Box:
    style: Styled | None
    anonymous: bool = False
    children: list[Box] = field(default_factory=list)
    runs: list[Styled] = field(default_factory=list)
    lines: list[tuple[float, float, list[tuple[str, Styled, float, float, float, float]]]] = field(default_factory=list)  # top, height, (word, style, x, y, w, h)
    x: float = 0.0
    y: float = 0.0
    width: float = 0.0
    height: float = 0.0
    margin: list[float] = field(default_factory=lambda: [0.0] * 4)
    border: list[float] = field(default_factory=lambda: [0.0] * 4)
    padding: list[float] = field(default_factory=lambda: [0.0] * 4)

    def outer(self, *edges: list[float]) -> tuple[float, float, float, float]:
        """(x, y, width, height) with the given edges around the content."""
        t, r, b, left = (sum(e[i] for e in edges) for i in range(4))
        return self.x - left, self.y - t, self.width + left + r, self.height + t + b

    def padding_box(self) -> tuple[float, float, float, float]:
        return self.outer(self.padding)

    def border_box(self) -> tuple[float, float, float, float]:
        return self.outer(self.padding, self.border)

    def margin_box(self) -> tuple[float, float, float, float]:
        return self.outer(self.padding, self.border, self.margin)


# ---- box tree


def _hidden(s: Styled) -> bool:
    return s.node.kind == "element" and s.keyword("display", "inline") == "none"


def _is_block(s: Styled) -> bool:
    return s.node.kind == "element" and s.keyword("display", "inline") in _BLOCK_LEVEL


def _runs(s: Styled) -> Iterator[Styled]:
    if s.node.kind == "text":
        if s.node.data.strip():
            yield s
    elif not _hidden(s):
        for c in s.children:
            yield from _runs(c)


def boxes(s: Styled) -> Box:
    """A box for a styled node: inline content between blocks is wrapped in anonymous boxes."""
    box = Box(s if s.node.kind == "element" else None)
    shown = [c for c in s.children if not _hidden(c)]
    if not any(map(_is_block, shown)):
        box.runs = [r for c in shown for r in _runs(c)]
        return box
    waiting: list[Styled] = []
    for c in [*shown, None]:
        if c is not None and not _is_block(c):
            waiting += _runs(c)
            continue
        if waiting:
            box.children.append(Box(None, anonymous=True, runs=waiting))
            waiting = []
        if c is not None:
            box.children.append(boxes(c))
    return box


# ---- layout


class _Lengths:
    """Used lengths of a box against its container's width; ``None`` is auto."""

    def __init__(self, style: Styled | None, around: float) -> None:
        self.style, self.around = style, around
        self.em = style.length("font-size", 16.0) if style is not None else 16.0

    def px(self, v) -> float:  # noqa: ANN001
        return v.amount / 100 * self.around if v.unit == "%" else v.px(self.em)

    def get(self, name: str):  # noqa: ANN201
        return self.style.values.get(name) if self.style is not None else None

    def length(self, name: str) -> float | None:
        v = self.get(name)
        return self.px(v) if v is not None and v.kind == "length" else None

    def four(self, text: str) -> list[float]:
        got = [self.px(v) if v.kind == "length" else 0.0 for v in map(value, text.split())]
        spread = {1: (0, 0, 0, 0), 2: (0, 1, 0, 1), 3: (0, 1, 2, 1), 4: (0, 1, 2, 3)}.get(len(got))
        return [got[i] for i in spread] if spread else [0.0] * 4

    def edge(self, name: str, side: int, auto: bool = False) -> float | None:
        for v, whole in ((self.get(f"{name}-{_SIDE[side]}"), False), (self.get(name), True)):
            if v is None:
                continue
            if v.kind == "length":
                return self.px(v)
            if v.kind == "keyword" and auto and v.keyword == "auto":
                return None
            return self.four(v.keyword)[side] if whole and v.kind == "keyword" else 0.0
        return 0.0

    def border(self, side: int) -> float:
        own = self.length(f"border-{_SIDE[side]}-width")
        if own is not None:
            return own
        v = self.get("border-width")
        if v is not None and v.kind == "length":
            return self.px(v)
        if v is not None and v.kind == "keyword":
            return self.four(v.keyword)[side]
        v = self.get("border")
        if v is None or v.kind == "color":
            return 0.0
        if v.kind == "length":
            return self.px(v)
        return next((self.px(w) for w in map(value, v.keyword.split()) if w.kind == "length"), 0.0)


def _widths(box: Box, around: float) -> None:
    n = _Lengths(box.style, around)
    box.padding = [n.edge("padding", s) or 0.0 for s in range(4)]
    box.border = [n.border(s) for s in range(4)]
    width, left, right = n.length("width"), n.edge("margin", LEFT, auto=True), n.edge("margin", RIGHT, auto=True)
    fixed = sum(e[s] for e in (box.padding, box.border) for s in (LEFT, RIGHT))
    spare = around - (fixed + (width or 0.0) + (left or 0.0) + (right or 0.0))
    if width is None:
        left, right, width = left or 0.0, (right or 0.0) + min(0.0, spare), max(0.0, spare)
    else:
        if spare < 0:
            left, right = left or 0.0, right or 0.0
        if left is None and right is None:
            left = right = spare / 2
        elif left is None:
            left = spare
        elif right is None:
            right = spare
        else:
            right += spare
    box.width = width
    box.margin = [n.edge("margin", TOP, auto=True) or 0.0, right, n.edge("margin", BOTTOM, auto=True) or 0.0, left]


def _flow(box: Box) -> None:
    """Words into lines, greedily."""
    left, right = box.x, box.x + box.width
    x, top, tall, line = left, box.y, 0.0, []
    for run in box.runs:
        size, bold = run.length("font-size", 16.0), run.bold
        high, space, one = line_height(size), text_width(" ", size, bold), 0.55 if bold else 0.5
        for word in run.node.data.split():
            w = len(word) * size * one
            if x + w > right and x > left:
                box.lines.append((top, tall, line))
                top, x, tall, line = top + tall, left, 0.0, []
            line.append((word, run, x, top, w, high))
            x += w + space
            if high > tall:
                tall = high
    if line:
        box.lines.append((top, tall, line))
    box.height = sum(h for _, h, _ in box.lines)


def layout(box: Box, x: float, y: float, around: float) -> None:
    """Place a box whose container's content starts at x and has so far come down to y."""
    _widths(box, around)
    box.x = x + box.margin[LEFT] + box.border[LEFT] + box.padding[LEFT]
    box.y = y + box.margin[TOP] + box.border[TOP] + box.padding[TOP]
    if box.children:
        for c in box.children:
            layout(c, box.x, box.y + box.height, box.width)
            box.height += c.margin_box()[3]
    else:
        _flow(box)
    v = box.style.values.get("height") if box.style is not None else None
    if v is not None and v.kind == "length" and v.unit != "%":
        box.height = v.px(box.style.length("font-size", 16.0))


def layout_document(root: Styled, viewport: float) -> Box:
    box = boxes(root)
    layout(box, 0.0, 0.0, viewport)
    return box


# ---- paint


def _border_color(s: Styled) -> tuple[int, int, int, int] | None:
    own = s.color("border-color")
    if own is not None:
        return own
    v = s.values.get("border")
    if v is not None and v.kind == "color":
        return v.rgba
    if v is not None and v.kind == "keyword":
        for word in v.keyword.split():
            if (c := color(word)) is not None:
                return c
    return s.color("color")


def display_list(box: Box) -> Iterator[tuple]:
    """(kind, x, y, width, height, text, font_size, bold, color): backgrounds, borders, words, then children."""
    todo = [box]
    while todo:
        box = todo.pop()
        s = box.style
        if s is not None:
            fill = s.color("background-color") or s.color("background")
            if fill is not None and fill[3]:
                yield ("rect", *box.border_box(), None, None, None, fill)
            edge = _border_color(s)
            if edge is not None and any(x > 0 for x in box.border):
                bx, by, bw, bh = box.border_box()
                px, py, pw, ph = box.padding_box()
                t, r, b, left = box.border
                for size, rect in ((left, (bx, by, left, bh)), (r, (px + pw, by, r, bh)), (t, (bx, by, bw, t)), (b, (bx, py + ph, bw, b))):
                    if size > 0:
                        yield ("rect", *rect, None, None, None, edge)
        of, paint = None, ()
        for _, _, words in box.lines:
            for word, run, x, y, w, h in words:
                if run is not of:
                    of, paint = run, (run.length("font-size", 16.0), run.bold, run.color("color") or (0, 0, 0, 255))
                yield ("glyphs", x, y, w, h, word, *paint)
        todo.extend(reversed(box.children))


def walk_boxes(box: Box, depth: int = 0) -> Iterator[tuple[int, Box]]:
    yield depth, box
    for c in box.children:
        yield from walk_boxes(c, depth + 1)
