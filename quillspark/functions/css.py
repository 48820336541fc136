"""Style sheets: rules, selectors, values and the cascade over a tree.

At-rules, combinators other than descent, attribute selectors and pseudo-classes aren't understood: such a selector
parses to a name that no element has.  ``!important`` is part of a value.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

from quillspark.functions.html import Node

INHERITED = frozenset("color font-family font-size font-weight font-style line-height text-align text-indent text-transform white-space visibility list-style letter-spacing word-spacing".split())

#: What every page starts from.
_BLOCKS = "html body div p h1 h2 h3 h4 h5 h6 ul ol li section article header footer nav main aside figure figcaption blockquote pre table thead tbody tr td th form fieldset address dl dd dt hr"
_HEADINGS = {"h1": (32, 16), "h2": (24, 14), "h3": (20, 12), "h4": (16, 12), "h5": (14, 10), "h6": (12, 10)}
USER_AGENT = "\n".join(
    [
        ",".join(_BLOCKS.split()) + "{display:block}",
        "head,script,style,title,meta,link,base,noscript{display:none}",
        "span,a,b,i,em,strong,small,code,label,img,button,sub,sup{display:inline}",
        "body{margin:8px;color:#000000;font-size:16px;font-family:sans-serif}",
        *(f"{h}{{font-size:{size}px;font-weight:bold;margin:{margin}px}}" for h, (size, margin) in _HEADINGS.items()),
        "p{margin:12px}",
        "ul,ol{margin:12px;padding:24px}",
        "blockquote{margin:12px;padding:8px}",
        "pre,code{font-family:monospace}",
        "a{color:#0000ee}",
        "strong,b{font-weight:bold}",
        "em,i{font-style:italic}",
    ]
)


@dataclass(frozen=True)
class Compound:
    tag: str | None
    id: str | None
    classes: tuple[str, ...]

    def matches(self, e: Node) -> bool:
        return (self.tag in (None, "*") or self.tag == e.tag) and (self.id is None or e.attrs.get("id") == self.id) and (not self.classes or set(self.classes) <= set(e.classes()))

    def specificity(self) -> tuple[int, int, int]:
        return int(self.id is not None), len(self.classes), int(self.tag not in (None, "*"))

    def __str__(self) -> str:
        return (self.tag or "") + (f"#{self.id}" if self.id else "") + "".join(f".{c}" for c in self.classes)


@dataclass(frozen=True)
class Selector:
    """Compounds joined by descent, the subject last."""

    parts: tuple[Compound, ...]

    def matches(self, e: Node) -> bool:
        if not self.parts[-1].matches(e):
            return False
        left, up = len(self.parts) - 1, e.parent
        while left and up is not None:
            left -= up.kind == "element" and self.parts[left - 1].matches(up)
            up = up.parent
        return not left

    def specificity(self) -> tuple[int, int, int]:
        return tuple(map(sum, zip(*(p.specificity() for p in self.parts), strict=True)))

    def __str__(self) -> str:
        return " ".join(map(str, self.parts))


@dataclass(frozen=True)
class Rule:
    selectors: tuple[Selector, ...]
    declarations: tuple[tuple[str, str], ...]


def _compound(word: str) -> Compound:
    head, *rest = re.split(r"(?=[.#])", word) if word[0] not in ".#" else ["", *re.split(r"(?=[.#])", word)]
    names = [(x[0], x[1:]) for x in rest if len(x) > 1]
    ids = [v for k, v in names if k == "#"]
    return Compound(head.lower() or None, ids[-1] if ids else None, tuple(v for k, v in names if k == "."))


def selector(text: str) -> Selector | None:
    words = text.split()
    return Selector(tuple(map(_compound, words))) if words else None


def selectors(text: str) -> list[Selector]:
    return [s for s in map(selector, text.split(",")) if s is not None]


def declarations(body: str) -> list[tuple[str, str]]:
    found = []
    for piece in body.split(";"):
        name, colon, value = piece.partition(":")
        if colon and name.strip():
            found.append((name.strip().lower(), value.strip()))
    return found


def parse(css: str | None) -> list[Rule]:
    text = re.sub(r"/\*.*?\*/", "", css or "", flags=re.S)
    rules, at = [], 0
    while (opened := text.find("{", at)) >= 0:
        closed = text.find("}", opened)
        closed = len(text) if closed < 0 else closed
        head, at_head = text[at:opened].strip(), closed + 1
        if head and (found := selectors(head)):
            rules.append(Rule(tuple(found), tuple(declarations(text[opened + 1 : closed]))))
        at = at_head
    return rules


# ---- values

_GREYS = {"black": 0, "gray": 128, "grey": 128, "silver": 192, "lightgray": 211, "lightgrey": 211, "darkgray": 169, "darkgrey": 169, "white": 255}
NAMED = {k: (v, v, v, 255) for k, v in _GREYS.items()} | {
    name: (*bytes.fromhex(code), 255)
    for name, code in (x.split(":") for x in "maroon:800000 red:ff0000 purple:800080 fuchsia:ff00ff magenta:ff00ff green:008000 lime:00ff00 olive:808000 yellow:ffff00 navy:000080 blue:0000ff teal:008080 aqua:00ffff cyan:00ffff orange:ffa500 pink:ffc0cb brown:a52a2a gold:ffd700 indigo:4b0082 violet:ee82ee".split())
}
NAMED["transparent"] = (0, 0, 0, 0)
_LENGTH = re.compile(r"([+-]?[0-9]*\.?[0-9]+)(px|em|rem|ex|pt|%)?")


def _round(x: float) -> int:
    return math.floor(x + 0.5)


def color(text: str | None) -> tuple[int, int, int, int] | None:
    """(r, g, b, a) from 0 to 255."""
    s = (text or "").strip().lower()
    if s.startswith("#"):
        h = s[1:]
        if not re.fullmatch("[0-9a-f]+", h or "x"):
            return None
        if len(h) == 3:
            return (*(int(c, 16) * 17 for c in h), 255)
        return (*bytes.fromhex(h), *([255] if len(h) == 6 else [])) if len(h) in (6, 8) else None
    if s.startswith(("rgb(", "rgba(")):
        inside = s[s.find("(") + 1 : s.find(")")] if ")" in s else None
        if inside is None:
            return None
        try:
            parts = [x.strip() for x in inside.split(",")]
            rgb = [_round(float(p[:-1]) * 255 / 100) if p.endswith("%") else _round(float(p)) for p in parts[:3]]
            alpha = [_round(float(p) * 255) for p in parts[3:]]
        except ValueError:
            return None
        if len(parts) not in (3, 4):
            return None
        return tuple(min(255, max(0, x)) for x in [*rgb, *(alpha or [255])])
    return NAMED.get(s)


@dataclass(frozen=True)
class Value:
    """kind: keyword, length or color."""

    kind: str
    keyword: str | None = None
    amount: float | None = None
    unit: str | None = None
    rgba: tuple[int, int, int, int] | None = None

    def px(self, em: float = 16.0) -> float:
        scale = {"pt": 96 / 72, "em": em, "rem": em, "ex": em}
        return self.amount * scale.get(self.unit, 1.0)

    def plain(self) -> str:
        if self.kind == "keyword":
            return self.keyword
        return f"{self.amount:g}{self.unit or ''}" if self.kind == "length" else "rgba(%d,%d,%d,%d)" % self.rgba


def value(raw: str | None) -> Value:
    s = (raw or "").strip()
    if m := _LENGTH.fullmatch(s):
        return Value("length", amount=float(m[1]), unit=m[2])
    if (c := color(s)) is not None:
        return Value("color", rgba=c)
    return Value("keyword", keyword=s.lower())


# ---- cascade over a tree


class Styled:
    """A node with its resolved values; comments are left out of ``children``."""

    __slots__ = ("children", "node", "values")

    def __init__(self, node: Node, values: dict[str, Value], children: list[Styled]) -> None:
        self.node, self.values, self.children = node, values, children

    def keyword(self, name: str, default: str) -> str:
        v = self.values.get(name)
        return v.keyword if v is not None and v.kind == "keyword" else default

    def length(self, name: str, default: float) -> float:
        v = self.values.get(name)
        return v.px() if v is not None and v.kind == "length" else default

    def color(self, name: str) -> tuple[int, int, int, int] | None:
        v = self.values.get(name)
        return v.rgba if v is not None and v.kind == "color" else None

    @property
    def bold(self) -> bool:
        v = self.values.get("font-weight")
        if v is None:
            return False
        return v.keyword in ("bold", "bolder") if v.kind == "keyword" else v.kind == "length" and v.amount >= 700


_AGENT = parse(USER_AGENT)
_Found = tuple[int, tuple[int, int, int], int, tuple[tuple[str, str], ...]]


def _by_tag(sheet: list[Rule]) -> dict[str, list[_Found]]:
    """What a sheet whose selectors are all single tags declares for each of them."""
    found: dict[str, list[_Found]] = {}
    for order, rule in enumerate(sheet):
        for tag in dict.fromkeys(str(s) for s in rule.selectors):
            found.setdefault(tag, []).append((0, (0, 0, 1), order, rule.declarations))
    return found


_AGENT_FOUND = _by_tag(_AGENT)
_AGENT_ROWS = {tag: [(o, sp, n, p, v) for o, sp, n, ds in found for p, v in ds] for tag, found in _AGENT_FOUND.items()}
_AGENT_VALUES = {tag: {p: value(v) for *_, p, v in rows} for tag, rows in _AGENT_ROWS.items()}
_kept = lru_cache(maxsize=1 << 14)(value)


def _authored(e: Node, sheets: list[list[Rule]]) -> list[tuple[int, tuple[int, int, int], int, str, str]]:
    """What authors declare for an element, weakest first; the agent's rules are all weaker."""
    found, order = [], len(_AGENT)
    for sheet in sheets:
        for rule in sheet:
            best = max((x.specificity() for x in rule.selectors if x.matches(e)), default=None)
            if best is not None:
                found.append((1, best, order, rule.declarations))
            order += 1
    rows = [(o, sp, n, p, v) for o, sp, n, ds in sorted(found, key=lambda x: x[:3]) for p, v in ds]
    inline = e.attrs.get("style", "")
    if inline.strip():
        body = re.sub(r"/\*.*?\*/", "", inline, flags=re.S).split("}")[0]
        rows += [(2, (0, 0, 0), order, p, v) for p, v in declarations(body)]
    return rows


def candidates(e: Node, sheets: list[list[Rule]]) -> list[tuple[int, tuple[int, int, int], int, str, str]]:
    """(origin, specificity, order, property, value) of everything that is declared for an element, weakest first."""
    return _AGENT_ROWS.get(e.tag, []) + _authored(e, sheets)


def style(node: Node, sheets: list[list[Rule]], inherited: dict[str, Value] | None = None) -> Styled:
    values = dict(inherited or {})
    down = inherited or {}
    if node.kind == "element":
        own = dict(_AGENT_VALUES.get(node.tag, {}))
        own.update({p: _kept(v) for *_, p, v in _authored(node, sheets)})
        values.update(own)
        down = down | {k: v for k, v in own.items() if k in INHERITED}
    return Styled(node, values, [style(c, sheets, down) for c in node.children if c.kind in ("element", "text")])


def computed(document: Node, sheets: list[list[Rule]]) -> Iterator[tuple[int, str, str]]:
    """(place in document order, property, value as written) of elements and texts: what is declared most strongly for an element,
    and for inherited properties what the nearest element up from the node has."""
    downs: dict[int, dict[str, str]] = {}
    for i, n in enumerate(document.walk()):
        down = downs[id(n.parent)] if i else {}
        if n.kind == "element":
            own = {p: v for *_, p, v in candidates(n, sheets)}
            yield from ((i, p, v) for p, v in own.items() if p not in INHERITED)
            down = down | {p: v for p, v in own.items() if p in INHERITED}
        if n.kind in ("element", "text"):
            yield from ((i, p, v) for p, v in down.items())
        if n.children:
            downs[id(n)] = down


def author_sheets(document: Node, fetch=None) -> list[list[Rule]]:  # noqa: ANN001
    """Sheets of <style> and <link rel=stylesheet> in document order; one that can't be fetched is dropped."""
    sheets = []
    for e in document.by_tag("*"):
        if e.tag == "style":
            sheets.append(parse(e.text()))
        elif e.tag == "link" and "stylesheet" in e.attrs.get("rel", "").lower() and e.attrs.get("href", "").strip() and fetch:
            content = fetch(e.attrs["href"].strip())
            if content is not None:
                sheets.append(parse(content))
    return sheets
