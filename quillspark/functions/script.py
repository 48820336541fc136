"""A small ECMAScript dialect for page scripts, compiled to Python closures.

Statements: var/let/const (all block-scoped), if, while, for, for-of, for-in, functions, return, break, continue.
No prototypes, exceptions, classes, switch, arrow functions, templates or regular expressions.  A script has a budget of steps,
from which texts and arrays that are copied take their share, and limits on call depth and on the length of a text, so it
can't hang a task or fill its memory.  Values are None (null), UNDEF, bool, float, str, Array, Object and callables.
"""

from __future__ import annotations

import math
import random
import re
import sys
from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

from quillspark.functions import css
from quillspark.functions.html import Node, parse, title

MAX_STEPS, MAX_DEPTH, MAX_TEXT = 10_000_000, 1000, 1 << 24
_KEYWORDS = frozenset("var let const function return if else while for do true false null undefined new typeof break continue this in of".split())
_LEX = re.compile(
    r"(?P<skip>\s+|//[^\n]*|/\*.*?(?:\*/|$))|(?P<num>(?:\d+(?:\.\d*)?|\.\d+)(?:[eE][+-]?\d*)?)|(?P<str>\"(?:\\.|[^\"\\])*\\?(?:\"|$)|'(?:\\.|[^'\\])*\\?(?:'|$))|(?P<id>[^\W\d][\w$]*|\$[\w$]*)|(?P<op>===|!==|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|=>|.)",
    re.S,
)
_NUMBER = re.compile(r"[+-]?(?:NaN|Infinity|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?[fFdD]?)")
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "0": "\0"}


class ScriptError(Exception):
    """A script failed: its message starts with the kind of error where there is one."""


class _Undefined:
    def __repr__(self) -> str:
        return "undefined"

    def __reduce__(self) -> str:
        return "UNDEF"


UNDEF = _Undefined()


class _Return(Exception):
    def __init__(self, value: object) -> None:
        self.value = value


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class Object:
    def __init__(self) -> None:
        self.props: dict[str, object] = {}

    def get(self, name: str) -> object:
        return self.props.get(name, UNDEF)

    def set(self, name: str, value: object) -> None:
        self.props[name] = value


class Array(Object):
    def __init__(self, items: list | None = None) -> None:
        super().__init__()
        self.items = list(items or [])

    def get(self, name: str) -> object:
        if name == "length":
            return float(len(self.items))
        if name.isdecimal():
            return self.items[int(name)] if int(name) < len(self.items) else UNDEF
        return super().get(name)

    def set(self, name: str, value: object) -> None:
        if name == "length" or name.isdecimal():
            size = _int(number(value)) if name == "length" else max(len(self.items), int(name) + 1)
            if size > 10_000_000:
                raise ScriptError("RangeError: array too long")
            self.items += [UNDEF] * (size - len(self.items))
            if name == "length":
                del self.items[max(size, 0) :]
            else:
                self.items[int(name)] = value
        else:
            super().set(name, value)


# ---- conversions


def _int(x: float) -> int:
    return 0 if math.isnan(x) else int(max(-(2**31), min(2**31 - 1, x)))


def truthy(v: object) -> bool:
    if isinstance(v, float):
        return v != 0 and not math.isnan(v)
    return bool(v) if isinstance(v, bool | str) else v is not None and v is not UNDEF


def number(v: object) -> float:
    if isinstance(v, float):
        return v
    if v is None or isinstance(v, bool):
        return float(bool(v))
    if isinstance(v, str):
        t = v.strip()
        if not t:
            return 0.0
        if _NUMBER.fullmatch(t):
            return float(t.rstrip("fFdD") if t[-1] in "fFdD" else t)
    return math.nan


def show_number(d: float) -> str:
    if math.isnan(d) or math.isinf(d):
        return "NaN" if math.isnan(d) else "Infinity" if d > 0 else "-Infinity"
    if d == int(d) and abs(d) < 1e15:
        return str(int(d))
    if 1e-3 <= abs(d) < 1e7:
        return repr(d)
    digits, exponent = Decimal(repr(d)).normalize().as_tuple().digits, math.floor(math.log10(abs(d)))
    exponent = Decimal(repr(d)).adjusted()
    text = "".join(map(str, digits))
    return f"{'-' if d < 0 else ''}{text[0]}.{text[1:] or '0'}E{exponent}"


def show(v: object) -> str:
    if isinstance(v, str):
        return v
    if v is None or v is UNDEF:
        return "null" if v is None else "undefined"
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        return show_number(v)
    if isinstance(v, Array):
        return _joined(v.items, ",")
    return "[object Object]" if isinstance(v, Object) else "function"


def _joined(items: list, sep: str) -> str:
    return sep.join("" if x is None or x is UNDEF else show(x) for x in items)


def type_of(v: object) -> str:
    for kinds, name in ((_Undefined, "undefined"), (bool, "boolean"), (float, "number"), (str, "string")):
        if isinstance(v, kinds):
            return name
    return "function" if callable(v) else "object"


def same(a: object, b: object) -> bool:
    if type(a) is type(b) and isinstance(a, float | str | bool):
        return a == b
    return a is b


def alike(a: object, b: object) -> bool:
    none = [x is None or x is UNDEF for x in (a, b)]
    if any(none):
        return all(none)
    if type(a) is type(b):
        return same(a, b)
    if isinstance(a, bool):
        return alike(float(a), b)
    if isinstance(b, bool):
        return alike(a, float(b))
    return isinstance(a, float | str) and isinstance(b, float | str) and number(a) == number(b)


def _divide(a: float, b: float) -> float:
    if b:
        return a / b
    return math.nan if a == 0 or math.isnan(a) or math.isnan(b) else math.copysign(math.inf, a) * math.copysign(1, b)


def _modulo(a: float, b: float) -> float:
    return math.nan if not b or math.isinf(a) or math.isnan(a) or math.isnan(b) else math.fmod(a, b)


def _multiply(a: float, b: float) -> float:
    return a * b


def _ordered(test: Callable[[object, object], bool]) -> Callable[[object, object], bool]:
    def run(a: object, b: object) -> bool:
        return test(a, b) if isinstance(a, str) and isinstance(b, str) else test(number(a), number(b))

    return run


_BINARY: dict[str, Callable[[object, object], object]] = {
    "+": lambda a, b: show(a) + show(b) if isinstance(a, str) or isinstance(b, str) else number(a) + number(b),
    "-": lambda a, b: number(a) - number(b),
    "*": lambda a, b: _multiply(number(a), number(b)),
    "/": lambda a, b: _divide(number(a), number(b)),
    "%": lambda a, b: _modulo(number(a), number(b)),
    "<": _ordered(lambda a, b: a < b),
    ">": _ordered(lambda a, b: a > b),
    "<=": _ordered(lambda a, b: a <= b),
    ">=": _ordered(lambda a, b: a >= b),
    "==": alike,
    "!=": lambda a, b: not alike(a, b),
    "===": same,
    "!==": lambda a, b: not same(a, b),
}
_LEVELS = [("||",), ("&&",), ("==", "!=", "===", "!=="), ("<", ">", "<=", ">="), ("+", "-"), ("*", "/", "%")]


# ---- scopes and methods


class Scope:
    __slots__ = ("up", "vars")

    def __init__(self, up: Scope | None) -> None:
        self.up, self.vars = up, {}

    def find(self, name: str) -> dict | None:
        s: Scope | None = self
        while s is not None:
            if name in s.vars:
                return s.vars
            s = s.up
        return None

    def get(self, name: str) -> object:
        found = self.find(name)
        if found is None:
            raise ScriptError(f"ReferenceError: {name} is not defined")
        return found[name]

    def assign(self, name: str, value: object) -> None:
        found = self.find(name)
        if found is None:
            s = self
            while s.up is not None:
                s = s.up
            found = s.vars
        found[name] = value


def _arg(a: list, i: int) -> object:
    return a[i] if i < len(a) else UNDEF


def _num(a: list, i: int) -> float:
    return number(_arg(a, i))


def _str(a: list, i: int) -> str:
    return show(_arg(a, i))


def _span(a: list, n: int) -> tuple[int, int]:
    """Start and end of slice arguments; negative ones count from the end."""
    ends = []
    for i, default in ((0, 0), (1, n)):
        v = _arg(a, i)
        k = default if v is UNDEF else _int(number(v))
        ends.append(max(0, min(n, k + n if k < 0 else k)))
    return ends[0], ends[1]


def _substring(s: str, a: list) -> str:
    lo = max(0, min(len(s), _int(_num(a, 0))))
    hi = max(0, min(len(s), _int(_num(a, 1)))) if len(a) > 1 else len(s)
    return s[min(lo, hi) : max(lo, hi)]


def _split(s: str, a: list) -> Array:
    if _arg(a, 0) is UNDEF:
        return Array([s])
    return Array(s.split(_str(a, 0)) if _str(a, 0) else s)


def _at(s: str, a: list) -> str:
    i = _int(_num(a, 0))
    return s[i] if 0 <= i < len(s) else ""


def _repeated(s: str, a: list) -> str:
    n = max(0, _int(_num(a, 0)))
    if len(s) * n > MAX_TEXT:
        raise ScriptError("RangeError: Invalid string length")
    return s * n


_STRING: dict[str, Callable[[str, list], object]] = {
    "charAt": _at,
    "charCodeAt": lambda s, a: float(ord(_at(s, a))) if _at(s, a) else math.nan,
    "toUpperCase": lambda s, a: s.upper(),
    "toLowerCase": lambda s, a: s.lower(),
    "trim": lambda s, a: s.strip(),
    "indexOf": lambda s, a: float(s.find(_str(a, 0))),
    "lastIndexOf": lambda s, a: float(s.rfind(_str(a, 0))),
    "includes": lambda s, a: _str(a, 0) in s,
    "startsWith": lambda s, a: s.startswith(_str(a, 0)),
    "endsWith": lambda s, a: s.endswith(_str(a, 0)),
    "slice": lambda s, a: s[slice(*_span(a, len(s)))],
    "substring": _substring,
    "split": _split,
    "replace": lambda s, a: s.replace(_str(a, 0), _str(a, 1), 1),
    "repeat": _repeated,
    "concat": lambda s, a: s + "".join(map(show, a)),
    "toString": lambda s, a: s,
}


def _fixed(d: float, a: list) -> str:
    if math.isnan(d) or math.isinf(d):
        return show_number(d)
    return f"{Decimal(repr(d)).quantize(Decimal(1).scaleb(-max(0, _int(_num(a, 0)))), ROUND_HALF_UP):f}"


def _grown(v: Array, new: list, front: bool) -> float:
    if front:
        v.items[:0] = new
    else:
        v.items += new
    return float(len(v.items))


def _place(v: Array, x: object) -> int:
    return next((i for i, y in enumerate(v.items) if same(y, x)), -1)


def _reversed(v: Array) -> Array:
    v.items.reverse()
    return v


_ARRAY: dict[str, Callable[[Array, list], object]] = {
    "push": lambda v, a: _grown(v, a, False),
    "pop": lambda v, a: v.items.pop() if v.items else UNDEF,
    "shift": lambda v, a: v.items.pop(0) if v.items else UNDEF,
    "unshift": lambda v, a: _grown(v, a, True),
    "join": lambda v, a: _joined(v.items, _str(a, 0) if a else ","),
    "indexOf": lambda v, a: float(_place(v, _arg(a, 0))),
    "includes": lambda v, a: _place(v, _arg(a, 0)) >= 0,
    "slice": lambda v, a: Array(v.items[slice(*_span(a, len(v.items)))]),
    "concat": lambda v, a: Array(v.items + [y for x in a for y in (x.items if isinstance(x, Array) else [x])]),
    "reverse": lambda v, a: _reversed(v),
}


def _parse_int(a: list) -> float:
    base = (_int(_num(a, 1)) if len(a) > 1 else 10) or 10
    m = re.match(r"([+-]?)(0[xX])?" if base == 16 else r"([+-]?)()", _str(a, 0).strip())
    rest = _str(a, 0).strip()[m.end() :]
    value, seen = 0, False
    for c in rest:
        d = int(c, 36) if c.isascii() and c.isalnum() else base
        if d >= base:
            break
        value, seen = value * base + d, True
    return float(-value if m[1] == "-" else value) if seen else math.nan


def _parse_float(a: list) -> float:
    m = re.match(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", _str(a, 0).strip())
    return float(m[0]) if m else math.nan


def _guard(f: Callable[..., float], on_error: float = math.nan) -> Callable[[object, list], float]:
    def run(this: object, a: list) -> float:
        try:
            return float(f(_num(a, 0)))
        except (ValueError, OverflowError):
            x = _num(a, 0)
            return x if math.isinf(x) or math.isnan(x) else on_error

    return run


def _power(this: object, a: list) -> float:
    try:
        r = math.pow(_num(a, 0), _num(a, 1))
    except OverflowError:
        return math.inf
    except ValueError:
        return math.inf if _num(a, 0) == 0 else math.nan
    return r


def _extreme(pick: Callable[[list], float], start: float) -> Callable[[object, list], float]:
    def run(this: object, a: list) -> float:
        xs = [start, *map(number, a)]
        return math.nan if any(map(math.isnan, xs)) else float(pick(xs))

    return run


def _math() -> Object:
    m = Object()
    plain = {"floor": math.floor, "ceil": math.ceil, "round": lambda x: math.floor(x + 0.5), "trunc": math.trunc, "abs": abs, "sign": lambda x: x if math.isnan(x) else (x > 0) - (x < 0), "sqrt": math.sqrt, "cbrt": math.cbrt, "sin": math.sin, "cos": math.cos, "tan": math.tan}
    m.props = {"PI": math.pi, "E": math.e} | {k: _guard(f) for k, f in plain.items()}
    m.props |= {"exp": _guard(math.exp, math.inf), "log": lambda t, a: -math.inf if _num(a, 0) == 0 else math.nan if _num(a, 0) < 0 or math.isnan(_num(a, 0)) else math.log(_num(a, 0)), "pow": _power, "random": lambda t, a: random.random(), "max": _extreme(max, -math.inf), "min": _extreme(min, math.inf)}
    return m


# ---- machine


class Machine:
    def __init__(self, max_steps: int = MAX_STEPS) -> None:
        self.left, self.depth, self.console = max_steps, 0, []
        console = Object()
        for name in ("log", "info", "warn", "error", "debug"):
            console.props[name] = self._log
        self.globals = Scope(None)
        self.globals.vars |= {
            "undefined": UNDEF, "NaN": math.nan, "Infinity": math.inf, "console": console, "Math": _math(),
            "parseInt": lambda t, a: _parse_int(a), "parseFloat": lambda t, a: _parse_float(a),
            "isNaN": lambda t, a: math.isnan(_num(a, 0)), "isFinite": lambda t, a: math.isfinite(_num(a, 0)),
            "String": lambda t, a: show(a[0]) if a else "", "Number": lambda t, a: number(a[0]) if a else 0.0, "Boolean": lambda t, a: bool(a) and truthy(a[0]),
        }

    def _log(self, this: object, a: list) -> object:
        self.console.append(" ".join(map(show, a)))
        return UNDEF

    def run(self, source: str) -> None:
        limit = sys.getrecursionlimit()
        sys.setrecursionlimit(max(limit, 60_000))
        try:
            _Compiler(self, source).program()(self.globals)
        except RecursionError as e:
            raise ScriptError("RangeError: Maximum call stack size exceeded") from e
        except (_Return, _Break, _Continue) as e:
            raise ScriptError(f"SyntaxError: misplaced {type(e).__name__[1:].lower()}") from e
        finally:
            sys.setrecursionlimit(limit)

    def charge(self, copied: int) -> None:
        """Take characters or elements that were copied from the budget."""
        if copied > MAX_TEXT:
            raise ScriptError("RangeError: Invalid string length")
        self.left -= copied >> 6
        if self.left < 0:
            raise ScriptError("RangeError: script exceeded its execution budget")

    def charged(self, size: int, f: Callable, v: object, a: list) -> object:
        self.charge(size)
        return f(v, a)

    def call(self, f: object, this: object, args: list) -> object:
        if not callable(f):
            raise ScriptError(f"TypeError: {show(f)} is not a function")
        if self.depth >= MAX_DEPTH:
            raise ScriptError("RangeError: Maximum call stack size exceeded")
        self.depth += 1
        try:
            return f(this, args)
        finally:
            self.depth -= 1

    def member(self, v: object, name: str) -> object:
        if v is None or v is UNDEF:
            raise ScriptError(f"TypeError: Cannot read properties of {show(v)} (reading '{name}')")
        if isinstance(v, Array):
            if name in ("map", "filter", "forEach"):
                return self._each(v, name)
            if name in _ARRAY:
                return lambda t, a: self.charged(len(v.items) if name not in ("push", "pop") else 0, _ARRAY[name], v, a)
        if isinstance(v, Object):
            return v.get(name)
        if isinstance(v, str):
            return float(len(v)) if name == "length" else (lambda t, a: self.charged(len(v), _STRING[name], v, a)) if name in _STRING else UNDEF
        if isinstance(v, float) and name in ("toFixed", "toString"):
            return lambda t, a: _fixed(v, a) if name == "toFixed" else show_number(v)
        return UNDEF

    def _each(self, v: Array, name: str) -> Callable:
        def run(this: object, a: list) -> object:
            out, i = [], 0
            while i < len(v.items):
                x = v.items[i]
                got = self.call(_arg(a, 0), UNDEF, [x, float(i), v])
                if name == "map":
                    out.append(got)
                elif name == "filter" and truthy(got):
                    out.append(x)
                i += 1
            return UNDEF if name == "forEach" else Array(out)

        return run


Code = Callable[[Scope], object]


class _Compiler:
    """Recursive descent; every rule returns a closure over the machine."""

    def __init__(self, machine: Machine, source: str) -> None:
        self.m, self.at = machine, 0
        self.toks: list[tuple[str, str]] = []
        for t in _LEX.finditer(source or ""):
            kind, text = t.lastgroup, t[0]
            if kind == "str":
                body = text[1:-1] if len(text) > 1 and text[-1] == text[0] and not re.search(r"(?<!\\)(\\\\)*\\$", text[1:-1]) else text[1:]
                text = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], x[1]), body, flags=re.S)
            elif kind == "id" and text in _KEYWORDS:
                kind = "kw"
            if kind != "skip":
                self.toks.append((kind, text))
        self.toks.append(("end", ""))

    # -- tokens
    def next(self) -> tuple[str, str]:
        t = self.toks[self.at]
        self.at += self.at < len(self.toks) - 1
        return t

    def sees(self, *ops: str) -> bool:
        k, t = self.toks[self.at]
        return k == "op" and t in ops

    def keyword(self, *words: str) -> bool:
        k, t = self.toks[self.at]
        return k == "kw" and t in words

    def takes(self, op: str) -> bool:
        return self.sees(op) and bool(self.next())

    def need(self, op: str) -> None:
        if not self.takes(op):
            raise ScriptError(f"Expected '{op}' but found '{self.toks[self.at][1]}'")

    def name(self) -> str:
        k, t = self.toks[self.at]
        if k not in ("id", "kw"):
            raise ScriptError(f"Expected an identifier but found '{t}'")
        return self.next()[1]

    def listed(self, close: str, item: Callable[[], object], trailing: bool = False) -> list:
        found: list = []
        while not self.sees(close) or (found and not trailing):
            found.append(item())
            if not self.takes(","):
                break
            if trailing and self.sees(close):
                break
        self.need(close)
        return found

    def ticking(self, f: Code) -> Code:
        m = self.m

        def run(s: Scope) -> object:
            m.left -= 1
            if m.left < 0:
                raise ScriptError("RangeError: script exceeded its execution budget")
            v = f(s)
            if type(v) is str and len(v) > 256:
                m.charge(len(v))
            return v

        return run

    # -- statements
    def program(self) -> Code:
        body = []
        while self.toks[self.at][0] != "end":
            body.append(self.statement())
        return self.sequence(body)

    def sequence(self, body: list[tuple[bool, Code]]) -> Code:
        """Function declarations take effect first."""
        hoisted, codes = [c for is_function, c in body if is_function], [c for _, c in body]

        def run(s: Scope) -> None:
            for c in hoisted:
                c(s)
            for c in codes:
                c(s)

        return run

    def statement(self) -> tuple[bool, Code]:
        if self.keyword("function"):
            self.next()
            name, make = self.name(), self.function_rest()
            return True, self.ticking(lambda s: s.vars.__setitem__(name, make(s)))
        return False, self.ticking(self.plain_statement())

    def plain_statement(self) -> Code:
        if self.takes(";"):
            return lambda s: None
        if self.sees("{"):
            body = self.block()
            return lambda s: body(Scope(s))
        if self.keyword("var", "let", "const"):
            code = self.declaration()
            self.takes(";")
            return code
        kind, word = self.toks[self.at]
        rule = {"if": self.if_, "while": self.while_, "for": self.for_, "return": self.return_}.get(word) if kind == "kw" else None
        if rule:
            self.next()
            return rule()
        if self.keyword("break", "continue"):
            signal = _Break if self.next()[1] == "break" else _Continue
            self.takes(";")

            def leave(s: Scope) -> None:
                raise signal

            return leave
        code = self.assignment()
        self.takes(";")
        return code

    def block(self) -> Code:
        self.need("{")
        body = []
        while not self.sees("}") and self.toks[self.at][0] != "end":
            body.append(self.statement())
        self.need("}")
        return self.sequence(body)

    def declaration(self, first: str | None = None) -> Code:
        if first is None:
            self.next()
        pairs = []
        while True:
            name = first if first is not None and not pairs else self.name()
            pairs.append((name, self.assignment() if self.takes("=") else None))
            if not self.takes(","):
                break

        def run(s: Scope) -> None:
            for name, init in pairs:
                s.vars[name] = UNDEF if init is None else init(s)

        return run

    def if_(self) -> Code:
        self.need("(")
        test = self.assignment()
        self.need(")")
        yes, no = self.statement()[1], None
        if self.keyword("else"):
            self.next()
            no = self.statement()[1]

        def run(s: Scope) -> None:
            if truthy(test(s)):
                yes(s)
            elif no is not None:
                no(s)

        return run

    @staticmethod
    def once(body: Code, s: Scope) -> bool:
        """Run a loop's body; False ends the loop."""
        try:
            body(s)
        except _Continue:
            pass
        except _Break:
            return False
        return True

    def while_(self) -> Code:
        self.need("(")
        test = self.assignment()
        self.need(")")
        body, once = self.statement()[1], self.once

        def run(s: Scope) -> None:
            while truthy(test(s)) and once(body, s):
                pass

        return run

    def for_(self) -> Code:
        self.need("(")
        init: Code | None = None
        if self.keyword("var", "let", "const"):
            self.next()
            name = self.name()
            if self.keyword("of", "in"):
                return self.for_each(name, self.next()[1] == "of")
            init = self.declaration(name)
        elif not self.sees(";"):
            init = self.assignment()
        self.need(";")
        test = None if self.sees(";") else self.assignment()
        self.need(";")
        update = None if self.sees(")") else self.assignment()
        self.need(")")
        body, once = self.statement()[1], self.once

        def run(s: Scope) -> None:
            inner = Scope(s)
            if init is not None:
                init(inner)
            while (test is None or truthy(test(inner))) and once(body, inner):
                if update is not None:
                    update(inner)

        return run

    def for_each(self, name: str, of: bool) -> Code:
        source = self.assignment()
        self.need(")")
        body, once = self.statement()[1], self.once

        def run(s: Scope) -> None:
            v = source(s)
            if of:
                if not isinstance(v, Array | str):
                    raise ScriptError("TypeError: value is not iterable")
                items = list(v.items if isinstance(v, Array) else v)
            else:
                items = [str(i) for i in range(len(v.items))] if isinstance(v, Array) else list(v.props) if isinstance(v, Object) else []
            for x in items:
                inner = Scope(s)
                inner.vars[name] = x
                if not once(body, inner):
                    break

        return run

    def return_(self) -> Code:
        value = None if self.sees(";", "}") or self.toks[self.at][0] == "end" else self.assignment()
        self.takes(";")

        def run(s: Scope) -> None:
            raise _Return(UNDEF if value is None else value(s))

        return run

    # -- expressions
    def assignment(self) -> Code:
        left, target = self.conditional()
        if not self.sees("=", "+=", "-=", "*=", "/=", "%="):
            return left
        op = self.next()[1][:-1]
        right = self.assignment()
        put = self.store(target)
        if not op:

            def plain(s: Scope) -> object:
                v = right(s)
                put(s, v)
                return v

            return self.ticking(plain)
        apply = _BINARY[op]

        def compound(s: Scope) -> object:
            v = apply(left(s), right(s))
            put(s, v)
            return v

        return self.ticking(compound)

    def store(self, target: tuple | None) -> Callable[[Scope, object], None]:
        if target is None:

            def fail(s: Scope, v: object) -> None:
                raise ScriptError("Invalid assignment target")

            return fail
        if target[0] == "name":
            return lambda s, v: s.assign(target[1], v)
        _, owner, key = target

        def put(s: Scope, v: object) -> None:
            o, k = owner(s), key(s)
            if isinstance(o, Object):
                o.set(k, v)

        return put

    def conditional(self) -> tuple[Code, tuple | None]:
        test, target = self.level(0)
        if not self.takes("?"):
            return test, target
        yes = self.assignment()
        self.need(":")
        no = self.assignment()
        return self.ticking(lambda s: yes(s) if truthy(test(s)) else no(s)), None

    def level(self, k: int) -> tuple[Code, tuple | None]:
        """Left-associative binary operators, loosest first."""
        if k == len(_LEVELS):
            return self.unary()
        left, target = self.level(k + 1)
        while self.sees(*_LEVELS[k]):
            op = self.next()[1]
            right = self.level(k + 1)[0]
            left, target = self.ticking(self.binary(op, left, right)), None
        return left, target

    @staticmethod
    def binary(op: str, a: Code, b: Code) -> Code:
        if op in ("&&", "||"):

            def short(s: Scope) -> object:
                v = a(s)
                return b(s) if truthy(v) is (op == "&&") else v

            return short
        f = _BINARY[op]
        return lambda s: f(a(s), b(s))

    def unary(self) -> tuple[Code, tuple | None]:
        if self.sees("!", "-", "+") or self.keyword("typeof"):
            op = self.next()[1]
            value, target = self.unary()
            if op == "typeof":
                if target is not None and target[0] == "name":
                    return self.ticking(lambda s: "undefined" if s.find(target[1]) is None else type_of(value(s))), None
                return self.ticking(lambda s: type_of(value(s))), None
            f = {"!": lambda v: not truthy(v), "-": lambda v: -number(v), "+": number}[op]
            return self.ticking(lambda s: f(value(s))), None
        if self.sees("++", "--"):
            step = 1 if self.next()[1] == "++" else -1
            value, target = self.unary()
            return self.stepped(value, target, step, after=True), None
        value, target = self.postfix()
        if self.sees("++", "--"):
            return self.stepped(value, target, 1 if self.next()[1] == "++" else -1, after=False), None
        return value, target

    def stepped(self, value: Code, target: tuple | None, step: int, after: bool) -> Code:
        put = self.store(target)

        def run(s: Scope) -> float:
            old = number(value(s))
            put(s, old + step)
            return old + step if after else old

        return self.ticking(run)

    def postfix(self) -> tuple[Code, tuple | None]:
        value, target = self.primary()
        m = self.m
        while True:
            if self.takes("."):
                word = self.name()
                value, target = self.access(value, lambda s, w=word: w)
            elif self.takes("["):
                inner = self.assignment()
                self.need("]")
                value, target = self.access(value, lambda s, k=inner: show(k(s)))
            elif self.takes("("):
                value, target = self.ticking(self.invoke(m, value, target, self.listed(")", self.assignment))), None
            else:
                return value, target

    def access(self, owner: Code, key: Callable[[Scope], str]) -> tuple[Code, tuple]:
        m = self.m
        return self.ticking(lambda s: m.member(owner(s), key(s))), ("member", owner, key)

    @staticmethod
    def invoke(m: Machine, value: Code, target: tuple | None, args: list[Code]) -> Code:
        if target is not None and target[0] == "member":
            _, owner, key = target

            def method(s: Scope) -> object:
                this = owner(s)
                f = m.member(this, key(s))
                return m.call(f, this, [a(s) for a in args])

            return method

        def plain(s: Scope) -> object:
            f = value(s)
            return m.call(f, UNDEF, [a(s) for a in args])

        return plain

    def primary(self) -> tuple[Code, tuple | None]:
        kind, text = self.next()
        if kind in ("num", "str"):
            try:
                v = float(text) if kind == "num" else text
            except ValueError as e:
                raise ScriptError(f"SyntaxError: {text}") from e
            return self.ticking(lambda s: v), None
        if kind == "id":
            return self.ticking(lambda s: s.get(text)), ("name", text)
        constants = {"true": True, "false": False, "null": None, "undefined": UNDEF}
        if kind == "kw" and text in constants:
            c = constants[text]
            return self.ticking(lambda s: c), None
        if kind == "kw" and text == "this":
            return self.ticking(lambda s: UNDEF if s.find("this") is None else s.get("this")), None
        if kind == "kw" and text == "function":
            own = self.next()[1] if self.toks[self.at][0] == "id" else None
            return self.ticking(self.function_rest(own)), None
        if kind == "kw" and text == "new":
            return self.new(), None
        if kind == "kw":
            raise ScriptError(f"Unexpected keyword '{text}'")
        if text == "(" and kind == "op":
            value = self.assignment()
            self.need(")")
            return value, None
        if text == "[" and kind == "op":
            items = self.listed("]", self.assignment, trailing=True)
            return self.ticking(lambda s: Array([x(s) for x in items])), None
        if text == "{" and kind == "op":
            pairs = self.listed("}", self.pair, trailing=True)

            def make(s: Scope) -> Object:
                o = Object()
                for k, v in pairs:
                    o.set(k, v(s))
                return o

            return self.ticking(make), None
        raise ScriptError(f"Unexpected token '{text}'")

    def pair(self) -> tuple[str, Code]:
        key = self.next()[1]
        self.need(":")
        return key, self.assignment()

    def new(self) -> Code:
        callee, _ = self.primary()
        while self.takes("."):
            word = self.name()
            callee, _ = self.access(callee, lambda s, w=word: w)
        args = self.listed(")", self.assignment) if self.takes("(") else []

        def run(s: Scope) -> object:
            f = callee(s)
            if not callable(f):
                raise ScriptError("TypeError: value is not a constructor")
            this = Object()
            got = f(this, [a(s) for a in args])
            return got if isinstance(got, Object) else this

        return self.ticking(run)

    def function_rest(self, own: str | None = None) -> Code:
        """Parameters and body; ``own`` is visible inside a named function expression."""
        self.need("(")
        params = self.listed(")", self.name)
        body = self.block()

        def make(s: Scope) -> Callable:
            home = Scope(s) if own else s

            def f(this: object, args: list) -> object:
                local = Scope(home)
                local.vars |= {"this": this, "arguments": Array(args)}
                for i, p in enumerate(params):
                    local.vars[p] = _arg(args, i)
                try:
                    body(local)
                except _Return as r:
                    return r.value
                return UNDEF

            if own:
                home.vars[own] = f
            return f

        return make


# ---- the page


class _Wrapped(Object):
    """A node as scripts see it: computed properties first, then whatever was set."""

    def __init__(self, page: Page, node: Node) -> None:
        super().__init__()
        self.page, self.node = page, node

    def get(self, name: str) -> object:
        reader = getattr(self, "r_" + name, None)
        if reader is not None:
            return reader()
        method = getattr(self, "m_" + name, None)
        return (lambda t, a: method(a)) if method is not None else super().get(name)

    def set(self, name: str, value: object) -> None:
        writer = getattr(self, "w_" + name, None)
        if writer is not None:
            writer(show(value))
        else:
            super().set(name, value)

    @property
    def el(self) -> Node | None:
        return self.node if self.node.kind == "element" else None

    def _first_str(self, a: list) -> str:
        return show(a[0]) if a else ""

    def m_getElementById(self, a: list) -> object:  # noqa: N802
        return self.page.wrap(self.node.by_id(self._first_str(a)))

    def m_getElementsByTagName(self, a: list) -> object:  # noqa: N802
        return self.page.array(self.node.by_tag(self._first_str(a)))

    def m_querySelectorAll(self, a: list) -> object:  # noqa: N802
        return self.page.array(select(self.node, self._first_str(a)))

    def m_querySelector(self, a: list) -> object:  # noqa: N802
        return self.page.wrap(next(iter(select(self.node, self._first_str(a))), None))


class _Document(_Wrapped):
    def _tag(self, name: str) -> object:
        return self.page.wrap(next(iter(self.node.by_tag(name)), None))

    def r_body(self) -> object:
        return self._tag("body")

    def r_head(self) -> object:
        return self._tag("head")

    def r_documentElement(self) -> object:  # noqa: N802
        return self.page.wrap(next(iter(self.node.elements()), None))

    def r_title(self) -> str:
        return title(self.node)

    def w_title(self, value: str) -> None:
        first = next(iter(self.node.by_tag("title")), None)
        if first is not None:
            _replace(first, [Node("text", data=value)])

    def m_getElementsByClassName(self, a: list) -> object:  # noqa: N802
        return self.page.array(select(self.node, "." + self._first_str(a)))

    def m_createElement(self, a: list) -> object:  # noqa: N802
        return self.page.wrap(Node("element", tag=self._first_str(a).lower()))

    def m_createTextNode(self, a: list) -> object:  # noqa: N802
        return self.page.wrap(Node("text", data=self._first_str(a)))


class _Element(_Wrapped):
    """Elements, texts and comments."""

    def r_tagName(self) -> object:  # noqa: N802
        return self.el.tag.upper() if self.el else UNDEF

    def r_nodeName(self) -> str:  # noqa: N802
        return self.el.tag.upper() if self.el else f"#{self.node.kind}"

    def r_nodeType(self) -> float:  # noqa: N802
        return {"element": 1.0, "text": 3.0, "comment": 8.0}.get(self.node.kind, 9.0)

    def _attr(self, name: str) -> str:
        return self.el.attrs.get(name, "") if self.el else ""

    def r_id(self) -> str:
        return self._attr("id")

    def r_className(self) -> str:  # noqa: N802
        return self._attr("class")

    def r_value(self) -> str:
        return self._attr("value")

    def _write(self, name: str, value: str) -> None:
        if self.el:
            self.el.attrs[name] = value

    def w_id(self, value: str) -> None:
        self._write("id", value)

    def w_className(self, value: str) -> None:  # noqa: N802
        self._write("class", value)

    def w_value(self, value: str) -> None:
        self._write("value", value)

    def r_textContent(self) -> str:  # noqa: N802
        return self.node.text()

    def w_textContent(self, value: str) -> None:  # noqa: N802
        _replace(self.node, [Node("text", data=value)])

    def r_innerHTML(self) -> str:  # noqa: N802
        return self.el.inner_html() if self.el else self.node.text()

    def w_innerHTML(self, value: str) -> None:  # noqa: N802
        if self.el:
            _replace(self.el, list(parse(value).children))

    def r_outerHTML(self) -> str:  # noqa: N802
        return self.el.outer_html() if self.el else self.node.text()

    def r_children(self) -> object:
        return self.page.array(self.el.elements() if self.el else [])

    def r_childNodes(self) -> object:  # noqa: N802
        return self.page.array(self.node.children)

    def r_parentNode(self) -> object:  # noqa: N802
        return self.page.wrap(self.node.parent)

    r_parentElement = r_parentNode  # noqa: N815

    def r_firstChild(self) -> object:  # noqa: N802
        return self.page.wrap(next(iter(self.node.children), None))

    def _sibling(self, step: int) -> object:
        if self.node.parent is None:
            return None
        around = self.node.parent.children
        k = next(i for i, c in enumerate(around) if c is self.node) + step
        return self.page.wrap(around[k]) if 0 <= k < len(around) else None

    def r_nextSibling(self) -> object:  # noqa: N802
        return self._sibling(1)

    def r_previousSibling(self) -> object:  # noqa: N802
        return self._sibling(-1)

    def r_style(self) -> object:
        return _Style(self.el)

    def m_getAttribute(self, a: list) -> object:  # noqa: N802
        return self.el.attrs.get(self._first_str(a).lower()) if self.el else None

    def m_setAttribute(self, a: list) -> object:  # noqa: N802
        if self.el:
            self.el.attrs[self._first_str(a).lower()] = _str(a, 1) if len(a) > 1 else ""
        return UNDEF

    def m_hasAttribute(self, a: list) -> bool:  # noqa: N802
        return self.el is not None and self._first_str(a).lower() in self.el.attrs

    def m_appendChild(self, a: list) -> object:  # noqa: N802
        if a and isinstance(a[0], _Wrapped):
            self.node.append(a[0].node)
        return _arg(a, 0)

    def m_removeChild(self, a: list) -> object:  # noqa: N802
        if a and isinstance(a[0], _Wrapped):
            self.node.remove(a[0].node)
        return _arg(a, 0)

    def m_remove(self, a: list) -> object:
        if self.node.parent is not None:
            self.node.parent.remove(self.node)
        return UNDEF

    def m_addEventListener(self, a: list) -> object:  # noqa: N802
        return UNDEF  # events don't happen

    m_removeEventListener = m_addEventListener  # noqa: N815


class _Style(Object):
    """element.style: camelCase names over the style attribute."""

    def __init__(self, element: Node | None) -> None:
        super().__init__()
        self.element = element

    def _all(self) -> dict[str, str]:
        pairs = (x.partition(":") for x in self.element.attrs.get("style", "").split(";"))
        return {k.strip().lower(): v.strip() for k, colon, v in pairs if colon and k}

    def get(self, name: str) -> object:
        if self.element is None:
            return ""
        return self.element.attrs.get("style", "") if name == "cssText" else self._all().get(css_name(name), "")

    def set(self, name: str, value: object) -> None:
        if self.element is None:
            return
        text = show(value)
        if name != "cssText":
            found = self._all()
            found.pop(css_name(name), None) if not text else found.update({css_name(name): text})
            text = " ".join(f"{k}: {v};" for k, v in found.items())
        self.element.attrs["style"] = text


def css_name(name: str) -> str:
    return re.sub(r"[A-Z]", lambda m: "-" + m[0].lower(), name)


def _replace(node: Node, children: list[Node]) -> None:
    for c in list(node.children):
        node.remove(c)
    for c in children:
        node.append(c)


def select(root: Node, text: str) -> list[Node]:
    """Elements below ``root`` that match one of the selectors, in document order."""
    wanted = css.selectors(text)
    return [e for e in root.by_tag("*") if any(s.matches(e) for s in wanted)]


class Page:
    """A document with a machine: all scripts of a page share its globals."""

    def __init__(self, document: Node, max_steps: int = MAX_STEPS) -> None:
        self.document, self.machine = document, Machine(max_steps)
        self.wrapped: dict[int, _Wrapped] = {}
        doc = self.wrapped[id(document)] = _Document(self, document)
        window = Object()
        window.set("document", doc)
        self.machine.globals.vars |= {"document": doc, "window": window, "globalThis": window, "alert": self._alert}

    def _alert(self, this: object, a: list) -> object:
        self.machine.console.append(show(a[0]) if a else "")
        return UNDEF

    def wrap(self, node: Node | None) -> object:
        if node is None:
            return None
        return self.wrapped.setdefault(id(node), None) or self.wrapped.__setitem__(id(node), _Element(self, node)) or self.wrapped[id(node)]

    def array(self, nodes: list[Node]) -> Array:
        return Array([self.wrap(n) for n in nodes])

    def run_scripts(self, fetch=None) -> None:  # noqa: ANN001
        """Every script element of a script type, in order; one that fails keeps what it did so far."""
        for e in self.document.by_tag("script"):
            kind = e.attrs.get("type", "").strip()
            if kind and e.attrs["type"].lower() not in ("text/javascript", "application/javascript", "module"):
                continue
            src = e.attrs.get("src", "").strip()
            code = (fetch(src) if fetch else None) if src else e.text()
            if code and code.strip():
                try:
                    self.machine.run(code)
                except ScriptError:
                    continue
